"""A fold kept up to date by a stream, with bounded state.

Three tables of cells (``tables``): the folded rows; the state of each key behind each slice of positions; and one head a key:
its last slice, the state behind it and the state in front of it. A batch folds, of the keys it touches, from the slice of
their earliest new row on. For rows in order this is the last slice: the head gives the state to start
from, and the history is not read. A row that comes late starts from the state in front of its slice, and
the later slices of its key, and only they, are folded again. What a batch reads and writes
depends on the batch and on the cells that it touches, not on how much came before.

Cells must hold rows of many keys to be worth a file: a slice is ``width`` positions, a bucket one of ``buckets`` parts of the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vetline.operators.folds import Fold, same_key
from vetline.sources.folders import Folder
from vetline.streaming.tables import CellTable, Commits, bucket_of, stream_of

WIDTH = 1 << 20
BUCKETS = 8


class FoldedTable:
    def __init__(self, spark: SparkSession, path: str, fold: Fold, schema: StructType, width: int = WIDTH, buckets: int = BUCKETS):
        self.spark, self.fold, self.schema, self.width, self.buckets = spark, fold, schema, width, buckets
        key = schema[fold.key].dataType.simpleString()
        own = f"`{fold.key}` {key}"
        state = fold.state_type

        def table(name: str, ddl: str) -> CellTable:
            return CellTable(spark, path, name, spark.createDataFrame([], ddl).schema)
        self.rows = table("rows", fold.schema)
        self.states = table("states", f"{own}, _state {state}")
        self.heads = table("heads", f"{own}, _last bigint, _state {state}, _before {state}")
        self.done, self.work = Commits(spark, path), Folder(spark, f"{path}/_work")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` computed once for this batch."""
        path = f"{self.work.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self) -> DataFrame:
        """All folded rows."""
        return self.rows.read(self.rows.current(self.done.last())).select(*self.rows.schema.names)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Fold the rows of one batch in; the same batch twice counts once."""
        key, stream, last = self.fold.key, stream_of(batch), self.done.last()
        version = self.done.next(stream, number)
        if version is None:
            return
        for table in (self.rows, self.states, self.heads):
            table.undo(version)
        new = self._kept(batch.select(*self.schema.names, F.floor(F.col(self.fold.position) / self.width).cast("long").alias("_slice"),
                                  bucket_of(key, self.buckets).alias("_bucket")), "batch")
        touched = {(r[0], r[1]) for r in new.select("_slice", "_bucket").distinct().collect()}
        if not touched:
            self.done.add(version, stream, number)
            return
        buckets = {b for _, b in touched}
        heads = self.heads.current(last, [0])
        old_heads = self.heads.read({c: v for c, v in heads.items() if c[1] in buckets})
        since = self._kept(self._since(new, old_heads), "since")
        late = since.filter("_late")
        redo = set(touched)
        states = self.states.current(last, [s for s in self.states.slices() if s >= min(s for s, _ in touched)])
        if not late.isEmpty():
            # late keys: the states in front of their rows, and the cells behind that hold more of them
            late_buckets = {r[0] for r in late.select("_bucket").distinct().collect()}
            history = self.states.read({c: v for c, v in self.states.current(last).items() if c[1] in late_buckets})
            met = self._kept(same_key(history, late.select(key, "_from"), key, "inner"), "met")
            redo |= {(r[0], r[1]) for r in met.filter("_slice >= _from").select("_slice", "_bucket").distinct().collect()}
            front = met.filter("_slice < _from").groupBy(key).agg(F.max_by("_state", "_slice").alias("_front"))
            since = same_key(since, front, key, "left").withColumn("_state", F.when(F.col("_late"), F.col("_front")).otherwise(F.col("_state"))).drop("_front")
        current = self.rows.current(last, {s for s, _ in redo})
        cells = {c: current[c] for c in redo if c in current}
        marked = same_key(self.rows.read(cells), since.select(key, "_from"), key, "left")
        again = F.coalesce(F.col("_slice") >= F.col("_from"), F.lit(False))
        to_fold = marked.filter(again).select(*self.schema.names, "_slice", "_bucket").unionByName(new)
        ready = same_key(to_fold, since.select(key, "_state"), key, "left").withColumn("_session", F.lit(0).cast("long"))
        walked = self._kept(self.fold.run(ready, True, ["_slice", "_bucket"]), "walked")
        self.rows.write(walked.select(*self.rows.schema.names, "_slice", "_bucket").unionByName(
            marked.filter(~again).select(*self.rows.schema.names, "_slice", "_bucket")), version)

        behind = self._kept(self.fold.ends(walked, "_slice", "_bucket"), "behind")
        old_states = same_key(self.states.read({c: states[c] for c in redo if c in states}), since.select(key, "_from"), key, "left")
        self.states.write(behind.unionByName(old_states.filter(~again).select(*behind.columns)), version)

        in_order = W.partitionBy(key).orderBy("_slice")
        fronts = same_key(behind, since.select(key, F.col("_state").alias("_start")), key, "left").withColumn(
            "_before", F.when(F.lag(F.lit(1)).over(in_order) == 1, F.lag("_state").over(in_order)).otherwise(F.col("_start")))
        newest = fronts.groupBy(key, "_bucket").agg(F.max_by(F.struct("_slice", "_state", "_before"), "_slice").alias("h")).select(
            key, F.col("h._slice").alias("_last"), F.col("h._state").alias("_state"), F.col("h._before").alias("_before"), "_bucket")
        kept = same_key(old_heads, since.select(key), key, "left_anti").select(*newest.columns)
        self.heads.write(newest.unionByName(kept).withColumn("_slice", F.lit(0).cast("long")), version)

        self.done.add(version, stream, number)
        self.rows.clear(redo, version)
        self.states.clear(redo, version)
        self.heads.clear({(0, b) for b in buckets}, version)
        self.work.delete("")

    def _since(self, new: DataFrame, heads: DataFrame) -> DataFrame:
        """Per touched key: the slice to fold from, the state to start from, and whether the head does not know that state."""
        key = self.fold.key
        first = new.groupBy(key, "_bucket").agg(F.min("_slice").alias("_from"))
        known = same_key(first, heads.select(key, "_last", "_state", "_before"), key, "left")
        return known.select(
            key, "_bucket", "_from", F.coalesce(F.col("_from") < F.col("_last"), F.lit(False)).alias("_late"),
            F.when(F.col("_from") > F.col("_last"), F.col("_state")).when(F.col("_from") == F.col("_last"), F.col("_before")).alias("_state"))
