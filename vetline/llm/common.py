"""What several operators of this package share: reading, storing, links to components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.session import scratch_path

#: One word, as all contracts of this package define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps start from files that
    outlive any executor, and columns stay prunable."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b) from each row of ``nodes`` (id).

    Every round hooks each root to the smallest label seen next to its tree and then jumps labels,
    so the rounds grow with the logarithm of the longest path. Only nodes that have links take part
    in the rounds. A round is a join and a partial minimum: a node with very many links costs one
    partial row a task. More than ``max_rounds`` rounds is an error, never a wrong result.
    """
    both = stored(links.filter("a <> b").select("a", "b").unionByName(
        links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp"))
                    .select(F.col("a").alias("id"), "comp"), "labels")
    for _ in range(max_rounds):
        around = (both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near")))
        seen = labels.join(around, labels["id"] == around["a"]).select("id", "comp", "near")
        # what a member sees also moves the root of its tree
        hooks = (seen.select(F.col("comp").alias("id"), "near")
                 .unionByName(seen.select("id", "near")).groupBy("id").agg(F.min("near").alias("near")))
        hooked = labels.join(hooks, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        hooked = stored(hooked, "hooked")
        target = hooked.select(F.col("id").alias("t"), F.col("comp").alias("t_comp"))
        step = stored(hooked.join(target, hooked["comp"] == target["t"]).select(
            "id", "old", F.least("comp", "t_comp").alias("comp")), "labels")
        labels = step.select("id", "comp")
        if step.filter("comp <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    named = labels.withColumnRenamed("id", "_id")
    return nodes.join(named, nodes["id"] == named["_id"], "left").select(
        "id", F.coalesce("comp", "id").alias("component"))


def batches(items, most: int):
    """Lists of ``items`` holding texts of about ``most`` characters together."""
    part, size = [], 0
    for x in items:
        part.append(x)
        size += len(x[1] or "") + 64
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def texts_of(batch, key: int = 0, text: int = 1):
    """(key, text) of an Arrow batch, one row at a time."""
    keys, texts = batch.column(key), batch.column(text)
    for i in range(batch.num_rows):
        yield keys[i].as_py(), texts[i].as_py()

