"""Streams with bounded state: any order of files, growth of the history, failures between writes, null keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vetline.operators import folds
from vetline.streaming.folded import FoldedTable
from vetline.streaming.registered import Registry
from vetline.streaming.tables import CellTable, Commits


def events(spark, n, keys=7, start=0):
    """Key 0 holds a third of the rows, some keys are null."""
    k = F.col("id")
    return spark.range(start, start + n).select(
        F.when(k % 3 == 0, 0).when(k % 41 == 1, None).otherwise(k % keys).cast("bigint").alias("chain_id"), "id",
        F.timestamp_seconds(1700000000 + k * 25).alias("ts"), F.lit("SYSTEM").alias("actor"), F.lit("STEP").alias("event_type"),
        k.cast("string").alias("payload"))


def folders(path):
    return sorted(os.path.relpath(d, path) for d, _, files in os.walk(path) if any(f.endswith(".parquet") for f in files))


def as_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def chained(spark, path, df, **more):
    return FoldedTable(spark, str(path), folds.chain_fold(df.schema), df.schema, **more)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_equal_one(spark, tmp_path, seed):
    df = events(spark, 200)
    rng = random.Random(seed)
    ids = list(range(200))
    if seed == 2:
        rng.shuffle(ids)                                  # every row late
    else:
        ids = [*range(100, 160), 3, *range(160, 200), *range(3), *range(4, 100)]
    cuts = [0, 60, 61, 110, 200]
    chain = chained(spark, tmp_path / "c", df, width=70, buckets=2)
    limited = df.select("chain_id", "id", "ts")
    quota = FoldedTable(spark, str(tmp_path / "t"), folds.throttle_fold(limited.schema, "chain_id", "id", "ts", 3, 900), limited.schema, 70, 2)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = df.filter(F.col("id").isin(ids[a:b]))
        chain.apply(part, n)
        chain.apply(part, n)                              # again: counts once
        quota.apply(part.select(*limited.columns), n)
    assert as_rows(chain.read(), "id", "previous_hash", "event_hash") == as_rows(folds.build_chain(df), "id", "previous_hash", "event_hash")
    want = folds.throttle(limited, "chain_id", "id", "ts", 3, 900)
    assert as_rows(quota.read(), "id", "accepted") == as_rows(want, "id", "accepted")
    cells = [os.path.dirname(f) for f in folders(tmp_path / "c")]
    assert len(cells) == len(set(cells))                  # one version of each cell is left


def test_cost_of_a_batch_does_not_grow_with_history(spark, tmp_path, monkeypatch):
    """Rows and cells that a batch in order reads, after a short and after a ten times longer history."""
    read = []
    plain = CellTable.read
    monkeypatch.setattr(CellTable, "read", lambda self, cells: read.append((self.name, len(cells), plain(self, cells).count())) or plain(self, cells))
    seen = {}
    for blocks in (1, 10):
        df = events(spark, blocks * 60, start=0)
        table = chained(spark, tmp_path / str(blocks), df, width=60, buckets=2)
        table.apply(df, 0)
        read.clear()
        table.apply(events(spark, 30, start=blocks * 60), 1)
        table.apply(events(spark, 30, start=blocks * 60 + 30), 2)
        seen[blocks] = (sum(c for _, c, _ in read), sum(n for _, _, n in read))
    assert seen[10][0] <= seen[1][0] and seen[10][1] <= 2 * seen[1][1], seen


def test_late_row_refolds_its_key_only(spark, tmp_path):
    df = events(spark, 400)
    table = chained(spark, tmp_path / "c", df, width=50, buckets=8)
    table.apply(df.filter("id <> 55"), 0)
    before = set(folders(tmp_path / "c" / "rows"))
    table.apply(df.filter("id = 55"), 1)
    changed = set(folders(tmp_path / "c" / "rows")) - before
    assert 0 < len(changed) < len(before) and len({f.split("/")[1] for f in changed}) == 1
    assert as_rows(table.read(), "id", "event_hash") == as_rows(folds.build_chain(df), "id", "event_hash")


@pytest.mark.parametrize("fails", ["rows", "states", "heads", "mark"])
def test_failed_batch_leaves_no_trace(spark, tmp_path, monkeypatch, fails):
    df = events(spark, 120)
    table = chained(spark, tmp_path / "c", df, width=30, buckets=2)
    table.apply(df.filter("id < 70"), 0)
    before = as_rows(table.read(), "id", "event_hash")
    with monkeypatch.context() as m:
        write = CellTable.write

        def broken(self, rows, version):
            write(self, rows, version)
            if self.name == fails:
                raise OSError("lost")
        m.setattr(CellTable, "write", broken)
        if fails == "mark":
            m.setattr(Commits, "add", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.apply(df.filter("id >= 70"), 1)
    assert as_rows(table.read(), "id", "event_hash") == before
    table.apply(df.filter("id >= 70"), 1)
    assert as_rows(table.read(), "id", "event_hash") == as_rows(folds.build_chain(df), "id", "event_hash")


def test_null_key_is_registered_once_over_many_batches(spark, tmp_path):
    df = events(spark, 200).select("chain_id", "id")
    registry = Registry(spark, str(tmp_path / "r"), "chain_id", df.schema, buckets=4)
    for n in range(5):
        registry.register(df.filter((F.col("id") >= n * 40) & (F.col("id") < n * 40 + 40)), n, ["id"])
        registry.register(df.filter("id = 199"), n, ["id"])       # seen under this number
    want = {r["chain_id"]: r["id"] for r in df.groupBy("chain_id").agg(F.min("id").alias("id")).collect()}
    got = registry.read().collect()
    assert {r["chain_id"]: r["id"] for r in got} == want and len(got) == len(want) and None in want
    registry.register(df.limit(0), 5, ["id"])
    assert registry.read().count() == len(want)


def test_registration_reads_only_touched_buckets(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("k"), F.col("id"))
    registry = Registry(spark, str(tmp_path / "r"), "k", df.schema, buckets=32)
    registry.register(df, 0, ["id"])
    plan = registry._read([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    files = registry._read([3, 5]).select(F.input_file_name()).distinct().collect()
    assert {f[0].split("bucket=")[1].split("/")[0] for f in files} == {"3", "5"}


def test_registration_of_a_failed_batch_does_not_count(spark, tmp_path, monkeypatch):
    df = spark.range(20).select(F.col("id").alias("k"), F.col("id"))
    registry = Registry(spark, str(tmp_path / "r"), "k", df.schema, buckets=2)
    registry.register(df.filter("id < 10"), 0, ["id"])
    with monkeypatch.context() as m:
        m.setattr(Commits, "add", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            registry.register(df.filter("id < 15"), 1, ["id"])
    assert registry.read().count() == 10
    registry.register(df.filter("id < 15"), 1, ["id"])
    assert registry.read().count() == 15


def test_a_second_stream_into_the_same_table_is_not_skipped(spark, tmp_path):
    """Batch numbers of another stream start from nothing again; its rows count."""
    from vetline.streaming import operators as st
    df = events(spark, 90).select("chain_id", "id", "ts")
    df.filter("id < 50").coalesce(1).write.parquet(str(tmp_path / "a"))
    df.filter("id >= 50").coalesce(1).write.parquet(str(tmp_path / "b"))
    for name in "ab":
        s = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
        out = st.throttle_stream(s, "chain_id", "id", "ts", 2, 300, str(tmp_path / "t"), str(tmp_path / f"ck-{name}"))
    assert as_rows(out, "id", "accepted") == as_rows(folds.throttle(df, "chain_id", "id", "ts", 2, 300), "id", "accepted")
