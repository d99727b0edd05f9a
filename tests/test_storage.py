"""Files hashed in chunks, batches written whole or not at all, components over a shrinking graph."""

import hashlib
import os
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from vetline.operators import clustering
from vetline.sources import files, tables


def wide(spark, lo, hi):
    finding = F.struct(F.lit("ELA").alias("technique"), (F.col("id") * 1.5).alias("score"))
    return spark.range(lo, hi).select("id", F.lit("NEW").alias("status"), F.timestamp_seconds(1700000000 + F.col("id") * 86400).alias("created_at"),
                                      F.array(finding, finding).alias("tamper_findings"))


def counts(spark, base):
    return tables.read_screenings(spark, base).count(), tables.read_screenings(spark, base, "tamper_findings").count()


def test_write_that_fails_between_two_tables(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "cases")
    assert tables.write_screenings(wide(spark, 0, 10), base, "b1")
    plain = DataFrameWriter.parquet

    def broken(self, path, *args, **kw):
        if "/tamper_findings/batch=b2" in path:
            raise OSError("lost")
        return plain(self, path, *args, **kw)
    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", broken)
        with pytest.raises(OSError):
            tables.write_screenings(wide(spark, 10, 15), base, "b2")
    assert os.path.isdir(f"{base}/screenings/batch=b2") and counts(spark, base) == (10, 20)   # the parent's rows lie there and do not count
    assert tables.write_screenings(wide(spark, 10, 15), base, "b2")
    assert counts(spark, base) == (15, 30)


def test_repeated_batch_counts_once(spark, tmp_path):
    base = str(tmp_path / "cases")
    for again in (True, False, False):
        assert tables.write_screenings(wide(spark, 0, 7), base, "2024-01-01") is again
    assert counts(spark, base) == (7, 14)
    assert tables.write_screenings(wide(spark, 7, 9), base, "2024-01-02") and counts(spark, base) == (9, 18)
    with pytest.raises(ValueError):
        tables.write_screenings(wide(spark, 0, 1), base, "a/b")


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_files_are_hashed_in_chunks(spark, tmp_path, chunk):
    rng = random.Random(1)
    want = {}
    for i, name in enumerate(["a.jpg", "sub/b.JPG", "sub/deep/c.png", "d.txt", "e.webp", "_hidden.jpg", "empty.png", "f g.jpeg"]):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        body = b"" if "empty" in name else rng.randbytes(1000 + i)
        path.write_bytes(body)
        if not name.endswith(".txt") and not name.startswith("_"):
            want[path.name] = (len(body), hashlib.sha256(body).hexdigest())
    got = files.chunked_inventory(spark, [str(tmp_path / "in")], chunk=chunk)
    assert {r["filename"]: (r["length"], r["sha256"]) for r in got.collect()} == want
    plain = files.inventory(spark, [str(tmp_path / "in")])
    full = got.filter("length > 0").select("filename", "length", "sha256")     # Spark's own reader passes over empty files
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, plain.select(*full.columns).collect()))


def test_many_small_files_share_a_task_and_no_file_is_read_on_the_driver(spark, tmp_path, monkeypatch):
    from vetline.sources import digests
    for i in range(30):
        (tmp_path / f"{i}.png").write_bytes(b"x" * 100)
    reader = digests.DigestReader({"paths": str(tmp_path), "extensions": "png", "chunk": "10"})
    assert [len(p.files) for p in reader.partitions()] == [30]
    monkeypatch.setattr(digests, "PARTITION", 5 * (1 << 20))
    assert len(reader.partitions()) > 5


def test_rows_become_files_in_place_and_a_second_attempt_changes_nothing(spark, tmp_path):
    base = f"file://{tmp_path}/out"
    rows = spark.range(300).selectExpr("concat(id % 7, '/', id, '.txt') name", "if(id % 50 = 0, '', concat('é', repeat('x', cast(id as int)))) content")
    for _ in range(2):
        assert files.write_files(rows.repartition(5), base) == 300
    want = {r["name"].split("/")[1]: r["content"].encode() for r in rows.collect()}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == want
    assert sum(p.is_dir() for p in (tmp_path / "out").rglob("*")) == 7     # none for a single file
    got = files.chunked_inventory(spark, [base], ["txt"])
    assert {r["filename"]: (r["length"], r["sha256"]) for r in got.collect()} == {
        n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in want.items()}
    assert files.write_files(rows.limit(0), base) == 0


def plain_components(ids, pairs):
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in ids}


@pytest.mark.parametrize("kind", ["chain", "stars", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    n = 400
    names = list(range(n))
    pairs = {"chain": list(zip(names, names[1:])), "none": [],
             "stars": [(n - 1, i) for i in range(0, n - 1, 2)] + [(5, i) for i in range(7, n, 4)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] + [(3, 3), (4, 8), (8, 4)]}[kind]
    links = spark.createDataFrame(pairs or [(0, 0)], "a long, b long")
    got = {r["id"]: r["component"] for r in clustering.components(spark.range(n), links, "id").collect()}
    assert got == plain_components(range(n), pairs)


def test_rounds_shrink(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long")
    sizes = [links.count()]
    while sizes[-1]:
        _, links = clustering.contracted(links, len(sizes))
        sizes.append(links.count())
    assert len(sizes) < 10 and all(b <= .6 * a for a, b in zip(sizes, sizes[1:])), sizes
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        clustering.components(spark.range(201), chain, "id", max_rounds=1)
