"""Operators against brute force on small fixtures."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetline.operators import clustering, filters, joins, layout, similarity, topk
from vetline.plans import classify, crosscheck, extraction, screening
from vetline.sources import files, tables
from vetline.streaming import operators as st
from vetline import schemas


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(150, 16))
    m[50:100] = m[0]          # a third are copies
    m[120] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, v array<double>")
    return m, df


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 1e-6, m / np.where(n > 1e-6, n, 1), m)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_topk_is_exact_for_any_block_size(vectors, block):
    m, df = vectors
    s = np.round(unit(m) @ unit(m).T, 9)
    got = {}
    for r in similarity.similar_topk(df, df, "id", "v", 3, block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["match_id"]
    for q in range(len(m)):
        want = sorted(range(len(m)), key=lambda i: (-s[q, i], i))[:3]
        assert [got[q][r] for r in (1, 2, 3)] == want


def test_blocks_travel_to_shelves_as_given(spark, vectors, monkeypatch):
    m, df = vectors
    m = m.astype(np.float32).astype(np.float64)
    single = df.select("id", df["v"].cast("array<float>").alias("v"))
    packed, cells = similarity._pack(single, "id", "v", "q", np.zeros((0, 0)), 40)
    assert {len(r["q_data"]) / len(r["q_ids"]) for r in packed.collect()} == {16 * 4}     # four bytes a number
    # blocks of a cell on two shelves, cells that share one, shelves shared out
    monkeypatch.setattr(similarity, "SHELF", 3)
    monkeypatch.setattr(similarity, "SHARE", 2)
    assert similarity.shelves({-1: (1, 0), 0: (4, 0), 2: (2, 0)}, 3) == {-1: 0, 0: 1, 2: 5}
    s = np.round(unit(m) @ unit(m).T, 9)
    got = {(r["query_id"], r["rank"]): r["match_id"] for r in similarity.similar_topk(single, single, "id", "v", 3, 12).collect()}
    assert got == {(q, r + 1): i for q in range(len(m)) for r, i in enumerate(sorted(range(len(m)), key=lambda i: (-s[q, i], i))[:3])}


def test_groups_of_vectors_meet_only_their_own_cells(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 24)) * 10
    rows = [(i, (centers[i % 6 if i % 3 else 0] + rng.standard_normal(24) * .2).tolist()) for i in range(600)]
    df = spark.createDataFrame([*rows, (600, [0.0] * 24)], "id bigint, v array<double>")
    pivots = similarity._pivots(df, "id", "v", 40)
    _, cells = similarity._pack(df, "id", "v", "q", pivots, 40)
    met = similarity.reachable(pivots, cells, cells, {c: 0.9 for c in cells})
    assert len(cells) > 6 and len([p for p in met if min(p) >= 0]) < len(cells) ** 2 / 2
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(m @ m.T, 9)
    np.fill_diagonal(cos, -2)
    got = {r["id"]: r for r in similarity.pair_summary(df, "id", "v", 0.9, 40).collect()}
    assert all(got[i]["partners"] == (cos[i] >= 0.9).sum() and got[i]["best_id"] == cos[i].argmax() for i in range(600))
    assert got[600]["partners"] == 0
    top = {(r["query_id"], r["rank"]): r["similarity"] for r in similarity.similar_topk(df, df, "id", "v", 3, 40).collect()}
    assert all(abs(top[i, 2] - cos[i].max()) < 1e-8 and abs(top[i, 3] - np.sort(cos[i])[-2]) < 1e-8 for i in range(600))


def test_pair_summary(vectors):
    m, df = vectors
    s = np.round(unit(m) @ unit(m).T, 9)
    np.fill_diagonal(s, -2)
    for r in similarity.pair_summary(df, "id", "v", 0.72, 32).collect():
        assert r["partners"] == int((s[r["id"]] >= 0.72).sum())
        assert r["best_id"] == int(s[r["id"]].argmax())


def test_planted_copy_is_the_alert(vectors):
    _, df = vectors
    alerts = {r["query_id"]: r for r in similarity.duplicate_alerts(
        similarity.similar_topk(df, df, "id", "v", 3, 64)).collect()}
    assert alerts[0]["duplicate_detected"] and alerts[0]["alert_id"] == 51 and alerts[0]["alert_similarity"] == 1.0


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(5)
    docs = [(i, f"N{rng.integers(0, 120)}" if rng.random() < .5 else None, f"S{rng.integers(0, 60)}",
             f"G{rng.integers(0, 4)}" if rng.random() < .9 else None) for i in range(300)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(docs, 2):
        same = (a[1] and a[1] == b[1]) or (a[2] == b[2] and (not a[3] or not b[3] or a[3] == b[3]))
        if same:
            ra, rb = find(a[0]), find(b[0])
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(docs, "id bigint, document_number string, surname string, given_names string")
    got = clustering.components(df, clustering.person_links(df, "id"), "id").collect()
    assert {r["id"]: r["component"] for r in got} == {i: find(i) for i in range(300)}


def test_long_chain_of_links(spark):
    nodes = spark.range(200)
    links = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert clustering.components(nodes, links, "id").select("component").distinct().collect()[0][0] == 0


def test_first_break_of_append_once(spark):
    stored = spark.createDataFrame([("a",)], "k string")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "k string, n int")
    assert [tuple(r) for r in joins.append_once(stored, new, "k", ["n"]).collect()] == [("b", 2)]


def test_best_pair_equals_all_pairs_with_small_slices(spark, sf_dir):
    from vetline.feeds import frame
    lines = extraction.line_rows(frame(spark, sf_dir, "travel_texts"), "doc_id", "text")
    c = extraction.candidate_lines(lines, "doc_id", "2026-07-01 12:00:00").cache()
    one = sorted(map(tuple, extraction.best_pair(c, "doc_id").collect()))
    assert one == sorted(map(tuple, extraction.best_pair(c, "doc_id", slice_rows=2).collect()))


def test_reasons_keep_their_place_in_slices(spark):
    rows = [(1, 2 if i % 3 else 6, i * 5, "HIGH" if i % 2 else "LOW", "c") for i in range(60)] + [(2, 1, 0, "INFO", "c")]
    df = spark.createDataFrame(rows, "case_id int, step int, seq bigint, severity string, category string")
    got = sorted((r["case_id"], r["place"], r["seq"]) for r in screening.order_reasons(df, 16).collect())
    rank = {"HIGH": 1, "LOW": 3, "INFO": 4}
    want = [(1, i + 1, r[2]) for i, r in enumerate(sorted(rows[:60], key=lambda r: (rank[r[3]], r[1], r[2])))]
    assert got == sorted([*want, (2, 1, 0)])


def test_reading_order_is_sorted(spark, sf_dir):
    from vetline.feeds import frame
    got = [(r["page"], r["top"], r["left"]) for r in layout.reading_order(
        layout.lines_from_tokens(frame(spark, sf_dir, "tokens"), slice_width=300)).collect()]
    assert got == sorted(got)


def test_line_text_does_not_depend_on_slices(spark, sf_dir):
    from vetline.feeds import frame
    t = frame(spark, sf_dir, "tokens")
    key = lambda df: sorted((r["page"], r["line_num"], r["text"], r["confidence"]) for r in df.collect())
    assert key(layout.lines_from_tokens(t)) == key(layout.lines_from_tokens(t, slice_width=10))


def test_one_edit_is_one_mismatch(spark):
    cols = "id int, name string, date_of_birth string, sex string, nationality string, passport_number string, date_of_expiry string"
    ref = spark.createDataFrame([(1, "DOE JOHN", "1990-01-02", "M", "IND", "Z1", "2030-01-01")], cols)
    obs = spark.createDataFrame([(1, "JOHN DOE", "02/01/1990", "MALE", None, "Z2", "2030-01-01")], cols)
    diffs = crosscheck.field_diff(ref, obs, "id")
    assert {r["field"]: r["status"] for r in diffs.collect()} == {
        "name": "MATCH", "date_of_birth": "MATCH", "sex": "MATCH", "nationality": "UNKNOWN",
        "passport_number": "MISMATCH", "date_of_expiry": "MATCH"}
    s = crosscheck.diff_summary(diffs, "id").first()
    assert (s["overall_severity"], s["consistency_label"]) == ("CRITICAL", "Field Consistency: 4/6 matched")


@pytest.mark.parametrize("page,verdict,kind", [
    ("AADHAAR\n1234", "UNSUPPORTED_DOCUMENT", "AADHAAR"), ("short", "UNABLE_TO_CLASSIFY", "RANDOM_OR_UNREADABLE"),
    ("REPUBLIC OF INDIA\nPASSPORT\nSurname\nDate of Birth", "PASSPORT", "PASSPORT"),
    ("PASSPORT COVER\nREPUBLIC OF INDIA", "PASSPORT", "PASSPORT_COVER"),
    ("VISA\nNUMBER OF ENTRIES 2\nVALID UNTIL 2030", "VISA", "VISA"),
    ("VISA CATEGORY\nENTRIES\nP<INDDOE<<JO<<<<<<<<<<<<<<<<<<<\nP<INDDOE<<JO<<<<<<<<<<<<<<<<<<<", "VISA", "VISA"),
    ("an ordinary letter\nof two lines", "UNSUPPORTED_DOCUMENT", "OTHER_DOCUMENT")])
def test_classification(spark, page, verdict, kind):
    r = classify.classify_text(spark.createDataFrame([(1, page)], "id int, text string"), "id", "text").first()
    assert (r["verdict"], r["detected_type"]) == (verdict, kind)


def test_minimised_columns(spark):
    df = spark.createDataFrame([("h" * 64, "x" * 300)], "document_hash string, note string")
    with pytest.raises(ValueError, match="note"):
        filters.assert_minimised(df)
    with pytest.raises(ValueError, match="full_name"):
        filters.assert_minimised(df.withColumnRenamed("note", "full_name"))
    assert filters.assert_minimised(df.drop("note")).count() == 1


def test_scope_and_pages(spark):
    df = spark.createDataFrame([(i, f"CP-{i % 2}", i) for i in range(10)], "id int, checkpoint_id string, created_at int")
    assert filters.scope_for(df, None, "CP-1 ").count() == 5
    assert filters.scope_for(df, "admin", "CP-1").count() == filters.scope_for(df, "OFFICER", " ").count() == 10
    assert [r["id"] for r in topk.page(df, 0, -3).collect()] == [9]


# -- files ------------------------------------------------------------------------------

def test_inventory_and_admission(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.JPG").write_bytes(b"\xff\xd8\xff123")
    (tmp_path / "y.png").write_bytes(b"\xff\xd8\xff123")
    (tmp_path / "z.txt").write_bytes(b"\xff\xd8\xff123")
    inv = files.inventory(spark, [str(tmp_path)])
    seen = {r["filename"]: r["duplicate_of"] for r in joins.first_seen(inv, "sha256", ["filename"]).collect()}
    assert seen == {"x.JPG": None, "y.png": "x.JPG"}
    rows = [("a.jpg", b""), ("a.gif", b"\xff\xd8\xff"), ("a.jpeg", b"GIF8"), ("a b.WEBP", b"RIFF0000WEBP1"),
            ("n.png", b"\x89PNG\r\n\x1a\n"), ("png", b"\x89PNG\r\n\x1a\n"), ("big.jpg", b"\xff\xd8\xff" + b"0" * files.MAX_BYTES)]
    got = files.admit(spark.createDataFrame(rows, "filename string, content binary")).collect()
    assert [(r["refused"], r["media_type"]) for r in got] == [
        ("EMPTY", None), ("EXTENSION", None), ("CONTENT", None), (None, "image/webp"), (None, "image/png"),
        ("EXTENSION", None), ("TOO_LARGE", None)]


def test_nested_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"version": "1", "records": [{"internal_id": "D1", "has_mrz": true,\n '
                                     '"field_availability": {"sex": "UNKNOWN"}}, {"internal_id": "D2"}]}')
    got = files.read_records(spark, str(tmp_path)).orderBy("internal_id").collect()
    assert [r["internal_id"] for r in got] == ["D1", "D2"] and got[0]["field_availability"] == {"sex": "UNKNOWN"}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "r.json").write_text('{"document_type": "VISA", "rules": [{"rule_id": "A"},\n {"rule_id": "B"}]}')
    assert files.read_rules(spark, str(tmp_path / "r")).count() == 2


def test_old_files_read_under_the_new_schema(spark, tmp_path):
    spark.createDataFrame([(1, "s")], "id int, screening_id string").write.parquet(str(tmp_path / "face_results"))
    df = tables.load(spark, str(tmp_path), "face_results")
    assert df.columns == schemas.TABLES["face_results"].fieldNames() and df.first()["provider"] is None
    old = spark.createDataFrame([(1,)], "id int")
    assert schemas.evolve(old, schemas.TABLES["face_results"]).first()["quality_status"] == "GOOD"


# -- streams -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """Audit events in four files, in order of time."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    df = spark.range(240).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("bigint").alias("chain_id"), "id",
        F.timestamp_seconds(1700000000 + F.col("id") * 25).alias("ts"), F.lit("SYSTEM").alias("actor"),
        F.lit("STEP").alias("event_type"), F.col("id").cast("string").alias("payload"))
    for i in range(4):
        df.filter((F.col("id") >= i * 60) & (F.col("id") < (i + 1) * 60)).coalesce(1).write.mode("append").parquet(path)
    return path, df


def _read_stream(spark, path, df):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_equal_batch(spark, event_files, tmp_path):
    from vetline.operators import folds
    path, df = event_files
    out = st.chain_stream(_read_stream(spark, path, df), str(tmp_path / "c"), str(tmp_path / "cc"))
    want = {r["id"]: r["event_hash"] for r in folds.build_chain(df).collect()}
    assert {r["id"]: r["event_hash"] for r in out.collect()} == want
    limited = _read_stream(spark, path, df).select("chain_id", "id", "ts")
    out = st.throttle_stream(limited, "chain_id", "id", "ts", 2, 300, str(tmp_path / "t"),
                          str(tmp_path / "tc"))
    want = {r["id"]: r["accepted"] for r in folds.throttle(df, "chain_id", "id", "ts", 2, 300).collect()}
    assert {r["id"]: r["accepted"] for r in out.collect()} == want and not all(want.values())


def test_registration_is_at_most_once_across_runs(spark, event_files, tmp_path):
    path, df = event_files
    registry = str(tmp_path / "registry")
    for run in ("a", "b"):  # the second run starts from nothing and sees all events again
        s = _read_stream(spark, path, df).select("chain_id", "id", "ts")
        rows = st.anchor_stream(s, "chain_id", registry, str(tmp_path / f"ck-{run}"), ["id"])
    assert rows.count() == rows.select("chain_id").distinct().count() == df.select("chain_id").distinct().count()
    assert os.path.isdir(registry)


# -- rows of any order, type and key ---------------------------------------------------------

def test_streams_over_shuffled_part_files_equal_batch(spark, sf_dir, tmp_path):
    import __spark_entry__  # noqa: F401  registers the queries
    from vetline.registry.core import QUERIES
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(4, F.xxhash64("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    for stream, batch in (("throttle_stream", "throttle_accepted_only"),):
        got = QUERIES[stream](spark, str(tmp_path))
        want = QUERIES[batch](spark, str(tmp_path)).select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.count() == table.count()
    chain = QUERIES["audit_chain_stream"](spark, str(tmp_path))
    want = QUERIES["audit_chain_stream"](spark, sf_dir)
    assert sorted(map(tuple, chain.collect())) == sorted(map(tuple, want.collect()))
    anchors = QUERIES["anchor_stream"](spark, str(tmp_path)).collect()
    assert len(anchors) == table.select("user_id").distinct().count() + 1 and {r["n"] for r in anchors} == {1}


def test_folds_keep_large_ids_and_null_keys(spark):
    from vetline.operators import folds
    rows = [(None, 9007199254740993, "2026-01-01 00:00:00", None), (None, 9007199254740995, "2026-01-01 00:00:01", 9007199254740993),
            (1, 9007199254740997, "2026-01-01 00:00:02", 9007199254740993)]
    df = spark.createDataFrame(rows, "chain_id long, id long, ts string, extra long").withColumn("ts", F.col("ts").cast("timestamp"))
    full = df.withColumns({"actor": F.lit("a"), "event_type": F.lit("e"), "payload": F.lit("{}")})
    for seg in (4_000_000, 1):
        chain = folds.build_chain(full, segment_rows=seg).orderBy("id").collect()
        assert [(r["id"], r["extra"]) for r in chain] == [(r[1], r[3]) for r in rows]
        assert chain[1]["previous_hash"] == chain[0]["event_hash"] != chain[2]["previous_hash"]
        flags = folds.throttle(df, "chain_id", "id", "ts", 1, 60, segment_rows=seg).orderBy("id").collect()
        assert [r["accepted"] for r in flags] == [True, False, True] and [r["id"] for r in flags] == [r[1] for r in rows]


def test_rounding_of_large_sums(spark):
    from vetline.functions.numeric import fixed_round
    assert spark.range(1).select(fixed_round(F.lit(1e15 + 0.25), 1).alias("x")).first()["x"] == 1e15 + 0.3


def test_dossier_sorts_no_children(spark):
    """Rows of a case stream past the ids of their partition, so that a task's memory does not grow with them."""
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cases = joins.section("screening", spark.range(40).selectExpr("id", "'x' code"), "id", code=F.col("code"))
        kids = [joins.section(n, spark.range(500).selectExpr("if(id % 3 = 0, 7, id) screening_id", "id seq"), position=F.col("seq")) for n in "ab"]
        df = joins.dossier(cases, kids)
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        got = {(r["section"], r["case_id"]): r["count"] for r in df.groupBy("section", "case_id").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    want = {("screening", i): 1 for i in range(40)}
    want |= {(n, i): 1 for n in "ab" for i in range(40) if i % 3 and i != 7}
    assert got == want | {("a", 7): 168, ("b", 7): 168}


def test_line_confidence_is_that_of_the_lines_without_their_slices(spark, sf_dir):
    from vetline.feeds import frame
    t = frame(spark, sf_dir, "tokens")
    t = t.unionByName(t.limit(50).withColumn("conf", F.lit(None).cast("double")))
    short = layout.line_confidence(t)
    assert short._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert sorted(map(str, short.collect())) == sorted(map(str, layout.lines_from_tokens(t).select(short.columns).collect()))
