"""Sliced operators equal plain windows, also for a key that holds a third of the rows."""

import hashlib

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vetline.operators import folds
from vetline.operators.audit import chain_summary, first_break
from vetline.operators.layout import exact_median
from vetline.operators.ordered import global_sequence, with_cut, with_earlier_max, with_lag, with_rank, with_segment


def hot(spark, n=3000):
    """Key 0 holds a third of the rows; positions are unique and have gaps."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") * 3 + F.col("id") % 2).alias("pos"), (F.xxhash64("id") % 1000).alias("v"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lag_rank_and_running_max(spark):
    df = hot(spark)
    w = W.partitionBy("k").orderBy("pos")
    assert rows(with_lag(df, ["k"], "pos", ["v"], 64)) == rows(df.withColumn("prev_v", F.lag("v").over(w)))
    assert rows(with_rank(df, ["k"], "pos", 64)) == rows(df.withColumn("rank", F.row_number().over(w).cast("bigint")))
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    assert rows(with_earlier_max(df, ["k"], "pos", {"m": F.col("v")}, 64)) == rows(
        df.withColumn("m", F.max("v").over(earlier)))


def test_only_long_keys_are_cut(spark):
    df = hot(spark)
    cut = with_cut(df, ["k"], "pos", 200)
    sizes = cut.groupBy("k", "_cut").agg(F.count("*").alias("n")).collect()
    assert {r["k"] for r in sizes if r["_cut"] is not None} == {0}
    assert max(r["n"] for r in sizes if r["k"] == 0) <= 210 and sum(r["k"] == 0 for r in sizes) <= 6
    sparse = spark.range(300).select(F.lit(None).cast("string").alias("k"), (F.col("id") * 10 ** 12).alias("pos"), F.col("id").alias("v"))
    assert with_cut(sparse, ["k"], "pos", 100).select("_cut").distinct().count() == 3
    assert rows(with_lag(sparse, ["k"], "pos", ["v"], 100).select("v", "prev_v")) == sorted([(i, i - 1 if i else None) for i in range(300)], key=str)


def test_no_checkpoint_and_one_shuffle_of_the_rows(spark):
    df = hot(spark)
    for out in (with_lag(df, ["k"], "pos", ["v"]), with_rank(df, ["k"], "pos"), with_earlier_max(df, ["k"], "pos", {"m": F.col("v")})):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and plan.count("Window") >= 1


def test_rank_behind_other_columns(spark):
    df = hot(spark).withColumn("g", F.col("v") % 4)
    w = W.partitionBy("k").orderBy("g", "pos")
    for slice_rows in (64, 1 << 20):
        assert rows(with_rank(df, ["k"], "pos", slice_rows, ahead=["g"])) == rows(df.withColumn("rank", F.row_number().over(w).cast("bigint")))


def test_segments_are_bounded_and_in_order(spark):
    df = hot(spark)
    seg, rounds = with_segment(df, ["k"], "pos", 100)
    sizes = seg.groupBy("k", "_seg").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    got = sizes.orderBy("k", "_seg").collect()
    assert rounds > 5 and max(r["n"] for r in got) <= 125
    for a, b in zip(got, got[1:]):
        assert a["k"] != b["k"] or a["hi"] < b["lo"]


def test_global_sequence(spark):
    df = hot(spark).select("pos")
    got = sorted(map(tuple, global_sequence(df, ["pos"]).collect()))
    assert [s for _, s in got] == list(range(1, 3001))


def test_exact_median(spark):
    df = hot(spark).withColumn("x", F.col("v") * F.when(F.col("v") % 7 == 0, 1e6).otherwise(1.0))
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("x").alias("m")).collect()}
    for accuracy in (10, 50, 10000):
        got = {r["k"]: r["median"] for r in exact_median(df, "k", "x", accuracy).collect()}
        assert got == want
    same = spark.range(10).select(F.lit(1).alias("k"), F.lit(2.5).alias("x"))
    assert exact_median(same, "k", "x").first()["median"] == 2.5


def events(spark, n=900):
    return hot(spark, n).select(
        F.col("k").alias("chain_id"), F.col("pos").alias("id"), F.timestamp_seconds(F.col("pos") * 20).alias("ts"),
        F.lit("SYSTEM").alias("actor"), F.lit("STEP").alias("event_type"), F.col("v").cast("string").alias("payload"))


def plain_chain(df):
    heads, out = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        head = heads.get(r["chain_id"], "0" * 64)
        payload = hashlib.sha256(r["payload"].encode()).hexdigest()
        text = "|".join([str(r["chain_id"]), head, r["ts"].strftime("%Y-%m-%dT%H:%M:%SZ"), r["actor"], r["event_type"], payload])
        heads[r["chain_id"]] = out[r["id"]] = hashlib.sha256(text.encode()).hexdigest()
    return out


def test_chain_in_one_and_in_many_segments(spark):
    df = events(spark)
    want = plain_chain(df)
    for segment in (folds.SEGMENT_ROWS, 40):
        got = {r["id"]: r["event_hash"] for r in folds.build_chain(df, segment_rows=segment).collect()}
        assert got == want


def test_planted_faults_are_found(spark):
    chain = folds.build_chain(events(spark, 300)).cache()
    hot_ids = [r["id"] for r in chain.filter("chain_id = 0").orderBy("id").collect()]

    def verdict(log):
        return next(r for r in first_break(log, slice_rows=16).collect() if r["chain_id"] == 0)
    assert verdict(chain)["is_valid"]
    altered = chain.withColumn("payload_hash", F.when(F.col("id") == hot_ids[40], F.sha2("payload_hash", 256)).otherwise(
        F.col("payload_hash")))
    assert (verdict(altered)["tampered_at_event_id"], verdict(altered)["fault"]) == (hot_ids[40], "HASH")
    removed = verdict(chain.filter(F.col("id") != hot_ids[40]))
    assert (removed["tampered_at_event_id"], removed["fault"]) == (hot_ids[41], "LINK")
    assert verdict(chain.filter(F.col("id") != hot_ids[-1]))["is_valid"]  # a cut tail cannot be seen
    ends = {r["chain_id"]: r for r in chain_summary(chain, spark.range(60).withColumnRenamed("id", "chain_id")).collect()}
    assert ends[55]["total_events"] == 0 and ends[55]["head_hash"] == "0" * 64


def plain_throttle(df, limit, seconds):
    kept, out = {}, {}
    for r in sorted(df.collect(), key=lambda r: r["id"]):
        t = r["ts"].timestamp()
        live = [x for x in kept.get(r["chain_id"], []) if x > t - seconds]
        out[r["id"]] = len(live) < limit
        kept[r["chain_id"]] = live + [t] if out[r["id"]] else live
    return out


def test_throttle_counts_only_accepted(spark):
    df = events(spark).select("chain_id", "id", "ts")
    want = plain_throttle(df, 3, 600)
    for segment in (folds.SEGMENT_ROWS, 40):
        got = {r["id"]: r["accepted"] for r in folds.throttle(df, "chain_id", "id", "ts", 3, 600, segment).collect()}
        assert got == want
    t = F.unix_seconds("ts")
    rolling = df.withColumn("n", F.count("*").over(W.partitionBy("chain_id").orderBy(t).rangeBetween(-599, 0)))
    naive = {r["id"]: r["n"] <= 3 for r in rolling.collect()}
    assert naive != want  # a rolling count is a different rule


def test_quiet_gaps_cut_a_hot_key_without_rounds(spark):
    """A key of many rows that rests now and then is one round of sessions; times before a gap do not count behind it."""
    busy = spark.range(4000).select(
        F.when(F.col("id") % 4 == 3, F.col("id") % 30).otherwise(0).alias("chain_id"), F.col("id"),
        F.timestamp_seconds(F.col("id") * 7 + F.floor(F.col("id") / 100) * 3600 + F.pmod(F.xxhash64("id"), F.lit(40))).alias("ts"))
    at = busy.withColumn("_at", F.unix_micros("ts"))
    cut, rounds = with_segment(at, ["chain_id"], "id", 200, 50, ("_at", 600_000_000))
    sessions = cut.filter("chain_id = 0").groupBy("_session").agg(F.count("*").alias("n")).collect()
    assert rounds == 1 and len(sessions) > 15 and max(r["n"] for r in sessions) <= 200
    assert cut.filter("chain_id <> 0").agg(F.max("_session")).first()[0] == 0
    _, without = with_segment(at, ["chain_id"], "id", 200, 50)
    assert without > 10
    want = plain_throttle(busy, 5, 600)
    for segment in (folds.SEGMENT_ROWS, 200, 20):
        got = {r["id"]: r["accepted"] for r in folds.throttle(busy, "chain_id", "id", "ts", 5, 600, segment).collect()}
        assert got == want


def test_state_crosses_more_than_one_segment(spark):
    """Accepted events of a segment before the last still count when the window reaches back to them."""
    df = spark.createDataFrame([(1, i, i) for i in range(40)], "chain_id int, id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    want = plain_throttle(df, 3, 25)
    assert {r["id"]: r["accepted"] for r in folds.throttle(df, "chain_id", "id", "ts", 3, 25, 4).collect()} == want


def test_event_without_a_time_is_denied(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 6), (None, 4, 1), (None, 5, None)], "k int, id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["accepted"] for r in folds.throttle(df, "k", "id", "ts", 2, 60).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_event_exactly_one_window_later_is_free(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 60), (1, 3, 61)], "k int, id int, s int").withColumn(
        "ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["accepted"] for r in folds.throttle(df, "k", "id", "ts", 1, 60).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_updates_of_one_case_follow_each_other(spark):
    from vetline.operators.filters import apply_status
    cases = spark.createDataFrame([(1, "NEW"), (2, "NEW")], "id int, status string")
    updates = spark.createDataFrame([(1, 7, "cleared"), (1, 3, " escalated "), (1, 5, "gone"), (9, 1, "CLEARED")],
                                    "case_id int, seq bigint, status string")
    got = sorted(tuple(r) for r in apply_status(cases, updates).na.fill(0).collect())
    assert got == [(1, 3, "NEW", "ESCALATED", True), (1, 7, "ESCALATED", "CLEARED", True), (2, 0, "NEW", "NEW", False)]


def test_numbering_is_the_order_of_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(400)], "a int, b int")
    got = {(r["a"], r["b"]): r["seq"] for r in global_sequence(df, ["a", "b"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == sorted(got)
    assert global_sequence(df.filter("a > 9"), ["a"]).count() == 0
