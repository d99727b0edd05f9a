"""Mixing sources to target weights, with DataFrame functions only.

1. Sizes: words per document. A source's target is its weight's share of ``share`` times all words, at
   most ``repeat`` times its own words; the excess is shared again by weight. With sources ordered by
   (limit / weight) that is one running sum over one row per source.
2. Documents fall into blocks of their source by hash: about the square root of all documents many, so
   neither a block nor the list of a source's blocks grows large, and a source that holds a third of
   all rows is as spread as the rest. Blocks are permuted by hash. A source takes its words in whole
   passes over its blocks, then whole blocks in permuted order, then part of one block, whose
   documents are permuted too: each source meets its target to the word.
3. The blocks a source takes are its quota. A binary tree deals the quotas to output shards: at each
   node one multivariate hypergeometric draw (exact, by inverse distribution, from hashed uniforms)
   says how many blocks of each source go left. Shards then own disjoint ranges of each source's
   permuted blocks, and rows are shuffled inside their shard by hash.

Everything random is a hash of ids, so runs agree.

Cases: null or blank texts have size 0 and are taken 0 times; a null source is a source, last in
order; repeated rows count each; an empty table gives no rows; other columns are carried along by
``mixed_documents`` and ignored by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from vetline.llm.common import WORD, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2
SHARDS = 16
#: Documents of a shard that one task shuffles.
ROWS_A_TASK = 50_000
SEED = "mix-1"
OWN = "_mix_"      # prefix of columns added to carried rows


def _digest(*parts) -> F.Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(SEED)))


def _number(digest) -> F.Column:
    """60 bits of a digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame, blocks: int) -> DataFrame:
    """``docs`` with size, block and permutation key."""
    return docs.withColumns({
        OWN + "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        OWN + "key": _digest(F.col("doc_id")),
    }).withColumn(OWN + "block", F.pmod(_number(F.col(OWN + "key")), F.lit(blocks)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, source_rank, source_size, target) from rows (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy()      # one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = (totals.withColumn("source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
              .withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * repeat)
              .withColumn("ratio", F.col("most") / F.col("weight"))
              .withColumn("wanted", F.sum("source_size").over(everything).cast("double") * share))
    below = W.orderBy("ratio", "source_rank").rowsBetween(W.unboundedPreceding, -1)
    levels = ranked.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(below), F.lit(0.0)))
                               / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    # the first source, by ratio, that the level does not fill up sets the level of all
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_rank", "level"))).over(everything)
    return levels.withColumn("at", F.coalesce(level["level"], F.lit(float("inf")))).select(
        "source", "source_rank", "source_size", F.least("most", F.col("weight") * F.col("at")).alias("target"))


def _log_factorial(n: str) -> str:
    """SQL for ln(n!), by Stirling's series from 8 on."""
    small = ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(8))
    z = f"({n} + 1.0D)"
    return (f"if({n} < 8, element_at(array({small}), cast({n} as int) + 1), "
            f"({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)))")


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"


def _hypergeometric(all_: str, good: str, drawn: str, uniform: str) -> str:
    """SQL for how many of ``drawn`` blocks out of ``all_`` are among ``good`` ones, by inverse distribution."""
    chance = f"exp({_log_choose(good, 'k')} + {_log_choose(f'({all_} - {good})', f'({drawn} - k)')} - {_log_choose(all_, drawn)})"
    low, high = f"greatest(0L, {drawn} - ({all_} - {good}))", f"least({good}, {drawn})"
    return (f"aggregate(sequence({low}, {high}), named_struct('below', 0D, 'at', cast(null as bigint)), "
            f"(c, k) -> if(c.at is not null, c, named_struct('below', c.below + {chance}, "
            f"'at', if(c.below + {chance} >= {uniform}, k, cast(null as bigint)))), c -> coalesce(c.at, {high}))")


def deal(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(source_rank, shard, first, last): which of a source's taken blocks, by place, each shard owns.

    ``quotas`` is (source_rank, quota), one row per source. ``shards`` is a power of two.
    """
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("source_rank", "quota"))).alias("q")).filter("size(q) > 0").select(
        F.lit(1).cast("long").alias("node"), F.col("q.quota").alias("q"))
    draw = _hypergeometric("acc.rest", "q[i]", "acc.free", f"(pmod(xxhash64(node, i, '{SEED}'), 1099511627776L) + 0.5D) / 1099511627776D")
    step = (f"aggregate(sequence(0, size(q) - 1), named_struct('free', total div 2, 'rest', total, 'left', cast(array() as array<bigint>)), "
            f"(acc, i) -> transform(array({draw}), k -> named_struct('free', acc.free - k, 'rest', acc.rest - q[i], "
            f"'left', concat(acc.left, array(k))))[0], acc -> acc.left)")
    for _ in range(shards.bit_length() - 1):
        split = nodes.withColumn("total", F.expr("aggregate(q, 0L, (a, x) -> a + x)")).withColumn("left", F.expr(step))
        nodes = split.select(F.explode(F.expr(
            "array(named_struct('node', 2 * node, 'q', left), "
            "named_struct('node', 2 * node + 1, 'q', zip_with(q, left, (a, b) -> a - b)))")).alias("child")).select("child.*")
    dealt = nodes.select((F.col("node") - shards).cast("int").alias("shard"), F.posexplode("q").alias("at", "n"))
    ranks = quotas.select("source_rank", (F.row_number().over(W.orderBy("source_rank")) - 1).alias("at"))
    upto = W.partitionBy("source_rank").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    return dealt.join(ranks, "at").withColumn("last", F.sum("n").over(upto)).select(
        "source_rank", "shard", (F.col("last") - F.col("n")).alias("first"), "last")


def taken_blocks(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, shards: int = SHARDS) -> DataFrame:
    """One row per (source, block): whole passes, words left for the last pass, and the shard of each pass."""
    targets = stored(source_targets(sizes, weights, share, repeat), "targets")
    blocks = sizes.groupBy("source", "block").agg(F.sum("size").alias("words"))
    quota = F.floor(F.col("target") + 1e-6).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    blocks = (blocks.withColumnRenamed("source", "b_source").join(targets, F.col("source").eqNullSafe(F.col("b_source"))).drop("b_source")
              .withColumn("passes", F.least(passes, F.lit(repeat))).withColumn("rest", quota - F.col("passes") * F.col("source_size"))
              .withColumn("perm", _digest(F.lit("block"), F.col("block"), F.col("source_rank"))))
    order = W.partitionBy("source_rank").orderBy("perm", "block")
    blocks = (blocks.withColumn("place", F.row_number().over(order) - 1)
              .withColumn("blocks", F.count(F.lit(1)).over(W.partitionBy("source_rank")))
              .withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("left", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
              .withColumn("copies", F.col("passes") + F.when(F.col("left") > 0, 1).otherwise(0)))
    blocks = stored(blocks.select("source", "source_rank", "source_size", "target", "block", "place", "blocks", "passes", "left", "copies"), "blocks")
    quotas = blocks.groupBy("source_rank").agg(F.sum("copies").alias("quota"))
    dealt = stored(deal(quotas, shards), "dealt")
    copies = blocks.filter("copies > 0").select("source_rank", "block", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("pass"),
                                                "place", "blocks")
    at = F.col("pass") * F.col("blocks") + F.col("place")
    owned = copies.join(dealt, "source_rank").filter((at >= F.col("first")) & (at < F.col("last")))
    shards_of = owned.groupBy("source_rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("passes_in"))
    return blocks.join(shards_of, ["source_rank", "block"], "left").select(
        F.col("source").alias(OWN + "b_source"), F.col("block").alias(OWN + "b_block"), F.col("source_size").alias(OWN + "source_size"),
        F.col("target").alias(OWN + "target"), F.col("passes").alias(OWN + "passes"), F.col("left").alias(OWN + "left"),
        F.transform(F.coalesce("passes_in", F.array().cast("array<struct<pass:int,shard:int>>")), lambda p: p["shard"]).alias(OWN + "shards"))


def _take(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Words taken of each measured row."""
    joined = rows.join(blocks, F.col("source").eqNullSafe(F.col(OWN + "b_source")) & (F.col(OWN + "block") == F.col(OWN + "b_block")))
    inside = (W.partitionBy(OWN + "b_source", OWN + "b_block").orderBy(OWN + "key", OWN + "size", "doc_id")
              .rowsBetween(W.unboundedPreceding, -1))
    return joined.withColumn(OWN + "last", F.greatest(F.lit(0), F.least(
        F.col(OWN + "size"), F.col(OWN + "left") - F.coalesce(F.sum(OWN + "size").over(inside), F.lit(0))))).withColumn(
        OWN + "taken", F.col(OWN + "passes") * F.col(OWN + "size") + F.col(OWN + "last"))


def _block_count(docs: DataFrame) -> int:
    return max(1, math.ceil(math.sqrt(docs.count())))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards): words the mix takes of each document, and the shards of its passes."""
    rows = stored(measured(docs.select("doc_id", "source", "text"), _block_count(docs)).drop("text"), "sizes")
    sizes = rows.select("source", F.col(OWN + "block").alias("block"), F.col(OWN + "size").alias("size"))
    return _take(rows, taken_blocks(sizes, weights, share, repeat, shards)).select("doc_id", *[
        F.col(OWN + c).alias(c) for c in ("size", "source_size", "target", "taken", "shards")])


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, shards: int = SHARDS) -> DataFrame:
    """The mix itself: a row per pass over a document, with the columns of ``docs``.

    Rows come partitioned by shard and shuffled inside it, in as many slices of a shard as its documents need. The one document of a source whose last pass
    is only partly needed ends after the words taken.
    """
    blocks = _block_count(docs)
    # the number of documents is about the square of that of blocks
    slices = max(16, math.ceil(blocks * blocks / (shards * ROWS_A_TASK)))
    keyed = measured(docs, blocks)
    sizes = stored(keyed.select("source", F.col(OWN + "block").alias("block"), F.col(OWN + "size").alias("size")), "sizes")
    rows = _take(keyed, taken_blocks(sizes, weights, share, repeat, shards))
    size, last, passes = (F.col(OWN + c) for c in ("size", "last", "passes"))
    copies = passes + F.when(last > 0, 1).otherwise(0)
    rows = rows.filter((copies > 0) & (size > 0)).withColumn(OWN + "pass", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    partly = (F.col(OWN + "pass") > passes) & (last < size)
    first_words = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.greatest(last, F.lit(1)).cast("int")), " ")
    rows = rows.withColumn("text", F.when(partly, first_words).otherwise(F.col("text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows
    shard = F.coalesce(F.get(OWN + "shards", F.col(OWN + "pass") - 1), F.lit(0))
    order = F.xxhash64(OWN + "key", OWN + "pass")
    return (rows.withColumn(OWN + "shard", shard).withColumn(OWN + "order", order)
            .repartition(OWN + "shard", F.pmod(F.col(OWN + "order"), F.lit(slices)))
            .sortWithinPartitions(OWN + "shard", OWN + "order").select(*docs.columns))


#: The rows of mix() without the shards, in DuckDB's SQL.
ORACLE = f"""
with base as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '') || ':{SEED}') as k, greatest(1, ceil(sqrt(count(*) over ())))::bigint as nb from documents),
doc as (select *, ('0x' || k[1:15])::bigint % nb as block from base),
totals as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as r from doc group by source),
ranked as (select *, [3.0::double, 1.0::double, 2.0::double][(r % 3 + 1)::int] as weight, source_size::double * 2 as most,
    (sum(source_size) over ())::double * 1.5 as wanted from totals),
leveled as (select *, most / weight as ratio, (wanted - coalesce(sum(most) over below, 0.0)) / (sum(weight) over () - coalesce(sum(weight) over below, 0.0)) as level
    from ranked window below as (order by most / weight, r rows between unbounded preceding and 1 preceding)),
chosen as (select coalesce(min_by(level, r0) filter (level <= ratio), 'infinity'::double) as lvl from
    (select *, row_number() over (order by ratio, r) as r0 from leveled)),
targets as (select source, r, source_size, least(most, weight * lvl) as target from leveled, chosen),
planned as (select *, floor(target + 1e-6)::bigint as quota from targets),
passed as (select *, case when source_size > 0 then least(quota // source_size, 2) else 0 end as passes from planned),
blocks as (select p.*, d.block, d.words, p.quota - p.passes * p.source_size as rest, md5('block:' || d.block || ':' || p.r || ':{SEED}') as perm
    from (select source, block, sum(size)::bigint as words from doc group by all) d join passed p on p.source is not distinct from d.source),
drawn as (select *, greatest(0, least(words, rest - coalesce(sum(words) over (partition by r order by perm, block rows between unbounded preceding and 1 preceding), 0))) as remains from blocks)
select d.doc_id, d.size, b.source_size, b.target, (b.passes * d.size + greatest(0, least(d.size, b.remains - coalesce(sum(d.size) over
    (partition by b.r, b.block order by d.k, d.size, d.doc_id rows between unbounded preceding and 1 preceding), 0))))::bigint as taken
from doc d join drawn b on b.source is not distinct from d.source and b.block = d.block
"""
