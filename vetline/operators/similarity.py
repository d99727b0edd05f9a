"""Exact vector similarity as a join of blocks that can hold a match.

Vectors fall into the cell of their nearest pivot, at most ``MOST_PIVOTS`` in all, and into blocks of a bounded
number of rows inside it. Blocks of one cell meet first. What a query found there bounds what it can
still gain, and by the triangle inequality on angles a cell whose pivot is further away than that bound
and both cells' radii cannot hold it: only the other pairs of cells meet, through an equi-join on the cell. Nothing
is missed; vectors without any grouping meet all cells. Each meeting is one matrix product in a task; only
the best rows of a query or one summary row per vector leave it. Blocks are sent to shelves, not to meetings: a shelf holds
``SHELF`` gallery blocks, and a query block goes there once for all it meets on it. The driver sees the pivots and one row per
cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.functions.numeric import cosine, fixed_round
from vetline.operators.topk import top_per_group
from vetline.session import cut_lineage

DUPLICATE_AT = 0.72
BLOCK_ROWS = 4096
MOST_PIVOTS = 256
SHELF = 32          # gallery blocks that a copy of a query block meets
SHARE = 64          # query blocks that a copy of a shelf meets


def _pivots(vectors: DataFrame, key: str, vector: str, block_rows: int) -> np.ndarray:
    """Different unit vectors chosen by a hash of their id: one per block, at most MOST_PIVOTS, so that cells fill blocks."""
    some = vectors.filter(F.col(vector).isNotNull())
    wanted = min(MOST_PIVOTS, max(1, some.count() // block_rows))
    rows = some.orderBy(F.xxhash64(F.lit(23), key), key).limit(wanted).select(vector).collect()
    m = np.unique(_unit(np.array([r[0] for r in rows], np.float64)), axis=0) if rows else np.zeros((0, 0))
    return m[np.linalg.norm(m, axis=1) > 0.5] if len(m) else m


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(norm > 1e-6, m / np.where(norm > 1e-6, norm, 1.0), m)


def _kind(df: DataFrame, vector: str) -> str:
    """The type that holds a vector's numbers without loss: what is given in single precision travels so."""
    return "float32" if df.schema[vector].dataType.simpleString() == "array<float>" else "float64"


def _pack(df: DataFrame, key: str, vector: str, prefix: str, pivots: np.ndarray, block_rows: int) -> tuple[DataFrame, dict]:
    """Rows (cell, block, ids, data): vectors of a block, as given, in order of their ids; and of each cell its number of
    blocks and its radius. Blocks come from a hash of the unique id, so their sizes are even. Vectors without a
    direction are in cell -1, which is in reach of all."""
    kind = _kind(df, vector)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            given = [np.asarray(v, dtype=kind) for v in pdf["v"]]
            m = _unit(np.array(given, dtype=np.float64))
            cos = m @ pivots.T if len(pivots) else np.zeros((len(m), 1))
            cell, angle = cos.argmax(1), np.arccos(np.clip(cos.max(1), -1.0, 1.0))
            flat = (np.linalg.norm(m, axis=1) < 0.5) | (len(pivots) == 0)
            yield pd.DataFrame({"cell": np.where(flat, -1, cell).astype(np.int32), "angle": np.where(flat, np.pi, angle),
                                "id": pdf["id"].to_numpy(), "v": [x.tobytes() for x in given]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "block": [int(pdf["block"].iloc[0])],
                             "ids": [pdf["id"].to_numpy()], "data": [b"".join(pdf["v"])]})
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInPandas(
        place, "cell int, angle double, id bigint, v binary")
    cells = {r["cell"]: (-(-r["n"] // block_rows), r["radius"]) for r in rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    sizes = df.sparkSession.createDataFrame([(c, n) for c, (n, _) in sorted(cells.items())], "cell int, blocks int")
    packed = (rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(F.lit(17), "id"), F.col("blocks")).cast("int"))
              .groupBy("cell", "block").applyInPandas(pack, "cell int, block int, ids array<bigint>, data binary"))
    return packed.select(*[F.col(c).alias(f"{prefix}_{c}") for c in packed.columns]), cells


def reachable(pivots: np.ndarray, q_cells: dict, g_cells: dict, bound: dict[int, float]) -> list[tuple[int, int]]:
    """Pairs of cells, other than a cell with itself, where a query may find a similarity of its bound or more."""
    between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0)) if len(pivots) else np.zeros((0, 0))

    def near(a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        # rounding to nine digits and of the angles themselves stays inside the slack
        return between[a, b] - q_cells[a][1] - g_cells[b][1] <= np.arccos(np.clip(bound.get(a, -1.0), -1.0, 1.0)) + 1e-4
    return [(a, b) for a in sorted(q_cells) for b in sorted(g_cells) if a != b and near(a, b)]


def shelves(g_cells: dict, size: int) -> dict[int, int]:
    """The running number of each cell's first block; a block's shelf is its number over ``size``."""
    first, at = {}, 0
    for cell in sorted(g_cells):
        first[cell] = at
        at += g_cells[cell][0]
    return first


def _meet(q: DataFrame, g: DataFrame, q_cells: dict, g_cells: dict, pairs: list[tuple[int, int]], reduce_block: Callable,
          schema: str, kinds: tuple[str, str]) -> DataFrame:
    """The reduced rows of all blocks of the paired cells, with the query's cell."""
    spark = q.sparkSession
    # about as many shelves as shares, and together one a task: the fewest copies of blocks that still fill all tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_blocks, g_blocks = (max(1, sum(n for n, _ in cells.values())) for cells in (q_cells, g_cells))
    size = min(SHELF, -(-g_blocks // math.ceil(math.sqrt(tasks))))
    salts = min(q_blocks, max(-(-q_blocks // SHARE), -(-tasks // -(-g_blocks // size))))
    first = shelves(g_cells, size)
    meets: dict[tuple[int, int], list[int]] = {}
    for a, b in pairs:
        for shelf in range(first[b] // size, (first[b] + g_cells[b][0] - 1) // size + 1):
            meets.setdefault((a, shelf), []).append(b)
    which = spark.createDataFrame([(a, shelf, cells) for (a, shelf), cells in meets.items()], "q_cell int, shelf int, meets array<int>")
    starts = spark.createDataFrame(sorted(first.items()), "g_cell int, first int")
    q = q.join(which, "q_cell").withColumn("salt", F.pmod(F.xxhash64("q_cell", "q_block"), F.lit(salts)))
    g = g.join(starts, "g_cell").withColumn("g_shelf", F.floor((F.col("first") + F.col("g_block")) / size).cast("int")).withColumn(
        "g_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    met = q.join(g, (q["shelf"] == g["g_shelf"]) & (q["salt"] == g["g_salt"]) & F.array_contains(q["meets"], g["g_cell"])).select(
        "q_cell", "q_ids", "q_data", "g_ids", "g_data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell, qi, qd, gi, gd in zip(*[pdf[c] for c in ("q_cell", "q_ids", "q_data", "g_ids", "g_data")]):
                qi, gi = np.asarray(qi), np.asarray(gi)
                a, b = (_unit(np.frombuffer(d, dtype=k).reshape(len(i), -1).astype(np.float64))
                        for d, k, i in ((qd, kinds[0], qi), (gd, kinds[1], gi)))
                # rounding makes equal vectors tie, whatever block they are in
                yield reduce_block(qi, gi, np.round(np.clip(a @ b.T, -1.0, 1.0), 9)).assign(cell=cell)
    return met.mapInPandas(run, schema + ", cell int")


def _block_join(queries: DataFrame, gallery: DataFrame, key: str, vector: str, reduce_block: Callable, schema: str,
                bounds: Callable[[DataFrame], DataFrame], block_rows: int) -> DataFrame:
    """Reduced rows of all meetings that can matter. ``bounds`` turns the rows of the cells' own meetings into
    (cell, bound): the least similarity that a query of the cell can still gain by."""
    pivots = _pivots(gallery, key, vector, block_rows)
    q, q_cells = _pack(queries, key, vector, "q", pivots, block_rows)
    g, g_cells = _pack(gallery, key, vector, "g", pivots, block_rows)
    own = [(c, c) for c in sorted(q_cells) if c in g_cells]
    kinds = _kind(queries, vector), _kind(gallery, vector)
    if len(set(q_cells) | set(g_cells)) > 1:      # otherwise all have met
        q, g = cut_lineage(q), cut_lineage(g)
        first = cut_lineage(_meet(q, g, q_cells, g_cells, own, reduce_block, schema, kinds))
        bound = {r["cell"]: r["bound"] for r in bounds(first).collect()}
        others = reachable(pivots, q_cells, g_cells, bound)
        return first.unionByName(_meet(q, g, q_cells, g_cells, others, reduce_block, schema, kinds)).drop("cell")
    return _meet(q, g, q_cells, g_cells, own, reduce_block, schema, kinds).drop("cell")


def similar_topk(queries: DataFrame, gallery: DataFrame, key: str, vector: str, k: int = 3,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest gallery vectors of each query by cosine, ties by gallery id."""
    def best(qi, gi, s):
        n = min(k, len(gi))
        kth = -np.partition(-s, n - 1, axis=1)[:, n - 1]
        row, col = np.nonzero(s >= kth[:, None])
        sim = s[row, col]
        order = np.lexsort((col, -sim, row))
        row, col, sim = row[order], col[order], sim[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < n
        return pd.DataFrame({"query_id": qi[row[keep]], "match_id": gi[col[keep]], "similarity": sim[keep]})
    def bounds(parts):
        top = top_per_group(parts, ["cell", "query_id"], [F.desc("similarity"), F.col("match_id")], k)
        kth = top.groupBy("cell", "query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(-1.0).alias("kth"))
        return kth.groupBy("cell").agg(F.min("kth").alias("bound"))
    parts = _block_join(queries, gallery, key, vector, best, "query_id bigint, match_id bigint, similarity double",
                        bounds, block_rows)
    return top_per_group(parts, ["query_id"], [F.desc("similarity"), F.col("match_id")], k)


def duplicate_alerts(topk: DataFrame, threshold: float = DUPLICATE_AT) -> DataFrame:
    """Per query whether another document is too similar; the alert is the last such match in rank."""
    hit = (F.col("similarity") >= threshold) & (F.col("match_id") != F.col("query_id"))
    at = F.when(hit, F.col("rank"))
    return topk.groupBy("query_id").agg(
        F.max(hit).alias("duplicate_detected"), F.max_by("match_id", at).alias("alert_id"),
        fixed_round(F.max_by("similarity", at), 3).alias("alert_similarity"))


def stored_matches(topk: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Matches kept with a case; the document itself is not left out."""
    return topk.filter(F.col("similarity") >= threshold)


def pair_summary(vectors: DataFrame, key: str, vector: str, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs, one row per vector: how many others reach the threshold, and the closest one."""
    def summarise(qi, gi, s):
        s = np.where(qi[:, None] == gi[None, :], -2.0, s)
        best = s.max(axis=1)
        # ids are sorted, so the first maximum is the smallest id
        return pd.DataFrame({"id": qi, "partners": (s >= threshold).sum(axis=1), "best_similarity": best,
                             "best_id": gi[s.argmax(axis=1)]})
    def bounds(parts):
        highest = parts.groupBy("cell", "id").agg(F.max("best_similarity").alias("b"))
        return highest.groupBy("cell").agg(F.least(F.min("b"), F.lit(float(threshold))).alias("bound"))
    parts = _block_join(vectors, vectors, key, vector, summarise,
                        "id bigint, partners bigint, best_similarity double, best_id bigint", bounds, block_rows)
    best = F.max(F.struct("best_similarity", (-F.col("best_id")).alias("neg"))).alias("b")
    out = parts.filter("best_similarity > -2").groupBy("id").agg(F.sum("partners").alias("partners"), best)
    return out.select("id", "partners", (-F.col("b.neg")).alias("best_id"),
                      fixed_round(F.col("b.best_similarity"), 4).alias("best_similarity"))


def paired_similarity(vectors: DataFrame, entity: str, kind: str, key: str, vector: str, kinds: tuple[str, str]) -> DataFrame:
    """Similarity of an entity's two kinds; the first vector of each kind counts, so the join is one to one."""
    firsts = vectors.filter(F.col(kind).isin(*kinds)).groupBy(entity).agg(*[
        F.min_by(vector, F.when(F.col(kind) == k, F.col(key))).alias(f"_{i}") for i, k in enumerate(kinds)])
    out = firsts.filter("_0 is not null and _1 is not null").withColumn("similarity", cosine(F.col("_0"), F.col("_1")))
    band = F.when(F.col("similarity") >= 0.75, "MATCH").when(F.col("similarity") >= 0.50, "BORDERLINE").otherwise("MISMATCH")
    return out.select(entity, "similarity", band.alias("result"))
