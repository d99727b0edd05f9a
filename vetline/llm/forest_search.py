"""Nearest neighbours by a forest of random-projection trees.

1. ``TREES`` trees are grown on a bounded sample (``SAMPLE`` vectors): a node splits at the median of the
   projection on the difference of two random vectors. A tree has at most ``MOST_LEAVES`` leaves, so the
   forest's size is bounded. Every vector is then filed in one leaf of each tree; equal vectors are one
   entry with its ``k`` + 1 smallest ids, which is all that a result can hold.
2. A query walks all trees through one shared priority queue, ordered by the squared margins crossed so
   far, until the leaves taken hold ``SHARE`` of the entries. On vectors without clusters, like random ones
   in 64 dimensions, a small recall loss needs a large share; lower it for data with structure.
3. The leaves of a tree form ``RUNS`` runs, cut into blocks of bounded size. Blocks of queries meet blocks of entries by equi-join and
   are reranked exactly in numpy, double precision; each meeting returns its best few per query.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do
rows without id; lengths must agree with the query's; repeated rows of one id count once; fewer candidates
than ``k`` are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from vetline.llm.common import stored
from vetline.llm.vectors import packed, stacked, usable

TREES = 4
SAMPLE = 20_000
LEAF = 64
MOST_LEAVES = 1024
RUNS = 16
SHARE = 1.5
#: Entries or queries of one block.
BLOCK = 4096
SEED = 11


class Tree:
    """Inner nodes as arrays; children below zero are leaves, -1 - number."""

    def __init__(self, vectors: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normal, self.at, self.left, self.right, self.leaves = [], [], [], [], 0
        self._grow(vectors, np.arange(len(vectors)), leaf, rng)
        self.normal = np.array(self.normal).reshape(len(self.at), vectors.shape[1])
        self.at = np.array(self.at)

    def _grow(self, v: np.ndarray, rows: np.ndarray, leaf: int, rng) -> int:
        side = np.zeros(0, bool)
        if len(rows) > leaf:
            a, b = v[rng.choice(rows, 2, replace=False)]
            normal = (a - b) / max(np.linalg.norm(a - b), 1e-12)
            along = v[rows] @ normal
            at = float(np.median(along))
            side = along > at
        if not side.any() or side.all():
            self.leaves += 1
            return -self.leaves
        me = len(self.at)
        self.normal.append(normal)
        self.at.append(at)
        self.left.append(0)
        self.right.append(0)
        self.left[me] = self._grow(v, rows[~side], leaf, rng)
        self.right[me] = self._grow(v, rows[side], leaf, rng)
        return me

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        where = np.full(len(v), 0 if len(self.at) else -1)
        left, right = np.array(self.left), np.array(self.right)
        while (inner := np.flatnonzero(where >= 0)).size:
            node = where[inner]
            over = np.einsum("ij,ij->i", v[inner], self.normal[node]) > self.at[node]
            where[inner] = np.where(over, right[node], left[node])
        return -1 - where


def leaves_for(query: np.ndarray, trees: list[Tree], counts: list[np.ndarray], wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue, until they hold ``wanted`` entries."""
    margins = [t.normal @ query - t.at if len(t.at) else None for t in trees]
    queue = [(0.0, i, 0 if len(t.at) else -1) for i, t in enumerate(trees)]
    out, seen = [], 0
    while queue and seen < wanted:
        crossed, i, node = heapq.heappop(queue)
        if node < 0:
            out.append((i, -1 - node))
            seen += int(counts[i][-1 - node])
            continue
        m = float(margins[i][node])
        near, far = (trees[i].right[node], trees[i].left[node]) if m > 0 else (trees[i].left[node], trees[i].right[node])
        heapq.heappush(queue, (crossed, i, near))
        heapq.heappush(queue, (crossed + m * m, i, far))
    return out


def _entries(rows: DataFrame, keep: int) -> DataFrame:
    """(node, dims, ids, vec): distinct vectors with their smallest ids."""
    best = W.partitionBy("node").orderBy("vec_id")
    marked = rows.dropDuplicates(["vec_id", "node"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    few = marked.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("embedding", "rank").alias("embedding"))
    return packed(few.withColumn("dims", F.size("embedding")))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = TREES, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest cosines of each row whose id is divisible by ``every``."""
    rows = vectors.filter(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("embedding").alias("node"), "embedding")
    entries = stored(_entries(rows, k + 1), "entries")
    spark = vectors.sparkSession
    sizes = {r["dims"]: r["n"] for r in entries.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    result = None
    for dims, total in sorted(sizes.items()):
        found = _search(rows.filter(F.size("embedding") == dims), entries.filter(F.col("dims") == dims), total, every, k, trees, share)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return result


def _search(rows: DataFrame, entries: DataFrame, total: int, every: int, k: int, n_trees: int, share: float) -> DataFrame:
    sample = entries.filter(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / total) * (1 << 20)))
    got = sorted((r["node"], bytes(r["vec"])) for r in sample.select("node", "vec").collect())
    base = stacked([g[1] for g in got]) if got else stacked([bytes(entries.select("vec").first()[0])])
    rng = np.random.default_rng(SEED)
    leaf = max(2, LEAF * len(base) // total, -(-2 * len(base) // MOST_LEAVES))
    forest = [Tree(base, leaf, rng) for _ in range(n_trees)]

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                v = stacked(frame["vec"])
                yield pd.concat([frame.assign(tree=i, leaf=t.leaf_of(v)) for i, t in enumerate(forest)])

    filed = stored(entries.select("node", "ids", "vec").mapInPandas(file, "node long, ids array<long>, vec binary, tree int, leaf int"), "filed")
    counts = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in filed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).collect():      # at most TREES * MOST_LEAVES rows
        counts[r["tree"]][r["leaf"]] = r["n"]
    per_run = max(-(-len(c) // RUNS) for c in counts)
    run = F.floor(F.col("leaf") / per_run).cast("int")
    sizes = {(i, g): int(c[g * per_run:(g + 1) * per_run].sum()) for i, c in enumerate(counts) for g in range(-(-len(c) // per_run))}
    blocks = rows.sparkSession.createDataFrame([(i, g, n // BLOCK + 1) for (i, g), n in sizes.items()], "tree int, run int, blocks int")
    filed = filed.withColumn("run", run).join(F.broadcast(blocks), ["tree", "run"]).withColumn("block", F.pmod(F.col("node"), F.col("blocks")).cast("int"))
    index = filed.groupBy("tree", "run", "block").agg(F.collect_list(F.struct("leaf", "ids", "vec")).alias("entries"))

    queries = packed(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "node"]).withColumnRenamed("vec_id", "query_id").select("query_id", "embedding"))
    wanted = max(share * total, 10 * k)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for query, vec in zip(frame["query_id"], frame["vec"]):
                runs: dict[tuple[int, int], list[int]] = {}
                for i, x in leaves_for(np.frombuffer(vec, np.float64), forest, counts, wanted):
                    runs.setdefault((i, x // per_run), []).append(x)
                out += [(query, vec, i, g, x) for (i, g), x in runs.items()]
            yield pd.DataFrame(out, columns=["query_id", "vec", "tree", "run", "leaves"])

    queries = stored(queries, "queries")
    n_queries = queries.count()
    # a number of its own, as few bytes mean a long walk here: all cores work, and no task walks more than a block
    queries = queries.repartition(max(1, -(-n_queries // BLOCK), min(n_queries, rows.sparkSession.sparkContext.defaultParallelism)), "query_id")
    walked = queries.mapInPandas(walk, "query_id long, vec binary, tree int, run int, leaves array<int>")
    asked = walked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_queries // BLOCK + 1))).groupBy("tree", "run", "part").agg(
        F.collect_list(F.struct("query_id", "vec", "leaves")).alias("queries"))
    asked = asked.join(F.broadcast(blocks), ["tree", "run"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def rerank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[int, int, float]] = []
            for asked_rows, filed_rows in zip(frame["queries"], frame["entries"]):
                q, v = stacked([x["vec"] for x in asked_rows]), stacked([x["vec"] for x in filed_rows])
                leaf_no = np.array([x["leaf"] for x in filed_rows])
                score = q @ v.T
                taken = np.zeros((len(q), leaf_no.max() + 1), bool)
                for r, x in enumerate(asked_rows):
                    inside = np.asarray(x["leaves"])
                    taken[r, inside[inside < taken.shape[1]]] = True
                score[~taken[:, leaf_no]] = -np.inf
                for r, x in enumerate(asked_rows):
                    line = score[r]
                    least = np.partition(line, -(k + 1))[-(k + 1)] if len(line) > k + 1 else -np.inf
                    for j in np.flatnonzero((line >= least) & (line > -np.inf)).tolist():
                        out += [(x["query_id"], int(i), line[j]) for i in filed_rows[j]["ids"] if i != x["query_id"]]
            both = pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).drop_duplicates(["query_id", "vec_id"])
            yield both.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    met = asked.join(index, ["tree", "run", "block"]).select("queries", "entries").mapInPandas(rerank, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score")).alias("score")))
