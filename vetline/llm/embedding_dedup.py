"""Embedding near-duplicates on a robust-pruned flat graph.

Only vectors of one label and one length are compared. Equal vectors are one node with a weight.

1. Shards. Pivots from k-means over a bounded sample (``SAMPLE`` vectors; at most ``MOST_PIVOTS`` in all, so
   their broadcast is bounded) cut each label into shards of about ``SHARD`` nodes. A node is a member of
   its ``overlap`` nearest shards and is searched in its ``probes`` nearest and in every shard whose pivot is
   nearly in range, so a group that spans many shards is searched in all of them.
2. Build. Each shard links each of its nodes to near and random candidates and prunes them robustly: a
   candidate goes if a kept one is closer to it, by ``ALPHA``, than the node is.
3. Union. A node's neighbour lists from all its shards become one.
4. Search. In each shard, a greedy beam from the shard's medoids walks towards the query; then everything
   within the radius plus a margin is expanded until nothing new comes. Neighbours that live in shards not
   yet probed are searched there in further rounds. A pair met in several shards counts in one.
   Cosines are in double precision.
   The rounds end when none is left to search; more than ``ROUNDS`` are an error.
5. Audit. Nodes fall into strata by the links that were found for them (none, 1-3, 4-15 and so on), and about
   ``AUDIT`` of each stratum are compared with all. The recall is the mean share of links found over the
   nodes that have links, so a large group counts no more than as many pairs: the least of that of each
   stratum with links and that of all, where a stratum counts by its size and a node that was found
   no link counts as missed. If it is below ``RECALL``, overlap and probes are doubled and the search is done
   again; if the last round still misses it, that is an error. It is null where no audited node has a link.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without
label, link with nothing; repeated rows are vectors of their own and link; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import components, stored
from vetline.llm.vectors import packed, stacked, usable

THRESHOLD = 0.93
SHARD = 256
SAMPLE = 20_000
MOST_PIVOTS = 4096
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BEAM = 16
MEDOIDS = 16
MARGIN = 0.1
ROUNDS = 64
AUDIT = 200
STRATA = 5
RECALL = 0.999


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, key, n, first, vec): distinct usable vectors; key is label and length."""
    rows = vectors.filter(usable() & F.col("label").isNotNull()).select(
        "vec_id", F.concat_ws("/", F.col("label").cast("string"), F.size("embedding")).alias("key"), "embedding")
    classes = rows.groupBy("key", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    return stored(packed(classes.withColumn("node", F.xxhash64("key", "embedding"))), "nodes")


def pivots_of(nodes: DataFrame, shard: int = SHARD) -> dict[str, tuple[int, np.ndarray]]:
    """Of each key the number of its first shard and its pivots."""
    sizes = {r["key"]: r["m"] for r in nodes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).collect()}
    total = sum(sizes.values())
    per = max(shard, total / MOST_PIVOTS)
    share = min(1.0, SAMPLE / max(1, total))
    sample: dict[str, list] = {}
    for r in nodes.filter(F.pmod(F.col("node"), F.lit(1 << 20)) < int(share * (1 << 20))).select("key", "node", "vec").collect():
        sample.setdefault(r["key"], []).append((r["node"], np.frombuffer(bytes(r["vec"]), np.float64)))
    out, at = {}, 0
    for key in sorted(sizes):
        mine = np.stack([v for _, v in sorted(sample[key], key=lambda x: x[0])]) if key in sample else None
        k = min(max(1, round(sizes[key] / per)), len(mine) if mine is not None else 1)
        if mine is None:
            out[key] = at, None
        else:
            centers = mine[:: max(1, len(mine) // k)][:k]
            for _ in range(6):
                near = (mine @ centers.T).argmax(1)
                sums = np.stack([mine[near == j].sum(0) if (near == j).any() else centers[j] for j in range(k)])
                centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
            out[key] = at, centers
        at += k
    return out


def placed(nodes: DataFrame, pivots: dict, overlap: int, probes: int, threshold: float) -> DataFrame:
    """Each node once per shard that it belongs to or is searched in."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for node, key, n, vec in zip(frame["node"], frame["key"], frame["n"], frame["vec"]):
                first, centers = pivots[key]
                if centers is None:
                    order, near = np.array([0]), 1
                else:
                    cos = centers @ np.frombuffer(vec, np.float64)
                    order = np.argsort(-cos, kind="stable")
                    near = max(probes, int((cos >= threshold - 2 * MARGIN).sum()))
                searched = (order[:near] + first).tolist()
                rows += [(s, node, n, vec, i < overlap, searched[:overlap], searched) for i, s in enumerate(searched)]
            yield pd.DataFrame(rows, columns=["shard", "node", "n", "vec", "member", "members", "searched"])

    return nodes.select("node", "key", "n", "vec").mapInPandas(
        run, "shard int, node long, n long, vec binary, member boolean, members array<int>, searched array<int>")


def pruned_graph(v: np.ndarray, seed: int, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each vector: robust pruning of its nearest and some random others, both ways."""
    m = len(v)
    if m == 1:
        return [np.zeros(0, np.int64)]
    rng = np.random.default_rng(seed)
    out = [set() for _ in range(m)]
    for lo in range(0, m, 512):
        own = np.arange(lo, min(lo + 512, m))
        cos = v[own] @ v.T
        cos[np.arange(len(own)), own] = -3
        k = min(candidates, m - 1)
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        near = np.concatenate([near, rng.integers(0, m, (len(own), 8))], axis=1)
        dist = 1 - np.take_along_axis(cos, near, 1)
        dist[near == own[:, None]] = np.inf
        for _ in range(degree):
            pick = dist.argmin(1)
            rows = np.flatnonzero(np.isfinite(dist[np.arange(len(own)), pick]))
            if not len(rows):
                break
            kept = near[rows, pick[rows]]
            for r, x in zip(rows.tolist(), kept.tolist()):
                out[lo + r].add(x)
            between = 1 - np.einsum("rd,rcd->rc", v[kept], v[near[rows]])
            left = dist[rows]
            left[(alpha * between <= left) | (near[rows] == kept[:, None])] = np.inf
            dist[rows] = left
    for a in range(m):
        for b in list(out[a]):
            if b > a or a not in out[b]:
                out[b].add(a)
    return [np.array(sorted(x), np.int64) for x in out]


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node")
    graph = pruned_graph(stacked(frame["vec"]), int(frame["shard"].iloc[0]))
    nodes, homes = frame["node"].to_numpy(), np.array([m[0] for m in frame["members"]])
    return pd.DataFrame({"node": nodes, "near": [nodes[g] for g in graph], "homes": [homes[g] for g in graph]})


def range_search(v: np.ndarray, near: list[np.ndarray], queries: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) within the threshold: a beam from medoids, then expansion of all that is nearly in range.

    ``own`` is each query's own place in ``v`` or -1.
    """
    m, q = len(v), len(queries)
    width = max(1, max((len(x) for x in near), default=1))
    table = np.full((m, width), -1, np.int64)
    for i, x in enumerate(near):
        table[i, :len(x)] = x
    cos = np.full((q, m), -2.0)
    step = max(1, m // MEDOIDS)
    center = v.mean(0)
    medoids = np.argsort(-(v @ center), kind="stable")[::step][:MEDOIDS]
    cos[:, medoids] = queries @ v[medoids].T
    known = np.flatnonzero(own >= 0)
    cos[known, own[known]] = 1.0
    done = np.zeros((q, m), bool)
    rows = np.arange(q)

    def visit(who: np.ndarray, where: np.ndarray) -> None:
        flat = np.repeat(who, width) * m + table[where].ravel()
        flat = np.unique(flat[table[where].ravel() >= 0])
        flat = flat[cos.ravel()[flat] == -2.0]
        for lo in range(0, len(flat), 100_000):
            part = flat[lo:lo + 100_000]
            cos.ravel()[part] = np.einsum("ij,ij->i", queries[part // m], v[part % m])

    for _ in range(BEAM):
        best = np.where(done, -2.0, cos).argmax(1)
        open_ = (cos[rows, best] > -2.0) & ~done[rows, best]
        if not open_.any():
            break
        done[rows[open_], best[open_]] = True
        visit(rows[open_], best[open_])
    while True:
        who, where = np.nonzero((cos >= threshold - MARGIN) & ~done)
        if not len(who):
            break
        done[who, where] = True
        for lo in range(0, len(who), 50_000):
            visit(who[lo:lo + 50_000], where[lo:lo + 50_000])
    return np.nonzero(cos >= threshold)


def _search(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Rows (node, links, other, to_shard): links counted here, a link to hold components together, or a
        shard where the node has to be searched as well."""
        shard = int(frame["shard"].iloc[0])
        frame = frame.sort_values("node")
        members = frame[frame["member"]]
        v, vn = stacked(members["vec"]), members["node"].to_numpy()
        place = {x: i for i, x in enumerate(vn.tolist())}
        near, away = [], []
        for adjacent, homes in zip(members["near"], members["homes"]):
            local = [place.get(x, -1) for x in adjacent]
            near.append(np.array([x for x in local if x >= 0], np.int64))
            away.append({h for x, h in zip(local, homes) if x < 0})
        asked = frame[frame["asked"]]
        qn = asked["node"].to_numpy()
        own = np.array([place.get(x, -1) for x in qn.tolist()], np.int64)
        who, where = range_search(v, near, stacked(asked["vec"]), own, threshold)
        other = qn[who] != vn[where]
        who, where = who[other], where[other]
        # a pair that several shards could meet counts in the first that is both searched and home
        searched = [set(x) for x in asked["searched"]]
        before = [set(x) for x in asked["before"]]
        homes_of = [sorted(x) for x in members["members"]]
        counted = np.array([next((h for h in homes_of[b] if h in searched[a] and not _seen(homes_of[b], before[a])), -1) == shard
                            for a, b in zip(who.tolist(), where.tolist())], bool)
        weight = members["n"].to_numpy()
        links = np.bincount(who[counted], weights=weight[where[counted]], minlength=len(qn)).astype(np.int64)
        # a spanning forest of the links met here
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        forest = []
        for a, b in zip(qn[who].tolist(), vn[where].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                forest.append((a, b))
        further = {(int(qn[a]), int(h)) for a, b in zip(who.tolist(), where.tolist()) for h in away[b]
                   if h not in searched[a] and h not in before[a]}
        rows = ([(x, n, None, None) for x, n in zip(qn.tolist(), links.tolist()) if n]
                + [(a, None, b, None) for a, b in forest] + [(a, None, None, h) for a, h in sorted(further)])
        return pd.DataFrame({"node": pd.array([r[0] for r in rows], "Int64"), "links": pd.array([r[1] for r in rows], "Int64"),
                             "other": pd.array([r[2] for r in rows], "Int64"), "to_shard": pd.array([r[3] for r in rows], "Int32")})

    return run


def _seen(homes: list[int], before: set[int]) -> bool:
    return any(h in before for h in homes)


def searched_links(nodes: DataFrame, pivots: dict, overlap: int, probes: int, threshold: float, rounds: int = ROUNDS) -> DataFrame:
    """Rows (node, links, other) of all search rounds; more than ``rounds`` are an error, never a part of the links."""
    rows = stored(placed(nodes, pivots, overlap, probes, threshold), "placed")
    members = rows.filter("member")
    lists = members.groupBy("shard").applyInPandas(_build, "node long, near array<long>, homes array<int>")
    lists = stored(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("near", "homes")))).alias("l"))
                   .select("node", "l.near", "l.homes"), "adjacency")
    with_lists = stored(members.join(lists, "node").select("shard", "node", "n", "vec", "members", "near", "homes"), "graph")
    none = F.array().cast("array<int>")
    asked = rows.withColumn("before", none)
    found = None
    for _ in range(rounds):
        both = with_lists.withColumns({"member": F.lit(True), "asked": F.lit(False), "searched": none, "before": none}).unionByName(
            asked.filter("not member").withColumns({"asked": F.lit(True), "near": F.array().cast("array<long>"), "homes": none}))
        # a member that is asked too is one row
        own = asked.filter("member").select("shard", "node", F.col("searched").alias("s"), F.col("before").alias("b"))
        both = both.join(own, ["shard", "node"], "left").withColumns({
            "asked": F.col("asked") | F.col("s").isNotNull(), "searched": F.coalesce("s", "searched"), "before": F.coalesce("b", "before")}).drop("s", "b")
        busy = asked.select("shard").distinct()
        out = stored(both.join(busy, "shard", "left_semi").groupBy("shard").applyInPandas(
            _search(threshold), "node long, links long, other long, to_shard int"), "searched")
        found = out if found is None else found.unionByName(out)
        further = out.filter("to_shard is not null").select("node", "to_shard").distinct().groupBy("node").agg(
            F.sort_array(F.collect_set("to_shard")).alias("searched"))
        history = asked.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list(F.concat("searched", "before")))).alias("before"))
        further = stored(further.join(history, "node"), "further")
        if further.isEmpty():
            return found.select("node", "links", "other")
        where = further.join(nodes.select("node", "n", "vec"), "node").withColumn("shard", F.explode("searched"))
        asked = stored(where.select("shard", "node", "n", "vec", F.lit(False).alias("member"), none.alias("members"), "searched", "before"), "asked")
    raise RuntimeError(f"nodes are still to be searched in further shards after {rounds} rounds")


def true_links(nodes: DataFrame, threshold: float, few: list) -> dict[int, int]:
    """Links of the nodes ``few`` (node, key, vec), by comparison with all; pairs at the threshold to within rounding are left out."""
    by_key: dict[str, tuple[list, list]] = {}
    for r in few:
        by_key.setdefault(r["key"], ([], []))[0].append(r["node"])
        by_key[r["key"]][1].append(np.frombuffer(bytes(r["vec"]), np.float64))
    by_key = {k: (np.array(a), np.stack(b)) for k, (a, b) in by_key.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, part in frame.groupby("key"):
                if key in by_key:
                    ids, q = by_key[key]
                    close = (q @ stacked(part["vec"]).T >= threshold + 1e-12) & (ids[:, None] != part["node"].to_numpy()[None, :])
                    yield pd.DataFrame({"node": ids, "links": close @ part["n"].to_numpy()})

    sums = nodes.select("key", "node", "n", "vec").mapInPandas(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    return {r["node"]: r["links"] for r in sums.collect()}


def audited_recall(nodes: DataFrame, links: DataFrame, threshold: float, audit: int = AUDIT) -> float | None:
    """The recall of ``links`` (node, links) as the module's text has it."""
    got = F.coalesce("links", F.lit(0))
    stratum = F.when(got > 0, F.least(F.lit(STRATA - 1), 1 + F.floor(F.log(4.0, got)))).otherwise(0).cast("int")
    judged = stored(nodes.select("node", "key", "vec").join(links, "node", "left").select(
        "node", "key", "vec", got.alias("got"), stratum.alias("stratum")), "audit")
    sizes = {r["stratum"]: r["m"] for r in judged.groupBy("stratum").agg(F.count(F.lit(1)).alias("m")).collect()}
    drawn = F.lit(False)
    for k, m in sizes.items():
        drawn = drawn | ((F.col("stratum") == k) & (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(min(1.0, audit / m) * (1 << 20))))
    few = judged.filter(drawn).collect()
    truth = true_links(nodes, threshold, few)
    means, found, linked = [], 0.0, 0.0
    for k, m in sizes.items():
        mine = [r for r in few if r["stratum"] == k]
        shares = [min(1.0, r["got"] / truth[r["node"]]) for r in mine if truth.get(r["node"])]
        if shares:
            found += m / len(mine) * sum(shares)
            linked += m / len(mine) * len(shares)
            if k:
                means.append(sum(shares) / len(shares))
    return min([*means, found / linked]) if linked else None


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, overlap: int = 2, probes: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    nodes = nodes_of(rows)
    pivots = pivots_of(nodes, shard)
    for _ in range(4):
        found = stored(searched_links(nodes, pivots, overlap, probes, threshold), "links")
        links = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
        recall = audited_recall(nodes, links, threshold)
        if recall is None or recall >= RECALL:
            break
        overlap, probes = 2 * overlap, 2 * probes
    else:
        raise RuntimeError(f"the audit found only {recall:.4f} of the links")
    edges = found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    groups = components(nodes.select(F.col("node").alias("id")), edges)
    named = nodes.select("node", "n", "first").join(groups, F.col("node") == F.col("id")).join(links, "node", "left")
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(firsts, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    key = F.when(usable() & F.col("label").isNotNull(), F.xxhash64(
        F.concat_ws("/", F.col("label").cast("string"), F.size("embedding")), "embedding"))
    out = rows.select("vec_id", key.alias("_node")).join(named, F.col("_node") == F.col("node"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"), F.lit(recall).cast("double").alias("recall"))


#: The rows of near_duplicates() without the recall, in DuckDB's SQL.
ORACLE = f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(id, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from reach r join links l on l.a = r.id),
comp as (select id, min(c) as component_id from reach group by id),
n as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join comp c on c.id = e.vec_id left join n on n.a = e.vec_id
"""
