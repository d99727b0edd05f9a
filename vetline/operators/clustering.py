"""Grouping documents of one person: same number, same full name, or same surname where given names
do not contradict. Clusters are the connected components of these links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.functions.text import full_name
from vetline.operators.ordered import global_sequence
from vetline.session import stored


def _star(df: DataFrame, key: str, group: str, hub_when=None) -> DataFrame:
    """Link every member of a group to one hub: as many links as members, connected alike."""
    rows = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("_g"), key,
                                                      (F.lit(True) if hub_when is None else hub_when).alias("_h"))
    hubs = rows.groupBy("_g").agg(F.min(F.when(F.col("_h"), F.col(key))).alias("hub")).filter("hub is not null")
    return rows.join(hubs, "_g").filter(F.col("hub") != F.col(key)).select(F.col("hub").alias("a"), F.col(key).alias("b"))


def person_links(docs: DataFrame, key: str) -> DataFrame:
    """Links (a, b) over document_number, surname and given_names."""
    d = docs.select(key, "document_number", F.nullif("surname", F.lit("")).alias("surname"),
                    F.nullif("given_names", F.lit("")).alias("given_names"))
    d = d.withColumn("full_name", full_name(F.col("given_names"), F.col("surname")))
    lacks = F.col("given_names").isNull()
    return (_star(d, key, "document_number").unionByName(_star(d, key, "full_name"))
            .unionByName(_star(d, key, "surname", lacks)).distinct())


def contracted(links: DataFrame, number: int = 0) -> tuple[DataFrame, DataFrame]:
    """Round ``number`` over links (a, b): (id, parent) of every node, and the links left between parents.

    A node joins the one of lowest rank among its neighbours and itself, and that one's parent, twice over. Ranks are a hash that
    changes by round, so ways down are short even where ids follow a chain, and a constant share of the nodes leaves.
    """
    def rank(node: str):
        return F.struct(F.xxhash64(node, F.lit(number)).alias("rank"), F.col(node).alias("node"))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooked = ends.groupBy(F.col("a").alias("id")).agg(F.min(rank("b")).alias("_low")).select("id", F.least(rank("id"), "_low")["node"].alias("parent"))
    hooked = stored(hooked, "hooked")
    for _ in range(2):
        above = hooked.select(F.col("id").alias("_id"), F.col("parent").alias("_above"))
        hooked = hooked.join(above, F.col("parent") == F.col("_id")).select("id", F.col("_above").alias("parent"))
    hooked = stored(hooked, "parents")
    for end in ("a", "b"):
        links = links.join(hooked.withColumnRenamed("parent", f"_{end}"), links[end] == F.col("id")).drop("id")
    left = links.filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    return hooked, stored(left, "links")


def components(nodes: DataFrame, links: DataFrame, key: str, max_rounds: int = 64) -> DataFrame:
    """(key, component): the smallest id reachable over the links.

    Trees of linked nodes become one node, and only links between different trees go on, so a round
    handles far fewer rows than the round before: nodes without open links have left. The parents of all rounds,
    each a table in the shared folder, are followed back at the end. More than ``max_rounds`` rounds is an
    error, never a partial result.
    """
    rest = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while not rest.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"links are left after {max_rounds} rounds")
        parents, rest = contracted(rest, len(rounds))
        rounds.append(parents)
    ids = nodes.select(F.col(key).alias("id"))
    if not rounds:
        return ids.select(F.col("id").alias(key), F.col("id").alias("component"))
    roots = rounds.pop()
    while rounds:
        further = roots.select(F.col("id").alias("_id"), F.col("parent").alias("_root"))
        roots = rounds.pop().join(further, F.col("parent") == F.col("_id"), "left").select("id", F.coalesce("_root", "parent").alias("parent"))
    roots = stored(roots, "roots")
    smallest = roots.groupBy("parent").agg(F.min("id").alias("_least"))
    found = roots.join(smallest, "parent").select(F.col("id").alias("_id"), "_least")
    return ids.join(found, F.col("id") == F.col("_id"), "left").select(F.col("id").alias(key), F.coalesce("_least", "id").alias("component"))


def cluster_ids(clusters: DataFrame, component: str = "component") -> DataFrame:
    """Add person_id PERSON-001, PERSON-002, ... in order of each cluster's smallest document."""
    numbered = global_sequence(clusters.select(component).distinct(), [component], "_n")
    return clusters.join(numbered, component).withColumn(
        "person_id", F.concat(F.lit("PERSON-"), F.when(F.col("_n") < 1000, F.lpad(
            F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string")))).drop("_n")
