"""Line deduplication by a segment-partition edit join, with DataFrame functions only.

Lines are the parts of a text between line feeds. Two lines are duplicates when they are equal or, with
at least ``MIN_CHARS`` characters each, at most ``MAX_EDITS`` = 1 insertion, deletion or substitution
apart; duplicates of duplicates belong together. Of each class the first line stays, by document,
then by place. Lines of blanks alone take no part and stay.

1. Equal lines meet on their 64-bit hash: a partial minimum keeps the first place of each.
2. Segment partition: a line of n characters is cut into MAX_EDITS + 1 = 2 segments. If two lines are one
   edit apart, one segment of the shorter (or, at equal length, of either) stands unchanged in the
   other, and only at the place that the difference of lengths allows: so a line offers its two
   segments for its own length and probes with two substrings for length n - 1. Keys hold length,
   segment and hash; keys of one line only are dropped by a partial aggregate before anything joins.
3. Keys of up to ``HOT`` lines give candidate pairs, verified by the banded bit-parallel edit distance
   below. A key of more lines gives no pairs: its lines are keyed anew by all but one of ``PIECES`` pieces
   (prefix and suffix), for their own length and as the shorter line for length n + 1. What is crowded
   even then is keyed by that and the piece less one character: with the character's place, lines of one
   length share such a key exactly when one substitution parts them, so each key's lines are linked to
   its smallest one; without it, lines are linked to the shorter line that their deletion gives, if there
   is one. Nothing is lost, and no pairs within a group are made.
4. Links join to components.

Lines are told apart by a 64-bit hash; two different lines with the same hash would count as equal.

Cases: a null text has no lines and stays null, an empty text has one empty line, which stays; a line of
any length is compared whole; repeated rows are documents of their own, but of fully equal rows (id
and text) each is treated alike: what is a duplicate in one is in all. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import components, stored

MIN_CHARS = 20
MAX_EDITS = 1
HOT = 16
PIECES = 16


def band_distance(short: str, long: str, k: int = MAX_EDITS) -> str:
    """SQL for the edit distance of two arrays of characters, right wherever it is at most ``k``.

    Bit-parallel along a band of 2k + 1 diagonals (``short`` has at most k characters less): one word holds
    which characters of ``short`` inside the band equal the next one of ``long``, two words the
    vertical differences in the band. The score follows the lowest diagonal to the last row and then
    that row.
    """
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (2 * k)
    n = f"size({short})"
    equal = " + ".join(f"if(i >= {k - d} and get({short}, i - {k - d}) = get({long}, i), {1 << d}, 0)" for d in range(width))
    left = f"({2 * k - 1} - (i - ({n} - {k})))"
    score = (f"c.score + case when i < {n} - {k} then if(d0 & {top} = 0, 1, 0) when {left} >= 0 then "
             f"(shiftright(hp, {left}) & 1) - (shiftright(d0 & c.vp, {left}) & 1) else 0 end")
    bind = "transform(array({value}), {name} -> {body})[0]".format
    state = (f"named_struct('vp', ((d0 & c.vp) | ~(shiftright(d0, 1) | hp)) & {full}, 'vn', shiftright(d0, 1) & hp, 'score', {score})")
    step = bind(value=f"coalesce({equal}, 0)", name="eq", body=bind(
        value=f"((((eq & c.vp) + c.vp) ^ c.vp) | eq | c.vn) & {full}", name="d0", body=bind(
            value=f"(c.vn | ~(d0 | c.vp)) & {full}", name="hp", body=state)))
    return (f"if(size({long}) = 0, 0, aggregate(sequence(0, greatest(size({long}) - 1, 0)), "
            f"named_struct('vp', {full & ~((1 << k) - 1)}, 'vn', 0, 'score', {k}), (c, i) -> {step}, c -> c.score))")


#: One halving of (s, t): one of the two segments of the shorter text must stand at the same end of the
#: longer one, else they are more than one edit apart and become null.
_HALVE = """transform(array(cast(length(c.s) div 2 as int)), h -> case
    when left(c.s, h) = left(c.t, h) then named_struct('s', substring(c.s, h + 1), 't', substring(c.t, h + 1))
    when right(c.s, length(c.s) - h) = right(c.t, length(c.s) - h)
        then named_struct('s', left(c.s, h), 't', left(c.t, length(c.t) - length(c.s) + h))
    else named_struct('s', cast(null as string), 't', cast(null as string)) end)[0]"""


def verified(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, s, t) with texts, those within MAX_EDITS."""
    longer = F.length("s") > F.length("t")
    ordered = pairs.select("a", "b", F.when(longer, F.col("t")).otherwise(F.col("s")).alias("s"),
                           F.when(longer, F.col("s")).otherwise(F.col("t")).alias("t")).filter(f"length(t) - length(s) <= {MAX_EDITS}")
    halved = ordered.withColumn("core", F.expr(
        f"aggregate(sequence(1, 5), named_struct('s', s, 't', t), (c, r) -> {_HALVE})"))
    # the generator keeps the halving from being evaluated once per use
    cores = halved.select("a", "b", F.explode(F.array("core")).alias("core")).filter("core.s is not null").select(
        "a", "b", "core.s", "core.t").select("a", "b", F.expr("filter(split(s, ''), x -> x <> '')").alias("s"),
                                      F.expr("filter(split(t, ''), x -> x <> '')").alias("t"))
    # cores below the band's width are judged as they are
    near = f"case when size(s) < {MAX_EDITS} then size(t) <= {MAX_EDITS} else {band_distance('s', 't')} <= {MAX_EDITS} end"
    return cores.filter(F.expr(near)).select("a", "b")


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, row_id, line_no, line, h); row_id is a hash of id and text, h one of the line."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_id"),
                        F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("h", F.xxhash64("line"))


def segment_keys(lines: DataFrame) -> DataFrame:
    """(key, h): the two segments of each line, and its two probes for lines one shorter."""
    n = F.length("line")
    keys = []
    for short in (0, 1):
        size = n - short
        h = F.floor(size / 2).cast("int")
        keys += [F.xxhash64(size, F.lit(1), F.substring("line", F.lit(1), h)),
                 F.xxhash64(size, F.lit(2), F.substring("line", h + 1 + short, size - h))]
    return lines.filter(n >= MIN_CHARS).select("h", F.explode(F.array(*keys)).alias("key"))


def piece_keys(lines: DataFrame) -> DataFrame:
    """(key, h, i, longer): all of a line but one of its pieces, for its own length (longer = 0) and as the
    shorter line for one character more (longer = 1)."""
    cut = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))).withColumn(
        "longer", F.explode(F.array(F.lit(0), F.lit(1))))
    size, start, stop = _piece_bounds()
    return cut.select(F.xxhash64(size, "i", F.substring("line", F.lit(1), start),
                                 F.substring("line", stop + 1 - F.col("longer"), size - stop)).alias("key"), "h", "i", "longer")


def _piece_bounds():
    size = F.length("line") + F.col("longer")
    return size, F.floor(F.col("i") * size / PIECES).cast("int"), F.floor((F.col("i") + 1) * size / PIECES).cast("int")


def character_keys(lines: DataFrame) -> DataFrame:
    """(key, h, hub) of rows (key, h, i, longer, line), two families apart: the piece key with the piece less one
    character and that character's place, for lines of one length (substitutions, hub = 0); and the piece
    key with the piece less one character, or whole where the line is the shorter one (deletions, hub = 1
    for that line). Equal keys of the first family mean one edit, as do those of the second between its hub and any other."""
    size, start, stop = _piece_bounds()
    pieces = lines.select("key", "h", "longer", F.substring("line", start + 1, stop - start - F.col("longer")).alias("piece"))
    less = pieces.filter("longer = 0").withColumn("at", F.explode(F.sequence(F.lit(1), F.length("piece")))).select(
        "key", "h", "at", F.expr("concat(substring(piece, 1, at - 1), substring(piece, at + 1, length(piece)))").alias("piece"))
    # place 0 stands for deletions
    less = less.withColumn("at", F.explode(F.array(F.lit(0), F.col("at")))).withColumn("hub", F.lit(0))
    whole = pieces.filter("longer = 1").select("key", "h", F.lit(0).alias("at"), "piece", F.lit(1).alias("hub"))
    keyed = less.unionByName(whole)
    return keyed.select(F.xxhash64("key", "at", "piece").alias("key"), "h", "hub", (F.col("at") == 0).alias("deleted")).distinct()


def _stars(near: DataFrame) -> DataFrame:
    """(a, b): lines of one substitution key to its smallest, lines of one deletion key to its shorter line."""
    hubs = near.groupBy("key").agg(F.min(F.when(~F.col("deleted") | (F.col("hub") == 1), F.col("h"))).alias("a"),
                                   F.min("h").alias("low"), F.max("h").alias("high"))
    hubs = hubs.filter("a is not null and low <> high").select("key", "a")
    return near.join(hubs, "key").select("a", F.col("h").alias("b")).filter("a <> b").distinct()


def _shared(keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``keys`` whose key more than one line has, with ``n``, how many those are."""
    keys = stored(keys, name)
    shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("key")
    members = stored(keys.join(shared, "key", "left_semi").distinct(), name + "-shared")
    return stored(members.join(members.groupBy("key").agg(F.count_distinct("h").alias("n")), "key"), name + "-sized")


def _pairs(sized: DataFrame) -> DataFrame:
    """(a, b): pairs of lines that share a key of at most HOT lines."""
    few = sized.filter(F.col("n") <= HOT).groupBy("key").agg(F.sort_array(F.collect_set("h")).alias("hs"))     # at most HOT
    return few.select(F.explode(F.expr(
        f"flatten(transform(hs, (x, i) -> transform(slice(hs, i + 2, {HOT}), y -> named_struct('a', x, 'b', y))))")).alias("p")).select("p.*")


def line_links(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b): hashes of different lines at most one edit apart, as pairs or stars of such groups."""
    segments = _shared(segment_keys(line_table(docs).select("h", "line")), "segment-keys")
    places = firsts.join(segments.select("h").distinct(), "h").select("h", "first.row_id", "first.line_no")
    texts = stored(docs.select(F.xxhash64("doc_id", "text").alias("row_id"), "text").join(places, "row_id").select(
        "h", F.get(F.split("text", "\n"), F.col("line_no")).alias("line")).dropDuplicates(["h"]), "candidate-lines")
    crowded = segments.filter(F.col("n") > HOT).select("h").distinct()
    pieces = _shared(piece_keys(texts.join(crowded, "h", "left_semi")), "piece-keys")
    pairs = stored(_pairs(segments).unionByName(_pairs(pieces)).distinct(), "pairs")
    with_texts = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("s")), "a").join(
        texts.select(F.col("h").alias("b"), F.col("line").alias("t")), "b")
    near = stored(character_keys(pieces.filter(F.col("n") > HOT).join(texts, "h")), "character-keys")
    return verified(with_texts).unionByName(_stars(near))


def line_classes(docs: DataFrame) -> DataFrame:
    """(h, first): for each line that has a duplicate, the first place (doc_id, row_id, line_no) of its class."""
    lines = line_table(docs).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    firsts = stored(lines.groupBy("h").agg(F.min(F.struct("doc_id", "row_id", "line_no")).alias("first"),
                                           F.count(F.lit(1)).alias("n")), "first-places")
    links = stored(line_links(docs, firsts), "line-links")
    linked = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    groups = components(linked, links)
    named = firsts.join(groups, firsts["h"] == groups["id"], "left").filter("n > 1 or component is not null").select(
        "h", "first", F.coalesce("component", "h").alias("component"))
    named = stored(named, "line-classes")
    best = named.groupBy("component").agg(F.min("first").alias("first"))
    return named.select("h", "component").join(best, "component").select("h", "first")


def judged_lines(docs: DataFrame) -> DataFrame:
    """Every line: (doc_id, row_id, line_no, class_doc, class_line, kept)."""
    classes = line_classes(docs)
    rows = line_table(docs).drop("line").withColumnRenamed("h", "_h").join(classes, F.col("_h") == F.col("h"), "left")
    here = F.struct("doc_id", "row_id", "line_no")
    return rows.select("doc_id", "row_id", "line_no", F.coalesce("first.doc_id", "doc_id").alias("class_doc"),
                       F.coalesce("first.line_no", "line_no").alias("class_line"),
                       (F.col("first").isNull() | F.col("first").eqNullSafe(here)).alias("kept"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; every document stays."""
    gone = judged_lines(docs).filter("not kept").groupBy(F.col("row_id").alias("_line_row")).agg(F.collect_set("line_no").alias("_line_gone"))
    rows = docs.withColumn("_line_key", F.xxhash64("doc_id", "text")).join(gone, F.col("_line_key") == F.col("_line_row"), "left")
    text = F.when(F.col("_line_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(
        F.split("text", "\n"), lambda x, i: ~F.array_contains("_line_gone", i)), "\n"))
    rows = rows.withColumn("text", text)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows
    return rows.select(*docs.columns)
