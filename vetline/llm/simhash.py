"""SimHash near-duplicates by tiled exact comparison.

1. Fingerprints (mapInArrow): one long per document. Equal fingerprints become one class, by a partial
   minimum, so copies cost nothing further.
2. Classes fall into cells by the population counts of their four 16-bit quarters, cells into tiles of
   about ``TILE`` fingerprints. Two fingerprints at d differing bits have quarter counts that differ by
   at most d in all; tile pairs beyond the radius are never made. The cell table has at most 17^4 rows.
3. A remaining pair of tiles is compared whole by exclusive-or and bit counts in numpy. Nothing is
   missed. The work grows with the square of the distinct fingerprints, with a constant of about
   one in a hundred for random ones; the tiles spread evenly whatever the cells' sizes.
4. Links join classes to components.

Cases: null, empty and blank texts have fingerprint zero and link like any other; texts of one or two
words are one shingle; repeated rows stay repeated; an empty table gives no rows; other columns are
ignored.

``keep_one`` is the pipeline's stage. It wants a similarity of 0.8 between bags of five-word shingles, which 64
bits cannot tell from chance among many documents: 10 bits are expected to differ at 0.8, and of random pairs
one in a hundred million differs so little. So it takes fingerprints of 256 bits: at 0.8 expected 39 bits
differ (standard error 6), at random 128. Documents link at ``ALIKE_BITS`` or fewer, if also the numbers of their
shingles are as near as that similarity demands. Tiles are cut by number of shingles and by population count;
tile pairs beyond either bound are never made, the rest is compared whole. A tile pair answers with a
spanning forest of its links, so a group of copies costs rows by its members, not by its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import batches as text_batches
from vetline.llm.common import components, stored, texts_of

RADIUS = 2
SHINGLE = 3
SEED = 42
TILE = 4096
#: Characters fingerprinted at once.
CHUNK = 1_000_000
#: The stage's shingles, 64-bit words of a fingerprint, most differing bits, and the least ratio of shingle numbers.
ALIKE_SHINGLE = 5
ALIKE_WORDS = 4
ALIKE_BITS = 44
ALIKE_RATIO = (4, 5)
#: Shingles counted at once.
SLICE = 100_000


def _shingle_hashes(text: bytes, words: int, digest=None) -> list:
    import xxhash

    digest = digest or xxhash.xxh64_intdigest
    parts = text.lower().split()          # bytes: lower-cases A-Z, cuts at ASCII blanks
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(line[a:b], SEED) for a, b in zip(starts[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist())]


def fingerprints_of(texts: list[bytes], words: int = SHINGLE) -> np.ndarray:
    """Bit by bit the majority of the shingles' hashes; zero without shingles."""
    out = np.zeros(len(texts), np.uint64)
    hashes = [_shingle_hashes(t, words) for t in texts]
    full = [i for i, h in enumerate(hashes) if h]
    if not full:
        return out
    sizes = np.array([len(hashes[i]) for i in full])
    flat = np.fromiter((h for i in full for h in hashes[i]), np.uint64, int(sizes.sum()))
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.uint32)
    out[full] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) of every document; text_hash tells rows of one doc_id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprints_of([(t or "").encode("utf-8", "surrogatepass") for _, t in part], words)
                   for part in text_batches(texts_of(batch), CHUNK)]
            fp = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, fp long")


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Half of the count differences within the radius: each unordered pair of cells once."""
    each = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [d for d in each if d >= (0, 0, 0, 0)]


def close_pairs(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): pairs of different fingerprints ``fp`` within the radius."""
    quarter = [F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFF << s if s < 48 else -(1 << 48)).cast("long"))) for s in (0, 16, 32, 48)]
    celled = classes.select("fp", *[q.alias(f"q{i}") for i, q in enumerate(quarter)])
    cell = ["q0", "q1", "q2", "q3"]
    tiles = (celled.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")))
    packed = (celled.join(tiles, cell).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
              .groupBy(*cell, "tile").agg(F.collect_list("fp").alias("fps")))
    packed = stored(packed, "tiles")      # at most some multiple of ``tile`` fingerprints a row
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in _neighbours(radius)])
    left = packed.select(*cell, F.col("tile").alias("a_tile"), F.col("fps").alias("a"), F.explode(steps).alias("d"))
    left = left.select(F.col("a_tile"), "a", *[(F.col(f"q{i}") + F.col(f"d.d{i}")).alias(f"q{i}") for i in range(4)],
                       F.expr("d.d0 = 0 and d.d1 = 0 and d.d2 = 0 and d.d3 = 0").alias("same"))
    left = left.join(tiles, cell).withColumn("tile", F.explode(F.sequence(
        F.when(F.col("same"), F.col("a_tile")).otherwise(0), F.col("tiles") - 1)))
    pairs = left.join(packed.withColumnRenamed("fps", "b"), [*cell, "tile"]).select(
        "a", "b", (F.col("same") & (F.col("a_tile") == F.col("tile"))).alias("own"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for i in range(batch.num_rows):
                a, b = (batch.column(k)[i].values.to_numpy().view(np.uint64) for k in (0, 1))     # of signed numbers numpy counts the absolute value's bits
                own = batch.column(2)[i].as_py()
                step = max(1, 1_000_000 // len(b))
                for s in range(0, len(a), step):
                    near = np.bitwise_count(a[s:s + step, None] ^ b[None, :]) <= radius
                    at, to = np.nonzero(near)
                    if len(at):
                        links = np.stack([a[s + at], b[to]]).view(np.int64)
                        found.append(links[:, links[0] < links[1]] if own else links)
            both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id): the linked group's smallest fingerprint, which tells groups
    apart, and its smallest doc_id, null where none of the group has one."""
    marked = stored(fingerprints(docs, words), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    groups = components(classes.select(F.col("fp").alias("id")), close_pairs(classes.select("fp"), radius))
    named = classes.join(groups, classes["fp"] == groups["id"]).select("fp", "component", "first")
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = named.join(firsts, "component").select("fp", "component", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Another 64 bits from each 64 bits, by shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ones(hashes: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Per owner and bit, in how many of its rows of ``hashes`` (n x words) the bit is set. Runs of at most 255 rows
    are added as bytes, eight at a time, and the runs as longs; rows of one owner stand together."""
    total = np.zeros((owners, hashes.shape[1] * 64), np.int64)
    for s in range(0, len(hashes), SLICE):
        part, own = hashes[s:s + SLICE], owner[s:s + SLICE]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        inside = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        starts = np.flatnonzero(inside % 255 == 0)
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        runs = np.add.reduceat(bits, starts, axis=0).view(np.uint8)
        again = np.flatnonzero(np.r_[True, own[starts][1:] != own[starts][:-1]])
        total[own[starts][again]] += np.add.reduceat(runs, again, axis=0, dtype=np.int64)
    return total


def wide_fingerprints_of(texts: list[bytes], words: int = ALIKE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles of each text, and its fingerprint as a row of ALIKE_WORDS longs."""
    import xxhash

    hashes = [_shingle_hashes(t, words, xxhash.xxh3_128_digest) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    half = np.frombuffer(b"".join(d for h in hashes for d in h), np.uint64).reshape(-1, 2)
    full = np.concatenate([half, _mixed(half)], axis=1)
    ones = _ones(full, np.repeat(np.arange(len(texts)), sizes), len(texts))
    return sizes, np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.int64)


_FP = [f"w{i}" for i in range(ALIKE_WORDS)]


def wide_fingerprints(docs: DataFrame, words: int = ALIKE_SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n, w0 to w3) of every document; n is its number of shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [wide_fingerprints_of([(t or "").encode("utf-8", "surrogatepass") for _, t in part], words)
                     for part in text_batches(texts_of(batch), CHUNK)]
            n = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
            fp = np.concatenate([np.zeros((0, ALIKE_WORDS), np.int64), *[p[1] for p in parts]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), *[pa.array(w) for w in fp.T.copy()]],
                                             ["doc_id", "text_hash", "n", *_FP])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n long, " + ", ".join(f"{w} long" for w in _FP))


def _forest(at: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """Links (2 x m) that join the same of ``size`` members as the pairs (at, to), at most one per member."""
    label = np.arange(size)
    while True:
        low = label.copy()
        np.minimum.at(low, at, label[to])
        np.minimum.at(low, to, label[at])
        np.minimum.at(low, label, low.copy())     # what a member sees also moves the root of its tree
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(size))
    return np.stack([label[moved], moved])


def alike_links(classes: DataFrame, bits: int = ALIKE_BITS, ratio: tuple[int, int] = ALIKE_RATIO, tile: int = TILE) -> DataFrame:
    """(a, b): links between rows (h, n, w0 to w3) that join whatever pairs are within ``bits`` and ``ratio``."""
    less, more = ratio
    ones = sum((F.bit_count(w) for w in _FP[1:]), F.bit_count(_FP[0]))
    # pairs within the bounds fall into the same or adjacent classes of both; the margin covers rounding
    celled = classes.filter("n > 0").withColumn("s", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(more / less * 1.001))).cast("int")).withColumn(
        "p", F.floor(ones / (bits + 1)).cast("int"))
    tiles = celled.groupBy("s", "p").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    packed = stored(celled.join(tiles, ["s", "p"]).withColumn("tile", F.pmod("h", F.col("tiles")).cast("int"))
                    .groupBy("s", "p", "tile").agg(F.collect_list(F.struct("h", "n", *_FP)).alias("members")), "wide-tiles")
    steps = F.array(*[F.struct(F.lit(x).alias("s"), F.lit(y).alias("p")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = packed.select(F.col("s").alias("a_s"), F.col("p").alias("a_p"), F.col("tile").alias("a_tile"), F.explode(steps).alias("d")).select(
        "a_s", "a_p", "a_tile", (F.col("a_s") + F.col("d.s")).alias("s"), (F.col("a_p") + F.col("d.p")).alias("p"),
        ((F.col("d.s") == 0) & (F.col("d.p") == 0)).alias("same"))
    meet = left.join(tiles, ["s", "p"]).withColumn("tile", F.explode(F.sequence(
        F.when(F.col("same"), F.col("a_tile")).otherwise(0), F.col("tiles") - 1)))
    own = packed.select(F.col("s").alias("a_s"), F.col("p").alias("a_p"), F.col("tile").alias("a_tile"), F.col("members").alias("a"))
    pairs = meet.join(packed.withColumnRenamed("members", "b"), ["s", "p", "tile"]).join(own, ["a_s", "a_p", "a_tile"]).select("a", "b")

    def columns(value) -> list[np.ndarray]:
        members = value.values
        fields = [members.field(k).to_numpy() for k in range(2 + ALIKE_WORDS)]
        return fields[:2] + [w.view(np.uint64) for w in fields[2:]]     # of signed numbers numpy counts the absolute value's bits

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ha, na, *fa), (hb, nb, *fb) = columns(batch.column(0)[i]), columns(batch.column(1)[i])
                step, ats, tos = max(1, 1_000_000 // len(hb)), [], []
                for s in range(0, len(ha), step):
                    e = s + step
                    part = np.bitwise_count(fa[0][s:e, None] ^ fb[0]) + np.bitwise_count(fa[1][s:e, None] ^ fb[1])
                    at, to = np.nonzero(part <= bits)          # half of the words rules nearly all pairs out
                    at += s
                    whole = part[at - s, to] + sum(np.bitwise_count(x[at] ^ y[to]).astype(np.int64) for x, y in zip(fa[2:], fb[2:]))
                    low, high = np.minimum(na[at], nb[to]), np.maximum(na[at], nb[to])
                    near = (whole <= bits) & (more * low >= less * high) & (ha[at] != hb[to])
                    ats.append(at[near])
                    tos.append(to[near])
                ids, place = np.unique(np.r_[ha, hb], return_inverse=True)
                links = _forest(place[:len(ha)][np.concatenate(ats)], place[len(ha):][np.concatenate(tos)], len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[links[0]]), pa.array(ids[links[1]])], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def alike(docs: DataFrame, words: int = ALIKE_SHINGLE, bits: int = ALIKE_BITS, ratio: tuple[int, int] = ALIKE_RATIO, tile: int = TILE) -> DataFrame:
    """(doc_id, text_hash, component): groups of documents alike by their wide fingerprints. Fingerprint and number of
    shingles are told apart by a 64-bit hash; documents without words are alike with each other only."""
    marked = stored(wide_fingerprints(docs, words).withColumn("h", F.xxhash64("n", *_FP)), "wide-fingerprints")
    classes = stored(marked.groupBy("h").agg(*[F.min(c).alias(c) for c in ("n", *_FP)]), "wide-classes")
    groups = components(classes.select(F.col("h").alias("id")), stored(alike_links(classes, bits, ratio, tile), "wide-links"))
    return marked.join(groups, marked["h"] == groups["id"]).select("doc_id", "text_hash", "component")


def keep_one(docs: DataFrame, words: int = ALIKE_SHINGLE, bits: int = ALIKE_BITS, ratio: tuple[int, int] = ALIKE_RATIO) -> DataFrame:
    """``docs`` with one row of each group of ``alike``: that of the smallest doc_id (then text hash)."""
    marked = alike(docs, words, bits, ratio)
    rows = marked.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("w")).select(
        F.col("w.doc_id").alias("_sim_id"), F.col("w.text_hash").alias("_sim_hash"), F.col("w.n").alias("_sim_n"))
    keyed = docs.withColumn("_sim_text", F.xxhash64("text"))
    kept = keyed.join(best, F.col("doc_id").cast("long").eqNullSafe(F.col("_sim_id")) & (F.col("_sim_text") == F.col("_sim_hash")), "inner")
    once = kept.filter("_sim_n = 1").select(*docs.columns)
    # only a winner that is a repeated row has to be made one
    more = kept.filter("_sim_n > 1").dropDuplicates(["_sim_id", "_sim_hash"]).select(*docs.columns)
    return once.unionByName(more)


def as_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
