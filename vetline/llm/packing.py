"""Best-fit packing by exact complements: which pieces of documents share a training sequence.

1. Tokenise (mapInArrow): one narrow row per piece; token ids themselves are not shuffled.
2. The lengths form a histogram of at most ``seq_len`` numbers, whatever the input. The plan is made
   from it alone: the longest length takes the single, pair or triple of lengths that fills its gap
   exactly, as often as all of them are available; what finds no exact fill is placed best-fit
   decreasing, again by counts. A plan is a list of patterns with multiplicities.
3. Pieces get their rank within their length (windows over slices of bounded size, so a length that
   a third of all pieces has is split) and find sequence and offset by an equi-join with the plan.

Cases: a null or empty text is one piece that holds only the end id; repeated rows are packed once
each; an empty table gives no rows; extra input columns are ignored. No text is cut but those
longer than ``seq_len`` ids.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from vetline.llm.common import stored, texts_of

SEQ_LEN = 4096
END_ID = 1
#: Words remembered by a worker; it forgets all of them beyond this number.
CACHE_WORDS = 250_000
#: Marks that close a part and never merge with a letter before them; < | > are left out because they
#: spell special tokens.
MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
#: Python's split() also cuts at these, the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
BLANKS = re.compile(r"[ \n\r\t]+")
#: Capitals whose small form depends on what is around them.
ODD_CASE = re.compile("[Σİ]")
#: How the tokenizer writes the bytes that are no visible character of their own.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Pieces of one length that one window ranks.
SLICE_PIECES = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """Token ids of whole texts through a cache of words.

    The tokenizer never merges over white space, so a text's ids are those of its parts between
    blanks; a part's closing marks are merged apart from its letters, so they are looked up apart. A
    part of letters alone is one word to the tokenizer and goes straight to its merges; any other
    part goes through all of its steps.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.cache_words = cache_words

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.cache_words:
            self.clear()
        core = word.rstrip(MARKS)
        # a letter whose small form ends in a mark, as the dotted capital I, would merge with the marks
        if core != word and core and core[-1].isalnum() and unicodedata.normalize("NFC", core.lower())[-1].isalnum():
            ids = self[core] + self[word[len(core):]]
        else:
            low = word.lower()
            if low.isalpha() and (low.isascii() or (unicodedata.is_normalized("NFC", word) and not ODD_CASE.search(word))):
                spelt = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = array("I", [t.id for t in self.merge(spelt)]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Unsigned 32-bit ids, in the machine's order (little-endian wherever Spark runs)."""
        return b"".join(map(self.__getitem__, BLANKS.split(text) if SEPARATORS.search(text) else text.split()))


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One for all tasks that a Python worker runs."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN,
                 end_id: int = END_ID) -> DataFrame:
    """One row per piece: documents with their end id, cut only where longer than ``seq_len``."""
    path = tokenizer_path or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in texts_of(batch):
                ids = memoryview((encoder.encode(text) if text else b"") + end)
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, seq_len)):
                    length = min(seq_len, n - start)
                    out.append((doc, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


def _pair(have: np.ndarray, total: int) -> tuple[int, int] | None:
    """The pair of available lengths with this sum whose larger member is largest."""
    low = np.arange(1, total // 2 + 1)
    good = (have[low] > 0) & (have[total - low] > 0) & ((2 * low != total) | (have[low] > 1))
    return (total - int(low[good.argmax()]), int(low[good.argmax()])) if good.any() else None


def _complement(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """A single, pair or triple of available lengths that sums to ``gap``."""
    if have[gap]:
        return (gap,)
    if pair := _pair(have, gap):
        return pair
    for first in np.flatnonzero(have[:gap])[::-1].tolist():
        if 3 * first < gap:
            return None
        have[first] -= 1
        rest = _pair(have[:first + 1], gap - first) if gap - first <= first else _pair_below(have, gap - first, first)
        have[first] += 1
        if rest:
            return (first, *rest)
    return None


def _pair_below(have: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """As _pair, no member above ``most``."""
    low = np.arange(max(1, total - most), total // 2 + 1)
    if not len(low):
        return None
    good = (have[low] > 0) & (have[total - low] > 0) & ((2 * low != total) | (have[low] > 1))
    return (total - int(low[good.argmax()]), int(low[good.argmax()])) if good.any() else None


def packing_plan(counts: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; uses every piece exactly once."""
    have = np.zeros(seq_len + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if have[seq_len]:
        plan.append(((seq_len,), int(have[seq_len])))
    rest: dict[int, int] = {}
    for length in range(seq_len - 1, 0, -1):
        while have[length]:
            have[length] -= 1
            fill = _complement(have, seq_len - length)
            have[length] += 1
            if fill is None:
                rest[length] = int(have[length])
                have[length] = 0
                break
            pattern = (length, *fill)
            times = min(int(have[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                have[x] -= times
            plan.append((pattern, times))
    return plan + best_fit(rest, seq_len)


def best_fit(counts: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: bins of one content are one entry with a multiplicity."""
    rooms: list[int] = []                      # free rooms that some open bins have, ascending
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        room = seq_len - sum(pattern)
        if not times:
            return
        if not room:
            done.append((pattern, times))
        else:
            if room not in bins:
                bins[room] = []
                bisect.insort(rooms, room)
            bins[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = seq_len // length
                put((length,) * each, n // each)
                put((length,) * (n % each), 1 if n % each else 0)
                break
            room = rooms[at]
            pattern, times = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            # a bin that still has room for another of this length is its own best fit
            each = room // length
            full = min(times, n // each)
            put(pattern + (length,) * each, full)
            n -= full * each
            times -= full
            if times and n:
                put(pattern + (length,) * n, 1)
                times, n = times - 1, 0
            put(pattern, times)
    return done + [x for group in bins.values() for x in group]


def pack(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence and its place there."""
    pieces = stored(token_pieces(docs, tokenizer_path, seq_len, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots: list[tuple[int, int, int, int, int]] = []    # length, first and last rank, first sequence, offset
    used = dict.fromkeys(counts, 0)
    sequence = 0
    for pattern, times in packing_plan(counts, seq_len):
        offset = 0
        for length in pattern:
            slots.append((length, used[length], used[length] + times - 1, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    if used != counts:
        raise AssertionError("the plan does not use every piece once")
    return _placed(pieces, counts, slots)


def _placed(pieces: DataFrame, counts: dict[int, int], slots: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Pieces with the sequence and offset that their rank within their length has in the plan."""
    spark = pieces.sparkSession
    per_length: dict[int, int] = {}
    for length, *_ in slots:
        per_length[length] = per_length.get(length, 0) + 1
    # slots are looked up by stretches of ranks, about one slot each
    lengths = spark.createDataFrame([(k, n // SLICE_PIECES + 1, -(-n // per_length[k])) for k, n in counts.items()],
                                    "length long, slices long, stretch long")
    sliced = pieces.join(F.broadcast(lengths), "length").withColumn(    # at most seq_len rows
        "slice", F.pmod(F.xxhash64("doc_id", "piece"), F.col("slices")))
    sizes = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "slice", (F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    inside = W.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    rank = (F.col("before") + F.col("place")).cast("long")
    ranked = sliced.withColumn("place", F.row_number().over(inside) - 1).join(before, ["length", "slice"]).withColumn(
        "rank", rank).withColumn("stretch_no", F.floor(F.col("rank") / F.col("stretch")))
    table = spark.createDataFrame(slots, "length long, first long, last long, sequence long, offset long").join(
        F.broadcast(lengths.select("length", "stretch")), "length")
    table = table.withColumn("stretch_no", F.explode(F.expr("sequence(first div stretch, last div stretch)"))).drop("stretch")
    found = ranked.join(table, ["length", "stretch_no"]).filter((F.col("rank") >= F.col("first")) & (F.col("rank") <= F.col("last")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32",
                        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
