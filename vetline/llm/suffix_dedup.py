"""Exact removal of repeated passages by a sparse, range-partitioned suffix sort.

Every byte that a string of ``WINDOW`` bytes covers is removed if that string starts anywhere else too, in
any document. Sorting all suffixes of a corpus moves many times its size, so only suffixes that can
matter are sorted; the result is exact all the same.

1. Anchors. Inside each window the ``GRAM``-byte string with the smallest rolling hash (the first such) is
   its anchor. Equal windows have their anchor at the same place, so windows are compared only along
   their anchors. Consecutive windows share an anchor: one row for about 70 bytes of text.
2. Anchors are grouped by the hashes of their string and of their block (all bytes of the windows they
   serve). Blocks that occur more than once are repeated as a whole: most copies end here, collapsed by a
   partial aggregate. Anchors whose string occurs once have no equal. What is left are the blocks at the
   rims of repeated passages, a few for each.
3. Suffix sort. Those blocks are fetched and range-partitioned by the leading bytes of their suffixes at
   the anchor (Spark samples the splitters); each bucket sorts all its windows by multikey quicksort
   over 8-byte characters, and equal neighbours are repeats. An anchor with more than ``GROUP`` blocks is
   split by more characters: a window reaches at least ``REACH`` bytes to the left or to the right of its anchor, so its blocks
   are dealt once by the bytes on the left, for the windows that hold them, and once by those on the right. Where even such
   a string has more than ``GROUP`` blocks, they are spread over buckets, and what such a bucket has not matched itself is
   compared across buckets by a 128-bit hash, counted with partial aggregates.
4. Each document gets the ranges found in it, merges them and drops their bytes.

Cases: null is an empty text; texts under ``WINDOW`` bytes keep all; texts of any length are read whole;
repeated rows are repeats of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from vetline.llm.common import stored

WINDOW = 200
GRAM = 64
#: Blocks of one anchor string that one bucket sorts together.
GROUP = 2048
#: Bytes that every window holds on one side of its anchor at least.
REACH = (WINDOW - GRAM) // 2
#: Window starts hashed together, and windows sorted together.
CHUNK = 1 << 18
SORT_WINDOWS = 400_000
_SPAN = 1 << 19          # positions that the low bits of a sliding minimum hold
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have:have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


_UP, _DOWN = _powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 1 << 64), _SPAN)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums that give the hash of any substring, wherever it stands."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _DOWN[:len(data)], out=sums[1:])
    return sums


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def anchors_of(text: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, block hash, first window, last window, anchor) of each run of windows with one anchor."""
    parts = []
    for at in range(0, len(text) - window + 1, CHUNK):
        data = np.frombuffer(text, np.uint8, min(CHUNK + window - 1, len(text) - at), at)
        sums = _sums(data)
        grams = _mixed((sums[gram:] - sums[:-gram]) * _UP[:len(data) - gram + 1])
        ranked = (grams & ~np.uint64(_SPAN - 1)) | np.arange(len(grams), dtype=np.uint64)
        place = (_sliding_min(ranked, window - gram + 1) & np.uint64(_SPAN - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        anchor = place[first]
        block = (sums[last + window] - sums[first]) * _UP[first]
        shape = ((last - first) << 8 | (anchor - first)).astype(np.uint64)
        parts.append((grams[anchor], _mixed(block + shape * np.uint64(0xC2B2AE3D27D4EB4F)), first + at, last + at, anchor + at))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(p) for p in zip(*parts))


def _bytes(value: str | None) -> bytes:
    return value.encode("utf-8", "surrogatepass") if value else b""


def _anchor_rows(rows: DataFrame, window: int) -> DataFrame:
    """(h, block, row_id, at): at packs the first window, how many more the anchor serves, and its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1)
            for lo in range(0, batch.num_rows, 500):
                found = [anchors_of(_bytes(texts[i].as_py()), window) for i in range(lo, min(lo + 500, batch.num_rows))]
                h, block, first, last, anchor = (np.concatenate(x) for x in zip(*found))
                row = np.repeat(ids[lo:lo + len(found)], [len(x[0]) for x in found])
                yield pa.RecordBatch.from_arrays([
                    pa.array(h.view(np.int64)), pa.array(block.view(np.int64)), pa.array(row),
                    pa.array(first << 16 | (last - first) << 8 | (anchor - first))], ["h", "block", "row_id", "at"])

    return rows.select("row_id", "text").mapInArrow(run, "h long, block long, row_id long, at long")


def _ranges(window: int):
    """The bytes [start, stop) that the windows of a packed run cover."""
    start = F.shiftright("at", 16)
    return start.alias("start"), (start + F.shiftright("at", 8).bitwiseAND(F.lit(255)) + window).alias("stop")


def _fetch(joined: DataFrame, window: int) -> DataFrame:
    """The wanted blocks of each document: rows (.., text, wanted array of (h, at, crowded)). Of a crowded anchor
    the windows that reach left and those that do not, each with the bytes there in ``h``."""
    names = joined.columns
    reach = (window - GRAM) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, texts, wanted = (batch.column(names.index(c)) for c in ("row_id", "text", "wanted"))
            for i in range(batch.num_rows):
                data = _bytes(texts[i].as_py())
                row = ids[i].as_py()
                for x in wanted[i].as_py():
                    start, more, off = x["at"] >> 16, (x["at"] >> 8) & 255, x["at"] & 255
                    anchor = start + off
                    lead = int.from_bytes(data[anchor:anchor + 8], "big") - (1 << 63)
                    if not x["crowded"]:
                        out.append((lead, x["h"], False, row, start, data[start:start + more + window]))
                        continue
                    # starts up to ``left`` reach left far enough
                    left, last = anchor - reach, start + more
                    if start <= left:
                        out.append((lead, _narrowed(x["h"], b"l" + data[left:anchor]), True, row, start, data[start:min(last, left) + window]))
                    if last > left:
                        first = max(start, left + 1)
                        out.append((lead, _narrowed(x["h"], b"r" + data[anchor + GRAM:anchor + GRAM + reach]), True, row, first, data[first:last + window]))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["lead", "h", "crowded", "row_id", "start", "bytes"])

    return joined.mapInArrow(run, "lead long, h long, crowded boolean, row_id long, start long, bytes binary")


def _narrowed(h: int, context: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(h.to_bytes(8, "little", signed=True) + context, digest_size=8).digest(), "little", signed=True)


def repeated_windows(blocks: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, offset, repeated?) of every window of ``blocks``, by multikey quicksort over 8-byte characters.

    Each round sorts the windows that are still tied by their next character and drops those that
    became unique; what is tied to the end is repeated.
    """
    pad = -window % 8
    counts = np.array([len(b) - window + 1 for b in blocks])
    data = np.frombuffer(b"".join(blocks) + bytes(8 + pad), np.uint8)
    begins = np.cumsum([0] + [len(b) for b in blocks[:-1]])
    owner = np.repeat(np.arange(len(blocks)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    where = begins[owner] + offset
    chars = np.lib.stride_tricks.sliding_window_view(data, 8)
    tied, group = np.arange(len(where)), np.zeros(len(where), np.int64)
    for at in range(0, window, 8):
        if not len(tied):
            break
        words = np.ascontiguousarray(chars[where[tied] + at]).view(">u8").ravel().astype(np.uint64)
        if at + 8 > window:
            words >>= np.uint64(8 * (at + 8 - window))
        order = np.lexsort((words, group))
        tied, group, words = tied[order], group[order], words[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (words[1:] != words[:-1])])
        group = np.cumsum(new)
        same = np.bincount(group)[group] > 1
        tied, group = tied[same], group[same]
    repeated = np.zeros(len(where), bool)
    repeated[tied] = True
    return owner, offset, repeated


def _sort_buckets(buckets: DataFrame, window: int) -> DataFrame:
    """Rows (row_id, start, stop, w1, w2): ranges of repeated windows; w1 not null: a window of a spread group
    that other buckets may hold, known to be repeated (stop > 0) or not yet (stop = 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows, group = 0, None

        def flush() -> pa.RecordBatch:
            owner, offset, repeated = repeated_windows([x[4] for x in held], window)
            row, start = (np.array([x[k] for x in held], np.int64) for k in (2, 3))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
            new_owner = np.flatnonzero(np.diff(owner) != 0) + 1
            cut = new_owner[repeated[new_owner] & repeated[new_owner - 1]] if len(new_owner) else new_owner
            begin, end = np.sort(np.concatenate([edge[::2], cut])), np.sort(np.concatenate([edge[1::2], cut]))
            out = [(row[owner[begin]], start[owner[begin]] + offset[begin], start[owner[begin]] + offset[end - 1] + window,
                    np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), np.zeros(len(begin), bool))]
            spread = [i for i, x in enumerate(held) if x[1]]
            if spread:
                at = np.flatnonzero(np.isin(owner, spread))
                digests = np.array([np.frombuffer(hashlib.blake2b(held[owner[i]][4][offset[i]:offset[i] + window], digest_size=16)
                                                  .digest(), np.int64) for i in at]).reshape(-1, 2)
                out.append((row[owner[at]], start[owner[at]] + offset[at], np.where(repeated[at], 1, 0), digests[:, 0], digests[:, 1],
                            np.ones(len(at), bool)))
            cols = [np.concatenate(c) for c in zip(*out)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row_id", "start", "stop", "w1", "w2", "open"])

        for batch in batches:
            cols = [batch.column(i) for i in range(7)]
            for i in range(batch.num_rows):
                key = cols[1][i].as_py(), cols[2][i].as_py()
                if key != group and windows > SORT_WINDOWS:
                    yield flush()
                    windows = 0
                group = key
                data = cols[6][i].as_py()
                held.append((key, cols[3][i].as_py(), cols[4][i].as_py(), cols[5][i].as_py(), data))
                windows += len(data) - window + 1
        if held:
            yield flush()

    return buckets.mapInArrow(run, "row_id long, start long, stop long, w1 long, w2 long, open boolean")


def repeated_ranges(rows: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(row_id, start, stop): byte ranges, which may overlap, that repeated windows cover.

    ``rows`` is (row_id, doc_id, text).
    """
    anchors = _anchor_rows(rows, window)
    blocks = anchors.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "at")).alias("one"))
    contested = stored(blocks.withColumn("kinds", F.count(F.lit(1)).over(W.partitionBy("h"))).filter("n > 1 or kinds > 1")
                       .select("h", "block", "n", "kinds", "one.row_id", "one.at"), "contested-blocks")
    whole = anchors.join(contested.filter("n > 1").select("h", "block"), ["h", "block"]).select("row_id", *_ranges(window))
    whole = stored(whole, "whole-blocks")
    wanted = contested.filter("kinds > 1").groupBy("row_id").agg(F.collect_set(F.struct(
        "h", "at", (F.col("kinds") > group).alias("crowded"))).alias("wanted"))
    fetched = stored(_fetch(rows.join(wanted, "row_id"), window), "blocks")
    full = fetched.filter("crowded").groupBy(F.col("h").alias("_h")).agg(F.ceil(F.count(F.lit(1)) / group).alias("salts")).filter("salts > 1")
    salted = fetched.join(full, F.col("h") == F.col("_h"), "left").select(
        "lead", "h", F.coalesce(F.pmod(F.xxhash64("bytes"), F.col("salts")), F.lit(0)).cast("int").alias("salt"),
        F.col("salts").isNotNull().alias("spread"), "row_id", "start", "bytes")
    buckets = salted.repartitionByRange("lead", "h", "salt").sortWithinPartitions("lead", "h", "salt")
    found = stored(_sort_buckets(buckets, window), "sorted-windows")
    open_ = found.filter("open")
    across = open_.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    late = open_.filter("stop = 0").join(across, ["w1", "w2"]).select("row_id", "start", (F.col("start") + window).alias("stop"))
    return whole.unionByName(found.filter("not open").select("row_id", "start", "stop")).unionByName(late)


def _merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = repeated_ranges(rows, window).groupBy("row_id").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    joined = rows.join(ranges, "row_id", "left")
    names = joined.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, gone = (batch.column(names.index(c)) for c in ("doc_id", "text", "gone"))
            out = []
            for i in range(batch.num_rows):
                data = _bytes(texts[i].as_py())
                spans = _merged([(x["start"], x["stop"]) for x in gone[i].as_py() or ()])
                kept, at = hashlib.sha256(), 0
                for start, stop in spans:
                    kept.update(data[at:start])
                    at = stop
                kept.update(data[at:])
                out.append((ids[i].as_py(), len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            cols = list(zip(*out)) or [[]] * 5
            kinds = (*[pa.int64()] * 4, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
