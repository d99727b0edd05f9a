"""Spelling variants by finite-state composition.

1. The vocabulary: runs of letters, counted with a partial aggregate; what occurs rarely goes.
2. A pair one edit apart shares its first half or its last half. The acceptor of the vocabulary is therefore
   cut at the states that a half leads to from the initial state, read forwards and backwards: one part holds the words of
   two neighbouring lengths that pass such a state. Parts are dealt to tasks and sorted, none is gathered.
3. In a part the rest of the words, sorted, becomes a minimal acceptor (``Acceptor``). It is composed with the
   one-edit transducer and itself: before the edit both sides are in the same state; the edit replaces,
   or inserts, one letter; behind it both sides must read the same. ``near_pairs`` enumerates what the product accepts.
   Each pair is found once: at its first difference, forwards if that lies behind the first half, else backwards.
   Only counts and the best partner of a word leave the task.
4. A part above ``PART`` words takes the edit at its state as a step of its own: words that agree
   without the letter there meet by key, and the others go on one letter deeper, as smaller parts. So no task
   holds more than ``PART`` words, whatever beginnings are frequent.
5. Forms are followed to their roots by doubling.

Cases: null or empty text has no words; a null ``doc_id`` counts as empty text before the colon; repeated rows count each;
words of equal count are told apart by code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form occurs at least so many times as often.
RATIO = 5
#: Most words of a part.
PART = 20_000
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
EVERY = 199

FOUND = "word string, n_near long, n long, form string"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the lower-cased runs, some without a letter, that are long and frequent enough."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= LEAST_LENGTH).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.when(F.col("h") % EVERY == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run"))))
    words = runs.withColumn("h", h).select(F.coalesce(cut, "run").alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The minimal acceptor of sorted distinct words: ``arcs`` and ``final`` by state, the initial state is ``start``.

    A state is settled once no later word can change it, and merged with a settled one of equal arcs.
    """

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[{}, False]]           # states of the word read last, not settled
        last = ""

        def settle(depth: int) -> None:
            while len(path) > depth:
                arcs, final = path.pop()
                key = (final, *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                if path:
                    path[-1][0][last[len(path) - 1]] = state
                else:
                    self.start = state
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            settle(same + 1)
            path += [[{}, False] for _ in range(len(word) - same)]
            path[-1][1] = True
            last = word
        settle(0)

    def common(self, p: int, q: int) -> Iterator[str]:
        """What both states accept."""
        stack = [(p, q, "")]
        while stack:
            p, q, read = stack.pop()
            if self.final[p] and self.final[q]:
                yield read
            right = self.arcs[q]
            stack += [(to, right[x], read + x) for x, to in self.arcs[p].items() if x in right]

    def near_pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs one edit apart, the shorter first: words of acceptor, one-edit transducer and acceptor, composed."""
        stack = [(self.start, "")]
        while stack:
            p, read = stack.pop()
            for (x, px), (y, py) in combinations(self.arcs[p].items(), 2):
                for rest in self.common(px, py):
                    yield read + x + rest, read + y + rest
            for y, py in self.arcs[p].items():
                for rest in self.common(p, py):
                    if rest[:1] != y:                      # else the same pair is found behind
                        yield read + rest, read + y + rest
                stack.append((py, read + y))


def _better(a: tuple, b: tuple) -> bool:
    """More frequent, or as frequent and smaller; (count, word)."""
    return (-a[0], a[1]) < (-b[0], b[1])


class _Partners:
    """Per word of a part: near words, and the best of them."""

    def __init__(self) -> None:
        self.of: dict[str, list] = {}

    def add(self, word: str, other: str, n: int) -> None:
        got = self.of.setdefault(word, [0, (0, "")])
        got[0] += 1
        if _better((n, other), got[1]):
            got[1] = (n, other)

    def batch(self) -> pa.RecordBatch:
        rows = [(w, k, n, form) for w, (k, (n, form)) in self.of.items()]
        self.of = {}
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                          ["word", "n_near", "n", "form"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """(part, its rows) of batches sorted by part: columns cls, back, deep, head, rest, n."""
    part, rows = None, []
    for batch in batches:
        for *key, rest, n in zip(*[batch.column(c).to_pylist() for c in ("cls", "back", "deep", "head", "rest", "n")]):
            if key != part:
                if len(rows) > 1:
                    yield part, rows
                part, rows = key, []
            rows.append((rest, n))
    if len(rows) > 1:
        yield part, rows


def _first_difference(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Partners()
    for (cls, back, _, head), rows in _parts(batches):
        n, half = dict(rows), (cls + 1) // 2
        for u, v in Acceptor(n).near_pairs():
            a, b = head + u, head + v
            if min(len(a), len(b)) != cls:                 # both of the longer length: pairs of the next class
                continue
            if back:
                a, b = a[::-1], b[::-1]
                if _first_difference(a, b) >= half:        # found forwards
                    continue
            found.add(a, b, n[v])
            found.add(b, a, n[u])
        if len(found.of) > 50_000:
            yield found.batch()
    yield found.batch()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of one key differ in the letter left out of the key, by an edit of ``kind``; the alphabet bounds the words of a key."""
    found = _Partners()
    for (cls, back, _, _), rows in _parts(batches):
        half = (cls + 1) // 2
        for (a, na), (b, nb) in combinations(rows, 2):
            short, long = sorted((a, b), key=len)
            if len(short) != cls:
                continue
            if back and _first_difference(a[::-1], b[::-1]) >= half:
                continue
            a, b = (a[::-1], b[::-1]) if back else (a, b)
            found.add(a, b, nb)
            found.add(b, a, na)
        if len(found.of) > 50_000:
            yield found.batch()
    yield found.batch()


def _sorted_parts(rows: DataFrame) -> DataFrame:
    key = ["cls", "back", "deep", "head"]
    return rows.select(*key, "rest", "n").repartition(*key).sortWithinPartitions(*key, "rest")


def initial_parts(words: DataFrame) -> DataFrame:
    """(cls, back, deep, head, rest, n): each word in the parts of its halves; ``cls`` is the shorter length of the pairs sought."""
    size = F.length("word")
    sides = words.select("n", F.explode(F.array(*[F.struct(F.lit(back).alias("back"), w.alias("s"), c.alias("cls")) for c in (size, size - 1)
                                                  for back, w in ((0, F.col("word")), (1, F.reverse("word")))])).alias("_"))
    cls = F.col("_.cls")
    deep = F.when(F.col("_.back") == 0, F.floor((cls + 1) / 2)).otherwise(F.floor(cls / 2)).cast("int")
    return sides.filter(cls >= LEAST_LENGTH).select(
        cls.alias("cls"), F.col("_.back").alias("back"), deep.alias("deep"), F.col("_.s").alias("s"), "n").select(
        "cls", "back", "deep", F.col("s").substr(F.lit(1), F.col("deep")).alias("head"),
        F.col("s").substr(F.col("deep") + 1, F.length("s")).alias("rest"), "n")


def partners(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, n, form): partial counts of near words and the best of them, several rows a word."""
    key = ["cls", "back", "deep", "head"]
    open_, found = stored(initial_parts(words), "parts"), []
    while True:
        crowded = stored(open_.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > part).select(*key), "crowded")
        none = crowded.isEmpty()
        small = open_ if none else open_.join(crowded, key, "left_anti")
        found.append(_sorted_parts(small).mapInArrow(_compose, FOUND))
        if none:
            break
        large = stored(open_.join(crowded, key, "left_semi"), "large")
        found.append(_sorted_parts(_edits_here(large)).mapInArrow(_meet, FOUND))
        first = F.col("rest").substr(1, 1)
        open_ = stored(large.filter("rest <> ''").select(
            "cls", "back", (F.col("deep") + 1).alias("deep"), F.concat("head", first).alias("head"),
            F.col("rest").substr(F.lit(2), F.length("rest")).alias("rest"), "n"), "deeper")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _edits_here(large: DataFrame) -> DataFrame:
    """Keys of the words without their letter at the part's state: equal keys are one edit apart there."""
    word, behind = F.concat("head", "rest"), F.col("rest").substr(F.lit(2), F.length("rest"))
    short = F.length(word) == F.col("cls")
    replaced = F.when(short & (F.col("rest") != ""), F.concat("head", F.lit("\x00"), behind))
    # of equal letters in a row the last one counts as inserted
    inserted = F.when(short, word).when((F.col("rest") != "") & (F.col("rest").substr(1, 1) != F.col("rest").substr(2, 1)), F.concat("head", behind))
    return large.select("cls", "back", "deep", F.explode(F.array_compact(F.array(replaced, inserted))).alias("head"), word.alias("rest"), "n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last; the way doubles each round."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = steps.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        further = stored(steps.join(ahead, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        steps = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return steps


def variants(docs: DataFrame, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = stored(vocabulary(docs), "vocabulary")
    best = partners(words, part).groupBy(F.col("word").alias("_w")).agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("form").alias("form"))).alias("best"))
    own = F.col("n")
    frequent = -F.col("best.less") >= own * RATIO
    judged = stored(words.join(best, F.col("word") == F.col("_w"), "left").select(
        "word", F.when(frequent, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, -F.col("best.less")).alias("form_n")), "judged")
    last = roots(judged.filter("form is not null")).select(F.col("word").alias("_w"), "root")
    return judged.join(last, F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
