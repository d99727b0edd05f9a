"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Input is a word's hashed embedding plus the mean of its hashed character-gram embeddings (three and four
characters, with marks at both ends), so invented inflections of known words count. A window of
``WINDOW`` words goes through a gated recurrent unit in both directions; attention pools its states and a
linear unit gives a logit. A text is scored by all its windows, which overlap by half, and takes the
highest: whole texts are read, and toxic words are found wherever they stand.

Training: ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` other labelled rows at most, none above ``LONGEST``
characters, are the bounded sample; one task learns from it, the driver only gets the weights. Each round scores all windows of the sample, then learns from each
text's highest window and from a random one of clean texts. Scoring is one pass over the documents without
a shuffle; what a worker keeps is a cache of words' inputs.

Cases: a null, empty or blank text scores 0; without labelled rows of both kinds every score is 0;
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import batches as text_batches
from vetline.llm.common import held_out, texts_of

WINDOW = 32
STRIDE = 16
HIDDEN = 8
WIDTH = 12
WORD_ROWS, GRAM_ROWS = 1 << 12, 1 << 15
TOXIC_ROWS, CLEAN_ROWS = 1000, 2500
LONGEST = 100_000
ROUNDS = 12
CACHE_WORDS = 200_000
CHUNK = 1_000_000
SEED = 7


class Features:
    """Rows of words in the embedding tables: one of the word, several of its character grams."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
        grams, owners = [], []
        for k in (3, 4):
            whole = np.flatnonzero(owner[:len(owner) - k + 1] == owner[k - 1:])
            h = np.zeros(len(whole), np.uint32)
            for i in range(k):
                h = (h ^ codes[whole + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            grams.append(h % np.uint32(GRAM_ROWS))
            owners.append(owner[whole])
        owners = np.concatenate(owners)
        self.grams = np.concatenate(grams)[np.argsort(owners, kind="stable")]
        self.sizes = np.bincount(owners, minlength=len(words))
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.word = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_ROWS for w in words], np.int64)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, gram rows word by word, and how many grams each has (one at least)."""
        sizes = self.sizes[words]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(self.firsts[words] - before, sizes) + np.arange(sizes.sum())
        return self.word[words], self.grams[at], sizes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and passes. Arrays are (step, window, unit)."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN, width: int = WIDTH):
        rng = np.random.default_rng(seed)
        h, d = hidden, width

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": draw(WORD_ROWS, d, scale=.1), "gram": draw(GRAM_ROWS, d, scale=.3),
                  "wx": draw(2, d, 3 * h, scale=d ** -.5), "b": np.zeros((2, 3 * h), np.float32),
                  "u": draw(2, h, 3 * h, scale=h ** -.5), "wa": draw(2 * h, h, scale=(2 * h) ** -.5),
                  "ba": np.zeros(h, np.float32), "va": draw(h, scale=h ** -.5),
                  "w": draw(2 * h, scale=(2 * h) ** -.5), "c": np.full(1, -1, np.float32)}
        self.hidden = h

    def inputs(self, features: Features, words: np.ndarray) -> np.ndarray:
        """Embedding of each word."""
        word, grams, sizes = features.of(words)
        sums = np.add.reduceat(self.p["gram"][grams], np.cumsum(sizes) - sizes, axis=0)
        return self.p["word"][word] + sums / sizes[:, None].astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """(word, direction, 3 gates): a word's share of the gates."""
        return np.einsum("nd,kdg->nkg", x, self.p["wx"]) + self.p["b"]

    def projected_words(self, features: Features, block: int = 16_384) -> np.ndarray:
        """projected() of all words of ``features``, some at a time."""
        n = len(features.word)
        return np.concatenate([self.projected(self.inputs(features, np.arange(i, min(i + block, n)))) for i in range(0, n, block)])

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows whose words have the input shares ``gates`` (step, window, 2, 3h)."""
        steps, n, h = gates.shape[0], gates.shape[1], self.hidden
        states = np.zeros((2, steps, n, h), np.float32)
        kept = []
        for k in (0, 1):
            u = self.p["u"][k]
            s = np.zeros((n, h), np.float32)
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                x, r = gates[t, :, k], s @ u
                zr = _sigmoid(x[:, :2 * h] + r[:, :2 * h])
                z, g = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h:] + g * r[:, 2 * h:])
                new = c + z * (s - c)
                m = mask[t][:, None]
                new = np.where(m, new, s)
                if keep:
                    kept.append((k, t, s, z, g, c, r[:, 2 * h:]))
                s = states[k, t] = new
        both = np.concatenate([states[0], states[1]], axis=-1)
        act = np.tanh(both @ self.p["wa"] + self.p["ba"])
        e = np.where(mask, act @ self.p["va"], -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, both)
        logit = pooled @ self.p["w"] + self.p["c"][0]
        return (logit, (both, act, a, pooled, kept)) if keep else logit

    def backward(self, gates, mask, cache, dlogit) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters above the inputs, and of ``gates``."""
        both, act, a, pooled, kept = cache
        h = self.hidden
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram", "wx", "b")}
        g["w"], g["c"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpool = dlogit[:, None] * self.p["w"]
        da = np.einsum("nh,tnh->tn", dpool, both)
        de = a * (da - (a * da).sum(0))
        dact = de[..., None] * self.p["va"] * (1 - act ** 2)
        g["va"] = np.einsum("tn,tnh->h", de, act)
        g["ba"], g["wa"] = dact.sum((0, 1)), np.einsum("tni,tnj->ij", both, dact)
        dboth = a[..., None] * dpool + dact @ self.p["wa"].T
        dgates = np.zeros_like(gates)
        carry = {0: np.zeros_like(dboth[0, :, :h]), 1: np.zeros_like(dboth[0, :, :h])}
        for k, t, s, z, gate, c, rn in reversed(kept):
            u = self.p["u"][k]
            m = mask[t][:, None]
            ds = carry[k] + dboth[t, :, k * h:(k + 1) * h]
            dn = np.where(m, ds, 0)
            dc = dn * (1 - z) * (1 - c ** 2)
            dz = dn * (s - c) * z * (1 - z)
            dg = dc * rn * gate * (1 - gate)
            dgates[t, :, k] = np.concatenate([dz, dg, dc], 1)
            dr = np.concatenate([dz, dg, dc * gate], 1)
            g["u"][k] += s.T @ dr
            carry[k] = np.where(m, ds * z, ds) + dr @ u.T
        return g, dgates


def windows(ids: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """(window, step) places of all overlapping windows; -1 pads the last."""
    n = len(ids)
    starts = np.arange(0, max(1, n - window + stride), stride)
    at = starts[:, None] + np.arange(window)
    return np.where(at < n, ids[np.minimum(at, n - 1)], -1)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        for k, x in g.items():
            m = self.m[k] = .9 * self.m.get(k, 0) + .1 * x
            v = self.v[k] = .99 * self.v.get(k, 0) + .01 * x * x
            p[k] -= (self.rate * (m / (1 - .9 ** self.t)) / (np.sqrt(v / (1 - .99 ** self.t)) + 1e-7)).astype(np.float32)


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = SEED) -> Network | None:
    """Multiple-instance learning: a toxic text has a toxic window, a clean text has none."""
    vocabulary: dict[str, int] = {}
    docs = []
    for text, label in zip(texts, labels):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in text.lower().split()], np.int32)
        if len(ids):
            docs.append((windows(ids), label))
    if len({y for _, y in docs}) < 2:
        return None
    del texts
    features = Features(list(vocabulary))
    del vocabulary
    all_windows = [w for w, _ in docs]
    of_doc = np.repeat(np.arange(len(docs)), [len(x) for x in all_windows])
    stacked = np.concatenate(all_windows)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in all_windows])])
    y = np.array([d[1] for d in docs], np.float32)
    net, rng = Network(seed), np.random.default_rng(seed)
    adam = _Adam(0.02)

    def learn(chosen: np.ndarray, target: np.ndarray) -> None:
        places = stacked[chosen].T
        mask = places >= 0
        words, inverse = np.unique(np.maximum(places, 0), return_inverse=True)
        x = net.inputs(features, words)
        gates = net.projected(x)[inverse.reshape(places.shape)]
        logit, cache = net.forward(gates, mask, keep=True)
        weight = np.where(target > 0, .5 / max(1, (target > 0).sum()), .5 / max(1, (target == 0).sum()))
        g, dgates = net.backward(gates, mask, cache, ((_sigmoid(logit) - target) * weight).astype(np.float32))
        dproj = np.zeros((len(words), 2, 3 * net.hidden), np.float32)
        np.add.at(dproj, inverse.ravel(), (dgates * mask[..., None, None]).reshape(-1, 2, 3 * net.hidden))
        g["wx"], g["b"] = np.einsum("nd,nkg->kdg", x, dproj), dproj.sum(0)
        dx = np.einsum("nkg,kdg->nd", dproj, net.p["wx"])
        g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
        word, grams, sizes = features.of(words)
        np.add.at(g["word"], word, dx)
        np.add.at(g["gram"], grams, np.repeat(dx / sizes[:, None].astype(np.float32), sizes, axis=0))
        adam.step(net.p, g)

    for r in range(rounds):
        table = net.projected_words(features)
        score = np.concatenate([_scores(net, table, stacked[i:i + 2048]) for i in range(0, len(stacked), 2048)])
        order = np.lexsort((-score, of_doc))
        best = order[begin[:-1]]
        second = order[np.minimum(begin[:-1] + 1, begin[1:] - 1)]
        other = begin[:-1] + rng.integers(0, 1 << 30, len(docs)) % np.diff(begin)
        # early rounds also learn from random windows of toxic texts, until the highest ones are the right ones
        early = r < rounds // 3
        chosen = np.concatenate([best, second[y == 0], other if early else other[y == 0]])
        target = np.concatenate([y, y[y == 0], y if early else y[y == 0]])
        shuffled = rng.permutation(len(chosen))
        for i in range(0, len(shuffled), 256):
            learn(chosen[shuffled[i:i + 256]], target[shuffled[i:i + 256]])
    # put the decision half way between the kinds' rims, where training left it near one of them
    table = net.projected_words(features)
    score = np.concatenate([_scores(net, table, stacked[i:i + 2048]) for i in range(0, len(stacked), 2048)])
    top = np.maximum.reduceat(score, begin[:-1])
    net.p["c"] -= np.float32((np.quantile(top[y == 1], .01) + np.quantile(top[y == 0], .999)) / 2)
    return net


def _scores(net: Network, table: np.ndarray, places: np.ndarray) -> np.ndarray:
    places = places.T
    return net.forward(table[np.maximum(places, 0)], places >= 0)


class Scorer:
    """Scores texts with a cache of words' input shares."""

    def __init__(self, net: Network, cache_words: int = CACHE_WORDS):
        self.net, self.cache_words = net, cache_words
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 2, 3 * self.net.hidden), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        split = [t.lower().split() if t else [] for t in texts]
        words = set().union(*split)
        new = words.difference(self.rows)
        if len(self.rows) + len(new) > self.cache_words:
            self.forget()
            new = words
        if new:
            new = sorted(new)
            at = len(self.rows)
            if at + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(new)), *self.table.shape[1:]), np.float32)])
            self.table[at:at + len(new)] = self.net.projected_words(Features(new))
            self.rows.update(zip(new, range(at, at + len(new))))
        out = np.zeros(len(texts))
        get = self.rows.__getitem__
        full = [(i, windows(np.fromiter(map(get, s), np.int64, len(s)))) for i, s in enumerate(split) if s]
        if full:
            places = np.concatenate([w for _, w in full])
            logit = np.concatenate([_scores(self.net, self.table, places[i:i + 2048]) for i in range(0, len(places), 2048)])
            top = np.maximum.reduceat(logit, np.concatenate([[0], np.cumsum([len(w) for _, w in full])[:-1]]))
            out[[i for i, _ in full]] = _sigmoid(top.astype(np.float64))
        return out


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Network | None:
    """A network of labelled documents outside the held-out fifth.

    Ids are sampled first, from narrow columns; only the texts of the bounded sample move.
    """
    docs = docs.select("doc_id", "text")
    known = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("key"), "toxic")
    rows = docs.filter(~held_out(F.col("doc_id")) & (F.length("text") <= LONGEST)).select("doc_id").join(
        known, F.col("doc_id") == F.col("key")).select("key", "toxic").distinct()
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("toxic") == 1, toxic_rows / sizes[1]).otherwise(clean_rows / sizes[0])
    sample = rows.filter(F.pmod(F.xxhash64("key", F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20))
    # about toxic_rows + clean_rows ids, whatever the input
    texts = docs.filter(F.length("text") <= LONGEST).join(F.broadcast(sample), F.col("doc_id") == F.col("key")).select("key", "text", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(3)]))
        texts, marks = [g[1] for g in got], [g[2] for g in got]
        del got
        net = train(texts, marks)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p) if net else None], pa.binary())], ["weights"])

    weights = texts.repartition(1).mapInArrow(learn, "weights binary").first()["weights"]
    if weights is None:
        return None
    net = Network(SEED)
    net.p = pickle.loads(weights)
    return net


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, row_id, score) of every document; row_id is a hash of id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            parts = [scorer.scores([t for _, t in part]) if scorer else np.zeros(len(part))
                     for part in text_batches(texts_of(batch), CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(parts) if parts else np.zeros(0))],
                                             ["doc_id", "row_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row_id")).mapInArrow(
        run, "doc_id long, row_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    net = fit(docs, labels)
    return score(docs, net).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                                   (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` less those judged toxic."""
    bad = score(docs, fit(docs, labels)).filter("score >= 0.5").select(F.col("row_id").alias("_tox_bad")).distinct()
    keyed = docs.withColumn("_tox_row", F.xxhash64("doc_id", "text"))
    return keyed.join(bad, F.col("_tox_row") == F.col("_tox_bad"), "left_anti").select(*docs.columns)
