"""Language of a text by its nearest centroid.

A text is the vector of its hashed character pairs and triples, log(1 + count) times inverse document
frequency, of length 1. Each language has several centroids from spherical k-means over a bounded
sample of its learning rows (``SAMPLE_ROWS`` in all, the same share of every language, never under
``LEAST_ROWS`` where there are as many). The largest cosine names the language; a text further from that centroid than
nearly all learning texts of the language are is marked ``rejected``. Scoring is one pass over whole
texts without a shuffle.

Cases: null text or no letter gives ``und`` and score 0; empty learning data gives ``und`` everywhere;
repeated rows are judged each; rows without id are judged as not held out, but nothing is learnt from them;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.llm.common import held_out, texts_of

DIMS = 2048
CENTROIDS = 4
SAMPLE_ROWS = 4000
LEAST_ROWS = 300
#: The share of learning texts that lie beyond the rejection distance.
REJECT_SHARE = 0.005
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


def gram_counts(text: str, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed character pairs and triples."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    pairs = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - dims.bit_length() + 1)
    both = np.concatenate([pairs, triples ^ (triples >> np.uint32(15))])
    both *= np.uint32(0x2C1B3C6D)
    return np.bincount(both >> shift, minlength=dims)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray      # one row each
    langs: list[str]           # of each centroid
    limit: np.ndarray          # least cosine of each centroid's language

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from points far from those chosen before."""
    start = [int((x @ x.mean(0)).argmax())]
    while len(start) < min(k, len(x)):
        start.append(int((x @ x[start].T).max(1).argmin()))
    centers = x[start]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(1)
        sums = np.stack([x[near == j].sum(0) for j in range(len(centers))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centers)
    return centers


def fit(learning: DataFrame, sample_rows: int = SAMPLE_ROWS, dims: int = DIMS, k: int = CENTROIDS) -> LanguageModel | None:
    """A model of the rows (key, text, lang); ``key`` only picks the sample."""
    rows = learning.filter("text is not null and lang is not null").select("key", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = sample_rows / max(sample_rows, sum(sizes.values()))
    wanted = {lang: max(share * n, min(LEAST_ROWS, sample_rows / len(sizes))) for lang, n in sizes.items()}
    chance = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, float(wanted[lang] / n))])[F.col("lang")]
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < chance * (1 << 20)).select("text", "lang")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, gram_counts(text, dims).astype(np.float32).tobytes()) for text, lang in texts_of(batch)
                     if LETTER.search(text)]
            cols = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary())], ["lang", "counts"])

    got = sorted((r["lang"], bytes(r["counts"])) for r in sample.mapInArrow(features, "lang string, counts binary").collect())
    if not got:
        return None
    langs = np.array([g[0] for g in got], dtype=object)
    counts = np.stack([np.frombuffer(g[1], np.float32) for g in got])
    model = LanguageModel(np.log((1 + len(got)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1, np.zeros((0, dims)), [], np.zeros(0))
    vectors = model.vectors(counts)
    centers, limits = [], []
    for lang in sorted(set(langs)):
        own = vectors[langs == lang]
        mine = _clusters(own, k)
        centers.append(mine)
        model.langs += [lang] * len(mine)
        limits += [float(np.quantile((own @ mine.T).max(1), REJECT_SHARE))] * len(mine)
    model.centroids, model.limit = np.concatenate(centers).astype(np.float32), np.array(limits)
    return model


def predict(docs: DataFrame, model: LanguageModel | None, reject: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, rejected). With ``reject`` a rejected text is ``und``."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in texts_of(batch):
                if model is None or not text or not LETTER.search(text):
                    out.append((doc, UNDETERMINED, 0.0, True))
                    continue
                near = model.centroids @ model.vectors(gram_counts(text, len(model.idf)).astype(np.float32))
                at = int(near.argmax())
                far = bool(near[at] < model.limit[at])
                out.append((doc, UNDETERMINED if reject and far else model.langs[at], min(1.0, max(0.0, float(near[at]))), far))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.bool_()))],
                ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        judge, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from four fifths of the documents, judge all. Rows without id are judged, not learnt from."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(docs, model).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")
