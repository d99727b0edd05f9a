"""Spelling variants and the filter audit against brute force."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest
from test_llm import documents, edits
from pyspark.sql import functions as F

from vetline.llm import filter_audit, spelling


def plain_variants(rows):
    n = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = sorted(w for w in n if len(w) >= 6 and n[w] >= 5)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelled_rows(seed, n=80):
    random.seed(seed)
    base = ["".join(random.choices("abé", k=random.randint(6, 9))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "abbbbba", "abbbbbba", "prefixword", "prefixwort"]
    rows = []
    for d in range(n):
        words = []
        for _ in range(60):
            w = list(random.choice(base[:3] * 6 + base))
            if random.random() < .5:
                p = random.randrange(len(w))
                w[p:p + random.randint(0, 1)] = random.choice([[], ["a"], ["b"], ["é"]])
            words.append("".join(w))
        rows.append((d, random.choice([" ", "-", " 7 "]).join(words).swapcase() if d % 3 == 0 else " ".join(words)))
    return [*rows, (900, None), (901, ""), (902, "ab ×÷ÿ×÷ÿ Āabc"), (None, rows[3][1]), rows[5], rows[5], (903, "x" * 30000), (904, "wordword " * 3000),
            *[(1000 + i, "chainab " * 20 + "chainabc " * 3 + "chainabcd" * (i % 3 == 0)) for i in range(20)]]


@pytest.mark.parametrize("part", [spelling.PART, 200])
def test_variants_equal_brute_force(spark, part):
    rows = spelled_rows(part)
    got = [tuple(r) for r in spelling.variants(documents(spark, rows), part).collect()]
    want = plain_variants(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(r[1] is not None for r in got) > 5 and any(r[1] and r[1] != r[2] for r in got)


def test_crowded_parts_are_split(spark):
    random.seed(4)
    words = sorted({"internal" + "".join(random.choices("abc", k=random.randint(3, 5))) for _ in range(300)}
                   | {"".join(random.choices("abc", k=random.randint(1, 3))) + "ational" for _ in range(40)})
    rows = spark.createDataFrame([(w, 5 + i % 97) for i, w in enumerate(words)], "word string, n long")
    crowded = spelling.initial_parts(rows).groupBy("cls", "back", "deep", "head").count().filter("count > 120")
    assert crowded.count() > 0
    got = {r["word"]: (r["k"], r["f"]) for r in spelling.partners(rows, 120).groupBy("word").agg(
        F.sum("n_near").alias("k"), F.min(F.struct((-F.col("n")).alias("a"), "form"))["form"].alias("f")).collect()}
    n = {w: 5 + i % 97 for i, w in enumerate(words)}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    assert got == {w: (len(v), min(v, key=lambda x: (-n[x], x))) for w, v in near.items() if v}


def test_acceptor_is_minimal_and_exact():
    random.seed(1)
    words = sorted({"".join(random.choices("ab", k=random.randint(0, 7))) for _ in range(90)})
    a = spelling.Acceptor(words)
    assert sorted(a.common(a.start, a.start)) == words
    rights = {s: frozenset(a.common(s, s)) for s in range(len(a.arcs))}
    assert len(set(rights.values())) == len(rights)
    pairs = list(a.near_pairs())
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert {frozenset(p) for p in pairs} == {frozenset((u, v)) for i, u in enumerate(words) for v in words[:i] if abs(len(u) - len(v)) < 2 and edits(u, v) == 1}


def plain_audit(rows, labels):
    first, texts = {}, []
    for d, text, lang in rows:
        text = text or ""
        if d is not None:
            first[text] = min(d, first.get(text, d))
        texts.append((d, text, lang or ""))
    labels = [x for x in labels if x[0] is not None]
    good, toxic = {d for d, q, t in labels if q == 1}, {d for d, q, t in labels if t == 1}
    out = collections.Counter()
    for d, text, part in texts:
        words = text.encode().split()
        fails = {x for x, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                                               re.search("[#$%&*|]", text), d is not None and d > first[text])) if bad}
        for order in filter_audit.ORDERS:
            there = True
            for s, x in enumerate(order):
                key = (part, order, s + 1)
                fail, gone = x in fails, there and x in fails
                out[key, "kept"] += there and not fail
                out[key, "removed"] += gone
                out[key, "redundant"] += fail and not there
                out[key, "unique_fails"] += fails == {x}
                out[key, "good_lost"] += gone and d in good
                out[key, "toxic_lost"] += gone and d in toxic
                out[part, x] += gone
                there &= not fail
    return {(*k, *[out[k, c] for c in filter_audit.OUTCOMES], out[k[0], k[1][k[2] - 1]]) for k in {k[0] for k in out if len(k[0]) == 3 and isinstance(k[0], tuple)}}


def test_audit_equals_brute_force(spark):
    random.seed(2)
    words = ["the", "Of", "été", "A#", "x\x1cy", "日本", "ONE", "two", "%"] + [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(random.choices(words[random.choice([0, 9]):], k=random.choice([5, 99, 100, 101, 200]))), random.choice(["en", "fr", None, ""])) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, " \n ", "xx"), (None, rows[3][1], "en"), rows[4], rows[4], (103, rows[4][1], "fr"), (104, "Word " * 9000, "en"),
             (105, "A" * 1 + "b" * 9, "en"), (106, "A" * 2 + "b" * 9, "en")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 110, 2)] + [(4, None, 1), (None, 1, 1), (6, 1, None), (6, 0, 0)]
    got = [tuple(r) for r in filter_audit.audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()]
    want = plain_audit([r[:3] for r in rows], labels)
    assert len(got) == len(want) == 600 * 4 and set(got) == want


def test_wide_counters_do_not_run_over():
    top = (1 << 63) - 1
    total = sum(filter_audit.packed(m, 1, 1) * (top // 32) for m in range(32))
    counts = filter_audit.unpacked(total)
    assert counts.max() <= top and counts[0, 0, 0] == 16 * (top // 32)


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert spelling.variants(docs).count() == 0
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
