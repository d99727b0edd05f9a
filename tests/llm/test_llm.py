"""The operators of vetline.llm against brute force, on small tables with every odd case."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetline.llm import (embedding_dedup, forest_search, language_id, line_dedup, mixing, packing, simhash, suffix_dedup,
                         token_counts, toxicity)
from vetline.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h long, key string"


def documents(spark, rows):
    """Rows (doc_id, text[, lang, source]) with extra columns that clash with names used inside."""
    full = [(*r, *[None] * (4 - len(r)), None, "x", 1, "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    random.seed(3)
    words = ["the", "of", "Straße", "été", "ab", "Idiot", "a\x1cb", "x<|endoftext|>.", "it's", "²", "ΑΣ", "日本"]
    rows = [(i, " ".join(random.choices(words, k=random.randint(0, 40))), "en", random.choice(["a", "b", None])) for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \n\t ", "fr", "b"), (None, rows[3][1], "en", "a"), rows[5], rows[5],
             (103, "word " * 9000, "en", "a"), (104, "x" * 20000, "en", "b"), (105, rows[7][1], "en", "a")]
    return rows


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def joined(ids, pairs):
    """Smallest member of each id's group."""
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in ids}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    from compare import compare, connect
    message, rows = compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name])
    assert not message and rows


def test_empty_tables(spark):
    docs = documents(spark, [])
    for out in (token_counts.token_counts(docs), language_id.identify(docs), packing.pack(docs), simhash.near_duplicates(docs),
                simhash.keep_one(docs), mixing.mix(docs), mixing.mixed_documents(docs), line_dedup.judged_lines(docs),
                line_dedup.without_repeats(docs), suffix_dedup.without_repeats(docs)):
        assert out.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.judge(docs, labels).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(vectors).count() == 0
    assert forest_search.nearest(vectors).count() == 0


def vectors(spark, n=400):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((20, 16))
    v = rng.standard_normal((n, 16))
    near = rng.random(n) < .5
    v[near] = base[rng.integers(0, 20, near.sum())] + .1 * rng.standard_normal((near.sum(), 16))
    rows = [(i, [float(x) for x in v[i]], int(rng.integers(0, 2))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, rows[0][1], None),
             (n + 5, rows[1][1], rows[1][2]), (n + 6, [2 * x for x in rows[1][1]], rows[1][2]), (n + 7, [], 1), (n + 8, [float("inf")] * 16, 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def units(rows):
    ok = {i: np.array(e, float) for i, e, _ in rows if e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    return {i: v / np.linalg.norm(v) for i, v in ok.items()}


def test_embedding_links_are_complete(spark):
    rows, df = vectors(spark)
    v, label = units(rows), {i: x for i, _, x in rows}
    pairs = [(a, b) for a in v for b in v if a < b and label[a] is not None and label[a] == label[b] and v[a] @ v[b] >= .93]
    n = collections.Counter(x for p in pairs for x in p)
    group = joined([r[0] for r in rows], pairs)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, shard=40).collect()}
    assert got == {i: (n[i], group[i], group[i] == i) for i in group} and len(pairs) > 100


def test_embedding_search_ends_or_fails(spark):
    nodes = embedding_dedup.nodes_of(vectors(spark)[1])
    pivots = embedding_dedup.pivots_of(nodes, 40)
    with pytest.raises(RuntimeError, match="further shards"):
        embedding_dedup.searched_links(nodes, pivots, 2, 2, .93, rounds=1)


def test_embedding_audit_sees_lost_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    group = np.eye(64)[0] + .01 * rng.standard_normal((280, 64))
    ends = rng.standard_normal((20, 64))
    v = np.concatenate([group, ends, ends + .01 * rng.standard_normal((20, 64))])
    df = spark.createDataFrame([(i, [float(x) for x in e], 1) for i, e in enumerate(v)], "vec_id long, embedding array<double>, label int")
    lost = [r["node"] for r in embedding_dedup.nodes_of(df).filter("first >= 280").select("node").collect()]
    known = embedding_dedup.searched_links
    assert {r["recall"] for r in embedding_dedup.near_duplicates(df).select("recall").collect()} == {1.0}
    monkeypatch.setattr(embedding_dedup, "searched_links", lambda *a: known(*a).filter(~F.col("node").isin(lost)))
    with pytest.raises(RuntimeError, match="audit"):
        embedding_dedup.near_duplicates(df)


def test_forest_recall(spark):
    rows, df = vectors(spark, 1000)
    v = units(rows)
    got = collections.defaultdict(list)
    for r in forest_search.nearest(df, every=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert abs(r["score"] - v[r["query_id"]] @ v[r["vec_id"]]) < 1e-12
    hits = total = 0
    for q in (i for i in v if i % 10 == 0):
        best = sorted((-(v[q] @ v[x]), x) for x in v if x != q)[:5]
        assert len(got[q]) == 5
        hits += len({x for _, x in best} & {x for x, _ in got[q]})
        total += 5
    assert hits / total >= .9
    few = df.filter("vec_id < 4")
    assert sorted(r["vec_id"] for r in forest_search.nearest(few).collect()) == [1, 2, 3]


def test_forest_ties_repeats_and_clashing_names(spark):
    clash = ["node", "dims", "vec", "tree", "run", "leaf", "block", "query_id", "score", "rank"]
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], *["x"] * len(clash)) for i in range(20)]
    rows += [rows[3], rows[3], rows[10], (None, [1.0, 0.0], *["x"] * len(clash))]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, {', '.join(f'{c} string' for c in clash)}")
    got = collections.defaultdict(list)
    for r in forest_search.nearest(df, every=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {0: [(i, 1.0) for i in (2, 4, 6, 8, 10)], 10: [(i, 1.0) for i in (0, 2, 4, 6, 8)]}


def test_toxicity_finds_marked_words(spark):
    random.seed(1)
    clean = ["".join(random.choices(["th", "er", "on", "an", "re"], k=random.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        words = random.choices(clean, k=random.randint(5, 150))
        bad = i % 3 == 0
        for _ in range(3 if bad else 0):
            words.insert(random.randrange(len(words)), "vile" + random.choice(clean))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "  \n"), rows[0]]
    got = toxicity.judge(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 500]
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) / len(held) > .95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= .5) for r in got)
    assert all(r["score"] == 0 for r in got if r["doc_id"] >= 900)


def test_network_gradient():
    net = toxicity.Network(hidden=3, width=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    gates, mask = rng.standard_normal((5, 2, 2, 9)), np.ones((5, 2), bool)
    mask[3:, 1] = False
    _, cache = net.forward(gates, mask, keep=True)
    g, dgates = net.backward(gates, mask, cache, np.ones(2))

    def loss():
        return net.forward(gates, mask).sum()
    for array, grad in [(gates, dgates), *[(net.p[k], g[k]) for k in ("u", "wa", "ba", "va", "w", "c")]]:
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(6)]:
            old = array[at]
            array[at] = old + 1e-5
            up = loss()
            array[at] = old - 1e-5
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 2e-3 * max(1, abs(grad[at]))


@pytest.mark.parametrize("group", [2048, 3])
def test_suffix_dedup_equals_brute_force(spark, group, monkeypatch):
    random.seed(5)
    base = "".join(random.choice("abcdé \n") for _ in range(2500))
    rows = []
    for d in range(50):
        text = ""
        for _ in range(random.randint(0, 4)):
            a = random.randrange(2000)
            text += random.choice([base[a:a + random.randint(50, 500)], "".join(random.choices("abcd", k=random.randint(10, 300))), "ab" * random.randint(0, 250)])
        rows.append((d, text))
    rows += [(100, None), (101, ""), rows[3], (None, rows[4][1]), (103, base)]
    monkeypatch.setattr(suffix_dedup.repeated_ranges, "__defaults__", (200, group))
    count = collections.Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        count.update(b[i:i + 200] for i in range(len(b) - 199))
    want = collections.Counter()
    for d, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                gone[i + 1:i + 201] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        want[d, len(b), len(b) - len(kept), int((gone[1:] > gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert collections.Counter(map(tuple, suffix_dedup.without_repeats(documents(spark, rows)).collect())) == want


@pytest.mark.parametrize("group", [8, 3])
def test_suffix_dedup_of_one_crowded_passage(spark, group, monkeypatch):
    """One passage in every document, with neighbours of its own or of few kinds: crowded anchors are split, nothing is lost."""
    random.seed(9)
    passage = "".join(random.choices("abcdefghij ", k=260))
    sides = ["".join(random.choices("xyz", k=150)) for _ in range(6)]
    rows = [(d, random.choice([*sides, f"{d:04d}" * 40]) + passage[random.choice([0, 0, 30]):] + random.choice([*sides, f"{d:05d}" * 30])) for d in range(70)]
    rows += [rows[0]] * 3
    monkeypatch.setattr(suffix_dedup.repeated_ranges, "__defaults__", (200, group))
    count = collections.Counter(t[i:i + 200] for _, t in rows for i in range(len(t) - 199))
    want = collections.Counter()
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i:i + 200]] > 1:
                gone[i:i + 200] = True
        want[d, int(gone.sum())] += 1
    got = suffix_dedup.without_repeats(documents(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_removed"]) for r in got) == want


def test_token_counts_equal_a_plain_unigram(spark, odd):
    from tokenizers import Tokenizer, models
    scores = token_counts.read_pieces(token_counts.default_vocabulary())
    trie = token_counts.PrefixTrie(scores)
    plain = Tokenizer(models.Unigram([("<unk>", -100.0), *scores.items()], 0, False))
    words = {w for r in odd for w in (r[1] or "").split(" ") if w.isalpha() and w.isascii() and len(w) < 50}
    for w in words:
        assert trie.insert(w) == len(plain.encode("▁" + w).ids)

    def slow(word):
        text = "▁" + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            found = [(best[end - 1][0] + trie.unknown, -best[end - 1][1] - len(text[end - 1].encode()))]
            found += [(best[s][0] + scores[text[s:end]], -best[s][1] - 1) for s in range(end) if text[s:end] in scores]
            top = max(found)
            best.append((top[0], -top[1]))
        return best[-1][1]
    want = collections.Counter()
    memo = {}
    for r in odd:
        ws = [w.decode() for w in (r[1] or "").encode().split()]
        want[r[0], len(ws), sum(memo.setdefault(w, slow(w) if len(w) < 1000 else trie.insert(w)) for w in ws)] += 1
    assert collections.Counter(map(tuple, token_counts.token_counts(documents(spark, odd)).collect())) == want


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > .97


def test_language_learns_nothing_without_id(spark):
    docs = documents(spark, [(None, "le chat mange la souris", "fr"), (None, "the cat eats the mouse", "en"), (1, "the dog", None)])
    got = language_id.identify(docs).collect()
    assert len(got) == 3 and {r["lang_pred"] for r in got} == {"und"} and not any(r["held_out"] for r in got)


def test_language_is_that_of_the_nearest_centroid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    model = language_id.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    few = docs.limit(60)
    got = {r["doc_id"]: r for r in language_id.predict(few, model).collect()}
    for row in few.collect():
        if not language_id.LETTER.search(row["text"]):
            continue
        v = [math.log1p(n) * w for n, w in zip(language_id.gram_counts(row["text"]).tolist(), model.idf.tolist())]
        size = math.sqrt(sum(x * x for x in v))
        near = [sum(x * y for x, y in zip(v, c)) / size for c in model.centroids.tolist()]
        of = got[row["doc_id"]]
        best = max(x for x, lang in zip(near, model.langs) if lang == of["lang_pred"])
        assert best >= max(near) - 1e-5 and abs(of["score"] - best) < 1e-4


def test_language_odd_texts(spark, odd):
    got = language_id.identify(documents(spark, odd)).collect()
    assert len(got) == len(odd)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (100, 101, 102)} == {"und"}
    assert all(r["lang_pred"] != "und" for r in got if r["doc_id"] in (103, 104))


@pytest.mark.parametrize("hot", [16, 2])
def test_line_dedup_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    random.seed(3)
    base = ["".join(random.choices("abcé ", k=random.randint(18, 60))) for _ in range(20)] + ["x" * 40]

    def changed(s):
        t = list(s)
        for _ in range(random.choice([0, 1, 1, 2])):
            p = random.randrange(len(t))
            t[p:p + random.randint(0, 1)] = random.choice([[], ["a"], ["é"]])
        return "".join(t)
    rows = [(d, "\n".join([changed(random.choice(base[:5] + base[-1:])) for _ in range(random.randint(0, 8))]
                          + random.choice([[], [""], ["  "], ["ab"], ["x" * 39]]))) for d in range(50)]
    rows += [(99, None), (98, ""), rows[3], (None, rows[4][1])]
    lines = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    full = sorted({x for _, _, x in lines if x.strip(" ")})
    pairs = [(a, b) for i, a in enumerate(full) for b in full[:i] if min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) < 2 and edits(a, b) < 2]
    group = joined(full, pairs)
    first = {}
    for d, i, x in lines:
        if x in group:
            place = (d is not None, d or 0, i)
            first[group[x]] = min(first.get(group[x], place), place)
    want = collections.Counter((d, i, x not in group or first[group[x]] == (d is not None, d or 0, i)) for d, i, x in lines)
    docs = documents(spark, rows)
    assert collections.Counter((r["doc_id"], r["line_no"], r["kept"]) for r in line_dedup.judged_lines(docs).collect()) == want
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = collections.defaultdict(set)
    for d, i, k in want:
        if k:
            kept[d].add(i)
    texts = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i in kept[d]) for d, t in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in out.collect())


def test_crowded_lines_within_one_piece(spark):
    random.seed(8)
    pieces = ["12", "21", "31", "13"] + ["".join(p) for p in ("1234", "2345", "3456", "4567", "1243", "2143", "1324", "9345")]
    pieces += ["".join(random.sample("123456789", 4)) for _ in range(60)] + ["".join(random.sample("123456789", 3)) for _ in range(12)]
    head, tail = "abcdefghijklmnopqrst", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmn"       # 64 characters: pieces of four
    full = sorted({head + p + tail for p in pieces})
    group = joined(full, [(a, b) for i, a in enumerate(full) for b in full[:i] if abs(len(a) - len(b)) < 2 and edits(a, b) < 2])
    first = {}
    for i, x in enumerate(full):
        first.setdefault(group[x], i)
    assert len(full) > 4 * line_dedup.HOT and len(first) > 10
    got = {r["doc_id"]: r["class_doc"] for r in line_dedup.judged_lines(documents(spark, list(enumerate(full)))).collect()}
    assert got == {i: first[group[x]] for i, x in enumerate(full)}


def test_band_distance(spark):
    random.seed(2)
    rows = []
    while len(rows) < 400:
        a = "".join(random.choices("ab", k=random.randint(3, 12)))
        b = list(a)
        for _ in range(random.randint(0, 3)):
            p = random.randrange(len(b) + 1)
            b[p:p + random.randint(0, 1)] = random.choice([[], ["a"], ["b"]])
        if 0 <= len(b) - len(a) <= 2:
            rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", *[F.expr(line_dedup.band_distance("split(a, '(?!^)')", "split(b, '(?!^)')", k)).alias(f"d{k}") for k in (1, 2)])
    for r in df.collect():
        true = edits(r["a"], r["b"])
        for k in (1, 2):
            if len(r["b"]) - len(r["a"]) <= k:
                assert (r[f"d{k}"] == true) if true <= k else (r[f"d{k}"] > k)


def test_packing_is_exact_and_tight(spark, odd):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(documents(spark, odd)).collect()
    ids = [(r[0], plain.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in odd]
    want = collections.Counter((d, k, s, min(4096, len(x) - s), zlib.crc32(np.array(x[s:s + 4096], "<u4").tobytes()))
                               for d, x in ids for k, s in enumerate(range(0, len(x), 4096)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(len(x) for _, x in ids) // 4096) + 1


def test_word_ids_equal_the_tokenizer():
    """Capitals whose small form has a mark, combining marks, special tokens and closing marks in all orders."""
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    letters = list("aBzİıIſßẞΣσςéÉñ1²½'.,!?;:()-\"") + ["e\u0301", "\u0307", "i\u0307", "\u0130", "ǅ", "ﬁ", "日", "<|endoftext|>", "'s", "...", "x", "Å", "\u212b", "ᾳ"]
    rng = random.Random(11)
    words = {"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(60000)} | {"KİŞİ.", "DİKKATLİ!"}
    bad = [w for w in words if np.frombuffer(encoder[w], np.uint32).tolist() != plain.encode(w, add_special_tokens=False).ids]
    assert not bad, bad[:20]


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = random.Random(seed)
    counts = collections.Counter(min(4096, max(1, int(rng.lognormvariate(6.5, 1.3)))) for _ in range(5000))
    plan = packing.packing_plan(dict(counts))
    used = collections.Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 4096 and times > 0
        for x in pattern:
            used[x] += times
    assert used == counts
    assert sum(n for _, n in plan) <= -(-sum(k * n for k, n in counts.items()) // 4096) * 1.01 + 1


def test_mix_meets_targets(spark, odd):
    rows = [(i, "w " * (i % 37), "en", f"s{i % 4}" if i % 9 else None) for i in range(600)] + odd
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    size = collections.Counter()
    for _, text, _, source in rows:
        size[source] += len([w for w in (text or "").encode().split()])
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(names, [3, 1, 2] * 9))
    open_, left, target = set(names), 1.5 * sum(size.values()), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit > 2 * size[s]} or open_
        done = full != open_ or any(weight[s] * unit > 2 * size[s] for s in full)
        for s in full:
            target[s] = 2 * size[s] if done else weight[s] * unit
            left -= target[s]
        open_ -= full
    taken = collections.Counter()
    where = mixing.mix(docs).collect()
    by = {s: {r[0] for r in rows if r[3] == s} for s in names}
    assert sorted(map(str, where)) == sorted(map(str, got))
    for r in got:
        matches = [s for s in names if abs(r["target"] - target[s]) < 1e-6 and r["doc_id"] in by[s]]
        assert matches
        taken[matches[0]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").encode().split()) for r in mixed.collect()) == sum(taken.values())


def test_dealt_quotas(spark):
    quotas = {0: 50, 1: 0, 2: 7, 3: 300}
    dealt = mixing.deal(spark.createDataFrame(list(quotas.items()), "source_rank int, quota long"), 8).collect()
    per = collections.Counter()
    for s in quotas:
        mine = sorted((r["shard"], r["first"], r["last"]) for r in dealt if r["source_rank"] == s)
        assert [m[1] for m in mine] == [0, *[m[2] for m in mine[:-1]]] and mine[-1][2] == quotas[s]
        for shard, a, b in mine:
            per[shard] += b - a
    assert max(per.values()) - min(per.values()) <= 3 and sum(per.values()) == 357


def test_simhash_equals_brute_force(spark, odd):
    import xxhash

    def fp(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))
    rows = odd + [(200 + i, " ".join(["the", "of", "and"] * 30 + [f"w{i}"] * (i % 4))) for i in range(40)]
    docs = documents(spark, rows)
    fps = [(r[0], fp(r[1])) for r in rows]
    kinds = sorted({f for _, f in fps})
    group = joined(kinds, [(a, b) for i, a in enumerate(kinds) for b in kinds[:i] if (a ^ b).bit_count() <= 2])
    first = {}
    for d, f in fps:
        if d is not None:
            first[group[f]] = min(d, first.get(group[f], d))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(F.col("fp")).alias("f"), "component_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((d, f"{f:016x}", first[group[f]]) for d, f in fps)
    spread = simhash.close_pairs(spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in kinds], "fp long"), tile=3)
    assert spread.distinct().count() == sum((a ^ b).bit_count() <= 2 for i, a in enumerate(kinds) for b in kinds[:i])


def test_simhash_links_across_the_sign_bit(spark):
    fps = [0, -(1 << 63), -(1 << 63) + 1, 3, -1, (1 << 63) - 1, (1 << 63) - 2, -2]
    got = simhash.close_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    want = {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {frozenset(r) for r in got} == want and len(got) == len(want)


def test_alike_equals_brute_force(spark, odd):
    import xxhash

    def fp(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        wide = []
        for g in grams:
            half = [int.from_bytes(xxhash.xxh3_128_digest(g, 42)[k:k + 8], "little") for k in (0, 8)]
            for x in list(half):
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                half.append(x ^ x >> 31)
            wide.append(sum(x << 64 * k for k, x in enumerate(half)))
        return len(grams), sum(1 << b for b in range(256) if 2 * sum(w >> b & 1 for w in wide) > len(grams))
    random.seed(11)
    base = [f"w{random.randrange(900)}" for _ in range(300)]
    rows = odd + [(200 + i, " ".join(w if random.random() > i / 900 else "new" for w in base[:300 - i])) for i in range(50)]
    docs = documents(spark, rows)
    of = [fp(r[1]) for r in rows]
    kinds = sorted(set(of))
    near = [(a, b) for i, a in enumerate(kinds) for b in kinds[:i] if (a[1] ^ b[1]).bit_count() <= 44 and 5 * min(a[0], b[0]) >= 4 * max(a[0], b[0])
            and a[0] and b[0]]
    group = joined(kinds, near)
    assert 20 < len(near)
    for tile in (4096, 3):
        got = simhash.alike(docs, tile=tile).select("doc_id", "component").collect()
        assert len(got) == len(rows)
        # equal partitions: the multiset of (ids of a group)
        mine, want = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            mine[r["component"]].append(str(r["doc_id"]))
        for r, f in zip(rows, of):
            want[group[f]].append(str(r[0]))
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group.values()))


def test_alike_finds_near_copies_and_leaves_others(spark):
    """At a similarity of 0.85 and more nearly all pairs link; texts that share half of their shingles never do."""
    random.seed(12)
    rows, pairs, apart = [], [], []
    for k in range(200):
        words = [f"x{random.randrange(5000)}" for _ in range(400)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[:200] + ["other"] + words[201:390])), (3 * k + 2, " ".join(words[:270] + words[:130][::-1]))]
        pairs.append((3 * k, 3 * k + 1))
        apart.append((3 * k, 3 * k + 2))
    of = {r["doc_id"]: r["component"] for r in simhash.alike(documents(spark, rows)).collect()}
    assert all(of[a] == of[b] for a, b in pairs)
    assert all(of[a] != of[b] for a, b in apart)


def test_simhash_counts_long_texts_in_slices(monkeypatch):
    random.seed(13)
    texts = [" ".join(random.choices("abcdefgh", k=n)).encode() for n in (3000, 2, 700, 1)] + [b""]
    whole = simhash.wide_fingerprints_of(texts)
    monkeypatch.setattr(simhash, "SLICE", 100)
    cut = simhash.wide_fingerprints_of(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert whole[0].tolist() == [2996, 1, 696, 1, 0] and not whole[1][4].any()


def test_simhash_keeps_different_texts_without_id(spark):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "green", "blue")]
    docs = documents(spark, [(None, t) for t in texts] + [(None, texts[0]), (7, " ".join(f"w{i}" for i in range(40)))])
    kept = simhash.keep_one(docs).collect()
    assert sorted(r["text"] for r in kept) == sorted([*texts, " ".join(f"w{i}" for i in range(40))])


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf_dir)
        if i < 4:
            assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
            after = after.cache()
        if i == 0:
            bad = toxicity.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1").count()
            assert after.count() == docs.count() - bad
        if i == 1:
            assert after.count() == before.count()
        before = after
    texts = before.select("doc_id", "piece").count()
    assert texts > 0
