"""Nearest neighbours, spelling variants and lexical search against brute force; edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import graphs, impacts, spelling
from tidewatch.llm.common import Scratch

SF = "/root/testdata/sf0.001"
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# Nearest neighbours.


def brute_nearest(rows, queries, k):
    least = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            least[i] = min(least.get(i, v), v)
    out = []
    for q in sorted(set(queries) & set(least)):
        near = sorted((math.dist(v, least[q]), i) for i, v in least.items() if i != q and len(v) == len(least[q]))
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(near[:k], 1)]
    return out


def searched(spark, rows, wanted, k=10, shard=graphs.SHARD):
    """rows: (vec_id, embedding), with more columns, some of the operator's own names."""
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, shard int, size int, label string")
    index, shards = graphs.build_graphs(frame, Scratch(spark, "test"), shard)
    return sorted(tuple(r) for r in graphs.nearest(index, shards, frame.filter(wanted), k).collect())


def test_nearest_finds_what_brute_force_finds(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, "embeddings").collect()]
    exact = brute_nearest(rows, [i for i, _ in rows if i % 100 == 0], 10)
    for shard in (100, graphs.SHARD):
        found = searched(spark, rows, "vec_id % 100 = 0", shard=shard)
        scores = {(q, i): s for q, _, i, s in found}
        assert [(q, r) for q, r, _, _ in found] == [(q, r) for q, r, _, _ in exact]
        hits = [(q, i) for q, _, i, _ in exact if (q, i) in scores]
        assert len(hits) >= 0.97 * len(exact)
        vectors = dict(rows)
        assert all(s == pytest.approx(math.dist(vectors[q], vectors[i]), abs=1e-12) for (q, i), s in scores.items())


def test_nearest_of_copies_and_bad_rows(spark):
    rnd = random.Random(5)
    same = [0.5] * 8
    rows = [(i, same) for i in range(400)] + [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(400, 700)]
    rows += [(None, same), (900, None), (1000, []), (1100, [0.0] * 8), (1200, [1.0, None] * 4), (1300, [float("nan")] * 8), (1400, [float("inf")] * 8)]
    rows += [(1500, [1.0, 2.0]), (1600, [1.0, 2.5]), (1700, [3.0, 2.0]), (0, same), (100, [0.25] * 8)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    exact = brute_nearest(rows, [i for i, _ in rows if i is not None and i % 100 == 0], 10)
    found = searched(spark, rows, "vec_id % 100 = 0", shard=200)
    # Most rows are one vector: ties go to the smaller ids, and short vectors meet each other only.
    assert [r[:2] for r in found] == [r[:2] for r in exact]
    agree = [a[2] == b[2] and a[3] == pytest.approx(b[3], abs=1e-12) for a, b in zip(found, exact)]
    assert sum(agree) >= 0.97 * len(agree)
    assert [r for r in found if r[0] in (0, 200)] == [r for r in exact if r[0] in (0, 200)]
    assert [r[2] for r in found if r[0] == 1500] == [1600, 1700]


def test_nearest_of_few_and_none(spark):
    assert searched(spark, [], "vec_id = 0") == []
    assert searched(spark, [(0, [1.0, 0.0])], "vec_id = 0") == []
    assert [r[2] for r in searched(spark, [(0, [1.0, 0.0]), (2, [0.0, 1.0]), (1, [1.0, 1.0])], "vec_id = 0")] == [1, 2]


# Spelling variants.


def brute_counts(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def found_variants(spark, counts):
    frame = spark.createDataFrame([(w, c, "x") for w, c in counts.items()], "word string, n long, form string")
    return sorted(tuple(r) for r in spelling.variants(frame, Scratch(spark, "test")).collect())


def test_variants_of_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    exact = brute_variants(brute_counts(rows))
    assert sorted(tuple(r) for r in spelling.op12_spelling_variants(spark, SF).collect()) == exact
    assert any(r[1] for r in exact) and any(r[4] > 1 for r in exact)


def test_no_near_pair_is_missed(spark):
    rnd, counts = random.Random(3), {}
    # Few letters, repeated bigrams: what prefixes with positions could miss.
    while len(counts) < 700:
        word = "".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9)))
        counts[word] = rnd.choice([5, 6, 25, 30, 150, 800])
    for word in ("banana" * 30, "banana" * 29 + "banan", "aaaaaaa", "aaaaaa", "aaaaaaaa"):
        counts[word] = rnd.choice([5, 25, 126])
    assert found_variants(spark, counts) == brute_variants(counts)


def test_chains_of_forms(spark):
    counts = {"a" * 6 + "bcdefghi"[:k]: 5 ** (k + 1) for k in range(9)}
    found = found_variants(spark, counts)
    assert found == brute_variants(counts)
    assert found[0][2] == "aaaaaabcdefghi"


def test_word_counts_edges(spark):
    docs = [(1, None), (2, ""), (3, "Árbolés"), (4, "ÁRBOLéS " * 5), (None, "planets " * 5), (5, "x" * 30_000 + " plänets" * 6), (5, "x" * 30_000), (6, "abcādefghi " * 9)]
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.word_counts(frame).collect()} == brute_counts(docs)
    empty = spelling.word_counts(frame.limit(0))
    assert empty.count() == 0
    assert spelling.variants(empty, Scratch(spark, "test")).count() == 0


# Lexical search.


def brute_search(docs, items, k=50):
    words = [(i, Counter(TERMS.findall(lower(t)))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    N, L = len(words), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERMS.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, w in words:
            n = sum(w.values())
            m = 50 + 50 * n * N // L
            s = sum(int(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 20 * m)) for t in terms if w[t])
            if s:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found_documents(spark, docs, items, k=50):
    scratch = Scratch(spark, "test")
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, weight int, items string")
    return sorted((tuple(r) for r in impacts.search(impacts.build_index(d, scratch), q, k, scratch).collect()), key=str)


def test_search_of_all_items(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    items = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    found = sorted((tuple(r) for r in impacts.op13_lexical_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert found == brute_search(docs, items)


def test_search_edges_and_ties(spark, monkeypatch):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["alpha", "Beta", "gamma", "délta", "x1", "\U0001f389", "the"])
    docs = [(i, " ".join(word() for _ in range(rnd.randint(1, 12)))) for i in range(300)]
    docs += [(None, "alpha"), (1, None), (2, ""), (3, " .,;\t"), (7, "alpha beta"), (7, "alpha beta"), (8, "alpha " * 20_000), *((1000 + i, "same text the") for i in range(90))]
    items = [(1, "alpha BETA"), (2, None), (3, "unknown"), (4, "the same"), (4, "délta"), (None, "alpha"), (5, " ".join(f"w{i}" for i in range(50)) + " \U0001f389 x1")]
    exact = brute_search(docs, items)
    assert found_documents(spark, docs, items) == exact
    monkeypatch.setattr(impacts, "ITEMS", 2)
    assert found_documents(spark, docs, items, 7) == brute_search(docs, items, 7)
    assert found_documents(spark, [], items) == []
    assert found_documents(spark, docs, []) == []


def test_bitwise_sums(spark):
    rng = np.random.default_rng(2)
    counts = np.array([1, 7, 8, 9, 300])
    values = rng.integers(0, 1 << impacts.SLICES, counts.sum())
    data, ends = impacts.sliced(values, counts)
    total, width, sums = [], 512, np.zeros(512, np.int64)
    for t, n in enumerate(counts):
        own = data[(0 if t == 0 else ends[t - 1]) : ends[t]].tobytes()
        size = (n + 7) // 8
        slices = [int.from_bytes(own[i : i + size], "little") for i in range(0, len(own), size)]
        mine = values[counts[:t].sum() : counts[: t + 1].sum()]
        places, weight = np.sort(rng.choice(width, n, replace=False)), int(rng.integers(0, 20_000))
        impacts.add(total, impacts.spread(impacts.times(slices, weight), places, width) if weight else [])
        sums[places] += weight * mine
    assert (impacts.numbers(total, np.arange(width), width) == sums).all()
    for k in (1, 10, 500):
        order = np.lexsort((np.arange(width), -sums))[:k]
        assert set(impacts.highest(total, k, width)) == {int(p) for p in order if sums[p] > 0}
