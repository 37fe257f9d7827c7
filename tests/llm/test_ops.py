"""Each operator against brute force, a round trip, or a held-out accuracy; edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, fuzzy, langid, linking, media, minhash, mixing, paragraphs, rollup, shingles, tokenfiles, urls
from tidewatch.llm.common import Scratch, strings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "one"), (None, "one"), (5, " \t\n"), (6, "word " * 30_000), (7, "é ü\U0001f389 \x00")]


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def docs(spark, pairs):
    """Rows with extra columns, some of whose names the operators use themselves."""
    rows = [(i, t, "en", "s1", 0, 1, "x") for i, t in pairs]
    return spark.createDataFrame(rows, DOCS + ", component int, set_hash string")


def brute_sets(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    return sets


def brute_components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def near_copies(seed):
    rnd, out = random.Random(seed), []
    for g in range(12):
        base = words(rnd, rnd.randint(3, 160)).split(" ")
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rnd.randrange(len(copy))] = words(rnd, 1)
            out.append(" ".join(copy))
    rnd.shuffle(out)
    return list(enumerate(out))


def test_minhash_equals_all_pairs(spark):
    rows = near_copies(1)
    found = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    sets = brute_sets(rows)
    assert {i: r.component_id for i, r in found.items()} == brute_components(sets, 85)
    assert all(found[i].n_shingles == len(s) and found[i].kept == (i == found[i].component_id) for i, s in sets.items())


def test_minhash_edges(spark):
    out = minhash.near_duplicates(docs(spark, EDGE)).collect()
    assert len(out) == len(EDGE)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[5] == (0, 5, True)
    assert got[3] == (1, 3, True) and got[4] == (1, 3, False) and got[None] == (1, None, True) and got[6][0] == 1
    assert minhash.near_duplicates(docs(spark, [(1, "a")]).limit(0)).collect() == []


def test_bayes_bound():
    assert minhash.posterior(72, 144, 0.85) < 1e-6 < minhash.posterior(122, 144, 0.85)
    a = np.tile(np.arange(144, dtype=np.uint32), (2, 1))
    b = a.copy()
    b[1, ::2] += 1
    assert minhash.surviving(a, b, 85).tolist() == [0]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "a long, b long")
    got = {r.node: r.component for r in linking.components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


def test_shingles_of_short_and_split_batches():
    flat, offsets = shingles.shingle_sets([b"a b c d e f", b"", b"a b", b"A B"])
    assert np.diff(offsets).tolist() == [2, 0, 1, 1] and flat[offsets[2]] == flat[offsets[3]]
    assert sum(len(p) for p in shingles.batched(["x" * 10, None, "y" * 2000], 100)) == 3


def test_rollup_equals_recount_and_commits_once(spark):
    kept = Scratch(spark, "rollup-test")
    store = rollup.TokenRollup(spark, f"{kept.base}/t")
    assert store.totals().collect() == []
    a = spark.createDataFrame([("a", "en", "v", 5, 1, 9), ("a", "en", "v", 7, 1, 9), (None, "en", "v", 1, 1, 9)], "source string, lang string, version string, tokens long, sign int, documents int")
    assert store.commit("1", a) and not store.commit("1", a)
    assert store.commit("2", a.filter("tokens = 7").withColumn("sign", F.lit(-1)))
    want = {("a", 1, 5), (None, 1, 1)}
    assert {(r.source, r.documents, r.tokens) for r in store.totals().collect()} == want
    store.compact()
    assert not store.commit("2", a) and {(r.source, r.documents, r.tokens) for r in store.totals().collect()} == want
    assert store.commit("3", a.limit(0)) and store.totals().count() == 2


def test_mixing_meets_targets(spark):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.randint(0, 60), "en", rnd.choice(["a", "b", "b", "c", "d", None]), 0) for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(t.split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight, goal, free, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()), set(names), {}
    while True:
        share = {s: goal * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s], goal = 2 * size[s], goal - 2 * size[s]
            free.discard(s)
    by = {i: s for i, _, _, s, _ in rows}
    taken = {s: sum(r.taken for r in got if by[r.doc_id] == s) for s in names}
    for r in got:
        assert abs(r.target - target[by[r.doc_id]]) < 1e-6 and r.source_size == size[by[r.doc_id]] and r.taken <= 2 * r.size and 0 <= r.rate <= 2
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] + 3 for s in names)
    again = mixing.mix_sources(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def taken_of(spark, rows):
    """Words taken of each source, and its target; rows: (doc_id, words, source)."""
    got = mixing.mix_sources(spark.createDataFrame([(i, "w " * n, "en", s, 0) for i, n, s in rows], DOCS)).collect()
    by, out = {i: s for i, _, s in rows}, {}
    for r in got:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken, _ = out.get(by[r.doc_id], (0, 0))
        out[by[r.doc_id]] = taken + r.taken, r.target
    return out


def test_mixing_of_repeated_rows(spark):
    rnd = random.Random(21)
    for fixed in (3, 40):
        rows = [(7, fixed, "a")] * 500 + [(i, rnd.randint(3, 300), "a") for i in range(100, 335)] + [(i, rnd.randint(3, 60), "b") for i in range(1000, 1400)]
        for taken, target in taken_of(spark, rows).values():
            assert abs(taken - target) <= 1.5


def test_mixing_takes_the_nearer_side(spark):
    rows = [(i, 3000, "a") for i in range(5)] + [(10 + i, 3000, "b") for i in range(4)] + [(20 + i, 1000, "c") for i in range(4)]
    for taken, target in taken_of(spark, rows).values():
        assert abs(taken - target) <= 1500


def test_mixing_edges(spark):
    assert mixing.mix_sources(docs(spark, EDGE)).count() == len(EDGE)
    assert mixing.mix_sources(docs(spark, EDGE).limit(0)).collect() == []


def test_fingerprints_and_successors(spark):
    rnd = random.Random(2)
    rows = [(i * 7, words(rnd, rnd.randint(0, 400))) for i in range(60)]
    got = {r.doc_id: r for r in fuzzy.document_fingerprints(docs(spark, rows), tasks=5).collect()}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        other = t[: len(t) - q] + nxt[:q]
        f, g = fuzzy.fingerprint(t.encode()), fuzzy.fingerprint(other.encode())
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (f, g)
        assert got[i].near_edited == fuzzy.likeness(f, g) and got[i].near_next == fuzzy.likeness(f, fuzzy.fingerprint(nxt.encode()))
    edge = fuzzy.document_fingerprints(docs(spark, EDGE)).collect()
    assert len(edge) == len(EDGE)
    assert [(r.n_chars, r.fingerprint, r.edited_sha256, r.edited_fingerprint, r.near_edited, r.near_next) for r in edge if r.doc_id is None] == [(3, fuzzy.fingerprint(b"one"), None, None, None, None)]
    assert fuzzy.document_fingerprints(docs(spark, EDGE).limit(0)).collect() == []


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 64))) for _ in range(2))
        assert fuzzy.edit_distance(a, b) == plain(a, b)


def test_url_rules_and_edges(spark):
    rows = [(1, None), (2, ""), (3, "HTTP://Ex.COM/en/x?y"), (4, "a://b://c/d#e"), (5, "x"), (6, "http://example.com?en/"), (7, "http://notexample.com/en/7"), (8, "http://a.example.com/en/77#z"), (9, "https://m.example.net/de/8"), (9, "https://m.example.net/de/8"), (10, "https://q.net/de/8"), (11, "http://x.org/es/")]
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in rows], "page_id long, url string, host string, score double")
    out = urls.filter_urls(pages).collect()
    got = {r.page_id: (r.host, r.path, r.rule) for r in out}
    assert got == {1: ("", "", None), 2: ("", "", None), 3: ("ex.com", "/en/x", "com/en/"), 4: ("b:", "//c/d", None), 5: ("", "", None), 6: ("example.com", "", None), 7: ("notexample.com", "/en/7", "com/en/"), 8: ("a.example.com", "/en/77", "example.com/en/7"), 9: ("m.example.net", "/de/8", "example.net/de/8"), 10: ("q.net", "/de/8", "net/de/"), 11: ("x.org", "/es/", "org/es/")}
    verdicts = {r.page_id: r.verdict for r in out}
    assert [verdicts[i] for i in (3, 8, 9, 10, 11)] == ["block", "allow", "block", "allow", "block"] and len(out) == len(rows)
    assert urls.filter_urls(pages.limit(0)).collect() == []


def test_url_model_tells_unseen_hosts_apart(spark):
    rnd = random.Random(4)
    good = [f"https://{words(rnd, 1)}.net/de/{rnd.randint(0, 9999)}" for _ in range(400)]
    bad = [f"https://{words(rnd, 1)}.org/es/{rnd.randint(0, 9999)}?x=1" for _ in range(400)]
    tests = [f"https://{words(rnd, 1)}.info/de/{rnd.randint(0, 9999)}" for _ in range(50)] + [f"https://{words(rnd, 1)}.info/es/{rnd.randint(0, 9999)}?x=1" for _ in range(50)]
    pages = spark.createDataFrame(list(enumerate(good + bad + tests)), "page_id long, url string")
    out = {r.page_id: r.verdict for r in urls.filter_urls(pages).collect()}
    assert sum(out[800 + i] == ("allow" if i < 50 else "block") for i in range(100)) >= 95


def test_language_id(spark):
    rnd = random.Random(9)
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "éèüñàçöô"}
    rows = [(i, " ".join("".join(rnd.choice(letters[k]) for _ in range(5)) for _ in range(rnd.randint(3, 40))), k, "s", 0) for i, k in enumerate(rnd.choice(list(letters)) for _ in range(600))]
    table = spark.createDataFrame(rows, DOCS).withColumn("lang", F.when(F.col("doc_id") % 9 != 0, F.col("lang")))
    model = langid.trained(table)
    out = {r.doc_id: r for r in langid.identify(table, model).collect()}
    held = [(i, k) for i, _, k, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].lang_pred == k for i, k in held) >= 0.98 * len(held)
    edge = langid.identify(docs(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and {r.doc_id: r.lang_pred for r in edge}[1] == "und" and {r.doc_id: r.rejected for r in edge}[5]
    assert all(0 <= r.score <= 1 for r in [*edge, *out.values()])
    assert langid.identify(docs(spark, EDGE).limit(0), model).collect() == []
    none = langid.trained(table.limit(0))
    assert {r.lang_pred for r in langid.identify(docs(spark, EDGE), none).collect()} == {"und"}


ODD = ["", "  a b", "İstanbul ΣΑΣ Ⅷ ½ don't DON'T it's", "e\u0301a x\u0301", "<|endoftext|>hi <|startoftext|> <|x|>", "a\x1cb\x1d c", "日本語 テスト 🎉🎉", "a\r\nb\tc", "123 4567", "'s's 'S", "a\n\n\nb", "a  b   c", " x ", "x \n"]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    library, own = Tokenizer.from_file(path), bpe.word_bpe(path)
    for t in ODD + [words(random.Random(0), 300)]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.encode(None) == []


def test_bpe_equals_the_library_on_all_of_unicode():
    from tokenizers import Tokenizer

    path, rnd = bpe.tokenizer_path(), random.Random(4)
    library, own = Tokenizer.from_file(path), bpe.word_bpe(path)
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}1{c} x\u0301{c}" for c in points]
    texts += ["".join(rnd.choice([rnd.choice(points), rnd.choice("ab 1'\n\u0301\u0323<|>")]) for _ in range(rnd.randint(1, 14))) for _ in range(10_000)]
    texts += ["".join(rnd.choice(points[1:0x300]) for _ in range(rnd.randint(1, 10))) for _ in range(20_000)]
    for i in range(0, len(texts), 5000):
        part = texts[i : i + 5000]
        assert [t for t, e in zip(part, library.encode_batch(part, add_special_tokens=False)) if own.encode(t) != e.ids] == []


def test_bpe_frames(spark):
    rows = bpe.bpe_digests(docs(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) and {r.doc_id: r.n_tokens for r in rows}[1] == 0
    for r in bpe.bpe_round_trip(docs(spark, EDGE)).collect():
        assert r.n_tokens == len(r.ids)
    assert sorted(map(str, bpe.bpe_digests(docs(spark, EDGE), forget=True).collect())) == sorted(map(str, rows))
    assert bpe.bpe_digests(docs(spark, EDGE).limit(0)).collect() == []


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenfiles.tokenizer_path())
    rows = [(i * 3, t) for i, t in enumerate([None, *ODD, words(random.Random(1), 3000)])]
    kept = Scratch(spark, "files-test")
    tokenfiles.write_token_files(docs(spark, rows), kept.base)
    got = {r.doc_id: r for r in tokenfiles.document_digests(tokenfiles.read_token_files(spark, kept.base)).collect()}
    at = 0
    for i, t in rows:
        ids = [*(library.encode(t, add_special_tokens=False).ids if t else []), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_segments_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.04, rng.integers(0, 2**32 - 1, n), rng.integers(0, 50_000, n)).astype(np.uint32)
    raw = tokenfiles.write_segment([4, -9], [n // 3, n - n // 3], ids)
    doc_ids, lengths, back = tokenfiles.read_segment(raw)
    assert (back == ids).all() and doc_ids.tolist() == [4, -9] and lengths.sum() == n
    if n >= 256:
        assert (tokenfiles.read_block(raw, 1) == ids[128:256]).all()
    with pytest.raises(ValueError):
        tokenfiles.read_segment(b"none" + raw[4:])


def test_media_round_trip(spark):
    for n in (1, 15, 16, 17, 300):
        payload = random.Random(n).randbytes(n * media.FRAME)
        data = media.mux(payload)
        track = media.probe(data)[0]
        assert media.demux(data) == payload and track["codec"] == "raw " and track["duration"] == n and len(track["keyframes"]) == -(-n // media.KEY_EVERY)
        at, size = track["keyframes"][-1]
        assert data[at : at + size] == payload[(len(track["keyframes"]) - 1) * media.KEY_EVERY * media.FRAME :][: media.FRAME]
    with pytest.raises(ValueError):
        media.probe(data[:-10])
    out = media.add_media(docs(spark, EDGE)).collect()
    assert len(out) == len(EDGE)
    for r, (_, t) in zip(out, EDGE):
        raw = (t or "").encode()
        pay = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
    assert media.add_media(docs(spark, EDGE).limit(0)).collect() == []


def test_substring_dedup_catches_passages_and_leaves_clean_texts(spark):
    rnd, rows, passages = random.Random(1), [], []
    for k in range(30):
        passages.append(words(rnd, (51, 60, 80)[k % 3]))
        rows += [(k * 3 + j, f"{words(rnd, 120)} {passages[k]} {words(rnd, 90)}") for j in range(3)]
    clean = [(1000 + k, "common header line of exactly twelve words for all of them here\n" + words(rnd, 200)) for k in range(30)]
    out = {r.doc_id: r for r in paragraphs.substring_dedup(docs(spark, rows + clean)).collect()}
    assert all(out[i].text == t and not out[i].removed_words for i, t in clean)
    for k, p in enumerate(passages):
        assert out[3 * k].text == dict(rows)[3 * k]
        for j in (1, 2):
            r = out[3 * k + j]
            assert r.removed_words >= 16 and p not in r.text and r.first_docs == [3 * k]


def test_substring_dedup_edges(spark):
    out = paragraphs.substring_dedup(docs(spark, EDGE)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out if r.text) == sorted((str(i), t) for i, t in EDGE if t)
    assert paragraphs.substring_dedup(docs(spark, EDGE).limit(0)).collect() == []


def test_substring_dedup_keeps_every_first_place(spark):
    rnd, rows = random.Random(11), []
    for k in range(12):
        a, b, changed = words(rnd, 60), words(rnd, 60), words(rnd, 5)
        rows += [(10 * k + j, f"{a} {words(rnd, 5) if j in (0, 4) else changed} {b}") for j in range(5)]
    out = {r.doc_id: r for r in paragraphs.substring_dedup(docs(spark, rows)).collect()}
    own, first, end, _, values, offsets = paragraphs.cut([t.encode() for _, t in rows])
    removed = [any(s.start <= first[k] and end[k] <= s.end for s in out[rows[i][0]].spans or []) for k, i in enumerate(own)]
    roots = brute_components({k: frozenset(values[offsets[k] : offsets[k + 1]].tolist()) for k in range(len(own))}, 80)
    # Whatever is removed is a paragraph whose component starts in an earlier document, and stays there.
    assert all(own[roots[k]] < own[k] and not removed[roots[k]] for k in range(len(own)) if removed[k])
    for r in out.values():
        raw = dict(rows)[r.doc_id].encode()
        assert r.removed_words == sum(len(raw[s.start : s.end].split()) for s in r.spans or [])
    assert sum(r.removed_words for r in out.values()) >= 12 * 4 * 80


def test_paragraphs_depend_on_their_text_alone():
    rnd = random.Random(12)
    raws = [words(rnd, rnd.randint(0, 40)).encode() for _ in range(300)] + [b"", b"a", b"a b", b"a b " * 30, b"a " * 30]

    def cuts(batch):
        own, first, end, n, values, offsets = paragraphs.cut(batch)
        return [[(first[k], end[k], n[k], values[offsets[k] : offsets[k + 1]].tolist()) for k in np.flatnonzero(own == i)] for i in range(len(batch))]

    alone = [cuts([r])[0] for r in raws]
    assert cuts(raws) == alone and cuts(raws[::-1]) == alone[::-1]


def test_substring_dedup_removes_exact_copies_in_full(spark):
    rnd = random.Random(13)
    rows = [(k, words(rnd, (20, 25, 30, 40)[k % 4])) for k in range(60)]
    copies = [(1000 + k, t) for k, t in rows]
    mixed = [r for k in range(60) for r in (copies[k], (2000 + k, words(rnd, 30)))]
    out = {r.doc_id: r for r in paragraphs.substring_dedup(docs(spark, rows + mixed)).collect()}
    assert all(not out[i].text and out[i].removed_words == len(t.split()) for i, t in copies)
    assert all(out[i].text == t for i, t in rows)


def test_paragraph_bands_miss_no_similar_pair():
    rng, values, offsets = np.random.default_rng(14), [], [0]
    for _ in range(4000):
        n = int(rng.integers(1, 60))
        base = rng.integers(0, 2**63, n, np.uint64)
        lost = int(rng.integers(0, n // 4 + 1))
        other = np.concatenate([base[lost:], rng.integers(0, 2**63, int(rng.integers(0, lost + 1)), np.uint64)])
        for s in (base, other if len(other) else base):
            values.append(np.unique(s))
            offsets.append(offsets[-1] + len(values[-1]))
    keys, ends = paragraphs.least_keys(np.concatenate(values), np.array(offsets), 80)
    similar = unequal = 0
    for k in range(0, len(values), 2):
        shared, union = shingles.jaccard_counts(values[k], values[k + 1])
        if 100 * shared >= 80 * union:
            similar += 1
            # Equal sets are one class, whose members needn't share a key.
            same = np.array_equal(values[k], values[k + 1])
            if same:
                both = paragraphs.set_ids(np.concatenate(values[k : k + 2]), np.array([0, len(values[k]), 2 * len(values[k])]))
                assert all(x[0] == x[1] for x in both)
            else:
                unequal += 1
                assert set(keys[ends[k] : ends[k + 1]]) & set(keys[ends[k + 1] : ends[k + 2]])
    assert similar > 1000 and unequal > 1000 and len(paragraphs.least_keys(np.zeros(0, np.uint64), np.zeros(3, np.int64), 80)[0]) == 0


def test_url_scores_equal_a_model_of_all_contexts(spark):
    rnd, weight = random.Random(16), urls.WEIGHT
    texts = [(f"https://{words(rnd, 2).replace(' ', '.')}.{k}/{words(rnd, 3).replace(' ', '/')}", k) for k in ("allow", "block") for _ in range(400)]
    assert len({t[j - 4 : j] for t, _ in texts for j in range(4, len(t))}) > 8192
    frame = spark.createDataFrame(texts, "url string, rule_verdict string")
    counts = {}

    def contexts(t, j):
        return [(["^"] * 4 + list(t))[j + 4 - k : j + 4] for k in range(5)]

    for t, kind in texts:
        for j, c in enumerate(t):
            for x in map(tuple, contexts(t, j)):
                for key in ((kind, x, c), (kind, x)):
                    counts[key] = counts.get(key, 0) + 1
    got = {r.url: r.score for r in urls.scored(frame, frame, Scratch(spark, "urls-test")).collect()}
    for t, _ in texts[::20]:
        total = 0.0
        for j, c in enumerate(t):
            for kind, sign in (("allow", 1), ("block", -1)):
                p = 1 / urls.SYMBOLS
                for x in map(tuple, contexts(t, j)):
                    p = (counts.get((kind, x, c), 0) + weight * p) / (counts.get((kind, x), 0) + weight)
                total += sign * float(np.log(p))
        assert abs(got[t] - total / len(t)) < 1e-7


def test_language_id_rejects_what_it_never_learned():
    rnd = random.Random(17)

    def text(letters, n=40):
        return " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(n))

    kinds = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}
    rows = [(text(kinds[k]), k) for k in (rnd.choice(list(kinds)) for _ in range(1000))]
    model = langid.train([(k, *c) for (_, k), c in zip(rows[:600], langid.counted([t for t, _ in rows[:600]]))])
    clean = model.predict([t for t, _ in rows[600:]])[2]
    unseen = model.predict([text("абвгдежз") for _ in range(100)])[2]
    junk = model.predict([text("abcdefghijklmnopqrstuvwx") for _ in range(100)])[2]
    assert clean.mean() <= 0.01 and unseen.mean() >= 0.95 and junk.mean() >= 0.95


def test_token_files_edges(spark):
    kept = Scratch(spark, "files-edges")
    tokenfiles.write_token_files(docs(spark, EDGE), f"{kept.base}/a")
    got = tokenfiles.document_digests(tokenfiles.read_token_files(spark, f"{kept.base}/a")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in EDGE)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert min(got, key=lambda r: r.start).doc_id is None and {r.doc_id: r.n_tokens for r in got}[1] == 1
    tokenfiles.write_token_files(docs(spark, EDGE).limit(0), f"{kept.base}/b")
    assert tokenfiles.document_digests(tokenfiles.read_token_files(spark, f"{kept.base}/b")).collect() == []


def test_passages_are_cut_out_without_a_python_worker(spark):
    rnd = random.Random(21)
    passage = words(rnd, 80)
    rows = [(1, f"{words(rnd, 50)} {passage}"), (2, f"été  {words(rnd, 40)}\n{passage}\n  日本 {words(rnd, 40)} {passage}"), (3, None), (4, "")]
    out = paragraphs.substring_dedup(docs(spark, rows))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in (1, 3, 4)] == [rows[0][1], None, ""]
    raw, parts, at = rows[1][1].encode(), [], 0
    for s in got[2].spans:
        parts.append(raw[at : s.start])
        at = s.end
    parts.append(raw[at:])
    assert len(parts) == 3
    joined = b"".join(p if not k else p.lstrip(b" ") if parts[k - 1][-1:] in (b" ", b"\n", b"") else p for k, p in enumerate(parts))
    assert got[2].text == joined.decode() and got[2].removed_words >= 120


def test_few_texts_of_a_batch_are_python_strings_at_once():
    column = pa.array([f"text {k}" if k % 7 else None for k in range(1000)])
    taken = []

    class Seen:
        def __len__(self):
            return len(column)

        def slice(self, at, n):
            taken.append(n)
            return column.slice(at, n)

    assert list(strings(Seen())) == column.to_pylist() and max(taken) <= 64


def test_new_pieces_go_to_the_library_together(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenfiles.tokenizer_path()
    library, made = Tokenizer.from_file(path), tokenfiles.Encoder(path)
    rnd, calls, ids = random.Random(22), [], made._ids
    odd = [f"{rnd.randint(0, 10**9)}{rnd.choice(['', ',', '.', '!?', 'x.', 'é,'])}" for _ in range(3000)]
    texts = [" ".join(odd), "\n".join(odd[:500]), *ODD, None, " a", "a ", "a,,b.", "don't, it's.", "x\n\ny", "\n", "é, à.\nñ,", "Straße. ﬁ, ǆ."]
    monkeypatch.setattr(made, "_ids", lambda t: calls.append(t) or ids(t))
    for _ in range(2):
        got = made.encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert len(calls) < 200


def test_segments_of_many_exceptions_round_trip():
    rng = np.random.default_rng(23)
    ids = np.where(rng.random(128 * 40) < 0.09, rng.integers(0, 2**32 - 1, 128 * 40), rng.integers(0, 300, 128 * 40)).astype(np.uint32)
    raw = tokenfiles.write_segment([1], [len(ids)], ids)
    assert (tokenfiles.read_segment(raw)[2] == ids).all()
    assert all((tokenfiles.read_block(raw, b) == ids[128 * b : 128 * (b + 1)]).all() for b in range(40))
