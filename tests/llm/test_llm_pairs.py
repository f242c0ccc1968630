"""Jaccard join, repeated spans and components against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from ledgertide.llm import jaccard_join
from ledgertide.llm import repeated_spans as suffixes
from ledgertide.llm.components import components
from ledgertide.llm.jaccard_join import jaccard_components
from ledgertide.llm.queries import queries
from ledgertide.llm.repeated_spans import repeated_spans
from ledgertide.llm.shingles import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_components_equal_brute_force(odd, odd_rows):
    got = jaccard_components(odd).collect()
    assert len(got) == len(odd_rows)
    want = brute_components(odd_rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert sum(v[1] != k for k, v in want.items()) > 10


def brute_links(rows):
    """Other rows that each row links with, repeated rows each counted."""
    sets = [shingles(t) for _, t in rows]
    return [sum(j != k and bool(b) and 100 * len(a & b) >= 80 * len(a | b) for k, b in enumerate(sets)) for j, a in enumerate(sets)]


def test_links_equal_brute_force(spark, odd, odd_rows, monkeypatch):
    rows = [(i, t) for i, t in odd_rows if i is not None]
    w = [f"w{k}" for k in range(200)]
    rows += [(1000 + k, " ".join(w[:k] + ["x"] + w[k + 1 :])) for k in range(0, 200, 9)]  # near copies: all pairs link, not only a tree of them
    want = sorted(zip((i for i, _ in rows), brute_links(rows), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block, tile in ((1 << 18, 2048), (700, 3)):  # one block a component or tile, and several
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        monkeypatch.setattr(jaccard_join, "TILE", tile)
        got = jaccard_components(docs, links=True).collect()
        assert sorted((r.doc_id, r.n_links) for r in got) == want
        name = {}
        for r in got:  # equal class_id exactly where the sets are equal
            own = shingles(dict(rows)[r.doc_id])
            assert name.setdefault(own, r.class_id) == r.class_id and (r.class_id is None) == (not own)
        assert len(set(name.values())) == len(name)


def test_rows_without_own_ids(spark, odd_rows):
    rng = random.Random(8)
    w = [f"{rng.choice('abc')}{k}" for k in range(120)]
    bridge = [" ".join([f"p{j}" for j in range(k)] + w[k:]) for k in (0, 8, 16)]  # the first and last link with the middle one only
    assert [n for _, n in sorted(zip(range(3), brute_links(list(enumerate(bridge))), strict=True))] == [1, 2, 1]
    copy, clean, lone = (" ".join(f"{c}{k}" for k in range(50)) for c in "xyz")
    rows = [*odd_rows, (901, bridge[0]), (None, bridge[1]), (900, bridge[2]), (910, copy), (911, copy), (911, clean), (911, copy), (911, copy), (None, lone), (None, lone), (None, copy)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), links=True).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == sorted(zip((i for i, _ in rows), brute_links(rows), strict=True), key=str)
    assert {r.component_id for r in got if r.doc_id in (900, 901)} == {900}
    full = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, full, "").collect()]
    groups = brute_components([(k, t) for k, (_, t) in enumerate(rows)])
    least = {}
    for k, (_, top) in groups.items():
        least[top] = min(least.get(top, k), k, key=lambda j: (rows[j][0] is None, rows[j][0] or 0, j))
    assert sorted((i for i, _ in kept), key=str) == sorted((rows[k][0] for k in least.values()), key=str)
    assert (911, clean) in kept and kept.count((None, lone)) == 1 and kept.count((3, "ab")) == 1 and [i for i, t in kept if t == copy] == [910]


def thue_morse(order, letters):
    out = [0]
    for _ in range(order):
        out += [1 - b for b in out]
    return "".join(letters[b] for b in out)


def test_regular_words_do_not_collide(spark):
    """Thue-Morse words are the classic clash of polynomial hashes modulo 2^64."""
    for order in (3, 6, 8, 10, 12):
        rows = [(k, thue_morse(order, pair)) for k, pair in enumerate(("ab", "ba"))]
        data, at = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.array([0, 1 << order, 2 << order])
        assert len(set(word_hashes(data, np.array([0, 1 << order]))[0]) | set(word_hashes(data[1 << order :], np.array([0, 1 << order]))[0])) == 2 and len(shingle_sets(data, at)[0]) == 2
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1)]


def test_prefixes_meet(spark):
    """Any two sets that reach the threshold share a shingle of their prefixes, under any levels."""
    rng = np.random.default_rng(5)
    levels = rng.integers(0, 5, jaccard_join.COUNTERS).astype(np.uint8)
    for _ in range(300):
        both = rng.integers(0, 2**64, int(rng.integers(1, 60)), dtype=np.uint64)
        one, two = (np.unique(np.concatenate((both, rng.integers(0, 2**64, int(rng.integers(0, 9)), dtype=np.uint64)))) for _ in range(2))
        common = len(np.intersect1d(one, two))
        if 100 * common >= 80 * (len(one) + len(two) - common):
            assert len(np.intersect1d(jaccard_join.prefix(one, levels, 80), jaccard_join.prefix(two, levels, 80)))


def test_links_at_the_threshold(spark):
    """Pairs with similarity of exactly 0.8 and just below, at many sizes."""
    rows = []
    for k, (both, own) in enumerate([(4, 1), (8, 2), (40, 10), (39, 10), (400, 100), (399, 100), (796, 199), (795, 200)]):
        shared = [f"s{k}.{j}" for j in range(both + 4)]
        rows += [(10 * k, " ".join(shared + [f"x{k}.{j}" for j in range(own)])), (10 * k + 1, " ".join(shared))]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), links=True).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted(zip((i for i, _ in rows), brute_links(rows), strict=True))
    assert sum(r.n_links for r in got) > 6


def test_query_returns_links(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries()["op2_ngram_jaccard_join"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted(zip((i for i, _ in rows), brute_links(rows), strict=True))


def test_jaccard_of_nothing(nothing):
    assert jaccard_components(nothing).count() == 0
    assert jaccard_components(nothing, links=True).count() == 0


def test_contraction(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 101), (7, 3), (50, 100)]
    out = {r.v: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(out[k] == 1 for k in range(1, 41)) and out[100] == out[101] == out[50] == 50


def brute_spans(rows):
    count, out = Counter(), []
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[p : p + 200] for p in range(len(b) - 199))
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                covered[p : p + 200] = b"\1" * 200
        spans = sum(covered[k] and (k == 0 or not covered[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, y in zip(b, covered, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def spans(docs):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_spans(docs).collect()], key=str)


def test_spans_equal_brute_force(odd, odd_rows, monkeypatch):
    for hot, most in ((4096, 20_000), (4096, 5), (3, 20_000)):  # all sorted, sorted in many rounds, most buckets hot
        monkeypatch.setattr(suffixes, "HOT", hot)
        monkeypatch.setattr(suffixes, "ROUND", most)
        assert spans(odd) == brute_spans(odd_rows)


def test_spans_of_regular_and_shared_texts(spark, monkeypatch):
    rng = random.Random(12)
    junk = lambda n: "".join(rng.choice("abcdefghij \0é") for _ in range(n))
    passage = junk(330)
    rows = [(2 * order + k, thue_morse(order, pair)) for order in (8, 9, 10, 12) for k, pair in enumerate(("ab", "ba"))]
    rows += [(100 + k, junk(rng.randrange(90)) + passage[: rng.randrange(200, 331)] + junk(rng.randrange(90))) for k in range(60)]
    rows += [(200, passage), (201, passage[100:]), (202, "\0" * 199), (203, "\0" * 200), (204, "\0" * 201), (205, passage[:199]), (206, passage * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (4096, 3):
        monkeypatch.setattr(suffixes, "HOT", hot)
        assert spans(docs) == brute_spans(rows)


def test_radix_order():
    rng = np.random.default_rng(3)
    for _ in range(40):
        texts = [bytes(rng.integers(0, 2, int(rng.integers(0, 40))).astype(np.uint8)) for _ in range(30)]
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        bucket = np.sort(rng.integers(0, 4, 30))
        place, shared = suffixes.radix_order(np.frombuffer(b"".join(texts), np.uint8), at[:-1], at[1:], bucket, 20)
        padded = [(b, t.ljust(24, b"\0")[:24]) for b, t in zip(bucket.tolist(), texts, strict=True)]
        laid = [padded[k] for k in np.argsort(place)]
        assert [(b, t[:20]) for b, t in laid] == sorted((b, t[:20]) for b, t in padded)
        for k in range(1, 30):
            both = next((j for j in range(20) if laid[k][1][j] != laid[k - 1][1][j]), 20)
            assert shared[k] == (both if laid[k][0] == laid[k - 1][0] else -1)


def test_spans_of_nothing(nothing):
    assert repeated_spans(nothing).count() == 0
