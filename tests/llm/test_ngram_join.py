"""Components against all pairs, hashing against plain Python, edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cartospark.llm import hashing, ngram_join
from cartospark.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [(i, sets(t)) for i, t in rows]
    root, links = list(range(len(s))), [0] * len(s)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            both = len(s[a][1] & s[b][1])
            if both and 100 * both >= 80 * (len(s[a][1]) + len(s[b][1]) - both):
                root[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for k, (i, x) in enumerate(s):
        if x and i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(x), least.get(find(k), i) if x else i, links[k]) for k, (i, x) in enumerate(s)), key=str)


def corpus(words):
    r, rows = random.Random(5), []
    for g in range(12):
        base = words(g, r.randrange(5, 120))
        rows.append(" ".join(base))
        for _ in range(r.randrange(12)):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(9))
            rows.append((" \n" if r.random() < 0.3 else " ").join(x.upper() if r.random() < 0.1 else x for x in w))
    return [(100 - i, t) for i, t in enumerate(rows)]


def assert_like_brute(df, rows):
    want = brute(rows)
    got = ngram_join.ngram_components(df, links=True).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    got = ngram_join.ngram_components(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((x[:3] for x in want), key=str)


def test_like_all_pairs(docs, words, odd):
    rows = corpus(words) + odd
    assert_like_brute(docs(rows), rows)


def test_hot_shingles_and_many_buckets(docs, words, odd, monkeypatch):
    """Shingles of most texts are dealt over the buckets, and buckets follow the data, with the same links."""
    for k, v in {"HOT": 8, "HOT_SHARE": 0.0, "FLUSH": 2_000, "BUCKET": 500}.items():
        monkeypatch.setattr(ngram_join, k, v)
    common = words(77, 40)
    rows = corpus(words) + odd + [(2000 + i, " ".join(common[: 40 - i % 4] + words(500 + i, i % 12))) for i in range(60)]
    base = ngram_join.cut(ngram_join.shingled(docs(rows)))
    assert base.where("often").count() > 0
    assert_like_brute(docs(rows), rows)


def test_large_group_of_near_copies(docs, words):
    base = words(1, 200)
    rows = [(0, " ".join(base))] + [(i, " ".join(base[: i % 190] + ["x" + str(i)] + base[i % 190 + 1 :])) for i in range(1, 300)] + [(1000 + i, " ".join(base)) for i in range(50)]
    out = ngram_join.ngram_components(docs(rows), links=True).collect()
    assert {r["doc_id"]: r["n_links"] for r in out} == {i: n for i, _, _, n in brute(rows)}
    assert {r["component_id"] for r in out} == {0} and len(out) == 350 and next(r for r in out if r["doc_id"] == 1000)["n_copies"] == 51


def test_empty_table(docs):
    for links in (False, True):
        assert ngram_join.ngram_components(docs([]), links=links).count() == 0


def test_hashes_of_words_and_shingles(words, odd):
    texts = [t for _, t in odd] + [" ".join(words(3, 50)), "a b c d e f", "b c d e f"]
    seen = {}
    for first, data, offsets in hashing.slices(pa.array(texts)):
        h, at, start, end = hashing.words(data, offsets)
        for i in range(len(offsets) - 1):
            t = (texts[first + i] or "").translate(LOWER)
            plain = re.findall(r"[^\x20\x09-\x0D]+", t)
            assert len(plain) == at[i + 1] - at[i]
            for w, x in zip(plain, h[at[i] : at[i + 1]], strict=True):
                assert seen.setdefault(w, int(x)) == int(x)
            assert len(np.unique(hashing.shingles(h[at[i] : at[i + 1]]))) == len(sets(t))
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_components_of_a_path(spark, n):
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "a long, b long")
    got = dict(components(e).collect())
    assert got == {i: 0 for i in range(n + 1 if n else 0)} | {100: 100, 101: 100, 102: 100}


def crowd(words, texts, edits=5, at=0):
    """Near copies of one text, a few words changed in each."""
    r, base = random.Random(9), words(8, 140)
    rows = []
    for i in range(texts):
        w = list(base)
        for _ in range(r.randrange(1, edits)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(900))
        rows.append((at + i, " ".join(w)))
    return rows


def test_pairs_of_a_crowd_are_not_listed(docs, words, monkeypatch):
    """Pairs that are verified one by one grow with the texts of a large group of near copies, not with their square."""
    listed, links = [], ngram_join._links

    def counted(pairs, *more):
        listed.append(pairs.count())
        return links(pairs, *more)

    monkeypatch.setattr(ngram_join, "_links", counted)
    rows = crowd(words, 240)
    got = ngram_join.ngram_components(docs(rows), links=True).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert sum(listed) < 4 * len(rows)


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 16}, {"BLOCKS": 1, "BLOCK_MOST": 50, "WIDE": 7}, {"BLOCK_SHINGLES": 3_000}])
def test_crowds_like_all_pairs(docs, words, odd, monkeypatch, sizes):
    """Several crowds, copies, texts beside them, whatever the blocks."""
    for k, v in ({"CROWD": 8} | sizes).items():
        monkeypatch.setattr(ngram_join, k, v)
    rows = crowd(words, 60, at=3000) + crowd(words, 50, edits=9, at=4000) + corpus(words) + odd
    rows += [(5000 + i, t) for i, (_, t) in enumerate(rows[:90:3])]
    assert_like_brute(docs(rows), rows)


def test_intersections_of_blocks():
    r = np.random.default_rng(3)
    a, b = ([np.sort(r.choice(5_000, r.integers(0, 3_000), replace=False)) for _ in range(n)] for n in (7, 5))
    packed = [(np.array([len(x) for x in s]), np.concatenate(s).astype("<i8")) for s in (a, b)]
    assert ngram_join._common(*packed).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert not ngram_join._common(packed[0], (np.array([0]), np.zeros(0, dtype="<i8"))).any()
