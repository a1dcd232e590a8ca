"""Collocations against counts in a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import ODD, documents, lower
from tidewatch.llm import phrases

PIECES, WORDS = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def brute(rows, least=10, top=2000, covered=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in PIECES.split(lower(text)):
            w = tuple(WORDS.findall(piece))
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    found = [(lang, p) for (lang, p), c in f.items() if len(p) > 1 and c >= least]
    out = {}
    for lang, p in found:
        a = f[lang, p]
        if len(p) == 2 and any(len(q) == 3 and o == lang and p in (q[:2], q[1:]) and 100 * f[o, q] >= covered * a for o, q in found):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, some in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(some)[:top], 1)
    }


def texts(rng, n, vocabulary):
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! "]
    return ["".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("shard", [50, 2_000_000])
def test_collocations_equal_a_dictionary(spark, shard, monkeypatch):
    rng = random.Random(5)
    some = texts(rng, 150, ["tide", "Tide", "a", "b", "c", "é", "𝒳x", "in"]) + ["hot pair " * 400, "a b c " * 30 + "a b d"] + ODD
    docs = documents(spark, some).repartition(3)
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    saved = phrases._tries
    monkeypatch.setattr(phrases, "_tries", lambda edges: _with_shards(saved, edges, shard))
    got = {tuple(r) for r in phrases.collocations(docs, least=4).collect()}
    assert got == brute(rows, least=4)


def _with_shards(tries, edges, shard):
    def run(batches):
        from tidewatch.llm import phrases as inside

        before, inside.SHARD = inside.SHARD, shard
        try:
            yield from tries(edges)(batches)
        finally:
            inside.SHARD = before

    return run


def test_every_edge_cuts_all_levels_alike():
    rng = np.random.default_rng(3)
    key = rng.integers(1, 9, 400).astype(np.uint64) << np.uint64(60)
    joined = rng.random(400) < 0.8
    joined[-1] = False
    trie = phrases.Trie(key, joined)
    v, word = int(trie.v), [int(x) for x in trie.vocabulary]
    pairs = [(word[int(c) // v], word[int(c) % v]) for c in trie.code2]
    paths = [[(k, 0, 0) for k in word], [(*p, 0) for p in pairs], [(*pairs[int(c) // v], word[int(c) % v]) for c in trie.code3]]
    every = sorted({p for level in paths for p in level} | {(5 << 58, 0, 0), (1 << 60, 3 << 59, 0), (1 << 60, 2 << 60, 3 << 59), ((1 << 64) - 1,) * 3, (1, 2, 3)})
    cuts = trie.cuts(np.array(every, np.uint64))
    for level, cut in zip(paths, cuts, strict=True):
        assert level == sorted(level)
        assert cut.tolist() == [sum(p < e for p in level) for e in every]


def test_products_over_64_bits(spark):
    rows = spark.createDataFrame([(3_000_000_000_000_000, 3_000_000_000_000_001, 3_000_000_000_000_007)], "a bigint, l bigint, r bigint")
    a, left, right = rows.first()
    assert rows.select(phrases._score("a", "l", "r")).first()[0] == 10**6 * a * a // (left * right)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [None, "", " .\n", "one"])).count() == 0


def test_more_than_the_top_are_cut_by_rank(spark):
    some = [f"w{k:04d} v{k:04d}. " * (2 + k % 3) for k in range(300)]
    docs = documents(spark, some)
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert {tuple(r) for r in phrases.collocations(docs, least=2, top=20).collect()} == brute(rows, least=2, top=20)

