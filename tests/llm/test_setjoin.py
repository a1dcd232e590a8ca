"""The join by token groups against all pairs, with sizes that make many shards, ranges, groups and blocks."""

import random

import pytest

from tests.llm.cases import BASE, ODD, ODD_IDS, documents, lower, words
from tests.llm.test_free import near_copies
from tidewatch.llm import setjoin

SMALL = setjoin.Sizes(group=7, block=5, shard=900, part=700, least_parts=3, counters=1 << 10)


def brute(ids, texts, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := words(lower(t))) else set() for t in texts]
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (len(sets[i]), least[top(i)]) for i, d in enumerate(ids)}


def joined(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join_documents(df, **kw).collect()}


@pytest.mark.parametrize("sizes", [setjoin.Sizes(), SMALL])
def test_join_equals_all_pairs(spark, sizes):
    rng = random.Random(12)
    texts = near_copies(rng, 70) + [None, "", " ", "One two", "one TWO", BASE, BASE, BASE.upper()]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"x{rng.randrange(900)}" for _ in range(rng.choice([5, 12, 14, 200]))) for _ in range(80)]
    hot = [f"h{i}" for i in range(100)]
    texts += [" ".join(f"y{rng.randrange(99)}" if rng.random() < 0.02 else w for w in hot) for _ in range(60)]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    assert joined(documents(spark, texts, ids).repartition(3), sizes=sizes) == brute(ids, texts)


def test_similarity_at_the_edge(spark):
    one = [f"w{i}" for i in range(94)]
    texts = [" ".join(one[:k]) for k in (94, 80, 76, 75, 62)]  # 90 shingles, and 76, 72, 71, 58 of them
    assert joined(documents(spark, texts)) == brute(range(5), texts)


def test_odd_rows(spark):
    out = setjoin.join_documents(documents(spark, ODD, ODD_IDS)).collect()
    assert len(out) == len(ODD)
    assert {r.component_id for r in out if r.doc_id in (5, 7)} == {5}
    assert setjoin.join_documents(documents(spark, ["x"]).limit(0)).count() == 0
    assert [tuple(r)[2:] for r in setjoin.join_documents(documents(spark, ["a b", None], [None, None])).collect()][0][0] in (0, 1)


def test_the_bound_never_cuts_a_link():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(9)]
        group = setjoin.Group(list(range(9)), list(range(9)), [(1, k) for k in range(9)], sets)
        own = sets[0][rng.random(len(sets[0])) < 0.95]
        if not len(own):
            continue
        want = [k for k, s in enumerate(sets) if (b := len(np.intersect1d(own, s))) and 100 * b >= 80 * (len(own) + len(s) - b)]
        assert group.links(own, 80).tolist() == want
