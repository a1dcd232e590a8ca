"""Phrase collocations from count tries.

A task counts the words, pairs and triples of about SHARD tokens in a trie of
depth three: sorted arrays for each level, whose nodes are paths of 64-bit word
keys (a key tells a word of one language). The trie is cut by prefix ranges,
serialised in order and sent to the task of each range, which merges the sorted
runs of all shards. In the merged trie the count of a node's prefixes, the left
parts, are met by walking to it from the root; only prefixes of the first path
of a range, its spine, stand in an earlier range and come from there. Right
parts are suffix links: a pair links to its second word, a triple to the pair
of its last two words, and through this to its last word. A part is at least as
frequent as the phrase, so only frequent nodes leave a range, and none that a
candidate needs is missing.

Range edges are taken from a sample and only set how evenly ranges are filled.
A frequent word or pair is split among ranges like any other stretch of paths.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import hashed
from tidewatch.llm.blobs import numbers, packed, planes, unpacked
from tidewatch.llm.store import written

MIN_COUNT, TOP, COVERED = 10, 2000, 50
#: Tokens to a shard's trie, and bytes of text to a range. A shard sends at most one row to each range.
SHARD, RANGE_BYTES, LEAST_RANGES = 2_000_000, 8 << 20, 16
#: Documents, and paths of each, from which range edges are taken; they bound what the driver sees of the sample.
SAMPLE_DOCS, SAMPLE_PATHS = 20_000, 20
NO_LANG = "und"
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
SPACES = STOPS.copy()
SPACES[[0x20, 0x09]] = True
NODE = "depth int, k1 bigint, k2 bigint, k3 bigint, f bigint, lang string, word string, left1 bigint, left2 bigint"
_LOW32 = np.uint64(0xFFFFFFFF)


class _Tokens:
    """The words of a slice: key, whether the next word is in the same piece, and the bytes and language of each new key."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        raw, off = hashed.utf8(texts)
        self.low = hashed.lowered(raw)
        self.starts, self.ends, rows = hashed.word_spans(raw, off, SPACES)
        lang_raw, lang_off = hashed.utf8(langs.fill_null(NO_LANG))
        self.langs = langs.fill_null(NO_LANG).to_pylist()
        distinct = np.zeros(len(self.langs), np.uint64)
        full = lang_off[1:] > lang_off[:-1]
        distinct[full] = hashed.span_hashes(lang_raw, lang_off[:-1][full], lang_off[1:][full])
        self.row = np.repeat(np.arange(len(self.langs)), np.diff(rows))
        key = hashed.mix(hashed.span_hashes(self.low, self.starts, self.ends) * hashed.BASE + distinct[self.row])
        self.key = np.maximum(key, np.uint64(1))
        stops = np.cumsum(STOPS[raw], dtype=np.int64)[self.starts] if len(raw) else np.zeros(0, np.int64)
        self.joined = np.zeros(len(self.key), bool)
        self.joined[:-1] = (stops[1:] == stops[:-1]) & (self.row[1:] == self.row[:-1])

    def word(self, at: int) -> bytes:
        return self.low[self.starts[at] : self.ends[at]].tobytes()


class Trie:
    """Count trie of depth three of some tokens. Levels are sorted by path; words are ranks in ``vocabulary``."""

    def __init__(self, key: np.ndarray, joined: np.ndarray):
        self.vocabulary, rank, self.count1 = np.unique(key, return_inverse=True, return_counts=True)
        self.v = np.uint64(max(1, len(self.vocabulary)))
        rank = rank.astype(np.uint64)
        two = np.flatnonzero(joined)
        self.code2, pair, self.count2 = np.unique(rank[two] * self.v + rank[two + 1], return_inverse=True, return_counts=True)
        three = joined[two + 1] if len(two) else np.zeros(0, bool)
        self.code3, self.count3 = np.unique(pair[three].astype(np.uint64) * self.v + rank[two[three] + 2], return_counts=True)

    def cuts(self, edges: np.ndarray) -> list[np.ndarray]:
        """For each level, how many nodes stand before each edge (paths of three keys, sorted)."""
        one, two, three = edges[:, 0], edges[:, 1], edges[:, 2]
        word = lambda k: (np.searchsorted(self.vocabulary, k), np.isin(k, self.vocabulary))
        (i1, in1), (i2, in2), (i3, _) = word(one), word(two), word(three)
        i1, i2, i3 = (i.astype(np.uint64) for i in (i1, i2, i3))
        first = i1 + (in1 & ((two > 0) | (three > 0))).astype(np.uint64)
        top = np.where(in1, i1 * self.v + i2, i1 * self.v)
        second = np.searchsorted(self.code2, top + (in1 & in2 & (three > 0)).astype(np.uint64))
        parent = np.searchsorted(self.code2, top).astype(np.uint64)
        here = in1 & in2 & np.isin(top, self.code2)
        third = np.searchsorted(self.code3, parent * self.v + np.where(here, i3, np.uint64(0)))
        return [first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)]

    def pieces(self, edges: np.ndarray, words: dict[int, tuple[bytes, str]]) -> Iterator[tuple[int, bytes]]:
        """(range, serialised nodes) of each range that has nodes; nodes of the first level come with their words."""
        cuts = [np.concatenate([[0], c, [n]]) for c, n in zip(self.cuts(edges), (len(self.vocabulary), len(self.code2), len(self.code3)), strict=True)]
        v = self.v
        for r in range(len(edges) + 1):
            (a1, b1), (a2, b2), (a3, b3) = ((int(c[r]), int(c[r + 1])) for c in cuts)
            if a1 == b1 and a2 == b2 and a3 == b3:
                continue
            one = np.arange(a1, b1, dtype=np.uint64)
            two, three = self.code2[a2:b2], self.code3[a3:b3]
            pair = self.code2[(three // v).astype(np.int64)]
            paths = [one, two // v, two % v, pair // v, pair % v, three % v]
            used, local = np.unique(np.concatenate(paths), return_inverse=True)
            local = np.split(local, np.cumsum([len(p) for p in paths])[:-1])
            keys = self.vocabulary[used.astype(np.int64)]
            own = [words[k] for k in self.vocabulary[a1:b1].tolist()]
            langs = sorted({lang for _, lang in own})
            at = {lang: k for k, lang in enumerate(langs)}
            step = lambda x: np.diff(x, prepend=0)
            yield (
                r,
                packed(
                    keys.astype("<u8").tobytes(), b" ".join(w for w, _ in own), json.dumps(langs).encode(), planes(np.array([at[x] for _, x in own], np.uint32)),
                    planes(step(local[0])), planes(self.count1[a1:b1]), planes(step(local[1])), planes(local[2]), planes(self.count2[a2:b2]),
                    planes(step(local[3])), planes(local[4]), planes(local[5]), planes(self.count3[a3:b3]),
                ),
            )


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some paths of each document, spread evenly over its words."""
    for whole in batches:
        for batch in hashed.slices(whole):
            t = _Tokens(batch.column(0), batch.column(1))
            n = np.bincount(t.row, minlength=batch.num_rows)
            begin = np.cumsum(n) - n
            some = np.flatnonzero(n)
            if not len(some):
                continue
            at = np.unique((begin[some, None] + (np.arange(SAMPLE_PATHS) * n[some, None]) // SAMPLE_PATHS).ravel())
            zero = np.zeros(2, np.uint64)
            key, joined = np.concatenate([t.key, zero]), np.concatenate([t.joined, [False, False]])
            two = np.where(joined[at], key[at + 1], np.uint64(0))
            three = np.where(joined[at] & joined[at + 1], key[at + 2], np.uint64(0))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key[at], two, three)], ["k1", "k2", "k3"])


def range_edges(docs: DataFrame, rows: int, ranges: int) -> np.ndarray:
    """``ranges`` - 1 paths (three keys each) that cut the paths of sampled documents evenly; fewer where these are few."""
    share = min(1.0, SAMPLE_DOCS / max(1, rows))
    some = docs.sample(share, 17) if share < 1 else docs
    found = some.mapInArrow(_sampled, "k1 bigint, k2 bigint, k3 bigint").toPandas()
    paths = np.ascontiguousarray(found.to_numpy(np.int64)).view(np.uint64)
    if not len(paths):
        return np.zeros((0, 3), np.uint64)
    paths = paths[np.lexsort((paths[:, 2], paths[:, 1], paths[:, 0]))]
    picked = paths[(np.arange(1, ranges) * len(paths)) // ranges]
    return np.unique(picked, axis=0) if len(picked) else np.zeros((0, 3), np.uint64)


def _tries(edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        joined: list[np.ndarray] = []
        words: dict[int, tuple[bytes, str]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            trie = Trie(np.concatenate(keys), np.concatenate(joined))
            size, rs, blobs = 0, [], []
            for r, blob in trie.pieces(edges, words):
                rs.append(r)
                blobs.append(blob)
                size += len(blob)
                if size > hashed.SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(rs, pa.int32()), pa.array(blobs, pa.binary())], ["range", "nodes"])
                    size, rs, blobs = 0, [], []
            yield pa.RecordBatch.from_arrays([pa.array(rs, pa.int32()), pa.array(blobs, pa.binary())], ["range", "nodes"])
            keys.clear()
            joined.clear()
            words.clear()

        held = 0
        for whole in batches:
            for batch in hashed.slices(whole):
                t = _Tokens(batch.column(0), batch.column(1))
                own, first = np.unique(t.key, return_index=True)
                for k, at in zip(own.tolist(), first.tolist(), strict=True):
                    if k not in words:
                        words[k] = (t.word(at), t.langs[t.row[at]])
                keys.append(t.key)
                joined.append(t.joined)
                held += len(t.key)
                if held >= SHARD:
                    yield from flushed()
                    held = 0
        if held:
            yield from flushed()

    return run


def _summed(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal codes of sorted runs merged: codes, summed counts, and where each stood first."""
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(code) else np.zeros(0, np.int64)
    total = np.add.reduceat(count[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    return ordered[begin], total, order[begin]


def _found(codes: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each wanted code, and whether it is among the codes."""
    if not len(codes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return values[at], codes[at] == wanted


def merged(blobs: list[bytes], least: int) -> pa.Table:
    """Rows of NODE: the nodes of a range with ``least`` and more, and the number of words of each language (depth 0)."""
    parts = [unpacked(b) for b in blobs]
    known = [np.frombuffer(p[0], "<u8") for p in parts]
    vocabulary = np.unique(np.concatenate(known))
    ranks = [np.searchsorted(vocabulary, k).astype(np.uint64) for k in known]
    level = lambda at: np.concatenate([r[numbers(p[at]).astype(np.int64)] for r, p in zip(ranks, parts, strict=True)])
    walked = lambda at: np.concatenate([r[np.cumsum(numbers(p[at])).astype(np.int64)] for r, p in zip(ranks, parts, strict=True)])
    count = lambda at: np.concatenate([numbers(p[at]) for p in parts])
    wide = np.uint64(32)
    words = [w for p in parts if len(p[4]) for w in p[1].split(b" ")]
    langs = [names[k] for p in parts for names in [json.loads(p[2])] for k in numbers(p[3]).tolist()]
    one, f1, at1 = _summed(walked(4), count(5))
    two, f2, _ = _summed(walked(6) << wide | level(7), count(8))
    pairs, pair = np.unique(walked(9) << wide | level(10), return_inverse=True)
    three, f3, _ = _summed(pair.astype(np.uint64) << wide | level(11), count(12))

    totals: dict[str, int] = {}
    for k, n in zip(at1.tolist(), f1.tolist(), strict=True):
        totals[langs[k]] = totals.get(langs[k], 0) + n
    cols: dict[str, list] = {c: [] for c in ("depth", "k1", "k2", "k3", "f", "lang", "word", "left1", "left2")}
    key = lambda r: vocabulary[r.astype(np.int64)].view(np.int64)

    def add(depth: int, k1, k2, k3, f, first: np.ndarray, lefts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        at, there = _found(one, first, at1)
        none = [None] * len(f)
        cols["depth"] += [depth] * len(f)
        for name, k in (("k1", k1), ("k2", k2), ("k3", k3)):
            cols[name] += none if k is None else k.tolist()
        cols["f"] += f.tolist()
        cols["lang"] += [langs[a] if t else None for a, t in zip(at.tolist(), there.tolist(), strict=True)]
        cols["word"] += [words[a].decode() if t else None for a, t in zip(at.tolist(), there.tolist(), strict=True)]
        for name, (value, has) in zip(("left1", "left2"), lefts, strict=False):
            cols[name] += [v if h else None for v, h in zip(value.tolist(), has.tolist(), strict=True)]
        for name in ("left1", "left2")[len(lefts) :]:
            cols[name] += none

    keep = f1 >= least
    add(1, key(one[keep]), None, None, f1[keep], one[keep], [])
    keep = f2 >= least
    first, second = two[keep] >> wide, two[keep] & _LOW32
    add(2, key(first), key(second), None, f2[keep], first, [_found(one, first, f1)])
    keep = f3 >= least
    prefix, third = pairs[(three[keep] >> wide).astype(np.int64)], three[keep] & _LOW32
    first, second = prefix >> wide, prefix & _LOW32
    add(3, key(first), key(second), key(third), f3[keep], first, [_found(one, first, f1), _found(two, prefix, f2)])
    for lang, n in totals.items():
        for name, value in (("depth", 0), ("f", n), ("lang", lang)):
            cols[name].append(value)
        for name in ("k1", "k2", "k3", "word", "left1", "left2"):
            cols[name].append(None)
    kinds = {"depth": pa.int32(), "lang": pa.string(), "word": pa.string()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in cols.items()})


def _merging(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != now and blobs:
                    yield from merged(blobs, least).to_batches()
                    blobs = []
                now = r
                blobs.append(blob)
        if blobs:
            yield from merged(blobs, least).to_batches()

    return run


def frequent_nodes(docs: DataFrame, least: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows of NODE: every word, pair and triple of a language that occurs ``least`` times and more, and each language's words.

    ``left1`` and ``left2`` are the counts of a node's prefixes of one and two words.
    """
    base = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    size = base.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = max(LEAST_RANGES, math.ceil((size["bytes"] or 0) / RANGE_BYTES))
    edges = range_edges(base, size["rows"], ranges)
    sent = base.mapInArrow(_tries(edges), "range int, nodes binary")
    by_range = sent.repartition(ranges, "range").sortWithinPartitions("range")
    nodes = written(by_range.mapInArrow(_merging(least), NODE), "phrases-nodes")

    # the spines: at most one word and one pair of each range, looked up in the ranges that have their counts
    lost = lambda c, *keys: nodes.filter(F.col(c).isNull() & (F.col("depth") > len(keys))).select(*keys).distinct()
    of = lambda depth, *cols: nodes.filter(F.col("depth") == depth).select(*cols)
    first = lost("left1", "k1").join(of(1, "k1", F.col("f").alias("f1"), F.col("lang").alias("lang1"), F.col("word").alias("word1")), "k1")
    second = lost("left2", "k1", "k2").join(of(2, "k1", "k2", F.col("f").alias("f12")), ["k1", "k2"])
    filled = nodes.join(F.broadcast(written(first, "phrases-spine")), "k1", "left").join(F.broadcast(written(second, "phrases-spine")), ["k1", "k2"], "left")
    return filled.select(
        "depth", "k1", "k2", "k3", "f", F.coalesce("lang", "lang1").alias("lang"), F.coalesce("word", "word1").alias("word"),
        F.when(F.col("depth") > 1, F.coalesce("left1", "f1")).alias("left1"), F.when(F.col("depth") > 2, F.coalesce("left2", "f12")).alias("left2"),
    )


def _score(a: str, left: str, right: str) -> F.Column:
    """floor(1000000 * a * a / (left * right)), exact for counts up to 10^16."""
    d = lambda c: f"cast({c} as decimal(16,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * ({d(a)} * {d(a)})) div ({d(left)} * {d(right)})")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, covered: int = COVERED, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each language.

    Candidates occur ``least`` times and more; the cut with the lowest score counts (ties: the shorter first part). A pair
    goes if a triple holds it that is at least ``covered`` hundredths as frequent. Ranked by score and frequency,
    descending, then by phrase in byte order. Null texts have no words, a null language is "und"; rows count each for
    itself, with repeated or null ids too; other columns are ignored. No rows without candidates.
    """
    nodes = written(frequent_nodes(docs, least, lang_col, text_col), "phrases-filled")
    words = nodes.filter("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    link = nodes.filter("depth = 1").select(F.col("k1").alias("k2"), F.col("word").alias("word2"), F.col("f").alias("right1"))
    pairs = written(nodes.filter("depth = 2").select("k1", "k2", "f", "lang", "word", "left1").join(link, "k2"), "phrases-pairs")
    link = pairs.select(
        F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.concat_ws(" ", "word", "word2").alias("rest"), F.col("f").alias("right2"), F.col("right1").alias("right1"),
    )
    triples = written(nodes.filter("depth = 3").select("k1", "k2", "k3", "f", "lang", "word", "left1", "left2").join(link, ["k2", "k3"]), "phrases-triples")

    inside = triples.select("k1", "k2", "f").union(triples.select("k2", "k3", "f")).groupBy("k1", "k2").agg(F.max("f").alias("within"))
    alone = pairs.join(inside, ["k1", "k2"], "left").filter(F.col("within").isNull() | (100 * F.col("within") < covered * F.col("f")))
    two = alone.select("lang", F.concat_ws(" ", "word", "word2").alias("phrase"), F.col("f").alias("a"), F.col("left1").alias("l"), F.col("right1").alias("r"))
    cut = lambda left, right: F.struct(_score("f", left, right).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))
    both = triples.withColumn("c1", cut("left1", "right2")).withColumn("c2", cut("left2", "right1"))
    best = F.when(F.col("c2.score") < F.col("c1.score"), F.col("c2")).otherwise(F.col("c1"))
    three = both.select("lang", F.concat_ws(" ", "word", "rest").alias("phrase"), F.col("f").alias("a"), best.alias("c"))
    every = two.withColumn("score", _score("a", "l", "r")).unionByName(three.select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    ranked = every.selectExpr("*", "row_number() over (partition by lang order by score desc, a desc, phrase) as rank").filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
