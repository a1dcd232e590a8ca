"""Toxicity by the nearest labelled examples.

Documents and examples are TF-IDF vectors over all their terms, words and the
beginnings of words, with document frequencies over all documents. A factor of
how a term goes with the label weighs it (``least_factor=1`` gives plain
TF-IDF); no term is left out. The nearest examples are exact. They are found by
a block-max inverted index: alike examples stand in one block, the postings of
rare terms are added up, frequent terms have a largest weight for each block,
and a block is looked into only if its bound reaches the cosine of the last
neighbour so far. Terms that no example has change a document's length only:
this is summed by a join of these terms with their frequencies. The nearest
examples' votes, weighted by cosine and held against the general rate, are
calibrated on votes that the examples get from each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import hashed
from tidewatch.llm.store import written

#: Labelled examples at most: the classifier's bounded sample.
EXAMPLES = 6_000
NEIGHBOURS, CALIBRATED = 15, 3_000
#: Texts that are ordered by their best block, and of these the alike ones that look into the same blocks.
TOGETHER, ALIKE = 512, 64
PREFIXES = (4, 6)
#: Weight of the general rate among the votes, as the squared cosine of one neighbour.
PRIOR_WEIGHT = 0.25
#: A term's factor without any association with the label, and the association (G2) that takes it halfway to one.
LEAST_FACTOR, HALF_G2 = 0.25, 12.0
#: Terms in a larger share of the examples have block maxima; of the others all postings are read.
FREQUENT_SHARE = 1 / 32
#: Examples to a block at most; a text's blocks that are looked into before the cut; what bounds may be off by.
BLOCK, FIRST_BLOCKS, SLACK = 64, 4, 1e-5
#: The terms that most examples have, by which the examples are ordered.
ORDERED_BY = 256
BREAKS = np.zeros(256, bool)
BREAKS[[c for c in range(128) if not chr(c).isalnum()]] = True


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The terms of each place in a column as hashes, and where each row's begin: all words, then their beginnings."""
    raw, off = hashed.utf8(col)
    low = hashed.lowered(raw)
    s, e, rows = hashed.word_spans(low, off, BREAKS)
    kinds = [hashed.span_hashes(low, s, e)]
    for n in PREFIXES:
        kinds.append(np.where(e - s > n, hashed.mix(hashed.span_hashes(low, s, np.minimum(e, s + n)) + np.uint64(n)), np.uint64(0)))
    return np.stack(kinds, axis=1).ravel(), rows * len(kinds)


def _rows(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct terms of each row, and their counts."""
    all_terms, rows = terms(col)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        k, n = np.unique(all_terms[a:b], return_counts=True)
        yield k[k != 0], n[k != 0]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and their counts in each example, packed."""
    for whole in batches:
        for batch in hashed.slices(whole):
            rows = [(k.astype("<u8").tobytes(), n.astype("<i4").tobytes()) for k, n in _rows(batch.column(2))]
            packed = [pa.array([r[i] for r in rows], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["mix", "toxic", "terms", "tf"])


def find(vocabulary: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted vocabulary, and which of them stand there."""
    if not len(vocabulary):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    return at, vocabulary[at] == keys


def alike_order(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which neighbours are alike, and where its blocks begin: each part is halved along its main direction."""
    done, parts = [], [np.arange(len(vectors))] if len(vectors) else []
    while parts:
        rows = parts.pop()
        if len(rows) <= BLOCK:
            done.append(rows)
            continue
        own = vectors[rows] - vectors[rows].mean(axis=0)
        way = own[np.argmax((own * own).sum(axis=1))]
        for _ in range(4):
            way = (own @ way) @ own
            way = way / max(float(np.sqrt(way @ way)), 1e-12)
        by = rows[np.argsort(np.round(own @ way, 5), kind="stable")]
        parts += [by[len(by) // 2 :], by[: len(by) // 2]]
    sizes = [len(d) for d in done]
    return np.concatenate(done) if done else np.zeros(0, np.int64), np.cumsum([0, *sizes])


class Index:
    """The examples' vectors by term: postings of the rare terms; of the frequent ones the weights and their maxima by block."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]):
        order = np.argsort(vocabulary)
        self.vocabulary, self.idf = vocabulary[order], idf[order].astype(np.float32)
        n = len(rows)
        sizes = np.array([len(k) for k, _ in rows], np.int64)
        ids = np.repeat(np.arange(n, dtype=np.int32), sizes)
        term, weight = np.empty(len(ids), np.int32), np.empty(len(ids), np.float32)
        ends = np.cumsum(sizes)
        for r, to, size in zip(rows, ends.tolist(), sizes.tolist(), strict=True):  # all terms of examples are known
            term[to - size : to], weight[to - size : to] = self.vector(*r)
        times = np.bincount(term, minlength=len(vocabulary))
        frequent = np.flatnonzero(times > max(1, FREQUENT_SHARE * n))
        frequent = frequent[np.argsort(-times[frequent], kind="stable")]
        self.slot = np.full(len(vocabulary), -1, np.int32)
        self.slot[frequent] = np.arange(len(frequent))
        slot = self.slot[term]
        #: The example at each place of the index, and where its blocks begin.
        first = (slot >= 0) & (slot < ORDERED_BY)
        matrix = np.zeros((n, min(len(frequent), ORDERED_BY)), np.float32)
        matrix[ids[first], slot[first]] = weight[first]
        self.order, self.starts = alike_order(matrix)
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        many = slot >= 0
        self.frequent = len(frequent), place[ids[many]], slot[many], weight[many]
        self.blocks = self.maxima = None
        few = np.flatnonzero(~many)
        few = few[np.argsort(term[few], kind="stable")]
        self.ids, self.weights = place[ids[few]], weight[few]
        self.ptr = np.searchsorted(term[few], np.arange(len(vocabulary) + 1))
        self.labels = np.array(labels, np.int8)[self.order]
        self.place = place
        self.rate = float((self.labels.sum() + 1) / (n + 2)) if n else 0.5
        self.scale, self.shift = 1.0, 0.0
        self.seen = self.held = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": None, "maxima": None}

    def _spread(self) -> None:
        """Lays out the weights of the frequent terms that a block has, with their maxima; tasks do it for themselves, so that less is sent."""
        n_frequent, ids, slot, weight = self.frequent
        by_place = np.argsort(ids, kind="stable")
        edges = np.searchsorted(ids[by_place], self.starts)
        self.blocks, self.maxima = [], np.zeros((n_frequent, len(self.starts) - 1), np.float32)
        for b, (a, e, x, y) in enumerate(zip(self.starts[:-1], self.starts[1:], edges[:-1], edges[1:], strict=True)):
            own = by_place[x:y]
            here, row = np.unique(slot[own], return_inverse=True)
            block = np.zeros((len(here), e - a), np.float32)
            block[row, ids[own] - a] = weight[own]
            self.blocks.append((here, block))
            self.maxima[here, b] = block.max(axis=1)

    def weighed(self, keys: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights."""
        at, known = find(self.vocabulary, keys)
        at = at[known]
        return at, (1 + np.log(tf[known])).astype(np.float32) * self.idf[at]

    def vector(self, keys: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights, of length one."""
        at, w = self.weighed(keys, tf)
        return at, w / np.sqrt(np.sum(w * w)) if len(at) else w

    def _rare(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the rare terms add to the cosine with each example."""
        few = self.slot[at] < 0
        start = self.ptr[at[few]]
        size = self.ptr[at[few] + 1] - start
        if not size.sum():
            return np.zeros(len(self.labels))
        ends = np.cumsum(size)
        posting = np.repeat(start - ends + size, size)
        posting += np.arange(ends[-1])
        added = np.repeat(w[few], size)
        added *= self.weights[posting]
        return np.bincount(self.ids[posting], weights=added, minlength=len(self.labels))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the places of the k largest positive cosines and these; ``without`` is an own place that doesn't count.

        Vectors with the same best block are dealt with together, ``ALIKE`` at a time: a block that most of them ask is looked into for all.
        """
        m, n = len(vectors), len(self.labels)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        if self.blocks is None:
            self._spread()
        best = [np.argmax(self._frequent_part(vectors[a : a + ALIKE]) @ self.maxima, axis=1) for a in range(0, m, ALIKE)]
        order, out = np.argsort(np.concatenate(best), kind="stable") if m else [], [None] * m
        for a in range(0, m, ALIKE):
            rows = order[a : a + ALIKE]
            found = self._alike([vectors[r] for r in rows], k, None if without is None else np.array(without)[rows])
            for row, near in zip(rows, found, strict=True):
                out[row] = near
        return out

    def _frequent_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The vectors' weights of the frequent terms."""
        out = np.zeros((len(vectors), len(self.maxima)), np.float32)
        for row, (at, w) in enumerate(vectors):
            slot = self.slot[at]
            out[row, slot[slot >= 0]] = w[slot >= 0]
        return out

    def _alike(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """:meth:`nearest` of some vectors.

        No cosine in a block is above its bound, the block's maxima times the vector and the largest sum of rare terms. So
        blocks under the k-th cosine so far are skipped; what is found is exact.
        """
        m, n, n_blocks = len(vectors), len(self.labels), len(self.blocks)
        rare = np.empty((m, n), np.float32)
        for row, vector in enumerate(vectors):
            rare[row] = self._rare(*vector)
        query = self._frequent_part(vectors)
        bound = query @ self.maxima + np.maximum.reduceat(rare, self.starts[:-1], axis=1)
        by_term, part = np.ascontiguousarray(query.T), np.empty((query.shape[1], m), np.float32)
        scores, seen, least = np.zeros((m, n), np.float32), np.zeros((m, n_blocks), bool), np.zeros((m, 1), np.float32)
        cut = np.partition(bound, max(0, n_blocks - FIRST_BLOCKS), axis=1)[:, max(0, n_blocks - FIRST_BLOCKS), None]
        for last in (False, True):
            ask = (bound > 0) & ~seen & (bound + SLACK >= (least if last else cut))
            for b in np.flatnonzero(ask.any(axis=0)):
                (here, block), a, e = self.blocks[b], self.starts[b], self.starts[b + 1]
                own = np.take(by_term, here, axis=0, out=part[: len(here)], mode="clip")  # "raise" would need a second buffer
                rows = np.flatnonzero(ask[:, b])
                if 2 * len(rows) > m:  # all of them cost less than to pick these
                    np.add(own.T @ block, rare[:, a:e], out=scores[:, a:e])
                    seen[:, b] = True
                else:
                    scores[rows, a:e] = own[:, rows].T @ block + rare[rows, a:e]
                    seen[rows, b] = True
            if without is not None:
                scores[np.arange(m), without] = 0
            if not last:
                some = scores[:, np.repeat(seen.any(axis=0), np.diff(self.starts))]
                if some.shape[1] > k:
                    least = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k, None]
        self.seen, self.held = self.seen + int(seen.sum()), self.held + seen.size
        out = []
        for row, places in enumerate((scores > 0) & (scores + SLACK >= least)):
            ids = np.flatnonzero(places)
            near, cosines = self.best(scores[row, ids], k)
            out.append((ids[near], cosines))
        return out

    @staticmethod
    def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the k largest positive scores (ties to six digits: the lower place) and these."""
        rank = np.round(scores, 6)
        ids = np.flatnonzero(scores > 0 if len(scores) <= k else (scores > 0) & (rank >= np.partition(rank, len(rank) - k)[len(rank) - k]))
        ids = ids[np.lexsort((ids, -rank[ids]))[:k]]
        return ids, scores[ids]

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines.astype(float) ** 2
        return float(((w * self.labels[ids]).sum() + PRIOR_WEIGHT * self.rate) / (w.sum() + PRIOR_WEIGHT))

    def calibrate(self, votes: list[float], labels: list[int]) -> None:
        """Platt's curve through the votes that examples get from the others; one kind of label leaves the votes as they are."""
        x, y = np.log(np.array(votes, float)) - np.log1p(-np.array(votes, float)), np.array(labels, float)
        if len(set(y)) < 2:
            return
        z, w = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(2), z.T @ (y - p) - (w - [1.0, 0.0]))
        if 0 < w[0] < 20:
            self.scale, self.shift = float(w[0]), float(w[1])


def association(df: np.ndarray, pos: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """G2 of each term with the label, from the examples and the toxic ones that have it."""
    rate = n_toxic / max(n, 1)
    if not 0 < rate < 1:
        return np.zeros(len(df))

    def part(a, b):
        return np.where(a > 0, a * np.log(np.maximum(a, 1) / np.maximum(b, 1e-12)), 0.0)

    return np.maximum(0.0, 2 * (part(pos, df * rate) + part(df - pos, df * (1 - rate)) + part(n_toxic - pos, (n - df) * rate) + part(n - df - n_toxic + pos, (n - df) * (1 - rate))))


def _frequencies(vocabulary):
    """Of a task's documents: how many have each known term, as (null, term, count, null); and (text_key, term, count in the text,
    number of such terms) for each term that no example has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_terms, names = vocabulary.value, ["text_key", "term", "n", "others"]
        df = np.zeros(len(known_terms), np.int64)
        for whole in batches:
            for batch in hashed.slices(whole):
                keys, out = batch.column(0).to_numpy(), []
                for key, (k, n) in zip(keys, _rows(batch.column(1)), strict=True):
                    at, known = find(known_terms, k)
                    df[at[known]] += 1
                    if len(other := k[~known]):
                        out.append((np.full(len(other), key), other.astype(np.int64), n[~known].astype(np.int64), np.full(len(other), len(other))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)
        some = np.flatnonzero(df)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(known_terms[some].astype(np.int64)), pa.array(df[some]), none], names)

    return run


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, toxic): how many of a task's examples have each term, and how many of these are toxic."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.frombuffer(k.as_buffer(), "<u8") for k in batch.column(1)]
        toxic = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(float), [len(k) for k in keys])
        term, at = np.unique(np.concatenate(keys), return_inverse=True)
        n, pos = np.bincount(at, minlength=len(term)), np.bincount(at, toxic, minlength=len(term))
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(n), pa.array(pos.astype(np.int64))], ["term", "n", "toxic"])


def _votes(shared, mixes: np.ndarray, neighbours: int):
    """(vote, toxic) of some examples, evenly spread over their order: what the other examples say of them."""
    step = max(1, len(mixes) // CALIBRATED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            row = np.searchsorted(mixes, batch.column(0).to_numpy())
            some = batch.filter(pa.array(row % step == 0))
            row = row[row % step == 0]
            for a in range(0, len(row), TOGETHER):
                part = some.slice(a, TOGETHER)
                vectors = [index.vector(np.frombuffer(k.as_buffer(), "<u8"), np.frombuffer(n.as_buffer(), "<i4")) for k, n in zip(part.column(2), part.column(3), strict=True)]
                near = index.nearest(vectors, neighbours, [int(p) for p in index.place[row[a : a + TOGETHER]]])
                yield pa.RecordBatch.from_arrays([pa.array([index.vote(*x) for x in near], pa.float64()), part.column(1)], ["vote", "toxic"])

    return run


def fit_index(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, least_factor: float = LEAST_FACTOR) -> tuple[Index, object, DataFrame]:
    """The index of at most ``examples`` labelled documents that are not held out, taken in the order of a hash, equal texts once;
    the same sent to all tasks; and (text_key, more): what the terms that no example has add to the square of a text's length."""
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).select("doc_id", "toxic").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "toxic").limit(examples)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")
    sample = texts.select(F.xxhash64("text").alias("mix"), F.col("toxic").cast("int").alias("toxic"), "text").dropDuplicates(["mix"])
    # an id may stand on many rows, so the texts are bounded once more, by keys alone
    kept = sample.select("mix").orderBy(F.xxhash64("mix", F.lit(12)), "mix").limit(examples)
    sample = sample.join(F.broadcast(kept), "mix")
    counted = written(sample.mapInArrow(_counts, "mix bigint, toxic int, terms binary, tf binary"), "toxicity-examples")
    of_terms = counted.select("toxic", "terms").mapInArrow(_example_terms, "term bigint, n bigint, toxic bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()
    vocabulary = of_terms.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, here, pos = vocabulary[order], of_terms.column(1).to_numpy().astype(float)[order], of_terms.column(2).to_numpy().astype(float)[order]
    n_examples, n_toxic = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    g2 = association(here, pos, n_examples, n_toxic)
    factor = least_factor + (1 - least_factor) * g2 / (g2 + HALF_G2)

    words = spark.sparkContext.broadcast(vocabulary)
    keyed = docs.select(F.xxhash64("text").alias("text_key"), "text")
    seen = written(keyed.mapInArrow(_frequencies(words), "text_key bigint, term bigint, n bigint, others bigint"), "toxicity-terms")
    n_docs = docs.count()
    of_known = seen.filter("text_key is null").groupBy("term").agg(F.sum("n").alias("df")).toArrow()
    at, _ = find(vocabulary, of_known.column(0).to_numpy().astype(np.int64).view(np.uint64))
    df = np.zeros(len(vocabulary))
    df[at] = of_known.column(1).to_numpy()
    words.unpersist()

    rows = counted.orderBy("mix", "toxic").toArrow()
    pairs = [(np.frombuffer(k.as_buffer(), "<u8"), np.frombuffer(n.as_buffer(), "<i4")) for k, n in zip(rows["terms"], rows["tf"], strict=True)]
    index = Index(vocabulary, np.log((n_docs + 1) / (df + 0.5)) * factor, pairs, rows["toxic"].to_pylist())
    mixes = rows["mix"].to_numpy().astype(np.int64)
    del rows, pairs
    shared = spark.sparkContext.broadcast(index)
    told = counted.mapInArrow(_votes(shared, mixes, neighbours), "vote double, toxic int").toArrow().to_pydict()
    index.calibrate(told["vote"], told["toxic"])

    others = seen.filter("text_key is not null")
    rare = others.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = (1 + F.log("n")) * F.log((n_docs + 1) / (F.col("df") + 0.5)) * least_factor
    # rows of one text bring its terms each
    more = others.join(rare, "term").groupBy("text_key").agg((F.sum(weight * weight) * F.max("others") / F.count(F.lit(1))).alias("more"))
    return index, shared, more


def score_texts(docs: DataFrame, index: Index, shared, more: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score, evidence): the calibrated vote of the nearest examples; evidence has their places, labels and cosines."""
    kind = pa.list_(pa.struct([("example", pa.int32()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for piece in hashed.slices(whole):
                for a in range(0, piece.num_rows, TOGETHER):
                    batch = piece.slice(a, TOGETHER)
                    known = [index.weighed(*r) for r in _rows(batch.column(2))]
                    square = [float(np.sum(w.astype(float) ** 2)) for _, w in known]
                    near = index.nearest([(at, w / np.float32(q**0.5) if q else w) for (at, w), q in zip(known, square, strict=True)], neighbours)
                    votes = [float((c**2).sum()) for _, c in near]
                    toxic = [float((c**2 * index.labels[ids]).sum()) for ids, c in near]
                    evidence = [[{"example": int(index.order[i]), "label": int(index.labels[i]), "cosine": float(c)} for i, c in zip(ids[:3], cos[:3], strict=True)] for ids, cos in near]
                    numbers = [pa.array(x, pa.float64()) for x in (square, votes, toxic)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array(evidence, kind)], ["doc_id", "text_key", "square", "votes", "toxic", "evidence"])

    shape = "doc_id bigint, text_key bigint, square double, votes double, toxic double, evidence array<struct<example:int,label:int,cosine:double>>"
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, shape).join(more, "text_key", "left")
    # cosines so far are with the part of the text that has known terms
    share = F.when(F.col("square") > 0, F.col("square") / (F.col("square") + F.coalesce("more", F.lit(0.0)))).otherwise(0.0)
    vote = (F.col("toxic") * F.col("share") + PRIOR_WEIGHT * index.rate) / (F.col("votes") * F.col("share") + PRIOR_WEIGHT)
    odds = index.scale * F.log(F.col("vote") / (1 - F.col("vote"))) + index.shift
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds))))
    whole = F.transform("evidence", lambda e: F.struct(e["example"].alias("example"), e["label"].alias("label"), (e["cosine"] * F.sqrt("share")).alias("cosine")))
    return found.withColumn("share", share).withColumn("vote", vote).select("doc_id", score.alias("score"), whole.alias("evidence"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, least_factor: float = LEAST_FACTOR) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row for each row of ``docs``.

    A text without a known term (null and empty ones too) has no neighbour and gets the calibrated general rate. Without
    labels of both kinds that holds for all. Rows are independent: null and repeated ids are ordinary. Only the text enters
    a score; other columns are ignored.
    """
    index, shared, more = fit_index(docs, labels, examples, neighbours, least_factor)
    out = score_texts(docs, index, shared, more, neighbours)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def crc_held_out(doc_id: int) -> bool:
    """What :func:`held_out` says, in Python."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
