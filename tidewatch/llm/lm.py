"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its bigram, its
unigram and a uniform floor; the weights depend on how often the context was
seen and are learned by expectation-maximisation on a part of the training
documents whose counts are deleted from the estimates.

Counts cover all training documents. Tokens and bigrams are hashes of 64 bits,
packed by batches of documents: each batch sends its distinct n-grams, in
order, to the shards that own them; a shard adds up the counts and answers each
batch; a batch then scores its documents. Batches and shards are rows that
Spark shuffles, and a task holds one of them at a time. There are as many
shards as keep one at some millions of n-grams, without a limit; numbers are
stored by byte, so that what they share is compressed away.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import hashed
from tidewatch.llm.store import written

#: Bytes of text to a batch; shards at least, tokens to a shard, and to a partition of shards.
BATCH, LEAST_SHARDS, SHARD_TOKENS, PART_TOKENS = 1 << 23, 256, 1 << 21, 1 << 20
BEGIN, END = hashed.mix(np.array([11, 13], np.uint64))
#: Parts of crc32(id as text) mod 7: held out from training, and deleted from the counts while the weights are learned.
HELD_OUT, DELETED, PARTS = 2, 0, 7
BUCKETS, CELLS = 16, 8


def part(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 7; a null id trains."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(PARTS)), F.lit(1)).cast("int")


def packed(numbers: np.ndarray, width: int = 8) -> bytes:
    """The lowest ``width`` bytes of the numbers: the first byte of all, then the second of all, and so on."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(blob: bytes, width: int = 8) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _batch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each batch of documents; deleted ones are batches of their own."""
    names = ["batch", "deleted", "doc_ids", "train", "sizes", "vocabulary", "tokens"]
    for whole in batches:
        for piece in hashed.slices(whole, limit=BATCH):
            parts = piece.column(1).to_numpy(zero_copy_only=False)
            for deleted in (False, True):
                rows = piece.filter(pa.array((parts == DELETED) == deleted))
                if not rows.num_rows:
                    continue
                word, at = hashed.words(rows.column(2))
                sizes = np.diff(at) + 1
                tokens = np.empty(int(sizes.sum()), np.uint64)
                ends = np.cumsum(sizes) - 1
                inside = np.ones(len(tokens), bool)
                inside[ends] = False
                tokens[inside], tokens[ends] = word, END
                vocabulary, index, times = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")  # frequent tokens get small numbers
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                width = max(1, (len(vocabulary).bit_length() + 7) // 8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int.from_bytes(os.urandom(8), "little", signed=True)], pa.int64()),
                        pa.array([deleted]),
                        pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())),
                        pa.array([(rows.column(1).to_numpy(zero_copy_only=False) != HELD_OUT).tolist()], pa.list_(pa.bool_())),
                        pa.array([sizes.tolist()], pa.list_(pa.int32())),
                        pa.array([vocabulary[order].tobytes()], pa.binary()),
                        pa.array([packed(rank[index], width)], pa.binary()),
                    ],
                    names,
                )


class _Batch:
    """A batch unpacked: its vocabulary, tokens, and bigrams as sorted distinct keys and the place of each token's among them."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["sizes"], np.int64)
        self.train = np.repeat(np.array(row["train"], bool), self.sizes)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        n = int(self.sizes.sum())
        self.tokens = unpacked(row["tokens"], len(row["tokens"]) // n).astype(np.int64)
        #: The vocabulary in the order of its hashes, in which shards answer.
        self.order = np.argsort(self.vocabulary)
        self.starts = np.cumsum(self.sizes) - self.sizes
        context = np.empty(n, np.uint64)
        own = self.vocabulary[self.tokens]
        context[1:] = own[:-1]
        context[self.starts] = BEGIN
        self.bigrams, self.places = np.unique(hashed.mix(context * hashed.BASE + own), return_inverse=True)

    def of_tokens(self, uni: np.ndarray) -> np.ndarray:
        """Each token's figure, from figures of the vocabulary in the order of its hashes."""
        out = np.empty(len(uni))
        out[self.order] = uni
        return out[self.tokens]


def _requests(bits: int):
    """The distinct n-grams of each batch and their counts in training documents, by shard."""
    names = ["kind", "shard", "batch", "deleted", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            for k in range(table.num_rows):
                row = table.slice(k, 1).to_pylist()[0]
                b = _Batch(row)
                width = (71 - bits) // 8  # the shard's bits needn't be sent
                for kind, keys, index, order in ((1, b.vocabulary[b.order], b.tokens, b.order), (2, b.bigrams, b.places, slice(None))):
                    counts = np.bincount(index[b.train], minlength=len(keys))[order]
                    shard = keys >> np.uint64(64 - bits)
                    edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(keys)]])
                    full = shard[edges[:-1]]
                    parts = list(zip(edges[:-1], edges[1:], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int64)),
                            pa.array(np.full(len(full), row["batch"], np.int64)), pa.array(np.full(len(full), row["deleted"])),
                            pa.array([packed(keys[x:y], width) for x, y in parts], pa.binary()),
                            pa.array([packed(counts[x:y], 4) for x, y in parts], pa.binary()),
                        ],
                        names,
                    )

    return run


ANSWERS = "kind int, shard bigint, batch bigint, deleted boolean, counts binary, deleted_counts binary, n_types bigint, n_tokens bigint, rest_types bigint, rest_tokens bigint"


def _answers(key: tuple, table: pa.Table) -> pa.Table:
    """A shard's sums for each batch that asked, in the order it asked; the first row also has the shard's totals.

    Sums are taken in doubles, which are exact up to 2**53, and sent as 64 bits.
    """
    rows = table.select(["batch", "deleted", "keys", "counts"]).to_pylist()
    counts = [unpacked(r["counts"], 4) for r in rows]
    sizes = [len(c) for c in counts]
    keys = [unpacked(r["keys"], len(r["keys"]) // n) for r, n in zip(rows, sizes, strict=True)]
    counts = np.concatenate(counts).astype(float)
    types, index = np.unique(np.concatenate(keys), return_inverse=True)
    from_deleted = np.repeat(np.array([r["deleted"] for r in rows]), sizes)
    total = np.bincount(index, weights=counts, minlength=len(types))
    deleted = np.bincount(index[from_deleted], weights=counts[from_deleted], minlength=len(types))
    out, at = [], 0
    for k, (r, n) in enumerate(zip(rows, sizes, strict=True)):
        own = index[at : at + n]
        at += n
        figures = (int((total > 0).sum()), int(total.sum()), int((total > deleted).sum()), int((total - deleted).sum())) if k == 0 else (0, 0, 0, 0)
        out.append((key[0].as_py(), key[1].as_py(), r["batch"], r["deleted"], packed(total[own]), packed(deleted[own]) if r["deleted"] else b"", *figures))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in ANSWERS.split(", ")]
    return pa.table({n: pa.array(v, t) for n, v, t in zip(names, zip(*out, strict=True), kinds, strict=True)})


def _sums(right: pa.Table, kind: int, column: str) -> np.ndarray:
    rows = sorted((r["shard"], r[column]) for r in right.select(["kind", "shard", column]).to_pylist() if r["kind"] == kind)
    return np.concatenate([np.zeros(0), *[unpacked(x).astype(float) for _, x in rows]])


def _estimates(b: _Batch, uni: np.ndarray, bi: np.ndarray, n_tokens: float, n_docs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: the bucket of its context's count, and its bigram and unigram estimates, from counts in the order of hashes."""
    own = b.of_tokens(uni)
    context = np.empty(len(own))
    context[1:] = own[:-1]
    context[b.starts] = n_docs
    bucket = np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1))).astype(np.int64)
    two = np.where(context > 0, bi[b.places] / np.maximum(context, 1), 0.0)
    return bucket, np.minimum(two, 1.0), own / max(n_tokens, 1)


@dataclass(frozen=True)
class Mixture:
    """For each bucket the weights of the bigram, the unigram and the floor; the counts' totals."""

    weights: tuple[tuple[float, float, float], ...]
    n_tokens: int
    n_types: int
    n_docs: int


def learn_weights(cells: list[tuple[int, float, float, float]], floor: float, rounds: int = 100) -> tuple[tuple[float, float, float], ...]:
    """EM over (bucket, bigram estimate, unigram estimate, count) of deleted tokens; buckets without any lean on the unigram."""
    out = []
    for k in range(BUCKETS):
        own = np.array([c[1:] for c in cells if c[0] == k], float).reshape(-1, 3)
        w = np.array([0.3, 0.6, 0.1])
        if len(own):
            p = np.column_stack([own[:, 0], own[:, 1], np.full(len(own), floor)])
            for _ in range(rounds):
                share = p * w
                share /= share.sum(axis=1, keepdims=True)
                w = (share * own[:, 2:]).sum(axis=0) + np.array([1e-3, 1e-3, 1e-3])
                w /= w.sum()
        out.append(tuple(float(x) for x in w))
    return tuple(out)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Mixture]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of ``docs``; and the model.

    Tokens are words in lower case (A-Z) and one end for each document; null and empty texts have only the end. Rows are
    documents of their own, null and repeated ids too (a null id trains). Without training documents every count is 0.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), part(F.col(id_col)).alias("part"), F.col(text_col).alias("text"))
    schema = "batch bigint, deleted boolean, doc_ids array<bigint>, train array<boolean>, sizes array<int>, vocabulary binary, tokens binary"
    tokens = written(rows.mapInArrow(_batch_rows, schema), "lm-tokens")
    sizes = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    train_docs = F.size(F.filter("train", lambda t: t))
    n_all, docs_all, docs_deleted, n_batches = tokens.agg(F.sum(sizes), F.sum(train_docs), F.sum(F.when(F.col("deleted"), train_docs)), F.count(F.lit(1))).first()
    bits = max(LEAST_SHARDS.bit_length() - 1, ((n_all or 0) // SHARD_TOKENS).bit_length())
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_shard, by_batch = max(least, (n_all or 0) // PART_TOKENS), max(least, 2 * n_batches)

    asked = tokens.mapInArrow(_requests(bits), "kind int, shard bigint, batch bigint, deleted boolean, keys binary, counts binary")
    answers = written(asked.repartition(by_shard, "kind", "shard").groupBy("kind", "shard").applyInArrow(_answers, ANSWERS), "lm-answers")
    names = ("n_types", "n_tokens", "rest_types", "rest_tokens")
    n_types, n_tokens, rest_types, rest_tokens = (int(x or 0) for x in answers.filter("kind = 1").agg(*[F.sum(n) for n in names]).first())
    rest_docs = (docs_all or 0) - (docs_deleted or 0)

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for row in left.to_pylist():
            b = _Batch(row)
            uni, bi = (_sums(right, k, "counts") - _sums(right, k, "deleted_counts") for k in (1, 2))
            bucket, two, one = _estimates(b, uni, bi, rest_tokens, rest_docs)
            with np.errstate(divide="ignore"):
                code = [np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-30)) * CELLS), 1).astype(np.int64) for x in (two, one)]
            found.append(np.stack([bucket, *code], axis=1))
        kinds, counts = np.unique(np.concatenate(found), axis=0, return_counts=True) if found else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        return pa.table({"bucket": kinds[:, 0], "two": kinds[:, 1], "one": kinds[:, 2], "n": counts})

    both = tokens.filter("deleted").groupBy("batch").cogroup(answers.filter("deleted").groupBy("batch"))
    seen = both.applyInArrow(cells, "bucket bigint, two bigint, one bigint, n bigint").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    value = lambda code: 0.0 if code == 1 else 2.0 ** (code / CELLS)
    weights = learn_weights([(r["bucket"], value(r["two"]), value(r["one"]), r["n"]) for r in seen], 1 / (rest_types + 1))
    model = Mixture(weights, n_tokens, n_types, docs_all or 0)

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for row in left.to_pylist():
            b = _Batch(row)
            uni, bi = _sums(right, 1, "counts"), _sums(right, 2, "counts")
            bucket, two, one = _estimates(b, uni, bi, model.n_tokens, model.n_docs)
            w = np.array(model.weights)[bucket]
            p = w[:, 0] * two + w[:, 1] * one + w[:, 2] / (model.n_types + 1)
            own = b.of_tokens(uni)
            add = lambda x, b=b: np.add.reduceat(x, b.starts)
            out["doc_id"] += row["doc_ids"]
            out["held_out"] += [not t for t in row["train"]]
            out["n_tokens"] += b.sizes.tolist()
            out["n_known"] += add((own > 0).astype(np.int64)).tolist()
            out["base_score"] += (add(np.log10(own + 1)) - b.sizes * np.log10(model.n_tokens + model.n_types + 1)).tolist()
            out["score"] += add(np.log10(p)).tolist()
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    dealt = lambda df: df.repartition(by_batch, "batch").groupBy("batch")
    all_of = dealt(tokens).cogroup(dealt(answers.select("kind", "shard", "batch", "counts")))
    scored = all_of.applyInArrow(scores, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score"), model
