"""Set similarity join of documents on word shingles, by a matrix of tokens and groups.

Texts with the same set are one class. A set that is similar to another shares
most of its tokens with it, so a set with too many tokens that no other set has
is done: tokens meet by range, packed, each shard of documents first settles
what it can alone and sends a token once. Those that stay are ordered by how
frequent their tokens are, from a table of counters; the rarest tokens of two
similar sets, a prefix of each, have one in common.

Similar sets are partitioned into groups, by the most frequent token of their
prefix, and cut to at most GROUP sets. The matrix has a row (token, group) for
each token in the union of a group's prefixes. Groups are first joined inside.
A set then queries the groups with which it shares a token of the matrix, if
they hold a component that isn't its own; where the union of a group's tokens
overlaps too little with the set the group isn't opened, otherwise its sets are
compared in full. Of two components that meet, the smaller one asks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import hashed
from tidewatch.llm.blobs import numbers, packed, planes, unpacked
from tidewatch.llm.neardup import BROADCAST_IDS, components
from tidewatch.llm.store import written

SHINGLE, SIMILARITY = 5, 80


@dataclass(frozen=True)
class Sizes:
    """Sets to a group, queries to a block of a group, tokens to a shard and to a range, counters for frequencies (they are sent to all tasks)."""

    group: int = 512
    block: int = 2048
    shard: int = 2_000_000
    part: int = 2_000_000
    least_parts: int = 16
    counters: int = 1 << 18


def least_common(n: np.ndarray, similarity: int) -> np.ndarray:
    """Tokens that a set of n shares at least with a similar one."""
    return -(-n * similarity // 100)


def _of_rows(batch: pa.RecordBatch, at: int, shingle: int) -> Iterator[np.ndarray]:
    word, rows = hashed.words(batch.column(at))
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        yield hashed.shingle_set(word[a:b], shingle)


def _class(own: np.ndarray) -> int:
    """A key of 64 bits for a set."""
    one = np.add.reduce(hashed.mix(own + np.uint64(1)))
    two = np.bitwise_xor.reduce(hashed.mix(own ^ hashed.BASE))
    return int(hashed.mix(np.array([hashed.mix(np.array([one + np.uint64(len(own))], np.uint64))[0] * hashed.BASE + two], np.uint64)).view(np.int64)[0])


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashed.slices(whole):
                n, rep = [], []
                for own in _of_rows(batch, 2, shingle):
                    n.append(len(own))
                    rep.append(_class(own) if len(own) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(rep, pa.int64())], ["doc_id", "text_key", "n", "rep"])

    return run


def _shard_rows(shingle: int, sizes: Sizes, parts: int, bits: int):
    """(part, tokens): of a shard's sets, their tokens by range, and at one place how many of a set's tokens others of the shard have.

    Tokens are cut to their first bits; two that then are equal count as shared, so a set never seems to share less than it does.
    """
    edges = np.array([(k << bits) // parts for k in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        sets: list[np.ndarray] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            reps = np.array(list(known), np.int64)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            token = np.concatenate(sets)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(begin, len(token)))
            shared = np.repeat(count > 1, count)
            own = np.bincount(owner[shared], minlength=len(sets))
            shard = np.array([hashed.mix(reps.view(np.uint64)).sum(dtype=np.uint64)], np.uint64)
            once, more = np.flatnonzero(count == 1), np.flatnonzero(count > 1)
            single, many = begin[once], token[begin[more]]
            cut1 = np.concatenate([[0], np.searchsorted(token[single], edges), [len(single)]])
            cut2 = np.concatenate([[0], np.searchsorted(many, edges), [len(many)]])
            home = int(shard[0] % np.uint64(parts))
            to, blobs = [], []
            for p in range(parts):
                some, dup = single[cut1[p] : cut1[p + 1]], many[cut2[p] : cut2[p + 1]]
                if not len(some) and not len(dup) and p != home:
                    continue
                used, local = np.unique(owner[some], return_inverse=True)
                step = lambda x: np.diff(x, prepend=np.uint64(0))
                counted = (reps.tobytes(), planes(own)) if p == home else (b"", b"")
                to.append(p)
                blobs.append(packed(shard.tobytes(), reps[used].tobytes(), planes(step(token[some]), 8), planes(local), planes(step(dup), 8), *counted))
            known.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], ["part", "tokens"])

        for whole in batches:
            for batch in hashed.slices(whole):
                for own in _of_rows(batch, 0, shingle):
                    if not len(own) or (rep := _class(own)) in known:
                        continue
                    known[rep] = len(own)
                    sets.append(own >> np.uint64(64 - bits))
                    held += len(own)
                    if held >= sizes.shard:
                        yield flushed()
                        held = 0
        if held:
            yield flushed()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, counts): for each shard in one row, how many tokens of a range its sets have that another set has too."""

    def of_part(blobs: list[bytes]) -> pa.RecordBatch:
        parts = [unpacked(b) for b in blobs]
        shards = [int(np.frombuffer(p[0], "<i8")[0]) for p in parts]
        reps = [np.frombuffer(p[1], "<i8") for p in parts]
        single = [np.cumsum(numbers(p[2], 8), dtype=np.uint64) for p in parts]
        owner = [r[numbers(p[3]).astype(np.int64)] for r, p in zip(reps, parts, strict=True)]
        many = np.concatenate([np.cumsum(numbers(p[4], 8), dtype=np.uint64) for p in parts])
        token, rep = np.concatenate(single), np.concatenate(owner)
        at = np.repeat(np.arange(len(parts)), [len(s) for s in single])
        order = np.argsort(token, kind="stable")
        token, rep, at = token[order], rep[order], at[order]
        out: list[tuple[int, bytes]] = []
        if len(token):
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            common = (np.minimum.reduceat(rep, begin) != np.maximum.reduceat(rep, begin)) | np.isin(token[begin], many)
            shared = np.repeat(common, np.diff(np.append(begin, len(token))))
            (of, who), n = np.unique(np.stack([at[shared], rep[shared]]), axis=1, return_counts=True)
            for k in np.unique(of).tolist():
                out.append((shards[k], packed(who[of == k].astype("<i8").tobytes(), planes(n[of == k]))))
        out += [(shard, packed(p[5], p[6])) for shard, p in zip(shards, parts, strict=True) if len(p[5])]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], ["shard", "counts"])

    now, blobs = None, []
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != now and blobs:
                yield of_part(blobs)
                blobs = []
            now = part
            blobs.append(blob)
    if blobs:
        yield of_part(blobs)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, shared) of each shard, from its counts over all ranges, sorted by shard."""

    def of_shard(blobs: list[bytes]) -> pa.RecordBatch:
        parts = [unpacked(b) for b in blobs]
        reps, at = np.unique(np.concatenate([np.frombuffer(p[0], "<i8") for p in parts]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([numbers(p[1]) for p in parts]).astype(float), minlength=len(reps))
        return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(total.astype(np.int64))], ["rep", "shared"])

    now, blobs = None, []
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shard != now and blobs:
                yield of_shard(blobs)
                blobs = []
            now = shard
            blobs.append(blob)
    if blobs:
        yield of_shard(blobs)


def _full(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashed.slices(whole):
                sets = [own.tobytes() for own in _of_rows(batch, 1, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

    return run


def _counted(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(x, "<u8") % np.uint64(counters)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part])], ["counter", "n"])

    return run


def _packed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one = [pa.array([batch.column(k).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(one, ["counters", "counts"])


def _prefixes(counts: np.ndarray, similarity: int):
    """(rep, n, key, prefix): the rarest tokens of a set, as many as leave one in common with each similar set, and the most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, prefix = [], [], []
            for x in batch.column(1).to_pylist():
                own = np.frombuffer(x, "<u8")
                order = np.lexsort((own, counts[(own % np.uint64(len(counts))).astype(np.int64)]))
                rare = own[order[: len(own) - int(least_common(len(own), similarity)) + 1]]
                n.append(len(own))
                key.append(int(rare[-1:].view(np.int64)[0]))
                prefix.append(np.sort(rare).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(prefix, pa.binary())], ["rep", "n", "key", "prefix"])

    return run


def _matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, gid, n) for each token of each prefix."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = [np.frombuffer(x, "<i8") for x in part.column(2).to_pylist()]
            if not sets:
                continue
            size = [len(s) for s in sets]
            gid, n = (np.repeat(part.column(k).to_numpy(zero_copy_only=False), size) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(gid, pa.int64()), pa.array(n, pa.int64())], ["token", "gid", "n"])


class Group:
    """Sets of a group, and the union of their tokens with the sets that have each."""

    def __init__(self, reps: list[int], comps: list[int], asks: list[tuple], sets: list[np.ndarray]):
        self.reps, self.comps, self.asks = reps, comps, asks
        self.n = np.array([len(s) for s in sets])
        token = np.concatenate(sets)
        order = np.argsort(token, kind="stable")
        self.token = token[order]
        self.owner = np.repeat(np.arange(len(sets)), self.n)[order]
        self.union = np.unique(token)

    def bound(self, own: np.ndarray) -> int:
        """Tokens of a set that the union has: no set of the group shares more."""
        at = np.searchsorted(self.union, own)
        return int((self.union[np.minimum(at, len(self.union) - 1)] == own).sum())

    def links(self, own: np.ndarray, similarity: int) -> np.ndarray:
        """Which sets are similar to ``own``, by what they share in full."""
        if self.bound(own) < least_common(len(own), similarity):
            return np.zeros(0, np.int64)
        a, b = np.searchsorted(self.token, own, "left"), np.searchsorted(self.token, own, "right")
        size = b - a
        at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
        both = np.bincount(self.owner[at], minlength=len(self.n))
        return np.flatnonzero((both > 0) & (100 * both >= similarity * (self.n + len(own) - both)))


class _Roots:
    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, c: int) -> int:
        while c in self.up:
            c = self.up[c]
        return c

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _joined(similarity: int):
    """Links (a, b) of sorted rows (gid, block, side, rep, weight, comp, set): within the sets of side 0 where no set of side 1 asks, else between the sides.

    Links that join nothing new within a group are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, group, roots = None, [], None, _Roots()
        a, b = [], []

        def link(group: Group, rep: int, comp: int, ask: tuple | None, own: np.ndarray, upto: int | None) -> None:
            may = [k for k in range(len(group.reps) if upto is None else upto) if (ask is None or group.asks[k] > ask) and roots.top(group.comps[k]) != roots.top(comp)]
            if not may:
                return
            some = set(may)
            for k in group.links(own, similarity).tolist():
                if k in some and roots.join(group.comps[k], comp):
                    a.append(min(rep, group.reps[k]))
                    b.append(max(rep, group.reps[k]))

        def inside() -> None:
            whole = Group(*map(list, zip(*members, strict=True)))
            for k, (rep, comp, _, own) in enumerate(members):
                link(whole, rep, comp, None, own, k)

        for batch in batches:
            for gid, block, side, rep, weight, comp, x in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                own = np.frombuffer(x, "<u8")
                if (gid, block) != now:
                    if len(members) > 1 and group is None:
                        inside()
                    now, members, group, roots = (gid, block), [], None, _Roots()
                if side == 0:
                    members.append((rep, comp, (weight, comp), own))
                elif members:
                    group = group or Group(*map(list, zip(*members, strict=True)))
                    link(group, rep, comp, (weight, comp), own, None)
            if len(a) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if len(members) > 1 and group is None:
            inside()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _open_sets(base: DataFrame, sets: DataFrame, shingle: int, similarity: int, sizes: Sizes) -> DataFrame:
    """(rep, set) of the classes that share enough tokens with others."""
    total = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = max(sizes.least_parts, math.ceil(total / sizes.part))
    bits = min(64, max(16, math.ceil(math.log2(total + 2)) + 8))
    sent = base.select("text").mapInArrow(_shard_rows(shingle, sizes, parts, bits), "part int, tokens binary")
    met = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_shared, "shard bigint, counts binary")
    told = met.repartition("shard").sortWithinPartitions("shard").mapInArrow(_totals, "rep bigint, shared bigint")
    shared = told.groupBy("rep").agg(F.max("shared").alias("shared"))
    classes = sets.filter("n > 0").groupBy("rep").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"))
    need = F.ceil(F.col("n") * similarity / 100)
    opened = written(classes.join(shared, "rep").filter(F.col("shared") >= need).select("rep", "text_key"), "setjoin-open")
    few = opened.count() <= BROADCAST_IDS
    texts = base.select("text_key", "text").join(F.broadcast(opened) if few else opened, "text_key").select("rep", "text").dropDuplicates(["rep"])
    return written(texts.mapInArrow(_full(shingle), "rep bigint, set binary"), "setjoin-sets")


def similar_sets(sets: DataFrame, similarity: int = SIMILARITY, sizes: Sizes = Sizes()) -> DataFrame:
    """(node, component) of the sets (rep, set: sorted 64-bit tokens as bytes, not empty) that are linked with others, by similarity over all pairs."""
    counters = written(sets.select("set").mapInArrow(_counted(sizes.counters), "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")), "setjoin-counts")
    counts = np.zeros(sizes.counters, np.int64)
    for r in counters.mapInArrow(_packed_counts, "counters binary, counts binary").collect():  # a row for some ten thousand counters
        counts[np.frombuffer(r["counters"], "<i8")] = np.frombuffer(r["counts"], "<i8")

    keyed = written(sets.mapInArrow(_prefixes(counts, similarity), "rep bigint, n bigint, key bigint, prefix binary"), "setjoin-prefixes")
    size = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / sizes.group).alias("cuts"))
    gid = F.xxhash64("key", F.pmod(F.xxhash64("rep"), F.col("cuts")))
    members = written(keyed.join(size.hint("merge"), "key").select(gid.alias("gid"), "rep", "n", "prefix"), "setjoin-members")

    shape = "a bigint, b bigint"
    block = lambda df: df.repartition("gid", "block").sortWithinPartitions("gid", "block", "side", "rep").mapInArrow(_joined(similarity), shape)
    zero = lambda c, kind="int": F.lit(0).cast(kind).alias(c)
    inside = members.join(members.groupBy("gid").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("gid"), "gid").join(sets, "rep")
    links = written(block(inside.select("gid", zero("block"), zero("side"), "rep", zero("weight", "bigint"), F.col("rep").alias("comp"), "set")), "setjoin-links")

    matrix = members.select("gid", "n", "prefix").mapInArrow(_matrix_rows, "token bigint, gid bigint, n bigint").groupBy("token", "gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    matrix = written(matrix, "setjoin-matrix")
    several = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("token")
    rows = written(matrix.join(several, "token"), "setjoin-matrix")
    other = rows.select("token", F.col("gid").alias("to"), F.col("lo").alias("to_lo"), F.col("hi").alias("to_hi"))
    fits = (100 * F.col("hi") >= similarity * F.col("to_lo")) & (100 * F.col("to_hi") >= similarity * F.col("lo"))
    pairs = written(rows.join(other, "token").filter((F.col("gid") < F.col("to")) & fits).select("gid", "to").distinct(), "setjoin-pairs")
    pairs = pairs.union(pairs.select(F.col("to").alias("gid"), F.col("gid").alias("to")))

    def across(links: DataFrame, large_only: bool) -> DataFrame:
        """Links between groups that aren't in one component yet. First of components with several sets, one of each in a group asks for all."""
        parts = components(links)
        placed = members.select("gid", "rep", "n").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        weight = parts.groupBy("component").agg(F.count(F.lit(1)).alias("w")).withColumnRenamed("component", "comp")
        placed = written(placed.join(weight, "comp", "left").select("gid", "rep", "n", "comp", F.coalesce("w", F.lit(1)).alias("weight")), "setjoin-placed")
        asking, asked = placed, placed
        if large_only:
            asked = placed.filter("weight > 1")
            asking = asked.groupBy("gid", "comp").agg(F.min(F.struct("rep", "n", "weight")).alias("one")).select("gid", "one.rep", "one.n", "comp", "one.weight")
        top = asked.groupBy(F.col("gid").alias("to")).agg(F.max(F.struct("weight", "comp")).alias("top"), F.min("n").alias("lo"), F.max("n").alias("hi"))
        near = (100 * F.col("hi") >= similarity * F.col("n")) & (100 * F.col("n") >= similarity * F.col("lo"))
        wanted = asking.join(pairs, "gid").join(top, "to").filter(near & (F.col("top") > F.struct("weight", "comp")))
        wanted = written(wanted.select("to", "rep", "weight", "comp"), "setjoin-queries")
        load = written(wanted.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / sizes.block).cast("int").alias("blocks")), "setjoin-load")
        blocks: Column = F.col("blocks")
        queries = wanted.join(load.hint("merge"), "to").select(
            F.col("to").alias("gid"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"), F.lit(1).alias("side"), "rep", "weight", "comp"
        )
        held = asked.join(load.withColumnRenamed("to", "gid"), "gid").select("gid", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), zero("side"), "rep", "weight", "comp")
        return written(block(held.union(queries).join(sets, "rep").select("gid", "block", "side", "rep", "weight", "comp", "set")), "setjoin-links")

    links = links.union(across(links, large_only=True))
    links = links.union(across(links, large_only=False))
    return components(links)


def join_documents(
    docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()
) -> DataFrame:
    """(doc_id, text_key, n_shingles, class_id, component_id), one row for each row of ``docs``.

    Two documents are linked if ``100 * both >= similarity * either`` for their sets of word shingles; class_id tells equal
    sets, component_id is the smallest id reachable by links. Null and empty texts have no shingles and no links. Rows are
    members by their own text, so null and repeated ids lose no link; a component without an id has none. Ids are whole
    numbers; other columns are ignored, and an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    sets = written(base.mapInArrow(_sets(shingle), "doc_id bigint, text_key bigint, n bigint, rep bigint"), "setjoin-rows")
    parts = similar_sets(_open_sets(base, sets, shingle, similarity, sizes), similarity, sizes)
    classes = sets.filter("n > 0").groupBy("rep").agg(F.min("doc_id").alias("least"))
    of_class = written(classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "least", F.coalesce("component", "rep").alias("component")), "setjoin-classes")
    least = of_class.groupBy("component").agg(F.min("least").alias("id"))
    out = sets.join(of_class.join(least, "component").select("rep", "id"), "rep", "left")
    component = F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), component.alias("component_id"))
