"""Near-duplicates by HyperMinHash.

A text's set of word shingles is sketched by K buckets; each keeps, of the
least hash it saw, the count of leading zeros and the bits after the first
one. Bands of four packed buckets are the keys on which texts meet. The share
of equal buckets, corrected for equal ones by chance, estimates the Jaccard
similarity and sorts out pairs that are far off; the rest are confirmed on
their full sets.

Texts with the same set are one class, so copies never pair up. In a band's
group every member is held against the smallest first; what is then in one
component needs no more pairs. Groups that still join several components are
compared in blocks: all pairs of a block are looked at inside a task, first by
their sketches and, where these look alike, by their full sets, and only links
that join two components leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import hashed
from tidewatch.llm.store import written

SHINGLE, SIMILARITY = 4, 80
BUCKETS, BAND, MANTISSA = 128, 4, 10
#: Rows to a block of a large group: its pairs are dealt out as (rows / BLOCK) blocks for each row.
BLOCK = 2048
#: Ids of documents whose texts are compared, sent to all tasks up to this number (16 bytes each).
BROADCAST_IDS = 500_000
_MULTIPLY = hashed.mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * hashed.BASE) | np.uint64(1)
_ADD = hashed.mix(np.arange(1001, 1001 + BUCKETS, dtype=np.uint64) * hashed.BASE)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty: K numbers of 16 bits, 6 for leading zeros and 10 for what follows."""
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 256):
        np.minimum(least, (shingles[k : k + 256, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    bits = np.frexp((least & ~np.uint64(0x7FF)).astype(np.float64))[1]
    zeros = np.clip(64 - bits, 0, 63).astype(np.uint64)
    rest = np.where(zeros < 63, (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA), np.uint64(0))
    return (zeros << np.uint64(MANTISSA) | rest).astype("<u2")


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of buckets that two disjoint sets of n and m shingles have equal by chance."""
    ratio = np.maximum(n, m) / np.minimum(n, m)
    return 0.169919487159739 / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal buckets."""
    by_chance = chance(n, m)
    return np.maximum(0.0, (equal / BUCKETS - by_chance) / (1 - by_chance))


#: Estimates under this go: five deviations of the estimate below the similarity that is asked for.
def least_estimate(similarity: int = SIMILARITY) -> float:
    j = similarity / 100
    return j - 5 * (j * (1 - j) / BUCKETS) ** 0.5


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashed.slices(whole):
                word, rows = hashed.words(batch.column(2))
                n, one, two, sketch = [], [], [], []
                for a, b in zip(rows[:-1], rows[1:], strict=True):
                    own = hashed.shingle_set(word[a:b], shingle)
                    n.append(len(own))
                    one.append(int(np.add.reduce(hashed.mix(own + np.uint64(1))).astype(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(hashed.mix(own ^ hashed.BASE)).astype(np.int64)) if len(own) else 0)
                    sketch.append(registers(own).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketch, pa.binary())],
                    ["doc_id", "text_key", "n", "fp1", "fp2", "sketch"],
                )

    return run


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, band) for each band of each sketch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, BUCKETS // BAND)
        keys = hashed.mix(packed + np.arange(BUCKETS // BAND, dtype=np.uint64) * hashed.BASE).astype(np.int64)
        rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BUCKETS // BAND)
        band = np.tile(np.arange(BUCKETS // BAND, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep, pa.int64()), pa.array(band)], ["key", "rep", "band"])


def _alike(similarity: int):
    """Keeps the pairs whose sketches look alike."""
    least = least_estimate(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, BUCKETS) for k in (2, 3))
            n, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (4, 5))
            keep = (estimate((a == b).sum(axis=1), n, m) >= least) & (100 * np.minimum(n, m) >= similarity * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _star_links(similarity: int):
    """Links (a, b) of rows (a, block, side, rep, set), sorted: the set of a hub comes first, then those that it is held against."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for k, block, side, rep, x in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                own = np.frombuffer(x, "<u8")
                if side == 0:
                    now, hub = (k, block), own
                elif now == (k, block):
                    both = len(np.intersect1d(hub, own, assume_unique=True))
                    if both and 100 * both >= similarity * (len(hub) + len(own) - both):
                        a.append(k)
                        b.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of equal (key, i, j) of sorted rows, each a batch of at most 2 * BLOCK rows."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        ids = [table.column(c).to_numpy() for c in ("key", "i", "j")]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
        edges = [0, *cuts.tolist()]
        for at, to in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(at, to - at).combine_chunks()
        held = table.slice(edges[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks()


class _Block:
    """Rows of a block pair, and for each the rows of other components that look alike and that this group has to compare.

    Two sketches meet in the groups of all bands they share; the first such band compares them, the others don't.
    """

    def __init__(self, table: pa.Table, similarity: int):
        self.similarity = similarity
        self.rep, self.comp, self.side, n = (table.column(c).to_numpy() for c in ("rep", "comp", "side", "n"))
        self.n = n.astype(float)
        self.band = table.column("band")[0].as_py()
        self.own = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u2").reshape(-1, BUCKETS)

    def alike(self) -> Iterator[tuple[int, np.ndarray]]:
        every = np.arange(len(self.rep))
        left, right = (every, every) if self.own else (np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1))
        least = least_estimate(self.similarity)
        for k in left:
            to = right[(self.comp[right] != self.comp[k]) & (self.rep[right] > self.rep[k] if self.own else self.rep[right] != self.rep[k])]
            to = to[100 * np.minimum(self.n[to], self.n[k]) >= self.similarity * np.maximum(self.n[to], self.n[k])]
            if len(to):
                equal = self.sketch[to] == self.sketch[k]
                first = equal.reshape(len(to), BUCKETS // BAND, BAND).all(axis=2).argmax(axis=1)
                yield k, to[(estimate(equal.sum(axis=1), self.n[to], self.n[k]) >= least) & (first == self.band)]


def _open_rows(similarity: int):
    """Of the rows of block pairs, those that look like some other that their group has to compare them with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            if table.num_rows < 2:
                continue
            keep = np.zeros(table.num_rows, bool)
            for k, to in _Block(table, similarity).alike():
                if len(to):
                    keep[k] = keep[to] = True
            if keep.any():
                yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _block_links(similarity: int):
    """Links (a, b) between components, confirmed on full sets: as many as join what can be joined, not all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            block, sets = _Block(table, similarity), [np.frombuffer(x, "<u8") for x in table.column("set").to_pylist()]
            joined: dict[int, int] = {}

            def top(c: int, joined: dict[int, int] = joined) -> int:
                while c in joined:
                    c = joined[c]
                return c

            a, b = [], []
            for k, to in block.alike():
                for j in to:
                    x, y = top(int(block.comp[k])), top(int(block.comp[j]))
                    if x == y:
                        continue
                    both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                    if 100 * both >= similarity * (len(sets[k]) + len(sets[j]) - both):
                        joined[max(x, y)] = min(x, y)
                        a.append(int(min(block.rep[k], block.rep[j])))
                        b.append(int(max(block.rep[k], block.rep[j])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashed.slices(whole):
                word, rows = hashed.words(batch.column(1))
                sets = [hashed.shingle_set(word[a:b], shingle).tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "set"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) can reach.

    In each round all nodes of a label take the least label that any of them has beside it, and then the label of that
    label, so distances to the root double; rounds are written tables.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "neardup-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "neardup-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooks = labels.join(near, labels["node"] == near["a"]).groupBy("label").agg(F.min(F.least("label", "near")).alias("to"))
        hooked = written(labels.join(hooks, "label").select("node", "label", "to"), "neardup-labels")
        up = hooked.select(F.col("node").alias("to"), F.col("to").alias("above"))
        new = written(hooked.join(up, "to").select("node", "label", F.least("to", "above").alias("new")), "neardup-labels")
        changed = new.filter("label <> new").agg(F.count(F.lit(1))).first()[0]
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept), one row for each row of ``docs``.

    Two documents are linked if ``100 * both >= similarity * either``; component_id is the smallest id reachable. Null and
    empty texts have no shingles and no links. Rows are members by their own text; equal sets share a class, whose key is
    a hash of the set, so null and repeated ids lose no link. Of a component the rows of the smallest id and, of these, of
    the smallest text_key are kept; only where all ids are null, a null one is. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    sets = written(base.mapInArrow(_sketches(shingle), "doc_id bigint, text_key bigint, n bigint, fp1 bigint, fp2 bigint, sketch binary"), "neardup-sketches")
    same = ["n", "fp1", "fp2"]
    stands = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    classes = written(sets.filter("n > 0").groupBy(*same).agg(F.min("text_key").alias("text_key"), F.min(stands).alias("stands")).withColumn("rep", F.xxhash64(*same)), "neardup-classes")
    first = sets.filter("n > 0").join(classes.select("rep", "text_key", *same), [*same, "text_key"])
    reps = written(first.select("rep", "text_key", "n", "sketch").dropDuplicates(["rep"]), "neardup-reps")

    keys = written(reps.select("rep", "sketch").mapInArrow(_band_keys, "key bigint, rep bigint, band int"), "neardup-keys")
    groups = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("a")).filter("members > 1"), "neardup-band-groups")
    # merged by sorting, as a join of this kind can split the rows of a key that very many sketches share
    grouped = written(keys.join(groups.hint("merge"), "key").select("key", "members", "a", "rep", "band"), "neardup-groups")
    sketch = reps.select("rep", "n", "sketch")
    side = lambda k: sketch.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))

    def texts(ids: DataFrame, name: str) -> DataFrame:
        """(doc_id, text) of some representatives; few of them are looked up without dealing out the documents."""
        need = written(reps.select(F.col("rep").alias("doc_id"), "text_key").join(ids.select("doc_id").distinct(), "doc_id"), f"{name}-ids")
        all_texts = base.select("text_key", "text")
        few = need.count() <= BROADCAST_IDS
        return written(all_texts.join(F.broadcast(need) if few else need, "text_key").dropDuplicates(["doc_id"]).select("doc_id", "text"), name)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that are similar on their full sets. A hub's set is sent once for each block of its pairs, however many these are."""
        own = texts(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), f"{name}-texts")
        full = own.select(F.col("doc_id").alias("rep"), "text").mapInArrow(_full_sets(shingle), "rep bigint, set binary")
        load = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), f"{name}-load")
        held = load.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("a").alias("rep"))
        asked = pairs.join(load.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), F.col("b").alias("rep"))
        rows = held.union(asked).join(written(full, f"{name}-sets"), "rep").select("a", "block", "side", "rep", "set")
        dealt = rows.repartition("a", "block").sortWithinPartitions("a", "block", "side", "rep")
        return written(dealt.mapInArrow(_star_links(similarity), "a bigint, b bigint"), name)

    stars = grouped.filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    seen = stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b", "n_a", "n_b")
    seen = written(seen.mapInArrow(_alike(similarity), "a bigint, b bigint"), "neardup-stars")
    links = confirmed(seen, "neardup-links")
    parts = written(components(links), "neardup-parts")

    # groups of three and more that still hold several components
    wide = grouped.filter("members > 2").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    wide = written(wide.select("key", "members", "rep", "band", "comp"), "neardup-wide")
    mixed = written(wide.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key"), "neardup-mixed")
    open_rows = wide.join(mixed.hint("merge"), "key").join(sketch, "rep")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp", "band",
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "n", "sketch",
    )
    by_group = lambda df: df.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j", "rep")
    shape = "key bigint, i int, j int, rep bigint, comp bigint, band int, side int, n bigint, sketch binary"
    still = written(by_group(dealt).mapInArrow(_open_rows(similarity), shape), "neardup-open")
    wanted = texts(still.select(F.col("rep").alias("doc_id")), "neardup-open-texts").select(F.col("doc_id").alias("rep"), "text")
    full = written(wanted.mapInArrow(_full_sets(shingle), "rep bigint, set binary"), "neardup-sets")
    more_links = written(by_group(still.join(full, "rep")).mapInArrow(_block_links(similarity), "a bigint, b bigint"), "neardup-links")
    parts = components(links.union(more_links))

    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*same, "stands", F.coalesce("component", "rep").alias("component"))
    of_class = written(of_class, "neardup-of-class")
    least = of_class.groupBy("component").agg(F.min("stands").alias("least"))
    out = sets.select("doc_id", "text_key", *same).join(of_class.join(least, "component").select(*same, "least"), same, "left")
    component = F.when(F.col("least").isNotNull(), F.col("least.id")).otherwise(F.col("doc_id"))
    kept = F.col("least").isNull() | F.col("doc_id").eqNullSafe(F.col("least.id")) & (F.col("text_key") == F.col("least.key"))
    return out.select(
        F.col("doc_id").alias(id_col),
        "text_key",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        kept.alias("kept"),
    )
