"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of an item (or all of a shorter item);
equal windows of several items are one, and items come in after the match. It
is taken as the set of its shingles, ordered by how often they occur in all
documents. Containment of the whole set is asked for, so the prefix that a
document must share is one shingle: the rarest. Documents meet windows on it;
the place of the shingle gives the only start the window can have, bounds on
position and length drop what can't fit, and the words are then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.store import written
from tidewatch.llm.words import ascii_lower

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words to a shingle and to a window.
SHINGLE, WIDTH = 3, 13
#: The benchmark's shingles are sent to all tasks up to this number (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def item_words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _shingle(words: str, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + k) for k in range(length)])


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, words, window): the windows of each item, once each; ``window`` is a digest of the words. Items without words have none."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = items.select("item_id", F.col("words").alias("all"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))).alias("start"))
    sets = starts.select("item_id", F.slice("all", F.col("start") + 1, F.lit(width)).alias("words"))
    return sets.withColumn("window", F.sha2(F.array_join("words", " "), 256)).dropDuplicates(["item_id", "window"])


def windows(of_items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(window, words, len, kind, off, g): each distinct window's shingles with their place.

    Windows shorter than a shingle are one shingle of their own length. ``kind`` is the length of the shingle.
    """
    sets = of_items.select("window", "words").dropDuplicates(["window"])
    sets = sets.withColumn("len", F.size("words")).withColumn("kind", F.least(F.lit(shingle), F.col("len")))
    placed = sets.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("kind"))))
    hashes = F.coalesce(*[F.when(F.col("kind") == k, _shingle("words", F.col("off"), k)) for k in range(1, shingle + 1)])
    return placed.withColumn("g", hashes)


def _words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), item_words(F.col("text")).alias("words"))


def _positions(docs: DataFrame, kinds: list[int], carry: bool) -> DataFrame:
    """(doc_id, text_key, n_words, pos, g) of each shingle of each kind in each document, with the document's words if asked for."""
    at = _words(docs).select("doc_id", "text_key", "words", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word"))
    keys = F.array(*[F.when(F.col("pos") + k <= F.col("n_words"), _shingle("words", F.col("pos"), k)) for k in kinds])
    if len(kinds) == 1:
        out = at.withColumn("g", keys[0]).filter("g is not null")
    else:
        out = at.withColumn("g", F.explode(keys)).filter("g is not null")
    return out.select("doc_id", "text_key", "n_words", "pos", "g", *(["words"] if carry else []))


def contained_windows(docs: DataFrame, of_items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, text_key, start, len, window) of every occurrence of every window in every document."""
    spark = docs.sparkSession
    grams = written(windows(of_items, shingle), "decontam-windows")
    size, kinds = grams.agg(F.count(F.lit(1)), F.array_sort(F.collect_set("kind"))).first()
    if not size:
        return spark.createDataFrame([], "doc_id bigint, text_key bigint, start int, len int, window string")
    small = size <= broadcast_shingles
    vocabulary = grams.select("g").distinct()
    counted = _positions(docs, kinds, False).join(_hinted(vocabulary, small), "g").groupBy("g").count()
    rarity = written(counted, "decontam-rarity")
    # a window with a shingle that no document has occurs nowhere; of the others the rarest is the prefix
    by_rarity = Window.partitionBy("window").orderBy("n", "g", "off")
    ordered = grams.join(_hinted(rarity.withColumnRenamed("count", "n"), small), "g", "left").fillna(0, ["n"])
    prefix = written(ordered.withColumn("rank", F.row_number().over(by_rarity)).filter("rank = 1 and n > 0").select("g", "off", "len", "words", "window"), "decontam-prefix")

    keys = prefix.select("g").distinct()
    around, first = F.lit(2 * width), F.greatest(F.col("pos") - width, F.lit(0))
    near = F.slice("words", first + 1, around).alias("near")
    if small:  # nothing is shuffled between here and the match, so a document's words are at hand
        hits = _positions(docs, kinds, True).join(F.broadcast(keys), "g").select("doc_id", "text_key", "n_words", "pos", "g", first.alias("from"), near)
    else:  # places are joined without the words, which are fetched for the documents that have some
        at = written(_positions(docs, kinds, False).join(keys, "g"), "decontam-places")
        some = _words(docs).join(at.select("text_key").distinct(), "text_key").dropDuplicates(["text_key"]).select("text_key", "words")
        hits = at.join(some, "text_key").select("doc_id", "text_key", "n_words", "pos", "g", first.alias("from"), near)
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.slice("near", start - F.col("from") + 1, F.col("len")) == F.col("words")
    found = hits.join(_hinted(prefix, small), "g").filter(fits).filter(same)
    return found.select("doc_id", "text_key", start.alias("start"), "len", "window").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, share: int = 20, broadcast_shingles: int = BROADCAST_SHINGLES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted ids as text), contaminated (n_hit > 0 and share * n_hit >= n_words).

    Null and empty texts have no words and are clean; items without words are ignored, as are columns not named here. Rows
    with the same id are judged each on its own text, null ids too; equal rows get equal results. Items with the same id are
    one item. ``keep`` passes columns of ``docs`` on.
    """
    own = docs.select("doc_id", "text")
    of_items = written(item_windows(benchmark.select("item_id", "text"), width), "decontam-item-windows")
    found = written(contained_windows(own, of_items, width, shingle, broadcast_shingles), "decontam-found")
    spans = found.select("doc_id", "text_key", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest(F.col("start"), F.least(F.col("end"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.withColumn("new", new).groupBy("doc_id", "text_key").agg(F.sum("new").alias("n_hit"))
    owners = found.select("doc_id", "text_key", "window").distinct().join(of_items.select("window", "item_id"), "window")
    items = owners.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_doc = hit.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "t").join(
        items.withColumnRenamed("doc_id", "d2").withColumnRenamed("text_key", "t2"), F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2"))
    ).select("d", "t", "n_hit", "items")
    # the count needs no lower-casing: A-Z are letters here
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")
    left = docs.select("doc_id", F.xxhash64("text").alias("text_key"), n_words.alias("n_words"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    joined = left.join(written(per_doc, "decontam-hits"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep if c != "doc_id"],
    )
