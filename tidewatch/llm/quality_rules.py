"""Quality rules learned as a decision list.

Statistics of a text are Spark expressions. On a bounded sample of labelled
rows, sequential covering grows conjunctions of thresholds for the bad label,
prunes each on rows it wasn't grown on, and keeps those that stay precise. The
list is emitted as one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.store import written
from tidewatch.llm.words import SPACE, space_words

#: Labelled rows that the list is learned from at most, taken in the order of a hash of their id.
FIT_ROWS = 20_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbols", "repeats", "dup_lines", "upper", "stutter", "distinct")


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the statistics of the text, and the figures that rules are learned on).

    Whole texts; a null or empty text has only zeros. ``keep`` passes columns of ``docs`` on, as ``_keep_<name>``. Rows with the same id are
    judged each on its own text. Windows of three words are told apart by hashes of 64 bits: a text would need some 1e8 of them to expect
    one mistake in a thousand texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [f"_keep_{c}" for c in keep]
    split = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), space_words(text).alias("w"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    # a window of three words as one number; only rows in which some number repeats are looked at more closely
    three = F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    )
    hashed = split.withColumn("g", three)
    same_next = lambda a, i: F.coalesce(F.get(a, i + 1)["h"] == F.get(a, i)["h"], F.lit(False))
    placed = F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_g = hashed.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), placed))
    twice = F.filter("s", lambda x, i: same_next("s", i) | ((i > 0) & same_next("s", i - 1)))
    at = sorted_g.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^" + SPACE[1:]))
    one = at.select(
        "doc_id",
        *kept,
        F.size("w").alias("n_words"),
        (F.length("text") - F.length(F.regexp_replace("text", SPACE + "+", ""))).alias("n_space"),
        F.length("text").alias("n_text"),
        (F.size(F.split("text", "[#*$%&|<>]")) - 1).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.size(lines).alias("n_lines"),
        F.coalesce(covered, F.lit(0)).alias("n_repeat_words"),
        (F.size(F.split("text", "[A-ZÀ-ÖØ-Þ]")) - 1).alias("n_upper"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )
    n, chars = F.col("n_words"), F.col("n_text") - F.col("n_space")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return one.select(
        "doc_id",
        *kept,
        *[F.col(c).cast("long").alias(c) for c in ("n_words", "n_symbols", "n_dup_lines", "n_repeat_words")],
        chars.cast("long").alias("word_chars"),
        n.cast("double").alias("words"),
        share(chars, n).alias("word_length"),
        share(F.col("n_symbols"), n).alias("symbols"),
        share(F.col("n_repeat_words"), n).alias("repeats"),
        share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_lines"),
        share(F.col("n_upper"), chars).alias("upper"),
        share(n, F.col("n_distinct")).alias("stutter"),
        share(F.col("n_distinct"), n).alias("distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the text is bad. Counts are those of the rows that pruned it."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" -> bad ({self.bad} bad, {self.good} good)"


def _counts(rows: list[dict], conditions: tuple[Condition, ...]) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in conditions)]
    return sum(hit), len(hit) - sum(hit)


def _best(rows: list[dict], features: tuple[str, ...], now: float) -> Condition | None:
    """The threshold with the largest gain in information about the bad rows it covers."""
    best, gain = None, 1e-9
    for f in features:
        values = sorted((r[f], r["bad"]) for r in rows)
        all_bad = sum(b for _, b in values)
        bad = 0
        for k in range(1, len(values)):
            bad += values[k - 1][1]
            if values[k][0] == values[k - 1][0]:
                continue
            middle = (values[k][0] + values[k - 1][0]) / 2
            for above, p, n in ((False, bad, k), (True, all_bad - bad, len(values) - k)):
                if p and (g := p * (math.log2((p + 1) / (n + 2)) - now)) > gain:
                    best, gain = Condition(f, above, middle), g
    return best


def learn_rules(rows: list[dict], features: tuple[str, ...] = FEATURES, max_rules: int = 12, max_conditions: int = 3, precision: float = 0.95, least: int = 3) -> list[Rule]:
    """Sequential covering. ``rows`` are dicts of the features, ``bad`` (0 or 1) and ``grow`` (else the row prunes).

    A rule is kept if it covers ``least`` bad rows at ``precision`` or better among the rows that prune.
    """
    grow, prune = [r for r in rows if r["grow"]], [r for r in rows if not r["grow"]]
    rules: list[Rule] = []
    while len(rules) < max_rules and any(r["bad"] for r in grow):
        covered, conditions = grow, ()
        while len(conditions) < max_conditions and any(not r["bad"] for r in covered):
            now = math.log2((sum(r["bad"] for r in covered) + 1) / (len(covered) + 2))
            if (c := _best(covered, features, now)) is None:
                break
            conditions += (c,)
            covered = [r for r in covered if c.holds(r)]
        if not conditions:
            break

        def worth(cs: tuple[Condition, ...]) -> float:
            bad, good = _counts(prune, cs)
            return (bad - good) / (bad + good) if bad + good else -1.0

        while len(conditions) > 1:
            shorter = max((conditions[:k] + conditions[k + 1 :] for k in range(len(conditions))), key=worth)
            if worth(shorter) < worth(conditions):
                break
            conditions = shorter
        bad, good = _counts(prune, conditions)
        if bad < least or bad < precision * (bad + good):
            break
        rules.append(Rule(conditions, bad, good))
        left = lambda rs, cs=conditions: [r for r in rs if not all(c.holds(r) for c in cs)]
        grow, prune = left(grow), left(prune)
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), null if none does, as one ordered conditional."""
    out = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules, 1))):
        out = F.when(r.column(), F.lit(k)).otherwise(out)
    return out


def fit_rules(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> list[Rule]:
    """Rules from at most ``fit_rows`` labelled rows (quality 0 or 1); no labels, or one kind only, give no rules."""
    sample = labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality").distinct()
    sample = sample.withColumn("mix", F.xxhash64("doc_id", F.lit(5))).orderBy("mix", "doc_id", "quality").limit(fit_rows)
    rows = stats.filter(~base_failed()).join(F.broadcast(sample), "doc_id").select("mix", "quality", *FEATURES).orderBy("mix", *FEATURES, "quality").limit(fit_rows)
    data = [r.asDict() | {"bad": int(r["quality"] == 0), "grow": r["mix"] % 3 != 0} for r in rows.collect()]
    return learn_rules(data, **options)


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, **options) -> tuple[DataFrame, list[Rule]]:
    """The statistics with ``base_failed``, ``rule`` (the first that holds) and ``kept``; and the rules.

    Every row of ``docs`` gives one row, repeated ids and null ids included; null texts fail the base rule. Extra columns of
    either table are ignored.
    """
    stats = written(text_stats(docs), "quality-stats")
    rules = fit_rules(stats, labels, fit_rows, **options)
    judged = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules_column(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
