"""Personal data by weak supervision.

Patterns find spans. Those of the four base kinds that pass their check stay.
Looser candidates (secrets, account numbers, handles, names of people, street
addresses, mail addresses written out in words) get votes from labelers: the
shape of the span, a gazetteer of given names and of words that introduce
personal data, the words before it, how varied its characters are, and for base
kinds their check. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is, without labels; the posterior of each
pattern then trains a classifier over the span's features, and candidates that
it takes for personal data are added. What no pattern proposes isn't found: a
name, say, needs a title or a given name of the gazetteer. Everything that
touches text is a Spark expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.arrays import cut, let, running_max, running_sum
from tidewatch.llm.store import written

#: Base patterns in the order of the kinds. They match what the plain ones match, leftmost and without overlap:
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
#: ``[0-9]([\x20-]?[0-9])+`` and ``\+[0-9][\x20().0-9-]+[0-9]``. Possessive repeats and a look behind (or the end of the
#: match before) keep them linear on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*+(?:[1-9]?[0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

#: Given names, titles before names, kinds of street, and words that introduce personal data (fixed values).
GIVEN = (
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Daniel Karen Emma Oliver "
    "Hans Karl Klaus Peter Wolfgang Sabine Petra Ursula Anna Monika Pierre Jean Marie Claire Louis Camille Sophie Jose Juan Carlos Carmen Lucia Pablo Ana Luis Maria"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Madame Monsieur Señor Señora".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Square Way Place".split()
TRIGGERS = "password passwd pwd secret token key apikey login user account iban ssn contact follow mail email phone tel call card ip name address street live lives".split()
#: Looser patterns whose spans are voted on; the kind they would add. A secret is the whole run of its characters, but for full
#: stops at its end; an account number has the lengths that its standard allows; an address ends at its first kind of street.
#: Groups that repeat without bound are possessive: the engine walks them in a loop and not by recursion, whatever their length.
LOOSE = {
    "secret": r"(?<![A-Za-z0-9_])(?:AKIA[A-Z0-9]{12,}+|(?i:password|passwd|pwd|secret|token|api_?key)\s*+[=:]\s*+\x22?[A-Za-z0-9+/_.=~-]{6,}(?<!\.)\x22?)",
    "account": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|(?:\x20?[A-Z0-9]{4}){2}\x20?[A-Z0-9]{3})|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9])",
    "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z_][A-Za-z0-9_]{2,}+(?!@|\.[A-Za-z0-9])",
    "name": rf"(?<![A-Za-z])(?=[A-Z])(?:(?:{'|'.join(TITLES)})\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?|(?:{'|'.join(GIVEN)})\x20(?:[A-Z]\.\x20)?[A-Z][a-z]++)(?![A-Za-z])",
    "address": rf"(?<![A-Za-z0-9])[0-9]{{1,5}}\x20[A-Z][a-z]++\x20(?:(?!(?:{'|'.join(STREETS)})(?![A-Za-z]))[A-Z][a-z]++\x20)*+(?:{'|'.join(STREETS)})(?![A-Za-z])",
    "written": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20++|\x20*+[\[({]\x20*+)(?i:at)(?:\x20++|\x20*+[\])}]\x20*+)[A-Za-z0-9-]++(?:(?:\x20++|\x20*+[\[({]\x20*+)(?i:dot)(?:\x20++|\x20*+[\])}]\x20*+)[A-Za-z0-9-]++)++",
}
#: What a text must have, by a cheaper test, for its pattern to be tried.
NEEDS = {
    "email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "secret": "AKIA|[=:]", "account": "[0-9]{2}", "handle": "@",
    "name": "[A-Z][a-z]+\\.?\\x20[A-Z]", "address": "[0-9]\\x20[A-Z][a-z]", "written": "(?i)[^A-Za-z]dot[^A-Za-z]",
}
KINDS = (*BASE, *LOOSE)
BEFORE = 24
LABELERS = ("shape", "gazetteer", "context", "spread", "check")
FEATURES = (*LABELERS, "long", "digits")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    digits = F.regexp_replace(span, "[^0-9]", "")
    if kind == "ip":
        return span.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _votes(kind: str, span: Column, before: Column) -> list[Column]:
    """What each labeler says of a span: 1 personal, 0 not, -1 nothing."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    letters, digits = span.rlike("[A-Za-z]"), span.rlike("[0-9]")
    near = F.lower(F.concat(before, F.lit(" "), span))
    words = "|".join([*TRIGGERS, *[n.lower() for n in GIVEN]])
    distinct = F.size(F.array_distinct(F.split(span, "")))
    shape = {"name": span.rlike(r"[A-Z][a-z]+\x20(?:[A-Z]\.\x20)?[A-Z]"), "address": span.rlike(r"^[0-9]+\x20[A-Z]"), "written": span.rlike(r"(?i)\bat\b.*\bdot\b"), "account": digits}
    return [
        flag(F.length(span) >= 8) if kind in BASE else flag(shape.get(kind, letters & digits)),
        F.when(near.rlike(rf"(?<![a-z])(?:{words})(?![a-z])"), 1).otherwise(-1),
        F.when(before.rlike(r"(?:[:=]|\b(?:is|for|at|to))\s*$"), 1).when(before.rlike(r"[A-Za-z0-9]$"), 0).otherwise(-1),
        flag(distinct >= 6),
        flag(_valid(kind, span)) if kind in BASE else F.lit(-1),
    ]


def _found(kind: str) -> Column:
    """Array of the spans of a kind: start, end (code points), its votes and features; a base span also whether it is valid.

    The positions are sums over the parts between and the matches. Base matches that fail keep their votes for the
    estimation, and are marked.
    """
    between, spans = F.col(f"_b_{kind}"), F.col(f"_m_{kind}")

    def about(gap: Column, span: Column) -> Column:
        named = [v.alias(n) for n, v in zip(LABELERS, _votes(kind, span, F.right(gap, F.lit(BEFORE))), strict=True)]
        share = F.length(F.regexp_replace(span, "[^0-9]", "")) * 2 >= F.length(span)
        return F.struct(
            F.length(gap).alias("gap"), F.length(span).alias("len"), *named,
            F.when(F.length(span) >= 16, 1).otherwise(0).alias("long"), F.when(share, 1).otherwise(0).alias("digits"),
        )

    pairs = F.filter(F.zip_with(between, spans, lambda g, s: F.when(s.isNotNull(), about(g, s))), lambda x: x.isNotNull())
    span_type = "struct<kind:int,start:int,end:int," + ",".join(f"{n}:int" for n in FEATURES) + ">"
    ends = running_sum(F.transform(pairs, lambda x: x["gap"] + x["len"]))

    def placed(x: Column, end: Column) -> Column:
        named = [x[n].cast("int").alias(n) for n in FEATURES]
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), (end - x["len"]).cast("int").alias("start"), end.cast("int").alias("end"), *named)

    return F.when(F.size(spans) > 0, F.zip_with(pairs, ends, placed)).otherwise(F.array().cast(f"array<{span_type}>"))


def candidate_spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``docs`` with ``found``: its spans of every kind, base and loose, with votes and features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select(text.alias("_text"), "doc_id", *[F.col(c).alias(f"_keep_{c}") for c in keep])
    patterns = BASE | LOOSE
    none = F.array().cast("array<string>")
    has = {k: F.col("_text").contains("@") if NEEDS[k] == "@" else F.col("_text").rlike(NEEDS[k]) for k in KINDS}
    for k, p in patterns.items():
        raw = raw.withColumn(f"_m_{k}", F.when(has[k], F.regexp_extract_all("_text", F.lit(p), F.lit(0))).otherwise(none))
    for k, p in patterns.items():
        raw = raw.withColumn(f"_b_{k}", F.when(F.size(f"_m_{k}") > 0, F.split("_text", p)).otherwise(none))
    return raw.select("doc_id", F.concat(*[_found(k) for k in KINDS]).alias("found"), *[F.col(f"_keep_{c}") for c in keep])


@dataclass(frozen=True)
class SpanModel:
    """``prior``; for each labeler its chance to vote 1 on personal data and on other; the classifier's weights."""

    prior: float
    reliability: dict[str, tuple[float, float]]
    bias: float
    weights: dict[str, float]

    def score(self, span: Column) -> Column:
        out = F.lit(self.bias)
        for f, w in self.weights.items():
            out = out + F.lit(w) * span[f]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-out))


def estimate_reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[tuple[float, float]], list[float]]:
    """EM over (votes, count): the share of personal data, each labeler's two chances of voting 1, each pattern's posterior.

    Votes of -1 say nothing. It starts from the mean vote, which also settles which of the two classes is which.
    """
    post = [(sum(v == 1 for v in votes) + 0.5) / (sum(v >= 0 for v in votes) + 1) for votes, _ in patterns]
    prior, chances = 0.5, [(0.5, 0.5)] * len(LABELERS)
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = (sum(p * n for p, (_, n) in zip(post, patterns, strict=True)) + 1) / (total + 2)
        chances = []
        for k in range(len(LABELERS)):
            pair = []
            for personal in (True, False):
                w = [(p if personal else 1 - p) * n for p, (v, n) in zip(post, patterns, strict=True) if v[k] >= 0]
                ones = sum((p if personal else 1 - p) * n for p, (v, n) in zip(post, patterns, strict=True) if v[k] == 1)
                pair.append((ones + (1.2 if personal else 0.8)) / (sum(w) + 2))
            chances.append((pair[0], pair[1]))
        new = []
        for votes, _ in patterns:
            log_odds = math.log(prior / (1 - prior))
            for v, (a, b) in zip(votes, chances, strict=True):
                if v >= 0:
                    log_odds += math.log(a / b) if v else math.log((1 - a) / (1 - b))
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds)))))
        post = new
    return prior, chances, post


def train_classifier(rows: list[tuple[tuple[int, ...], float, int]], steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[float, list[float]]:
    """Logistic regression of posteriors on features: rows are (features, posterior, count)."""
    total = sum(n for *_, n in rows) or 1
    bias, weights = 0.0, [0.0] * len(FEATURES)
    for _ in range(steps):
        gb, gw = 0.0, [ridge * w for w in weights]
        for x, p, n in rows:
            z = bias + sum(w * v for w, v in zip(weights, x, strict=True))
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            gb += d
            for k, v in enumerate(x):
                gw[k] += d * v
        bias -= rate * gb
        weights = [w - rate * g for w, g in zip(weights, gw, strict=True)]
    return bias, weights


def fit_spans(candidates: DataFrame) -> SpanModel | None:
    """The model from the votes on all candidates: the driver sees one row for each pattern of votes and features (972 at most)."""
    one = candidates.select(F.explode("found").alias("s"))
    rows = one.groupBy(*[F.col(f"s.{f}").alias(f) for f in FEATURES]).count().orderBy(*FEATURES).collect()
    if not rows:
        return None
    patterns = [(tuple(r[f] for f in LABELERS), r["count"]) for r in rows]
    prior, chances, post = estimate_reliabilities(patterns)
    bias, weights = train_classifier([(tuple(r[f] for f in FEATURES), p, r["count"]) for r, p in zip(rows, post, strict=True)])
    return SpanModel(prior, dict(zip(LABELERS, chances, strict=True)), bias, dict(zip(FEATURES, weights, strict=True)))


def find_personal_data(docs: DataFrame, keep: tuple[str, ...] = (), threshold: float = 0.5) -> tuple[DataFrame, SpanModel | None]:
    """Each row with ``base`` and ``spans``: arrays of (start, kind, end), sorted, code points, end exclusive; and the model.

    ``kind`` is a place in KINDS. Null and empty texts have no spans; rows are independent, so null and repeated ids are
    nothing special; columns not named in ``keep`` are ignored. Whole texts are searched.
    """
    found = written(candidate_spans(docs, keep), "pii-spans")
    model = fit_spans(found)
    short = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    is_base = lambda s: s["kind"] < len(BASE)
    base = F.filter("found", lambda s: is_base(s) & (s["check"] == 1))
    taken = F.filter("found", lambda s: F.when(is_base(s), s["check"] == 1).otherwise(model.score(s) >= threshold if model else F.lit(False)))
    out = found.select(
        "doc_id", F.array_sort(F.transform(base, short)).alias("base"), F.array_sort(F.transform(taken, short)).alias("spans"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep if c != "doc_id"],
    )
    return out, model


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` for each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span as ``[KIND]``; of spans that overlap, the first stands for all up to where the last ends."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    #: Up to where the text is done before each span, and after the last.
    done = F.concat(F.array(F.lit(0).cast("long")), running_max(F.transform(spans, lambda s: s["end"])))

    def whole(v: Column) -> Column:
        starts = F.concat(F.transform(v["spans"], lambda s: s["start"].cast("long")), F.array(F.length(v["text"]).cast("long")))
        pieces = cut(v["text"], v["done"], F.zip_with(starts, v["done"], lambda a, b: F.greatest(a, b)))
        marks = F.transform(v["spans"], lambda s, i: F.when(s["start"] >= F.get(v["done"], i), F.get(names, s["kind"])).otherwise(""))
        return F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    return F.when(F.size(spans) > 0, let(F.struct(text.alias("text"), spans.alias("spans"), done.alias("done")), whole)).otherwise(text)
