"""Quality classifier by hierarchical empirical Bayes.

``documents`` has no url, so its source and language stand in for host and
path; with urls these are columns of the caller (``host``, ``path``).

A logistic model of text statistics gives each document's evidence. Sites
(hosts) and parts of sites (paths) get posteriors from the soft counts of good
documents: a host is shrunk toward the global rate and a path toward its host,
by as many pseudo-documents as the spread between them suggests. A document's
posterior joins its evidence with the posterior of its path, so a sparse site
leaves the decision to the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.quality_rules import text_stats
from tidewatch.llm.store import written

#: Labelled rows that the text model is fitted on at most, and site rows that are sent to all tasks at most.
FIT_ROWS, BROADCAST_SITES = 20_000, 50_000
STATS = ("words", "word_length", "symbols", "dup_lines", "upper", "stutter", "distinct")
#: Pseudo-documents are kept between these; a site's rate can move the log odds by MOST at the most.
LEAST_SHRINK, MOST_SHRINK, MOST = 5.0, 10_000.0, 2.0


def features() -> dict[str, Column]:
    """Bounded figures of a text's statistics."""
    c = F.col
    return {
        "log_words": F.log1p(c("words")),
        "few_words": F.when(c("words") < 50, 1.0).otherwise(0.0),
        "word_length": F.least(c("word_length"), F.lit(20.0)),
        "symbols": F.least(c("symbols"), F.lit(1.0)),
        "some_symbols": F.when(c("symbols") > 0.1, 1.0).otherwise(0.0),
        "dup_lines": c("dup_lines"),
        "upper": c("upper"),
        "stutter": F.least(F.log(F.greatest(c("stutter"), F.lit(1.0))), F.lit(3.0)),
        "lean": F.when((c("distinct") < 0.35) & (c("words") < 2000), 1.0).otherwise(0.0),
    }


@dataclass(frozen=True)
class TextModel:
    """Log odds of good, less the log odds of the sample, are ``bias + sum(weights * features)``."""

    bias: float
    weights: tuple[float, ...]
    prior: float

    def evidence(self) -> Column:
        out = F.lit(self.bias)
        for w, f in zip(self.weights, features().values(), strict=True):
            out = out + F.lit(w) * f
        return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), out))


def fit_text_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, ridge: float = 1.0) -> TextModel:
    """Logistic regression by Newton's steps on a sample bounded by ``fit_rows``; without both labels, no evidence."""
    sample = labels.filter("quality is not null and doc_id is not null").select("doc_id", "quality").distinct()
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "quality").limit(fit_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = text_stats(chosen, keep=("quality",)).select("_keep_quality", *[f.alias(n) for n, f in features().items()]).orderBy(*range(1, len(features()) + 2)).limit(fit_rows).collect()
    data = np.array([tuple(r) for r in rows], float).reshape(len(rows), len(features()) + 1)
    y, x = data[:, 0], data[:, 1:]
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(set(y)) < 2:
        return TextModel(0.0, (0.0,) * x.shape[1], prior)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    bias = float(w[0] - weights @ mean - np.log(prior / (1 - prior)))
    return TextModel(bias, tuple(float(v) for v in weights), prior)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _shrink(rates: DataFrame, rate: str, n: str, target: str) -> float:
    """Pseudo-documents by the method of moments: how far the groups' rates spread beyond chance around their targets."""
    w = rates.agg(
        F.sum(F.col(n)).alias("n"), F.sum(F.col(n) * F.col(target) * (1 - F.col(target))).alias("within"),
        F.sum(F.col(n) * F.pow(F.col(rate) - F.col(target), 2)).alias("between"), F.count(F.lit(1)).alias("groups"), F.sum(F.col(n) * F.col(n)).alias("n2"),
    ).first()
    if not w["n"] or w["groups"] < 2:
        return MOST_SHRINK
    v = w["within"] / w["n"]
    size = w["n"] - w["n2"] / w["n"]
    spread = max(0.0, (w["between"] - v * (w["groups"] - 1)) / max(size, 1e-9))
    return float(min(MOST_SHRINK, max(LEAST_SHRINK, v / spread - 1 if spread > 0 else MOST_SHRINK)))


def site_posteriors(evidence: DataFrame, prior: float) -> DataFrame:
    """(host, path, rate): posteriors from rows (host, path, evidence), null hosts and paths being groups of their own."""
    good = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(prior / (1 - prior))))))
    paths = written(evidence.groupBy("host", "path").agg(F.sum(good).alias("good"), F.count(F.lit(1)).alias("n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good_h"), F.sum("n").alias("n_h"))
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    rate = ((total[0] or 0.0) + prior) / ((total[1] or 0) + 1)
    hosts = hosts.withColumn("rate_h", F.col("good_h") / F.col("n_h")).withColumn("global", F.lit(rate))
    k_host = _shrink(hosts, "rate_h", "n_h", "global")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good_h") + k_host * rate) / (F.col("n_h") + k_host)).alias("host_rate"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).withColumn("rate_p", F.col("good") / F.col("n"))
    k_path = _shrink(both, "rate_p", "n", "host_rate")
    posterior = (F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)
    return both.select("host", "path", F.least(F.lit(0.999), F.greatest(F.lit(0.001), posterior)).alias("rate"), F.lit(float(rate)).alias("global_rate"))


def site_quality(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5, fit_rows: int = FIT_ROWS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, n_words, evidence, site_rate, score, kept), one row for each row of ``docs``.

    ``host`` and ``path`` default to source and language; for pages they are parts of the url. ``score`` is the posterior
    that the document is good, ``kept`` that it is at least ``threshold``. Null and empty texts have the evidence of zero
    statistics; null hosts, paths and ids and repeated rows are ordinary; columns not named in ``keep`` are ignored. Without
    labels of both kinds the text gives no evidence and every row has the same score.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit_text_model(docs, labels, fit_rows)
    named = docs.select("doc_id", "text", host.cast("string").alias("_host"), path.cast("string").alias("_path"), *[F.col(c).alias(f"k_{c}") for c in keep])
    stats = text_stats(named, keep=("_host", "_path", *[f"k_{c}" for c in keep]))
    judged = stats.select("doc_id", F.col("_keep__host").alias("host"), F.col("_keep__path").alias("path"), "n_words", model.evidence().alias("evidence"), *[F.col(f"_keep_k_{c}").alias(f"k_{c}") for c in keep])
    if not keep:
        judged = written(judged, "quality-evidence")
    sites = written(site_posteriors(judged, model.prior), "quality-sites").withColumnsRenamed({"host": "h", "path": "p"})
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    joined = judged.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    shift = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), _logit(F.col("rate")) - _logit(F.col("global_rate"))))
    base = float(np.log(model.prior / (1 - model.prior)))
    score = 1 / (1 + F.exp(-(F.col("evidence") + base + shift)))
    return joined.select(
        "doc_id", "n_words", "evidence", F.col("rate").alias("site_rate"), score.alias("score"), (score >= threshold).alias("kept"), *[F.col(f"k_{c}").alias(c) for c in keep if c != "doc_id"]
    )
