"""Second versions of what the quality operators decide, and odd rows for the pipeline's stages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import BASE, ODD, ODD_IDS, documents
from tests.oracle import DATA
from tidewatch.llm import quality_rules, site_quality
from tidewatch.llm.store import table, written

# --- site quality


def moments(groups, least=5.0, most=10_000.0):
    """Pseudo-documents from (n, rate, target)."""
    total = sum(n for n, *_ in groups)
    if len(groups) < 2:
        return most
    within = sum(n * t * (1 - t) for n, _, t in groups) / total
    between = sum(n * (r - t) ** 2 for n, r, t in groups)
    spread = max(0.0, (between - within * (len(groups) - 1)) / (total - sum(n * n for n, *_ in groups) / total))
    return min(most, max(least, within / spread - 1)) if spread > 0 else most


def test_site_posteriors_equal_loops(spark):
    rng = random.Random(6)
    rows = []
    for h in range(12):
        lean = rng.uniform(-3, 3)
        for p in range(rng.randint(1, 4)):
            rows += [(rng.choice([f"h{h}", None]) if h == 3 else f"h{h}", f"p{p}" if p else None, lean + rng.uniform(-1, 1)) for _ in range(rng.choice([1, 3, 40]))]
    prior = 0.7
    got = {(r.host, r.path): r.rate for r in site_quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"), prior).collect()}
    good = [(h, p, 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior)))))) for h, p, e in rows]
    rate = (sum(g for *_, g in good) + prior) / (len(good) + 1)
    hosts, paths = {}, {}
    for h, p, g in good:
        for table_, key in ((hosts, h), (paths, (h, p))):
            n, s = table_.get(key, (0, 0.0))
            table_[key] = n + 1, s + g
    k = moments([(n, s / n, rate) for n, s in hosts.values()])
    host_rate = {h: (s + k * rate) / (n + k) for h, (n, s) in hosts.items()}
    k = moments([(n, s / n, host_rate[h]) for (h, _), (n, s) in paths.items()])
    want = {key: min(0.999, max(0.001, (s + k * host_rate[key[0]]) / (n + k))) for key, (n, s) in paths.items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_text_model_is_the_penalised_optimum(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Word", "other", "#x", "AB|C"]) if rng.random() < 0.5 or i % 3 else "plain" for _ in range(rng.randint(5, 120))) for i in range(300)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i % 10 == 1), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    model = site_quality.fit_text_model(docs, labels)
    rows = quality_rules.text_stats(docs).join(labels, "doc_id").select("quality", *[f.alias(n) for n, f in site_quality.features().items()]).collect()
    data = np.array([tuple(r) for r in rows], float)
    y, x = data[:, 0], data[:, 1:]
    scale, mean = x.std(axis=0) + 1e-6, x.mean(axis=0)
    w = np.array(model.weights) * scale
    bias = model.bias + np.log(model.prior / (1 - model.prior)) + np.array(model.weights) @ mean
    z = (x - mean) / scale
    p = 1 / (1 + np.exp(-(z @ w + bias)))
    assert np.abs(z.T @ (p - y) + w).max() < 1e-4 and abs((p - y).sum()) < 1e-3


def test_sites_of_pages_are_hosts_and_paths(spark):
    rows = [(i, f"https://{h}.example/{p}/{i}", t) for i, (h, p, t) in enumerate([("good", "news", BASE)] * 30 + [("bad", "ads", "# | # |")] * 30 + [("bad", "blog", "# | # |")] * 3)]
    pages = spark.createDataFrame(rows, "doc_id bigint, url string, text string")
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(0, 60, 2)], "doc_id bigint, quality int, toxic int")
    host, path = F.parse_url("url", F.lit("HOST")), F.element_at(F.split(F.parse_url("url", F.lit("PATH")), "/"), 2)
    got = site_quality.site_quality(pages, labels, host=host, path=path, keep=("url",)).collect()
    rate = {r.url.split("/")[2:4][0] + "/" + r.url.split("/")[3]: r.site_rate for r in got}
    assert rate["bad.example/ads"] < 0.3 < 0.7 < rate["good.example/news"] and all(r.kept == ("good" in r.url) for r in got)


# --- quality rules


def covering(rows, features):
    """The learner once more, by trying every threshold in plain loops."""

    def split(rs, conds):
        hit = [r for r in rs if all((r[f] > t) if up else (r[f] <= t) for f, up, t in conds)]
        return sum(r["bad"] for r in hit), sum(1 - r["bad"] for r in hit), hit

    grow, prune, rules = [r for r in rows if r["grow"]], [r for r in rows if not r["grow"]], []
    while len(rules) < 12 and any(r["bad"] for r in grow):
        conds = []
        covered = grow
        while len(conds) < 3 and any(not r["bad"] for r in covered):
            base = math.log2((sum(r["bad"] for r in covered) + 1) / (len(covered) + 2))
            best, gain = None, 1e-9
            for f in features:
                seen = sorted({r[f] for r in covered})
                for a, b in zip(seen, seen[1:], strict=False):
                    t = (a + b) / 2
                    for up in (False, True):
                        p, q, _ = split(covered, [(f, up, t)])
                        if p and p * (math.log2((p + 1) / (p + q + 2)) - base) > gain + 1e-12:
                            best, gain = (f, up, t), p * (math.log2((p + 1) / (p + q + 2)) - base)
            if best is None:
                break
            conds.append(best)
            covered = split(covered, [best])[2]
        if not conds:
            break

        def worth(cs):
            p, q, _ = split(prune, cs)
            return (p - q) / (p + q) if p + q else -1.0

        while len(conds) > 1:
            shorter = max((conds[:k] + conds[k + 1 :] for k in range(len(conds))), key=worth)
            if worth(shorter) < worth(conds):
                break
            conds = shorter
        p, q, _ = split(prune, conds)
        if p < 3 or p < 0.95 * (p + q):
            break
        rules.append(conds)
        grow, prune = ([r for r in rs if r not in split(rs, conds)[2]] for rs in (grow, prune))
    return rules


def test_rules_equal_a_second_covering():
    rng = random.Random(9)
    features, found = ("words", "symbols", "upper"), 0
    for noise in (0.0, 0.0, 0.01, 0.02):
        rows = []
        for i in range(240):
            r = {f: round(rng.random(), 2) for f in features} | {"grow": i % 3 != 0, "id": i}
            rows.append(r | {"bad": int(r["symbols"] > 0.7 and r["upper"] < 0.6 or r["words"] > 0.9 or rng.random() < noise)})
        got = [[(c.feature, c.above, c.threshold) for c in r.conditions] for r in quality_rules.learn_rules(rows, features=features)]
        assert got == covering(rows, features)
        found += len(got)
    assert found >= 4


def test_the_emitted_list_decides_as_the_rules(spark):
    rules = [quality_rules.Rule((quality_rules.Condition("symbols", True, 0.5), quality_rules.Condition("words", False, 3.0)), 5, 0), quality_rules.Rule((quality_rules.Condition("upper", True, 0.4),), 5, 0)]
    rng = random.Random(1)
    rows = [(rng.choice([0.4, 0.5, 0.6]), rng.choice([2.0, 3.0, 4.0]), rng.choice([0.3, 0.5])) for _ in range(60)]
    got = spark.createDataFrame(rows, "symbols double, words double, upper double").withColumn("rule", quality_rules.rules_column(rules)).collect()
    assert all(r.rule == (1 if r.symbols > 0.5 and r.words <= 3 else 2 if r.upper > 0.4 else None) for r in got)


# --- decontamination


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_preamble_of_many_items(spark, broadcast):
    """One window that 400 items share is matched once for each place, and gives all its items."""
    from tidewatch.llm import decontam

    preamble = " ".join(f"read{i}" for i in range(13))
    items = [(i, f"{preamble} item{i}") for i in range(400)]
    texts = [f"x {preamble} y {preamble}", preamble + " item7", "nothing", None, "far " * 3000 + preamble]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    of_items = decontam.item_windows(bench)
    assert decontam.contained_windows(documents(spark, texts), of_items, broadcast_shingles=broadcast).count() == 2 + 2 + 1
    got = {r.doc_id: (r.n_hit, len(r.items), r.contaminated) for r in decontam.decontaminate(documents(spark, texts), bench, broadcast_shingles=broadcast).collect()}
    assert got == {0: (26, 400, True), 1: (14, 400, True), 2: (0, 0, False), 3: (0, 0, False), 4: (13, 400, False)}
    assert decontam.decontaminate(documents(spark, ["x"]).limit(0), bench, broadcast_shingles=broadcast).count() == 0


# --- pipeline


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_odd_rows_and_empty_tables(spark, stage):
    import corpus_pipeline as c

    name, f = c.STAGES[stage]
    odd = documents(spark, ODD, ODD_IDS)
    out = written(f(spark, odd, DATA), f"odd-{name}")
    assert out.columns == list(c.COLUMNS)
    rows = {(r.doc_id, r.text) for r in out.collect()}
    given = set(zip(ODD_IDS, ODD, strict=True))
    if name == "near_dedup":  # texts 5, 6 and 7 are alike; texts without words stay
        assert rows <= given and {(None, None), (1, ""), (2, " \t\n"), (5, BASE)} <= rows and len([t for _, t in rows if t and t.startswith("Alpha") and len(t) < 1000]) == 1
    elif name in ("decontamination", "personal_data"):
        assert rows == given and out.count() == len(ODD)
    else:
        assert rows <= given
    if name == "mixing":
        assert out.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 6
    empty = f(spark, odd.limit(0), DATA)
    assert empty.columns == list(c.COLUMNS) and empty.count() == 0


def test_pipeline_documents_come_from_the_input(spark):
    import corpus_pipeline as c

    docs = table(spark, DATA, "documents")
    out = c.run(spark, DATA)
    known = docs.select("doc_id", "lang", "source")
    assert out.join(known, ["doc_id"]).count() == out.count() > 0
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
