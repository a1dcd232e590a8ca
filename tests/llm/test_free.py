import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import BASE, ODD, ODD_IDS, documents, lower, words
from tests.oracle import DATA
from tidewatch.llm import hashed, html_text, lm, neardup, site_quality, toxicity
from tidewatch.llm.registry import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/a">One</a></li></ul></nav><div class="ad">Buy a long and shiny thing today, it is really good and it is cheap, buy it.</div>
<article><h1>A &amp; B&nbsp;head</h1><p><b>Lead<br>line<p>First paragraph that is long enough to be dense text, with  spaces
and lines.</p><p>Short.</p><div class="comments"><p>A comment by a reader that is very long and would be dense.</p></div></article><aside>Side</aside><footer>&copy; me</footer>"""


def test_main_text():
    assert html_text.main_blocks(PAGE) == ["A & B head", "Lead line", "First paragraph that is long enough to be dense text, with spaces and lines.", "Short."]
    assert html_text.main_blocks(None) == html_text.main_blocks("") == html_text.main_blocks("<nav>x</nav>") == []
    plain = '<body><div id="header">Top</div><div class="content"><h1>T</h1><p>Long text here that goes on and on, and on &amp; on.<p>Short.</p><ul><li>a<li>b</ul></div><div class="comments"><p>I am a very long comment.</p></div>'
    assert html_text.main_blocks(plain) == ["T", "Long text here that goes on and on, and on & on.", "Short.", "a", "b"]
    assert len(html_text.main_blocks("<article>" + "<p>word word</p>" * 5000 + "</article>")) == 5000


def test_all_regions_of_a_page():
    long = [f"Sentence {i} is long enough to be dense text, with many words and few tags in it." for i in range(10)]
    p = lambda some: "".join(f"<p>{x}</p>" for x in some)
    head = '<body><nav><a href="/">Home</a></nav>'
    assert html_text.main_blocks(f"{head}<main><section>{p(long[:8])}</section><section>{p(long[8:])}</section></main>") == long
    assert html_text.main_blocks(f"{head}<article>{p(long[:8])}</article><article>{p(long[8:])}</article><footer>end</footer>") == long
    assert html_text.main_blocks(f'<body><form action="x.aspx"><nav><a>Home</a></nav><div>{p(long)}</div></form></body>') == long
    assert html_text.main_blocks(f'{head}<article>{p(long)}<form><p>Your name</p><input><button>Send</button></form></article>') == long


def test_wrappers_with_telling_names():
    long = [f"Sentence {i} is long enough to be dense text, with many words and few tags in it." for i in range(6)]
    body = "".join(f"<p>{x}</p>" for x in long)
    names = ["content with-sidebar", "no-sidebar", "post has-comments", "legal-news", "social-policy", "newsletter-archive", "ad-free article", "page-header-and-body", "sidebar", "comments", "main-content"]
    for name in names:
        assert html_text.main_blocks(f'<body><nav><a>Home</a></nav><div class="{name}">{body}</div><footer>end</footer></body>') == long, name
    for name in ["sidebar", "comments-area", "site-footer", "ad", "adBox", "cookie-banner", "newsletter-signup", "related-posts", "share-buttons", "nav menu", "comment-list", "page-header"]:
        page = f'<body><div class="post">{body}</div><div class="{name}"><p>{long[0]}</p><p>Another line that is as dense as the text of the article.</p></div></body>'
        assert html_text.main_blocks(page) == long, name
    lead = f"<body><div><p>{long[0]}</p></div><div>{body}</div></body>"
    assert html_text.main_blocks(lead) == [long[0], *long]
    spans = f'<body><p><span hidden>gone<p>{long[0]}</p><p>{long[1]} <span class="ad">buy <b>now</b></span> {long[2]}</p><p><b>{long[3]}</i></p></body>'
    assert html_text.main_blocks(spans) == [long[0], long[1], long[2], long[3]]


def test_pages_take_linear_time():
    for piece in ("<div>x ", "<b>x</i> ", "<div>word here <p>", "<span class=ad>x<div></div>", "<span hidden>", "<i><div></i>", "<li><h1>x", "</div>x"):
        took = []
        for n in (10_000, 40_000):
            start = time.process_time()
            html_text.main_blocks(piece * n)
            took.append(time.process_time() - start)
        assert took[1] < 3 and took[1] < 9 * took[0] + 0.2, (piece, took)


def brute_dense(sizes, tags, out):
    ratios = [0.0 if o else n / max(1, t) for n, t, o in zip(sizes, tags, out, strict=True)]
    smooth = []
    for i in range(len(ratios)):
        near = [(math.exp(-((i - j) ** 2) / 2), ratios[j]) for j in range(max(0, i - 3), min(len(ratios), i + 4))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    cut = upper = sum(smooth) / len(smooth)
    for _ in range(20):
        low, high = [v for v in smooth if v <= cut], [v for v in smooth if v > cut]
        if low and high:
            upper = sum(high) / len(high)
            cut = (sum(low) / len(low) + upper) / 2
    cut = min(cut, upper / 2)
    return [s >= cut - 1e-9 and r > 0 for s, r in zip(smooth, ratios, strict=True)]


def test_ratio_smoothing_and_clusters_equal_loops():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 40)
        sizes, tags, out = [rng.choice([3, 20, 90, 400]) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)], [rng.random() < 0.2 for _ in range(n)]
        want = brute_dense(sizes, tags, out)
        got = html_text.dense_lines(np.array(sizes), np.array(tags), np.array(out)).tolist()
        assert got == (want if any(want) else [not o for o in out])


def test_pages_query(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "u", "", "x"), (3, None, "<p>just text", "x")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id == 3} == {"just text"}
    assert html_text.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# --- near duplicates


def brute_components(ids, texts):
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if (w := words(lower(t))) else set() for t in texts]
    root = {i: i for i in range(len(ids))}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: (len(sets[i]), least[top(i)]) for i, d in enumerate(ids)}


def near_copies(rng, n):
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 3, 12])):
            copy = list(base)
            for _ in range(max(1, len(base) // rng.choice([25, 40, 60]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    texts = near_copies(rng, 60) + [None, "", " ", "One two", "one TWO", BASE, BASE, BASE.upper()]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, texts, ids)).collect()}
    assert got == brute_components(ids, texts)


def test_components_of_chains(spark):
    rng = random.Random(3)
    chain = rng.sample(range(10_000), 300)
    edges = [*zip(chain, chain[1:], strict=False), *zip(range(20_000, 20_200), range(20_001, 20_201), strict=True), (5, 10_001), (30_000, 30_000)]
    df = spark.createDataFrame([rng.choice([(a, b), (b, a)]) for a, b in edges], "a bigint, b bigint")
    got = {r.node: r.component for r in neardup.components(df).collect()}
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in root}


def test_one_hot_band(spark):
    rng = random.Random(1)
    hot = " ".join(f"h{i}" for i in range(150))
    texts = [hot + " " + " ".join(f"x{rng.randrange(9000)}" for _ in range(rng.choice([20, 45, 90]))) for _ in range(300)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute_components(list(range(300)), texts)


def test_near_duplicates_of_odd_rows(spark):
    out = neardup.near_duplicates(documents(spark, ODD, ODD_IDS)).collect()
    assert len(out) == len(ODD)
    assert {r.kept for r in out if r.doc_id == 5} == {True} and [r.component_id for r in out if r.doc_id == 7] == [5]
    assert neardup.near_duplicates(documents(spark, ["x"]).limit(0)).count() == 0


def test_pair_between_the_thresholds_of_four_and_five_words(spark):
    import corpus_pipeline as c

    one = [f"w{i}" for i in range(1000)]
    other = [f"x{i}" if i % 40 == 20 else w for i, w in enumerate(one)]  # 897 of 1,097 sets of four are common, 871 of 1,121 of five
    docs = documents(spark, [" ".join(one), " ".join(other)], [1, 2])
    assert [r.kept for r in neardup.near_duplicates(docs, shingle=4).orderBy("doc_id").collect()] == [True, False]
    assert [r.kept for r in neardup.near_duplicates(docs, shingle=5).orderBy("doc_id").collect()] == [True, True]
    assert c.drop_near_duplicates(spark, docs, DATA).count() == 2


def test_near_duplicates_of_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    texts = [one, two, two + " more", three, three + " more"]
    out = {r.text_key: r for r in neardup.near_duplicates(documents(spark, texts, [1, 1, 2, None, None]).repartition(1)).collect()}
    keys = [r.k for r in documents(spark, texts).orderBy("doc_id").select(F.xxhash64("text").alias("k")).collect()]
    got = [out[k] for k in keys]
    assert [r.component_id for r in got] == [1, 1, 1, None, None]
    assert [r.kept for r in got[:3]] == [True, True, False] and sorted(r.kept for r in got[3:]) == [False, True]


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            both, own = int(1000 * j), int(1000 * (1 - j) / 2)
            x = rng.integers(0, 2**63, both + 2 * own).astype(np.uint64)
            a, b = (neardup.registers(np.unique(s)) for s in (x[: both + own], np.concatenate([x[:both], x[both + own :]])))
            errors.append(float(neardup.estimate(np.array([(a == b).sum()]), np.array([both + own]), np.array([both + own]))[0]) - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_word_hashes_follow_the_bytes():
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice("aBc é\t\x0b\n") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "x" * (hashed.PIECE + 7) + " y " + "z " * 10]
    h, rows = hashed.words(pa.array(texts))
    seen = {}
    for t, a, b in zip(texts, rows[:-1], rows[1:], strict=True):
        own = words(lower(t))
        assert len(own) == b - a
        for w, x in zip(own, h[a:b], strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- quality classifier


def test_site_quality(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    share = {r.quality: r.k for r in QUERIES["op3_site_quality"](spark, DATA).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.98 and share[0] < 0.1
    none = site_quality.site_quality(documents(spark, ODD, ODD_IDS), labels.limit(0), keep=("text", "n_chars"))
    assert none.count() == len(ODD) and none.columns[-2:] == ["text", "n_chars"]
    assert site_quality.site_quality(documents(spark, ["x"]).limit(0), labels).count() == 0


def test_sparse_sites_shrink_to_the_general_rate(spark):
    rows = [("big", "a", 4.0)] * 300 + [("bad", "a", -4.0)] * 300 + [("tiny", "a", -4.0)]
    got = {r.host: r.rate for r in site_quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"), 0.5).collect()}
    assert got["bad"] < 0.1 < got["tiny"] < 0.5 < 0.9 < got["big"]


# --- toxicity


def sparse_examples(rng, vocabulary, n, groups=6):
    """Examples of several kinds, each with a vocabulary of its own and some words that all share."""
    parts, rows = np.array_split(vocabulary[40:], groups), []
    for i in range(n):
        own = np.concatenate([rng.choice(parts[i % groups], rng.integers(0, 30)), rng.choice(vocabulary[:40], rng.integers(0, 12))])
        t = np.unique(own)
        rows.append((t, rng.integers(1, 4, len(t)).astype(float)))
    return rows


def test_neighbours_are_exact_and_blocks_are_skipped():
    rng = np.random.default_rng(0)
    vocabulary = np.unique(rng.integers(1, 2**62, 400).astype(np.uint64))
    rows = sparse_examples(rng, vocabulary, 700)
    rows[9] = rows[3]  # a tie
    index = toxicity.Index(vocabulary, rng.uniform(1, 5, len(vocabulary)), rows, [int(x) for x in rng.random(700) < 0.2])
    assert sorted(index.order) == list(range(700)) and np.diff(index.starts).max() <= toxicity.BLOCK
    dense = np.zeros((700, len(vocabulary)))
    for place, i in enumerate(index.order):
        at, w = index.vector(*rows[i])
        dense[place, at] = w
    queries = rows[:200] + [(vocabulary[:0], np.zeros(0))]
    for without in (None, [int(index.place[i]) for i in range(200)] + [0]):
        near = index.nearest([index.vector(*r) for r in queries], 10, without)
        for i, (r, (ids, cosines)) in enumerate(zip(queries, near, strict=True)):
            at, w = index.vector(*r)
            query = np.zeros(len(vocabulary))
            query[at] = w
            every = dense @ query
            if without:
                every[without[i]] = 0
            want = np.sort(every[every > 0])[::-1][:10]
            assert len(ids) == len(want) and np.allclose(cosines, want, atol=1e-5) and np.allclose(every[ids], cosines, atol=1e-5)
    assert index.seen < 0.8 * index.held


def test_vectors_of_several_kinds_are_ordered_and_blocks_hold_their_own_terms():
    rng = np.random.default_rng(3)
    vocabulary = np.unique(rng.integers(1, 2**62, 240).astype(np.uint64))
    rows = sparse_examples(rng, vocabulary, 1200)
    index = toxicity.Index(vocabulary, rng.uniform(1, 5, len(vocabulary)), rows, [int(x) for x in rng.random(1200) < 0.2])
    dense = np.zeros((1200, len(vocabulary)))
    for place, i in enumerate(index.order):
        at, w = index.vector(*rows[i])
        dense[place, at] = w
    vectors = [index.vector(*r) for r in rows[:500]]  # the kinds alternate; several times as many as are dealt with together
    without = [int(p) for p in index.place[:500]]
    assert len(vectors) > 2 * toxicity.ALIKE
    for (at, w), own, (ids, cosines) in zip(vectors, without, index.nearest(vectors, 15, without), strict=True):
        every = dense[:, at] @ w
        every[own] = 0
        want = np.sort(every[every > 0])[::-1][:15]
        assert own not in ids and len(ids) == len(want)
        assert np.allclose(cosines, want, atol=1e-5) and np.allclose(every[ids], cosines, atol=1e-5)
    alone = [index.nearest([v], 15, [p])[0] for v, p in zip(vectors[:40], without, strict=False)]
    together = index.nearest(vectors[:40], 15, without[:40])
    assert all(np.allclose(x[1], y[1], atol=1e-6) for x, y in zip(alone, together, strict=True))
    # a block is multiplied by the terms that its examples have, not by all frequent ones
    assert all((block > 0).any(axis=1).all() for _, block in index.blocks)
    assert sum(block.size for _, block in index.blocks) < 0.5 * index.frequent[0] * 1200


def brute_toxicity(texts, known, least_factor):
    """Scores by plain loops: {id: text}, {id: label} of the examples; all examples are used for the calibration."""
    cut = re.compile("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+")

    def terms(t):
        w = cut.findall(lower(t))
        return Counter([(0, x) for x in w] + [(n, x.encode()[:n]) for x in w for n in toxicity.PREFIXES if len(x.encode()) > n])

    tf = {i: terms(t) for i, t in texts.items()}
    df = Counter(k for c in tf.values() for k in c)
    n, n_toxic, examples = len(known), sum(known.values()), {}
    for i in known:
        examples.setdefault(texts[i], i)
    assert len(examples) == n
    held, bad = Counter(k for i in known for k in tf[i]), Counter(k for i, y in known.items() if y for k in tf[i])
    weight = {}
    for k in df:
        d, p = held[k], bad[k]
        cells = [(p, d * n_toxic / n), (d - p, d * (n - n_toxic) / n), (n_toxic - p, (n - d) * n_toxic / n), (n - d - n_toxic + p, (n - d) * (n - n_toxic) / n)]
        g2 = max(0.0, 2 * sum(a * math.log(a / b) for a, b in cells if a > 0)) if d else 0.0
        weight[k] = math.log((len(texts) + 1) / (df[k] + 0.5)) * (least_factor + (1 - least_factor) * g2 / (g2 + toxicity.HALF_G2))
    vector = {i: {k: (1 + math.log(c)) * weight[k] for k, c in t.items()} for i, t in tf.items()}
    length = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vector.items()}
    rate = (n_toxic + 1) / (n + 2)

    def vote(i, without=None):
        near = []
        for j in known:
            if j != without and length[i] and length[j]:
                c = sum(x * vector[j].get(k, 0.0) for k, x in vector[i].items()) / length[i] / length[j]
                if c > 0:
                    near.append((c, known[j]))
        near = sorted(near, reverse=True)[: toxicity.NEIGHBOURS]
        return (sum(c * c * y for c, y in near) + toxicity.PRIOR_WEIGHT * rate) / (sum(c * c for c, _ in near) + toxicity.PRIOR_WEIGHT)

    odds = lambda v: math.log(v / (1 - v))
    x, y = np.array([odds(vote(i, i)) for i in known]), np.array(list(known.values()), float)
    a, b = 1.0, 0.0
    for _ in range(20000):  # plain descent to the same penalised optimum
        p = 1 / (1 + np.exp(-(a * x + b)))
        a, b = a - 0.01 * (((p - y) * x).sum() + a - 1) / len(x) * 10, b - 0.01 * ((p - y).sum() + b) / len(x) * 10
    return {i: 1 / (1 + math.exp(-(a * odds(vote(i)) + b))) for i in texts}


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(12)
    texts = {i: " ".join(f"Word{rng.randrange(60)}" for _ in range(rng.randint(3, 25))) + (" nastyword" if i % 4 == 0 else "") for i in range(160)} | {500: "", 501: "Unknown words only"}
    known = {i: int(i % 4 == 0) for i in range(160) if not toxicity.crc_held_out(i)}
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id bigint, quality int, toxic int")
    for least_factor in (0.25, 1.0):
        got = {r.doc_id: r.score for r in toxicity.toxicity(documents(spark, list(texts.values()), list(texts)), labels, least_factor=least_factor).collect()}
        want = brute_toxicity(texts, known, least_factor)
        assert all(abs(got[i] - want[i]) < 2e-3 for i in texts), sorted((abs(got[i] - want[i]), i, got[i], want[i]) for i in texts)[-3:]


def test_toxicity(spark):
    rng = random.Random(6)
    noise = lambda: " ".join(f"w{rng.randrange(2000)}" for _ in range(60))
    texts = [noise() + (" rudeword badword" if i % 5 == 0 else "") + " " + noise() for i in range(400)] + [None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(got[i].predicted == (i % 5 == 0) for i in range(400)) and got[400].score == got[401].score < 0.5
    assert toxicity.toxicity(documents(spark, ODD, ODD_IDS), labels.limit(0)).filter("score <> 0.5").count() == 0
    assert toxicity.toxicity(documents(spark, ["x"]).limit(0), labels).count() == 0
    assert toxicity.toxicity(documents(spark, ODD, ODD_IDS), spark.createDataFrame([(3, 1, 1), (4, 1, 0), (5, None, None), (None, 1, 1)], labels.schema)).count() == len(ODD)


def test_held_out_toxic_documents_are_found(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = QUERIES["op5_toxicity"](spark, DATA).join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("k")).collect()
    share = {r.toxic: r.k for r in got}
    assert share[1] >= 0.7 and share[0] <= 0.02, share


def test_toxicity_keeps_all_terms(spark):
    rng = random.Random(9)
    noise = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(40))
    known = [i for i in range(600) if not toxicity.crc_held_out(i)][:300]
    texts = {i: noise() + (" badword" if k % 5 == 0 else "") for k, i in enumerate(known)}
    texts[known[0]] = " ".join(f"own{k}x" for k in range(30))  # words of this toxic example alone
    texts |= {1000: texts[known[0]] + " more", 1001: "badword " + " ".join(f"new{k}" for k in range(2000)), 1002: "badword"}
    docs = documents(spark, list(texts.values()), list(texts))
    labels = spark.createDataFrame([(i, 1, int(k % 5 == 0)) for k, i in enumerate(known)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.evidence for r in toxicity.toxicity(docs, labels).collect()}
    assert got[1000][0].cosine > 0.9 and got[1000][0].label == 1
    assert 0 < got[1001][0].cosine < 0.3 * got[1002][0].cosine


# --- language model


def test_language_model_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a B c d ee É".split()) for _ in range(rng.randint(0, 30))) for _ in range(120)] + ODD[:9]
    ids = [*range(120), *ODD_IDS[:9]]
    out, model = lm.score_documents(documents(spark, texts, ids))
    part = lambda i: 1 if i is None else zlib.crc32(str(i).encode()) % 7
    one, two, n_docs = Counter(), Counter(), 0
    for i, t in zip(ids, texts, strict=True):
        if part(i) != lm.HELD_OUT:
            w = [*words(lower(t)), None]
            one.update(w)
            two.update(zip([0, *w], w, strict=False))
            n_docs += 1
    n, v = sum(one.values()), len(one)
    assert (model.n_tokens, model.n_types, model.n_docs) == (n, v, n_docs)
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        w = [*words(lower(t)), None]
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for h, x in zip([0, *w], w, strict=False):
            c = n_docs if h == 0 else one[h]
            a = model.weights[min(lm.BUCKETS - 1, math.ceil(math.log2(c + 1)))]
            score += math.log10(a[0] * (two[h, x] / c if c else 0) + a[1] * one[x] / n + a[2] / (v + 1))
        want[(i, part(i) == 2, len(w), sum(one[x] > 0 for x in w), n, round(base, 4), round(score, 4))] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in out.collect())
    assert got == want
    assert lm.score_documents(documents(spark, ["x"]).limit(0))[0].count() == 0


def test_mixture_weights_equal_an_own_em(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    follow = {w: rng.sample(vocab, 3) for w in vocab}
    texts = []
    for _ in range(700):
        w = [rng.choice(vocab)]
        while len(w) < 30:
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.6 else rng.choice(vocab))
        texts.append(" ".join(w))
    _, model = lm.score_documents(documents(spark, texts))
    part = [zlib.crc32(str(i).encode()) % 7 for i in range(len(texts))]
    rest = [[0, *t.split(), None] for t, p in zip(texts, part, strict=True) if p not in (lm.HELD_OUT, lm.DELETED)]
    one, two = Counter(x for w in rest for x in w), Counter(p for w in rest for p in zip(w, w[1:], strict=False))
    n = sum(v for k, v in one.items() if k != 0)
    cells = {}
    for t, p in zip(texts, part, strict=True):
        if p == lm.DELETED:
            w = [0, *t.split(), None]
            for h, x in zip(w, w[1:], strict=False):
                bucket = min(lm.BUCKETS - 1, math.ceil(math.log2(one[h] + 1)))
                cells.setdefault(bucket, []).append((two[h, x] / one[h] if one[h] else 0.0, one[x] / n, 1 / len(one)))
    for bucket, rows in cells.items():
        if len(rows) < 300:
            continue
        w = [1 / 3] * 3
        for _ in range(400):
            shares = [[a * b for a, b in zip(w, r, strict=True)] for r in rows]
            w = [sum(s[k] / sum(s) for s in shares) / len(rows) for k in range(3)]
        assert all(abs(a - b) < 0.03 for a, b in zip(w, model.weights[bucket], strict=True)), (bucket, w, model.weights[bucket])


def test_numbers_by_byte():
    x = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert (lm.unpacked(lm.packed(x)) == x).all() and (lm.unpacked(lm.packed(x, 7), 7) == x & np.uint64(2**56 - 1)).all()
    assert len(lm.unpacked(lm.packed(x[:0], 3), 3)) == 0


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    from tidewatch.llm.store import written

    sizes = [docs.count()]
    for name, stage in c.STAGES:
        docs = written(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == list(c.COLUMNS)
        sizes.append(docs.count())
        if name == "quality_classifier":
            assert docs.join(labels.filter("quality = 1"), "doc_id").count() >= 0.98 * labels.filter("quality = 1").count()
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    odd = documents(spark, ODD, ODD_IDS).select(*c.COLUMNS)
    for _, stage in c.STAGES:
        odd = written(stage(spark, odd, DATA), "test-odd")
