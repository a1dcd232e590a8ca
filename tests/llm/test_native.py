import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import BASE, ODD, ODD_IDS, documents, lower, words
from tests.oracle import DATA, same
from tidewatch.llm import chat, decontam, mixing, pii, quality_rules
from tidewatch.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


# --- chat


def test_long_chat(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn <|{i}é") for i in range(20_000)]
    out = chat.chat_digest(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()[0]
    loss = "".join(t for *_, r, t in rows if r == "assistant")
    assert (out.n_turns, out.loss_chars, out.loss_sha256) == (20_000, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in rows).encode()).hexdigest()


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi <|im_end|>\n&lt;|"), (1, 0, "user", "hi <|im_end|>\n&lt;|"), (1, 1, "assistant", "<|im_sep|>&amp;"), (1, 2, "assistant", None), (1, None, "sys\ntem", "first"), (None, 3, None, ""), (2, 0, "assistant", "<"), (2, 1, "user", "|im_end|>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, t string, pos int")
    out = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.read_chats(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(b.role, b.text) for b in out[1].back] == [("sys\ntem", "first"), ("user", rows[0][3]), ("user", rows[0][3]), ("assistant", "<|im_sep|>&amp;"), ("assistant", "")]
    assert out[1].loss == "<|im_sep|>&amp;" and out[1].formatted.count(chat.START) == 3
    assert [(b.role, b.text) for b in out[2].back] == [("assistant", "<"), ("user", "|im_end|>")] and out[2].loss == "<"
    assert [(b.role, b.text) for b in out[None].back] == [("", "")]
    assert chat.format_chats(df.limit(0)).count() == 0


# --- quality rules


def brute_stats(t):
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [*ODD[:-3], *["".join(rng.choice("ab #|\n") for _ in range(rng.randint(0, 90))) for _ in range(300)], "a b c a b c a b", "x\r\nx\ny", None]
    got = quality_rules.text_stats(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute_stats(t) for i, t in enumerate(texts)}
    assert quality_rules.text_stats(documents(spark, ["x"]).limit(0)).count() == 0


def test_rules_find_a_planted_conjunction():
    rng = random.Random(0)
    rows = []
    for i in range(900):
        r = {f: rng.random() for f in quality_rules.FEATURES} | {"grow": i % 3 != 0}
        rows.append(r | {"bad": int(r["symbols"] > 0.8 or r["upper"] > 0.6 and r["words"] < 0.5)})
    rules = quality_rules.learn_rules(rows)
    judged = [any(all(c.holds(r) for c in rule.conditions) for rule in rules) for r in rows]
    assert sum(j == bool(r["bad"]) for j, r in zip(judged, rows, strict=True)) > 870
    assert quality_rules.learn_rules([r | {"bad": 0} for r in rows]) == [] and quality_rules.learn_rules([]) == []


def test_quality_query_keeps_clean_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = QUERIES["op2_quality_rules"](spark, DATA).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in got}
    assert share[1] > 0.99 and share[0] < 0.2


def test_quality_without_labels(spark):
    judged, rules = quality_rules.quality_rules(documents(spark, ODD, ODD_IDS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert rules == [] and judged.count() == len(ODD)


# --- mixing


def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


def test_targets_equal_resharing(spark):
    rng = random.Random(4)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 10, 1000, 50000]) for s in [None, "", "a", "b", "c", "d", "é"][: rng.randint(1, 7)]}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), (sizes, got, want)


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    texts = ["w " * rng.choice([1, 5, 5, 5, 80, 300]) for _ in range(3000)] + [None, ""]
    df = documents(spark, texts).withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 50 = 1 THEN NULL ELSE concat('s', doc_id % 4) END"))
    out = mixing.systematic_copies(df)
    rows = sorted(map(tuple, out.collect()), key=str)
    assert len(rows) == len(texts) and all(0 <= r[4] <= 3 for r in rows)
    taken = Counter()
    for _, size, source_size, t, copies in rows:
        taken[t, source_size] += size * copies
    # one offset misses by a part of the largest document
    assert all(abs(n - t) <= 300 for (t, _), n in taken.items()), taken
    assert rows == sorted(map(tuple, mixing.systematic_copies(df.repartition(7)).collect()), key=str)
    assert mixing.systematic_copies(df.limit(0)).count() == 0


def test_copies_equal_a_walk_along_the_line(spark):
    rng = random.Random(2)
    texts = ["w " * rng.choice([0, 1, 5, 5, 80, 300]) for _ in range(400)]
    df = documents(spark, texts)
    got = {r.doc_id: r for r in mixing.systematic_copies(df).collect()}
    facts = {r.doc_id: (r.source, r.mix) for r in df.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id", "text").alias("mix")).collect()}
    places, n_words = {}, {i: len(words(t)) for i, t in enumerate(texts)}
    for i in n_words:
        places.setdefault(facts[i][0], []).append(i)
    for ids in places.values():

        def shape(i):
            octave = math.floor(math.log2(n_words[i] + 1))
            return int(octave * 8 + math.floor((n_words[i] + 1) / 2**octave * 8 - 8)), facts[i][1] % 32, n_words[i], facts[i][1]

        line = sorted(ids, key=shape)
        source_size, target = sum(n_words[i] for i in ids), got[ids[0]].target
        each = min(3.0, target / source_size)
        walk = lambda u: {i: math.floor((k + 1) * each + u) - math.floor(k * each + u) for k, i in enumerate(line)}
        mine = {i: got[i].copies for i in ids}
        tried = [walk(k / 4096) for k in range(4096)]
        assert mine in tried  # one offset explains all copies of the source
        assert abs(sum(n_words[i] * c for i, c in mine.items()) - target) <= max(n_words[i] for i in ids)


def test_mixing_of_odd_rows(spark):
    out = mixing.systematic_copies(documents(spark, ODD, ODD_IDS), keep=("text", "n_chars"))
    assert out.count() == len(ODD) and out.columns[-2:] == ["text", "n_chars"] and out.filter("copies is null or copies > 3").count() == 0
    assert mixing.emit_copies(out).columns == out.columns
    same = mixing.systematic_copies(documents(spark, ["a b c"] * 50, [7] * 50)).agg(F.sum("copies").alias("n")).first().n
    assert abs(same - 50) <= 3


def test_mix_of_the_tables_meets_targets(spark):
    out = QUERIES["op6_mixing"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source"), "doc_id")
    per = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want"), F.max("size").alias("largest")).collect()
    # sources of fifty documents: one large document more or less can't be evened out
    assert all(abs(r.t - r.want) <= r.largest for r in per), per
    assert abs(sum(r.t - r.want for r in per)) < 0.03 * sum(r.want for r in per)


def test_copies_are_expected_in_proportion(spark):
    df = documents(spark, ["w " * (1 + k % 90) for k in range(400)])
    runs = [{r.doc_id: (r.copies, r.target / r.source_size) for r in mixing.systematic_copies(df, seed=k).collect()} for k in range(24)]
    mean = sum(r[i][0] for r in runs for i in r) / sum(r[i][1] for r in runs for i in r)
    assert abs(mean - 1) < 0.02
    assert all(math.floor(r[i][1]) <= r[i][0] <= math.ceil(r[i][1]) for r in runs for i in r)


# --- personal data

PLAIN = dict(email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(t):
    out = []
    for k, (n, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if n == "email" or n == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or n == "card" and 12 <= len(d) <= 19 and luhn(d) or n == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab@..-_+ 0123456789()é𝒳\n") for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += [*ODD, "a@b.c_d@e.f x@y.zz@w.qq", "4111 1111 1111 1111 00001.0255.3.4 +1 (212) 555-0100", "a" * 30000, "1 " * 20000, "a." * 9000 + "@" + "b." * 9000 + "c"]
    out, _ = pii.find_personal_data(documents(spark, texts))
    assert {r.doc_id: [tuple(s) for s in r.base] for r in out.collect()} == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_added_spans_and_redaction(spark):
    texts = ['so token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" it', "mail a.b@c.de now", "a plain text 12 34", None] * 20
    out, model = pii.find_personal_data(documents(spark, texts), keep=("text",))
    red = {r.text: r.red for r in out.withColumn("red", pii.redact(F.col("text"), F.col("spans"))).collect()}
    assert red[texts[0]] == "so [SECRET] it" and red[texts[1]] == "mail [EMAIL] now" and red[texts[2]] == texts[2] and red[None] is None
    assert model is not None and pii.find_personal_data(documents(spark, ["none here"]))[1] is None


def test_added_patterns_take_whole_values(spark):
    key, jwt = "a1B2" * 50, f"{'eyJ0' * 20}.{'eyJz' * 40}.{'x-_9' * 30}"
    values = [
        (f'token = "{key}"', "secret"), (f"token={jwt}", "secret"), ("api_key: abc123~45==", "secret"), ("AKIA" + "Q7" * 20, "secret"), ("password=" + "p4" * 20000, "secret"),
        ("DE89370400440532013000", "account"), ("DE89 3704 0044 0532 0130 00", "account"), ("FR1420041010050500013M02606", "account"), ("NO9386011117947", "account"),
        ("BE68539007547034", "account"), ("@some_name", "handle"), ("@" + "n" * 40, "handle"),
    ]
    kinds = list(pii.KINDS)
    for end in (" it", ". It"):
        found = pii.candidate_spans(documents(spark, [f"so {v}{end}" for v, _ in values])).collect()
        spans = {r.doc_id: [(s.start, s.end) for s in r.found if kinds[s.kind] == values[r.doc_id][1]] for r in found}
        assert spans == {i: [(3, 3 + len(v))] for i, (v, _) in enumerate(values)}
    lost = pii.candidate_spans(documents(spark, ["at @site.org", "a@b.c", "password: ......"])).select(F.explode("found").alias("s")).filter(F.col("s.kind") >= len(pii.BASE))
    assert lost.count() == 0
    texts = [f'so token = "{key}" it', f"so token={jwt} it", "a plain text 12 34"] * 20
    out, _ = pii.find_personal_data(documents(spark, texts), keep=("text",))
    assert {r.red for r in out.select(pii.redact(F.col("text"), F.col("spans")).alias("red")).collect()} == {"so [SECRET] it", "a plain text 12 34"}


def test_added_candidates_equal_loops(spark):
    rng = random.Random(31)
    parts = ["Password: Abc123.x ", "TOKEN=", "eyJ0.aB-_", "AKIA" + "Q7" * 9, "@some_one", "@", "a@b.c", "Dr. Anna Weber", "Mary ", "Smith", "J. ", "12 Long ", "Oak ", "Street", "Streets ", "jo.do at mail dot site dot com", " [at] ", "dot", "x", " ", ".", "DE89 3704 0044 0532 0130 00", "078-05-1120", "=", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)] + ["Password: " + "k9" * 500 + " end", "Mr Aaa Bbb"]
    found = pii.candidate_spans(documents(spark, texts)).collect()
    got = {r.doc_id: sorted((s.start, s.end, s.kind) for s in r.found if s.kind >= len(pii.BASE)) for r in found}
    patterns = [(k, re.compile(p)) for k, p in enumerate(pii.LOOSE.values(), len(pii.BASE))]
    want = {i: sorted((m.start(), m.end(), k) for k, p in patterns for m in p.finditer(t)) for i, t in enumerate(texts)}
    assert got == want and {k for v in want.values() for *_, k in v} == set(range(len(pii.BASE), len(pii.KINDS)))


def test_redaction_equals_a_loop(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abé𝒳 ") for _ in range(rng.choice([0, 5, 60, 300])))
        spans = sorted((a, rng.randrange(4), min(len(text), a + rng.randint(1, 9))) for a in (rng.randrange(len(text)) for _ in range(rng.choice([0, 1, 7, 40])) if text))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,kind:int,end:int>>")
    for r in df.select("i", pii.redact(F.col("text"), F.col("spans")).alias("red")).collect():
        _, text, spans = rows[r.i]
        out, at = "", 0
        for a, k, e in spans:
            if a >= at:
                out += text[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, e)
        assert r.red == out + text[at:]


def test_many_spans_in_one_text(spark):
    text = "write to jo.81@mail7.example.com now " * 50_000 + "Password: " + "k9" * 500 + " end"
    start = time.time()
    out, _ = pii.find_personal_data(documents(spark, [text, "token=abcdef123456 x"] * 2), keep=("text",))
    red = out.select(pii.redact(F.col("text"), F.col("spans")).alias("red"), F.size("base").alias("n")).collect()
    assert {r.n for r in red} == {50_000, 0} and {r.red for r in red} == {"write to [EMAIL] now " * 50_000 + "[SECRET] end", "[SECRET] x"}
    assert time.time() - start < 60


def test_personal_data_of_empty_tables(spark):
    out, model = pii.find_personal_data(documents(spark, ["x"]).limit(0), keep=("text",))
    assert model is None and out.count() == 0
    out, _ = pii.find_personal_data(documents(spark, ODD, ODD_IDS), keep=("text", "n_chars"))
    assert out.count() == len(ODD) and out.columns == ["doc_id", "base", "spans", "text", "n_chars"]


def test_personal_data_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op9_personal_data"](spark, DATA).collect():
        want = brute_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))


# --- decontamination

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(doc, items):
    w, hit, found = ITEM.findall(lower(doc)), set(), set()
    for i, t in items:
        q = ITEM.findall(lower(t))
        n = min(13, len(q))
        wins = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_windows_equal_brute_force(spark, broadcast):
    rng = random.Random(7)
    vocab = [*"abcdefgh", "É", "é", "K", "k", "7x", "Σ"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 12, 13, 14, 30])))) for i in range(25)] + [(25, None), (3, "a b c"), (26, BASE)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [*ODD, *[f"x,{t}. {rng.choice(vocab)}" for _, t in items if t]]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, n int")
    got = decontam.decontaminate(documents(spark, texts), bench, broadcast_shingles=broadcast).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items, r.contaminated) for r in got} == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    assert decontam.decontaminate(documents(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_repeated_ids_are_judged_on_their_text(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    df = documents(spark, ["one two three", "nothing", "one two three", None], [1, 1, None, None])
    assert sorted(r.n_hit for r in decontam.decontaminate(df, bench).collect()) == [0, 0, 3, 3]
