"""Very long runs of what a pattern repeats: the engine must neither overflow its stack nor cut them."""

from pyspark.sql import functions as F

from tests.llm.cases import documents
from tidewatch.llm import pii

N = 200_000
RUNS = {
    "email": "a@b" + ".cd" * N,
    "ip": "1" * N + ".2.3.4 and 1.2.3." + "4" * N,
    "card": "4 " * N + "1",
    "phone": "+1" + " (2) 3" * N,
    "secret": "password=" + "aB3_" * N + " AKIA" + "Z9" * N,
    "account": "DE12 " + "3456 " * N,
    "handle": "@" + "ab_1" * N,
    "name": "Anna " + "Bcd " * N + "Dr. X" + "y" * N,
    "address": "12 " + "Aaa " * N + "Street",
    "written": "jo at mail" + " dot c" * N,
}


def test_every_kind_has_a_run():
    assert set(RUNS) == set(pii.KINDS)


def test_long_runs(spark):
    kinds = sorted(RUNS)
    rows = pii.candidate_spans(documents(spark, [RUNS[k] for k in kinds])).select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.kind", "s.start", "s.end").collect()
    found = {tuple(r) for r in rows}
    for at, kind in enumerate(kinds):
        if kind not in ("ip", "account", "name"):  # of these parts of the run match: a part is over 255, or the standard ends it
            assert (at, pii.KINDS.index(kind), 0, RUNS[kind].index(" ") if kind == "secret" else len(RUNS[kind])) in found, kind


def test_addresses_end_at_the_first_street(spark):
    texts = ["12 Way Street now", "7 Old Mill Road St", "3 Street", "9 Stone Lanes Court x", "4 Anna Streets 5 Bell Ave"]
    rows = pii.candidate_spans(documents(spark, texts)).select("doc_id", F.explode("found").alias("s")).filter(F.col("s.kind") == pii.KINDS.index("address")).collect()
    assert sorted((texts[r.doc_id][r.s.start : r.s.end]) for r in rows) == ["12 Way Street", "5 Bell Ave", "7 Old Mill Road", "9 Stone Lanes Court"]


def test_the_stage_hides_long_runs(spark):
    docs = documents(spark, list(RUNS.values()) + ["12 " + "Aaa " * N, "plain text"])
    found, _ = pii.find_personal_data(docs, keep=("text",))
    rows = found.select("doc_id", F.length(pii.redact(F.col("text"), F.col("spans"))).alias("n")).collect()
    assert len(rows) == docs.count() and all(r.n is not None for r in rows)
