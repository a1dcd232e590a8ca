"""Queries of the operators that use Python inside tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import html_text, lm, neardup, phrases, repair, setjoin, site_quality, toxicity
from tidewatch.llm.store import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_quality.site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "site_rate", "score", "kept")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))[0]


def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_damage(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_text, op3_site_quality, op4_near_duplicates, op5_toxicity, op7_lm_score, op11_set_join, op12_conversation_repair, op13_collocations)}

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y) AS component_id, min(y) = doc_id AS kept
FROM r JOIN documents ON r.x = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP11_SQL = OP4_SQL.replace("i + 4]", "i + 5]").replace("len(w) - 4", "len(w) - 5").replace(", min(y) = doc_id AS kept", "")

#: States of the grammar by number: 1 start, 2 behind a system row, 3 behind a user's, 4 behind an assistant's.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc WHERE kind <> 0),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || chr(10) || text), copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
faulty AS (
  SELECT *, left(role, 1) AS ini, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault
  FROM placed),
told AS (
  SELECT c, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(ini) OVER (PARTITION BY c ORDER BY i) || ini AS pair FROM faulty) GROUP BY c),
ways AS (
  SELECT c, n + 1 AS i, [{'c': 0, 's': ''}, {'c': 10, 's': 'II'}, {'c': 5, 's': 'I'}, {'c': 0, 's': ''}] AS v FROM told
  UNION ALL
  SELECT c, i, list_transform([1, 2, 3, 4], lambda g: list_sort([base[g], {'c': once[nx[g]].c + 5, 's': 'I' || once[nx[g]].s}])[1]) AS v
  FROM (SELECT *, list_transform([1, 2, 3, 4], lambda g: list_sort([base[g], {'c': base[nx[g]].c + 5, 's': 'I' || base[nx[g]].s}])[1]) AS once
        FROM (SELECT f.c, f.i, [3, 3, 4, 3] AS nx, list_transform([1, 2, 3, 4], lambda g: list_sort([
                {'c': w.v[g].c + 2, 's': 'D' || w.v[g].s},
                {'c': w.v[[3, 3, 4, 3][g]].c + 1 + extra, 's': 'R' || w.v[[3, 3, 4, 3][g]].s},
                {'c': CASE WHEN g = 1 AND ini = 's' THEN w.v[2].c WHEN [3, 3, 4, 3][g] = 3 AND ini = 'u' THEN w.v[3].c WHEN g = 3 AND ini = 'a' THEN w.v[4].c ELSE 1000000000 END + extra,
                 's': 'K' || CASE WHEN g = 1 AND ini = 's' THEN w.v[2].s ELSE w.v[[3, 3, 4, 3][g]].s END}])[1]) AS base
              FROM ways w JOIN (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS extra FROM faulty) f ON f.c = w.c AND f.i = w.i - 1))),
best AS (SELECT c, v[1].c AS cost, v[1].s AS audit FROM ways WHERE i = 1),
labels AS (
  SELECT c, k, substr(audit, k, 1) AS label FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)),
outs AS (
  SELECT c, label, count(*) FILTER (label <> 'I') OVER (PARTITION BY c ORDER BY k) AS i, count(*) FILTER (label <> 'D') OVER (PARTITION BY c ORDER BY k) AS pos FROM labels),
turns AS (
  SELECT o.c, o.pos, o.label, f.role, f.text, max(CASE WHEN o.pos = 1 AND o.label = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.c) AS sys
  FROM outs o LEFT JOIN faulty f ON f.c = o.c AND f.i = o.i WHERE o.label <> 'D'),
repaired AS (
  SELECT c, string_agg(CASE WHEN label = 'K' THEN role WHEN (pos - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN label = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS whole FROM turns GROUP BY c),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM every LEFT JOIN told ON every.conv_id IS NOT DISTINCT FROM told.conv_id LEFT JOIN best USING (c) LEFT JOIN repaired USING (c)
"""

OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, c.w, x.k AS first, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.phrase = array_to_string(c.w[1 : x.k], ' ')
         JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.phrase = array_to_string(c.w[x.k + 1 : ], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, first) = 1),
inside AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), f FROM c WHERE k = 3)
  GROUP BY lang, phrase),
alone AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase AND b.k = 2 WHERE i.f IS NULL OR 100 * i.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op11_set_join": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_collocations": OP13_SQL, "op4_near_duplicates": OP4_SQL}
