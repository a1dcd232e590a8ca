"""Small tables with every awkward case, and brute-force helpers."""

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string, n bigint, component string, w int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return SPACE.findall(t or "")


def documents(spark, texts, ids=None):
    """Documents with clashing extra columns; texts may be None."""
    rows = [(i, t, ["en", "de", None][k % 3], ["s1", None, "s2"][k % 3], len(t or ""), "x", 1, "y", 2) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


BASE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"
ODD = [None, "", " \t\n", "one", "One two", BASE, BASE, BASE + " seven", "ÉCOLE É école K Σς " * 3, BASE + " " + "word " * 30000, "a\x00b \x85 c\xa0d", "𝒳 " * 10]
ODD_IDS = [None, 1, 2, 3, 4, 5, 5, 7, 8, 9, 10, None]
