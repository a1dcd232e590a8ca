"""Groups of any size give each instant to the same owner."""

import pytest

from tidewatch.operators import intervals as I


@pytest.mark.parametrize("few", [1, 3, 32])
def test_owners_are_the_same_by_either_way(spark, monkeypatch, few):
    """Members meet directly or in cells by the size of their group; those alone, and empty ones, aren't cut."""
    rows = [("a", f"{k:03}", (k * 7919) % 40 * 3_600_000_000, 0, k % 3 == 0) for k in range(24)] + [("b", "100", 5, 9, True), ("c", "101", 7, 7, True)]
    rows = [(s, c, a, b or a + (1 + int(c) * 31 % 50) * 3_600_000_000, m) for s, c, a, b, m in rows]
    df = spark.createDataFrame(rows, "subject string, content string, start_us bigint, end_us bigint, is_main boolean")
    met = []
    cover = I._covering
    monkeypatch.setattr(I, "_covering", lambda pieces, rows, *a: met.append(rows.count()) or cover(pieces, rows, *a))
    monkeypatch.setattr(I, "FEW", few)
    got = sorted(tuple(r) for r in I.ownership(df, ["subject"]).collect())
    bounds = {s: sorted({x for r in rows if r[0] == s for x in r[2:4]}) for s in "abc"}
    want = []
    for s in "abc":
        for lo, hi in zip(bounds[s], bounds[s][1:], strict=False):
            over = [r for r in rows if r[0] == s and r[2] <= lo and r[3] >= hi]
            if over:
                owner = min(over, key=lambda r: (not r[4], r[2] - r[3], r[2], r[1]))[1]
                if want and want[-1][:2] == (s, owner) and want[-1][3] == lo:
                    want[-1] = (s, owner, want[-1][2], hi)
                else:
                    want.append((s, owner, lo, hi))
    assert got == sorted(want) and met == [24 if few < 24 else 0]
