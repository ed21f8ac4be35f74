"""Entries of one page at one pos: which is the repeat doesn't hang on the order of rows."""

from tessella.operators import locale


def test_ties_do_not_hang_on_the_order_of_rows(spark):
    rows = [("p", 0, c, "https://x.test/") for c in ("en", "EN", "de", "DE", "De")]
    got = [sorted(map(tuple, locale.entry_faults(spark.createDataFrame(r, "page string, pos int, hreflang string, href string").coalesce(1)).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] == [("p", 0, "De", "duplicate"), ("p", 0, "de", "duplicate"), ("p", 0, "en", "duplicate")]
