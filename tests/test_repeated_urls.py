"""Pages of equal URL: queries still give what their SQL gives."""

from collections import Counter

import pytest

from tests.test_oracles import plain
from tessella.plans import registry

HTML = '<html><head><title>T{0}</title></head><body><nav><ul><li><a href="/a">a</a><li><a href="/b"> </a></ul></nav><article><p>x</p></article></body></html>'
QUERIES = [
    "appeared_pages",
    "broken_links",
    "links_by_region",
    "social_cards",
    "unlabelled_controls",
    "headers_of_pages",
    "snapshot_file_scan",
    "robots_drift",
    "sitemap_gate",
]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repeated"))
    rows = [(i, f"https://x.test/{i * 7 % 23}", HTML.format(i)) for i in range(120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", QUERIES)
def test_repeated_urls(spark, repeated, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{repeated}/pages.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, repeated)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"select {columns} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in want)
