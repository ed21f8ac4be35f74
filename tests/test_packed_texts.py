"""Many texts to a file: all come back as they were, however the files are split, and pages don't take a file each."""

import os
from collections import Counter

import pytest

from tessella.plans import registry
from tessella.sources import readers, sinks
from tests.test_oracles import plain

TEXTS = ["", "\n", "a\n", "a\n\n", "\r\n\x1e", "café \U0001f600", '{"name":"x"}\n', None, "-" * 300, "same", "same"]


@pytest.mark.parametrize("split", ["1k", "64", "128m"])
def test_packed_texts_come_back(spark, tmp_path, split):
    data = [(f"n{i % 90}\n.svg" if i % 7 else None, TEXTS[i % len(TEXTS)]) for i in range(200)]
    df = spark.createDataFrame(data, "name string, text string")
    between = sinks.write_packed(df.coalesce(1), str(tmp_path / "t"), "text", "name")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = readers.read_packed(spark, str(tmp_path / "t"), between).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert Counter((r.name, r.content, r.bytes) for r in got) == Counter((n, t, None if t is None else len(t.encode())) for n, t in data)


def test_pages_are_scanned_from_few_files(spark, tmp_path, monkeypatch):
    import duckdb

    rows = [(i // 2 if i else None, f"<p>{i}\n</p>" + "\n" * (i % 3) if i % 11 else None) for i in range(300)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr("tessella.plans.derived.folder", lambda spark, name: f"{tmp_path}/out/{name}")
    df = registry.QUERIES["text_file_scan"](spark, str(tmp_path))
    assert sum(f.endswith(".txt") for _, _, names in os.walk(tmp_path / "out") for f in names) < 10
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL['text_file_scan']})").fetchall()
    assert Counter(tuple(map(plain, r)) for r in df.collect()) == Counter(tuple(map(plain, r)) for r in want)
