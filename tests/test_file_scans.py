"""Files are scanned once for all that is read from them."""

from tessella.plans import registry
from tessella.sources import readers


def test_files_are_scanned_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_bytes(b"caf\xc3\xa9 \xff\n" * (i + 1))
    rows = readers.read_files(spark, f"{tmp_path}/*.txt")
    texts, assets = readers.read_texts(spark, f"{tmp_path}/*.txt"), readers.read_assets(spark, f"{tmp_path}/*.txt")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, texts.join(assets, "path").collect()))
    assert "Join" not in registry.QUERIES["text_file_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
