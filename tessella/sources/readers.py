"""Scans: delimited files, text, URL lists, JSON, XML, assets and the environment."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def shape_of(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether quoted cells span lines) of delimited files, from one pass over their lines.

    utf-8 if every line's bytes are valid UTF-8, else iso-8859-1, to be mended by `cp1252`.
    A line with an odd number of quotes begins or ends a cell that spans lines; only then
    must a file be read as a whole, by one task.
    """
    lines = spark.read.text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    found = lines.agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.bool_or(odd).alias("spans")).first()
    return "iso-8859-1" if found["valid"] is False else "utf-8", bool(found["spans"])


def _cp1252() -> tuple[str, str]:
    """Control characters of iso-8859-1, and what the same bytes are in cp1252, where it has them."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, c in pairs if c), "".join(c for _, c in pairs)


def header_of(spark: SparkSession, path: str, encoding: str, spans: bool, sep: str = ",") -> list[str]:
    """Names in the first record, a byte-order mark removed."""
    first = spark.read.option("encoding", encoding).option("sep", sep).option("multiLine", spans).option("header", False).csv(path).limit(1).collect()
    names = [str(v) if v is not None else "" for v in first[0]] if first else []
    names = [n.removeprefix("\ufeff") for n in names]
    return names if encoding == "utf-8" else [n.translate(str.maketrans(*_cp1252())) for n in names]


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, list[str], list[str]]:
    """(table of strings, raw header, warnings). Of equal headers the last column holds. Short
    rows get nulls; rows of another length are kept and counted by `ragged`."""
    encoding, spans = shape_of(spark, path)
    header = header_of(spark, path, encoding, spans, sep)
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(header))] + [T.StructField(CORRUPT, T.StringType())]
    raw = spark.read.schema(T.StructType(fields)).option("encoding", encoding).option("sep", sep).option("multiLine", spans).option("columnPruning", False).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    last = {name: i for i, name in enumerate(header)}
    warnings = [f"duplicate column: {n}" for n in sorted({h for h in header if header.count(h) > 1})]
    if encoding != "utf-8":
        raw = raw.select(*[F.translate(c, *_cp1252()).alias(c) for c in raw.columns])
    return raw.select(*[F.col(f"c{i}").alias(n) for n, i in sorted(last.items(), key=lambda x: x[1])], CORRUPT), header, warnings


def ragged(table: DataFrame) -> DataFrame:
    """(rows) that were longer or shorter than the header, which only a parse of whole rows shows."""
    every = F.concat_ws("", *table.columns)  # Spark doesn't parse for the raw record alone
    return table.where(F.col(CORRUPT).isNotNull() & (F.length(every) >= 0)).select(CORRUPT)


def read_library(spark: SparkSession, path: str) -> DataFrame | None:
    """A small table in file order (row_idx), or None if there is no such file."""
    try:
        table, _, _ = read_csv(spark, path)
    except Exception as error:  # a missing path is an answer here, anything else is not
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return table.drop(CORRUPT).coalesce(1).withColumn("row_idx", F.monotonically_increasing_id())


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files; bytes that aren't UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", _text("content"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(idx, url) of a list, a URL a line; blank lines and lines that begin with # are left out."""
    lines = spark.read.text(path).withColumn("idx", F.monotonically_increasing_id())
    return lines.where(~F.col("value").startswith("#")).select("idx", F.trim("value").alias("url")).where("url <> ''")


def read_json(spark: SparkSession, source: str) -> DataFrame:
    """(json) a row per object of a file, or of the argument itself if it is JSON."""
    if source.lstrip()[:1] in ("{", "["):
        value = json.loads(source)
        return spark.createDataFrame([(json.dumps(v),) for v in (value if isinstance(value, list) else [value])], "json string")
    whole = spark.read.text(source, wholetext=True)
    v = F.try_parse_json("value")
    listed = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    return whole.select(F.explode(listed).alias("v")).select(F.to_json("v").alias("json"))


def read_xml(spark: SparkSession, source: str) -> DataFrame:
    """(id, xml) of whole files, or of the argument itself if it is XML."""
    if source.lstrip().startswith("<"):
        return spark.createDataFrame([("inline", source)], "id string, xml string")
    return read_texts(spark, source).select(F.col("path").alias("id"), F.col("content").alias("xml"))


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, data_uri) of binary files; the kind follows from the extension, image/png otherwise."""
    return _files(spark, path).select("path", "bytes", "data_uri")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, bytes, data_uri): what read_texts and read_assets give, from one scan of the files."""
    return _files(spark, path).select("path", _text("content"), "bytes", "data_uri")


def read_packed(spark: SparkSession, path: str, between: str) -> DataFrame:
    """(name, content, bytes, data_uri) of each text that write_packed left, as read_files gives of whole files; nulls
    for a text that was null."""
    found = spark.read.option("lineSep", between).text(path).select("value", F.substring_index("value", "\n", 1).alias("line"))
    head = F.from_json("line", "name string, missing boolean")
    raw = F.substr(F.col("value").cast("binary"), F.octet_length("line") + 2)
    files = found.select(head.alias("head"), raw.alias("raw")).select("head.name", F.when(~F.col("head.missing"), F.col("raw")).alias("content"))
    return files.select("name", _text("content"), F.octet_length("content").cast("long").alias("bytes"), _data_uri("name"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", F.col("length").alias("bytes"), _data_uri("path"))


def _text(content: str) -> Column:
    return F.make_valid_utf8(F.col(content).cast("string")).alias("content")


def _data_uri(path: str) -> Column:
    kinds = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("image/png"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("content")).alias("data_uri")


# Bytes after which a page audit and a citation check stop reading.
AUDIT_BYTES, CITATION_BYTES = 2_000_000, 500_000


def read_fetched(spark: SparkSession, path: str, most_bytes: int = AUDIT_BYTES) -> DataFrame:
    """A table of responses (url, status, headers, body) that a crawler wrote; bodies over
    most_bytes are cut there, as a live fetch would stop (a character that the cut splits
    becomes a replacement character)."""
    raw = F.substring(F.encode("body", "UTF-8"), 1, most_bytes)
    cut = F.make_valid_utf8(raw.cast("string"))
    return spark.read.parquet(path).withColumn("body", F.when(F.octet_length("body") > most_bytes, cut).otherwise(F.col("body")))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """A baseline that write_snapshot left, or None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


#: Struct of a design's JSON, as compose gives it.
DESIGN = (
    "product_type string, industry string, pattern string, style struct<name:string,summary:string>, "
    "palette struct<name:string,primary:string,secondary:string,accent:string,bg:string,surface:string,text:string,on_primary:string,success:string,warning:string,error:string>, "
    "typography struct<heading_font:string,body_font:string>, effects struct<radius:string,shadow:string,motion:string>, "
    "key_sections array<string>, anti_patterns array<string>, checklist array<string>, fallbacks array<string>"
)


def read_designs(spark: SparkSession, source: str) -> DataFrame:
    """Design results (a row per JSON object of a file or of the argument itself), typed for the sinks."""
    return read_json(spark, source).select(F.from_json("json", DESIGN).alias("d")).select("d.*")


def probe(spark: SparkSession, tools: list[str], variables: list[str]) -> DataFrame:
    """(kind, name, present); values of variables are never shown."""
    rows = [("tool", t, shutil.which(t) is not None) for t in tools] + [("variable", v, bool(os.environ.get(v))) for v in variables]
    return spark.createDataFrame(rows, "kind string, name string, present boolean")
