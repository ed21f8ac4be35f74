"""Consistency of a set of text files: references, records, names, counts, versions.

files: (path, content); names, records and claims are tables of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.operators.routing import found
from tessella.sources.staging import small_table


def dangling_references(files: DataFrame, pattern: str = r"scripts[\\/][A-Za-z0-9_.\\/-]+\.py") -> DataFrame:
    """(path, ref) of paths that files mention and that are no file: an anti-join."""
    refs = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))).alias("ref"))
    refs = refs.withColumn("ref", F.replace("ref", F.lit("\\"), F.lit("/"))).distinct()
    return refs.join(files.select(F.col("path").alias("ref")), "ref", "left_anti").select("path", "ref")


def unrecorded(files: DataFrame, ledger: DataFrame, like: str = "%.py") -> DataFrame:
    """Paths like `like` without an entry `path` in backticks in any ledger text (content)."""
    known = ledger.select(F.explode(F.regexp_extract_all("content", F.lit("`([^`]+)`"), F.lit(1))).alias("path")).distinct()
    return files.where(F.col("path").like(like)).select("path").join(known, "path", "left_anti")


def denied_names(files: DataFrame, names: DataFrame) -> DataFrame:
    """(path, name) of names (name) that occur in a file, in equal case; however many names, each file
    is read once (see routing.found)."""
    return found(files, "path", "content", names).select("path", "name")


def wrong_counts(files: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim, claimed, actual) where a claim (claim, claimed, like) differs from the number of paths like it.

    The claims, a list of a checked size, go to the files as one array; each file names
    the claims it counts for, and these are summed map-side.
    """
    small = small_table(claims, "a list of claims")
    listed = F.broadcast(small.agg(F.collect_list(F.struct("claim", "like")).alias("claims")))  # one row
    like = lambda path, pattern: F.call_function("like", path, pattern)
    hits = files.join(listed, how="cross").select(F.explode(F.filter("claims", lambda c: like(F.col("path"), c["like"]))).alias("hit"))
    counts = hits.groupBy("hit.claim").agg(F.count("*").alias("n")).withColumnRenamed("claim", "of")
    rows = small.select("claim", "claimed").join(counts, F.col("claim") == F.col("of"), "left")
    return rows.select("claim", "claimed", F.coalesce("n", F.lit(0).cast("long")).alias("actual")).where("claimed <> actual")


def stale_versions(files: DataFrame, current: str) -> DataFrame:
    """(path, version) of x.y.z versions in files other than the current one."""
    rows = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\bv?(\d+\.\d+\.\d+)\b"), F.lit(1)))).alias("version"))
    return rows.where(F.col("version") != current)


def bare_lines(files: DataFrame, pattern: str) -> DataFrame:
    """(path, line_no, line) of lines that match a pattern."""
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    return rows.where(F.regexp_like("line", F.lit(pattern))).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def unmatched_fields(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left, right) where two lists of entries differ, or one lacks the entry."""
    pair = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").cast("string").alias("left"), F.col(f"r.{f}").cast("string").alias("right")) for f in fields])
    rows = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full").select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), F.inline(pair))
    return rows.where(~F.col("left").eqNullSafe(F.col("right")))


def passed_checks(reports: DataFrame) -> DataFrame:
    """(path, passed, total, all_passed) from the last `n/m checks passed` of report texts."""
    last = F.element_at(F.regexp_extract_all("content", F.lit(r"(\d+/\d+) checks passed"), F.lit(1)), -1)
    rows = reports.where(F.regexp_like("content", F.lit(r"\d+/\d+ checks passed"))).select("path", F.split(last, "/").alias("p"))
    rows = rows.select("path", F.col("p")[0].cast("int").alias("passed"), F.col("p")[1].cast("int").alias("total"))
    return rows.withColumn("all_passed", F.col("passed") == F.col("total"))


def floating_versions(files: DataFrame, names: str = r"(^|/)\.mcp\.json$", mark: str = "@latest") -> DataFrame:
    """(path) of configurations, by name, that pin no version."""
    return files.where(F.regexp_like("path", F.lit(names)) & F.contains("content", F.lit(mark))).select("path")


def manifest_faults(projects: DataFrame) -> DataFrame:
    """(project, fault) of projects (project, manifest: JSON, licence: text of the licence file).

    no_homepage, no_repository; placeholder_license: none declared, or a placeholder;
    license_mismatch: MIT is declared and the file isn't it; license_short: another one
    is declared and the file, trimmed, has at most 400 characters. What isn't JSON, or
    null, declares nothing; a null licence is empty.
    """
    field = lambda name: F.coalesce(F.get_json_object("manifest", f"$.{name}"), F.lit(""))
    declared, text = F.upper(strip(field("license"))), F.coalesce("licence", F.lit(""))
    # What stands for no licence.
    hollow = (declared == "") | F.contains(declared, F.lit("SEE LICENSE")) | F.contains(declared, F.lit("PLACEHOLDER"))
    faults = {
        "no_homepage": field("homepage") == "",
        "no_repository": field("repository") == "",
        "placeholder_license": hollow,
        "license_mismatch": (declared == "MIT") & ~F.contains(text, F.lit("MIT License")),
        "license_short": ~hollow & (declared != "MIT") & (F.length(strip(text)) <= 400),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in faults.items()]))
    return projects.select("project", F.explode(found).alias("fault"))
