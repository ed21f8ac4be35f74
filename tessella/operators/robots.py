"""Crawler policy from robots files: groups, precedence, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Crawlers that gather training data, and crawlers that answer questions, for the
# page audit and for the citation check; the two lists differ.
BOTS = {
    ("audit", "training"): ["GPTBot", "ClaudeBot", "Google-Extended", "CCBot", "Bytespider"],
    ("audit", "retrieval"): ["OAI-SearchBot", "Claude-SearchBot", "PerplexityBot", "ChatGPT-User"],
    ("citation", "training"): ["GPTBot", "ClaudeBot", "Google-Extended", "CCBot"],
    ("citation", "retrieval"): ["OAI-SearchBot", "Claude-SearchBot", "PerplexityBot"],
}
AGENT = r"(?i)^\s*User-agent\s*:"


def bots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, k, b) for (s, k), names in BOTS.items() for b in names], "source string, kind string, bot string")


def groups(files: DataFrame) -> DataFrame:
    """(site, group_id, agents, blocks_root) from files (site, raw).

    Agent lines in a row share a group; any other line, also a blank one, ends the run.
    A group blocks the root if it says `Disallow: /` and not `Allow: /`. What stands
    before the first agent line counts for nothing.
    """
    lines = files.select("site", F.posexplode(F.split("raw", r"\r\n|\n|\r")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace(F.regexp_replace("line", "#.*$", ""), r"\s+$", ""))
    order = Window.partitionBy("site").orderBy("pos")
    lines = lines.withColumn("is_agent", F.regexp_like("line", F.lit(AGENT)))
    begins = F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(order), F.lit(False))
    lines = lines.withColumn("begins", begins.cast("int")).withColumn("group_id", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agent = F.when(F.col("is_agent"), F.lower(F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))))
    rule = lambda word: F.coalesce(F.bool_or(F.regexp_like("line", F.lit(rf"(?i)^\s*{word}\s*:\s*/\s*$"))), F.lit(False))
    return lines.where("group_id > 0").groupBy("site", "group_id").agg(F.sort_array(F.collect_set(agent)).alias("agents"), (rule("Disallow") & ~rule("Allow")).alias("blocks_root"))


def blocked(files: DataFrame, source: str = "audit") -> DataFrame:
    """(site, kind, bot, blocked, mentioned) for every site and crawler of the list.

    The first group that names the bot decides, else the first group for `*`, else it
    may crawl. The crawler list is a fixed handful, so crossing it with sites is a map.
    """
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("bot")) for (s, k), names in BOTS.items() if s == source for b in names])
    pairs = files.select("site", "raw", F.inline(named))
    pairs = pairs.select("site", "kind", "bot", F.regexp_like(F.lower("raw"), F.concat(F.lit(r"user-agent:\s*"), F.replace(F.lower("bot"), F.lit("-"), F.lit(r"\-")))).alias("mentioned"))
    found = groups(files).select("site", F.explode("agents").alias("agent"), "group_id", "blocks_root").groupBy("site", "agent").agg(F.min_by("blocks_root", "group_id").alias("blocks"))
    own, star = found.alias("own"), found.where("agent = '*'").alias("star")
    rows = pairs.join(own, (pairs["site"] == F.col("own.site")) & (F.lower("bot") == F.col("own.agent")), "left")
    rows = rows.join(star, pairs["site"] == F.col("star.site"), "left")
    return rows.select(pairs["site"], "kind", "bot", F.coalesce("own.blocks", "star.blocks", F.lit(False)).alias("blocked"), "mentioned")


def citation(files: DataFrame) -> DataFrame:
    """(site, kind, blocked, mentioned): by kind of crawler, the names of the citation list that
    may not crawl the site and those its file names, in the order of the list, comma-separated."""
    order = F.create_map(*[x for (s, _), names in BOTS.items() if s == "citation" for i, b in enumerate(names) for x in (F.lit(b), F.lit(i))])
    listed = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(when), F.struct(order[F.col("bot")], "bot")))), lambda e: e["bot"]), ",")
    return blocked(files, "citation").groupBy("site", "kind").agg(listed("blocked").alias("blocked"), listed("mentioned").alias("mentioned"))


def policy(files: DataFrame) -> DataFrame:
    """(site, policy, bots, has_sitemap): blocks_training, mentions_only or silent."""
    per = blocked(files).groupBy("site").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") == "training") & F.col("blocked"), F.col("bot")))).alias("blocks"),
        F.array_sort(F.collect_list(F.when(F.col("mentioned"), F.col("bot")))).alias("mentions"),
    )
    kind = F.when(F.size("blocks") > 0, "blocks_training").when(F.size("mentions") > 0, "mentions_only").otherwise("silent")
    named = F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(F.col("mentions"))
    return files.join(per, "site").select("site", kind.alias("policy"), F.array_join(named, ",").alias("bots"), F.lower("raw").contains("sitemap:").alias("has_sitemap"))


def llms_txt(files: DataFrame) -> DataFrame:
    """(site, present, has_headings, length) of llms.txt files (site, body); length in characters."""
    present = F.coalesce(F.length("body") > 0, F.lit(False))
    return files.select("site", present.alias("present"), F.when(present, F.regexp_like("body", F.lit("(?m)^#"))).alias("has_headings"), F.when(present, F.length("body")).alias("length"))
