"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a Column that is true where a document fails, with a Column that says what
evaluating it costs. One aggregate over a sample counts which rules fail together, among
documents that the base lets through, and sums the costs. From these counts the rules
are ordered greedily: next comes the rule with most rejections per cost among documents
that the rules before it leave. They are evaluated as one CASE, so a document that fails
an early rule never pays for a later one. The order changes the cost, not the verdict,
and the same table always gives the same order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD

#: Words in a window that counts as repeated, the least words, and the most repeats in percent.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
#: Rows of the sample that costs and rejections are counted on, about.
SAMPLE_ROWS = 2_000
#: Cost of a rule on counts that are there already, and for each character that a pattern reads
#: or, beyond that, matches by itself; in nanoseconds, as measured once on ordinary prose.
COUNT_COST, READ_COST, MATCH_COST = 5.0, 12.0, 20.0


def reading(matched: Column | float = 0.0) -> Column:
    """What a pattern over the text costs of which `matched` characters match."""
    return READ_COST * F.length("text") + MATCH_COST * (matched if isinstance(matched, Column) else F.lit(matched))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column
    cost: Column = field(default_factory=lambda: F.lit(COUNT_COST))


def letters(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern))


def default_rules() -> list[Rule]:
    """On the columns that `features` adds. Thresholds stay clear of ordinary prose."""
    return [
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words")),
        Rule("duplicate_lines", F.col("n_dup_lines") * 2 > F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("shouting", letters(r"\p{Lu}") * 2 > letters(r"\p{L}"), 2 * reading(F.col("word_chars"))),
        Rule("exclaiming", letters("[!?]") * 2 > F.col("n_words"), reading()),
        Rule("few_letters", letters(r"\p{L}") * 4 < F.length("text"), reading(F.col("word_chars"))),
    ]


def without(text: Column, signs: str) -> Column:
    """The text without some single characters; a search for each is far quicker than a pattern."""
    for sign in signs:
        text = F.replace(text, F.lit(sign), F.lit(""))
    return text


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (longs).

    n_dup_lines: lines (cut at newline) that hold a word and equal an earlier line.
    n_repeat_words: words inside windows of 8 words that occur twice or more in the
    text. A null text counts as empty; every count is 0 then. Each row stands for
    itself, so repeated rows, ties and empty tables need no care. Columns of docs with
    these six names are replaced; all others stay, whatever their names.

    Equal windows have equal hashes, so a text whose window hashes all differ has no
    repeat; only the others (few in prose) sort their windows, hashes with places, and
    compare the words of neighbours. A very long text takes memory for its words and a
    number for each; the words of a window are never put together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    # Hashes of 1, 2, 4 and 8 words from each place on, each from two of the half.
    rows, size = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w))), 1
    while size < WINDOW:
        h, n = f"h{size}", F.greatest(F.size(f"h{size}") - size, F.lit(0))
        pairs = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(size + 1), n), lambda a, b: F.xxhash64(a, b))
        rows, size = rows.withColumn(f"h{2 * size}", pairs), 2 * size
    again = F.size(F.array_distinct(f"h{WINDOW}")) < F.size(f"h{WINDOW}")
    rows = rows.withColumn("again", again)
    window = F.transform(f"h{WINDOW}", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("sorted", F.when(F.col("again"), F.sort_array(window)))
    # Equal hashes stand together, by place; hashes preselect, words decide between neighbours.
    words = lambda s: F.slice("words", s["i"] + 1, WINDOW)
    alike = lambda s, t: F.coalesce((s["h"] == t["h"]) & (words(s) == words(t)), F.lit(False))
    found = F.filter("sorted", lambda s, j: alike(s, F.get("sorted", j - 1)) | alike(s, F.get("sorted", j + 1)))
    rows = rows.withColumn("at", F.when(F.col("again"), F.sort_array(F.transform(found, lambda s: s["i"]))))
    # Each repeated window adds the words up to the next one's start.
    gaps = F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW))))
    repeated = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    blank = lambda line: without(line, " \t\x0b\x0c\r") == ""
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda line: ~blank(line)))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(without(F.col("text"), " \t\n\x0b\x0c\r")),
        "n_symbols": F.length("text") - F.length(without(F.col("text"), SYMBOLS)),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(repeated, F.lit(0)),
    }
    # A generator of one row: else a filter on a count would be pushed down and make the count again.
    made = F.inline(F.array(F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])))
    return rows.select("row", made).select("row.*", *names)


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """Rules by rejections per cost, greedily, counted on a sample of about sample_rows rows.

    The sample is the rows whose hashed text falls in a share of the range, so the same
    rows are taken however the table is partitioned. The rules see the columns of
    `features`, and only documents that the base lets through count, as only those
    reach a rule. An empty sample keeps the given order; so do equal rates.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    text = docs.select("text")
    chosen = text.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True))
    reached = features(chosen).where(~base_failed())
    failing = F.array(*[F.coalesce(r.fails, F.lit(False)) for r in rules]).alias("failing")
    costs = [F.coalesce(r.cost, F.lit(0.0)).cast("double") for r in rules]
    patterns = reached.groupBy(failing).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"c{i}") for i, c in enumerate(costs)]).collect()  # at most a row for each row of the sample
    left, order = list(range(len(rules))), []
    while left:
        gain = {i: sum(p["n"] for p in patterns if p["failing"][i]) / max(sum(p[f"c{i}"] for p in patterns), 1e-9) for i in left}
        best = max(left, key=lambda i: (gain[i], -i))
        order.append(best)
        left.remove(best)
        patterns = [p for p in patterns if not p["failing"][best]]
    return [rules[i] for i in order]


def cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with `features`, base_failed and kept (booleans).

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows.
    kept: false if base_failed, else whether no rule of the cascade fails; a rule
    that comes out null doesn't fail. A null or empty text fails the base.
    """
    rows = features(docs.drop("base_failed", "kept")).withColumn("base_failed", base_failed())
    verdict = F.when(F.col("base_failed"), F.lit(False))
    for rule in order_rules(docs, default_rules() if rules is None else rules, sample_rows):
        verdict = verdict.when(F.coalesce(rule.fails, F.lit(False)), F.lit(False))
    return rows.withColumn("kept", verdict.otherwise(F.lit(True)))
