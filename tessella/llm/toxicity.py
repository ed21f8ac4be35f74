"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features: densities of a weighted lexicon (words and word beginnings), lexicon words
near a second person, capitals, punctuation, obfuscated spellings and lexicon words
behind them. The lexicon, the trees and the calibration are learned from three
separate parts of a bounded sample of labelled rows, so none flatters the next.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import held_out
from tessella.llm.words import segment_max, segment_sum, split_words

#: Labelled rows that are collected for training, at most about.
TRAIN_ROWS = 12_000
#: A lexicon entry's least log-odds and least number of toxic training texts; letters of a word beginning.
LOG_ODDS, LEAST_TEXTS, STEM = 1.5, 3, 5
#: Words between a lexicon word and a second person that count as near.
NEAR = 3
# Second-person words of English, German, French and Spanish.
SECOND_PERSON = [
    "you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine",
    "ihr", "euch", "euer", "tu", "te", "toi", "ton", "ta", "tes",
    "vous", "votre", "vos", "ti", "usted", "ustedes", "vosotros",
]
# Signs that stand for letters in obfuscated spellings.
DISGUISE = {"@": "a", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "!": "i", "*": "", "_": "", ".": "", "-": ""}


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def _plain(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\p{L}]+|[^\p{L}]+$", "")


def _weights(words: pa.Array, entries: dict[str, float]) -> np.ndarray:
    if not entries or not len(words):
        return np.zeros(len(words))
    at = pc.index_in(words, value_set=pa.array(list(entries), pa.large_string())).fill_null(len(entries)).to_numpy(zero_copy_only=False)
    return np.array([*entries.values(), 0.0])[at]


def learn_lexicon(texts: list[str], y: np.ndarray) -> Lexicon:
    """Words and word beginnings by smoothed log-odds of toxic against other texts."""
    found = []
    words, codes, bounds = split_words(pa.array(texts, pa.large_string()))
    plain = _plain(words)
    for entries in (plain, pc.utf8_slice_codeunits(plain, 0, STEM)):
        names = entries.to_pylist()
        seen = (Counter(), Counter())
        for i, label in enumerate(y):
            seen[int(label)].update({names[c] for c in set(codes[bounds[i] : bounds[i + 1]])})
        n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
        odds = {w: float(np.log((k + 0.5) / (n1 + 1)) - np.log((seen[0][w] + 0.5) / (n0 + 1))) for w, k in seen[1].items() if w and k >= LEAST_TEXTS}
        found.append({w: v for w, v in sorted(odds.items()) if v >= LOG_ODDS})
    return Lexicon(*found)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of dense features for each whole text; null and empty texts give zeros."""
    words, codes, bounds = split_words(texts)
    n = np.diff(bounds)
    per = np.maximum(n, 1)
    plain = _plain(words)
    weight = _weights(plain, lexicon.words)
    stem = _weights(pc.utf8_slice_codeunits(plain, 0, STEM), lexicon.stems)
    masked = pc.match_substring_regex(words, r"\p{L}[0-9@$!*_.\-]+\p{L}").to_numpy(zero_copy_only=False)
    bare = words
    for sign, letter in DISGUISE.items():
        bare = pc.replace_substring(bare, sign, letter)
    bare = _plain(bare)
    behind = np.where(masked, np.maximum(_weights(bare, lexicon.words), _weights(pc.utf8_slice_codeunits(bare, 0, STEM), lexicon.stems)), 0)
    weight, stem = np.maximum(weight, 0), np.maximum(stem, behind)
    second = pc.is_in(plain, value_set=pa.array(SECOND_PERSON, pa.large_string())).to_numpy(zero_copy_only=False)
    shouted = pc.match_substring_regex(words, r"^\P{Ll}*\p{Lu}{2}\P{Ll}*$").to_numpy(zero_copy_only=False)
    capital = pc.match_substring_regex(words, r"^\p{Lu}").to_numpy(zero_copy_only=False)
    marks = pc.add(pc.count_substring(words, "!"), pc.count_substring(words, "?")).to_numpy(zero_copy_only=False)
    points = pc.add(pc.count_substring(words, "."), pc.count_substring(words, ",")).to_numpy(zero_copy_only=False)
    hit = (weight > 0) | (stem > 0)
    text_of = np.repeat(np.arange(len(n), dtype=np.int32), n)
    person, toxic = second[codes], hit[codes]
    near = person.copy()
    for k in range(1, NEAR + 1):
        same = text_of[k:] == text_of[:-k] if k < len(codes) else np.zeros(0, bool)
        near[k:] |= person[:-k] & same if k < len(codes) else False
        near[:-k] |= person[k:] & same if k < len(codes) else False
    total = lambda v: segment_sum(v[codes].astype(np.float32), bounds)
    words_hit, stems_hit = total(weight > 0), total(stem > 0)
    close = segment_sum((near & toxic).astype(np.float32), bounds)
    return np.column_stack([
        words_hit / per, np.log1p(words_hit), total(weight) / per, segment_max(weight[codes], bounds),
        stems_hit / per, np.log1p(stems_hit), total(stem) / per, segment_max(stem[codes], bounds),
        close / per, np.log1p(close), total(second) / per,
        total(shouted) / per, total(capital) / per, total(marks) / per, total(points) / per,
        total(masked) / per, total(behind > 0) / per, np.log1p(n),
    ])


@dataclass(frozen=True)
class Tree:
    """A full binary tree in level order: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        for _ in range(int(np.log2(len(self.feature) + 1))):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return self.value[at - len(self.feature)]


def grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float = 1.0, ridge: float = 1.0) -> Tree:
    """A tree on binned features that fits gradients g and curvatures h, level by level."""
    inner = 2**depth - 1
    feature, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(g), int)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        best, split = 1e-6, None
        for f, e in enumerate(edges):
            if not len(e) or len(rows) < 2:
                continue
            gs = np.cumsum(np.bincount(bins[rows, f], g[rows], len(e) + 1))
            hs = np.cumsum(np.bincount(bins[rows, f], h[rows], len(e) + 1))
            left, right = hs[:-1], hs[-1] - hs[:-1]
            gain = gs[:-1] ** 2 / (left + ridge) + (gs[-1] - gs[:-1]) ** 2 / (right + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
            gain[(left < least) | (right < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, split = gain[k], (f, k)
        if split:
            feature[node], cut[node] = split[0], edges[split[0]][split[1]]
            at[rows] = 2 * node + 1 + (bins[rows, split[0]] > split[1])
        else:
            at[rows] = 2 * node + 1
    leaf = at - inner
    value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
    return Tree(feature, cut, value)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15) -> tuple[float, list[Tree]]:
    """Log-odds of the base rate and trees of the logistic loss."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
    edges = [np.unique(np.concatenate([e, [0.0]])) for e in edges]
    bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    z, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = grow(bins, edges, p - y, p * (1 - p), depth)
        tree = Tree(tree.feature, tree.cut, rate * tree.value)
        z += tree(x)
        trees.append(tree)
    return base, trees


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a non-decreasing map from z to the weighted mean of y.
    Equal z are one point."""
    points, back = np.unique(z, return_inverse=True)
    sums, weights = np.bincount(back, weight * y), np.bincount(back, weight)
    blocks: list[list[float]] = []
    for at, total, w in zip(points.tolist(), sums.tolist(), weights.tolist(), strict=True):
        blocks.append([total, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    return np.array([v for s, n, lo, hi in blocks for v in (lo, hi)]), np.array([s / n for s, n, _, _ in blocks for _ in (0, 1)])


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    base: float
    trees: list[Tree]
    knots: tuple[np.ndarray, np.ndarray]

    def margin(self, texts: pa.Array) -> np.ndarray:
        x = features(texts, self.lexicon)
        return self.base + sum(t(x) for t in self.trees) if self.trees else np.full(len(x), self.base)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probability; a hundredth of the raw one keeps order within flat stretches."""
        z = self.margin(texts)
        raw = 1 / (1 + np.exp(-z))
        return 0.99 * np.interp(z, *self.knots) + 0.01 * raw if len(self.knots[0]) else raw


def train(texts: list[str], y: np.ndarray, weight: np.ndarray | None = None, seed: int = 11) -> ToxicityModel:
    """Half of each label's rows for the lexicon, three tenths for the trees, a fifth for calibration.

    weight: how many rows each stands for, which the calibration takes account of. With rows of one label only, the score is that
    label's smoothed rate for every text.
    """
    weight = np.ones(len(y)) if weight is None else weight
    if len(set(y.tolist())) < 2:
        return ToxicityModel(Lexicon(), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), [], (np.zeros(0), np.zeros(0)))
    order = np.random.default_rng(seed).permutation(len(y))
    parts = [np.split(own, [len(own) // 2, len(own) * 4 // 5]) for own in (order[y[order] == 0], order[y[order] > 0])]
    a, b, c = (np.concatenate(both) for both in zip(*parts, strict=True))
    lexicon = learn_lexicon([texts[i] for i in a], y[a])
    base, trees = boost(features(pa.array([texts[i] for i in b], pa.large_string()), lexicon), y[b])
    model = ToxicityModel(lexicon, base, trees, (np.zeros(0), np.zeros(0)))
    if not len(c):
        return model
    margin = model.margin(pa.array([texts[i] for i in c], pa.large_string()))
    return ToxicityModel(lexicon, base, trees, isotonic(margin, y[c], weight[c]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Trains on at most about max_rows rows with a label and a text outside the held-out fold.

    Half of the rows are shared out in proportion, half evenly between the two labels, so
    that a rare label is learned too; in the calibration each row weighs what it stands for.
    Which rows follows from a hash of their ids and a count of the labels. Only the chosen ids,
    bounded by max_rows, are broadcast to the scan of texts. An id with several labels
    counts as toxic if one says so; of an id's several texts the one of least hash is learned,
    so what reaches the driver is bounded by ids however often they repeat.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, n_toxic = usable.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    shares = [min(1.0, max_rows / 2 / max(n, 1) + max_rows / 4 / max(of, 1)) if n > max_rows else 1.0 for of in (n - n_toxic, n_toxic)]
    share = F.when(F.col("toxic") > 0, shares[1]).otherwise(shares[0])
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    chosen = chosen.select(F.col("doc_id").alias("_id"), "toxic").limit(2 * max_rows)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.select("doc_id", "text", "toxic").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = np.array(got["toxic"].to_pylist(), dtype=float)
    return train(got["text"].to_pylist(), y, 1 / np.where(y > 0, shares[1], shares[0]))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= 0.5), replacing columns so named.

    Null and empty texts are scored like any other, on features that are all 0.
    Each text counts by itself, so repeated rows agree; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training rows

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(held.value.score(texts))

    rows = docs.drop("score", "predicted").withColumn("score", toxicity(F.col(text_col)))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
