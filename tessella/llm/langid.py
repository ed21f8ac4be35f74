"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte 2-, 3- and 4-grams of the lower-cased text, word boundaries
included. Each hashes to a row of an embedding table; a text is the mean of its
rows, classified by a linear softmax. Table and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample, on whole texts and short
spans of them. A temperature and a rejection threshold are calibrated on rows the
descent doesn't see. Embedding times softmax folds into one small score table, so
scoring is a gather and a segment sum over Arrow buffers, without Python strings.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import held_out
from tessella.llm.words import array_slices

#: Labelled rows that are collected for training, at most about.
TRAIN_ROWS = 4_000
#: Languages whose counts may travel to every task.
SMALL_LANGS = 10_000
BITS, DIM, ORDERS = 15, 16, (2, 3, 4)
#: Share of right answers on calibration rows that the rejection threshold may cost.
REJECT_RIGHT = 0.001
UNDETERMINED = "und"

# Bytes that stand for themselves: ASCII letters and everything beyond ASCII; all else is a blank.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123], _FOLD[128:] = np.arange(97, 123), np.arange(128, 256)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # float32 (len(ORDERS) << BITS) + 1 rows; the last is for grams across two texts
    bias: np.ndarray
    temperature: float
    reject_below: float


def gram_rows(text: np.ndarray, n: int) -> np.ndarray:
    """The table row of the n-gram at each byte (meaningless for the last n - 1)."""
    h = np.zeros(len(text), np.uint32)
    for k in range(n):
        h[: len(text) - k] = h[: len(text) - k] * np.uint32(0x01000193) + text[k:]
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - BITS)
    return h.astype(np.int32) + (ORDERS.index(n) << BITS)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts and the offsets of each; null is empty."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    offsets = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1, lower.offset * 8)
    data = lower.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def scores(model: LanguageModel, texts: pa.Array, group_bytes: int = 1 << 19) -> np.ndarray:
    """Softmax inputs of each text, mean score rows plus bias, whatever its length."""
    raw, offsets = buffers(texts)
    out = np.tile(model.bias.astype(np.float64), (len(texts), 1))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + group_bytes, "right")) - 1)
        text = _FOLD[raw[offsets[at] : offsets[end]]]
        bounds = offsets[at : end + 1] - offsets[at]
        full = np.flatnonzero(np.diff(bounds) > 0)
        if len(full):
            total, grams = 0.0, np.zeros(len(full))
            for n in ORDERS:
                rows = gram_rows(text, n)
                for k in range(1, n):  # grams that reach into the next text
                    cut = bounds[1:][full] - k
                    rows[cut[cut >= bounds[:-1][full]]] = len(model.table) - 1
                total = total + np.add.reduceat(model.table[rows], bounds[:-1][full], axis=0, dtype=np.float64)
                grams += np.maximum(np.diff(bounds)[full] - n + 1, 0)
            out[at + full] += total / np.maximum(grams, 1)[:, None]
        at = end
    return out


def _examples(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(rows, weights) of each whole text and of a short span of it."""
    spans, y = list(texts), list(labels)
    for text, label in zip(texts, labels, strict=True):
        words = text.split()
        if len(words) > 4:
            n = int(min(len(words), rng.integers(3, 40)))
            a = int(rng.integers(0, len(words) - n + 1))
            spans.append(" ".join(words[a : a + n]))
            y.append(label)
    raw, offsets = buffers(pa.array(spans, pa.large_string()))
    found = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        text = _FOLD[raw[a:b]]
        rows = np.concatenate([gram_rows(text, n)[: max(len(text) - n + 1, 0)] for n in ORDERS])
        rows, counts = np.unique(rows, return_counts=True)
        found.append((rows, (counts / max(counts.sum(), 1)).astype(np.float32)))
    return found, np.array(y)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 6, rate: float = 8.0, seed: int = 5) -> LanguageModel:
    """Texts with their languages to a model; the same input gives the same model.

    Without any row the model knows no language and every prediction is `und`.
    """
    names = tuple(sorted(set(langs)))
    width = (len(ORDERS) << BITS) + 1
    if not names:
        return LanguageModel((), np.zeros((width, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    y = np.array([names.index(x) for x in langs])
    cut = max(1, len(order) * 4 // 5)
    fit, rest = order[:cut], order[cut:] if len(order) > cut else order[:cut]
    examples, target = _examples([texts[i] for i in fit], y[fit], rng)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (width, DIM)).astype(np.float32)
    emb[-1] = 0
    w, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            rows, weight = examples[i]
            done += 1
            if not len(rows):
                continue
            step = rate * (1 - done / (steps + 1))
            mean = weight @ emb[rows]
            error = softmax(mean @ w + bias)
            error[target[i]] -= 1
            back = w @ error
            w -= 0.05 * step * np.outer(mean, error)
            bias -= 0.001 * step * error
            emb[rows] -= (step * weight)[:, None] * back
    model = LanguageModel(names, (emb @ w).astype(np.float32), bias, 1.0, 0.0)
    return calibrate(model, [texts[i] for i in rest], y[rest], rng)


def calibrate(model: LanguageModel, texts: list[str], y: np.ndarray, rng: np.random.Generator) -> LanguageModel:
    """Temperature of least log loss, then the threshold below which few right answers lie."""
    spans = [" ".join(t.split()[: int(rng.integers(4, 60))]) for t in texts]
    z = scores(model, pa.array([*texts, *spans], pa.large_string()))
    y = np.concatenate([y, y])
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 10, 60), key=loss)
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    threshold = min(0.5, float(np.quantile(right, REJECT_RIGHT))) if len(right) else 0.0
    return LanguageModel(model.languages, model.table, model.bias, float(temperature), threshold)


def fit(docs: DataFrame, max_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trains on at most about max_rows rows with text and language outside the held-out fold.

    Half of the rows are shared out in proportion, half evenly between languages, so that
    rare ones are learned too. The rows are those whose hashed id falls in their
    language's share of the range, so the same rows are taken however the table is
    partitioned.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counts = usable.groupBy("l").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("langs")).first()
    if total["n"] > max_rows:
        share = max_rows / 2 / total["n"] + F.lit(max_rows / 2 / total["langs"]) / F.col("n")
        taken = F.pmod(F.xxhash64(F.lit(3), "i"), F.lit(1 << 30)) < share * (1 << 30)
        of = counts.select(F.col("l").alias("of"), "n")
        of = F.broadcast(of) if total["langs"] <= SMALL_LANGS else of  # else texts are shuffled
        usable = usable.join(of, F.col("l") == F.col("of")).where(taken).select("i", "t", "l")
    made = usable.limit(2 * max_rows).repartition(1).mapInArrow(_learn, "model binary").first()  # one task for a bounded sample
    return pickle.loads(made["model"]) if made else train([], [])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of all rows (i, t, l); trained in a task, as its examples would stay in the driver's memory."""
    rows = [b for b in batches if b.num_rows]
    got = pa.Table.from_batches(rows).sort_by([("i", "ascending"), ("t", "ascending")]) if rows else {"t": pa.array([]), "l": pa.array([])}
    model = train(got["t"].to_pylist(), got["l"].to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


KIND = "struct<lang_pred:string,score:double,rejected:boolean>"


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (replacing columns so named).

    A null text, or one without a letter, is `und` with score 0 and rejected. Texts
    are scored whole and each by itself: repeated rows get the same answer, an empty
    table stays empty. rejected: the score is below the calibrated threshold.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # table size fixed by BITS and the number of languages

    @F.arrow_udf(KIND)
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [answers(held.value, part) for part in array_slices(texts)]
            yield pa.concat_arrays(parts) if parts else answers(held.value, texts)

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    name = max(docs.columns, key=len) + "_language"  # clashes with none
    return docs.select(*kept, language(F.col(text_col)).alias(name)).select(*kept, f"{name}.*")


def answers(m: LanguageModel, texts: pa.Array) -> pa.StructArray:
    """lang_pred, score and rejected of each text."""
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if m.languages and len(texts):
        p = softmax(scores(m, texts) / m.temperature)
        best, score = p.argmax(axis=1), p.max(axis=1)
    else:
        letters, best, score = np.zeros(len(texts), bool), np.zeros(len(texts), int), np.zeros(len(texts))
    names = np.array([*m.languages, UNDETERMINED], object)
    score = np.where(letters, score, 0.0)
    return pa.StructArray.from_arrays([pa.array(names[np.where(letters, best, -1)], pa.string()), pa.array(score), pa.array(~letters | (score < m.reject_below))], ["lang_pred", "score", "rejected"])
