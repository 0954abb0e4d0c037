"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

One model a class predicts each byte of a word from those before it: the class's own discounted counts at the longest
context, backed off to a Kneser-Ney chain of counts that both classes share, so what is rare in both says nothing. A
word's log-likelihood ratio follows, and a document is judged by ratios normalised by length: over the whole text, and
over its few most toxic words, which a long text would otherwise drown. A logistic curve
fitted on labelled documents outside the counts turns these into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # letters and digits; marks around a word don't make another expression
ORDER = 6  # bytes of an n-gram with the predicted one; at most 7 fit a key exactly
DISCOUNT = 0.75
SAMPLE_ROWS = 4_000  # labelled rows of each class that are used, at most
CACHED_WORDS = 200_000  # ratios that a worker remembers
STATISTICS = 6
TOP = 5  # words that count as a document's most toxic


def _positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' bytes between a start and an end mark; each byte's word and its place there."""
    text = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    return text, word, np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _keys(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place, as one number with n above them: exact for n <= 7."""
    key = np.full(len(at), n << 56, np.uint64)
    for k in range(n):
        key |= text[at - k] << np.uint64(8 * k)
    return key


def _context(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | np.uint64((n - 1) << 56)


def _shorter(keys: np.ndarray, n: int) -> np.ndarray:
    """The n-grams without their first byte."""
    return (keys & np.uint64((1 << (8 * (n - 1))) - 1)) | np.uint64((n - 1) << 56)


@dataclass
class Table:
    """Sorted keys with a row of numbers each; what isn't there is zero."""

    keys: np.ndarray
    values: np.ndarray

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), self.values.shape[1]))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at] * (self.keys[at] == keys)[:, None]


def _summed(keys: np.ndarray, values: np.ndarray) -> Table:
    found, at = np.unique(keys, return_inverse=True)
    return Table(found, np.stack([np.bincount(at, v, len(found)) for v in values.T], axis=1).astype(np.float32))


@dataclass
class Models:
    """grams[n]: shared, ordinary and toxic counts of n-grams; contexts[n]: their sums, then numbers, by context."""

    order: int
    grams: list[Table]
    contexts: list[Table]
    weights: np.ndarray  # of the logistic curve over the statistics

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary)."""
        out = np.zeros(len(words))
        text, word, place = _positions(words)
        at = np.flatnonzero(place > 0)
        shared = np.full(len(at), 1 / 256)
        depth = np.minimum(place[at] + 1, self.order)
        for n in range(1, self.order + 1):
            use = np.flatnonzero(depth >= n)
            keys = _keys(text, at[use], n)
            gram, ctx = self.grams[n][keys], self.contexts[n][_context(keys, n)]
            seen = ctx[:, 0] > 0
            total = np.where(seen, ctx[:, 0], 1)
            lower = np.where(seen, DISCOUNT * ctx[:, 3] / total, 1) * shared[use]
            shared[use] = np.where(seen, np.maximum(gram[:, 0] - DISCOUNT, 0) / total, 0) + lower
            last = depth[use] == n
            g, c, s = gram[last], ctx[last], shared[use][last]
            logs = []
            for k in (1, 2):
                known = c[:, k] > 0
                total = np.where(known, c[:, k], 1)
                own = np.maximum(g[:, k] - DISCOUNT, 0) / total
                logs.append(np.log(np.where(known, own + DISCOUNT * c[:, k + 3] / total * s, s)))
            out += np.bincount(word[at[use][last]], logs[1] - logs[0], len(words))
        return out

    def statistics(self, text: str | None, ratio) -> list[float]:
        """STATISTICS numbers about a whole text; ratio gives a word's number. All 0 without words."""
        words = WORD.findall((text or "").encode("utf-8").lower())
        if not words:
            return [0.0] * STATISTICS
        r = np.fromiter(map(ratio, words), float, len(words))
        top = np.sort(np.partition(r, -TOP)[-TOP:] if len(r) > TOP else np.append(r, np.zeros(TOP)))[::-1][:TOP]
        return [float(r.mean()), float(top[0]), float(top[1]), float(top[-1]), float(top.mean()), math.log(len(r))]

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_scaled(stats) @ self.weights, -50, 50)))


def _scaled(stats: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(stats)), np.clip(stats[:, 0], -5, 5), np.clip(stats[:, 1:5], -20, 20) / 4, stats[:, 5] / 5])


def grams_of(words: list[bytes], ordinary: np.ndarray, toxic: np.ndarray, order: int = ORDER) -> pd.DataFrame:
    """Every n-gram of words, n up to order, with its counts in the two classes."""
    text, word, place = _positions(words)
    out = []
    for n in range(1, order + 1):
        at = np.flatnonzero((place > 0) & (place + 1 >= n))
        found, where = np.unique(_keys(text, at, n), return_inverse=True)
        sums = [np.bincount(where, v[word[at]], len(found)).astype(np.int64) for v in (ordinary, toxic)]
        out.append(pd.DataFrame({"gram": found.view(np.int64), "ordinary": sums[0], "toxic": sums[1]}))
    return pd.concat(out)


def count(grams: pd.DataFrame, order: int = ORDER) -> Models:
    """Models of the classes from n-grams and their counts (see grams_of), each n-gram once."""
    keys = grams["gram"].to_numpy(np.int64).view(np.uint64)
    sort = np.argsort(keys)
    keys, both = keys[sort], np.column_stack([grams["ordinary"], grams["toxic"]]).astype(np.float32)[sort]
    size = (keys >> np.uint64(56)).astype(np.int64)
    raw = {n: Table(keys[size == n], both[size == n]) for n in range(1, order + 1)}
    tables, contexts = [None] * (order + 1), [None] * (order + 1)
    for n in range(1, order + 1):
        keys, c = raw[n].keys, raw[n].values
        shared = c.sum(axis=1)
        if n < order:  # the number of bytes before an n-gram; one that begins a word has none, and keeps its counts
            longer = _summed(_shorter(raw[n + 1].keys, n + 1), np.ones((len(raw[n + 1].keys), 1)))
            starts = (keys >> np.uint64(8 * (n - 1))) & np.uint64(255) == 2
            shared = np.where(starts & (n > 1), shared, longer[keys][:, 0])
        tables[n] = Table(keys, np.column_stack([shared, c]).astype(np.float32))
        sums = np.column_stack([tables[n].values, (tables[n].values > 0).astype(np.float32)])
        contexts[n] = _summed(_context(keys, n), sums)
    return Models(order, tables, contexts, np.zeros(STATISTICS + 1))


def calibrate(stats: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic curve by Newton's method; classes weigh as the square roots of their sizes."""
    x = _scaled(stats)
    share = np.where(y == 1, 1 / math.sqrt(max(1, (y == 1).sum())), 1 / math.sqrt(max(1, (y == 0).sum())))
    share *= len(y) / share.sum()
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (share * (p - y)) + penalty * w
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + np.diag(penalty), slope)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _remembering(models: Models):
    """A function that gives words' ratios, worked out together for the new words of a batch."""
    cache: dict[bytes, float] = {}

    def learn(texts) -> None:
        if len(cache) > CACHED_WORDS:
            cache.clear()
        new = {w for t in texts if t for w in WORD.findall(t.encode("utf-8").lower())}
        new = sorted(new.difference(cache))
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            cache.update(zip(part, models.ratios(part).tolist(), strict=True))

    return learn, cache.__getitem__


def _slices(texts: list[str | None], most: int = 1 << 21) -> Iterator[slice]:
    """Runs of texts with about `most` characters, so that what a run needs is bounded."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for some in _slices(part["_text"].tolist()):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(part["_text"].iloc[some], part["_y"].iloc[some], strict=True):
                found[int(y)].update(WORD.findall((t or "").encode("utf-8").lower()))
            words = sorted({**found[0], **found[1]})
            if words:
                yield grams_of(words, *(np.array([c[w] for w in words], float) for c in found))


def train(docs: DataFrame, labels: DataFrame, fold: Column, label_col: str = "toxic", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Models:
    """Models from at most sample_rows labelled rows of each class; docs has columns _id and _text."""
    spark = docs.sparkSession
    known = labels.where(fold & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_doc")).agg(F.max(label_col).cast("int").alias("_y"))
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_doc", F.lit("sample")), "_doc").limit(sample_rows) for y in (0, 1)]
    sample = docs.join(F.broadcast(picked[0].union(picked[1])), F.col("_id") == F.col("_doc")).select("_id", "_text", "_y")
    # the fourth part of the sample is for the curve, so that no document is judged by its own counts
    apart = F.pmod(F.xxhash64("_id", F.lit("curve")), F.lit(4)) == 0
    grams = sample.where(~apart).mapInPandas(_counted, "gram bigint, ordinary bigint, toxic bigint")
    grams = grams.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    models = count(grams.toPandas())  # all of them, seen once or often; their number is bounded by the sample
    shared = spark.sparkContext.broadcast(models)
    measured = sample.where(apart).mapInPandas(_measured(shared), f"_id bigint, _y int, _x array<double>").toPandas()
    measured = measured.sort_values("_id", kind="stable")
    if len(measured) and 0 < measured["_y"].sum() < len(measured):
        models.weights = calibrate(np.array(measured["_x"].tolist(), float), measured["_y"].to_numpy())
    shared.unpersist()
    return models


def _measured(shared):
    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learn, ratio = _remembering(shared.value)
        for part in parts:
            texts = part["_text"].tolist()
            stats = []
            for s in _slices(texts):
                learn(texts[s])
                stats += [shared.value.statistics(t, ratio) for t in texts[s]]
            yield part.drop(columns="_text").assign(_x=stats)

    return batch


def classify(
    docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: id, score, predicted.

    The score sees the whole text and nothing else. Labels are learnt from rows that meet `fold`, at most `sample_rows`
    of each class; of contradicting labels of an id the larger counts. Null and empty texts get the score of a text without
    words; without labels of both classes every score is 0.5. Repeated rows are scored each, other columns are ignored, and
    an empty input gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    shared = rows.sparkSession.sparkContext.broadcast(train(rows, labels, fold, label_col, id_col, sample_rows))
    measured = _measured(shared)

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in measured(parts):
            stats = np.array(part["_x"].tolist(), float).reshape(len(part), STATISTICS)
            yield pd.DataFrame({"_id": part["_id"], "score": shared.value.score(stats)})

    scored = rows.mapInPandas(batch, "_id bigint, score double")
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The rows of docs, all columns as they are, that classify() wouldn't call toxic. Rows are judged where they stand."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    shared = rows.sparkSession.sparkContext.broadcast(train(rows, labels, fold, label_col, id_col, sample_rows))
    measured, at = _measured(shared), docs.columns.index(text_col)

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def texts() -> Iterator[pd.DataFrame]:
            for part in parts:
                waiting.append(part)
                yield pd.DataFrame({"_text": pd.Series(part.column(at).to_pylist(), dtype=object)})

        for part in measured(texts()):
            stats = np.array(part["_x"].tolist(), float).reshape(len(part), STATISTICS)
            yield waiting.pop().filter(pa.array(shared.value.score(stats) < threshold))

    return docs.mapInArrow(batch, docs.schema)
