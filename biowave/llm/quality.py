"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted with numpy on the statistics of a bounded, documented sample of labelled rows; scoring maps over
every document and walks all trees at once through flat arrays.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 16_000  # labelled rows that the trees are fitted on, at most
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CLASS = np.zeros(256, np.int64)  # 0 letters and bytes of other scripts, 1 digits, 2 capitals, 3 blanks, 4 lines' ends, 5 the rest
for _k in range(128):
    _c = chr(_k)
    _CLASS[_k] = 1 if _c.isdigit() else 2 if "A" <= _c <= "Z" else 4 if _c == "\n" else 3 if _c.isspace() else 0 if _c.isalpha() else 5
_CLASS[128:] = 6  # parts of characters beyond ASCII
STATISTICS = 24


def statistics(text: str | None) -> list[float]:
    """STATISTICS numbers about a whole text; all 0 without words."""
    raw = (text or "").encode("utf-8")
    words = WORD.findall(raw)
    if not words:
        return [0.0] * STATISTICS
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_CLASS, weights=byte, minlength=7) / len(raw)
    share = byte[byte > 0] / len(raw)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    n = len(words)
    most = counts.most_common(1)[0][1]
    pairs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    odd = byte[[35, 36, 37, 38, 42, 124, 60, 62, 123, 125]].sum() / len(raw)  # # $ % & * | < > { }
    length = np.fromiter(map(len, words), np.int64, n)
    packed = len(zlib.compress(raw[: 1 << 16], 1)) / min(len(raw), 1 << 16) if len(raw) <= 1 << 16 else len(zlib.compress(raw, 1)) / len(raw)
    return [
        math.log1p(len(raw)), math.log1p(n), *kind[1:].tolist(), float(-(share * np.log(share)).sum()),
        float(length.mean()), float(length.std()), float(length.max()), len(counts) / n, len(counts) / math.sqrt(n), most / n,
        pairs / n, odd, byte[46] / n, byte[44] / n, len(lines) / n, len(line_counts) / max(1, len(lines)),
        max(line_counts.values()) / max(1, len(lines)), float((length <= 3).mean()), packed,
    ]


@dataclass
class Trees:
    """Flat arrays: node k goes to left[k] or right[k] by x[feature[k]] <= cut[k]; a leaf goes to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            at = np.repeat(self.roots[None], len(part), axis=0)
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[row, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out[a : a + 4096] = self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-(self.base + out)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Trees:
    """Logistic boosting; every split is chosen from histograms of gradients over quantile bins."""
    n, d = x.shape if len(x) else (0, STATISTICS)
    p = (y.sum() + 1) / (n + 2)
    base = math.log(p / (1 - p))
    flat: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}

    def node(value: float) -> int:
        k = len(flat["value"])
        for name, v in zip(flat, (0, np.inf, k, k, value), strict=True):
            flat[name].append(v)
        return k

    roots = []
    if n >= 2 * least and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1) + np.arange(d) * bins
        margin = np.full(n, base)
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-margin))
            grad, hess = y - prob, prob * (1 - prob)
            roots.append(node(0.0))
            level = [(roots[-1], np.arange(n), 0)]
            while level:
                k, rows, deep = level.pop()
                value = rate * grad[rows].sum() / (hess[rows].sum() + ridge)
                flat["value"][k] = value
                best = None
                if deep < depth and len(rows) >= 2 * least:
                    c = code[rows].ravel()
                    g, h, m = (
                        np.bincount(c, w, d * bins).reshape(d, bins).cumsum(axis=1)[:, :-1]
                        for w in (np.repeat(grad[rows], d), np.repeat(hess[rows], d), None)
                    )
                    gs, hs = grad[rows].sum(), hess[rows].sum()
                    gain = g**2 / (h + ridge) + (gs - g) ** 2 / (hs - h + ridge) - gs**2 / (hs + ridge)
                    gain[(m < least) | (len(rows) - m < least)] = -np.inf
                    j, b = np.unravel_index(gain.argmax(), gain.shape)
                    best = (int(j), int(b)) if gain[j, b] > 1e-6 and b < len(edges[j]) else None
                if best is None:
                    margin[rows] += value
                    continue
                j, b = best
                to_left = code[rows, j] - j * bins <= b
                flat["feature"][k], flat["cut"][k] = j, edges[j][b]
                flat["left"][k], flat["right"][k] = node(0.0), node(0.0)
                level += [(flat["left"][k], rows[to_left], deep + 1), (flat["right"][k], rows[~to_left], deep + 1)]
    arrays = {k: np.array(v, float if k in ("cut", "value") else np.int64) for k, v in flat.items()}
    return Trees(**arrays, roots=np.array(roots, np.int64), depth=depth, base=base)


def measured(docs: DataFrame, keep: str) -> DataFrame:
    """The columns of `keep` (a schema) and the statistics of column _text, as an array."""
    names = [x.split()[0] for x in keep.split(", ")]

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[names].assign(_x=[statistics(t) for t in part["_text"]])

    return docs.mapInPandas(batch, f"{keep}, _x array<double>")


def sampled_labels(labels: DataFrame, fold: Column, label_col: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """Up to `rows` (id, label 0 or 1) of the fold, chosen by a hash of the id; of contradicting labels the larger."""
    known = labels.where(fold & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_doc")).agg(F.max(label_col).cast("double").alias("_y"))
    return known.orderBy(F.xxhash64("_doc", F.lit("sample")), "_doc").limit(rows)


def classify(
    docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: id, score, predicted.

    The trees see the statistics of the text alone. fold is a condition over the labels' rows from which they learn, and
    at most `sample_rows` of them are used. Null and empty texts get the score of a text without words. With no usable
    label, or labels of one kind, the score is the smoothed share of label 1. Repeated rows are scored each, other columns
    are ignored, and an empty input gives an empty result.
    """
    known = sampled_labels(labels, fold, label_col, sample_rows, id_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    # the sample's ids are at most sample_rows numbers
    train = rows.join(F.broadcast(known), rows["_id"] == known["_doc"]).select("_id", "_text", "_y")
    got = measured(train, "_id bigint, _y double").toPandas().sort_values("_id", kind="stable")
    x = np.array(got["_x"].tolist(), float).reshape(len(got), STATISTICS)
    model = rows.sparkSession.sparkContext.broadcast(fit(x, got["_y"].to_numpy()))

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            stats = np.array([statistics(t) for t in part["_text"]], float).reshape(len(part), STATISTICS)
            yield pd.DataFrame({"_id": part["_id"], "score": model.value.score(stats)})

    scored = rows.mapInPandas(batch, "_id bigint, score double")
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
