"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text; a preference pair is a document
labelled 1 over one labelled 0, and the logistic loss on the difference of their features
is minimised by Newton steps. A quantile of the training scores is the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import batch

#: Byte classes that are counted, each against the bytes or the words of a text.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "letter": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789", "line": b"\n", "stop": b".?;:", "comma": b",", "bang": b"!", "pipe": b"|",
    "symbol": b"*&$%#^~@=_\\", "bracket": b"<>{}[]()", "high": bytes(range(128, 256)),
}
NAMES = (
    "empty", "log_words", "word_bytes", "upper_share", "digit_share", "high_share", "line_per_word", "stop_per_word",
    "comma_per_word", "bang_per_word", "pipe_per_word", "symbol_per_word", "bracket_per_word", "same_as_before",
    "same_as_two_before", "distinct_share", "log_distinct", "top_word_share", "repeated_line_share", "long_word_share",
)

#: Pairs whose differences are held at once.
STRETCH = 1 << 15


def features(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; a null text is an empty one."""
    return np.concatenate([_features(data, offsets) for _, data, offsets in batch.slices(texts)] or [np.zeros((0, len(NAMES)))])


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often its most frequent one occurs."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(rows)
    np.maximum.at(top, owner, np.diff(np.append(first, len(key))))
    return np.bincount(owner, minlength=rows).astype(float), top


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    row, start, end, h = batch.words(data, offsets, lower=False)
    count = np.bincount(row, minlength=rows).astype(float)
    some, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    hist = np.zeros((rows, 256))
    for i in range(rows):
        hist[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
    many = {name: hist[:, list(members)].sum(axis=1) for name, members in CLASSES.items()}
    same = [np.bincount(row[k:][(row[k:] == row[:-k]) & (h[k:] == h[:-k])], minlength=rows) for k in (1, 2)]
    distinct, top = _distinct(row, h, rows)
    ends = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], ends + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    line_hash = batch.span_hashes(batch.prefix_hashes(data), line_start, line_end - (data[line_end - 1] == 10)) if len(line_start) else np.zeros(0, np.uint64)
    lines = np.bincount(line_row, minlength=rows)
    kinds, _ = _distinct(line_row, line_hash, rows)
    length = np.bincount(row, weights=end - start, minlength=rows)
    long_words = np.bincount(row[end - start > 24], minlength=rows)
    root = lambda x: np.sqrt(np.minimum(x, 4.0))
    return np.column_stack([
        count == 0, np.log1p(count), np.minimum(length / some, 40), root(many["upper"] / np.maximum(many["letter"], 1)), root(many["digit"] / size),
        root(many["high"] / size), root(many["line"] / some), root(many["stop"] / some), root(many["comma"] / some), root(many["bang"] / some),
        root(many["pipe"] / some), root(many["symbol"] / some), root(many["bracket"] / some), root(same[0] / some), root(same[1] / some),
        distinct / some, np.log1p(distinct), root(top / some), root((lines - kinds) / np.maximum(lines, 1)), root(long_words / some),
    ]).astype(float)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, *, partners: int = 48, penalty: float = 1e-3, seed: int = 5) -> Ranker:
    """Fit strengths to pairs (label 1 over label 0): each row meets ``partners`` of the other label.

    Without rows of both labels all strengths are 0, so every score is a half.
    """
    f = x.shape[1]
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(f), np.ones(f))
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(f), 0.0)
    draw = np.random.default_rng(seed)
    winner = np.concatenate([np.repeat(good, partners), draw.choice(good, len(bad) * partners)])
    loser = np.concatenate([draw.choice(bad, len(good) * partners), np.repeat(bad, partners)])
    w = np.zeros(f)
    for _ in range(25):
        gradient, hessian = -penalty * w, penalty * np.eye(f)
        for lo in range(0, len(winner), STRETCH):
            pair = z[winner[lo : lo + STRETCH]] - z[loser[lo : lo + STRETCH]]
            p = 1 / (1 + np.exp(-np.clip(pair @ w, -30, 30)))
            gradient += pair.T @ (1 - p) / len(winner)
            hessian += (pair * (p * (1 - p))[:, None]).T @ pair / len(winner)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    return Ranker(mean, scale, w, _threshold(strength, y))


def _threshold(strength: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the scores that parts the labels best (balanced accuracy)."""
    levels = np.linspace(0.002, 0.998, 499)
    at = np.unique(np.quantile(strength, levels, method="midpoint"))
    kept = strength[None, :] >= at[:, None]
    good = (kept & (y == 1)).sum(axis=1) / max((y == 1).sum(), 1) + (~kept & (y == 0)).sum(axis=1) / max((y == 0).sum(), 1)
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float(at[best].mean())


def held_out(doc_id):
    """Rows that are never learnt from; a row without doc_id is none of them and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000) -> Ranker:
    """Fit on at most ``max_labelled`` labelled rows (by hash of doc_id), none of them held out.

    The bound keeps what is joined by broadcast and what reaches the driver small: an id
    and a label, then one row of features, for each. Rows without a label or text label
    are left out; text alone is looked at.
    """
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(features(b.column(2))), type=pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    found = rows.mapInArrow(measure, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(NAMES))
    return fit_pairs(x, found["quality"].to_numpy())


def score_quality(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """All rows and columns of ``docs`` plus score (0 to 1) and predicted (score >= 0.5).

    Only text is looked at; null and empty texts are scored as texts without words.
    Columns of ``docs`` with these names are replaced.
    """
    docs = docs.drop("score", "predicted")

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(ranker.score(features(pa.array(texts, type=pa.string(), from_pandas=True))))

    scored = docs.withColumn("score", of("text"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranker = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, ranker).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
