"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, prepare

WORDS = 1 << 15
BINS = 16
STATISTICS = (
    "upper", "lower", "digit", "space", "newline", "sentence", "symbol", "other",
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "repeats", "line_length", "distinct_lines",
    "stated_chars",
)
#: Labelled rows that a fit takes at most, about; they are chosen by hash.
SAMPLE = 6000
#: Features that come to the driver at most: about 200 MB.
MOST_CELLS = 16_000_000


def _classes() -> np.ndarray:
    table = np.full(256, 7, np.int64)
    for b in range(128):
        c = chr(b)
        table[b] = 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 5 if c in ".,;:'\"()?-" else 6
    return table


_CLASS = _classes()


class Features:
    """Turns texts into sparse rows: hashed words with their weights, and a dense row of statistics."""

    def __init__(self, most: int = 400_000):
        self.most, self.kept = most, {}

    def words(self, words: list[str]) -> np.ndarray:
        kept = self.kept
        got = list(map(kept.get, words))
        if None in got:
            if len(kept) > self.most:
                kept.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = h = zlib.crc32(words[i].lower().encode("utf-8", "surrogatepass")) % WORDS
                    if len(words[i]) <= 64:
                        kept[words[i]] = h
        return np.array(got, dtype=np.int64)

    def of(self, texts: list[str], stated: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, buckets and values of the word rows, and the statistics."""
        stats = np.zeros((len(texts), len(STATISTICS)))
        starts, buckets, values = [0], [], []
        for r, text in enumerate(texts):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            words, lines = text.split(), text.split("\n")
            n, m = max(1, len(data)), max(1, len(words))
            stats[r, :8] = np.bincount(_CLASS[data], minlength=8) / n
            stats[r, 8:10] = np.log1p(len(data)), np.log1p(len(words))
            stats[r, 10] = len(data) / m
            hashed = self.words(words)
            at, count = np.unique(hashed, return_counts=True)
            stats[r, 11] = len(at) / m
            stats[r, 12] = count.max() / m if len(count) else 0
            stats[r, 13] = np.count_nonzero(hashed[1:] == hashed[:-1]) / m
            stats[r, 14] = len(data) / len(lines)
            stats[r, 15] = len(set(lines)) / len(lines)
            stats[r, 16] = -1 if stated[r] is None else np.log1p(max(0, stated[r]))
            value = np.sqrt(count)
            buckets.append(at)
            values.append(value / np.sqrt((value**2).sum()) if len(at) else value)
            starts.append(starts[-1] + len(at))
        return np.array(starts), np.concatenate([*buckets, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0)]), stats


@dataclass
class FactorisationMachine:
    """bias + <w, x> + sum over pairs of <v_i, v_j> x_i x_j, the last in linear time as half of the square of the sum
    less the sum of squares. edges: the bounds of the statistics' bins; each bin is one more input."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray

    def rows(self, starts, buckets, values, stats):
        """CSR rows with a bin of each statistic behind the words."""
        n, s = stats.shape
        binned = np.stack([np.searchsorted(self.edges[j], stats[:, j], side="right") for j in range(s)], axis=1) if n else np.zeros((0, s), np.int64)
        binned = WORDS + np.arange(s) * BINS + binned
        at = np.concatenate([np.repeat(np.arange(n), np.diff(starts)), np.repeat(np.arange(n), s)])
        order = np.argsort(at, kind="stable")
        columns = np.concatenate([buckets, binned.ravel()])[order]
        x = np.concatenate([values, np.full(n * s, 0.5)])[order]
        return starts + np.arange(n + 1) * s, columns, x

    def margin(self, starts, columns, x) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros(0)
        vx = self.v[columns] * x[:, None]
        total = np.add.reduceat(vx, starts[:-1], axis=0)
        squares = np.add.reduceat((vx**2).sum(axis=1), starts[:-1])
        return self.bias + np.add.reduceat(self.w[columns] * x, starts[:-1]) + 0.5 * ((total**2).sum(axis=1) - squares)

    def score(self, features: Features, texts: list[str], stated: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.rows(*features.of(texts, stated))), -50, 50)))


def _columns(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", stated.alias("n_chars"))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = 8, steps: int = 1500, rate: float = 0.1, decay: float = 2e-5, seed: int = 7) -> FactorisationMachine:
    """Learns labels.quality (0 or 1) from the texts of docs by AdaGrad, in about `steps` steps of 128 rows.

    About `sample` labelled rows at most are taken, by hash of their doc_id; only their features come to the driver.
    Null labels are ignored; a doc_id with several labels has their rounded mean, and of a doc_id's rows the one with the
    smallest hash of its text counts. Of the chosen rows so many go to the driver, by hash of their doc_id, as have
    MOST_CELLS features together. Without both classes the model answers the share of ones (0.5 if there are no labels,
    as for an empty table). Long texts are read whole; empty and null ones have no words. Other columns are not read.
    """
    prepare(docs.sparkSession)
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    n = marks.count()
    chosen = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < min(1.0, sample / max(n, 1)) * 1_000_000)
    rows = _columns(docs).join(F.broadcast(chosen), "doc_id")
    one = F.min_by(F.struct("text", "n_chars", "quality"), F.struct(F.xxhash64("text"), "n_chars")).alias("r")
    rows = rows.groupBy("doc_id").agg(one).select("doc_id", "r.*")

    def run(batches):
        features = Features()
        for batch, texts in chunks(batches):
            starts, buckets, values, stats = features.of(texts, batch.column("n_chars").to_pylist())
            cells = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(buckets.astype(np.int32)))
            weights = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.astype(np.float32)))
            dense = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * stats.shape[1], pa.int32()), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), cells, weights, dense], names=["doc_id", "quality", "cells", "weights", "dense"])

    made = cut(rows.mapInArrow(run, "doc_id long, quality int, cells array<int>, weights array<float>, dense array<double>"))
    sizes = made.select("doc_id", F.xxhash64("doc_id").alias("h"), F.size("cells").alias("n")).toPandas().sort_values(["h", "doc_id"])
    few = sizes["doc_id"][sizes["n"].cumsum() <= MOST_CELLS].tolist()
    got = made.where(F.col("doc_id").isin(few)).toArrow().combine_chunks() if len(few) < len(sizes) else made.toArrow().combine_chunks()
    got = got.take(np.argsort(got.column("doc_id").to_numpy(), kind="stable")).combine_chunks()
    y = got.column("quality").to_numpy().astype(float)
    width = WORDS + len(STATISTICS) * BINS
    rng = np.random.default_rng(seed)
    edges = np.zeros((len(STATISTICS), BINS - 1))
    model = FactorisationMachine(0.0, np.zeros(width), np.zeros((width, rank)), edges)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
        model.bias = float(np.log(share / (1 - share)))
        return model
    lists = [got.column(c).combine_chunks() for c in ("cells", "weights", "dense")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    starts = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
    buckets, values = lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy().astype(float)
    stats = lists[2].flatten().to_numpy().reshape(len(y), -1)
    model.edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    starts, columns, x = model.rows(starts, buckets, values, stats)
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    model.v = rng.normal(0, 0.05, (width, rank))
    gw, gv, gb = np.full(width, 1e-2), np.full((width, rank), 1e-2), 1e-2
    batches = max(1, len(y) // 128)
    for _ in range(-(-steps // batches)):
        for rows_ in np.array_split(rng.permutation(len(y)), batches):
            lens = starts[rows_ + 1] - starts[rows_]
            own = np.concatenate(([0], np.cumsum(lens)))
            pick = np.arange(own[-1]) - np.repeat(own[:-1] - starts[rows_], lens)
            c, xv = columns[pick], x[pick]
            vx = model.v[c] * xv[:, None]
            total = np.add.reduceat(vx, own[:-1], axis=0)
            squares = np.add.reduceat((vx**2).sum(axis=1), own[:-1])
            m = model.bias + np.add.reduceat(model.w[c] * xv, own[:-1]) + 0.5 * ((total**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(m, -50, 50))) - y[rows_]) / len(rows_)
            e = np.repeat(error, lens) * xv
            at, back = np.unique(c, return_inverse=True)
            dw = np.bincount(back, e, len(at)) + decay * model.w[at]
            full = e[:, None] * (np.repeat(total, lens, axis=0) - vx)
            dv = np.stack([np.bincount(back, full[:, f], len(at)) for f in range(rank)], axis=1) + decay * model.v[at]
            gw[at] += dw**2
            gv[at] += dv**2
            model.w[at] -= rate * dw / np.sqrt(gw[at])
            model.v[at] -= rate * dv / np.sqrt(gv[at])
            gb += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(gb)
    return model


def score_quality(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, score for every row of docs: text and the stated n_chars are the only inputs, never doc_id, lang or source.

    Null texts score as empty ones; a null or missing n_chars has its own bin. The model is broadcast (its size is
    fixed: 33,040 inputs of nine numbers); whole texts are scored in batches without a shuffle.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        features = Features()
        for batch, texts in chunks(batches):
            score = held.value.score(features, texts, batch.column("n_chars").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return _columns(docs).mapInArrow(run, "doc_id long, score double")
