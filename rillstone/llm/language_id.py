"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import chunks, lighten, prepare

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: More distinct labels than this are refused, which bounds the broadcast matrix to 512 MB.
MOST_LANGUAGES = 1024
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case letter or mark, else a space; and whether it is a letter."""
    low = np.arange(0x110000, dtype=np.uint32)
    is_letter = np.zeros(0x110000, dtype=bool)
    low[0x40000:] = 32
    for c in range(0x40000):  # no code point beyond is a letter
        ch = chr(c)
        if ch.isalpha():
            is_letter[c] = True
            lower = ch.lower()
            low[c] = ord(lower) if len(lower) == 1 else c
        elif not unicodedata.category(ch).startswith("M"):
            low[c] = 32
    return low, is_letter


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the rows of the sparse text-by-bucket matrix: the buckets, the texts' starts in them, and which
    texts have letters. Each text stands by itself, with one space before it; BUCKETS marks a place without a gram."""
    low, is_letter = letters()
    codes = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    lettered = np.add.reduceat(is_letter[codes], starts[:-1]) > 0
    s = low[codes]
    blank = s == 32
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[starts[:-1]] = True
    s = s[keep]
    starts = np.concatenate(([0], np.cumsum(keep)))[starts]
    hashed = np.zeros(len(s), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(s) - n + 1
        if m > 0:
            hashed[:m] = (hashed[:m] ^ s[n - 1 :]) * np.uint32(0x9E3779B1)
            hashed[:m] ^= hashed[:m] >> np.uint32(15)
        if n in ORDERS:
            found = ((hashed + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int64)
            for back in range(1, n):
                found[np.maximum(starts[1:] - back, starts[:-1])] = BUCKETS
            yield found, starts[:-1], lettered


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, languages), the last row zero

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = np.tile(self.prior, (len(texts), 1))
        for found, starts, lettered in grams(texts):
            total += np.add.reduceat(self.weights[found], starts, axis=0)
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        score = np.where(lettered, 1 / odds.sum(axis=1), 0.0)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)], score


def fit_languages(docs: DataFrame, per_language: int = 3000, smoothing: float = 0.05) -> LanguageModel:
    """Learns from the rows of (text, lang) whose lang and text aren't null.

    Priors count all rows. The n-gram table is counted on the executors over a bounded sample: about `per_language`
    texts of each language, taken by the texts' hash. Only language-by-bucket sums come to the driver.
    """
    prepare(docs.sparkSession)
    rows = docs.select("text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct languages")
    names = sorted(counts)
    if not names:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS + 1, 0)))
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, per_language / counts[n]))])
    part = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000
    place = {n: i for i, n in enumerate(names)}

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch, texts in chunks(batches):
            by: dict[int, list[str]] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), texts, strict=True):
                by.setdefault(place[lang], []).append(t)
            for k, own in by.items():
                for found, _, _ in grams(own):
                    sums[k] = sums.get(k, 0) + np.bincount(found, minlength=BUCKETS + 1)[:BUCKETS]
        for k, s in sums.items():
            at = s.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at].astype(np.int64))], names=["k", "bucket", "n"])

    found = rows.where(part).mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(names)), smoothing)
    table[found["bucket"].to_numpy(), found["k"].to_numpy()] += found["n"].to_numpy()
    weights = np.zeros((BUCKETS + 1, len(names)))
    weights[:BUCKETS] = np.log(table / table.sum(axis=0))
    prior = np.array([counts[n] for n in names], dtype=float)
    return LanguageModel(names, np.log(prior / prior.sum()), weights)


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs (with a column text) and two columns more, lang_pred and lang_score; columns of those names are replaced.

    lang_pred is one of the model's languages, or `und` with score 0 where the text is null, empty or has no letter,
    or nothing was learned; ties go to the first language by name. The score is the posterior probability. The
    log-probability matrix is broadcast once; whole texts are scored in batches, without a shuffle.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])

    def run(batches):
        lighten(__name__)
        for batch, texts in chunks(batches):
            names, score = held.value.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)
