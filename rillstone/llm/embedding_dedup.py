"""Near-duplicate vectors by a pivot-permutation index: inverted lists of nearest reference points, then exact cosine."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, forest, in_blocks, prepare

#: Reference points grow with the square root of the vectors, up to a number that bounds the broadcast.
MOST_PIVOTS = 4096
#: They are chosen among so many sampled vectors for each, up to MOST_SAMPLED.
SAMPLED = 4
MOST_SAMPLED = 8192
NEAREST = 10
MIN_SHARED = 2
BLOCK = 1500


def unit_rows(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of length 1 in double precision, padded with zeros to `width`."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if len(out):
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out


def spread(units: np.ndarray, count: int, least: int, radius: float) -> np.ndarray:
    """Places of at most `count` rows, farthest first: each next one is the least like those before by cosine. It ends
    where all others are within `radius` of one, but not before `least`. So a dense group has few, however large it is.
    """
    chosen = [0] if len(units) else []
    near = units @ units[0] if chosen else np.zeros(0)
    while len(chosen) < min(count, len(units)):
        near[chosen[-1]] = np.inf
        at = int(near.argmin())
        if near[at] >= radius and len(chosen) >= least:
            break
        chosen.append(at)
        near = np.maximum(near, units @ units[at])
    return np.array(chosen, np.int64)


def permutations(units: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Each row's nearest reference points by cosine, in order; ties go to the smaller number."""
    near = units @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :nearest].astype(np.int32)


def _valid() -> F.Column:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def link_embeddings(vectors: DataFrame, threshold: float = 0.95, nearest: int = NEAREST, min_shared: int = MIN_SHARED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, ...).

    Equal vectors form one class, counted but not paired. Each class is described by its `nearest` closest reference
    points in order and stands in the inverted list of each. Pairs that meet in a list and share `min_shared` points
    are verified by cosine in double precision, in the list of the smallest point they share, so each pair counts once.
    Long lists are dealt out in pairs of blocks: no pair of a list is dropped. A task returns link counts and a
    spanning forest of its links, not the links. The index is approximate by its retrieval only; recall is measured
    in the tests. Reference points are spread out, farthest first, over a sample by hash of the vectors; at most 4096.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Rows with a null vec_id have no links and are not kept. Repeated rows are vectors of their own.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = rows.where(_valid() & F.col("vec_id").isNotNull())
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = cut(classes)
    n, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    alone = lambda d: d.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not n:
        return alone(rows)
    count = max(16, min(MOST_PIVOTS, math.ceil(2 * math.sqrt(n))))
    sample = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(min(SAMPLED * count, MOST_SAMPLED)).toPandas()["embedding"].tolist()
    sampled = unit_rows(sample, width)
    # any two rows share min_shared of so many points
    least = 2 * nearest - min_shared
    pivots = spark.sparkContext.broadcast(sampled[spread(sampled, max(count, least), least, threshold)])

    def describe(batches):
        for batch in batches:
            units = unit_rows(batch.column("embedding").to_pylist(), width)
            near = permutations(units, pivots.value, nearest)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "points"])

    kind = dict(classes.dtypes)["embedding"]
    described = cut(classes.mapInArrow(describe, f"embedding {kind}, rep long, weight long, points array<int>"))
    listed = described.withColumns({"length": F.size("embedding"), "point": F.explode("points")})
    dealt = in_blocks(listed, ["length", "point"], "rep", block)

    def verify(key, part: pd.DataFrame) -> pd.DataFrame:
        point, lo, hi = key[1:]
        part = part.sort_values("rep")
        units = unit_rows(part["embedding"].tolist(), len(part["embedding"].iloc[0]))
        points = np.sort(np.stack(part["points"].to_numpy()), axis=1)
        own, weight, rep = part["own"].to_numpy(), part["weight"].to_numpy(), part["rep"].to_numpy()
        links = np.zeros(len(part), np.int64)
        found_a, found_b = [], []
        for at in range(0, len(part), 256):
            close = units[at : at + 256] @ units.T >= threshold
            i, j = np.nonzero(close)
            i += at
            use = (i < j) & ((own[i] != own[j]) if lo != hi else True)
            i, j = i[use], j[use]
            for s in range(0, len(i), 100_000):
                a, b = i[s : s + 100_000], j[s : s + 100_000]
                same = (points[a][:, :, None] == points[b][:, None, :]).any(axis=2)
                first = points[a, same.argmax(axis=1)]
                use = (same.sum(axis=1) >= min_shared) & (first == point)
                a, b = a[use], b[use]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                tree = forest(len(part), a, b)
                found_a.append(tree[:, 0])
                found_b.append(tree[:, 1])
        has = links.nonzero()[0]
        counts = pd.DataFrame({"a": rep[has], "b": rep[has], "n": links[has]})
        if found_a:
            tree = forest(len(part), np.concatenate(found_a), np.concatenate(found_b))
            counts = pd.concat([counts, pd.DataFrame({"a": rep[tree[:, 0]], "b": rep[tree[:, 1]], "n": 0})])
        return counts

    found = cut(dealt.groupBy("length", "point", "lo", "hi").applyInPandas(verify, "a long, b long, n long"))
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("found"))
    groups = components(found.where("a <> b").select("a", "b")).withColumnRenamed("id", "rep")
    whole = classes.select(F.col("embedding").alias("_e"), "rep", "weight").join(links, "rep", "left").join(groups, "rep", "left")
    linked = good.join(whole, F.col("embedding") == F.col("_e"))
    out = linked.select(
        "vec_id", (F.col("weight") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return out.unionByName(alone(rows.where(~(_valid() & F.col("vec_id").isNotNull()) | F.col("embedding").isNull())))
