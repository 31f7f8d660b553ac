"""Benchmark decontamination with DataFrame functions alone: SimHash of item-sized windows, multi-index Hamming blocks,
then exact weighted-shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of 64 bits at most so far apart are compared; RADIUS + 1 blocks, of which one at least is then equal.
RADIUS = 19
#: Up to so many benchmark shingles are broadcast; beyond that Spark joins by shuffle.
MOST_BROADCAST = 2_000_000
#: Documents with windows to fingerprint are broadcast up to so many, by id and place.
MOST_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have none."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def shingles(column: str, width: int) -> Column:
    """Hashes of each `width` words running."""
    inside = ", ".join(f"element_at({column}, i + {k})" for k in range(width))
    return F.expr(f"if(size({column}) < {width}, cast(array() as array<bigint>), transform(sequence(1, greatest(size({column}) - {width - 1}, 1)), i -> xxhash64({inside})))")


def simhash(column: str) -> Column:
    """Bit b is set where more than half of the shingles, counted as often as they occur, have it set."""
    ones = f"aggregate({column}, 0, (s, x) -> s + cast(shiftrightunsigned(x, b) & 1L as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size({column}), shiftleft(1L, b), 0L))")


def hamming_blocks(column: str, radius: int = RADIUS) -> Column:
    """The fingerprint in radius + 1 blocks of bits, as structs (block, bits)."""
    short, more = divmod(64, radius + 1)
    out, at = [], 0
    for k in range(radius + 1):
        size = short + (k < more)
        out.append(f"struct({k} as block, cast(shiftrightunsigned({column}, {at}) & {(1 << size) - 1}L as int) as bits)")
        at += size
    return F.expr(f"array({', '.join(out)})")


def occurrences(column: str) -> str:
    """Each shingle with its number among equal ones, so that sets of these compare as weighted (counted) shingles."""
    ordered = f"array_sort({column})"
    return f"transform({ordered}, (x, i) -> struct(x as s, cast(i + 2 - array_position({ordered}, x) as int) as n))"


def common(a: str, b: str) -> str:
    """Weight that two arrays of shingles have in common; where neither repeats one, that of plain sets."""
    plain = f"size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b})"
    return f"if({plain}, size(array_intersect({a}, {b})), size(array_intersect({occurrences(a)}, {occurrences(b)})))"


def _windows(hits: DataFrame, width: int, similarity: float) -> DataFrame:
    """The window of each document that has most in common with an item: doc_id, check, item_id, n, start.

    hits: where shingles of an item stand in a document, in any order. A window within the similarity holds at least
    `least` of them, and one that starts at its first hit instead has no fewer; so windows are tried at hits alone. What
    a window has in common with the item follows from the hits in it.
    """
    own = F.greatest(F.least("n", "length") - (width - 1), F.lit(1))  # shingles of a window
    rows = hits.groupBy("doc_id", "check", "item_id", "n", "length").agg(F.array_sort(F.collect_set(F.struct("pos", "run"))).alias("hits"))
    least = F.ceil(F.lit(similarity) * (F.col("own") + F.col("n") - (width - 1)) / (1 + similarity) - 1e-9).cast("int")
    rows = rows.withColumn("own", own).withColumn("least", least).where("size(hits) >= least")
    starts = "filter(sequence(0, size(hits) - least), i -> hits[i + least - 1].pos - hits[i].pos < own)"
    rows = rows.withColumn("starts", F.expr(f"array_distinct(transform({starts}, i -> greatest(least(hits[i].pos, length - n), 0)))"))
    return rows.where("size(starts) > 0")


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words: documents with a window like a benchmark item, the best one of each.

    A window has as many words as the item (the whole text, if that is shorter), and starts anywhere. Similarity is the
    weighted Jaccard index of runs of `shingle` words, each weighing as often as it occurs, in whatever order; items with
    fewer words are one run. Only windows that hold enough of the item's runs to reach the similarity are fingerprinted,
    of each document and item the one that holds most (of several the first): no pair that reaches it is left out. Its
    SimHash meets those of items of that size by equal blocks of bits, which finds all within `radius`; the similarity of
    these is computed exactly. Where SimHash puts a pair that reaches the similarity farther apart than `radius`, it is
    lost: at 0.8 about one in a thousand.

    Null or wordless texts and items match nothing; null ids are dropped; rows of one id are looked at one by one and give
    one row an item; long texts are looked at whole. Of windows equally like the item the first counts. An empty table
    gives no rows. Other columns, whatever their names, are not read. The benchmark is broadcast only if its runs number
    at most MOST_BROADCAST.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0 and item_id is not null").distinct()
    items = items.withColumns({"n": F.size("w"), "width": F.least(F.size("w"), F.lit(shingle))})
    items = cut(items)
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # `shingle` at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("check"), "text").where("doc_id is not null")
    found = None
    for width in sorted(widths):
        own = cut(items.where(F.col("width") == width).select("item_id", "n", shingles("w", width).alias("item_runs")))
        runs = cut(own.select("item_id", "n", F.explode("item_runs").alias("run")).distinct())
        runs = F.broadcast(runs) if runs.count() <= MOST_BROADCAST else runs
        # posexplode_outer: for an inner one Spark infers a filter that makes the words again for each of them
        rows = texts.withColumn("w", words(F.col("text"))).select("doc_id", "check", F.size("w").alias("length"), shingles("w", width).alias("runs"))
        hits = rows.select("doc_id", "check", "length", F.posexplode_outer("runs").alias("pos", "run")).join(runs, "run")
        windows = _windows(hits, width, similarity).join(own, ["item_id", "n"])
        within = "transform(filter(hits, h -> h.pos >= p and h.pos < p + own), h -> h.run)"
        best = F.expr(f"array_max(transform(starts, p -> struct({common(within, 'item_runs')} as common, -p as start)))")
        windows = windows.withColumn("best", best).where("best.common >= least").select("doc_id", "check", (-F.col("best.start")).alias("start"), "n").distinct()
        windows = cut(windows.groupBy("doc_id", "check").agg(F.collect_list(F.struct("start", "n")).alias("windows")).withColumnsRenamed({"doc_id": "_id", "check": "_check"}))
        few = F.broadcast(windows) if windows.count() <= MOST_WINDOWS else windows
        # `check` stays out of the join's keys, as documents are dealt by id; rows of one id and text give the same windows
        pieces = texts.join(few, (F.col("doc_id") == F.col("_id")) & (F.col("check").bitwiseXOR(F.col("_check")) == 0))
        pieces = pieces.withColumn("w", words(F.col("text"))).select("doc_id", "w", F.explode_outer("windows").alias("x"))
        pieces = pieces.select("doc_id", "x.start", "x.n", F.expr("slice(w, x.start + 1, x.n)").alias("v"))
        prints = cut(pieces.select("doc_id", "start", "n", shingles("v", width).alias("runs")))
        prints = cut(prints.withColumn("print", simhash("runs")))
        prints = prints.select("doc_id", "start", "n", "runs", "print", F.explode(hamming_blocks("print", radius)).alias("k")).select("*", "k.block", "k.bits").drop("k")
        known = cut(own.withColumn("item_print", simhash("item_runs"))).select("item_id", "n", "item_runs", "item_print", F.explode(hamming_blocks("item_print", radius)).alias("k")).select("*", "k.block", "k.bits").drop("k")
        meet = prints.join(known, ["n", "block", "bits"])
        # of the equal blocks of a pair the first counts, so each pair is looked at once
        first = F.expr(f"array_position(zip_with({_bits('print', radius)}, {_bits('item_print', radius)}, (a, b) -> a = b), true) - 1")
        near = meet.where((F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius) & (F.col("block") == first))
        scored = near.withColumn("common", F.expr(common("runs", "item_runs")))
        scored = scored.withColumn("similarity", F.col("common") / (F.size("runs") + F.size("item_runs") - F.col("common"))).where(F.col("similarity") >= similarity)
        scored = scored.select("doc_id", "item_id", "similarity", "start", F.col("n").alias("n_words"))
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start int, n_words int")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n_words")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.similarity", (-F.col("m.start")).alias("start"), "m.n_words")


def _bits(column: str, radius: int) -> str:
    short, more = divmod(64, radius + 1)
    out, at = [], 0
    for k in range(radius + 1):
        size = short + (k < more)
        out.append(f"shiftrightunsigned({column}, {at}) & {(1 << size) - 1}L")
        at += size
    return f"array({', '.join(out)})"


def drop_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows that contaminated() found, of any columns; rows with a null doc_id stay."""
    return docs.join(found.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").cast("long") == F.col("_id"), "left_anti").select(*docs.columns)
