"""Near-duplicate documents by order MinHash and banded alignment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import banded_distance, chunks, components, cut, forget, in_blocks, mix, pairs_in_groups, prepare, release, table, word_hashes

#: Words of a run: SHINGLE in texts of at least LONG words, one in texts of LEAST to SHORT words. With 0.8 x SHORT =
#: LONG two texts that are alike enough always have sketches of one kind; below LEAST words only equal texts are alike.
SHINGLE = 2
LEAST, LONG, SHORT = 4, 40, 50
SIMILARITY = 0.8
SKETCHES = 20
BLOCK = 400
#: Turns in which the documents of a bucket are aligned with its smallest one that they aren't known to differ from.
STARS = 4
#: Ids of documents whose texts are needed are broadcast up to so many; beyond that texts are dealt by id.
MOST_BROADCAST = 1_000_000
#: Bins of the word-count signature whose difference bounds the edit distance from below.
BINS = 512
#: Words whose hashes a task keeps while it aligns a block.
WORDS_HELD = 4_000_000

_U = np.uint64


def labelled(kmers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The k-mers' hashes mixed with their occurrence, the number of equal ones before them in the same row."""
    key = mix(kmers ^ mix(rows.astype(_U) + _U(1)))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    out = mix(kmers)
    if len(twice):
        # few k-mers occur twice: only those whose low bits are those of one that does are sorted with their places
        seen = np.zeros(1 << 16, bool)
        seen[(twice & _U(0xFFFF)).astype(np.int64)] = True
        at = np.nonzero(seen[(key & _U(0xFFFF)).astype(np.int64)])[0]
        at = at[np.argsort(key[at], kind="stable")]
        new = np.ones(len(at), bool)
        new[1:] = key[at[1:]] != key[at[:-1]]
        number = np.arange(len(at))
        occurrence = number - np.maximum.accumulate(np.where(new, number, 0))
        out[at] = mix(kmers[at] + occurrence.astype(_U) * _U(0xD1B54A32D192ED03))
    return out


def order_minhash(words: np.ndarray, starts: np.ndarray, use: np.ndarray, shingle: int = SHINGLE, sketches: int = SKETCHES) -> np.ndarray:
    """Each document's sketches: of its k-mers of words, labelled with their occurrence, the two with the smallest
    hashes under each of `sketches` orders, joined in the order in which the text has them.

    words: the documents' word hashes one after another; starts: where each begins, and the end. A document that isn't
    in `use` or has fewer than `shingle` words has zeros for sketches; one k-mer gives sketches of that alone.
    """
    n = len(starts) - 1
    found = np.zeros((n, sketches), _U)
    own = np.where(use, np.maximum(np.diff(starts) - shingle + 1, 0), 0)
    full = np.nonzero(own)[0]
    if not len(full):
        return found
    g = np.zeros(len(words) - shingle + 1, _U)
    for k in range(shingle):
        g = mix((g ^ words[k : len(words) - shingle + 1 + k]) * _U(0x9E3779B97F4A7C15))
    rows = np.repeat(np.arange(n), own)
    ends = np.concatenate(([0], np.cumsum(own)))
    place = np.arange(ends[-1]) - ends[rows]
    x = labelled(g[place + starts[rows]], rows)
    # a hash's low bits make way for its place, so that the minimum tells where it stands
    low = _U((1 << int(own.max()).bit_length()) - 1)
    place, at, one = place.astype(_U), ends[:-1][full], own[full] == 1
    y = np.empty_like(x)
    for s in range(sketches):
        odd = mix(np.array([s + 1], _U))[0] | _U(1)
        np.multiply(x, odd, out=y)
        y &= ~low
        y |= place
        pair = []
        for _ in range(2):
            spot = (np.minimum.reduceat(y, at) & low).astype(np.int64) + at
            y[spot] = _U(0xFFFFFFFFFFFFFFFF)
            pair.append(spot)
        a, b = np.minimum(*pair), np.where(one, pair[0], np.maximum(*pair))
        a = np.where(one, pair[0], a)
        found[full, s] = mix(mix(x[a] * odd) ^ x[b]) ^ _U(s)
    return found


def sketches_of(words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Each document's sketches of one-word runs, then those of SHINGLE words; zeros where it has none of a kind, and
    none at all below LEAST words."""
    sizes = np.diff(starts)
    both = np.concatenate((order_minhash(words, starts, (sizes >= LEAST) & (sizes <= SHORT), 1), order_minhash(words, starts, sizes >= LONG)), axis=1)
    return [row if size >= LEAST else row[:0] for row, size in zip(both, sizes.tolist(), strict=True)]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, check (64 bits of the text), n_words, h1, h2 (128 bits of the word sequence), sketches, signature (BINS
    counts) of each document."""

    def run(batches):
        for batch, texts in chunks(batches, 1_000_000):
            words, starts = word_hashes(texts)
            found = sketches_of(words, starts)
            place = np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))
            h = [mix(words + mix(place.astype(_U) + _U(c))) for c in (1, 1 << 40)]
            sums = np.concatenate((np.zeros((2, 1), _U), np.cumsum(np.stack(h), axis=1, dtype=_U)), axis=1)
            h1, h2 = (sums[:, starts[1:]] - sums[:, starts[:-1]]).astype(np.int64)
            bins = np.repeat(np.arange(len(texts)), np.diff(starts)) * BINS + (words % _U(BINS)).astype(np.int64)
            counts = np.minimum(np.bincount(bins, minlength=len(texts) * BINS), 255).astype(np.uint8).reshape(len(texts), BINS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("check"), pa.array(np.diff(starts)), pa.array(h1), pa.array(h2), pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64())), pa.array([c.tobytes() for c in counts], pa.binary())],
                names=["doc_id", "check", "n_words", "h1", "h2", "sketches", "signature"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, check long, n_words long, h1 long, h2 long, sketches array<long>, signature binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("check"), "text")


def _allowed(longer: int, similarity: float) -> int:
    """The most edits between two documents of which the longer has so many words."""
    return math.floor((1 - similarity) * longer + 1e-9)


def _bound(counts: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The fewest edits between documents i and j by their signatures and numbers of words: a word put in or left out
    changes one count, a word in another's place two."""
    apart = [np.abs(counts[i[part]] - counts[j[part]]).sum(axis=1) for part in np.array_split(np.arange(len(i)), len(i) // 4096 + 1)]
    return (np.concatenate(apart) + np.abs(words[i] - words[j]) + 1) // 2


def _counts(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, BINS).astype(np.int16)


def bound_pairs(pairs: DataFrame, signed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, edits, possible: the fewest edits that signatures and numbers of words allow, and whether these are few
    enough. signed: doc_id, n_words, signature, a row per id."""
    side = lambda c: signed.select(F.col("doc_id").alias(c), F.col("n_words").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            counts = _counts([*batch.column("sa").to_pylist(), *batch.column("sb").to_pylist()])
            words = np.concatenate((batch.column("na").to_numpy(), batch.column("nb").to_numpy()))
            i = np.arange(len(batch))
            j = i + len(batch)
            edits = _bound(counts, words, i, j)
            most = np.floor((1 - similarity) * np.maximum(words[i], words[j]) + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(edits, pa.int64()), pa.array(edits <= most)], names=["a", "b", "edits", "possible"])

    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, edits long, possible boolean")


def distance(u: np.ndarray, v: np.ndarray, most: int) -> int:
    """banded_distance of two arrays, without what they have in common at both ends."""
    n = min(len(u), len(v))
    apart = np.flatnonzero(u[:n] != v[:n])
    begin = int(apart[0]) if len(apart) else n
    apart = np.flatnonzero(u[len(u) - (n - begin) :] != v[len(v) - (n - begin) :])
    end = n - begin - 1 - int(apart[-1]) if len(apart) else n - begin
    return banded_distance(u[begin : len(u) - end].tolist(), v[begin : len(v) - end].tolist(), most)


def align_pairs(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, reach: int = 1) -> DataFrame:
    """a, b, edits, alike: alike if the texts' word sequences are at least `similarity` alike, 1 - edits / words of the
    longer. edits is exact for these, otherwise a lower bound: bands are `reach` times as wide as the allowed edits.

    texts: doc_id and text, a row per id. Both joins are by document, so AQE can split one that stands in many pairs.
    """
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    prepare(texts.sparkSession)

    def run(batches):
        kept = {}

        def of(i, text):
            if i not in kept:
                if len(kept) > 64:
                    kept.clear()
                words = word_hashes([text or ""])[0]
                kept[i] = words, np.bincount((words % _U(4096)).astype(np.int64), minlength=4096)
            return kept[i]

        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            edits, alike = [], []
            for x, y, tx, ty in zip(a, b, ta, tb, strict=True):
                (u, n), (v, m) = of(x, tx), of(y, ty)
                most = _allowed(max(len(u), len(v)), similarity)
                least = int(np.abs(n - m).sum() + abs(len(u) - len(v)) + 1) // 2
                edits.append(least if least > reach * most else distance(u, v, reach * most))
                alike.append(edits[-1] <= most)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(edits, pa.int64()), pa.array(alike, pa.bool_())], names=["a", "b", "edits", "alike"])

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, edits long, alike boolean")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_words for every row of docs: class_id is the smallest doc_id reachable by verified links.

    Words are compared without case and outer punctuation. Documents of equal word sequences are one class from the
    start. Others are candidates if they share a sketch. In a few turns each is compared with the smallest doc_id of a
    bucket (that of most of its buckets) by word counts, and those that can't be alike go on to the next smallest; what
    may be alike is aligned. Then, in each bucket of a sketch that still holds several classes, all pairs across classes
    meet in blocks, and those are aligned there, once in one bucket of those they share, that neither word counts nor the
    triangle inequality (over the edits to a document that both were aligned with before) can rule out; only rows with
    such a pair are sent there with their texts. Only links leave a block, at most one a row. So a link is lost only where no sketch is shared
    (tests hold the share kept at 0.8 to 0.9 against brute force); no bucket is capped.

    Null, empty and wordless documents are their own class, and so are documents of fewer than four words but for equal
    ones; long documents are compared whole. Rows with a null doc_id get a null class, and no other row is compared with
    them. Rows of a repeated doc_id get one class: of several texts that whose word sequence has the smallest hash
    counts. Of sketches equally often shared the smaller document counts. An empty table gives no rows, and other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = cut(describe(docs))
    row = F.struct("h1", "h2", "n_words", "check")
    twice = known.where("doc_id is not null").groupBy("doc_id").agg(F.min(row).alias("first"), F.max(row).alias("last")).where("first <> last")
    twice = cut(twice.select("doc_id", "first"))
    known = known.join(twice, "doc_id", "left").withColumn("_counts", F.col("first").isNull() | (F.col("first") == row))
    known = known.withColumns({c: F.coalesce(f"first.{c}", c) for c in ("h1", "h2", "n_words")})
    classes = known.where("n_words > 0 and doc_id is not null and _counts").groupBy("h1", "h2", "n_words").agg(F.min(F.struct("doc_id", "check", "sketches", "signature")).alias("r"))
    classes, classes_at = table(classes.select("h1", "h2", "n_words", "r.*"))
    known = known.select("doc_id", "n_words", "h1", "h2")
    postings = classes.select("doc_id", F.explode(F.array_distinct("sketches")).alias("sketch")).where("sketch <> 0")
    shared = postings.groupBy("sketch").agg(F.count("*").alias("n")).where("n > 1").select("sketch")
    postings, postings_at = table(postings.join(shared, "sketch"))
    signed, signed_at = table(classes.join(postings.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "check", "n_words", "signature", "sketches"))
    paths = [classes_at, postings_at, signed_at]
    release(spark)

    def texts_of(ids: DataFrame) -> DataFrame:
        """doc_id and text, a row per id, of so few documents as have a pair that must be aligned."""
        ours, at = table(signed.join(ids.distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("check").alias("_check")))
        few = F.broadcast(ours) if ours.count() <= MOST_BROADCAST else ours
        # the difference keeps `check` out of the keys of the join, so rows stay dealt by doc_id
        found = _texts(docs).join(few, (F.col("doc_id") == F.col("_id")) & (F.col("check").bitwiseXOR(F.col("_check")) == 0), "left_semi")
        found, path = table(found.select("doc_id", "text").dropDuplicates(["doc_id"]))
        paths.extend([at, path])
        release(spark)
        return found

    rest, tested = postings, None
    for turn in range(STARS):
        low = rest.groupBy("sketch").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").select("sketch", "b")
        starred, at = table(rest.join(low, "sketch").where("doc_id > b"))
        edges = starred.groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("n"))
        edges = edges.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
        made, made_at = table(bound_pairs(edges, signed, similarity))
        paths += [at, made_at]
        tested = made if tested is None else tested.unionByName(made)
        if turn == STARS - 1 or not made.take(1):
            break
        parents = _parents(tested.where("possible").select("a", "b"))
        left = starred.join(parents.select(F.col("a").alias("doc_id"), F.col("b").alias("x")), "doc_id", "left").join(parents.select(F.col("a").alias("b"), F.col("b").alias("y")), "b", "left")
        rest, at = table(left.where(F.coalesce("x", "doc_id") != F.coalesce("y", "b")).select("doc_id", "sketch"))
        paths.append(at)
    possible = tested.where("possible").select("a", "b")
    aligned = align_pairs(possible, texts_of(possible.select(F.explode(F.array("a", "b")).alias("doc_id"))), similarity, reach=3)
    tested, at = table(aligned.unionByName(tested.where("not possible").select("a", "b", "edits", F.lit(False).alias("alike"))))
    paths.append(at)
    best = F.max(F.struct("alike", (-F.col("edits")).alias("less"), "b")).alias("m")
    known_edits = tested.groupBy(F.col("a").alias("doc_id")).agg(best).select("doc_id", F.col("m.b").alias("other"), (-F.col("m.less")).alias("edits"), "m.alike")
    label = signed.drop("check").join(known_edits, "doc_id", "left")
    label = label.withColumns({"other": F.coalesce("other", "doc_id"), "edits": F.coalesce("edits", F.lit(0)), "alike": F.coalesce("alike", F.lit(True))})
    label, at = table(_with_component(label, tested.where("alike").select("a", "b")))
    paths.append(at)
    mixed = postings.join(label.select("doc_id", "component"), "doc_id").groupBy("sketch").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("sketch")
    hot, at = table(postings.join(mixed, "sketch"))
    paths.append(at)
    dealt = in_blocks(hot, ["sketch"], "doc_id", block).join(label, "doc_id").withColumns({"id": F.col("doc_id"), "bucket": F.col("sketch")})
    columns = ["doc_id", "bucket", "component", "n_words", "signature", "sketches", "other", "edits", "alike"]

    def candidates(held, i, j):
        ok = _possible(held, i, j, similarity)
        return ok[_turn(held, i[ok], j[ok])]

    # only rows with a pair that must be aligned go on, with their texts
    marked, at = table(pairs_in_groups(dealt, ["sketch"], columns, candidates, rows=True))
    paths.append(at)
    dealt = marked.withColumn("doc_id", F.col("id")).join(label, "doc_id").join(texts_of(marked.select(F.col("id").alias("doc_id"))), "doc_id").withColumn("bucket", F.col("sketch"))
    across, at = table(pairs_in_groups(dealt, ["sketch"], [*columns, "text"], lambda held, i, j: _alike(held, i, j, similarity)))
    paths.append(at)
    of = label.select("doc_id", "component")
    # the stars' components are the nodes of what is left
    ends = across.join(of.withColumnsRenamed({"doc_id": "a", "component": "x"}), "a").join(of.withColumnsRenamed({"doc_id": "b", "component": "y"}), "b")
    joined = components(ends.select("x", "y"), "x", "y").select(F.col("id").alias("component"), F.col("component").alias("whole"))
    of = of.join(joined, "component", "left").select(F.col("doc_id").alias("rep"), F.coalesce("whole", "component").alias("component"))
    whole = classes.select("h1", "h2", "n_words", F.col("doc_id").alias("rep")).join(of, "rep", "left")
    whole = cut(whole.select("h1", "h2", "n_words", F.coalesce("component", "rep").alias("component")))
    for path in paths:
        forget(spark, path)
    release(spark)
    out = known.join(whole, ["h1", "h2", "n_words"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("class_id"), "n_words")


def _parents(links: DataFrame) -> DataFrame:
    """a, b: the smallest doc_id that a links to, or the smallest that this one links to. Never wrong about documents
    being of one class, but longer chains aren't followed."""
    low = links.groupBy("a").agg(F.min("b").alias("b"))
    return low.join(low.select(F.col("a").alias("b"), F.col("b").alias("top")), "b", "left").select("a", F.coalesce("top", "b").alias("b"))


def _with_component(label: DataFrame, links: DataFrame) -> DataFrame:
    """label with a column component: the smallest doc_id that links reach, its own without links."""
    groups = components(links).withColumnRenamed("id", "doc_id")
    return label.join(groups, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _turn(held, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether this is the bucket to compare a pair in: of those that both stand in, one chosen by hash of the pair, so
    that buckets of the same documents share the work."""
    if "all" not in held:
        held["all"], held["id"] = held["sketches"].astype(_U), held["doc_id"].astype(_U)
        held["at"] = held["bucket"].astype(_U)
    s, t = held["all"][i], held["all"][j]
    rank = np.where((s == t) & (s != 0), mix(s ^ mix(held["id"][i] + held["id"][j])[:, None]), _U(0xFFFFFFFFFFFFFFFF))
    return s[np.arange(len(s)), rank.argmin(axis=1)] == held["at"][i]


def _alike(held, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs that are alike by banded alignment, without those that links found before connect. Word hashes of at most
    WORDS_HELD words, or one document's, are kept."""
    ok = _possible(held, i, j, similarity)
    ok = ok[_turn(held, i[ok], j[ok])]
    if "root" not in held:
        held |= {"root": np.unique(held["component"], return_inverse=True)[1], "words": {}, "size": 0}
    root, words, found = held["root"], held["words"], []

    def of(r):
        if r not in words:
            if held["size"] > WORDS_HELD:
                words.clear()
                held["size"] = 0
            w = word_hashes([held["text"][r] or ""])[0]
            words[r] = w, np.bincount((w % _U(4096)).astype(np.int64), minlength=4096).astype(np.int32)
            held["size"] += len(w) + 2048
        return words[r]

    for k in ok.tolist():
        x, y = i[k], j[k]
        if root[x] == root[y]:
            continue
        (u, count), (v, other) = of(x), of(y)
        most = _allowed(max(len(u), len(v)), similarity)
        if (np.abs(count - other).sum() + abs(len(u) - len(v)) + 1) // 2 <= most and distance(u, v, most) <= most:
            found.append(k)
            root[root == root[y]] = root[x]
    return np.array(found, np.int64)


def _possible(held, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs across classes that may have the allowed edits: half the difference of word counts is a lower bound, and so
    is the difference of their edits to one third document, if those of the nearer one are exact."""
    words = held["n_words"]
    most = np.floor((1 - similarity) * np.maximum(words[i], words[j]) + 1e-9)
    ok = np.nonzero((held["component"][i] != held["component"][j]) & (np.abs(words[i] - words[j]) <= most))[0]
    a, b = i[ok], j[ok]
    more = held["edits"][a] - held["edits"][b]
    far = (held["other"][a] == held["other"][b]) & (held["alike"][b] & (more > most[ok]) | held["alike"][a] & (-more > most[ok]))
    ok = ok[~far]
    if "counts" not in held:
        held["counts"] = _counts(held["signature"])
    return ok[_bound(held["counts"], words, i[ok], j[ok]) <= most[ok]]
