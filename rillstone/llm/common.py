"""What the operators of this subpackage share: shared-folder tables, graph components, batching and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import sys
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of rows looked at at once.
AT_ONCE = 300_000
#: Rows of an Arrow batch sent to Python; texts may be long, so batches are short.
ARROW_ROWS = "500"


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on, and this package's source for executors that don't have it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    paths = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()] if p}
    if str(package.parent) in paths or getattr(sc, "_rillstone_shipped", False):
        return
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    name = os.path.join(folder, "rillstone.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(name)
    sc._rillstone_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all executors are
    this machine's (tests). On a cluster it must be set: others would write to their own disks."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rillstone-')}"
        atexit.register(shutil.rmtree, found[7:], True)
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/rillstone-{sc.applicationId}"


def table(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and its path: later stages don't depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    return table(df)[0]


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of what has been written: Spark deletes them only when the driver collects its garbage,
    and those of the latest query not before another one has run. To be called where much was shuffled."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    time.sleep(0.2)
    spark._jvm.System.gc()


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that table() wrote and no plan reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_ids(docs: DataFrame, column: str = "_row") -> DataFrame:
    """docs with a column that tells rows apart: doc_id where it isn't null and stands once, else a number beyond 2**62
    made from doc_id and text. Rows equal in both share it."""
    spark = docs.sparkSession
    own = F.col("doc_id").cast("long")
    made = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))
    again = cut(docs.where("doc_id is not null").groupBy(own.alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1").select("_twice"))
    if not again.take(1):
        return docs.withColumn(column, F.coalesce(own, made))
    found = docs.join(again, own == F.col("_twice"), "left")
    return found.withColumn(column, F.when(own.isNull() | F.col("_twice").isNotNull(), made).otherwise(own)).drop("_twice")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a graph: (id, component), component the smallest id; ids without an edge aren't listed.

    Alternating large-star and small-star steps: each is a minimum per node with partial aggregation and a join that
    AQE may split where one node has many edges. Rounds grow with the logarithm of the size and end when the edges are
    stars, none for edges that are so from the start; each is written to the shared folder, and at most one row per
    round comes to the driver.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, path = table(e)
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (
            e.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        e, new = table(e)
        forget(spark, path)
        path = new
    members = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars around their v: each u has one edge, and no v is a u."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("end"))
    seen = ends.groupBy("end.id").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("down"))
    return not seen.where("ups > 1 or ups = 1 and down = 0").select("ups").take(1)


def trim() -> None:
    """Gives the memory that a worker has freed back to the machine: workers wait for further tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lighten(own: str) -> None:
    """Drops what tasks of other operators than this module's have cached in a worker, such as vocabularies: workers live
    on through all stages."""
    for name, module in list(sys.modules.items()):
        if name.startswith(f"{__package__}.") and name not in (own, __name__):
            for x in list(vars(module).values()):
                if hasattr(x, "cache_clear"):
                    x.cache_clear()
    _powers.cache_clear()
    trim()


def chunks(it: Iterable[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with a column `text`, each of about `limit` characters or one row; null texts become ''."""
    yield from _chunks(it, limit)
    trim()


def _chunks(it: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in it:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        begin = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its kind (1 white space, 2 letter or digit) and a 64-bit number. None beyond those tried is a
    letter."""
    kind = np.zeros(0x110000, np.uint8)
    kind[:0x40000] = [1 if c.isspace() else 2 if c.isalnum() else 0 for c in map(chr, range(0x40000))]
    return kind, mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_ODD))


_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _ODD, np.uint64), np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n of each at least."""
    return _powers(1 << max(16, (n - 1).bit_length()))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' words one after another, and where each text's begin, and the end.

    A word is what stands between white space, without case and without what isn't a letter or digit at its ends (with
    them, if it has no letter or digit).
    """
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds, numbers = _characters()
    kind = kinds[points]
    within = kind != 1
    edges = np.flatnonzero(within[1:] != within[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    first, last = begin.copy(), end.copy()
    letters = np.flatnonzero(kind == 2)
    for ends, at in ((first, begin), (last, end)):
        odd = np.flatnonzero(kind[at if at is begin else at - 1] != 2)
        near = np.searchsorted(letters, at[odd]) - (at is end)
        near = np.append(letters, -1)[np.clip(near, -1, len(letters))]
        # the nearest letter of the word, if it has one
        has = (near >= begin[odd]) & (near < end[odd])
        ends[odd[has]] = near[has] + (at is end)
    up, down = powers(len(points))
    value = numbers[points]
    value *= up[: len(value)]
    sums = np.cumsum(value, dtype=np.uint64)
    hashes = mix((sums[last - 1] - sums[first - 1]) * down[first])
    places = np.cumsum([1, *(len(t) + 1 for t in lower)])
    return hashes, np.searchsorted(begin, places)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after another, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, texts), np.int64, len(texts))


class Stretches:
    """64-bit hashes of any stretches of code points: sums of random numbers times powers."""

    def __init__(self, points: np.ndarray):
        up, self.down = powers(len(points) + 1)
        value = _characters()[1][points]
        value *= up[: len(value)]
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value, out=self.sums[1:])

    def of(self, begin: np.ndarray, size) -> np.ndarray:
        """Of the code points begin to begin + size, for each of `begin`."""
        return mix((self.sums[begin + size] - self.sums[begin]) * self.down[begin])

    def all(self, size: int) -> np.ndarray:
        """Of as many code points from each on, but for the last ones."""
        n = max(0, len(self.sums) - size)
        x = self.sums[size:] - self.sums[:n]
        x *= self.down[:n]
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_blocks(df: DataFrame, keys: list[str], by: str, size: int) -> DataFrame:
    """df with columns lo, hi, own: the rows of a key, split by hash of `by` into blocks of about `size` rows, once for
    each pair of blocks (lo <= hi) that the row's own block takes part in. A key of up to `size` rows is one block.

    Grouped by keys, lo and hi, every pair of rows of a key meets: in (own, own) if they share a block, else in
    (lo, hi). So no task gets more than two blocks, however many rows a key has.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    hot = hot.select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("_blocks"))
    rows = df.join(hot, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumns({"lo": F.least("own", "_other"), "hi": F.greatest("own", "_other")}).drop("_blocks", "_other")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (node, root) that connect what the edges a-b connect among n nodes: at most n - 1 of them."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = np.nonzero(root != np.arange(n))[0]
    return np.stack([own, root[own]], axis=1)


def banded_distance(a, b, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1, by bit vectors over a band of diagonals.

    Bit k of a vector stands for row j - most + k of column j; the value followed is the band's lowest cell, along the
    diagonal while it has rows to go and along the last row after that.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > most:
        return most + 1
    begin = 0
    while begin < n and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < n - begin and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    a, b = a[begin : n - end], b[begin : m - end]
    n, m = len(a), len(b)
    if not n or not most:
        return min(m, most + 1)
    most_ = min(most, m)
    width = 2 * most_ + 1
    mask = (1 << width) - 1
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    # rows run over b (the longer), columns over a
    vp, vn, last = (mask >> most_) << most_, 0, most_
    hopeless = most + n - m + most_
    top = 1 << width - 1
    across = top
    for j in range(n):
        p = where.get(a[j], 0)
        shift = j - most_
        x = (p >> shift if shift >= 0 else p << -shift) & mask
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if j + most_ < m:
            last += not d0 & top
        else:
            across >>= 1
            last += bool(hp & across) - bool(hn & across)
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
        if last > hopeless:
            return most + 1
    return min(last, most + 1)


def _held(column: pa.Array, ragged: bool = False):
    """Numbers as an array, lists of them as rows filled up with zeros (or as one array and where each list begins), and
    texts and bytes as a list."""
    kind = column.type
    if pa.types.is_list(kind):
        ends = column.offsets.to_numpy()
        if ragged:
            return column.flatten().to_numpy(), ends - ends[0]
        sizes = np.diff(ends)
        out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(row)) - (ends[:-1] - ends[0])[row]] = column.flatten().to_numpy()
        return out
    return column.to_pylist() if pa.types.is_binary(kind) or pa.types.is_string(kind) else column.to_numpy(zero_copy_only=False)


def _gathered(batches: Iterable[pa.RecordBatch], by: list[str], rows: int = 20_000, size: int = 24_000_000) -> Iterator[pa.Table]:
    """Tables of whole groups of sorted rows, of about so many rows or bytes, or one group."""
    held, n_rows, n_bytes = [], 0, 0
    for batch in batches:
        if not len(batch):
            continue
        if n_rows >= rows or n_bytes >= size:
            last = [held[-1].column(k)[len(held[-1]) - 1] for k in by]
            at = 0
            while at < len(batch) and all(batch.column(k)[at] == v for k, v in zip(by, last, strict=True)):
                at += 1
            if at < len(batch):
                yield pa.Table.from_batches([*held, batch.slice(0, at)])
                held, batch, n_rows, n_bytes = [], batch.slice(at), 0, 0
        held.append(batch)
        n_rows += len(batch)
        n_bytes += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


#: Pairs aligned side by side, and the widest band (edits each way) that is.
ABREAST = 4096
WIDEST = 255


def _common(a: str, b: str) -> int:
    """How many characters two texts have in common from the start on."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def banded_distances(texts: list[str], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """banded_distance of texts[i] and texts[j] for each pair, side by side: exact up to most, else more than that.

    What two texts have in common at both ends needs no alignment. Pairs are ordered by their allowed edits and the
    lengths of what is left, so that those side by side are alike; few pairs, and those of very wide bands, are aligned
    one by one.
    """
    out = most + 1
    rest, sides = [], []
    for k, (x, y, limit) in enumerate(zip(i.tolist(), j.tolist(), most.tolist(), strict=True)):
        a, b = texts[x], texts[y]
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > limit:
            continue
        begin = _common(a, b)
        a, b = a[begin:], b[begin:]
        end = _common(a[::-1], b[::-1])
        a, b = a[: len(a) - end], b[: len(b) - end]
        if not a or not limit:
            out[k] = min(len(b), limit + 1)
        else:
            rest.append(k)
            sides.append((a, b))
    rest = np.array(rest, np.int64)
    size = np.fromiter((len(b) for _, b in sides), np.int64, len(sides))
    # no more edits than characters are left
    limit = np.minimum(most[rest], size)
    step = np.ceil(np.log(np.maximum(limit, 4)) / np.log(1.3))
    order = np.lexsort((size, step))
    at = 0
    while at < len(order):
        part = order[at : at + max(16, min(ABREAST, 4_000_000 // int(size[order[at]])))]
        part = part[(step[part] == step[part[0]]) & (size[part] <= 2 * size[part[0]] + 16)]
        at += len(part)
        if len(part) < 48 or limit[part].max() > WIDEST:
            out[rest[part]] = [banded_distance(*sides[k], int(most[rest[k]])) for k in part.tolist()]
        else:
            out[rest[part]] = _abreast([sides[k] for k in part.tolist()], int(limit[part].max()))
    return out


def _abreast(sides: list[tuple[str, str]], k: int) -> np.ndarray:
    """Edit distances of pairs (shorter, longer) of texts by bit vectors of 2k + 1 diagonals, in as many 64-bit numbers as
    that takes; what is more than k comes out as some number over k."""
    sides_ = sorted(range(len(sides)), key=lambda x: -len(sides[x][0]))  # those with many columns first
    a, n = code_points([sides[x][0] for x in sides_])
    b, m = code_points([sides[x][1] for x in sides_])
    code = np.concatenate((a, b))
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    letters = np.flatnonzero(seen)
    if len(letters) < 250:
        short = np.zeros(0x110000, np.uint8)
        short[letters] = np.arange(2, len(letters) + 2)
        code = short[code]
    else:
        code = code + np.uint32(2)
    width, count, cols = 2 * k + 1, len(sides), int(n.max())

    def laid(part, sizes, before, after, empty):
        out = np.full((count, before + int(sizes.max()) + after), empty, code.dtype)
        row = np.repeat(np.arange(count), sizes)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + before] = part
        return out

    b = laid(code[len(a) :], m, k, max(0, cols - int(m.max())) + k + 1, 1)
    a = np.ascontiguousarray(laid(code[: len(a)], n, 0, 0, 0).T)
    limbs = width // 64 + 1
    u, one = np.uint64, np.uint64(1)
    bits = [(1 << width) - 1 >> 64 * q & (1 << 64) - 1 for q in range(limbs)]
    mask = [u(x) for x in bits]
    bits = [((1 << width) - 1 >> k << k) >> 64 * q & (1 << 64) - 1 for q in range(limbs)]
    vp = np.stack([np.full(count, u(x)) for x in bits])
    vn = np.zeros_like(vp)
    last, ended, who = np.minimum(k, m), np.full(count, k + 1), np.array(sides_)
    top_limb, top = divmod(width - 1, 64)
    alive = np.searchsorted(-n, -np.arange(cols), side="left")  # pairs with more than so many columns
    number = np.arange(count)
    # eight bytes of 0 or 1 make one byte by a multiplication
    size = (width + 7) // 8
    equal = np.zeros((count, 8 * size), bool)
    packed = np.zeros((count, 8 * limbs), np.uint8)
    base, lowest = m - 1 + k, width - 1
    for col in range(cols):
        live = int(alive[col])
        if col % 32 == 31:
            # the value followed can fall by no more than the steps that are left along the last row
            keep = (last <= 2 * k + n - m) | (n <= col)
            if keep.sum() < 0.7 * len(keep):
                ended[who[n <= col]] = last[n <= col]
                keep &= n > col
                a, b, n, m, last, who = np.ascontiguousarray(a[:, keep]), b[keep], n[keep], m[keep], last[keep], who[keep]
                vp, vn, equal, packed, base, number = vp[:, keep], vn[:, keep], equal[keep], packed[keep], base[keep], number[: len(n)]
                if not len(n):
                    return ended
                alive = np.searchsorted(-n, -np.arange(cols), side="left")
                live = len(n)
        np.equal(b[:live, col : col + width], a[col, :live, None], out=equal[:live, :width])
        packed[:live, :size] = equal[:live].view(u) * u(0x0102040810204080) >> u(56)
        p = packed[:live].view(u).T
        v, w = vp[:, :live], vn[:, :live]
        d0 = np.empty((limbs, live), u)
        carry = None
        for q in range(limbs):
            term = p[q] & v[q]
            total = term + v[q]
            if limbs > 1:
                over = total < term
                if carry is not None:
                    total += carry
                    over |= (total == 0) & (carry == one)
                carry = over.astype(u)
            d0[q] = ((total ^ v[q]) | p[q] | w[q]) & mask[q]
        hp = w | ~(d0 | v)
        hn = d0 & v
        at = np.minimum(np.maximum(base[:live] - col, 0), lowest)
        if limbs == 1:
            shift = at.astype(u)
            down = (hp[0] >> shift & one).view(np.int64) - (hn[0] >> shift & one).view(np.int64)
        else:
            limb, shift = at >> 6, (at & 63).astype(u)
            down = (hp[limb, number[:live]] >> shift & one).view(np.int64) - (hn[limb, number[:live]] >> shift & one).view(np.int64)
        last[:live] += np.where(at == lowest, 1 - (d0[top_limb] >> u(top) & one).view(np.int64), down)
        half = d0 >> one
        if limbs > 1:
            half[:-1] |= d0[1:] << u(63)
        for q in range(limbs):
            vp[q, :live] = (hn[q] | ~(half[q] | hp[q])) & mask[q]
        vn[:, :live] = half & hp
    ended[who] = last
    return ended


def pairs_in_groups(spread: DataFrame, keys: list[str], columns: list[str], near, rows: bool = False, counts: bool = False, ragged: str = "") -> DataFrame:
    """a, b: pairs of ids (a < b) that stand in one group of `keys`, in two blocks where lo < hi, and that near() keeps;
    or with `rows` the keys, lo, hi, own and id of each row that stands in such a pair; or with `counts`
    rows a, b, n of some groups at once: where n > 0 the sum of the `weight` of the rows that near() keeps with a (its own
    b), and where n = 0 edges a-b that connect what these pairs connect.

    spread: as in_blocks() gives it, with a column id. Rows are sorted by group and read as a stream: one task holds a
    few thousand rows or one group of two blocks. near(columns, i, j) gets the sorted rows' `columns` as arrays and two
    arrays of places, and says which pairs to keep; the column `ragged` of lists isn't filled up. Groups of two rows cost as little as the rows themselves.
    """
    by = [*keys, "lo", "hi"]
    spread = spread.select(*by, "id", "own", *columns).repartition(*by).sortWithinPartitions(*by, "id")
    marks = [*by, "own", "id"]

    def pairs(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        held = {c: _held(part.column(c).combine_chunks(), c == ragged) for c in [*columns, "id", *keys]}
        ids, own, lo, hi = (part.column(c).to_numpy() for c in ("id", "own", "lo", "hi"))
        code = np.zeros(len(part), np.int64)
        for k in by:
            x = part.column(k).to_numpy()
            code[1:] += x[1:] != x[:-1]
        code = np.cumsum(code > 0)
        i = np.arange(len(part))
        out, step = [np.zeros((0, 2), np.int64)], 1
        touched = np.zeros(len(part), bool)
        nodes, of = np.unique(ids, return_inverse=True)
        weight, trees, waiting = np.zeros(len(nodes), np.int64), np.zeros((0, 2), np.int64), 0

        def count() -> None:
            """What near() keeps of the pairs that wait goes into the weights and the forest."""
            nonlocal out, trees, waiting
            a, b = np.concatenate(out).T
            ok = near(held, a, b)
            a, b = a[ok], b[ok]
            np.add.at(weight, of[a], held["weight"][b])
            np.add.at(weight, of[b], held["weight"][a])
            trees = forest(len(nodes), *np.concatenate((trees, np.stack([of[a], of[b]], axis=1))).T)
            out, waiting = out[:1], 0

        while len(i):
            i = i[i + step < len(part)]
            i = i[code[i + step] == code[i]]
            ok = i[((lo[i] == hi[i]) | (own[i] != own[i + step])) & (ids[i] != ids[i + step])]
            if counts:
                for at in range(0, len(ok), AT_ONCE):
                    out.append(np.stack([ok[at : at + AT_ONCE], ok[at : at + AT_ONCE] + step], axis=1))
                    waiting += len(out[-1])
                    if waiting >= AT_ONCE:
                        count()
            elif len(ok):
                ok = ok[near(held, ok, ok + step)]
                if rows:
                    touched[ok] = touched[ok + step] = True
                else:
                    out.append(np.stack([ids[ok], ids[ok + step]], axis=1))
            step += 1
        if counts:
            count()
            a, b = trees.T
            has = np.flatnonzero(weight)
            columns_ = (nodes[has], nodes[a]), (nodes[has], nodes[b]), (weight[has], np.zeros(len(a), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns_], names=["a", "b", "n"])
        if rows:
            return pa.RecordBatch.from_arrays([part.column(c).combine_chunks().filter(pa.array(touched)) for c in marks], names=marks)
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    def run(batches):
        yield from map(pairs, _gathered(batches, by))
        trim()

    if rows:
        return spread.mapInArrow(run, spread.select(*marks).schema)
    if counts:
        return spread.mapInArrow(run, "a long, b long, n long")
    return spread.mapInArrow(run, "a long, b long").distinct()
