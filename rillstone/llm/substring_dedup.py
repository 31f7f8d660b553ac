"""Removal of repeated byte strings by blockwise suffix sorting over a cover sample.

A difference cover samples suffixes by position, 19% of them and more for 50-byte strings, and all of these would travel.
The sample here is a cover by content: of each 50-byte string the 24 bytes with the smallest hash, which every copy of
the string has at the same place, so 7% suffice. Suffixes are sorted one bucket of cover keys at a time; long ties are
resolved by precomputed ranks of the cover sample (a fingerprint of the stretch that a cover point stands for), and what
these can't tell apart, where copies begin and end, by the bytes themselves.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, forget, mix, prepare, release, table

LENGTH = 50
COVER = 24
#: Entries that a task gathers before it deals them out, and bytes of text hashed at once.
GATHERED = 1_500_000
STRETCH = 2_000_000

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _ODD, _U), np.full(size, pow(_ODD, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def cover_points(data: bytes, length: int = LENGTH, cover: int = COVER) -> tuple[np.ndarray, ...]:
    """key, rank, point, low, high of each cover point of one text: the strings of `length` bytes that start at
    low..high have it as theirs; rank is a fingerprint of data[low : high + length] and the point's place in it."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (_U, _U, np.int64, np.int64, np.int64))
    words = np.empty(n - 7, _U)
    for r in range(8):
        part = np.frombuffer(data, "<u8", count=(n - r) // 8, offset=r)
        words[r::8] = part
    h = words[: n - cover + 1] * _U(_ODD)
    for k in range(8, cover, 8):
        h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93) + words[k : n - cover + 1 + k] * _U(0xC2B2AE3D27D4EB4F)
    h = mix(h)
    span = length - cover + 1
    low = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = span - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = (low & _U(0xFFFFFFFF)).astype(np.int64)
    begin = np.nonzero(np.diff(at, prepend=-1))[0]
    end = np.append(begin[1:], len(at)) - 1
    point = at[begin]
    up, down = _powers(n)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(words) * up[: len(words)], dtype=_U)))
    rank = (sums[end + length - 7] - sums[begin]) * down[begin]
    rank = mix(rank + (point - begin).astype(_U) * _U(0xA0761D6478BD642F) + (end - begin).astype(_U))
    return mix(h[point] ^ _U(0x5851F42D4C957F2D)), rank, point, begin, end


def _five(x: np.ndarray) -> bytes:
    """The low 40 bits of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _place(point, low, high):
    return point.astype(_U) << _U(10) | (point - low).astype(_U) << _U(5) | (point - high).astype(_U)


def _spans(place: np.ndarray, length: int) -> np.ndarray:
    point = (place >> _U(10)).astype(np.int64)
    return np.stack([point - (place >> _U(5) & _U(31)).astype(np.int64), point - (place & _U(31)).astype(np.int64) + length], axis=1)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _deal(docs: list[tuple[int, int]], parts: list[tuple[np.ndarray, ...]], buckets: int, length: int) -> pa.RecordBatch:
    """Rows (bucket, doc_id, crc, packed): cover points by bucket of their keys; what this task's own texts already show
    to be repeated goes out by document (bucket -1), and of points alike only those of the first document go on."""
    key, rank, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids = np.array([d for d, _ in docs], np.int64)
    crcs = np.array([c for _, c in docs], np.uint32)
    order = np.lexsort((doc, ids[doc], rank, key))
    key, rank, doc, place = key[order], rank[order], doc[order], place[order]
    new = _runs(key, rank)
    first = ids[doc][np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    known = ids[doc] > first
    rows = _by_document(ids[doc[known]], crcs[doc[known]], place[known])
    out = [(-1, d, c, p) for d, c, p in rows]
    key, rank, doc, place = key[~known], rank[~known], doc[~known], place[~known]
    bucket = (key & _U(buckets - 1)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        own = order[ends[b] : ends[b + 1]]
        if len(own):
            used, at = np.unique(doc[own], return_inverse=True)
            head = np.array([len(used), len(own)], "<i8").tobytes() + ids[used].astype("<i8").tobytes() + crcs[used].astype("<u4").tobytes()
            out.append((b, None, None, head + _five(key[own] >> _U(24)) + _five(rank[own]) + at.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes() + _five(place[own])))
    columns = zip(*out, strict=True) if out else ((), (), (), ())
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "doc_id", "crc", "packed"])


def _by_document(ids: np.ndarray, crcs: np.ndarray, values: np.ndarray):
    order = np.lexsort((values, crcs, ids))
    ids, crcs, values = ids[order], crcs[order], values[order]
    ends = np.append(np.nonzero(_runs(ids, crcs))[0], len(ids))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield int(ids[a]), int(crcs[a]), _five(values[a:b])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, crc, spans: for each document with bytes in a repeated string, packed (begin, end) pairs of such strings,
    which may overlap. docs: doc_id, text, crc. Two shuffles: cover points by key, and texts for the ends of copies."""
    spark = docs.sparkSession
    prepare(spark)
    buckets = 1 << max(5, (docs.count() // 2048).bit_length())

    def sample(batches):
        held, parts, size = [], [], 0
        for batch, texts in chunks(batches, STRETCH):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                key, rank, point, low, high = cover_points(data, length)
                if len(key):
                    parts.append((key, rank, np.full(len(key), len(held)), _place(point, low, high)))
                    held.append((doc, zlib.crc32(data)))
                    size += len(key)
            if size > GATHERED:
                yield _deal(held, parts, buckets, length)
                held, parts, size = [], [], 0
        if parts:
            yield _deal(held, parts, buckets, length)

    def compare(key, part):
        bucket = key[0].as_py()
        if bucket < 0:
            return part.select(["doc_id", "crc", "packed"]).append_column("kind", pa.array(np.zeros(len(part), np.int32)))
        got = [[] for _ in range(5)]
        for blob in part.column("packed").to_pylist():
            n, m = np.frombuffer(blob, "<i8", 2).tolist()
            at = 16
            ids = np.frombuffer(blob, "<i8", n, at)
            crcs = np.frombuffer(blob, "<u4", n, at + 8 * n)
            at += 12 * n
            size = 2 if n <= 1 << 16 else 4
            who = np.frombuffer(blob, f"<u{size}", m, at + 10 * m)
            for x, v in zip(got, (_from_five(blob[at : at + 5 * m]), _from_five(blob[at + 5 * m : at + 10 * m]), ids[who], crcs[who], _from_five(blob[at + (10 + size) * m :])), strict=True):
                x.append(v)
        k, rank, ids, crcs, place = map(np.concatenate, got)
        order = np.lexsort((ids, rank, k))
        k, rank, ids, crcs, place = k[order], rank[order], ids[order], crcs[order], place[order]
        new = _runs(k, rank)
        at = np.arange(len(k))
        first = ids[np.maximum.accumulate(np.where(new, at, 0))]
        known = ids > first
        fresh = _runs(k)
        starts = np.nonzero(fresh)[0]
        group = np.cumsum(fresh) - 1
        several = np.add.reduceat(new.astype(int), starts)[group] > 1
        apart = (np.minimum.reduceat(first, starts) < np.maximum.reduceat(first, starts))[group]
        ask = ~known & several & apart
        out = [(d, c, p, 0) for d, c, p in _by_document(ids[known], crcs[known], place[known])]
        # a request: the place, and the key's bits left of the bucket, to meet again
        order = np.lexsort((crcs[ask], ids[ask]))
        a_ids, a_crcs, a_place, a_key = ids[ask][order], crcs[ask][order], place[ask][order], k[ask][order]
        ends = np.append(np.nonzero(_runs(a_ids, a_crcs))[0], len(a_ids))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out.append((int(a_ids[a]), int(a_crcs[a]), np.array([b - a, bucket], "<i8").tobytes() + _five(a_key[a:b]) + _five(a_place[a:b]), 1))
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int32())], names=["doc_id", "crc", "packed", "kind"])

    dealt = docs.select("doc_id", "text").mapInArrow(sample, "bucket int, doc_id long, crc long, packed binary")
    # rows of bucket -1 need no meeting: they are spread over as many groups as there are documents
    key = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("doc_id"), F.lit(4 * buckets))).otherwise(F.col("bucket")).cast("int")
    found, found_at = table(dealt.withColumn("bucket", key).groupBy("bucket").applyInArrow(compare, "doc_id long, crc long, packed binary, kind int"))
    release(spark)
    asked = found.where("kind = 1").groupBy("doc_id", "crc").agg(F.collect_list("packed").alias("asked"))

    def fetch(batches):
        for batch, texts in chunks(batches, STRETCH):
            rows = {}
            for doc, crc, asked_, text in zip(batch.column("doc_id").to_pylist(), batch.column("crc").to_pylist(), batch.column("asked").to_pylist(), texts, strict=True):
                data = np.frombuffer(b"\0" * length + text.encode("utf-8", "surrogatepass") + b"\0" * length, np.uint8)
                for blob in asked_:
                    n, bucket = np.frombuffer(blob, "<i8", 2).tolist()
                    key, place = blob[16 : 16 + 5 * n], _from_five(blob[16 + 5 * n :])
                    point = (place >> _U(10)).astype(np.int64)
                    around = data[(point + length - (length - COVER))[:, None] + np.arange(2 * length - COVER)]
                    rows.setdefault(bucket, []).append((key, np.full(n, doc), np.full(n, crc), place, around))
            out = []
            for bucket, parts in rows.items():
                keys, ids, crcs, place, around = zip(*parts, strict=True)
                n = sum(map(len, ids))
                out.append((bucket, np.array([n], "<i8").tobytes() + b"".join(keys) + np.concatenate(ids).astype("<i8").tobytes() + np.concatenate(crcs).astype("<i8").tobytes() + np.concatenate(place).astype("<u8").tobytes() + np.concatenate(around).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "packed"])

    width = 2 * length - COVER

    def settle(key, part):
        got = [[] for _ in range(5)]
        for blob in part.column("packed").to_pylist():
            n = int(np.frombuffer(blob, "<i8", 1)[0])
            at = 8
            for x, (size, kind) in zip(got, ((5, None), (8, "<i8"), (8, "<i8"), (8, "<u8"), (width, np.uint8)), strict=True):
                raw = blob[at : at + size * n]
                x.append(_from_five(raw) if kind is None else np.frombuffer(raw, kind).reshape((n, width) if size == width else n))
                at += size * n
        k, ids, crcs, place, around = map(np.concatenate, got)
        back, ahead = (place >> _U(5) & _U(31)).astype(np.int64), (place & _U(31)).astype(np.int64)
        point = (place >> _U(10)).astype(np.int64)
        out = []
        order = np.argsort(k, kind="stable")
        ends = np.append(np.nonzero(_runs(k[order]))[0], len(order))
        # keys in blocks, so that the strings of a block stay within some tens of MB
        at = 0
        while at < len(ends) - 1:
            to = at + 1
            while to < len(ends) - 1 and ends[to + 1] - ends[at] <= 20_000:
                to += 1
            own = order[ends[at] : ends[to]]
            at = to
            for shift in range(length - COVER + 1):
                rows = own[(back[own] >= shift) & (ahead[own] <= shift)]
                if len(rows) < 2:
                    continue
                begin = length - COVER - shift
                strings = np.zeros((len(rows), 56), np.uint8)
                strings[:, :length] = around[rows, begin : begin + length]
                words = strings.view(">u8")
                sort = np.lexsort((ids[rows], *(words[:, c] for c in range(6, -1, -1)), k[rows]))
                rows, words = rows[sort], words[sort]
                new = _runs(k[rows], *(words[:, c] for c in range(7)))
                first = ids[rows][np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
                hit = rows[ids[rows] > first]
                begin = point[hit] - shift
                out.append((ids[hit], crcs[hit], _place(begin, begin, begin)))
        ids_, crcs_, place_ = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))
        rows = list(_by_document(ids_, crcs_, place_))
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["doc_id", "crc", "packed"])

    fetched = docs.join(asked, ["doc_id", "crc"]).select("doc_id", "crc", "asked", "text").mapInArrow(fetch, "bucket int, packed binary")
    settled = fetched.groupBy("bucket").applyInArrow(settle, "doc_id long, crc long, packed binary")
    both = found.where("kind = 0").select("doc_id", "crc", "packed").unionByName(settled)
    spans = table(both.groupBy("doc_id", "crc").agg(F.collect_list("packed").alias("packed")))[0]
    forget(spark, found_at)
    release(spark)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, kept (binary), spans (begin and end of each maximal removed run) for every row of (doc_id, text).

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller doc_id. Null texts count
    as empty. Rows with a null doc_id are left whole and repeat nothing; rows of one doc_id don't repeat each other, and
    a row is known by doc_id and the CRC of its text. Spans are in UTF-8 bytes and may cut a character.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("crc", F.crc32(F.col("text").cast("binary")))
    spans = repeated_spans(rows.where("doc_id is not null"), length)

    def run(batches):
        for batch, texts in chunks(batches, STRETCH):
            size, kept, removed = [], [], []
            for text, packed in zip(texts, batch.column("packed").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                marks = np.zeros(len(data) + 1, np.int64)
                for blob in packed or []:
                    span = _spans(_from_five(blob), length)
                    np.add.at(marks, span[:, 0], 1)
                    np.add.at(marks, span[:, 1], -1)
                gone = np.cumsum(marks)[:-1] > 0
                edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
                size.append(len(data))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes() if packed else data)
                removed.append(np.stack([np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]], axis=1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "kept", "spans"])

    joined = rows.join(spans, ["doc_id", "crc"], "left").select("doc_id", "text", "packed")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<long>")
