"""Packing of token sequences: first-fit decreasing on a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare
from .token_counts import Segments, byte_symbols

LENGTH = 2048
SEPARATOR = 1
#: Documents of one packing group; bounds a task's memory whatever the input's size.
GROUP = 8192


class Encoder(Segments):
    """The library's ids as (little-endian, as all of Spark's platforms) unsigned 32-bit bytes, for a byte-level BPE file of tokenizers.

    tiktoken makes the ids: its ranks are the file's ids, the pattern is the same, and tests hold both alike.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(set(merged)):
            raise ValueError(f"{path}: ids aren't in the order of the merges, so they can't be taken for ranks")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        super().__init__(list(self.added), most)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        plain = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.library = tiktoken.Encoding("packing", pat_str=plain, mergeable_ranks=ranks, special_tokens={})

    def unit(self, unit: str) -> bytes:
        return array("I", self.library.encode_ordinary(unit)).tobytes()

    def encode(self, text: str) -> bytes:
        parts = self.parts(text)
        if len(parts) == 1:
            return b"".join(self.results(text)) if text else b""
        marks = [*self.special.findall(text), None]
        out = []
        for part, mark in zip(parts, marks, strict=True):
            out += self.results(part) if part else []
            if mark is not None:
                out.append(self.added[mark].to_bytes(4, "little"))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its place in that bin: largest item first, each into the first bin with room.

    A tournament tree holds each bin's room at a leaf and the larger of two rooms above, so the first bin with room is
    found by one walk down. Ties keep the items' order.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item], places[item] = node - leaves, capacity - room[node]
        room[node] -= size
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return bins, places


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and a final separator, cut every `length` ids: doc_id, start, length, ids_crc32, doc_tokens
    (and ids, if keep_ids). Null and empty texts are the separator alone. Every id lies in one piece."""
    prepare(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        encode, end = encoder(tokenizer_path).encode, int(separator).to_bytes(4, "little")
        for batch, texts in chunks(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                data = encode(text) + end
                total = len(data) // 4
                for start in range(0, total, length):
                    own = data[4 * start : 4 * (start + length)]
                    row = (doc, start, len(own) // 4, zlib.crc32(own), total)
                    rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if keep_ids else row)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, separator: int = SEPARATOR, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """The pieces of token_pieces() with sequence_id and offset: where each lies, gapless from 0 in its sequence.

    A document longer than `length` fills whole sequences; what is left of it, and shorter documents, are packed by
    first-fit decreasing within a group of about `group` documents chosen by hash. Groups are independent, so any
    number of tasks can pack, and a lost one is packed again alike. sequence_id is unique over all groups. An empty
    table gives no rows; repeated rows are packed each.
    """
    pieces = token_pieces(docs, tokenizer_path, length, separator, keep_ids)
    groups = max(1, -(-docs.count() // group))
    pieces = pieces.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "doc_tokens", "ids_crc32"), F.lit(groups)))

    def run(key, part):
        part = part.drop(["packing_group"]).sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, places = first_fit_decreasing(part.column("length").to_numpy(), length)
        return part.append_column("sequence_id", pa.array(key[0].as_py() * (1 << 31) + bins)).append_column("offset", pa.array(places))

    schema = pieces.drop("packing_group").schema.add("sequence_id", "long").add("offset", "long")
    return pieces.groupBy("packing_group").applyInArrow(run, schema)
