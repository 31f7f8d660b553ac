"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are emitted."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare

#: Fixed value: the byte-level pre-tokenizer's pattern. White space is Unicode's White_Space, written out.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_DOUBLE = re.compile(r"\s\s")
_POSITION = 40


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Segments:
    """Cuts a text into units that pre-tokenization never crosses, and keeps a result for each unit seen before.

    A single space between two other characters always begins a new pre-token, so a text without two adjacent white
    space characters falls apart at its spaces. Other texts go through the pattern as a whole. `most` bounds the kept
    units; units over 64 characters aren't kept.
    """

    def __init__(self, specials: list[str], most: int):
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.most, self.kept = most, {}

    def unit(self, unit: str):
        raise NotImplementedError

    def parts(self, text: str) -> list[str]:
        return self.special.split(text) if self.special else [text]

    def results(self, part: str) -> list:
        if _DOUBLE.search(part):
            return [self.unit(part)]
        first, *units = part.split(" ")
        kept = self.kept
        got = list(map(kept.get, units))
        if None in got:
            if len(kept) > self.most:
                kept.clear()
            for i, x in enumerate(got):
                if x is None:
                    u = units[i]
                    got[i] = x = self.unit(" " + u)
                    if len(u) <= 64:
                        kept[u] = x
        if first:
            got.append(self.unit(first)) if not got else got.insert(0, self.unit(first))
        return got


class PairMerger(Segments):
    """Counts tokens of a byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str, most: int = 1_200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__([t["content"] for t in spec.get("added_tokens", [])], most)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[s] for s in byte_symbols()]
        self.width = max(vocab.values()) + 1
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] * self.width + vocab[b], rank * self.width + vocab[a + b])
        self.pattern = regex.compile(PATTERN)
        self.words: dict[str, int] = {}

    def word(self, data: bytes) -> int:
        """Symbols left of one pre-token: its bytes less the merges made, lowest rank first, leftmost first."""
        left = n = len(data)
        if n < 2:
            return n
        ranks, width = self.ranks, self.width
        symbols = [self.first[b] for b in data]
        heap = []
        for i in range(n - 1):
            found = ranks.get(symbols[i] * width + symbols[i + 1])
            if found is not None:
                heap.append((found // width) << _POSITION | i)
        if not heap:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(heap)
        mask = (1 << _POSITION) - 1
        while heap:
            entry = heappop(heap)
            i = entry & mask
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = ranks.get(symbols[i] * width + symbols[j])
            if found is None or found // width != entry >> _POSITION:
                continue
            symbols[i], symbols[j] = merged, _ = found % width, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                found = ranks.get(merged * width + symbols[k])
                if found is not None:
                    heappush(heap, (found // width) << _POSITION | i)
            h = before[i]
            if h >= 0:
                found = ranks.get(symbols[h] * width + merged)
                if found is not None:
                    heappush(heap, (found // width) << _POSITION | h)
        return left

    def unit(self, unit: str) -> int:
        words, total = self.words, 0
        for w in self.pattern.findall(unit):
            n = words.get(w)
            if n is None:
                n = self.word(w.encode("utf-8"))
                if len(w) <= 64:
                    if len(words) > self.most:
                        words.clear()
                    words[w] = n
            total += n
        return total

    def count(self, text: str) -> int:
        parts = self.parts(text)
        return len(parts) - 1 + sum(sum(self.results(p)) for p in parts if p)


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every document of (doc_id, text, ...).

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null doc_ids give a row each; other columns are
    ignored. An added token's string inside a text counts as that token. One pass, no shuffle; `tokenizer_path` must
    exist on every executor.
    """
    prepare(docs.sparkSession)

    def run(batches):
        count = merger(tokenizer_path).count
        for batch, texts in chunks(batches):
            tokens = pa.array(list(map(count, texts)), pa.int64())
            size = pa.array([len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, tokens], names=["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
