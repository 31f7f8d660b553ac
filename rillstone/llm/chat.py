"""Chat formatting by prefix-target expansion: one example for each assistant turn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: The template's own control strings, and those of other templates that texts may carry.
OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_HIDE = re.compile("|".join([re.escape("\\"), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]))
_SHOW = re.compile(r"\\(.)", re.S)
TRAINED = "assistant"


def escape(text: str) -> str:
    """A backslash goes behind each backslash and behind the first character of each control string, of overlapping ones
    too, so none is left."""
    return _HIDE.sub(lambda m: f"{m[0]}\\", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"\1", text)


def _head(role: str) -> str:
    return f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"


_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(CLOSE), re.S)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted example, unescaped. CLOSE can't occur inside a turn: it is escaped there."""
    for m in _TURN.finditer(text):
        yield unescape(m[1]), unescape(m[2])


def expand(turns: list[tuple[str, str]]) -> Iterator[tuple[int, str, int, int]]:
    """(target turn or -1, formatted text, loss begin, loss end) of one conversation, in order.

    Each assistant turn is the target of one example that ends with it, all turns before it being context; the loss
    span covers its escaped text alone. Turns after the last assistant turn, or of a conversation without one, close
    with a context-only example (target -1, empty span), so that no turn is lost.
    """
    text = ""
    last = -1
    for k, (role, said) in enumerate(turns):
        text += _head(role)
        begin = len(text)
        text += escape(said)
        end = len(text)
        text += f"{CLOSE}\n"
        if role == TRAINED:
            last = k
            yield k, text, begin, end
    if last < len(turns) - 1:
        yield -1, text, len(text), len(text)


def _conversations(batches) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    now, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if not begun or conv != now:
                if begun:
                    yield now, turns
                now, turns, begun = conv, [], True
            turns.append((role or "", text or ""))
    if begun:
        yield now, turns


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(conversations: DataFrame) -> DataFrame:
    """Examples of (conv_id, turn, role, text) rows: conv_id, target (the turn's place, or -1), text, loss_begin, loss_end.

    Turns are ordered by turn, ties by role, then text; repeated rows are turns of their own. Null roles and texts are
    empty; rows with a null conv_id form one conversation. One shuffle by conv_id, then a streaming pass over sorted
    rows: memory is bounded by one conversation, which no task can do without, as each example holds all turns before it.
    """
    prepare(conversations.sparkSession)

    def run(batches):
        rows, size = [], 0
        for conv, turns in _conversations(batches):
            for example in expand(turns):
                rows.append((conv, *example))
                size += len(example[1])
                if size > 4_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    return _sorted(conversations).mapInArrow(run, "conv_id long, target int, text string, loss_begin long, loss_end long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "target", "text", "loss_begin", "loss_end"])


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of format_chat()'s output, read from the formatted texts alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Keeps format_chat()'s order of rows, so it must follow it without a shuffle."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        out, now, begun, held = [], None, False, None

        def close():
            whole = hashlib.sha256()
            n = 0
            for role, said in read_turns(held["text"]):
                whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                n += 1
            out.append((now, n, whole.hexdigest(), held["loss"], held["hash"].hexdigest(), held["chars"]))

        for batch in batches:
            for conv, text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_begin", "loss_end")), strict=True):
                if not begun or conv != now:
                    if begun:
                        close()
                    now, begun, held = conv, True, {"loss": 0, "hash": hashlib.sha256(), "chars": 0}
                said = unescape(text[begin:end])
                held["loss"] += len(said)
                held["hash"].update(said.encode("utf-8", "surrogatepass"))
                held["chars"] += len(text)
                held["text"] = text  # the last example of a conversation holds all its turns
            if len(out) > 1000:
                yield _digest(out, names)
                out.clear()
        if begun:
            close()
        if out:
            yield _digest(out, names)

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
