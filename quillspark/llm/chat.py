"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted
spans of assistant texts are intersected with the token spans by binary search.
Control strings inside texts and roles are escaped reversibly, so a rendering
parses back into its turns whatever they say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import hold, tidy

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """A backslash before every backslash, and between ``<`` and ``|``: no control string is left."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    if "\\" not in text:
        return text
    return "\\".join(part.replace("<\\|", "<|") for part in text.split("\\\\"))


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation, and the (start, stop) of the escaped text of each assistant turn."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        at += len(head)
        if role == LOSS_ROLE:
            spans.append((at, at + len(body)))
        parts += (head, body, f"{END}\n")
        at += len(body) + len(END) + 1
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a rendering, unescaped."""
    turns = []
    for chunk in formatted.split(f"{END}\n")[:-1]:
        role, _, text = chunk.removeprefix(START).partition("\n")
        turns.append((_role(role), unescape(text)))
    return turns


def _role(shown: str) -> str:
    return "\\".join(part.replace("\\n", "\n").replace("<\\|", "<|") for part in shown.split("\\\\"))


def loss_spans(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The part of each token's (start, stop) that lies inside a span; (x, x) where none does.

    Both inputs are sorted. A token never straddles two spans, as control
    strings, which are tokens of their own, stand between them. Tokens that
    share a code point leave it to the first of them.
    """
    out = np.zeros_like(tokens)
    if not len(spans) or not len(tokens):
        return out
    start = np.maximum(tokens[:, 0], np.concatenate(([0], np.maximum.accumulate(tokens[:-1, 1]))))
    k = np.searchsorted(spans[:, 1], start, side="right")
    inside = k < len(spans)
    near = spans[np.minimum(k, len(spans) - 1)]
    lo, hi = np.maximum(start, near[:, 0]), np.minimum(tokens[:, 1], near[:, 1])
    hit = inside & (lo < hi)
    out[hit] = np.stack((lo, hi), axis=1)[hit]
    return out


def _tokenizer(path: str):
    """The tokenizer with the control strings as tokens; a worker holds it while tasks of this operator follow each other."""
    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens([START, END])
        return tokenizer

    return hold(("chat", path), make)


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Conversations out of rows (conv_id, role, text) sorted by conversation; one is held at a time."""
    key, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not begun or conv != key:
                if begun:
                    yield key, turns
                key, turns, begun = conv, [], True
            turns.append((role or "", text or ""))
    if begun:
        yield key, turns


FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss_start", T.ArrayType(T.IntegerType())),
        T.StructField("loss_stop", T.ArrayType(T.IntegerType())),
    ]
)


_INTS = pa.list_(pa.int32())
_FORMATTED = {"conv_id": pa.int64(), "formatted": pa.string(), "input_ids": _INTS, "loss_start": _INTS, "loss_stop": _INTS}


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Render and encode conversations given as rows (conv_id, turn, role, text).

    Returns a row per conversation: conv_id, formatted, input_ids, and for each
    token the code points [loss_start, loss_stop) of ``formatted`` that count
    in the loss (empty outside assistant texts).

    Rows of a conversation go by turn, then role, then text, nulls first;
    repeated rows are turns of their own. A null role or text counts as empty,
    rows without conv_id form one conversation, other columns are ignored. One
    shuffle by conv_id; a task streams through its sorted rows and holds one
    conversation at a time, as a rendering is encoded whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer).encode
        rows, size = [], 0
        for conv, said in _whole_conversations(batches):
            formatted, spans = render(said)
            coded = encode(formatted, add_special_tokens=False)
            clipped = loss_spans(np.array(coded.offsets, np.int64).reshape(-1, 2), spans).astype(np.int32)
            rows.append((conv, formatted, np.array(coded.ids, np.int32), clipped[:, 0], clipped[:, 1]))
            size += len(formatted)
            if size > 2_000_000:
                yield _batch(rows, _FORMATTED)
                rows, size = [], 0
        if rows:
            yield _batch(rows, _FORMATTED)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(tidy(run, keeps=True), FORMATTED)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_loss_tokens", T.LongType()),
    ]
)


_DIGESTS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_tokens": pa.int64(), "n_loss_tokens": pa.int64()}


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what ``format_conversations`` put out, from its columns alone.

    The turns are parsed from the rendering; the loss text is what the token
    masks cover, unescaped. Neighbouring masked code points belong together, so
    an escape that two tokens share is undone whole.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [_runs(batch.column(c)) for c in ("loss_start", "loss_stop")]
            rows = []
            for conv, text, n_tokens, starts, stops in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), pc.list_value_length(batch.column("input_ids")).to_pylist(), *masks):
                said, loss = parse(text), hashlib.sha256()
                turns = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in said).encode())
                used = stops > starts
                starts, stops = starts[used], stops[used]
                gaps = np.flatnonzero(starts[1:] != stops[:-1])
                n_chars = 0
                if len(starts):
                    for a, b in zip(starts[np.concatenate(([0], gaps + 1))], stops[np.concatenate((gaps, [len(stops) - 1]))]):
                        body = unescape(text[a:b])
                        n_chars += len(body)
                        loss.update(body.encode())
                rows.append((conv, len(said), turns.hexdigest(), n_chars, loss.hexdigest(), len(text), n_tokens, int(used.sum())))
            if rows:
                yield _batch(rows, _DIGESTS)

    return formatted.mapInArrow(tidy(digest, keeps=True), DIGESTS)


def _runs(lists: pa.ListArray) -> list[np.ndarray]:
    """The values of each list."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
