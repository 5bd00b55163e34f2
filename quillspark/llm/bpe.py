"""Byte-pair encoding and decoding with forced boundaries.

Two adjacent bytes that no vocabulary token holds side by side can never be
merged, neither directly nor as part of longer tokens. Such a pair is a certain
cut: the fragments on both sides are encoded independently and their ids
concatenate. Fragments are short and recur, so each is encoded once per worker.

The tokenizer file is a BPE model over byte-level characters with an
end-of-word suffix, normalised by NFC, white space folding and lower case.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .memory import hold, tidy
from .wordstream import WordEncoder, flattened, text_slices

# The white space and the pre-token pattern of this kind of tokenizer.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"


# The public byte-level alphabet.
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    return [c for _, c in sorted((table | {b: chr(256 + i) for i, b in enumerate(hidden)}).items())]


#: Distinct fragments whose ids an encoder remembers; beyond, it starts anew.
CACHE_FRAGMENTS = 100_000


class ForcedBoundaryBPE:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in (vocab | self.special).items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.inner_id = [vocab[c] for c in chars]
        self.final_id = [vocab[c + self.suffix] for c in chars]
        self.together = np.zeros((256, 256), bool)
        for token in vocab:
            raw = [byte_of[c] for c in token.removesuffix(self.suffix)]
            self.together[raw[:-1], raw[1:]] = True
        self._apart = [set(np.flatnonzero(~row)) for row in self.together]
        self._pretokens = regex.compile(_PRETOKEN).findall
        self._folded = regex.compile(rf"[{_SPACE}]+")
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._path, self._byte_of, self._library = path, byte_of, None
        self._fragments: dict[tuple[bytes, bool], list[int]] = {}

    def cuts(self, raw: bytes) -> list[int]:
        """Positions in a pre-token's bytes where a cut is certain."""
        return [i for i in range(1, len(raw)) if raw[i] in self._apart[raw[i - 1]]]

    def _merge(self, raw: bytes, final: bool) -> list[int]:
        """Ids of one fragment: the pair of the lowest rank merges first, leftmost on ties."""
        ids = [self.inner_id[b] for b in raw]
        if final:
            ids[-1] = self.final_id[raw[-1]]
        if len(ids) > 40:
            return self._merge_long(ids)
        find, none = self.merges.get, (len(self.merges), -1)
        ranked = [find(p, none) for p in zip(ids, ids[1:])]
        while ranked:
            best = min(ranked)
            if best is none:
                break
            i = ranked.index(best)
            ids[i : i + 2] = [best[1]]
            del ranked[i]
            if i:
                ranked[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(ranked):
                ranked[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked positions, for fragments of any length."""
        n, find = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := find((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            (_, made), i, left, right = heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (m := find((ids[k], ids[after[k]]))):
                    heappush(heap, (m, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def _pretoken(self, raw: bytes) -> list[int]:
        out: list[int] = []
        start = 0
        for stop in [*self.cuts(raw), len(raw)]:
            key = (raw[start:stop], stop == len(raw))
            ids = self._fragments.get(key)
            if ids is None:
                if len(self._fragments) > CACHE_FRAGMENTS:
                    self._fragments.clear()
                ids = self._fragments[key] = self._merge(*key)
            out += ids
            start = stop
        return out

    def _newer(self, text: str) -> list[bytes]:
        """Pre-tokens of a text with characters that Python's Unicode tables lack: their classes and cases are the library's."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        shown = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._byte_of[c] for c in piece) for piece, _ in shown]

    def _plain(self, text: str) -> list[int]:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [i for raw in self._newer(text) for i in self._pretoken(raw)]
        text = self._folded.sub(" ", unicodedata.normalize("NFC", text))
        # each character by itself: str.lower() looks at the neighbours of a capital sigma
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return [i for p in self._pretokens(text) for i in self._pretoken(p.encode())]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as add_special_tokens=False gives them."""
        if self._specials is None or "<|" not in text:
            return self._plain(text)
        out: list[int] = []
        for part in self._specials.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and the number of each piece's."""
        return flattened([self.encode(p) for p in pieces])

    def decode(self, ids) -> str:
        """Tokens joined by a space: the file names no decoder."""
        return " ".join([self.token_of[i] for i in ids if i in self.token_of])


def _coder(path: str) -> tuple[ForcedBoundaryBPE, WordEncoder, list[bytes]]:
    """Coder, encoder of texts and the bytes of each token; a worker holds them while tasks of these operators follow each other."""
    def make():
        bpe = ForcedBoundaryBPE(path)
        shown = [bpe.token_of.get(i, "").encode() for i in range(max(bpe.token_of) + 1)]
        return bpe, WordEncoder(bpe.encode_pieces), shown

    return hold(("forced-boundary", path), make)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the little-endian unsigned 32-bit ids of each whole text.

    A null or empty text has no ids. Repeated rows stay, each with its result;
    a null id stays null. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, _ = _coder(tokenizer)
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                ids, counts = words.encode(batch.column(1).slice(a, b - a))
                data = ids.astype("<u4", copy=False)
                ends = np.concatenate(([0], np.cumsum(counts))) * 4
                out = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), out.cast(pa.binary())], ["id", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(tidy(run, keeps=True), schema).withColumnRenamed("id", id_col)


def coded_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, decode the ids again, and return the digests of both.

    Columns: the id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers) and decoded_sha256 (of the decoded text in UTF-8). Null
    and empty texts have no tokens and the digests of nothing. One pass over
    the scan, no shuffle; only the text and id columns are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, shown = _coder(tokenizer)
        sha, shown_at = hashlib.sha256, shown.__getitem__
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                ids, counts = words.encode(batch.column(1).slice(a, b - a))
                ids = ids.astype("<u4", copy=False)
                ends = np.cumsum(counts)
                ids_sha, text_sha = [], []
                for start, stop in zip((ends - counts).tolist(), ends.tolist()):
                    own = ids[start:stop]
                    ids_sha.append(sha(own).hexdigest())
                    text_sha.append(sha(b" ".join(map(shown_at, own.tolist()))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )
    return docs.select(id_col, text_col).mapInArrow(tidy(run, keeps=True), schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)``: the decoded text of each row of ``encode_documents``. Null ids decode to ''."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _, _ = _coder(tokenizer)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x, "<u4").tolist()) if x else "" for x in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    schema = T.StructType([T.StructField("id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(id_col, ids_col).mapInArrow(tidy(run, keeps=True), schema).withColumnRenamed("id", id_col)
