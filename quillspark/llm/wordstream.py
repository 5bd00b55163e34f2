"""Batch-wise tokenising of texts through their distinct words and pieces.

Both byte-pair operators work on words cut at ASCII white space, a subset of
what the tokenizer's own pre-tokenizer cuts at, and on pieces cut where letters
meet other characters, so ids of pieces concatenate to ids of texts. Arrow
finds the distinct words of a batch and their distinct pieces; a piece is
encoded once per worker; numpy lays the ids of all occurrences out. Memory is
bounded by ``BATCH_CHARS`` of text at a time (or one text, where that is
longer) and by ``CACHE_PIECES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together until they hold so many bytes.
BATCH_CHARS = 2_500_000
#: Distinct pieces whose ids a Python worker remembers; beyond, it starts anew.
CACHE_PIECES = 300_000

# A word of these characters alone is its own NFC form and holds no contraction
# and no special token, so a letter next to a non-letter is a sure border.
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ!#-&(-;=?-@\[-`{}~]+$"
_PIECE = r"([A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ]+)"


def ragged_take(flat: np.ndarray, first: np.ndarray, n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[first[r] : first[r] + n[r]] for r in rows, end to end, and where each ends."""
    n = n[rows]
    ends = np.cumsum(n)
    at = np.repeat(first[rows] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends


def flattened(coded: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids end to end, and the length of each."""
    n = np.fromiter(map(len, coded), np.int64, len(coded))
    return np.fromiter(chain.from_iterable(coded), np.uint32, int(n.sum())), n


class WordEncoder:
    """Encodes columns of texts; ``encode_pieces`` gives the ids of new pieces, end to end, and how many each has."""

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self._encode = encode_pieces
        self._forget()

    def _forget(self) -> None:
        # an Arrow array, not a dictionary: a few strings kept among many that go would hold on to all their memory
        self._known = pa.array([], pa.large_string())
        self._ids = np.empty(0, np.uint32)
        self._n = np.empty(0, np.int64)
        self._first = np.empty(0, np.int64)

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """Rows of distinct pieces, new ones encoded."""
        rows = pc.index_in(pieces, value_set=self._known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            if len(self._known) + len(missing) > CACHE_PIECES:
                self._forget()
                missing = np.arange(len(pieces))
            new = pieces.take(pa.array(missing))
            rows[missing] = np.arange(len(self._known), len(self._known) + len(new))
            self._known = pa.concat_arrays([self._known, new])
            ids, n = self._encode(new.to_pylist())
            self._first = np.concatenate((self._first, len(self._ids) + np.cumsum(n) - n))
            self._n = np.concatenate((self._n, n))
            self._ids = np.concatenate((self._ids, ids))
        return rows

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and where each word's end."""
        plain = pc.match_substring_regex(words, _PLAIN)
        mixed = pc.and_not(plain, pc.utf8_is_alpha(words))
        text = pc.if_else(plain, pc.utf8_lower(words), words)
        text = pc.replace_with_mask(text, mixed, pc.replace_substring_regex(text.filter(mixed), _PIECE, r"\1 "))
        parts = pc.ascii_split_whitespace(text)
        offsets = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary)
        ids, ends = ragged_take(self._ids, self._first, self._n, rows[coded.indices.to_numpy(zero_copy_only=False)])
        return ids, np.concatenate(([0], ends))[offsets[1:] - offsets[0]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end to end, and the number of ids of each text.

        A null text counts as empty.
        """
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        borders = split.offsets.to_numpy()
        coded = split.values.slice(borders[0], borders[-1] - borders[0]).dictionary_encode()
        flat, word_ends = self._words(coded.dictionary)
        n = np.diff(word_ends, prepend=0)
        ids, ends = ragged_take(flat, word_ends - n, n, coded.indices.to_numpy(zero_copy_only=False))
        return ids, np.diff(np.concatenate(([0], ends))[borders - borders[0]])


def text_slices(texts: pa.Array, limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, a row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop
