"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over the benchmark's words, each
a column of its own, and hashed columns for all other words. A distributed
randomised SVD (a sketch summed over all passages, then the Nystrom step on the
driver) gives the corpus' leading directions. To them come the leading
directions of what the items' own TF-IDF vectors have beside them; together
they span the latent space. Document windows of an item's length are candidates
if their cosine with it in that space reaches a threshold: words that neither
the corpus' topics nor any item has weigh nothing there, so a window with other
words for some of an item's stays near it. Items of few words are looked up by
their rarest words instead. A longest common subsequence, and a check for the
item's answer where that is not clear, decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy
from .scratch import Scratch
from .wordstream import ragged_take, text_slices


@dataclass(frozen=True)
class Decontamination:
    """Parameters of the search and of the decision."""

    hashed: int = 8192  #: columns for words that the benchmark does not have
    passage: int = 32  #: words in a passage of the decomposition
    rank: int = 20  #: leading directions of the corpus
    item_rank: int = 256  #: leading directions of a block's items beside those
    step: int = 8  #: words of a cell; windows are runs of cells that overlap by half at least
    cosine: float = 0.6  #: cosine of a candidate window with its item in the latent space at least
    surely: float = 0.8  #: share of an item's words in the common subsequence that settles it
    perhaps: float = 0.6  #: share that settles it where the answer is there too
    answer_words: int = 8  #: the answer is an item's last sentence, or so many last words of it
    answer_share: float = 0.8  #: share of the answer's words that must be there in order
    short: int = 16  #: items of so many words at most (16 or fewer) are looked up by their rarest words
    block_items: int = 512  #: items searched for in one pass
    reducers: int = 8  #: partial sums are combined to so many before the driver


#: Words that are turned into dense rows at a time, of the search and of the sketch.
SLICE_WORDS, PASS_WORDS = 32_768, 262_144
#: The largest entry of the stored directions: eight of them add up within 16 bits.
QUANTA = 4_000
#: Occurrences of short items' words that are looked around at a time.
LOOKUPS = 8_192

_sentences = re.compile(r"[.!?。؟]+\s*")


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts, all texts as indexes into them, their number per text.

    Words are lower-cased runs of letters and digits. Returned are the words,
    the index of each word of all texts end to end, and the count per text.
    """
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    borders = split.offsets.to_numpy()
    coded = split.values.slice(borders[0], borders[-1] - borders[0]).dictionary_encode()
    cleaned = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}\p{N}]+", " ")
    parts = pc.ascii_split_whitespace(cleaned)
    words, offsets = parts.flatten(), parts.offsets.to_numpy()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    upto = np.concatenate(([0], np.cumsum(full)))
    words, offsets = words.filter(pa.array(full)), upto[offsets - offsets[0]]
    chosen = coded.indices.to_numpy(zero_copy_only=False)
    index, ends = ragged_take(np.arange(len(words)), offsets[:-1], np.diff(offsets), chosen)
    return words, index, np.diff(np.concatenate(([0], ends))[borders - borders[0]])


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    words, index, _ = word_lists(pa.array([text]))
    return words.take(pa.array(index)).to_pylist()


def answer_of(text: str, n: int) -> list[str]:
    """Last words, n at most, of the last sentence that has three; of the whole text if none has."""
    for sentence in reversed(_sentences.split(text)):
        words = words_of(sentence)
        if len(words) >= 3:
            return words[-n:]
    return words_of(text)[-n:]


class Columns:
    """The column of each word: one of its own for benchmark words, a hashed one for others."""

    def __init__(self, words: list[str], hashed: int):
        self.own = pa.array(words, pa.large_string())
        self.hashed = hashed
        self.width = len(words) + hashed
        self.stored = "<u2" if self.width <= 1 << 16 else "<u4"

    def of(self, words: pa.Array) -> np.ndarray:
        """Columns of an array of words."""
        words = words.cast(pa.large_string())
        at = pc.index_in(words, value_set=self.own).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        sizes = np.diff(offsets)
        if offsets[-1] > offsets[0]:
            data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32)
            place = np.arange(len(data), dtype=np.uint32) - np.repeat((offsets[:-1] - offsets[0]).astype(np.uint32), sizes)
            mixed = (data + np.uint32(1)) * (place * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA77))
            mixed ^= mixed >> np.uint32(15)
            upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
            spread = (upto[offsets[1:] - offsets[0]] - upto[offsets[:-1] - offsets[0]]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
            at = np.where(at >= 0, at, len(self.own) + (spread % np.uint64(self.hashed)).astype(np.int64))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Columns of all words of the texts, end to end, and their number per text."""
        words, index, counts = word_lists(texts)
        return self.of(words)[index] if len(words) else index, counts

    def of_text(self, words: list[str]) -> list[int]:
        return self.of(pa.array(words, pa.string())).tolist()


def passage_rows(counts: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The passage of each word of documents with so many words, and how many passages there are."""
    starts = np.cumsum(counts) - counts
    per_doc = -(-counts // size)
    inside = np.arange(int(counts.sum())) - np.repeat(starts, counts)
    return np.repeat(np.cumsum(per_doc) - per_doc, counts) + inside // size, int(per_doc.sum())


def _staged(tokens: Columns, size: int):
    """(kind 0, id, columns) of each document, then (kind 1, null, passages per column, and their number last)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(tokens.width + 1, np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                columns, counts = tokens.encode(batch.column(1).slice(a, b - a))
                rows, total = passage_rows(counts, size)
                keys = rows * tokens.width + columns
                keys = np.sort(keys.astype(np.uint32) if total * tokens.width < 1 << 32 else keys)
                frequency[:-1] += np.bincount(keys[np.flatnonzero(np.diff(keys, prepend=keys[:1] + 1))] % tokens.width, minlength=tokens.width)
                frequency[-1] += total
                stored = columns.astype(tokens.stored)
                ends = np.concatenate(([0], np.cumsum(counts))) * stored.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(stored)])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int32)), batch.column(0).slice(a, b - a), data.cast(pa.binary())], ["kind", "id", "data"])
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([frequency.astype("<i8").tobytes()], pa.binary())], ["kind", "id", "data"])

    return run


def _summed(df: DataFrame, kind: str, size: int, reducers: int) -> np.ndarray:
    """The sum of the arrays in the one binary column, combined on executors first; zeros of no rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(0):
                values = np.frombuffer(part.as_buffer(), kind)
                total = values.astype(np.float64 if "f" in kind else np.int64) if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], ["data"])

    parts = [np.frombuffer(r[0], kind) for r in df.repartition(reducers).mapInArrow(add, "data binary").collect()]
    return np.sum([np.zeros(size, kind), *parts], axis=0, dtype=np.float64 if "f" in kind else np.int64)


def sums_of_rows(table: np.ndarray, columns: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """Sums of the table's rows at ``columns``, grouped by ``rows``: ascending, none with more than ``size``. The table's last row is zero."""
    firsts = np.searchsorted(rows, np.arange(n_rows))
    index = np.full((size, n_rows), len(table) - 1, np.int64)
    index[np.arange(len(rows)) - firsts[rows], rows] = columns
    out = table[index[0]]
    part = np.empty_like(out)
    for own in index[1:]:
        out += np.take(table, own, axis=0, out=part, mode="clip")
    return out


def padded(table: np.ndarray) -> np.ndarray:
    """The table with a row of zeros at its end."""
    return np.concatenate((table, np.zeros_like(table[:1])))


def _gram_times(shared, size: int, tokens_stored: str):
    """One row: the task's part of A^T A Q, A being the TF-IDF matrix of all passages.

    A passage's row is scaled by the root of its words' summed squared idf.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weighted = shared.value
        total = np.zeros((len(idf), weighted.shape[1]), np.float32)
        for batch in batches:
            for counts, columns in _slices(batch.column(0), tokens_stored, PASS_WORDS):
                rows, n_rows = passage_rows(counts, size)
                scale = 1 / np.maximum(1e-12, np.bincount(rows, idf[columns] ** 2, n_rows))
                sketch = sums_of_rows(weighted, columns, rows, n_rows, size) * scale[:, None].astype(np.float32)
                for d in range(weighted.shape[1]):
                    total[:, d] += np.bincount(columns, np.ascontiguousarray(sketch[:, d])[rows], len(total))
        yield pa.RecordBatch.from_arrays([pa.array([(total * idf[:, None]).astype("<f4").tobytes()], pa.binary())], ["data"])

    return run


def _joined(data: pa.Array, stored: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of columns per document, and all columns end to end."""
    parts = data.fill_null(b"").to_pylist()
    counts = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(stored).itemsize
    return counts, np.frombuffer(b"".join(parts), stored)


def _slices(data: pa.Array, stored: str, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_joined`` of about so many words at a time, without empty slices."""
    for a, b in text_slices(data, words * np.dtype(stored).itemsize):
        counts, columns = _joined(data.slice(a, b - a), stored)
        if len(columns):
            yield counts, columns


def leading_directions(gram: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Right singular directions of A from G = A^T A S and S, strongest first (the Nystrom step)."""
    shift = 1e-6 * np.linalg.norm(gram)
    gram = gram + shift * sketch
    inner = sketch.T @ gram
    strength, turn = np.linalg.eigh((inner + inner.T) / 2)
    keep = strength > 1e-12 * max(strength.max(), 1e-300)
    if not keep.any():  # no passages
        return np.zeros((len(gram), 0), np.float32)
    left, _, _ = np.linalg.svd(gram @ (turn[:, keep] / np.sqrt(strength[keep])), full_matrices=False)
    return left.astype(np.float32)


class Pattern:
    """Words that are looked for in order; ``bits`` has, for each, the places where it stands."""

    def __init__(self, words: list[int]):
        self.words, self.size = words, len(words)
        self.bits: dict[int, int] = {}
        for i, w in enumerate(words):
            self.bits[w] = self.bits.get(w, 0) | 1 << i

    def common(self, text: list[int]) -> int:
        """Length of the longest common subsequence, by bit-parallel dynamic programming."""
        full = row = (1 << self.size) - 1
        for hit in filter(None, map(self.bits.get, text)):
            matched = row & hit
            row = ((row + matched) | (row - matched)) & full
        return self.size - row.bit_count()


@dataclass(frozen=True)
class Group:
    """Items that are compared with windows of one length."""

    span: int  #: window length in steps
    items: np.ndarray


@dataclass(frozen=True)
class Short:
    """Short items, found by words of which every match that can pass ``verify`` holds one."""

    items: np.ndarray
    least: np.ndarray  #: words of each that must be there
    first: np.ndarray  #: [column]: where the column's places in ``by_column`` begin
    many: np.ndarray  #: [column]: how many there are
    by_column: np.ndarray  #: places in ``items`` that the column's word leads to
    masks: np.ndarray  #: [item, column]: bits of the places where the item has the word
    scores: np.ndarray  #: [item, column]: what a word adds to the inner product with the item


@dataclass(frozen=True)
class Items:
    """Prepared items of a block."""

    ids: list
    words: list[Pattern]
    answers: list[Pattern]
    groups: list[Group]  #: by window length, ascending
    idf2: np.ndarray
    directions: np.ndarray  #: [column, direction] of 16 bits, in units of ``quantum``: times idf, those of the corpus first; zeros last
    quantum: float
    screen: np.ndarray  #: [column, ...] of 16 bits: the corpus directions, then what a word adds to the inner product with each grouped item, in units of ``quantum``
    corpus: int  #: how many directions are the corpus'
    latent: np.ndarray  #: [item, direction], rows of length one
    short: Short | None = None  #: items that are not in ``groups``


def stretch(words: int) -> int:
    """Words of a text among which an item of so many words has its common subsequence."""
    return words + words // 2 + 2


def _short_items(mine: np.ndarray, words: list[list[int]], idf: np.ndarray, scores: np.ndarray, settings: Decontamination) -> Short | None:
    """Lookups of the items at ``mine``.

    A match has ``least`` of an item's n words at least, so that of any
    n - least + 1 of them it has one: the rarest lead to the item.
    """
    if not len(mine):
        return None
    share = min(settings.surely, settings.perhaps)
    least = np.array([next(m for m in range(1, len(words[k]) + 1) if m / len(words[k]) >= share) for k in mine.tolist()])
    masks = np.zeros((len(mine), len(idf)), np.uint16)
    leads = set()
    for place, (k, need) in enumerate(zip(mine.tolist(), least.tolist())):
        for bit, column in enumerate(words[k]):
            masks[place, column] |= np.uint16(1 << bit)
        leads |= {(column, place) for column in sorted(words[k], key=lambda c: (-idf[c], c))[: len(words[k]) - need + 1]}
    columns, places = np.array(sorted(leads)).T
    many = np.bincount(columns, minlength=len(idf))
    return Short(mine, least, np.cumsum(many) - many, many, places, masks, scores.astype(np.float32))


def latent_space(rows: list[tuple[np.ndarray, np.ndarray]], corpus: np.ndarray, item_rank: int) -> np.ndarray:
    """Orthonormal directions [column, direction]: the corpus', then the leading ones of the rows' parts outside them.

    Rows are sparse (columns, values). The latter come from the eigenvectors of
    the rows' Gram matrix, so nothing of rows times columns is made.
    """
    shares = np.stack([values @ corpus[columns] for columns, values in rows])
    gram = -(shares @ shares.T)
    by_column: dict[int, list[tuple[int, float]]] = {}
    for k, (columns, values) in enumerate(rows):
        for c, v in zip(columns.tolist(), values.tolist()):
            by_column.setdefault(c, []).append((k, v))
    for met in by_column.values():
        at, values = np.array([k for k, _ in met]), np.array([v for _, v in met])
        gram[np.ix_(at, at)] += np.outer(values, values)
    strength, turn = np.linalg.eigh(gram)
    keep = np.flatnonzero(strength > 1e-6 * max(1e-300, strength.max()))[::-1][:item_rank]
    turn = turn[:, keep] / np.sqrt(strength[keep])
    own = -(corpus @ (shares.T @ turn))
    for k, (columns, values) in enumerate(rows):
        own[columns] += np.outer(values, turn[k])
    return np.hstack((corpus, own)).astype(np.float32)


def prepare(items: list[tuple[object, str]], tokens: Columns, idf: np.ndarray, corpus: np.ndarray, settings: Decontamination) -> Items:
    """Tables for a block of items."""
    words = [tokens.of_text(words_of(t)) for _, t in items]
    answers = [tokens.of_text(answer_of(t, settings.answer_words)) for _, t in items]
    rows = []
    for own in words:
        columns, many = np.unique(own, return_counts=True)
        values = many * idf[columns]
        rows.append((columns, values / np.linalg.norm(values)))
    space = latent_space(rows, corpus, settings.item_rank)
    latent = np.stack([values @ space[columns] for columns, values in rows])
    latent /= np.maximum(1e-12, np.linalg.norm(latent, axis=1, keepdims=True))
    directions = space * idf[:, None]
    quantum = float(np.abs(directions).max() / QUANTA) or 1.0
    sizes = np.array([len(w) for w in words])
    brief = sizes <= min(16, settings.short)
    lengths = np.where(brief, 0, np.maximum(1, np.rint(sizes / settings.step).astype(int)))
    groups = [Group(n, np.flatnonzero(lengths == n)) for n in np.unique(lengths[~brief]).tolist()]
    grouped = np.concatenate([g.items for g in groups]) if groups else np.empty(0, np.int64)
    screen = np.empty((tokens.width, corpus.shape[1] + len(grouped)), np.int16)
    screen[:, : corpus.shape[1]] = np.rint(directions[:, : corpus.shape[1]] / quantum)
    for at in range(0, tokens.width, 8192):
        screen[at : at + 8192, corpus.shape[1] :] = np.clip(np.rint(directions[at : at + 8192] @ latent[grouped].T / quantum), -QUANTA, QUANTA)
    mine = np.flatnonzero(brief)
    scores = np.zeros((len(mine), tokens.width), np.float32)
    for place, k in enumerate(mine.tolist()):
        columns, values = rows[k]
        scores[place, columns] = values * idf[columns]
    short = _short_items(mine, words, idf, scores, settings)
    return Items(
        [i for i, _ in items], [Pattern(w) for w in words], [Pattern(w) for w in answers], groups, (idf * idf).astype(np.float32),
        padded(np.rint(directions / quantum).astype(np.int16)), quantum, padded(screen), corpus.shape[1], latent.astype(np.float32), short,
    )


def _candidates(items: Items, columns: np.ndarray, counts: np.ndarray, settings: Decontamination) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, item, first word, last word, cosine) of windows at or over the threshold, in a slice of documents.

    Only windows whose bound reaches the threshold are projected whole.
    """
    if not items.groups:
        return
    step = settings.step
    # a run of one word repeated counts once, else it outweighs its window
    doc = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(columns), bool)
    new[1:] = (columns[1:] != columns[:-1]) | (doc[1:] != doc[:-1])
    place = np.flatnonzero(new)
    columns, doc = columns[place], doc[place]
    kept = np.bincount(doc, minlength=len(counts))
    starts = np.cumsum(kept) - kept
    cells = -(-kept // step)
    first_cell = np.cumsum(cells) - cells
    cell = first_cell[doc] + (np.arange(len(columns)) - starts[doc]) // step
    bounds = np.flatnonzero(np.diff(cell, prepend=-1))
    edges = np.append(bounds, len(columns))
    cell_doc = doc[bounds]
    stop = (first_cell + cells)[cell_doc]
    within = np.arange(len(bounds)) - first_cell[cell_doc]
    sums = sums_of_rows(items.screen, columns, cell, len(bounds), step)
    upto = np.zeros((len(bounds) + 1, sums.shape[1]), np.int32)
    np.cumsum(sums, axis=0, out=upto[1:])
    topics, first = upto[:, : items.corpus].astype(np.float32), items.corpus
    found = []
    for group in items.groups:
        # windows overlap by half at least, from each document's first cell on
        begin = np.flatnonzero(within % max(1, group.span // 2) == 0)
        end = np.minimum(begin + group.span, stop[begin])
        inner = upto[:, first : first + len(group.items)]
        first += len(group.items)
        inner = inner[end] - inner[begin]
        # a window weighs no less than its part among the corpus' directions: most are settled by that
        least = np.linalg.norm(topics[end] - topics[begin], axis=1)
        windows, picked = np.divmod(np.flatnonzero(inner >= np.maximum(1, settings.cosine * least)[:, None].astype(np.int32)), inner.shape[1])
        found.append((begin[windows], group.items[picked], end[windows], inner[windows, picked]))
    windows, picked, end, inner = (np.concatenate(x) for x in zip(*found))
    if not len(windows):
        return
    # the rest are weighed in the whole space, by the cells they have
    needed = np.zeros(len(bounds) + 1, np.int64)
    np.add.at(needed, windows, 1)
    np.add.at(needed, end, -1)
    needed = np.flatnonzero(np.cumsum(needed[:-1]))
    order = np.full(len(bounds), -1)
    order[needed] = np.arange(len(needed))
    chosen = np.flatnonzero(order[cell] >= 0)
    whole = np.zeros((len(needed) + 1, items.directions.shape[1]), np.int32)
    np.cumsum(sums_of_rows(items.directions, columns[chosen], order[cell[chosen]], len(needed), step), axis=0, out=whole[1:])
    spans, at = np.unique(order[windows] * (len(needed) + 1) + order[end - 1] + 1, return_inverse=True)
    from_, to = np.divmod(spans, len(needed) + 1)
    weight = np.linalg.norm((whole[to] - whole[from_]).astype(np.float32), axis=1)
    cosines = inner / np.maximum(1e-12, weight)[at]
    for i in np.flatnonzero(cosines >= settings.cosine).tolist():
        w = int(windows[i])
        yield int(cell_doc[w]), int(picked[i]), int(place[bounds[w]]), int(place[edges[end[i]] - 1]), float(cosines[i])


def _short_candidates(items: Items, columns: np.ndarray, counts: np.ndarray, settings: Decontamination) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, item, first word, last word, cosine) about words that lead to short items and have enough of the item around.

    Of the windows of the item's own length that hold the word, that with the
    largest cosine over the item's words is given, with its cosine in the latent
    space. None that ``verify`` accepts is left out.
    """
    short = items.short
    if short is None:
        return
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    hits = np.flatnonzero(short.many[columns])
    lookups = short.many[columns[hits]]
    upto = np.cumsum(lookups)
    start = 0
    while start < len(hits):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + LOOKUPS, "right")))
        at = np.repeat(hits[start:stop], lookups[start:stop])
        places, _ = ragged_take(short.by_column, short.first, short.many, columns[hits[start:stop]])
        start = stop
        sizes = np.array([items.words[k].size for k in short.items.tolist()])[places]
        for size in np.unique(sizes).tolist():
            chosen = np.flatnonzero(sizes == size)
            where, place = at[chosen], places[chosen]
            lo, hi = ends[doc[where]] - counts[doc[where]], ends[doc[where]]
            around = where[:, None] + np.arange(1 - stretch(size), stretch(size))
            inside = (around >= lo[:, None]) & (around < hi[:, None])
            there = short.masks[place[:, None], columns[np.clip(around, 0, len(columns) - 1)]] * inside
            enough = np.flatnonzero(np.bitwise_count(np.bitwise_or.reduce(there, axis=1)) >= short.least[place])
            if not len(enough):
                continue
            where, place, lo, hi = where[enough], place[enough], lo[enough], hi[enough]
            # windows of the item's length: their first words, then their words; those outside the document add nothing
            firsts = where[:, None] + np.arange(1 - size, 1)
            around = firsts[:, :, None] + np.arange(size)
            inside = (around >= lo[:, None, None]) & (around < hi[:, None, None])
            own = columns[np.clip(around, 0, len(columns) - 1)]
            weight = np.sqrt(np.maximum((items.idf2[own] * inside).sum(axis=2), 1e-12))
            cosines = (short.scores[place[:, None, None], own] * inside).sum(axis=2) / weight
            # the first of the best, so that the windows of one copy agree
            best = cosines.argmax(axis=1)
            rows = np.arange(len(best))
            directions = (items.directions[own[rows, best]] * inside[rows, best][:, :, None]).sum(axis=1, dtype=np.float32)
            item = short.items[place]
            total = (directions * items.latent[item]).sum(axis=1) / np.maximum(1e-12, np.linalg.norm(directions, axis=1))
            first = np.maximum(firsts[rows, best], lo)
            last = np.minimum(firsts[rows, best] + size, hi) - 1
            yield from zip(doc[where].tolist(), item.tolist(), first.tolist(), last.tolist(), total.tolist())


def verify(item: Pattern, answer: Pattern, text: list[int], settings: Decontamination) -> tuple[bool, float, bool]:
    """(contaminated, share of the item in the common subsequence, whether the answer is there)."""
    share = item.common(text) / item.size
    answered = answer.size > 0 and answer.common(text) >= settings.answer_share * answer.size
    return share >= settings.surely or (share >= settings.perhaps and answered), share, answered


def _search(shared, settings: Decontamination, id_type: pa.DataType, stored: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            found: dict[tuple[int, object], tuple] = {}
            for a, b in text_slices(batch.column(1), SLICE_WORDS * np.dtype(stored).itemsize):
                counts, columns = _joined(batch.column(1).slice(a, b - a), stored)
                if not len(columns):
                    continue
                ends = np.cumsum(counts)
                spans: dict[tuple[int, int], list[list]] = {}
                for doc, k, first, last, cosine in sorted({*_candidates(items, columns, counts, settings), *_short_candidates(items, columns, counts, settings)}):
                    runs = spans.setdefault((doc, k), [])
                    if runs and first <= runs[-1][1] + 1:
                        runs[-1][1] = max(runs[-1][1], last)
                        runs[-1][2] = max(runs[-1][2], cosine)
                    else:
                        runs.append([first, last, cosine])
                for (doc, k), runs in spans.items():
                    lo, hi = int(ends[doc] - counts[doc]), int(ends[doc])
                    item = items.words[k]
                    margin = stretch(item.size) if item.size <= settings.short else item.size
                    for first, last, cosine in runs:
                        # the item may begin before the window and end after it
                        start = max(lo, first - margin)
                        text = columns[start : min(hi, last + 1 + margin)].tolist()
                        sure, share, answered = _densest(item, items.answers[k], text, settings)
                        if sure:
                            row = (share, cosine, answered, first - lo)
                            found[(a + doc, k)] = max(found.get((a + doc, k), row), row)
            keys = sorted(found)
            rows = [found[key] for key in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([d for d, _ in keys], pa.int64())),
                    pa.array([items.ids[k] for _, k in keys], id_type),
                    pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.bool_()),
                    pa.array([r[3] for r in rows], pa.int64()),
                ],
                ["id", "item_id", "cosine", "lcs_share", "answer_found", "first_word"],
            )

    return run


def _densest(item: Pattern, answer: Pattern, text: list[int], settings: Decontamination) -> tuple[bool, float, bool]:
    """``verify`` of the stretch of the text, half as long again as the item, that has the largest share.

    Stretches begin at every word for short items, else at every quarter of the item.
    """
    size = stretch(item.size)
    if len(text) <= size:
        return verify(item, answer, text, settings)
    if item.common(text) < settings.perhaps * item.size:
        return False, 0.0, False
    step = 1 if item.size <= settings.short else item.size // 4
    return max(verify(item, answer, text[i : i + size], settings) for i in range(0, len(text) - size + step, step))


def contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, settings: Decontamination = Decontamination()) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found, first_word) of documents that hold a benchmark item.

    One row per pair of a document row and an item. Null or wordless texts and
    items match nothing; repeated rows each get their rows; a null doc_id or
    item_id stays null. An empty table gives no rows. Columns other than ids
    and texts are not read.

    Document frequencies and the decomposition are sums over all passages of
    all documents, combined on executors before the driver gets a few arrays
    of bounded size. Items are the query set: they go through all documents in
    blocks of ``block_items``, each pass reading the columns of the words as
    staged once. Documents never meet each other, so nothing can be skewed.
    """
    spark = docs.sparkSession
    items = [(r[0], r[1]) for r in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator() if words_of(r[1])]
    schema = f"id long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, cosine double, lcs_share double, answer_found boolean, first_word long"
    if not items:
        return spark.createDataFrame([], schema).withColumnRenamed("id", "doc_id")
    tokens = Columns(sorted({w for _, t in items for w in words_of(t)}), settings.hashed)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    staged = scratch.table(texts.mapInArrow(tidy(_staged(tokens, settings.passage)), "kind int, id long, data binary"), "columns")
    frequency = _summed(staged.filter("kind = 1").select("data"), "<i8", tokens.width + 1, settings.reducers)
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    words = staged.filter("kind = 0").select("id", "data")

    sketch = np.random.default_rng(11).standard_normal((tokens.width, settings.rank))
    shared = spark.sparkContext.broadcast((idf.astype(np.float32), padded((sketch * idf[:, None]).astype(np.float32))))
    gram = _summed(words.select("data").mapInArrow(tidy(_gram_times(shared, settings.passage, tokens.stored)), "data binary"), "<f4", tokens.width * settings.rank, settings.reducers)
    leading = leading_directions(gram.reshape(tokens.width, -1), sketch)

    found = None
    kind = pa.int64() if benchmark.schema["item_id"].dataType.simpleString() == "bigint" else None
    for at in range(0, len(items), settings.block_items):
        block = spark.sparkContext.broadcast(prepare(items[at : at + settings.block_items], tokens, idf, leading, settings))
        part = words.mapInArrow(tidy(_search(block, settings, kind, tokens.stored)), schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", "doc_id")
