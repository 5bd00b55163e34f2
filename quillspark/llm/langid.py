"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams weighted by TF-IDF. Document frequencies
cover all labelled training rows; every labelled language is learned. The
regression is fitted on a sample, of bounded rows a language, by
follow-the-regularised-leader with an elastic-net penalty, and a temperature
fitted on rows kept apart calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .memory import tidy
from .scratch import Scratch
from .wordstream import text_slices

UNKNOWN = "und"
BITS = 16
ORDERS = (1, 2, 3)
#: Scale of term frequencies, which sum to it in a document.
SCALE = 30.0


@dataclass(frozen=True)
class Training:
    """Bounds and penalties of the fit."""

    per_language: int = 500  #: labelled rows of a language in the sample at most
    full_languages: int = 64  #: beyond so many languages, a language has fewer rows in the sample
    least_rows: int = 50  #: but so many (or all it has)
    epochs: int = 4
    alpha: float = 0.5  #: learning rate
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.002
    calibration: int = 5  #: every so many sample rows are kept apart for the temperature
    reducers: int = 32  #: partial document frequencies are summed to so many before the driver

    def rows_of(self, languages: int) -> int:
        """Rows of a language in the sample: a step of the fit costs time by languages, as does the sample's size."""
        return min(self.per_language, max(self.least_rows, self.per_language * self.full_languages**2 // languages**2))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  #: [feature, language]: weight times idf times SCALE
    bias: np.ndarray
    temperature: float


def _alphabet() -> np.ndarray:
    """Which of the code points below 2**16 are letters."""
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)), bool, 1 << 16)


_letters: np.ndarray | None = None


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per order, the hashed n-grams at all positions; the border of each text; letters per text.

    Texts are lower-cased; a run of anything but letters counts as one space,
    and each text begins and ends with one. Position i belongs to text t if
    borders[t] <= i < borders[t + 1]; n-grams that reach into the next text
    are given feature -1.
    """
    global _letters
    if _letters is None:
        _letters = _alphabet()
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    borders = np.concatenate(([0], np.cumsum(lengths)))
    letter = _letters[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        letter[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[borders[:-1]] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    n_letters = np.add.reduceat(letter, borders[:-1], dtype=np.int64) if len(texts) else np.empty(0, np.int64)
    codes = np.where(letter, codes, np.uint32(32))[keep]
    borders = upto[borders]
    out = []
    mixed = np.zeros(len(codes), np.uint32)
    for order in ORDERS:
        n = len(codes) - order + 1
        mixed = (mixed[: max(n, 0)] + codes[order - 1 :]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        features = np.full(len(codes), -1, np.int32)
        features[: len(mixed)] = ((mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int32)
        for back in range(1, order):
            features[borders[1:] - back] = -1
        out.append(features)
    return out, borders, n_letters


def _text_list(column: pa.Array, a: int, b: int) -> list[str]:
    return column.slice(a, b - a).fill_null("").to_pylist()


SPARSE = "lang string, mark long, features binary, counts binary"


def _gather_statistics(per_language: int):
    """Sparse counts of the task's sampled rows, then one row with its document frequencies.

    Of a language's sampled rows a task keeps those with the smallest marks, a
    hash of the counts, as many as the whole sample has of it: copies of one
    row, however many there are, have one mark and are as good as each other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        frequency = np.zeros(1 << BITS, np.int64)
        kept: dict[str, list[tuple[int, bytes, bytes]]] = {}
        for batch in batches:
            langs, sampled = batch.column(0), batch.column(2).to_pylist()
            for a, b in text_slices(batch.column(1)):
                orders, borders, _ = ngrams(_text_list(batch.column(1), a, b))
                for t, (lo, hi) in enumerate(zip(borders, borders[1:])):
                    own = np.concatenate([f[lo:hi] for f in orders])
                    counts = np.bincount(own[own >= 0], minlength=1 << BITS)
                    present = np.flatnonzero(counts)
                    frequency[present] += 1
                    if sampled[a + t]:
                        row = (present.astype("<u4").tobytes(), counts[present].astype("<u4").tobytes())
                        mark = xxhash.xxh64_intdigest(row[0] + row[1]) - (1 << 63)
                        mine = kept.setdefault(langs[a + t].as_py(), [])
                        mine.append((mark, *row))
                        if len(mine) >= 2 * per_language:
                            mine.sort()
                            del mine[per_language:]
        names = ["lang", "mark", "features", "counts"]
        for lang, mine in kept.items():
            marks, features, counts = zip(*sorted(mine)[:per_language])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(marks)), pa.array(marks, pa.int64()), pa.array(features, pa.binary()), pa.array(counts, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([frequency.astype("<i8").tobytes()], pa.binary()), pa.array([b""], pa.binary())], names)

    return run


def _sum_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for part in batch.column(0):
            total += np.frombuffer(part.as_buffer(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], ["features"])


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], n_languages: int, n_features: int, settings: Training) -> tuple[np.ndarray, np.ndarray]:
    """Weights [feature, language] and bias by FTRL-proximal over sparse rows (language, features, values)."""
    z, n = np.zeros((n_features + 1, n_languages)), np.zeros((n_features + 1, n_languages))
    order = np.random.default_rng(7)

    def weights(at) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= settings.l1, 0.0, -(own - np.sign(own) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2))

    for _ in range(settings.epochs):
        for r in order.permutation(len(rows)):
            language, features, values = rows[r]
            at = np.append(features, n_features)
            x = np.append(values, 1.0)[:, None]
            w = weights(at)
            logits = (x * w).sum(axis=0)
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[language] -= 1.0
            g = x * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha * w
            n[at] += g * g
    w = np.empty_like(z)
    for start in range(0, len(w), 4096):
        w[start : start + 4096] = weights(slice(start, start + 4096))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its logarithm."""
    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        scaled -= scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(truth)), truth]).mean())

    if not len(truth):
        return 1.0
    lo, hi, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(labelled: DataFrame, scratch: Scratch, settings: Training = Training()) -> Model | None:
    """Fit a model to rows (id, lang, text); None if no row has a language and a text.

    Document frequencies are of all these rows, in one pass that also gathers
    the sparse counts of the sample: about twice ``Training.rows_of`` rows of each
    language by a hash of id and text, and the rows with its smallest hash
    whatever the share, so that no language goes unlearned; then the first so
    many of them. Repeated rows are rows like any others. A language's fifth,
    tenth, ... row is kept apart, so that one of few rows has all of them in the
    fit. The driver's memory and a step's time grow with the number of languages.
    """
    rows = labelled.filter("lang is not null and text is not null")
    spread = F.xxhash64(F.col("id").cast("string"), "text").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(spread).alias("least")).orderBy("lang").collect()
    if not sizes:
        return None
    per_language = settings.rows_of(len(sizes))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], max(r["least"], min(1.0, 2.0 * per_language / r["n"])))))[F.col("lang")]
    gathered = scratch.table(rows.select("lang", "text", (spread <= share).alias("sampled")).mapInArrow(tidy(_gather_statistics(per_language)), SPARSE), "statistics")

    frequency = np.zeros(1 << BITS, np.int64)
    for r in gathered.filter("lang is null").select("features").repartition(settings.reducers).mapInArrow(_sum_frequencies, "features binary").collect():
        frequency += np.frombuffer(r["features"], "<i8")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "features", "counts"))
    sample = gathered.filter("lang is not null").withColumn("place", place).filter(F.col("place") <= per_language).orderBy("lang", "place").collect()

    languages = tuple(sorted({r["lang"] for r in sample}))
    idf = np.log((1 + sum(r["n"] for r in sizes)) / (1 + frequency)) + 1
    number = {lang: k for k, lang in enumerate(languages)}
    examples, apart = [], []
    for r in sample:
        features, counts = np.frombuffer(r["features"], "<u4"), np.frombuffer(r["counts"], "<u4")
        example = (number[r["lang"]], features, SCALE * counts / max(1, counts.sum()) * idf[features])
        (examples if r["place"] % settings.calibration else apart).append(example)
    weights, bias = fit_ftrl(examples, len(languages), 1 << BITS, settings)
    logits = np.array([(x[:, None] * weights[f]).sum(axis=0) + bias for _, f, x in apart]).reshape(-1, len(languages))
    temperature = fit_temperature(logits, np.array([k for k, _, _ in apart], np.int64))
    return Model(languages, (weights * idf[:, None] * SCALE).astype(np.float32), bias, temperature)


#: Languages scored at a time.
SCORED_LANGUAGES = 32


def score_texts(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the index of the likeliest language, its calibrated probability, and the number of letters."""
    orders, borders, letters = ngrams(texts)
    total = np.zeros((len(texts), len(model.languages)))
    seen = np.zeros(len(texts))
    for a in range(0, len(model.languages), SCORED_LANGUAGES):
        some = slice(a, a + SCORED_LANGUAGES)
        padded = np.vstack((model.table[:, some], np.zeros_like(model.table[:1, some])))
        for features in orders:
            total[:, some] += np.add.reduceat(padded[features], borders[:-1], axis=0, dtype=np.float64)
    for features in orders:
        seen += np.add.reduceat(features >= 0, borders[:-1], dtype=np.int64)
    logits = (total / np.maximum(seen, 1)[:, None] + model.bias) / model.temperature
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    return p.argmax(axis=1), p.max(axis=1), letters


#: Characters scored at a time: their features stay in the processor's cache.
SCORED_CHARS = 400_000


def predict(docs: DataFrame, model: Model | None, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' id and ``keep`` columns with lang_pred and score, from the text column alone.

    Null texts and texts without a letter get ``und`` with score 0, as does
    every text if there is no model.
    """
    columns = [id_col, *keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(at_text).fill_null("").to_pylist()
            langs, scores = [], []
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= SCORED_CHARS):
                    size += len(texts[stop])
                    stop += 1
                if known is None:
                    langs += [UNKNOWN] * (stop - start)
                    scores += [0.0] * (stop - start)
                else:
                    best, p, letters = score_texts(known, texts[start:stop])
                    langs += [known.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), letters.tolist())]
                    scores += np.where(letters > 0, p, 0.0).tolist()
                start = stop
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    source = docs.select(*columns, *(() if "text" in columns else ("text",)))
    at_text = source.columns.index("text")
    schema = T.StructType([*source.schema.fields[: len(columns)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(tidy(run), schema)


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def identify_languages(docs: DataFrame, scratch: Scratch, settings: Training = Training()) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document (doc_id, text, lang).

    The model learns only from rows that are not held out and have a language
    and a text. Null or letterless texts get ``und`` and score 0; without any
    labelled row all do. Repeated rows stay; other columns are not read.
    """
    labelled = docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "lang", "text")
    model = train(labelled, scratch, settings)
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(marked, model, "doc_id", ("held_out",))
