"""Array functions for training examples and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def left_pad(ids: Column, length: int, pad: int) -> Column:
    """The last ``length`` ids, padded on the left."""
    kept = F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), length)
    return F.concat(F.array_repeat(F.lit(pad).cast("int"), F.greatest(F.lit(length) - F.size(kept), F.lit(0))), kept)


def attention_mask(ids: Column, length: int) -> Column:
    n = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0), F.lit(length) - n), F.array_repeat(F.lit(1), n))


def masked_labels(ids: Column, prompt_len: Column) -> Column:
    """Labels: the ignored value for the prompt, ids for the rest."""
    n = F.least(prompt_len, F.size(ids))
    rest = F.size(ids) - n
    tail = F.when(rest > 0, F.slice(ids, n + 1, F.greatest(rest, F.lit(1)))).otherwise(F.slice(ids, 1, 0))
    return F.concat(F.array_repeat(F.lit(IGNORED), n), tail)


def shifted(ids: Column, pad: int) -> Column:
    """The ids from the second on, then the pad id."""
    return F.when(F.size(ids) > 0, F.concat(F.slice(ids, 2, F.greatest(F.size(ids), F.lit(1))), F.array(F.lit(pad).cast("int"))))


def first_n(items: Column, n: Column) -> Column:
    return F.slice(items, F.lit(1), n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
