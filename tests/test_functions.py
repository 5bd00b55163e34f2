"""Scalar functions on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import arrays, text


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("said, want", [("COX-2 naïve β2 e.g.", ["cox", "2", "na", "ve", "2", "e", "g"]), ("—é—", []), ("", []), ("a" * 300, ["a" * 255]), ("5\u212am \u0130x AB", ["5", "m", "x", "ab"])])
def test_tokens(spark, said, want):
    assert one(spark, text.tokens(F.col("t")), t=said) == want


def test_tokens_of_null(spark):
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("said, want", [("the answer is: **[B]**", "B"), ("diagnosis (c) here", "c"), ("so [D] and (A)", "D"), ("none", "[invalid]")])
def test_answer_v3(spark, said, want):
    assert one(spark, text.extract_answer_v3(F.col("t")), t=said) == want


@pytest.mark.parametrize("said, want", [("the answer is (B).", "(B)"), ("(A) or [C]", "(C)"), ("nothing", "[invalid]")])
def test_answer_v1(spark, said, want):
    assert one(spark, text.extract_answer_v1(F.col("t")), t=said) == want


@pytest.mark.parametrize("said, want", [(r"so \boxed{ D }", "D"), ("Answer: [C] and [A]", "C"), ("[A] then [B]", "B"), ("[AB]", "[invalid]")])
def test_answer_v2(spark, said, want):
    assert one(spark, text.extract_answer_v2(F.col("t")), t=said) == want


@pytest.mark.parametrize("said, want", [("Yes.", "yes"), ("not sure", "no"), ("perhaps", "maybe")])
def test_yes_no_maybe(spark, said, want):
    assert one(spark, text.yes_no_maybe(F.col("t")), t=said) == want


def test_options_are_rewritten_in_prose_too(spark):
    assert one(spark, text.rewrite_options(F.col("t"), "user"), t="A. x DNA. y") == "[A] : x DN[A] : y"
    assert one(spark, text.rewrite_options(F.col("t"), "assistant"), t="B. x") == "[B]. x"


def test_option_text(spark):
    assert one(spark, text.option_text(F.col("t"), "B"), t="q?\n\nA. one\nB. two \nC. three") == "two "


def test_html_nodes_keep_to_their_tag(spark):
    page = '<pre>x</pre><p>a</p><p class="k">b</p><script>"<p>z</p>"</script>'
    assert one(spark, text.html_nodes(F.col("t"), "p"), t=page) == ["a", "b"]


def test_padding_and_labels(spark):
    ids = F.array(*map(F.lit, (1, 2, 3, 4, 5)))
    assert one(spark, arrays.left_pad(arrays.masked_labels(ids, F.lit(3)), 7, 2)) == [2, 2, -100, -100, -100, 4, 5]
    assert one(spark, arrays.left_pad(ids, 3, 2)) == [3, 4, 5]
    assert one(spark, arrays.attention_mask(ids, 7)) == [0, 0, 1, 1, 1, 1, 1]
    assert one(spark, arrays.shifted(ids, 9)) == [2, 3, 4, 5, 9]


def test_softmax_sums_to_one(spark):
    assert sum(one(spark, text.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(1000.0))))) == pytest.approx(1)
