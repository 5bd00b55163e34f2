"""Text functions: Column in, Column out, all built-in expressions; tokens and sentences of UTF-8 bytes too, for Arrow batches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop words that query analysis drops.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now ll ve m d re"
).split()
TOKEN = "[A-Za-z0-9]+"
TOKEN_CHARS = 255
INVALID = "[invalid]"
#: An option letter in brackets, and the wordings around it.
BRACKETED = r"[\*\s]*[\[\(]\s*([A-D])\s*[\]\)][\*\s]*"
OPTION_LETTERS = ("A", "B", "C", "D")


def tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, lower-cased, cut at 255 characters.

    The text is lower-cased as a whole, which is cheaper than token by token;
    the two other characters whose lower case has an ASCII letter are taken out first.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" "))
    return F.regexp_extract_all(F.lower(plain), F.lit(f"([a-z0-9]{{1,{TOKEN_CHARS}}})[a-z0-9]*"), F.lit(1))


#: Letters lower-cased and digits as they are, all other bytes (those of longer characters too) a space.
_TOKEN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 else 32 for b in range(256))


def byte_tokens(text: bytes) -> list[bytes]:
    """What ``tokens`` gives, of a text in UTF-8: many times faster."""
    found = text.translate(_TOKEN_BYTES).split()
    return found if not found or max(map(len, found)) <= TOKEN_CHARS else [t[:TOKEN_CHARS] for t in found]


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_punctuation(text: Column) -> Column:
    """Lower-cased, without characters of the Unicode category P."""
    return F.regexp_replace(F.lower(text), r"\p{P}", "")


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _last(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


# The wordings that the first and the second way of extraction look for.
ANSWER_IS, BRACKETED_CAPITAL = r"the answer is .(\w).", r"[\(\[]([A-Z])[\)\]]"
BOXED, ANSWER_COLON, LAST_BRACKETED = r"\\boxed\{([^}]+)\}", r"(?:Answer|answer):\s*\[?([A-Z])\]?", r"\[([A-Z])\](?:\s|$)"


def extract_answer_v1(response: Column) -> Column:
    """``the answer is (X)``, else the last bracketed capital, else invalid; in parentheses."""
    letter = F.coalesce(_first(response, ANSWER_IS), _last(response, BRACKETED_CAPITAL))
    return F.coalesce(F.concat(F.lit("("), letter, F.lit(")")), F.lit(INVALID))


def extract_answer_v2(response: Column) -> Column:
    """A boxed answer, else ``Answer: [X]``, else the last ``[X]`` before white space or the end, else invalid."""
    boxed = F.regexp_extract(response, BOXED, 1)
    found = F.coalesce(F.nullif(F.trim(boxed), F.lit("")), _first(response, ANSWER_COLON), _last(response, LAST_BRACKETED))
    return F.coalesce(found, F.lit(INVALID))


def extract_answer_v3(response: Column, upper: bool = False) -> Column:
    """``answer is [X]``, else ``is [X]`` anywhere, both in any case; else the first ``[X]``; else invalid."""
    letter = F.coalesce(_first(response, r"(?i)answer is[:\s]*" + BRACKETED), _first(response, r"(?i)is[:\s]*" + BRACKETED), _first(response, BRACKETED))
    return F.coalesce(F.upper(letter) if upper else letter, F.lit(INVALID))


def yes_no_maybe(text: Column) -> Column:
    """By substring, in this order: contains yes, contains no, else maybe."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("yes")), "yes").when(F.contains(low, F.lit("no")), "no").otherwise("maybe")


def after_marker(text: Column, marker: str) -> Column:
    """What follows the first occurrence of the marker in any case; null without it."""
    at = F.instr(F.lower(text), marker.lower())
    return F.when(at > 0, F.substring(text, at + F.lit(len(marker)), F.length(text)))


def spaced_tail(text: Column, marker: str) -> Column:
    """``after_marker`` with every run of white space as one space, and none at the ends."""
    return F.trim(F.regexp_replace(after_marker(text, marker), r"\s+", " "))


def after_last(text: Column, marker: str) -> Column:
    """The last piece of the text split at the marker; all of it without one."""
    return F.substring_index(text, marker, -1)


def before_marker(text: Column, marker: str) -> Column:
    return F.when(F.contains(text, F.lit(marker)), F.substring_index(text, marker, 1)).otherwise(text)


def first_character(text: Column) -> Column:
    return F.substring(strip_space(text), 1, 1)


def rewrite_options(text: Column, role: str) -> Column:
    """``A.`` to ``[A] :`` in what a user says, to ``[A].`` in an assistant's words; in prose too."""
    for letter in OPTION_LETTERS:
        text = F.replace(text, F.lit(f"{letter}."), F.lit(f"[{letter}] :" if role == "user" else f"[{letter}]."))
    return text


def sentences(text: Column) -> Column:
    """Pieces at white space after ``.``, ``!`` or ``?``, stripped, without empty ones."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip_space), lambda s: s != "")


_SENTENCE_END = re.compile(rb"([.!?])\s+")


def byte_sentences(text: bytes) -> list[bytes]:
    """What ``sentences`` gives, of a text in UTF-8."""
    return [s for piece in _SENTENCE_END.sub(b"\\1\x01", text).split(b"\x01") if (s := piece.strip(b" \t\n\r\x0b\x0c"))]


# The text that hides an option, and the two prompts around context, question and choices.
HIDDEN_OPTION = "None of the other answers"
PLAIN_PROMPT = ("\n", "\n\n", "\n")
CONTEXT_PROMPT = ("\nContext:\n", "\n\nQuestion:\n", "\n\n", "\n")


def _filled(template: tuple[str, ...], *values: Column) -> Column:
    """The template's pieces with the values between them."""
    return F.concat(F.lit(template[0]), *(x for value, piece in zip(values, template[1:]) for x in (value, F.lit(piece))))


def format_choices(choices: Column, answer_key: Column | None = None) -> Column:
    """``[A] : text`` lines of an array of (letter, text); with a key, its text is masked."""
    def line(c: Column) -> Column:
        text = c["text"] if answer_key is None else F.when(c["letter"] == answer_key, HIDDEN_OPTION).otherwise(c["text"])
        return F.concat(F.lit("["), c["letter"], F.lit("] : "), text)

    return F.array_join(F.transform(choices, line), "\n")


def build_prompt(context: Column, question: Column, choices: Column) -> Column:
    """The prompt with context, or the plain one where the context is null or empty."""
    plain = _filled(PLAIN_PROMPT, question, choices)
    full = _filled(CONTEXT_PROMPT, context, question, choices)
    return F.when(F.coalesce(context, F.lit("")) == "", plain).otherwise(full)


def html_nodes(html: Column, tag: str) -> Column:
    """Inner html of the elements of a tag, scripts and styles removed first; attributes allowed, longer names not."""
    clean = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    return F.regexp_extract_all(clean, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def softmax(scores: Column) -> Column:
    """Softmax of an array of doubles, shifted by its greatest."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def option_text(question: Column, letter: str) -> Column:
    """Text of the option that a line ``{letter}. text`` of the question gives; '' without it."""
    return F.regexp_extract(question, rf"(?m)^{letter}\.\s*(.*)$", 1)


def classifier_input(question: Column, context: Column) -> Column:
    """What the usefulness classifier reads."""
    return F.concat(F.lit("question: "), question, F.lit(" context: "), context)
