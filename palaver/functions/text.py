"""Scalar text functions as column expressions: everything stays in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions import rules as R

_I = "(?iud)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Words between white space, none empty; null stays null."""
    return F.filter(F.split(col(c), R.WS + "+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def estimate_tokens(c: Column | str) -> Column:
    """1.3 tokens per word."""
    return word_count(c) * F.lit(1.3)


def remove_all(c: Column | str, patterns: list[str]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, _I + p, ""), patterns, col(c))


def count_removed(c: Column | str, patterns: list[str]) -> Column:
    """Matches removed by remove_all, each pattern counted on what the earlier ones left."""
    total, x = F.lit(0), col(c)
    for p in patterns:
        total = total + F.regexp_count(x, F.lit(_I + p))
        x = F.regexp_replace(x, _I + p, "")
    return total


def clean_timestamps(c: Column | str) -> Column:
    return remove_all(c, R.TIMESTAMPS)


def clean_noise(c: Column | str) -> Column:
    return remove_all(c, R.NOISE)


def clean_artifacts(c: Column | str) -> Column:
    return remove_all(c, R.ARTIFACTS)


FILLER = rf"(?<!{R.WORD})(?:{'|'.join(R.FILLERS)})(?!{R.WORD})"


def clean_fillers(c: Column | str) -> Column:
    return remove_all(c, [FILLER])


REPEATED = [
    rf"(?<!{R.WORD})({R.WORD}+){R.WS}+\1(?!{R.WORD})",
    rf"(?<!{R.WORD})({R.WORD})\1{{3,}}(?!{R.WORD})",
    rf"(?<!{R.WORD})({R.WORD}{{1,3}})-\1(?!{R.WORD})",
]


def collapse_repetitions(c: Column | str) -> Column:
    """One pass per pattern: "the the" -> "the", "aaaa" -> "a", "th-th" -> "th"."""
    return reduce(lambda x, p: F.regexp_replace(x, _I + p, "$1"), REPEATED, col(c))


def count_repetitions(c: Column | str) -> Column:
    total, x = F.lit(0), col(c)
    for p in REPEATED:
        total = total + F.regexp_count(x, F.lit(_I + p))
        x = F.regexp_replace(x, _I + p, "$1")
    return total


def replace_words(c: Column | str, table: dict[str, str]) -> Column:
    """Whole words by a dictionary in one pass over the text."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    tokens = F.regexp_extract_all(col(c), F.lit(rf"({R.WORD}+|(?:(?!{R.WORD})(?s:.))+)"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(lookup, F.lower(t)), t)), "")


def spelled_numbers(c: Column | str) -> Column:
    return replace_words(c, R.NUMBERS)


def ordinals(c: Column | str) -> Column:
    return replace_words(c, R.ORDINALS)


def punctuation_spacing(c: Column | str) -> Column:
    x = F.regexp_replace(col(c), rf"{R.WS}*([,.!?;:]){R.WS}*", "$1 ")
    x = F.regexp_replace(x, rf"{R.WS}+([,.!?;:])", "$1")
    x = F.regexp_replace(x, rf"{R.WS}+", " ")
    return F.regexp_replace(x, r"([.!?])\1+", "$1")


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base, by canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    pairs += [("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), (" ", " ")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# Letters that become two.
DOUBLE = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}


def ascii_cleanup(c: Column | str) -> Column:
    """Latin letters without accents, other scripts and symbols dropped, white space collapsed and trimmed."""
    x = reduce(lambda y, kv: F.replace(y, F.lit(kv[0]), F.lit(kv[1])), DOUBLE.items(), col(c))
    x = F.translate(x, *_fold_table())
    x = F.regexp_replace(x, r"[^A-Za-z0-9_\s.,!?;:()'\"-]", "")
    return F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^ | $", "")


def time_to_seconds(c: Column | str) -> Column:
    """H:MM:SS with comma or point; anything but three parts is 0."""
    p = F.split(F.replace(col(c), F.lit(","), F.lit(".")), ":")
    n = [F.get(p, i).try_cast("double") for i in range(3)]
    return F.when(F.size(p) == 3, F.coalesce(n[0] * 3600 + n[1] * 60 + n[2], F.lit(0.0))).otherwise(F.lit(0.0))


def trim_ws(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"^{R.WS}+|{R.WS}+$", "")


# Label patterns in the order in which they are tried, case ignored; white space by this engine's class.
LABELS = [rf"^([A-Z][A-Z\s]+):{R.WS}*(.+)$", rf"^\[([^\]]+)\]:{R.WS}*(.+)$", rf"^([^:]+):{R.WS}*(.+)$"]


def detect_speaker(c: Column | str) -> tuple[Column, Column]:
    """(speaker or null, text) by the first label pattern that fits; the text unchanged where none does."""
    t = trim_ws(c)
    speaker, text = F.lit(None).cast("string"), col(c)
    for p in reversed(LABELS):
        hit = F.regexp_like(t, F.lit(_I + p))
        speaker = F.when(hit, trim_ws(F.regexp_extract(t, _I + p, 1))).otherwise(speaker)
        text = F.when(hit, trim_ws(F.regexp_extract(t, _I + p, 2))).otherwise(text)
    return speaker, text


def truncate_display(c: Column | str, n: int = 50) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.left(col(c), F.lit(n)), F.lit("..."))).otherwise(col(c))


def sentences(c: Column | str) -> Column:
    """Array of trimmed sentences: cut behind . ! ? before white space."""
    return F.filter(F.transform(F.split(col(c), rf"(?<=[.!?]){R.WS}+"), trim_ws), lambda s: s != "")


def long_sentences(c: Column | str, min_words: int = 3) -> Column:
    return F.filter(sentences(c), lambda s: word_count(s) >= min_words)


def extension(c: Column | str) -> Column:
    return F.lower(F.element_at(F.split(col(c), r"\."), -1))


def first_contained(c: Column | str, terms: list[str]) -> Column:
    """The first term of the list that the lower-cased text contains (as a substring), else null."""
    low = F.lower(col(c))
    return F.coalesce(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms])


def priority(c: Column | str) -> Column:
    low, out = F.lower(col(c)), None
    for level, patterns in R.PRIORITIES.items():
        hit = reduce(lambda a, b: a | b, [F.regexp_like(low, F.lit(ascii_words(p))) for p in patterns])
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise("unspecified")


def ascii_words(p: str) -> str:
    r"""A pattern \b(...)\b with word edges as in R.WORD."""
    return p.replace(r"\b(", rf"(?<!{R.WORD})(", 1)[:-2] + rf"(?!{R.WORD})" if p.endswith(r"\b") else p
