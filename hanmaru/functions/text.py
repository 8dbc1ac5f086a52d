"""Text functions as Columns; Python only where Spark has no built-in."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold(text: Column) -> Column:
    """Squeezed and in lower case; null gives an empty text."""
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def key_of(text: Column) -> Column:
    """Lower-case ASCII letters, digits and Hangul syllables only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z가-힣]", "")


@pandas_udf(StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition, without zero-width characters, line breaks as line feeds. ASCII and Hangul texts are in that form
    already and do not leave the JVM."""
    composed = F.when(text.rlike(r"^[\x00-\x7F가-힣]*$"), text).otherwise(_nfkc(text))
    return F.regexp_replace(F.regexp_replace(composed, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", ""), r"\r\n?", "\n")


def strip_brackets(text: Column) -> Column:
    """Without bracketed passages (no nesting), approval numbers and percentages, squeezed."""
    bare = F.regexp_replace(text, r"\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）", " ")
    return squeeze(F.regexp_replace(bare, r"제\s*\d{4}-\d+\s*호|\d+(\.\d+)?\s*%", " "))


def strip_suffixes(key: Column, suffixes: list[str], least: int = 2) -> Column:
    """Endings taken off until none is left to take: each time the longest that leaves `least` characters before it. An ending has a
    character at least, so as many rounds as the key has characters are enough; a key without an ending is not folded."""
    endings = "|".join(sorted(map(re.escape, suffixes), key=len, reverse=True))
    pattern = f"^(.{{{least},}}?)(?:{endings})$"
    rounds = F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1)))
    return F.when(key.rlike(pattern), F.aggregate(rounds, key, lambda k, _: F.regexp_replace(k, pattern, "$1"))).otherwise(key)


def first_rule(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The value of the first rule whose pattern is found in the text."""
    out = F.when(F.lit(False), default)
    for pattern, value in rules:
        out = out.when(text.rlike(pattern), F.lit(value))
    return out.otherwise(default)


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether a folded text contains any of the words without regard to white space; ASCII words of one or two letters must stand alone."""
    flat = F.regexp_replace(fold(text), r"\s+", "")
    out = F.lit(False)
    for w in words:
        plain = w.lower().replace(" ", "")
        out = out | (fold(text).rlike(rf"(?<![a-z0-9]){plain}(?![a-z0-9])") if len(plain) <= 2 and plain.isascii() else F.contains(flat, F.lit(plain)))
    return out


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def matching_ratio(a: Column, b: Column) -> Column:
    """Gestalt matching ratio of two texts, 0 to 1; null if either is. There is no built-in for it, so it is an Arrow UDF."""
    return _ratio(a, b)


def unordered(items: Column) -> Column:
    """An array whose order is not to count, for `signature`: its distinct items, sorted."""
    return F.array_sort(F.array_distinct(items))


def signature(*parts: Column) -> Column:
    """SHA-1 of the parts as JSON; nulls and empty texts differ, and so do arrays of another order (see `unordered`)."""
    return F.sha1(F.to_json(F.struct(*[F.coalesce(F.to_json(F.array(p)), F.lit("null")).alias(f"p{i}") for i, p in enumerate(parts)])))


def clean_array(items: Column, first: int | None = None) -> Column:
    """Trimmed items without empty ones and nulls, each once, in order; only the `first` of them if given."""
    out = F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.slice(out, 1, first) if first else out


def json_names(text: Column) -> Column:
    """A JSON array of names as an array; empty where the text is null, empty or no array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def count_phrase(names: Column, more: str = "외") -> Column:
    """One name, two with a comma, or the first two and the number of others."""
    n = F.size(names)
    return (
        F.when(n == 0, "").when(n <= 2, F.array_join(names, ", "))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, 2), ", "), F.lit(f" {more} "), (n - 2).cast("string")))
    )


def plain_or_empty(text: Column) -> Column:
    """Null-like texts (null, nan, none, null) as an empty text, others trimmed."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(bare).isin("nan", "none", "null"), "").otherwise(bare)


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    """At most `most` characters, the last of them the mark where something was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark)))


def file_key(text: Column, most: int = 80) -> Column:
    """A name fit for a file: letters, digits, points, dashes and underscores, runs of anything else one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9A-Za-z가-힣._-]+", "_"), "^_+|_+$", ""), 1, most)


def number_of(*candidates: Column, identifier: Column) -> Column:
    """The first candidate that is not empty, else what stands after `::` in the identifier, else the identifier."""
    after = F.when(F.contains(identifier, F.lit("::")), F.split_part(identifier, F.lit("::"), F.lit(2))).otherwise(identifier)
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates], after)


def tolerant_boolean(text: Column) -> Column:
    """true for 1, true, yes, y and t, false for 0, false, no, n, f and nothing; null for anything else."""
    bare = F.lower(F.trim(F.coalesce(text.cast("string"), F.lit(""))))
    return F.when(bare.isin("1", "1.0", "true", "yes", "y", "t"), True).when(bare.isin("0", "0.0", "false", "no", "n", "f", ""), False)


def tolerant_list(text: Column) -> Column:
    """A JSON array of names, or names between bars or commas, as an array of clean items."""
    bare = F.coalesce(text, F.lit(""))
    return clean_array(F.when(bare.rlike(r"^\s*\["), json_names(bare)).otherwise(F.split(bare, r"[|,]")))


def one_of_or_like(text: Column, exact: list[str], anchored: list[str]) -> Column:
    """Whether a folded text is one of the `exact` words or matches one of the patterns from its beginning to its end."""
    plain = fold(text)
    patterns = "|".join(f"(?:{p})" for p in anchored)
    return plain.isin(exact) | (plain.rlike(f"^(?:{patterns})$") if anchored else F.lit(False))


def is_amount(text: Column) -> Column:
    """Whether a text is a number with a unit and nothing else."""
    return fold(text).rlike(r"^\d[\d,]*(\.\d+)?\s*(mg|g|kg|mcg|ug|µg|μg|ml|l|iu|cfu|kcal|%)$")


def is_short_key(text: Column, most: int = 4) -> Column:
    """Whether a text has so few letters and digits that it is found within too many others."""
    return F.length(key_of(text)) <= most


def label_of(text: Column, names: dict[str, str]) -> Column:
    """A label by the map of its other names, white space and case aside; labels not in the map stay."""
    known = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.coalesce(F.element_at(known, fold(text)), squeeze(text))


def aliases_of(name: Column, suffixes: list[str]) -> Column:
    """The keys a name may be looked up by: its own, that without brackets, those without endings, and those of what stands in brackets."""
    inside = F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"[(\[（]([^()\[\]（）]*)[)\]）]"), F.lit(1)), lambda x: F.split(x, "[,;/|·]"))
    bare = strip_brackets(F.coalesce(name, F.lit("")))
    keys = F.concat(F.array(key_of(name), key_of(bare), strip_suffixes(key_of(name), suffixes), strip_suffixes(key_of(bare), suffixes)), F.transform(F.flatten(inside), key_of))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) > 1))
