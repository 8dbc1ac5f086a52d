"""Several values packed in one field: one row per value, with its place.

The field is cut at quote characters, brackets and separators; what stands between an opening and the
next matching closing quote is a literal, everything else is cut at separators, and an array fold puts
the pieces together again. All of it is built-in SQL (`regexp_extract_all` and `aggregate`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quote characters, brackets and separators of packed fields.
QUOTES = "\"'"
OPENING = "([{（［｛「『【〔"
CLOSING = ")]}）］｝」』】〕"
SEPARATORS = ",;/|，；／｜、\t\r\n"
#: Separators only where white space stands before them; inside a word they belong to it.
SPACED_SEPARATORS = "·+ㆍ・＋"

BLANK = r"[\s\p{Z}\x{85}]"


def _class(chars: str) -> str:
    return "[" + "".join({"\t": r"\t", "\r": r"\r", "\n": r"\n"}.get(c, "\\" + c if ord(c) < 128 else c) for c in chars) + "]"


def _pieces(text: Column) -> Column:
    """The field as an array of quotes, escaped quotes, brackets, separators and runs of other characters. A bracket pair
    without further brackets or quotes inside is one piece, as is a comma between digits with the digit after it."""
    special = _class(QUOTES + OPENING + CLOSING + SEPARATORS + SPACED_SEPARATORS + "\\")
    nested = _class(QUOTES + OPENING + CLOSING)[1:-1]
    common = "가-힣A-Za-z0-9 .%:-"  # tested first: cheaper than the complement of the special characters
    pattern = "|".join(
        [
            f"[{common}]++",
            _class(OPENING) + f"[,;/{common}]*+[^{nested}]*+" + _class(CLOSING),
            r"\\" + _class(QUOTES),
            r"(?<=\p{Nd})[,，]\p{Nd}",
            special,
            "[^" + special[1:-1] + "]++",
        ]
    )
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


#: Pieces folded at a time.
CHUNK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


FIELDS = ("vals", "raw", "lit", "mixed", "nlit", "depth", "quote", "closed", "under")


def _fold(pieces: Column, quotes: bool, brackets: bool) -> Column:
    """Folds pieces into values. State: finished values; the open value as stored (raw), the text of its literals (lit),
    whether anything else than literals was seen (mixed), the number of literals, bracket depth, the open quote, the quote
    just closed (met again at once, it stands for itself), and whether a bracket was closed that was never opened."""
    none, no, zero = F.lit(""), F.lit(False), F.lit(0)
    empty = F.struct(*[v.alias(k) for k, v in zip(FIELDS, (F.array().cast("array<string>"), none, none, no, zero, zero, none, none, no), strict=True)])

    def state(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(k, s[k]).alias(k) for k in FIELDS])

    def values(s: Column) -> Column:
        return F.array_append(s["vals"], F.when(~s["mixed"] & (s["nlit"] == 1), s["lit"]).otherwise(s["raw"]))

    def one_of(chars: str, t: Column) -> Column:
        return F.instr(F.lit(chars), t) > 0

    def step(s: Column, t: Column) -> Column:
        raw, mixed = F.concat(s["raw"], t), s["mixed"] | ~t.rlike(f"^{BLANK}*$")
        plain = state(s, raw=raw, mixed=mixed, closed=none)
        branch = F.when((s["quote"] == "") & ~one_of(QUOTES + OPENING + CLOSING + SEPARATORS + SPACED_SEPARATORS, t), plain)
        if quotes:
            escaped = F.when(t.isin(*["\\" + q for q in QUOTES]), F.substring(t, 2, 1)).otherwise(t)
            branch = (
                branch.when((s["quote"] != "") & (t == s["quote"]), state(s, raw=raw, quote=none, closed=t))
                .when(s["quote"] != "", state(s, raw=raw, lit=F.concat(s["lit"], escaped)))
                .when(t == s["closed"], state(s, raw=raw, lit=F.concat(s["lit"], t), quote=t, closed=none))
                .when(one_of(QUOTES, t) & ~((t == "'") & s["raw"].rlike(r"[\p{L}\p{N}]$")), state(s, raw=raw, nlit=s["nlit"] + 1, quote=t))
            )
        if brackets:
            branch = (
                branch.when(one_of(OPENING, t), state(s, raw=raw, mixed=F.lit(True), closed=none, depth=s["depth"] + 1))
                .when(one_of(CLOSING, t), state(s, raw=raw, mixed=F.lit(True), closed=none, depth=F.greatest(s["depth"] - 1, zero), under=s["under"] | (s["depth"] == 0)))
                .when(s["depth"] > 0, plain)
            )
        ends = one_of(SEPARATORS, t) | (one_of(SPACED_SEPARATORS, t) & s["raw"].rlike(f"(^|{BLANK})$"))
        emit = state(s, vals=values(s), raw=none, lit=none, mixed=no, nlit=zero, closed=none)
        return branch.when(ends, emit).otherwise(plain)

    def finish(s: Column) -> Column:
        return F.struct(values(s).alias("vals"), (s["quote"] != "").alias("open_quote"), (s["depth"] > 0).alias("open_bracket"), s["under"].alias("under"))

    def fold_chunk(s: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, state(s, vals=F.array().cast("array<string>")), step)
        return _let(done, lambda d: state(d, vals=F.concat(s["vals"], d["vals"])))

    def whole(p: Column) -> Column:
        count = F.ceil(F.size(p) / F.lit(CHUNK)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(p, i * CHUNK + 1, CHUNK))
        return F.aggregate(chunks, empty, fold_chunk, finish)

    # appending to an array copies it: long fields are folded chunk by chunk, so that only chunks are copied piece by piece
    return _let(pieces, lambda p: F.when(F.size(p) <= CHUNK, F.aggregate(p, empty, step, finish)).otherwise(whole(p)))


def split_packed(df: DataFrame, column: str, into: str = "packed_values") -> DataFrame:
    """Adds `into`, the array of the values packed in `column`, in order.

    Separators inside brackets or quotes and a comma between two digits belong to the value. A field may also be one list
    literal in square brackets. Quotes written twice or escaped inside a literal become one; outer white space and outer
    quotes go; empty values are skipped. Null, empty and blank fields give an empty array. A quote never closed makes all
    quotes of the field plain characters, a bracket never closed or never opened all its brackets. Other columns stay as
    they are, a column named like `into` is replaced.
    """
    tmp = "__packed_"
    inner = F.regexp_extract(F.col(column), rf"(?s)^{BLANK}*\[(.*)\]{BLANK}*$", 1)
    out = df.withColumn(f"{tmp}list", F.when(F.col(column).rlike(rf"(?s)^{BLANK}*\[.*\]{BLANK}*$"), _fold(_pieces(inner), True, True)))
    good = F.col(f"{tmp}list").isNotNull() & ~F.col(f"{tmp}list.under") & ~F.col(f"{tmp}list.open_quote") & ~F.col(f"{tmp}list.open_bracket")
    out = out.withColumn(f"{tmp}list", F.when(good, F.col(f"{tmp}list.vals")))
    out = out.withColumn(f"{tmp}all", F.when(F.col(f"{tmp}list").isNull(), _fold(_pieces(F.coalesce(F.col(column), F.lit(""))), True, True)))
    q, b = F.col(f"{tmp}all.open_quote"), F.col(f"{tmp}all.open_bracket")
    text = F.coalesce(F.col(column), F.lit(""))
    out = out.withColumn(
        into,
        F.when(F.col(f"{tmp}list").isNotNull(), F.col(f"{tmp}list"))
        .when(q, F.when(F.col(f"{tmp}all").isNotNull(), _plain_quotes(text)))
        .when(b, _fold(_pieces(text), True, False)["vals"])
        .otherwise(F.col(f"{tmp}all.vals")),
    )
    out = out.withColumn(into, F.filter(F.transform(into, _trim), lambda v: v != ""))
    return out.drop(f"{tmp}list", f"{tmp}all")


def _plain_quotes(text: Column) -> Column:
    first = _fold(_pieces(text), False, True)
    return F.when(first["open_bracket"], _fold(_pieces(text), False, False)["vals"]).otherwise(first["vals"])


def explode_packed(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, value_pos, value_text): one row for each value packed in `column`, numbered from 1; equal (key, field) rows count once."""
    once = df.select(F.col(key), F.col(column)).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
    values = split_packed(once, column).select(F.col(key), F.posexplode_outer("packed_values").alias("value_pos", "value_text"))
    # outer: a plain posexplode has the optimizer filter on the array's size, and so fold every field twice
    return values.where(F.col("value_pos").isNotNull()).select(F.col(key), (F.col("value_pos") + 1).alias("value_pos"), "value_text").distinct()
