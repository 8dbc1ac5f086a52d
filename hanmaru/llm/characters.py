"""Visually identical text with different characters: one consistent form for all of it.

DuckDB runs inside the Arrow partitions: its SQL removes invisible characters, maps compatibility forms, spaces and
look-alike letters with `translate`, and composes with `nfc_normalize`. Nothing leaves the executor, no shuffle is needed.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hanmaru.llm.pairing import pairs_within
from hanmaru.session import write_through

#: Letters of other scripts that look like Latin ones, each with the Latin letter it looks like.
LOOK_ALIKES = (
    ("АВЕЗКМНОРСТУХЅІӀЈԚԜѴҮаеорсухѕіӏјһԛԝԁѵү", "ABE3KMHOPCTYXSIIJQWVYaeopcyxsiljhqwdvy"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνϲϳ", "ABEZHIKMNOPTYXopvcj"),
    ("ՕՍօսհոցզ", "OUouhngq"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    ("ᴄᴏᴠᴡᴢꜱ", "covwzs"),
)
#: Spaces of all widths; line breaks of other kinds; characters without any width; hyphens that look like the ordinary one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u3164\uffa0"
LINE_BREAKS = "\u0085\u2028\u2029\r"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\U000e0001-\U000e007f"
HYPHENS = "\u2010\u2011"
#: Blocks whose compatibility forms read as the characters they stand for.
COMPATIBILITY_BLOCKS = ((0xFF01, 0xFFEE), (0x2160, 0x217F), (0x3380, 0x33DF), (0xFB00, 0xFB06), (0x2100, 0x214F), (0x1D400, 0x1D7FF), (0x00B5, 0x00B5), (0x2F00, 0x2FD5))


@functools.cache
def _tables() -> tuple[str, str, list[tuple[str, str]]]:
    """The two strings of `translate`, and the forms that stand for several characters."""
    one: dict[str, str] = {}
    several: list[tuple[str, str]] = []
    alike = {a: b for left, right in LOOK_ALIKES for a, b in zip(left, right, strict=True)}
    for low, high in COMPATIBILITY_BLOCKS:
        for c in map(chr, range(low, high + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and plain != " ":
                plain = "".join(alike.get(x, x) for x in plain)
                one[c] = plain if len(plain) == 1 else one.get(c, "")
                if len(plain) > 1:
                    several.append((c, plain))
                    one.pop(c)
    for c in (*map(chr, range(0x0370, 0x0530)), *map(chr, range(0x1F00, 0x2000))):
        whole = unicodedata.normalize("NFD", c)
        if whole[0] in alike:
            plain = unicodedata.normalize("NFC", alike[whole[0]] + whole[1:])
            if len(plain) == 1:
                one[c] = plain
    one |= alike | dict.fromkeys(SPACES, " ") | dict.fromkeys(LINE_BREAKS, "\n") | dict.fromkeys(HYPHENS, "-")
    return "".join(one), "".join(one.values()), several


def canonical_sql(column: str) -> str:
    """DuckDB SQL for the consistent form of a column: invisible characters go, then compatibility forms, spaces and look-alikes
    are mapped, the rest is composed; composed letters of look-alikes are mapped once more."""

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    left, right, several = _tables()
    visible = f"regexp_replace(replace({column}, chr(13) || chr(10), chr(10)), {quote('[' + INVISIBLE + ']')}, '', 'g')"
    mapped = f"nfc_normalize(translate({visible}, {quote(left)}, {quote(right)}))"
    spelled = mapped
    for form, plain in several:
        spelled = f"replace({spelled}, {quote(form)}, {quote(plain)})"
    some = "[" + "".join(form for form, _ in several) + "]"
    plain_ascii = f"regexp_full_match({column}, '[ -~\\n\\t가-힣]*')"
    return f"CASE WHEN {plain_ascii} THEN {column} WHEN regexp_matches({column}, {quote(some)}) THEN {spelled} ELSE {mapped} END"


def canonical_text(df: DataFrame, column: str, into: str = "canonical_text", digest_only: bool = False) -> DataFrame:
    """Adds `into`, the consistent form of a text column; other columns stay, one named like `into` is replaced.

    Null stays null, an empty text stays empty. Full-width and other compatibility forms become ordinary ones, every kind of
    single space a space, line breaks of any kind a line feed; zero-width characters go; look-alike Cyrillic and Greek
    letters become Latin; the result is composed (NFC). Letter case, number of spaces, line breaks and punctuation stay.
    With `digest_only` the MD5 of the form is added instead of the form itself, for grouping long texts.
    """
    df = df.drop(into) if into != column else df
    schema = StructType([*(f for f in df.schema.fields if f.name != into), StructField(into, StringType())])
    expression = canonical_sql(f'"{column}"')
    arrow_names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        value = f"md5({expression})" if digest_only else expression
        for batch in batches:
            con.register("batch", pa.table({column: batch.column(batch.schema.get_field_index(column))}))
            found = con.sql(f"SELECT {value} AS v FROM batch").to_arrow_table().column("v").combine_chunks()
            found = found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)
            columns = {batch.schema.names[i]: batch.column(i) for i in range(batch.num_columns)} | {into: found.cast(pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in arrow_names], names=arrow_names)

    return df.mapInArrow(run, schema)


def same_reading_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """(left_key, right_key): pairs of different keys, smaller first, whose texts read the same but are stored in different characters.

    Null and empty texts and null keys are no case; equal (key, text) rows count once; texts stored alike make no pair.
    """
    once = df.select(F.col(key).alias("key"), F.col(column).alias("text")).where(F.col("key").isNotNull() & (F.col(column) != "")).withColumn("stored", F.md5("text"))
    forms = canonical_text(once, "text", "reads", digest_only=True).select("key", "reads", "stored").distinct()
    forms = write_through(forms, "readings")
    mixed = forms.groupBy("reads").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select("reads")
    members = forms.join(mixed, "reads")
    return pairs_within(members, "reads", "key", "stored").distinct()
