"""Lines of scanned labels: the ingredient passage, wrapped lines put together again, and what is a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings that begin the ingredient passage, and those that end it.
STARTS = "원재료명 및 함량|원재료명|원료 및 함량|원재료"
STOPS = "섭취|내용량|LOT|보관|유통기한|소비기한|제조원|영양"


def passage_lines(text: Column) -> Column:
    """The lines after the first heading of ingredients up to the next other heading; without such a heading the first line with two commas
    or more and those after it up to a heading. Blank lines are left out."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(F.array(lines), _passage)[0]


def _first_place(lines: Column, pattern: str, after: Column) -> Column:
    places = F.filter(F.transform(lines, lambda x, i: F.when((i > after) & x.rlike(pattern), i)), lambda i: i.isNotNull())
    return F.get(places, F.lit(0))


def _passage(lines: Column) -> Column:
    start = _first_place(lines, STARTS, F.lit(-1))
    comma = _first_place(lines, r"[,、，][^,、，]*[,、，]", F.lit(-1))
    first = F.when(start.isNotNull(), start + 1).otherwise(comma)
    stop = _first_place(lines, f"^[^,、，]*({STOPS})", first - 1)
    count = F.coalesce(stop, F.size(lines)) - first
    return F.when(first.isNull() | (count <= 0), F.array().cast("array<string>")).otherwise(F.slice(lines, F.coalesce(first, F.lit(0)) + 1, F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))))


def _open(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^(\[（]", "")) > F.length(F.regexp_replace(text, r"[^)\]）]", ""))


def rejoined(lines: Column) -> Column:
    """Wrapped lines as one: a line goes on the one before if that has an open bracket or does not end with a separator and this begins with a
    separator, a closing bracket, a point or a digit after a digit, or is of two characters at most. Joined without a space, as
    labels break within words."""
    def step(done: Column, line: Column) -> Column:
        last = F.element_at(done, -1)
        goes_on = _open(last) | line.rlike(r"^[,;.)\]）、]") | (last.rlike(r"\d$") & line.rlike(r"^\d")) | ((F.length(line) <= 2) & ~last.rlike(r"[,;、]$"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, line)))
        return F.when(F.size(done) == 0, F.array(line)).when(goes_on, joined).otherwise(F.concat(done, F.array(line)))

    return F.aggregate(lines, F.array().cast("array<string>"), step)


def clean_token(token: Column) -> Column:
    """A token of the passage as a name: without bullets, brackets, amounts and shares at its end; null if no name is left."""
    bare = F.regexp_replace(token, r"^[\s*•·ㆍ\-–]+", "")
    bare = F.regexp_replace(bare, r"[(\[（].*$", "")
    bare = F.trim(F.regexp_replace(bare, r"(?i)\s*\d[\d,.]*\s*(mg|g|kg|mcg|ug|µg|ml|iu|cfu|%)?\s*$", ""))
    return F.when((F.length(bare) > 1) & bare.rlike(r"\p{L}{2}") & ~bare.rlike("^(원산지|함유|기타|이상|이하)$"), bare)
