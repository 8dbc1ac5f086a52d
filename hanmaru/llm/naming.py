"""Mapping free-entered names to a canonical list.

What the domain's names are made of (preparations, plant parts, salts and the like) is a parameter, a `Lexicon`; without one, names
are compared as they are. A value is cut into parts, details (amounts, shares, numbers, batch codes) are stripped, and every distinct name left is read in
all ways it can be meant: with and without preparation and plant part, typed with the keyboard in the wrong mode, romanised, as a
salt. Each reading is a set of letter pairs. A prefix-filter set-similarity join brings readings and list together: pairs are ordered
by global rarity, only the rare prefix is joined, length and position bounds cut the candidates, Jaccard is verified exactly.
Of the candidates the best is kept whose spelling is within one slip: a letter, or a syllable doubled, dropped or exchanged with its neighbour.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanmaru.llm.pairing import BROADCAST_ROWS, hot_groups, join_shuffled, look_up
from hanmaru.session import write_through


@dataclass(frozen=True)
class Lexicon:
    """What may stand in a name of a domain besides the thing it names. All of it is optional."""

    preparations: tuple[str, ...] = ()  # endings that do not change what is meant
    foreign_preparations: tuple[str, ...] = ()  # the same of names in Latin letters
    qualities: tuple[str, ...] = ()  # beginnings that do not
    parts: dict[str, str] = field(default_factory=dict)  # endings that do, if the list has several, with the foreign word
    doubtful_parts: tuple[str, ...] = ()  # parts that may belong to the name itself
    salts: tuple[str, ...] = ()  # beginnings before one of `bases`
    bases: tuple[str, ...] = ()
    foreign_words: dict[str, str] = field(default_factory=dict)  # names whose foreign word is not their romanisation
    replaced_words: dict[str, str] = field(default_factory=dict)  # words within names in mixed letters
    first_words: dict[str, str] = field(default_factory=dict)  # of the list, taken off: with the foreign word
    first_word_aliases: tuple[str, ...] = ()  # as typed
    variants: dict[str, str] = field(default_factory=dict)  # a letter and digit at the end, and the letter alone
    abbreviations: dict[str, str] = field(default_factory=dict)  # beginnings of Latin names
    lettered: tuple[str, ...] = ()  # beginnings of Latin names in which one letter makes another name
    codes: str = r"(?!)"  # pattern of what is taken off the end of a part of a value
    details: str = r"(?!)"  # pattern of parts of a value that are no names
    foreign_name: str = r"(?!)()"  # pattern of the foreign name in an entry's notes


# Fixed values of the domain, in Korean and English.
SUPPLEMENTS = Lexicon(
    preparations=(
        "추출농축액", "추출분말", "추출물", "열수추출물", "주정추출물", "농축분말", "농축액", "건조분말", "효소분해물", "발효물", "배양물", "가수분해물",
        "오일", "엑스", "추출", "분말", "파우더", "과립", "원말", "제제", "혼합제제", "혼합물", "사균", "생균", "고함량",
    ),
    foreign_preparations=("extractpowder", "extpwd", "extract", "ext", "concentratepowder", "concpwd", "concentrate", "conc", "hydrolysate", "ferment", "oil", "powder", "pwd"),
    qualities=("건조", "동결건조", "저온압착", "유기농", "국내재배", "국내산", "식품용", "정제", "천연", "활성"),
    parts={"씨앗": "seed", "열매": "fruit", "뿌리": "root", "줄기": "stem", "잎": "leaf", "꽃": "flower"},
    doubtful_parts=("꽃",),
    salts=("산화", "수산화", "구연산", "글루콘산", "탄산", "젖산", "황산", "염화", "인산", "푸마르산", "피콜린산"),
    bases=("아연", "칼슘", "크롬", "마그네슘", "망간", "셀레늄", "몰리브덴", "요오드", "철", "구리", "칼륨"),
    foreign_words={"칼슘": "calcium", "마그네슘": "magnesium", "아연": "zinc", "크롬": "chromium", "망간": "manganese", "셀레늄": "selenium", "몰리브덴": "molybdenum", "요오드": "iodine"},
    replaced_words={"비타민": "vitamin"},
    first_words={"락토바실러스": "lactobacillus"},
    first_word_aliases=("락토바실러스", "락토바실루스", "락토바실리우스", "유산균", "lactobacillus"),
    variants={"d2": "d", "d3": "d", "k1": "k", "k2": "k"},
    abbreviations={"vit": "vitamin"},
    lettered=("vit",),
    codes=r"(?i)\s+[a-z]{2}\d{6}$",
    details=r"\d{4}|^균주|^원료번호|수확$",
    foreign_name=r"(?:EN|영문명)\s*:?\s*([A-Za-z][A-Za-z0-9 \-]*)",
)

# The Korean keyboard: the key of every letter, and how Hangul syllables are built from letters.
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
TAILS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
KEYS = dict(zip("rRseEfaqQtTdwWczxvgkoiOjpuPhynbml", "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎㅏㅐㅑㅒㅓㅔㅕㅖㅗㅛㅜㅠㅡㅣ", strict=True))
DOUBLE = {"ㅗㅏ": "ㅘ", "ㅗㅐ": "ㅙ", "ㅗㅣ": "ㅚ", "ㅜㅓ": "ㅝ", "ㅜㅔ": "ㅞ", "ㅜㅣ": "ㅟ", "ㅡㅣ": "ㅢ", "ㄱㅅ": "ㄳ", "ㄴㅈ": "ㄵ", "ㄴㅎ": "ㄶ", "ㄹㄱ": "ㄺ", "ㄹㅁ": "ㄻ", "ㄹㅂ": "ㄼ", "ㄹㅅ": "ㄽ", "ㄹㅌ": "ㄾ", "ㄹㅍ": "ㄿ", "ㄹㅎ": "ㅀ", "ㅂㅅ": "ㅄ"}
SHIFTED = str.maketrans("ㄲㄸㅃㅆㅉㅒㅖ", "ㄱㄷㅂㅅㅈㅐㅔ")
# Revised Romanization, letter by letter as the list spells it.
ROMAN_LEADS = dict(zip(LEADS, "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" "), strict=True))
ROMAN_VOWELS = dict(zip(VOWELS, "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(), strict=True))
ROMAN_TAILS = dict(zip(TAILS, ["", *"k k k n n n t l k m l l l l l m p p t t ng t t k t p t".split()], strict=True))


def letters(text: str) -> str:
    """Hangul syllables as their letters, other characters as they are."""
    out = []
    for c in text:
        n = ord(c) - 0xAC00
        out.append(LEADS[n // 588] + VOWELS[n % 588 // 28] + TAILS[n % 28].strip() if 0 <= n < 11172 else c)
    return "".join(out)


def romanised(text: str) -> str:
    out = []
    for c in text:
        n = ord(c) - 0xAC00
        out.append(ROMAN_LEADS[LEADS[n // 588]] + ROMAN_VOWELS[VOWELS[n % 588 // 28]] + ROMAN_TAILS[TAILS[n % 28]] if 0 <= n < 11172 else c)
    return "".join(out)


def typed_hangul(keys: str) -> str | None:
    """What the keys give on the Korean keyboard; None if that is not whole syllables."""
    jamo = [KEYS.get(k) or KEYS.get(k.lower()) for k in keys]
    if not jamo or None in jamo:
        return None
    out, i = [], 0
    while i < len(jamo):
        if jamo[i] not in LEADS or i + 1 >= len(jamo) or jamo[i + 1] not in VOWELS:
            return None
        lead, vowel = jamo[i], jamo[i + 1]
        i += 2
        if i < len(jamo) and vowel + jamo[i] in DOUBLE:
            vowel = DOUBLE[vowel + jamo[i]]
            i += 1
        tail = " "
        if i < len(jamo) and jamo[i] in TAILS and not (i + 1 < len(jamo) and jamo[i + 1] in VOWELS):
            tail = jamo[i]
            i += 1
            if i < len(jamo) and tail + jamo[i] in DOUBLE and not (i + 1 < len(jamo) and jamo[i + 1] in VOWELS):
                tail = DOUBLE[tail + jamo[i]]
                i += 1
        out.append(chr(0xAC00 + LEADS.index(lead) * 588 + VOWELS.index(vowel) * 28 + TAILS.index(tail)))
    return "".join(out)


def slips(a: str, b: str, limit: int = 1) -> int:
    """Letters inserted, dropped, changed or exchanged with the neighbour between a and b; more than `limit` counts as limit + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return min(last[-1], limit + 1)


def spelled_alike(a: str, b: str, lettered: tuple[str, ...] = ()) -> int:
    """0 if equal, 1 within one slip, else 2. Digits and the Latin letters in Hangul names must agree; so must Latin names that begin with
    one of `lettered`, where one letter makes another name, and Latin names of less than six letters."""
    if a == b:
        return 0
    if re.sub(r"[^a-z0-9]", "", a) != re.sub(r"[^a-z0-9]", "", b) and re.search("[가-힣]", a + b):
        return 2
    if re.sub(r"\D", "", a) != re.sub(r"\D", "", b):
        return 2
    if not re.search("[가-힣]", a + b) and (min(len(a), len(b)) < 6 or a.startswith(lettered) or b.startswith(lettered)):
        return 2
    if slips(letters(a), letters(b)) <= 1:
        return 1
    # a syllable of `a` doubled, dropped or exchanged with its neighbour; one added or changed makes another name
    if len(a) == len(b) + 1:
        return 1 if any(a[i] == a[i - 1] and a[:i] + a[i + 1 :] == b for i in range(1, len(a))) else 2
    if len(a) == len(b) - 1:
        return 1 if slips(a, b) <= 1 else 2
    return 1 if len(a) == len(b) and sorted(a) == sorted(b) and slips(a, b) <= 1 else 2


@dataclass(frozen=True)
class Reading:
    """One way to read a name: kind h (Hangul), k (Hangul typed in the wrong mode, shift lost) or l (Latin); slips spent so far."""

    kind: str
    stem: str
    part: str
    cost: int


#: So many comparisons and endings a worker remembers, about 30 MB each.
REMEMBERED = 100_000


class Reader:
    """Reads names with a lexicon. Endings recur in name after name, so what they are near to is remembered."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.salted = {s + b: b for s in lexicon.salts for b in lexicon.bases}
        self.longest = max(map(len, lexicon.preparations), default=0)
        self.foreign_first = tuple(a for a in lexicon.first_word_aliases if a.isascii())
        self.of_length = {n: tuple(p for p in lexicon.preparations if len(p) > 1 and abs(len(p) - n) <= 1) for n in range(2, self.longest + 2)}
        self._compared: dict[tuple[str, str], int] = {}
        self._near_endings: dict[str, bool] = {}

    def alike(self, a: str, b: str) -> int:
        """`spelled_alike`, remembered. One slip cannot change both ends of a word of three characters or more."""
        if a[0] != b[0] and a[-1] != b[-1] and len(b) > 2:
            return 2
        found = self._compared.get((a, b))
        if found is None:
            if len(self._compared) > REMEMBERED:
                self._compared.clear()
            found = self._compared[a, b] = spelled_alike(a, b, self.lexicon.lettered)
        return found

    def near_preparation(self, tail: str) -> bool:
        """Whether `tail` without its first character is a preparation but for one slip; `tail` does not end with that preparation."""
        found = self._near_endings.get(tail)
        if found is None:
            if len(self._near_endings) > REMEMBERED:
                self._near_endings.clear()
            end = tail[1:]
            found = self._near_endings[tail] = any(not tail.endswith(p) and self.alike(end, p) == 1 for p in self.of_length[len(end)])
        return found

    def hangul(self, name: str, kind: str = "h") -> set[Reading]:
        lexicon = self.lexicon
        out: set[Reading] = set()
        start = {(name, 0)}
        for alias in lexicon.first_word_aliases:
            if name.startswith(alias) and len(name) > len(alias):
                start.add((name[len(alias):], 0))
            elif len(name) > len(alias) + 1 and len(alias) > 3:
                for n in (len(alias) - 1, len(alias), len(alias) + 1):
                    if self.alike(name[:n], alias) == 1:
                        start.add((name[n:], 1))
        if lexicon.first_word_aliases and re.match("l[가-힣]{2,}", name):
            start.add((name[1:], 0))
        seen, todo = set(), list(start)
        while todo:
            text, cost = todo.pop()
            if (text, cost) in seen or len(text) < 2:
                continue
            seen.add((text, cost))
            out.add(Reading(kind, text, "", cost))
            for q in lexicon.qualities:
                if text.startswith(q) and len(text) >= len(q) + 2:
                    todo.append((text[len(q):], cost))
            if text[-1] in "호0123456789":
                trimmed = re.sub(r"[0-9]+호?$", "", text)
                if trimmed != text and not re.search("[a-z][0-9]+$", text):
                    todo.append((trimmed, cost))
            for p in lexicon.preparations:
                if text.endswith(p):
                    todo.append((text[: -len(p)], cost))
            if cost == 0:
                for n in range(2, min(self.longest + 1, len(text) - 2) + 1):
                    if self.near_preparation(text[-n - 1 :]):
                        todo.append((text[:-n], 1))
            for part in lexicon.parts:
                if text.endswith(part) and len(text) >= len(part) + 2:
                    out.add(Reading(kind, text[: -len(part)], part, cost))
                elif cost == 0 and len(part) > 1 and len(text) >= len(part) + 2:
                    for n in (len(part), len(part) + 1):
                        if self.alike(text[-n:], part) == 1:
                            out.add(Reading(kind, text[:-n], part, 1))
            if base := self.salted.get(text):
                out.add(Reading(kind, base, "", cost))
            if text[-2:] in lexicon.variants:
                out.add(Reading(kind, text[:-2] + lexicon.variants[text[-2:]], "", cost))
        return out

    def latin(self, name: str) -> set[Reading]:
        lexicon = self.lexicon
        out, todo, seen = set(), [name], set()
        for short, word in lexicon.abbreviations.items():
            if name.startswith(short) and not name.startswith(word):
                todo.append(word + name[len(short):])
        for alias in self.foreign_first:
            if name.startswith(alias):
                todo.append(name[len(alias):])
        while todo:
            text = todo.pop()
            if text in seen or len(text) < 3:
                continue
            seen.add(text)
            out.add(Reading("l", text, "", 0))
            if text[-2:] in lexicon.variants and text[:-2] in lexicon.abbreviations.values():
                out.add(Reading("l", text[:-2] + lexicon.variants[text[-2:]], "", 0))
            for p in lexicon.foreign_preparations:
                if text.endswith(p) and len(text) >= len(p) + 3:
                    todo.append(text[: -len(p)])
            for part, foreign in lexicon.parts.items():
                if text.endswith(foreign) and len(text) >= len(foreign) + 3:
                    out.add(Reading("l", text[: -len(foreign)], part, 0))
        return out

    def readings(self, name: str) -> set[Reading]:
        """All readings of a name."""
        plain = unicodedata.normalize("NFKC", name)
        joined = re.sub(r"[^a-z0-9가-힣]", "", plain.lower())
        if not joined:
            return set()
        if re.search("[가-힣]", joined):
            return self.hangul(joined)
        out = self.latin(joined)
        if re.fullmatch(r"\s*[A-Za-z]+\s*", plain):
            if exact := typed_hangul(plain.strip()):
                out |= self.hangul(exact)
            if lost := typed_hangul(plain.strip().lower()):
                out |= {Reading("k", letters(r.stem).translate(SHIFTED), r.part, r.cost) for r in self.hangul(lost)}
        return out

    def entry_parts(self, name: str) -> tuple[str, str, str]:
        """(bare name, stem, part) of a list entry: without its first word and its preparation, and that cut into stem and part."""
        text = re.sub(r"[^a-z0-9가-힣]", "", name.lower())
        for first in self.lexicon.first_words:
            if text.startswith(first):
                text = text[len(first):]
        for p in sorted(self.lexicon.preparations, key=len, reverse=True):
            if text.endswith(p) and len(text) > len(p) + 1:
                text = text[: -len(p)]
                break
        stem, part = next(((text[: -len(p)], p) for p in self.lexicon.parts if text.endswith(p) and len(text) >= len(p) + 2), (text, ""))
        return text, stem, part

    def entry_readings(self, name: str, notes: str | None, bare: str, stem: str, part: str, siblings: int) -> set[tuple[str, str, str]]:
        """(kind, stem, part) of a list entry; `siblings`: entries of the list with its stem."""
        lexicon = self.lexicon
        rows: set[tuple[str, str, str]] = set()
        foreign = re.search(lexicon.foreign_name, notes or "")
        if part in lexicon.doubtful_parts and siblings < 2:
            said = lexicon.parts[part] in foreign[1] if foreign else None
            forms = [(stem, part)] if said else [(bare, "")] if said is False else [(stem, part), (bare, "")]
        else:
            forms = [(stem, part)]
        for s, p in forms:
            rows.add(("h", s, p))
            rows.add(("k", letters(s).translate(SHIFTED), p))
            latin = s
            for word, other in lexicon.replaced_words.items():
                latin = latin.replace(word, other)
            rows.add(("l", latin if re.search("[a-z]", s) else lexicon.foreign_words.get(s, romanised(s)), p))
        rows.add(("h", re.sub(r"[^a-z0-9가-힣]", "", name.lower()), ""))
        if foreign:
            text = re.sub(r"[^a-z0-9]", "", foreign[1].lower())
            rows.add(("l", text, ""))
            for r in self.latin(text):
                if (r.part or forms[0][1]) == forms[0][1] and (r.part or not forms[0][1]):
                    rows.add(("l", r.stem, r.part))
        return rows


@lru_cache(maxsize=20_000)
def pairs_of_letters(kind: str, stem: str) -> list[str]:
    """The set a stem is compared by: its pairs of neighbouring letters, ends included."""
    text = f"^{letters(stem)}$"
    return sorted({f"{kind}:{a}{b}" for a, b in zip(text, text[1:], strict=False)})


READING_SCHEMA = "name string, kind string, stem string, part string, cost int, tokens array<string>"


def _read_names(lexicon: Lexicon):  # noqa: ANN202
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lexicon)
        for frame in frames:
            rows = [(n, r.kind, r.stem, r.part, r.cost, pairs_of_letters(r.kind, r.stem)) for n in frame["name"] for r in reader.readings(n)]
            yield pd.DataFrame(rows, columns=["name", "kind", "stem", "part", "cost", "tokens"])

    return run


def list_readings(entries: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(id, entry, kind, ref_stem, ref_part, tokens, several) of the list (name, notes); several: 1 if the list has more entries of the
    same stem. Entries without a name are none; equal ones count once."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lexicon)
        for frame in frames:
            rows = [(n, t, *reader.entry_parts(n)) for n, t in zip(frame["name"], frame["notes"], strict=True)]
            yield pd.DataFrame(rows, columns=["name", "notes", "bare", "stem", "part"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lexicon)
        for frame in frames:
            rows = []
            for name, notes, bare, stem, part, siblings in frame.itertuples(index=False):
                rows += [(name, k, s, p, pairs_of_letters(k, s)) for k, s, p in sorted(reader.entry_readings(name, notes, bare, stem, part, siblings))]
            yield pd.DataFrame(rows, columns=["entry", "kind", "ref_stem", "ref_part", "tokens"])

    named = entries.select("name", "notes").where(F.col("name") != "").distinct()
    parts = write_through(named.mapInPandas(cut, "name string, notes string, bare string, stem string, part string"), "list-parts")
    siblings = parts.groupBy("stem").agg(F.count(F.lit(1)).alias("siblings"))
    rows = join_shuffled(parts, siblings, "stem").select("name", "notes", "bare", "stem", "part", "siblings")
    rows = rows.mapInPandas(read, "entry string, kind string, ref_stem string, ref_part string, tokens array<string>").drop_duplicates(["entry", "kind", "ref_stem", "ref_part"])
    rows = write_through(rows, "list-rows")
    several = rows.groupBy("kind", "ref_stem").agg((F.count_distinct("entry") > 1).cast("int").alias("several"))
    return write_through(join_shuffled(rows, several, ["kind", "ref_stem"]).withColumn("id", F.monotonically_increasing_id()), "list-readings")


#: Up to so many sets of the reference side are broadcast with their prefixes (about 1 KB a set).
FEW_SETS = 20_000


def similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Prefix-filter set-similarity join of (id, tokens) with (id, tokens): (left_id, right_id, jaccard) of all pairs with Jaccard
    similarity >= threshold. `right` is the reference side; tokens are ordered by their rarity in it, then by themselves."""
    eps = 1e-9
    every = right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))

    def ordered(side: DataFrame) -> DataFrame:
        flat = side.select("id", F.explode("tokens").alias("token")).join(every, "token", "left")
        sets = flat.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("f"), "token"))).alias("s"))
        sets = sets.select("id", F.transform("s", lambda x: x["token"]).alias("tokens"), F.size("s").alias("n"))
        prefix = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(eps)).cast("int") + 1
        return sets.select("id", "tokens", "n", prefix.alias("p"), F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("pos", "token"))

    a, b = ordered(left).alias("a"), ordered(right).alias("b")
    least = F.ceil((F.col("a.n") + F.col("b.n")) * F.lit(threshold / (1 + threshold)) - F.lit(eps))
    lengths = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(threshold) - F.lit(eps)
    position = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= least
    b = F.broadcast(b) if right.count() <= FEW_SETS else b.hint("merge")
    met = a.join(b, F.col("a.token") == F.col("b.token")).where(lengths & position)
    # a pair meets at every token its prefixes share: it counts at the first
    before = F.arrays_overlap(F.slice("a.tokens", F.lit(1), F.col("a.pos")), F.slice("b.tokens", F.lit(1), F.col("b.pos")))
    shared = F.size(F.array_intersect("a.tokens", "b.tokens"))
    return (
        met.where(~before).withColumn("shared", shared).where(F.col("shared") >= least)
        .select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), (F.col("shared") / (F.col("a.n") + F.col("b.n") - F.col("shared"))).alias("jaccard"))
    )


def names_of(value: Column, lexicon: Lexicon) -> Column:
    """The names in a free-entered value: its parts without quotes, bullets, amounts, shares, numbers and codes."""
    full = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = F.translate(value, full + "\u3000\u00a0", "".join(map(chr, range(0x21, 0x7F))) + "  ")
    plain = F.regexp_replace(plain, r"(?<![\p{L}\p{N}])(\p{Nd}{1,3}),(?=\p{Nd}{3}(?!\p{Nd}))", "$1")
    parts = F.split(plain, r"[,;/|()\[\]{}、\n\r]+")
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"[^\p{L}\p{N}%.]+", " ")))
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, rf"{lexicon.codes}|(?i)\s*\d[\d.]*\s*(mg|g|kg|mcg|ug|µg|ml|iu|cfu)$|\.", "")))
    detail = rf"^$|%|^\d|^제 ?\d|^[^\p{{L}}]*$|{lexicon.details}"
    return F.array_distinct(F.filter(parts, lambda p: ~p.rlike(detail)))


def map_names(values: DataFrame, entries: DataFrame, lexicon: Lexicon = SUPPLEMENTS, threshold: float = 0.34) -> DataFrame:
    """(value, entry): each distinct value of `values` (column `value`) with the list entry it stands for, '' if it stands for none.

    `entries`: the list (name, notes), of any size. Among several names in a value the one spelled best counts, then the first; if
    two entries fit a name equally well, or the list has several parts of a plant and the name says none of them, it stands for
    none. Null values are left out.
    """
    distinct = values.where(F.col("value").isNotNull()).select("value").distinct()
    named = write_through(distinct.select("value", F.posexplode_outer(names_of(F.col("value"), lexicon)).alias("pos", "name")), "names")
    # reading a name takes Python: the names, small as they are, are spread over all cores
    names = named.where(F.col("name").isNotNull()).select("name").distinct().repartition(4 * values.sparkSession.sparkContext.defaultParallelism)
    read = write_through(names.mapInPandas(_read_names(lexicon), READING_SCHEMA), "readings")
    reference = list_readings(entries, lexicon)

    def hashed(side: DataFrame) -> DataFrame:
        return side.select("id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"))

    stems = read.select("kind", "stem", "tokens").distinct().withColumn("id", F.struct("kind", "stem"))
    similar = similarity_join(hashed(stems), hashed(reference), threshold)
    listed = reference.select("id", "entry", "ref_stem", "ref_part", "several")
    met = similar.join(F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed.hint("merge"), F.col("right_id") == F.col("id"))
    # what one slip cannot do: change the length by more than one, or both ends of a word of three characters or more
    a, b = F.col("left_id.stem"), F.col("ref_stem")
    ends = (F.length(b) <= 2) | (F.left(a, F.lit(1)) == F.left(b, F.lit(1))) | (F.right(a, F.lit(1)) == F.right(b, F.lit(1)))
    met = met.where((F.abs(F.length(a) - F.length(b)) <= 1) & ends)
    lettered = lexicon.lettered
    alike = F.pandas_udf(lambda a, b: pd.Series([spelled_alike(x, y, lettered) for x, y in zip(a, b, strict=True)], dtype="int32"), "int", F.PandasUDFType.SCALAR)
    close = met.select(F.col("left_id.kind").alias("kind"), F.col("left_id.stem").alias("stem"), "entry", "ref_stem", "ref_part", "several", "jaccard").withColumn("slip", alike("stem", "ref_stem")).where("slip < 2")
    fits = join_shuffled(close, read.select("name", "kind", "stem", "part", "cost"), ["kind", "stem"]).where((F.col("several") == 0) | (F.col("part") == F.col("ref_part")))
    fits = fits.withColumn("total", F.col("cost") + F.col("slip")).where("total < 2")
    best = fits.groupBy("name", "entry").agg(F.min(F.struct("total", (-F.col("jaccard")).alias("j"))).alias("rank"))
    chosen = best.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("all"))
    first, second = F.col("all")[0], F.get("all", F.lit(1))
    chosen = chosen.where(second.isNull() | (second["rank"] != first["rank"])).select("name", first["entry"].alias("entry"), first["rank"]["total"].alias("total"))
    chosen = write_through(chosen, "mapped-names")
    mapped = look_up(named, chosen, ["name"], F.col("value"))
    return mapped.groupBy("value").agg(F.min(F.when(F.col("entry").isNotNull(), F.struct("total", "pos", "entry"))).alias("m")).select("value", F.coalesce("m.entry", F.lit("")).alias("entry"))


def with_entries(rows: DataFrame, mapped: DataFrame, value: str, key: str, hot_rows: int = 10_000) -> DataFrame:
    """`rows` joined with their value's entry. Values typed in more than `hot_rows` rows are looked up apart, so that no task holds them all."""
    mapped = write_through(mapped.withColumnRenamed("value", value), "mapped-values")
    hot = hot_groups(rows.select(value), [value], hot_rows).select(value)
    hot_entries = mapped.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot.hint("merge"), value, "left_semi").withColumnRenamed("entry", "hot_entry")
    marked = look_up(rows, hot_entries, [value], F.col(key))
    rest = join_shuffled(marked.where(F.col("hot_entry").isNull()).drop("hot_entry"), mapped, value)
    return rest.unionByName(marked.where(F.col("hot_entry").isNotNull()).withColumnRenamed("hot_entry", "entry"))
