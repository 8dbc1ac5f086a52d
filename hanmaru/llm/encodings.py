"""Garbled text from wrong character encoding.

The words of all distinct texts are counted once. For every distinct word its garbled forms under all encoding chains are
generated; a hash join of these forms with the words themselves tells which words of the corpus are forms of others. Which side of
such a pair is the garbled one is told by the two words (`evidence`); only where they do not tell, by the number of distinct texts
either is in. Documents then meet that table by their words.

Words are what stands between ASCII white space (no chain makes such characters out of others), with every run of digits
written as one 0, and besides these the runs of non-ASCII characters within them, for scripts without spaces.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanmaru.llm.pairing import join_shuffled, look_up
from hanmaru.session import write_through

#: Encodings texts were written in, encodings they are wrongly read in, and readings that are repeated.
WRITTEN = ("utf-8", "cp949", "cp932", "euc_jp", "gb18030", "big5", "cp1251", "koi8-r", "cp1252")
READ = ("latin-1", "cp1252", "cp1250", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp949", "cp932", "euc_jp", "gbk", "big5", "utf-8")
REPEATED = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251")

NON_ASCII = re.compile(r"[^\x00-\x7F]")
DIGITS = re.compile("[0-9]+")
#: A run of non-ASCII characters counts as a word of its own from this length; shorter ones also arise by chance.
LEAST_RUN = 4
#: An exchange of one letter for another between one-byte encodings is told from two ordinary words from this evidence on.
LEAST_EVIDENCE = 2


def _decoder(encoding: str):  # noqa: ANN202
    """Bytes to text as careless programs do: windows code pages pass undefined bytes through, others put U+FFFD."""
    if encoding.startswith("cp125"):
        table = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))
        return lambda raw: codecs.charmap_decode(raw, "strict", table)[0]
    return lambda raw: raw.decode(encoding, "replace")


DECODERS = {e: _decoder(e) for e in (*READ, *REPEATED)}


def garbled_forms_of(words: list[str]) -> list[set[str]]:
    """The forms of each word under the encoding chains, without the word itself and without forms in ASCII, which tell nothing. The
    words, free of line feeds, go through every chain together, one a line: no encoding has a line feed within a character."""
    out: list[set[str]] = [set() for _ in words]
    if not words:
        return out
    marks = [w.count("?") for w in words]
    whole = "\n".join(words)
    for written in WRITTEN:
        lines = whole.encode(written, "replace").split(b"\n")  # what cannot be written becomes a question mark
        able = [i for i, line in enumerate(lines) if line.count(b"?") == marks[i]]
        raw = b"\n".join([lines[i] for i in able])
        for read in READ if able else ():
            if read == written:
                continue
            for i, form in zip(able, DECODERS[read](raw).split("\n"), strict=True):
                if read != "utf-8" or "�" in form:  # bytes of another encoding are not UTF-8 by chance: this is a repair
                    out[i].add(form)
    once = whole.encode("utf-8", "surrogatepass")
    for first in REPEATED:
        again = DECODERS[first](once).encode("utf-8", "surrogatepass")
        for second in REPEATED:
            twice = DECODERS[second](again)
            forms = [twice]
            if first == second and first in ("latin-1", "cp1252"):
                forms.append(DECODERS[first](twice.encode("utf-8", "surrogatepass")))
            for text in forms:
                for mine, form in zip(out, text.split("\n"), strict=True):
                    mine.add(form)
    return [{f for f in mine if not f.isascii() and f != w} for w, mine in zip(words, out, strict=True)]


def garbled_forms(word: str) -> set[str]:
    """The forms of one word."""
    return garbled_forms_of([word])[0]


#: Non-ASCII marks of ordinary text; those that open stand before a word, those that close after it.
USUAL = frozenset("’‘“”„…–—·•°×℃%‰™®©№±÷²³、。「」『』【】〈〉《》〔〕・ー～　\u00a0\u202f«»¿¡")
OPENS, CLOSES = frozenset("«¿¡"), frozenset("»")
#: Marks that do not stand between two Latin letters.
APART = frozenset("²³±®©™×÷°")
#: Characters of the same word that ordinary text does not mix are of different groups here.
SCRIPTS = (("LATIN", "L"), ("CYRILLIC", "Y"), ("GREEK", "G"), ("HIRAGANA", "K"), ("KATAKANA", "K"), ("HANGUL", "H"), ("CJK", "C"))
SPELLED = frozenset("HKYG")
TOGETHER = frozenset({"aL", "aH", "aC", "aK", "CK", "CH"})


def _listed(char: str, *encodings: str) -> bool:
    for e in encodings:
        try:
            raw = char.encode(e)
        except UnicodeEncodeError:
            continue
        # other syllables than the common ones are spelled with eight bytes; the common half of GB 2312, JIS and Big5 stands before these lead bytes
        if e == "euc_kr" and len(raw) == 2 or e != "euc_kr" and raw[0] < {"gb2312": 0xD8, "euc_jp": 0xD0, "big5": 0xC9}[e]:
            return True
    return False


@lru_cache(maxsize=100_000)
def _char(char: str) -> tuple[str, int, str]:
    """(group, oddness, case) of a character. Groups: a ASCII letter, a script's letter, or empty for what is no letter."""
    case = "u" if char.isupper() else "l" if char.islower() else ""
    if char < "\x80":
        return ("a" if char.isalpha() else ""), 6 if unicodedata.category(char) == "Cc" else 0, case
    category = unicodedata.category(char)
    if char == "�" or category in ("Cc", "Cn", "Co", "Cs"):
        return "", 6, ""
    if char in USUAL or 0xFF01 <= ord(char) <= 0xFF5E or "\u2190" <= char <= "\u21ff" or "\u25a0" <= char <= "\u27bf":
        return "", 0, ""
    if not char.isalpha():
        return "", 2, ""
    name = unicodedata.name(char, "")
    group = next((g for start, g in SCRIPTS if name.startswith(start)), "O")
    if group == "H":
        return group, 0 if "ㄱ" <= char <= "ㅣ" or "가" <= char <= "힣" and _listed(char, "euc_kr") else 2, case
    if group == "C":
        return group, 0 if _listed(char, "gb2312", "euc_jp", "big5") else 2, case
    if name.startswith("HALFWIDTH") or group == "O":
        return ("K" if group == "O" and "KATAKANA" in name else group), 2, case
    return group, 1 if group == "L" and char > "ÿ" else 0, case


@lru_cache(maxsize=20_000)
def oddness(word: str) -> int:
    """How little a word looks like text as people write it: lost, control and private characters count 6; signs that are no usual marks,
    rare syllables and ideographs, letters of scripts that are not mixed side by side, a capital after a small letter and a mark
    on the wrong side of a letter or, of some, between letters and East Asian letters within an ASCII word count 2; letters beyond Latin-1 and words in capitals, 1; accented letters in a row, 1 and 2."""
    total, group, older, case, last, special, caps, small, run, before = 0, "", "", "", "", False, 0, 0, 0, ""
    for char in word:
        g, odd, c = _char(char)
        total += odd
        special = char >= "\x80"
        either = special or last >= "\x80"
        if either and g and group and g != group and g + group not in TOGETHER and group + g not in TOGETHER:
            total += 2
        elif either and c == "u" and case == "l":
            total += 2
        elif char in OPENS and (group or last >= "\x80") or g and last in CLOSES:
            total += 2
        elif g in ("a", "L") and last in APART and older in ("a", "L"):
            total += 2
        if g in ("H", "C", "K"):
            before = before if group in ("H", "C", "K") else group
        elif g == "a" and before == "a" and group in ("H", "C", "K"):
            total += 2
        run = run + 1 if g == "L" else 0
        total += min(max(run - 1, 0), 2)
        caps, small = caps + (special and c == "u"), small + (c == "l")
        older, group, case, last = group, g, c, char
    return total + (caps > 1 and not small)


def evidence(form: str, original: str) -> int:
    """How much more likely `form` is garbled `original` than the other way round, 0 if the two words do not tell. Bytes of one character
    read as several make more characters; that several make one, and the right one, does not happen by mistake."""
    more, less = len(NON_ASCII.findall(form)), len(NON_ASCII.findall(original))
    return oddness(form) - oddness(original) + 2 * ((more > less) - (more < less))


def hint(form: str, original: str) -> int:
    """For words that do not tell: 1 if letters or syllables became ideographs throughout, or the way cannot be gone backwards."""
    f, o = {_char(c)[0] for c in form}, {_char(c)[0] for c in original}
    if "C" in f | o and ("C" in f) != ("C" in o) and not (f if "C" in f else o) & SPELLED:
        return 1 if "C" in f else -1
    return int(original not in garbled_forms(form))


def words_of(text: Column) -> Column:
    """The distinct words with non-ASCII characters: whole words as `w:...`, runs of non-ASCII characters as `r:...`."""
    whole = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w.rlike(r"[^\x00-\x7F]"))
    whole = F.transform(whole, lambda w: F.regexp_replace(w, "[0-9]+", "0"))
    runs = F.regexp_extract_all(text, F.lit(rf"([^\x00-\x7F]{{{LEAST_RUN // 2},}})"), F.lit(1))
    return F.array_distinct(F.concat(F.transform(whole, lambda w: F.concat(F.lit("w:"), w)), F.transform(runs, lambda w: F.concat(F.lit("r:"), w))))


def letter_exchanged(form: str, original: str) -> bool:
    """Whether the two differ in one non-ASCII character and have no other: what one-byte encodings make of a single accent. (Two
    bytes read as one give an East Asian character.)"""
    if len(form) != len(original) or len(NON_ASCII.findall(form)) != 1 or len(NON_ASCII.findall(original)) != 1:
        return False
    return [max(a, b) < "\u2e80" for a, b in zip(form, original, strict=True) if a != b] == [True]


def _forms(words: list[str]) -> list[set[str]]:
    """Forms of words of the corpus (`w:...` or `r:...`) as such words."""
    out = []
    for word, forms in zip(words, garbled_forms_of([w[2:] for w in words]), strict=True):
        if word[0] == "w":
            out.append({"w:" + DIGITS.sub("0", f) for f in forms})  # some encodings write other scripts with digits
        else:
            out.append({"r:" + f for f in forms if len(f) >= LEAST_RUN})
    return out


def _generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            words, numbers = (batch.column(i).slice(start, 2000).to_pylist() for i in (0, 1))
            forms, sources = [], []
            for mine, number in zip(_forms(words), numbers, strict=True):
                forms += mine
                sources += [number] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(sources, pa.int64())], names=["form", "source"])


def _directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs that met by their hashes, those that are a form and its original, with the word as the garbled side. Where the words
    do not tell, the one in fewer distinct texts is."""
    for batch in batches:
        originals = sorted(set(batch.column(1).to_pylist()))
        forms = dict(zip(originals, _forms(originals), strict=True))
        found = []
        for word, original, original_texts, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            form, source = word[2:], original[2:]
            e = evidence(form, source) if word != original and word in forms[original] else -1
            if e < LEAST_EVIDENCE and letter_exchanged(form, source):
                e = -1
            found.append(e or int(original_texts > texts or original_texts == texts and hint(form, source) > 0))
        out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int32())], names=["word", "original", "original_texts", "evidence"])
        yield out.filter(pa.array([e > 0 for e in found], pa.bool_()))


def garbled_words(words: DataFrame) -> DataFrame:
    """(word, original, ambiguous): the garbled ones among the words (number, word, texts) of a corpus, each with the original the evidence is
    strongest for, of equal ones one that is no form itself, then that in most texts. `ambiguous`: characters were lost (U+FFFD) and several originals are possible, so
    the original cannot be had. Forms and words meet by 64-bit hashes, so a form costs two numbers in the shuffle; what met is verified.
    A word has some 70 forms, which the planner does not know: they are never broadcast."""
    hashed = words.withColumn("hash", F.xxhash64("word"))
    spread = words.select("word", "number").repartition(4 * words.sparkSession.sparkContext.defaultParallelism)
    forms = spread.mapInArrow(_generate, "form string, source bigint").select(F.xxhash64("form").alias("hash"), "source")
    met = join_shuffled(forms, hashed.select("hash", "word", "texts"), "hash").select("word", "texts", "source")
    originals = words.select(F.col("number").alias("source"), F.col("word").alias("original"), F.col("texts").alias("original_texts"))
    pairs = join_shuffled(met, originals, "source").select("word", "original", "original_texts", "texts")
    met = write_through(pairs.mapInArrow(_directed, "word string, original string, original_texts bigint, evidence int"), "directed")
    forms_too = met.select(F.col("word").alias("original")).distinct().withColumn("form_too", F.lit(1))
    ranked = join_shuffled(met, forms_too, "original", "left").withColumn("sound", F.col("form_too").isNull())
    best = ranked.groupBy("word").agg(F.max(F.struct("evidence", "sound", "original_texts", "original")).alias("best"), F.count_distinct("original").alias("originals"))
    return best.select("word", F.col("best.original").alias("original"), ((F.col("originals") > 1) & F.col("word").contains("�")).alias("ambiguous"))


def garbled_documents(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The keys of the documents with at least one garbled word, and the table of garbled words of the corpus.

    Null keys and null or empty texts are no documents; equal texts are found alike; nothing is found in an empty table.
    """
    cut = docs.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("key"), F.md5(F.col(text)).alias("digest"), words_of(F.col(text)).alias("words"))
    rows = write_through(cut.withColumn("place", F.monotonically_increasing_id()), "document-words")  # texts are cut into words once
    repeated = write_through(rows.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "repeated-texts")
    once = look_up(rows, repeated, ["digest"], F.col("place")).where(F.col("first").isNull() | (F.col("first") == F.col("place")))
    counts = once.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    words = write_through(counts.withColumn("number", F.monotonically_increasing_id()), "words")
    table = write_through(garbled_words(words), "garbled-words")
    found = look_up(rows.select("key", "place", F.explode("words").alias("word")), table.select("word"), ["word"], F.col("place"), "left_semi")
    return found.select(F.col("key").alias(key)).distinct(), table


def restored(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored_text, lost_words): the garbled documents with every garbled word replaced by its original; digits stay those of
    the document. Words whose characters were lost and words without a unique original stay as they are and are counted."""
    found, table = garbled_documents(docs, key, text)
    pieces = (
        docs.join(found, key, "left_semi")
        .select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"([ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\r]+)"), F.lit(1))).alias("pos", "piece"))
        .withColumn("word", F.concat(F.lit("w:"), F.regexp_replace("piece", "[0-9]+", "0")))
    )
    # white space and other ASCII pieces, half of all, take no part in the join
    plain_ascii = F.col("piece").rlike(r"^[\x00-\x7F]*$")
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in table.dtypes if c != "word"]
    met = look_up(pieces.where(~plain_ascii), table, ["word"], F.col(key)).unionByName(pieces.where(plain_ascii).select("*", *nothing))
    digits = F.regexp_extract_all("piece", F.lit("([0-9]+)"), F.lit(1))
    original = F.substring("original", 3, 1_000_000_000)
    plain = F.split(original, "[0-9]+", -1)
    filled = F.concat(
        F.get(plain, F.lit(0)),
        F.array_join(F.transform(F.slice(plain, 2, F.greatest(F.size(plain) - 1, F.lit(0))), lambda p, i: F.concat(F.coalesce(F.get(digits, i), F.lit("")), p)), ""),
    )
    good = F.col("original").isNotNull() & ~F.col("ambiguous") & (F.size(plain) == F.size(digits) + 1)
    return (
        met.withColumn("out", F.when(good, filled).otherwise(F.col("piece")))
        .groupBy(key)
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "").alias("restored_text"),
            F.count_if(F.col("original").isNotNull() & ~good | F.col("piece").contains("�")).alias("lost_words"),
        )
    )
