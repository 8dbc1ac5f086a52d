"""The pN_ queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanmaru.llm import characters, encodings, ledger, mixing, naming, packing, ranking, similar_sets
from hanmaru.llm.tokens import token_sizes
from hanmaru.operators.packed import split_packed
from hanmaru.plans.packed_values import P5_SQL
from hanmaru.session import scratch_path, write_through
from hanmaru.sources.tables import table


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[ledger.CopyLedger, DataFrame]:
    """Three batches of the match cache, by arrival, in a ledger; and the records with their keys."""
    rows = table(spark, sf_dir, "ingredient_match_cache_v2", "ingredient_id", "raw_ingredient", "created_at")
    keyed = write_through(
        rows.where(F.col("ingredient_id").isNotNull()).select(F.col("ingredient_id").alias("record_id"), ledger.canonical_key(F.col("raw_ingredient")).alias("key"), "created_at"),
        "keys",
    )
    book = ledger.CopyLedger(spark, scratch_path(spark, "ledger"), buckets=max(16, -(-keyed.count() // 1_000_000)))
    for i, batch in enumerate(ledger.batches_by_time(keyed, "created_at", 3)):
        book.apply(batch.select("record_id", "key"), f"arrival-{i}")
    return book, keyed


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus copies of the match cache: three batches by arrival go through the ledger, then every record meets its key."""
    book, keyed = _ledger(spark, sf_dir)
    return ledger.surplus_copies(book.read(), keyed).select(F.col("kept").alias("kept_ingredient_id"), F.col("copy").alias("copy_ingredient_id"))


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that is kept, and how many copies of it there are."""
    return _ledger(spark, sf_dir)[0].read().select(F.col("kept").alias("kept_ingredient_id"), "copies")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name typed into the match cache with the entry of the reference list it stands for."""
    entries = table(spark, sf_dir, "functional_category_map", F.col("functional_ingredient_name").alias("name"), "notes")
    rows = table(spark, sf_dir, "ingredient_match_cache_v2", "ingredient_id", "raw_ingredient", "matched_standard_name")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("raw_ingredient", "matched_standard_name")])).alias("f")
    typed = rows.select("ingredient_id", fields).select("ingredient_id", "f.field_name", "f.value").where(F.col("value") != "")
    mapped = naming.map_names(typed.select("value"), entries)
    found = naming.with_entries(typed, mapped, "value", "ingredient_id")
    return found.select("ingredient_id", "field_name", F.col("entry").alias("functional_ingredient_name")).distinct()


#: Full-width forms with the ordinary ones, for SQL's translate.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")

P1_GROUPS = (
    r"""
WITH keyed AS (
  SELECT ingredient_id, list_sort(list_filter(list_transform(
      regexp_split_to_array(lower(nfc_normalize(translate(raw_ingredient, '"""
    + FULL_WIDTH + "', '" + PLAIN
    + r"""'))), '[,;/|()\[\]{}<>、､〈〉《》「」『』【】〔〕
]'),
      lambda v: regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(\p{Nd})\.(\p{Nd})', '' || chr(57344) || '', 'g'),
        '(\p{Nd})\.(\p{Nd})', '' || chr(57344) || '', 'g'), '[^\p{L}\p{N}\p{M}' || chr(57344) || ']', '', 'g'), chr(57344), '.', 'g')),
    lambda v: v <> '')) AS parts
  FROM ingredient_match_cache_v2 WHERE raw_ingredient IS NOT NULL AND ingredient_id IS NOT NULL),
groups AS (SELECT parts, min(ingredient_id) AS kept, count(*) AS copies FROM keyed GROUP BY parts)
"""
)
P1_SQL = (
    P1_GROUPS
    + """SELECT DISTINCT g.kept AS kept_ingredient_id, k.ingredient_id AS copy_ingredient_id
FROM keyed k JOIN groups g ON k.parts = g.parts WHERE k.ingredient_id <> g.kept"""
)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar distinct targets of every base product."""
    rows = table(spark, sf_dir, "product_similarity_explanation_cache", "base_product_id", "target_product_id", "similarity_score")
    return ranking.top_n(rows, "base_product_id", "target_product_id", "similarity_score", 10).drop("similarity_score")


P3_SQL = """
WITH best AS (
  SELECT base_product_id, target_product_id, max(similarity_score) AS score FROM product_similarity_explanation_cache
  WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score) AND base_product_id IS NOT NULL AND target_product_id IS NOT NULL
  GROUP BY 1, 2),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY base_product_id ORDER BY score DESC, target_product_id) AS INTEGER) AS rank_no FROM best)
SELECT base_product_id, target_product_id, rank_no FROM ranked WHERE rank_no <= 10
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of products whose field reads the same in different characters, in both tables."""
    out = None
    for name, column in (("catalog_product_master", "raw_ingredients"), ("uploaded_product_master", "ocr_raw_text")):
        pairs = characters.same_reading_pairs(table(spark, sf_dir, name, "report_no", column), "report_no", column)
        part = pairs.select(F.lit(name).alias("table_name"), F.col("left_key").alias("left_report_no"), F.col("right_key").alias("right_report_no"))
        out = part if out is None else out.unionByName(part)
    return out


#: What other characters read as, written out for SQL apart from the operator's own tables: spaces and letters met in such fields.
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
GREEK, GREEK_READ = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"
CYRILLIC, CYRILLIC_READ = "АВЕКМНОРСТХЅІЈаеорсухѕіј", "ABEKMHOPCTXSIJaeopcyxsij"


def _reads_sql(column: str) -> str:
    seen = f"regexp_replace({column}, '[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]', '', 'g')"
    lines = f"replace(replace({seen}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"nfc_normalize(translate({lines}, '{FULL_WIDTH}{SPACES}{GREEK}{CYRILLIC}', '{PLAIN}{' ' * len(SPACES)}{GREEK_READ}{CYRILLIC_READ}'))"


P4_SQL = f"""
WITH f AS (
  SELECT DISTINCT 'catalog_product_master' AS table_name, report_no, raw_ingredients AS t FROM catalog_product_master WHERE raw_ingredients <> '' AND report_no IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'uploaded_product_master', report_no, ocr_raw_text FROM uploaded_product_master WHERE ocr_raw_text <> '' AND report_no IS NOT NULL),
c AS (SELECT table_name, report_no, t, {_reads_sql("t")} AS r FROM f)
SELECT DISTINCT a.table_name, a.report_no AS left_report_no, b.report_no AS right_report_no
FROM c a JOIN c b ON a.table_name = b.table_name AND a.r = b.r AND a.t <> b.t AND a.report_no < b.report_no
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of products with largely the same ingredients, and pairs of cached similarities with largely the same shared names."""
    fields = table(spark, sf_dir, "catalog_product_master", "report_no", "raw_ingredients").where(F.col("raw_ingredients") != "")
    packed = split_packed(fields, "raw_ingredients", "vals").select(F.lit("catalog").alias("scope"), F.col("report_no").alias("key"), F.array_join("vals", "\u0001").alias("v"))
    plain = characters.canonical_text(packed, "v", "v")
    catalog = plain.select("scope", "key", F.split(F.regexp_replace(F.lower("v"), r"[\s\p{Z}]+", ""), "\u0001").alias("tokens"))
    shared = F.col("shared_ingredients_json")
    names = F.from_json(shared, "array<string>")
    bare = F.array_distinct(F.filter(F.transform(names, lambda x: F.regexp_replace(F.lower(x), r"[\s\p{Z}]+", "")), lambda x: x != ""))
    cache = (
        table(spark, sf_dir, "product_similarity_explanation_cache", "base_product_id", "target_product_id", "shared_ingredients_json")
        .where(F.length(shared) - F.length(F.replace(shared, F.lit('"'), F.lit(""))) >= 12)  # six strings have twelve quotes
        .select(F.lit("cache").alias("scope"), F.concat_ws("|", "base_product_id", "target_product_id").alias("key"), bare.alias("tokens"))
        .where(F.size("tokens") >= 6)
    )
    return similar_sets.similar_pairs(catalog.unionByName(cache), 0.7)


P6_SQL = rf"""
WITH vals AS ({P5_SQL}),
catalog AS (
  SELECT DISTINCT 'catalog' AS scope, report_no AS key, regexp_replace(lower({_reads_sql("value_text")}), '[\s\p{{Z}}]+', '', 'g') AS v
  FROM vals WHERE table_name = 'catalog_product_master' AND report_no IS NOT NULL),
names AS (
  SELECT base_product_id || '|' || target_product_id AS key, unnest(CAST(CASE WHEN json_valid(shared_ingredients_json) THEN shared_ingredients_json END AS VARCHAR[])) AS v
  FROM product_similarity_explanation_cache),
cache AS (SELECT DISTINCT 'cache' AS scope, key, regexp_replace(lower(v), '[\s\p{{Z}}]+', '', 'g') AS v FROM names WHERE v IS NOT NULL),
large AS (SELECT key FROM cache WHERE v <> '' GROUP BY 1 HAVING count(*) >= 6),
s AS (SELECT * FROM catalog UNION ALL SELECT c.* FROM cache c JOIN large l ON c.key = l.key WHERE v <> ''),
n AS (SELECT scope, key, count(*) AS n FROM s GROUP BY 1, 2),
m AS (SELECT a.scope, a.key AS left_key, b.key AS right_key, count(*) AS i FROM s a JOIN s b ON a.scope = b.scope AND a.v = b.v AND a.key < b.key GROUP BY 1, 2, 3)
SELECT m.scope, left_key, right_key FROM m JOIN n x ON x.scope = m.scope AND x.key = left_key JOIN n y ON y.scope = m.scope AND y.key = right_key
WHERE 10 * i >= 7 * (x.n + y.n - i)
"""


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = table(spark, sf_dir, "pack_capacity").collect()  # a fixed table of a few rows
    return sorted((r.pack_name, r.capacity_tokens) for r in rows if r.capacity_tokens)


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each capacity."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", _capacities(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(write_through(p7_packs(spark, sf_dir), "packs"), _capacities(spark, sf_dir))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document is in the containers of each capacity once and as a whole, and the containers keep their capacity."""
    sized = write_through(token_sizes(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text"), "sizes")
    return packing.check_packs(write_through(p7_packs(spark, sf_dir), "packs"), sized, "doc_id", _capacities(spark, sf_dir))


P7_CHECKED_SQL = """
SELECT pack_name, doc_id, TRUE AS whole, TRUE AS kept FROM documents, pack_capacity WHERE text <> '' AND doc_id IS NOT NULL AND capacity_tokens > 0
"""


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, float, int]]:
    rows = table(spark, sf_dir, "source_mix_target").collect()  # a fixed table of a few rows
    return sorted((r.plan_name, r.source, r.target_share, r.max_repeats) for r in rows)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of each plan, piece by piece."""
    return mixing.mix_sources(table(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id", "text", "source", _targets(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens each source reached, and how often a document was used at most."""
    return mixing.share_report(write_through(p8_mix(spark, sf_dir), "mix"), "doc_id", _targets(spark, sf_dir))


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source of a plan reached its share and kept its repeats. Sources without documents leave their share to the others;
    a share may be off by a block of each source and by a 500th."""
    shares = p8_shares(spark, sf_dir)
    w = Window.partitionBy("plan_name")
    held = F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)
    total, goal = F.sum("tokens").over(w), held / F.sum(held).over(w)
    slack = mixing.BLOCK_TOKENS * F.count(F.lit(1)).over(w) + total / 500
    near = F.coalesce(F.abs(F.col("tokens") - goal * total) <= slack, F.lit(False))
    return shares.select("plan_name", "source", "target_share", (F.col("tokens") > 0).alias("used"), near.alias("near"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


P8_CHECKED_SQL = """
SELECT plan_name, source, target_share, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.text <> '' AND d.doc_id IS NOT NULL) AS used, TRUE AS near, TRUE AS repeats_kept
FROM source_mix_target t
"""


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text read in a wrong encoding."""
    return encodings.garbled_documents(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")[0]


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with their original text, as far as it can be had."""
    return encodings.restored(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_copies, p2_found, p3_found, p4_found, p6_found, p7_packs, p7_fill, p7_checked, p8_mix, p8_shares, p8_checked, p9_found, p9_restored)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL, "p1_copies": P1_GROUPS + "SELECT kept AS kept_ingredient_id, copies FROM groups", "p3_found": P3_SQL, "p4_found": P4_SQL, "p6_found": P6_SQL,
        "p7_checked": P7_CHECKED_SQL, "p8_checked": P8_CHECKED_SQL,
    }
