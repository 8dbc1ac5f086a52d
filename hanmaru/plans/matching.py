"""Entity matching over the match cache, the reference list and the embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanmaru.functions import text
from hanmaru.operators import matching
from hanmaru.session import write_through
from hanmaru.sources.tables import table

K = "regexp_replace(lower(coalesce({}, '')), '[^0-9a-z가-힣]', '', 'g')"
STRIP = (
    "trim(regexp_replace(regexp_replace(regexp_replace({}, '\\([^()]*\\)|\\[[^\\[\\]]*\\]|（[^（）]*）', ' ', 'g'), "
    "'제\\s*\\d{{4}}-\\d+\\s*호|\\d+(\\.\\d+)?\\s*%', ' ', 'g'), '\\s+', ' ', 'g'))"
)


#: Endings of preparation that two names may differ in.
SUFFIXES = ["추출분말", "추출물", "농축분말", "분말", "제제"]
FOREIGN = r"(?:EN|영문명):? ([A-Za-z][A-Za-z ]*)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ingredient_match_cache_v2", "ingredient_id", "raw_ingredient", "normalized_raw", "matched_standard_name", "confidence")
    return rows.select(
        "ingredient_id",
        text.key_of(F.col("normalized_raw")).alias("normal_key"),
        text.key_of(F.col("raw_ingredient")).alias("raw_key"),
        text.key_of(text.strip_brackets(F.coalesce("raw_ingredient", F.lit("")))).alias("bare_key"),
        text.key_of(F.col("matched_standard_name")).alias("name_key"),
        "confidence",
    ).withColumn("stem_key", text.strip_suffixes(F.col("bare_key"), SUFFIXES))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "functional_category_map", "functional_ingredient_name", "category_main", "notes")
    return rows.select(
        F.col("functional_ingredient_name").alias("entry"), text.key_of(F.col("functional_ingredient_name")).alias("entry_key"), "category_main",
        text.key_of(F.regexp_extract(F.coalesce("notes", F.lit("")), FOREIGN, 1)).alias("foreign_key"),
    )


def _tiers(spark: SparkSession, d: str, names: DataFrame) -> list[tuple[str, DataFrame, Column, list[Column]]]:
    """Normalised key, raw key, the key without brackets, that without endings where only one entry has it, an alias that means one
    standard name, the foreign name, the standard name, the standard name most trusted rows of the same bare key have, and a key of
    five letters or more within the bare one (the longest first)."""
    entries = write_through(_entries(spark, d), "entries")
    listed, zero = matching.small(entries), [F.lit(0)]
    stems = matching.unique_aliases(entries.select(text.strip_suffixes(F.col("entry_key"), SUFFIXES).alias("stem"), "entry"), "stem", "entry")
    known = names.where((F.col("bare_key") != "") & (F.col("name_key") != "")).select("bare_key", "name_key", "confidence")
    aliases = matching.unique_aliases(known.select(F.col("bare_key").alias("alias_key"), "name_key"), "alias_key", "name_key")
    aliases = aliases.join(listed, F.col("name_key") == F.col("entry_key")).select("alias_key", "entry")
    trusted = known.where(F.col("confidence") >= 0.9).groupBy(F.col("bare_key").alias("trusted_key"), "name_key").agg(F.count(F.lit(1)).alias("rows"), F.max("confidence").alias("best"))
    trusted = trusted.join(listed, F.col("name_key") == F.col("entry_key")).select("trusted_key", "entry", "rows", "best")
    bare = names.where(F.length("bare_key") >= 5).select("bare_key").distinct()
    within = matching.contained(bare, "bare_key", entries.where(F.length("entry_key") >= 5), "entry_key", 5).where(F.contains("bare_key", F.col("entry_key")))
    within = within.select(F.col("bare_key").alias("whole_key"), "entry", F.length("entry_key").alias("len"))
    foreign = matching.small(entries.where("foreign_key <> ''"))
    return [
        ("normal", listed, F.col("normal_key") == F.col("entry_key"), zero),
        ("raw", listed, F.col("raw_key") == F.col("entry_key"), zero),
        ("bare", listed, F.col("bare_key") == F.col("entry_key"), zero),
        ("stem", matching.small(stems), F.col("stem_key") == F.col("stem"), zero),
        ("alias", aliases, F.col("bare_key") == F.col("alias_key"), zero),
        ("foreign", foreign, F.col("bare_key") == F.col("foreign_key"), zero),
        ("standard", listed, F.col("names.name_key") == F.col("entry_key"), zero),
        ("trusted", trusted, F.col("bare_key") == F.col("trusted_key"), [-F.col("rows"), -F.round("best", 6)]),
        ("within", within, F.col("bare_key") == F.col("whole_key"), [-F.col("len")]),
    ]


def cascade_match(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the match cache with the entry of the first tier that finds one."""
    names = write_through(_names(spark, d), "keys")  # every tier reads them
    return matching.cascade(names.alias("names"), "ingredient_id", _tiers(spark, d, names))


def cascade_trace(spark: SparkSession, d: str) -> DataFrame:
    """What every tier finds for every row of the match cache."""
    names = write_through(_names(spark, d), "keys")
    return matching.trace(names.alias("names"), "ingredient_id", _tiers(spark, d, names)).select("ingredient_id", "tier_name", "entry", "place")


def unique_alias(spark: SparkSession, d: str) -> DataFrame:
    rows = _names(spark, d).where((F.col("bare_key") != "") & (F.col("name_key") != "")).select("bare_key", "name_key")
    return matching.unique_aliases(rows, "bare_key", "name_key")


def lexical_candidates(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d).where(F.col("name_key") != "").select("name_key")
    return matching.lexical_candidates(names, "name_key", _entries(spark, d), "entry_key", "entry", 3, SUFFIXES)


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Lexical candidates merged with the nearest by letter vectors, of three times as many those that share two neighbouring letters."""
    names = write_through(_names(spark, d).where(F.length("name_key") >= 3).select("name_key").distinct(), "keys")
    entries = write_through(_entries(spark, d).select("entry", "entry_key"), "entries")
    lexical = matching.lexical_candidates(names, "name_key", entries, "entry_key", "entry", 3, SUFFIXES).select("name_key", "entry", "lexical")
    listed = write_through(entries.select(F.col("entry").alias("t"), F.col("entry_key").alias("k")).distinct().withColumn("id", -1 - F.row_number().over(Window.orderBy("t"))), "list")  # the fixed list
    asked = write_through(names.select(F.col("name_key").alias("t"), F.col("name_key").alias("k")).withColumn("id", F.monotonically_increasing_id()), "names")
    vectors = [x.select("id", matching.letter_vector(F.col("k")).alias("v")) for x in (asked, listed)]
    near = matching.nearest(vectors[0], vectors[1], "id", "v", 9)
    near = near.join(asked.select(F.col("id").alias("query_id"), F.col("t").alias("name_key")), "query_id").join(listed.select(F.col("id").alias("neighbour_id"), F.col("t").alias("entry"), "k"), "neighbour_id")
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    near = near.where((F.length("k") >= 2) & F.arrays_overlap(pairs(F.col("name_key")), pairs(F.col("k")))).select("name_key", "entry", F.col("cosine").alias("vector"))
    return matching.merge_candidates("name_key", "entry", 3, lexical=lexical, vector=near)


def hybrid_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)


def hybrid_decision(spark: SparkSession, d: str) -> DataFrame:
    """Names whose best candidate is good enough to be taken, and by which list."""
    return matching.accepted(_hybrid(spark, d), "name_key", "entry", "lexical", "vector")


def fuzzy_pairs(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(name_key, entry, ratio): names and entries whose matching ratio is 0.78 or more. Twice the matched characters over both lengths is the
    ratio, and no more can match than the characters of either that the other has, so the join drops only pairs below it."""
    n, e = F.length("name_key"), F.length("entry_key")
    common = F.least(n - F.length(F.expr("translate(name_key, entry_key, '')")), e - F.length(F.expr("translate(entry_key, name_key, '')")))
    least = 0.7799995 * (n + e)  # what rounds to 0.78
    met = names.distinct().join(matching.small(entries), (2 * F.least(n, e) >= least) & (2 * common >= least))
    return met.withColumn("ratio", F.round(text.matching_ratio(F.col("name_key"), F.col("entry_key")), 6)).where(F.col("ratio") >= 0.78).select("name_key", "entry", "ratio")


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Names and entries whose matching ratio is 0.78 or more."""
    return fuzzy_pairs(_names(spark, d).where(F.length("name_key") >= 3).select("name_key"), _entries(spark, d))


def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    return matching.nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 5).select("query_id", "neighbour_id", F.round("cosine", 6).alias("cosine"), "rk")


def missing_targets(spark: SparkSession, d: str) -> DataFrame:
    """Per base product the targets from which no row leads back to it (`way back`), and those that neither product table has (`product`)."""
    cache = table(spark, d, "product_similarity_explanation_cache", "base_product_id", "target_product_id").where("base_product_id is not null and target_product_id is not null").distinct()
    back = cache.select(F.col("target_product_id").alias("base_product_id"), F.col("base_product_id").alias("target_product_id"))
    one_way = cache.join(back, ["base_product_id", "target_product_id"], "left_anti").groupBy("base_product_id").agg(F.count(F.lit(1)).alias("n")).withColumn("lack", F.lit("way back"))
    catalog = table(spark, d, "catalog_product_master", "report_no").select(F.concat(F.lit("catalog::"), "report_no").alias("target_product_id"))
    uploads = table(spark, d, "uploaded_product_master", F.col("product_id").alias("target_product_id"))
    unknown = cache.select("target_product_id").distinct().join(catalog.unionByName(uploads).distinct(), "target_product_id", "left_anti")
    no_product = cache.join(unknown, "target_product_id").groupBy("base_product_id").agg(F.count(F.lit(1)).alias("n")).withColumn("lack", F.lit("product"))
    return one_way.unionByName(no_product)


def _stem(column: str, rounds: int = 6) -> str:
    """Endings off a key until none is left, written out for SQL as nested calls (a key of the tables has fewer than six)."""
    for _ in range(rounds):
        column = f"regexp_replace({column}, '^(.{{2,}}?)({'|'.join(SUFFIXES)})$', '\\1')"
    return column


_NAMES = (
    f"WITH names AS (SELECT ingredient_id, {K.format('normalized_raw')} AS normal_key, {K.format('raw_ingredient')} AS raw_key, {K.format(STRIP.format('raw_ingredient'))} AS bare_key, "
    f"{K.format('matched_standard_name')} AS name_key, confidence FROM ingredient_match_cache_v2),\n"
    f"entries AS (SELECT functional_ingredient_name AS entry, {K.format('functional_ingredient_name')} AS entry_key, category_main, "
    f"lower(replace(regexp_extract(coalesce(notes, ''), '{FOREIGN}', 1), ' ', '')) AS foreign_key FROM functional_category_map)"
)
_LEX = """, n AS (SELECT DISTINCT name_key FROM names WHERE {where}),
lex AS (
  SELECT name_key, entry, max(CASE WHEN name_key = entry_key THEN 1.0 WHEN {stem_n} = {stem_e} THEN 0.95 WHEN len(entry_key) >= 4 AND len(name_key) >= 4 AND contains(name_key, entry_key) THEN 0.78
    WHEN len(name_key) >= 4 AND contains(entry_key, name_key) THEN 0.7 END) AS lexical FROM n, entries GROUP BY 1, 2 HAVING lexical IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY lexical DESC, entry) AS rk FROM lex QUALIFY rk <= 3)"""
_HITS = f""", stems AS (SELECT {_stem('entry_key')} AS stem, min(entry) AS entry FROM entries GROUP BY 1 HAVING count(DISTINCT entry) = 1),
known AS (SELECT bare_key, names.name_key, names.confidence FROM names WHERE bare_key <> '' AND names.name_key <> ''),
aliases AS (SELECT a.bare_key, e.entry FROM (SELECT bare_key, min(name_key) AS name_key FROM known GROUP BY 1 HAVING count(DISTINCT known.name_key) = 1) a JOIN entries e ON a.name_key = e.entry_key),
trusted AS (SELECT bare_key, e.entry, count(*) AS n, max(confidence) AS best FROM known k JOIN entries e ON k.name_key = e.entry_key WHERE confidence >= 0.9 GROUP BY 1, 2),
hits AS (
  SELECT ingredient_id, 0 AS tier, 'normal' AS tier_name, entry, 0 AS o1, 0.0 AS o2 FROM names JOIN entries ON normal_key = entry_key
  UNION ALL SELECT ingredient_id, 1, 'raw', entry, 0, 0 FROM names JOIN entries ON raw_key = entry_key
  UNION ALL SELECT ingredient_id, 2, 'bare', entry, 0, 0 FROM names JOIN entries ON bare_key = entry_key
  UNION ALL SELECT ingredient_id, 3, 'stem', entry, 0, 0 FROM names JOIN stems ON {_stem('bare_key')} = stem
  UNION ALL SELECT ingredient_id, 4, 'alias', entry, 0, 0 FROM names JOIN aliases ON names.bare_key = aliases.bare_key
  UNION ALL SELECT ingredient_id, 5, 'foreign', entry, 0, 0 FROM names JOIN entries ON bare_key = foreign_key AND foreign_key <> ''
  UNION ALL SELECT ingredient_id, 6, 'standard', entry, 0, 0 FROM names JOIN entries ON name_key = entry_key
  UNION ALL SELECT ingredient_id, 7, 'trusted', entry, -n, -round(best, 6) FROM names JOIN trusted ON names.bare_key = trusted.bare_key
  UNION ALL SELECT ingredient_id, 8, 'within', entry, -len(entry_key), 0 FROM names JOIN entries ON len(entry_key) >= 5 AND contains(bare_key, entry_key)),
once AS (SELECT ingredient_id, tier, tier_name, entry, min(o1) AS o1, min(o2) AS o2 FROM hits GROUP BY 1, 2, 3, 4),
placed AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id, tier ORDER BY o1, o2, entry) AS place FROM once)"""
_PAIRS = "list_transform(range(1, len({0})), lambda i: {0}[i:i+1])"
_VECTOR = "list_transform(range(0, 64), lambda j: CAST(len(list_filter(list_transform(range(1, len({0}) + 2), lambda i: (unicode(('^' || {0} || '$')[i:i]) * 31 + unicode(('^' || {0} || '$')[i+1:i+1])) % 64), lambda p: p = j)) AS DOUBLE))"
_HYBRID = (
    _NAMES
    + _LEX.format(where="len(name_key) >= 3", stem_n=_stem("name_key"), stem_e=_stem("entry_key"))
    + f""", nv AS (SELECT name_key, {_VECTOR.format('name_key')} AS v FROM n),
ev AS (SELECT DISTINCT entry, entry_key, {_VECTOR.format('entry_key')} AS v FROM entries WHERE entry_key <> ''),
cos AS (SELECT name_key, entry, entry_key, round(list_cosine_similarity(nv.v, ev.v), 6) AS vector, row_number() OVER (PARTITION BY name_key ORDER BY round(list_cosine_similarity(nv.v, ev.v), 6) DESC, entry DESC) AS p FROM nv, ev),
near AS (SELECT name_key, entry, vector FROM cos WHERE p <= 9 AND len(entry_key) >= 2 AND len(list_intersect({_PAIRS.format('name_key')}, {_PAIRS.format('entry_key')})) > 0),
u AS (SELECT name_key, entry, lexical, 0.0 AS vector FROM best UNION ALL SELECT name_key, entry, 0.0, vector FROM near),
m AS (SELECT name_key, entry, CAST(max(lexical) AS DOUBLE) AS lexical, CAST(max(vector) AS DOUBLE) AS vector FROM u GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY greatest(lexical, vector) DESC, lexical DESC, vector DESC, entry) AS rk FROM m QUALIFY rk <= 3)
"""
)

def _match(a: str, b: str) -> str:
    """The longest common passage of two texts in SQL: its length k and where it begins in the first, negated, so that the first counts."""
    return f"list_max(list_transform(range(1, len({a}) + 1), lambda i: {{'k': coalesce(list_max(list_filter(range(1, len({a}) - i + 2), lambda k: contains({b}, {a}[i:i+k-1]))), 0), 'i': -i}}))"


def ratio_sql(pairs: str, keys: str) -> str:
    """CTEs for SQL: `ratios` (the columns `keys`, ratio) of the relation `pairs` (keys, a, b): common passages are matched, the longest first,
    then what is before and after them on both sides."""
    return f"""seg AS (
  SELECT {keys}, a, b, {_match('a', 'b')} AS m, 0 AS depth FROM {pairs}
  UNION ALL SELECT {keys}, a, b, {_match('a', 'b')}, depth FROM (
    SELECT {keys}, depth + 1 AS depth, CASE WHEN side = 0 THEN a[1:-m.i-1] ELSE a[m.k-m.i:] END AS a,
      CASE WHEN side = 0 THEN left(b, instr(b, a[-m.i:m.k-m.i-1]) - 1) ELSE substr(b, instr(b, a[-m.i:m.k-m.i-1]) + m.k) END AS b
    FROM seg, (VALUES (0), (1)) AS sides(side) WHERE m.k > 0) WHERE a <> '' AND b <> ''),
sums AS (SELECT {keys}, sum(m.k) AS matched FROM seg GROUP BY ALL),
ratios AS (SELECT p.*, round(2.0 * matched / (len(a) + len(b)), 6) AS ratio FROM sums JOIN {pairs} p USING ({keys}))"""


QUERIES = {f.__name__: f for f in (cascade_match, cascade_trace, unique_alias, lexical_candidates, hybrid_candidates, hybrid_decision, fuzzy_names, embedding_topk, missing_targets)}
SQL = {
    "cascade_match": _NAMES
    + _HITS
    + """, best AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY tier, place) AS rn FROM placed QUALIFY rn = 1)
SELECT n.ingredient_id, b.tier_name, b.entry FROM names n LEFT JOIN best b ON n.ingredient_id = b.ingredient_id""",
    "cascade_trace": _NAMES + _HITS + " SELECT ingredient_id, tier_name, entry, CAST(place AS INTEGER) AS place FROM placed",
    "unique_alias": _NAMES + " SELECT bare_key, min(name_key) AS name_key FROM names WHERE bare_key <> '' AND name_key <> '' GROUP BY 1 HAVING count(DISTINCT names.name_key) = 1",
    "lexical_candidates": _NAMES + _LEX.format(where="name_key <> ''", stem_n=_stem("name_key"), stem_e=_stem("entry_key")) + " SELECT name_key, entry, CAST(lexical AS DOUBLE) AS lexical, rk FROM best",
    "hybrid_candidates": _HYBRID + "SELECT * FROM top",
    "hybrid_decision": _HYBRID
    + """, d AS (SELECT *, max(CASE WHEN rk > 1 THEN vector END) OVER (PARTITION BY name_key) AS second FROM top)
SELECT name_key, entry, CASE WHEN lexical >= 0.95 THEN 'lexical' ELSE 'vector' END AS method FROM d WHERE rk = 1 AND (lexical >= 0.95 OR vector >= 0.92 AND round(vector - coalesce(second, 0), 6) >= 0.08)""",
    "fuzzy_names": _NAMES.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, pairs AS (SELECT DISTINCT name_key, entry, name_key AS a, entry_key AS b FROM names, entries WHERE len(name_key) >= 3 AND 2 * least(len(name_key), len(entry_key)) >= 0.77 * (len(name_key) + len(entry_key))),
"""
    + ratio_sql("pairs", "name_key, entry")
    + " SELECT name_key, entry, ratio FROM ratios WHERE ratio >= 0.78",
    "embedding_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, round(list_cosine_similarity(q.e, c.e), 6) AS cosine,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, c.e), 6) DESC, c.vec_id) AS rk
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rk <= 5""",
    "missing_targets": """WITH c AS (SELECT DISTINCT base_product_id AS b, target_product_id AS t FROM product_similarity_explanation_cache WHERE base_product_id IS NOT NULL AND target_product_id IS NOT NULL)
SELECT b AS base_product_id, count(*) AS n, 'way back' AS lack FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.b = c.t AND x.t = c.b) GROUP BY 1
UNION ALL SELECT b, count(*), 'product' FROM c WHERE NOT EXISTS (SELECT 1 FROM catalog_product_master p WHERE 'catalog::' || p.report_no = t) AND NOT EXISTS (SELECT 1 FROM uploaded_product_master u WHERE u.product_id = t) GROUP BY 1""",
}
