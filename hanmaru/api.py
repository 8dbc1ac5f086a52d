"""The engine's Python interface: search, profiles, similar products, paging, matching and recommendations over a folder of tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hanmaru.functions import labels, text
from hanmaru.operators import matching, rows, vectors
from hanmaru.operators.packed import split_packed
from hanmaru.plans.profiles import search_names
from hanmaru.session import kept_for, write_through
from hanmaru.sources.tables import table

def ingredient_names(values: Column) -> Column:
    """Keys of packed values without brackets, doses and codes; each once, in order."""
    bare = F.transform(values, lambda v: F.regexp_replace(text.strip_brackets(v), r"(?i)\s[a-z]{2}\d{6}$|\s*[\d,.]+\s*(mg|mcg|g)$", ""))
    return F.array_distinct(F.filter(F.transform(bare, text.key_of), lambda k: k != ""))


@dataclass(frozen=True)
class Engine:
    """All methods return lazy DataFrames; a limit or page is the caller's own."""

    spark: SparkSession
    folder: str

    def _products(self) -> DataFrame:
        catalog = table(self.spark, self.folder, "catalog_product_master", "report_no", "product_name", "company_name", "raw_ingredients", "imported_at")
        catalog = rows.latest_by_key(catalog.where(F.col("report_no") != ""), ["report_no"], "imported_at").drop("imported_at")
        uploads = table(self.spark, self.folder, "uploaded_product_master", "report_no", "product_name", "raw_ingredients", "product_id")
        both = rows.union_padded(("catalog", catalog.withColumn("product_id", F.concat(F.lit("catalog::"), "report_no"))), ("upload", uploads))
        return both.select("product_id", "report_no", "product_name", "company_name", "raw_ingredients", "origin")

    def product_ids(self) -> DataFrame:
        """The ids of all products."""
        return self._products().select("product_id")

    def search_products(self, query: str, limit: int = 20) -> DataFrame:
        """Products whose name's key equals or contains the query's, then those spelled alike (`plans.profiles.search_names`)."""
        return search_names(self._products(), "product_name", query, limit)

    def product(self, report_no: str) -> DataFrame:
        """The product of a report number, of the catalogue if it is there, else of the uploads."""
        return self._products().where(F.col("report_no") == report_no).orderBy("origin").limit(1)

    def catalog_page(self, number: int = 1, size: int = 20, query: str = "") -> DataFrame:
        """A page of products by name and id, only those whose name contains the query."""
        found = self._products()
        return rows.page(found.where(F.contains("product_name", F.lit(query))) if query else found, [F.col("product_name"), F.col("product_id")], number, size)

    def ingredients(self, number: int = 1, size: int = 50) -> DataFrame:
        """A page of the reference list."""
        listed = table(self.spark, self.folder, "functional_category_map", "functional_ingredient_name", "category_main", "confidence")
        return rows.page(listed, [F.col("functional_ingredient_name")], number, size)

    def match_ingredients(self, names: list[str], k: int = 3) -> DataFrame:
        """The k best entries of the reference list for each name by containment of keys."""
        asked = self.spark.createDataFrame([(n,) for n in names], "name string").withColumn("name_key", text.key_of(F.col("name")))
        listed = table(self.spark, self.folder, "functional_category_map", "functional_ingredient_name")
        entries = listed.select(F.col("functional_ingredient_name").alias("entry"), text.key_of(F.col("functional_ingredient_name")).alias("entry_key"))
        best = matching.lexical_candidates(asked.where("name_key <> ''"), "name_key", entries, "entry_key", "entry", k)
        return asked.join(best, "name_key").select("name", "entry", "lexical", "rk")

    def _paths(self) -> list[str]:
        return [f"{self.folder}/{n}.parquet" for n in ("catalog_product_master", "uploaded_product_master")]

    def vectors(self) -> DataFrame:
        """(product_id, origin, item, weight, total): the ingredients of every product, weighted by how rare they are; computed once for the files
        of the products."""
        def build() -> DataFrame:
            held = split_packed(self._products(), "raw_ingredients", "values").select("product_id", "origin", F.explode(ingredient_names(F.col("values"))).alias("item")).distinct()
            held = write_through(held, "held")
            weights = vectors.idf(held.select(F.col("product_id").alias("owner"), "item")).select("item", F.col("idf").alias("weight"))
            weighed = held.join(weights, "item")
            return weighed.join(weighed.groupBy("product_id").agg(F.sum("weight").alias("total")), "product_id").select("product_id", "origin", "item", "weight", "total")

        return kept_for(self.spark, "ingredient-vectors", self._paths(), build)

    def _scored(self, asked: DataFrame) -> DataFrame:
        """(product_id, origin, score, shared) of products that share an item with `asked` (item), which is of one product or request: weighted
        Jaccard, where items no product has weigh as much as the rarest."""
        every = self.vectors()
        rarest = every.agg(F.max("weight")).first()[0] or 1.0  # one number
        mine = asked.join(every.select("item", "weight").distinct(), "item", "left").select("item", F.coalesce("weight", F.lit(rarest)).alias("own"))
        total = mine.agg(F.sum("own")).first()[0] or 0.0  # one number
        met = every.join(F.broadcast(mine), "item")  # the items of one product
        sums = met.groupBy("product_id", "origin").agg(F.sum("weight").alias("s"), F.max("total").alias("t"), F.array_sort(F.collect_list("item")).alias("shared"))
        return sums.select("product_id", "origin", F.round(F.col("s") / (F.col("t") + total - F.col("s")), 6).alias("score"), "shared")

    def similar(self, product_id: str, k: int = 10, refresh: bool = False) -> DataFrame:
        """The k most similar products of a product: those kept in the similarity cache, each at its best score; where it has none, or with
        `refresh`, they are computed from the products' ingredients and kept for the next time, as long as the tables are the same."""
        kept = table(self.spark, self.folder, "product_similarity_explanation_cache", "base_product_id", "target_product_id", "similarity_score", "created_at").where(F.col("base_product_id") == product_id)
        valid = kept.where(F.col("similarity_score").isNotNull() & ~F.isnan("similarity_score"))
        if not refresh and valid.limit(1).count():
            best = rows.first_per_key(valid, ["target_product_id"], F.desc("similarity_score"), F.desc("created_at"))
            return best.orderBy(F.desc("similarity_score"), "target_product_id").limit(k).select("target_product_id", "similarity_score")

        def build() -> DataFrame:
            scored = self._scored(self.vectors().where(F.col("product_id") == product_id).select("item")).where(F.col("product_id") != product_id)
            return scored.orderBy(F.desc("score"), "product_id").limit(k).select(F.col("product_id").alias("target_product_id"), F.col("score").alias("similarity_score")).coalesce(1)

        name = "similar-" + hashlib.sha1(f"{product_id}|{k}".encode()).hexdigest()
        return kept_for(self.spark, name, self._paths(), build).orderBy(F.desc("similarity_score"), "target_product_id")

    def recommend_by_ingredients(self, names: list[str], k: int = 10) -> DataFrame:
        """The k products most similar to a list of names by the engine's vectors: products with just these ingredients have a score of 1; of
        uploads with equal profile signatures the best counts. `place` is the rank among those of the same origin."""
        listed = self.spark.createDataFrame([(names,)], "names array<string>").select(F.explode(ingredient_names(F.col("names"))).alias("item"))
        uploads = table(self.spark, self.folder, "uploaded_product_master", "product_id", F.nullif("profile_signature", F.lit("")).alias("signature"))
        scored = self._scored(listed).join(uploads, "product_id", "left").withColumn("signature", F.coalesce("signature", "product_id"))
        one = rows.first_per_key(scored, ["signature"], F.desc("score"), F.col("product_id"))
        best = one.orderBy(F.desc("score"), "product_id").limit(k)
        named = best.join(self._products().select("product_id", "product_name"), "product_id")
        place = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("score"), "product_id"))
        return named.select("product_id", "product_name", "origin", "score", "shared", place.alias("place")).orderBy(F.desc("score"), "product_id")

    def recommend_by_text(self, label: str, k: int = 10) -> DataFrame:
        """The same for a scanned label: its ingredient passage, or all of it where there is no heading, is put together and split."""
        one = self.spark.createDataFrame([(label,)], "label string")
        lines = labels.rejoined(labels.passage_lines(F.col("label")))
        one = one.withColumn("passage", F.when(F.size(lines) > 0, F.array_join(lines, ", ")).otherwise(F.regexp_replace("label", "\n", "")))
        values = split_packed(one, "passage", "values").first()["values"]  # of one label
        return self.recommend_by_ingredients(list(values), k)
