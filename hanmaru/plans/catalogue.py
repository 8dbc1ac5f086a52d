"""All queries of the engine outside the subpackage for training data, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hanmaru.plans import matching, packed_values, profiles, records, similarity, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": packed_values.p5_found} | similarity.QUERIES | matching.QUERIES | tables.QUERIES | profiles.QUERIES | records.QUERIES
#: Columns whose type in SQL (HUGEINT of count_if, BIGINT of row_number) is another than Spark's.
TYPES = {
    "BIGINT": {
        "coverage_mismatch": ("expected", "actual", "missing", "extra"), "category_judgment_rates": ("n_A", "n_B", "n_C", "n_D"), "pattern_impact": ("hits", "low", "high"),
        "category_overlap": ("overlapping",), "table_health": ("no_upload_signature", "no_profile_signature", "no_parsed_signature", "doubtful_scan"), "user_activity": ("finished",),
        "event_props": ("no_k",), "measure_compare": ("both",), "pair_feature_sums": ("weak_core",),
    },
    "INTEGER": {
        "topk_similar": ("rk",), "candidate_pool": ("rk",), "candidate_pool_v1": ("rk",), "core_coverage": ("core", "shared_core"), "lexical_candidates": ("rk",), "hybrid_candidates": ("rk",), "embedding_topk": ("rk",),
        "reason_ingredients": ("rk",), "catalog_search_page": ("total_rows",),
    },
}


def _typed(name: str, sql: str) -> str:
    """The SQL with the columns of `TYPES` cast to Spark's type."""
    casts = [f'CAST("{c}" AS {kind}) AS "{c}"' for kind, columns in TYPES.items() for c in columns.get(name, ())]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


SQL: dict[str, str] = {n: _typed(n, q) for n, q in ({"p5_found": packed_values.P5_SQL} | similarity.SQL | matching.SQL | tables.SQL | profiles.SQL | records.SQL).items()}
