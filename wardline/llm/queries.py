"""The registered queries of the corpus operators, over whole tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .html_extract import html_extract
from .language_id import language_id
from .license_scan import license_scan
from .lm_scoring import lm_scoring
from .mixing import Mix, mix_sources, taken_columns
from .ngram_join import ngram_jaccard_join
from .packing import best_fit_packing
from .periodic_runs import periodic_runs
from .quality import quality_rules
from .spelling import spelling_variants
from .substring_dedup import substring_dedup

#: The mix of the query: domains fall in weight, English weighs twice the other languages in every domain.
DOMAINS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
MIX = Mix({**{(d,): w for d, w in DOMAINS.items()}, **{(d, "en"): 2.0 for d in DOMAINS}})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5(docs: DataFrame) -> DataFrame:
    taken = taken_columns(docs)
    return mix_sources(docs, MIX).select("doc_id", F.col(taken.domain).alias("domain"), "lang", "source", F.col(taken.epoch).alias("epoch"), F.col(taken.tokens).alias("n_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: operator(table(spark, sf_dir, name))

    return {
        "op1_substring_dedup": over("documents", substring_dedup),
        "op2_license_scan": over("documents", lambda docs: license_scan(docs).drop("spans")),
        "op3_best_fit_packing": over("documents", lambda docs: best_fit_packing(docs, vocabulary())),
        "op4_ngram_jaccard_join": over("documents", lambda docs: ngram_jaccard_join(docs, n=3, percent=90)),
        "op5_mix_sources": over("documents", op5),
        "op6_exact_dedup": over("documents", exact_dedup),
        "op7_lm_scoring": over("documents", lm_scoring),
        "op8_html_extract": over("pages", html_extract),
        "op9_language_id": over("documents", language_id),
        "op10_quality_rules": over("documents", quality_rules),
        "op11_periodic_runs": over("documents", lambda docs: periodic_runs(docs, planted=True)),
        "op12_embedding_dedup": over("embeddings", embedding_dedup),
        "op13_spelling_variants": over("documents", lambda docs: spelling_variants(docs, altered=True)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
            gone AS (
                SELECT doc_id, list(DISTINCT k) AS ks FROM (
                    SELECT doc_id, unnest(range(i, i + 13)) AS k FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM w) WHERE first < doc_id
                ) GROUP BY doc_id
            )
            SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
                sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(ks, k)) END, ' '), '')) AS kept_sha256
            FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
        """,
        "op6_exact_dedup": r"""
            SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
            FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        """,
    }
