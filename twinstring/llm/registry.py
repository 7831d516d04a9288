"""Queries of the operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_orc(spark, sf_dir):
    from twinstring.llm.token_orc import tokenize

    return tokenize(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark, sf_dir):
    from twinstring.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    from twinstring.llm.decontaminate import benchmark_hits

    return benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark, sf_dir):
    from twinstring.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark, sf_dir):
    from twinstring.llm.language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op5_html_text(spark, sf_dir):
    from twinstring.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op7_url_filter(spark, sf_dir):
    from twinstring.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_brown_lm(spark, sf_dir):
    from twinstring.llm.brown_lm import score

    return score(_table(spark, sf_dir, "documents"))


def op6_ngram_join(spark, sf_dir):
    from twinstring.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, threshold=0.9)


def op9_exact_dedup(spark, sf_dir):
    from twinstring.llm.exact_dedup import exact_copies

    return exact_copies(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_token_orc": op1_token_orc,
    "op2_mixing": op2_mixing,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_html_text": op5_html_text,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_filter": op7_url_filter,
    "op8_brown_lm": op8_brown_lm,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
}

ORACLES = {
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op7_url_filter": r"""
        WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'),
            ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        rest AS (SELECT page_id, CASE WHEN contains(url, '://')
            THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        cut AS (SELECT page_id, regexp_extract(r, '^([^/?#]*)', 1) AS h,
            regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        p AS (SELECT page_id, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host FROM cut),
        fit AS (SELECT p.page_id, arg_max({'rule': r.host || r.path, 'verdict': r.verdict},
            length(r.host) * 1000 + length(r.path)) AS best
            FROM p JOIN rules r ON starts_with(p.path, r.path)
            AND (p.host = r.host OR ends_with(p.host, '.' || r.host)) GROUP BY p.page_id)
        SELECT p.page_id, p.host, p.path, best.rule AS rule,
            coalesce(best.verdict, 'allow') AS verdict
        FROM p LEFT JOIN fit USING (page_id)
    """,
}
