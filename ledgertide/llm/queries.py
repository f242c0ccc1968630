"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.chat_format import END, START, format_digests, formatted
from ledgertide.llm.common import table
from ledgertide.llm.decontaminate import contaminated, contaminated_documents
from ledgertide.llm.jaccard_join import jaccard_components
from ledgertide.llm.language_id import predict_language
from ledgertide.llm.media_tiff import media_digests
from ledgertide.llm.mixture import mixture
from ledgertide.llm.repeated_spans import repeated_spans
from ledgertide.llm.secret_scan import secret_digests
from ledgertide.llm.token_counts import length_answers, length_histogram
from ledgertide.llm.toxicity import fit_toxicity, score_toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_answers(length_histogram(table(spark, sf_dir, "documents")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), links=True)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = f"{END}{START}assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return format_digests(formatted(rows.unionByName(extra)))


def op10_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_counts, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_language_id, op5_suffix_array_dedup, op6_toxicity, op7_source_mixing, op8_secret_scans, op9_chat_formatting, op10_tiff_media, pipeline)
    return {f.__name__: f for f in every}


_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = f"({_WORDS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _hits(kind: str, rank: int, pattern: str, keep: str) -> str:
    """All matches of a pattern that `keep` holds for, with their offsets."""
    return f"""
    SELECT row, '{kind}' AS kind, {rank} AS rank, p.start AS a, p.start + length(p.value) AS b, p.value AS value FROM (
      SELECT row, unnest(list_transform(range(1, len(h) + 1), lambda k: {{'start': coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length(x))), 0), 'value': h[k]}})) AS p
      FROM (SELECT row, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', 0) AS h FROM docs WHERE regexp_matches(text, '{pattern}')))
    WHERE {keep}"""


SECRETS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
hits AS (
  {_hits("assign", 1, _ASSIGN, f"length(regexp_extract(p.value, '{_ASSIGN}', 2)) >= 8")}
  UNION ALL {_hits("access", 2, "AKIA[A-Z0-9]+", "length(p.value) >= 16")}
  UNION ALL {_hits("hex", 3, "[0-9a-f]+", "length(p.value) >= 32")}),
loose AS ({_hits("owned", 4, "[A-Za-z0-9+/_=-]{{20,}}".replace("{{", "{").replace("}}", "}"), "regexp_matches(p.value, '[0-9]') AND regexp_matches(p.value, '[A-Za-z]')")}),
spans AS (
  SELECT * FROM hits UNION ALL
  SELECT * FROM loose l WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.row = l.row AND h.a < l.b AND l.a < h.b)),
valued AS (SELECT s.*, d.source, CASE WHEN kind = 'assign' THEN regexp_extract(value, '{_ASSIGN}', 2) ELSE value END AS v FROM spans s JOIN docs d USING (row)),
owners AS (SELECT v, count(DISTINCT coalesce(source, '')) AS n FROM valued GROUP BY v),
final AS (
  SELECT row, count(*) FILTER (n = 1) AS n_live, count(*) FILTER (n >= 3) AS n_copied,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 4) AS base,
    count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, count(*) FILTER (rank = 3) AS n3
  FROM valued JOIN owners USING (v) WHERE rank < 4 OR n = 1 GROUP BY row)
SELECT doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN final USING (row)"""


def oracle_sql() -> dict[str, str]:
    """The other queries encode, learn, compress or link texts; tests hold them against brute force and round trips."""
    return {"op8_secret_scans": SECRETS_SQL}
