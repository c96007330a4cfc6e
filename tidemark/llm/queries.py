"""The queries that apply the operators of this subpackage to whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.fill_middle import fill_in_middle, restore
from tidemark.llm.html_text import extract_main_text
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.lm_score import score_documents
from tidemark.llm.mixing import mix_sources
from tidemark.llm.quality import score_quality
from tidemark.llm.quality_rules import apply_rules
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.suffix_dedup import remove_earlier_repeats
from tidemark.llm.vector_codes import ENTRIES, ROUNDS, SCALE, compress_vectors
from tidemark.sources import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), window=35, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "copies")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_documents(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_earlier_repeats(table(spark, sf_dir, "documents"), length=100, with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), digest)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress_vectors(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_html_text": op2_html_text,
    "op3_ann": op3_ann,
    "op4_quality": op4_quality,
    "op5_licenses": op5_licenses,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_mixing": op8_mixing,
    "op9_lm_score": op9_lm_score,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_quality_rules": op13_quality_rules,
}


def _lloyd_sql() -> str:
    """The rounds one after the other, each over (part, position, component) rows."""
    width = "(SELECT max(len(embedding)) // 4 FROM kept)"
    steps = [
        f"""WITH kept AS MATERIALIZED (
            SELECT * FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c AS MATERIALIZED (
            SELECT vec_id, (i - 1) // {width} AS p, (i - 1) % {width} AS j, CAST(floor(embedding[i] * {SCALE}.0) AS BIGINT) AS x
            FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
        b0 AS MATERIALIZED (
            SELECT p, e, j, x AS c FROM c
            JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
            SELECT vec_id, p, min(e) AS e, min(d) AS d
            FROM (SELECT *, min(d) OVER (PARTITION BY vec_id, p) AS least
                  FROM (SELECT vec_id, c.p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d
                        FROM c JOIN b{k} b ON c.p = b.p AND c.j = b.j GROUP BY vec_id, c.p, e))
            WHERE d = least GROUP BY vec_id, p)""")
        if k < ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
            SELECT p, e, j, coalesce(m, c) AS c FROM b{k}
            LEFT JOIN (SELECT p, e, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m
                       FROM a{k} JOIN c USING (vec_id, p) GROUP BY p, e, j) USING (p, e, j))""")
    steps.append(f"""coded AS (
            SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)""")
    return ",\n        ".join(steps)


ORACLES: dict[str, str] = {
    "op11_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
        drawn AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
                         CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
        f AS (SELECT doc_id, t, n, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
                     CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
        parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM parts""",
    "op12_vector_codes": _lloyd_sql(),
    "op6_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM starts),
        repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM repeated),
        placed AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n
                 FROM placed WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = placed.doc_id AND g.p = placed.p) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
}
