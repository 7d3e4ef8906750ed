"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cashlens.llm.common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return wrap


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cashlens.llm.packing import pack
    p = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cashlens.llm.byte_bpe import decode, encode
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    e = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"),
                    F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"))


@query("op9_knn_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cashlens.llm.common import held_out
    from cashlens.llm.knn_quality import score
    s = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return s.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op1_toxicity_chain")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cashlens.llm.common import held_out
    from cashlens.llm.toxicity import score
    return (score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
            .withColumn("held_out", held_out(F.col("doc_id"), 4)))


@query("op7_robust_outliers")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cashlens.llm.outliers import outliers
    return outliers(table(spark, sf_dir, "documents")).drop("lang", "source")


@query("op4_kneser_ney_langid")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cashlens.llm.common import held_out
    from cashlens.llm.langid import identify
    r = identify(table(spark, sf_dir, "documents"))
    return r.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query("op8_signature_tree_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cashlens.llm.sigtree import jaccard_join
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op10_collinear_chains")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cashlens.llm.chaining import passages
    return passages(table(spark, sf_dir, "documents"))


@query("op6_e8_lattice")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cashlens.llm.lattice import near_vectors
    return (near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))


@query("op2_elias_fano_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cashlens.llm.common import held_out
    from cashlens.llm.lm_trie import score
    s = score(table(spark, sf_dir, "documents"))
    return s.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "oov_share")


@query("op11_middle_rotation", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                      sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                 CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
    p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
                 array_to_string(u[b + 1:], '') AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256 FROM p""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cashlens.llm.middle import fill_in_middle, restore
    r = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return r.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                    F.sha2("restored", 256).alias("restored_sha256"))


@query("op12_pivotal_grams")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cashlens.llm.spelling import spelling_groups
    return spelling_groups(table(spark, sf_dir, "documents"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cashlens.llm.token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
