"""The registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import ann, best_fit, centroids, html_extract, jaccard_join, line_dedup, lm, mixing, packing, spelling, suffix_dedup, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, by: int):
    """crc32 of an id as text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five words overlap by 80 percent."""
    found = jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), k=5, percent=80)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a string of 50 bytes of a smaller document covers."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=50)


@query
def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of documents in a mix of their sources that is nearly as even as the repetition limit allows."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


@query
def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@query
def op5_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors by cosine of every vector whose id is divisible by 50."""
    table = _table(spark, sf_dir, "embeddings")
    return ann.nearest(table.filter("vec_id % 50 = 0"), table, k=5)


@query
def op6_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of two thirds of them."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    model = toxicity.train(documents, labels)
    return toxicity.score(documents, model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"),
        F.size("toxic_spans").alias("n_spans"),
    )


@query
def op7_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest integer inner products of every vector whose id is divisible by 100."""
    table = _table(spark, sf_dir, "embeddings")
    return topk.largest_products(table.filter("vec_id % 100 = 0"), table, k=10)


@query
def op8_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that are within two edits of an earlier line."""
    return line_dedup.removed_lines(_table(spark, sf_dir, "documents"))


@query
def op9_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of four fifths of them."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = lm.train(documents, lm.learnt_from(F.col("doc_id")))
    scored = lm.score(documents, model, counts)
    held_out = F.coalesce(_remainder("doc_id", 5) == 1, F.lit(False))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query
def op10_consensus_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@query
def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with their more frequent neighbour at one edit."""
    return spelling.spelling_forms(_table(spark, sf_dir, "documents"))


@query
def op12_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in 40 clusters after five rounds, in integers."""
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


@query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in as few sequences of at most 4096 tokens as best fit finds."""
    return best_fit.pack_whole(_table(spark, sf_dir, "documents"))
