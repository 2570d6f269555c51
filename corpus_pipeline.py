"""A training-corpus pipeline: five stages over ``documents``, each written and read again.

1. toxicity: documents that the classifier rejects go;
2. exact dedup: of equal texts one document stays;
3. n-gram Jaccard join: of each group of near copies (five words, 0.8) one document stays;
4. mixing: documents are repeated or left out so that the sources reach their target weights;
5. SentencePiece: documents become piece ids, which decode to the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm import exact_dedup, mixing, ngram_join, sentencepieces, toxicity
from asofkit.llm.ranking import global_rank
from asofkit.llm.scratch import Scratch, trim

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), weights, score_col="toxicity").where("toxicity < 0.5").select(*COLUMNS)


def with_key(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with ``row_key``, different in every row and in the order of doc_id, null first.

    That is doc_id where it is never null and never repeated. Else the rows are written with their
    position, so that equal rows have keys of their own.
    """
    trim(spark)  # of the stage before
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("row_key", F.col("doc_id").cast("long"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    return Scratch(spark, "keyed").save(global_rank(docs.select(*COLUMNS), order, "row_key"), "rows")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = with_key(spark, docs)
    kept = exact_dedup.exact_dedup(rows, id_col="row_key").where("kept").select("row_key")
    return rows.join(kept.hint("shuffle_hash"), "row_key", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = with_key(spark, docs)
    kept = ngram_join.jaccard_components(rows, k=5, percent=80, id_col="row_key").where("kept").select("row_key")
    return rows.join(kept.hint("shuffle_hash"), "row_key", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = with_key(spark, docs)
    copies = mixing.mix_sources(rows, id_col="row_key").where("copies > 0").select("row_key", "copies")
    return (rows.join(copies.hint("shuffle_hash"), "row_key")
            .select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = sentencepieces.round_trip(docs, path)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix), ("sentencepiece", encode)]

#: A trained classifier, hashed rounding and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
