"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every document that the one before kept, and returns documents again
(the last returns packed pieces). `run` writes each stage's result to a table in the shared folder and reads it back.

* toxicity: documents with a score of 0.5 or more go.
* line_dedup: lines that are equal or within two edits to an earlier one go; a document that loses all of its text goes.
* ngram_join: of each group linked at a Jaccard similarity of 0.8 on five-word shingles, the document of the least id stays.
* decontamination: documents that hold a benchmark window (ten words) go.
* packing: what is left is packed into windows of 1024 tokens.

Rows without an id are scored and compared like others; in a group the third stage keeps one of them only if no row has an
id. Line dedup leaves them as they are. Rows that repeat an id with the same text count once after the third stage;
different texts of one id are judged each by itself. Extra columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from trellis.llm.common import lean, stored, text_of


def _boxed(docs: DataFrame) -> DataFrame:
    """docs as (_all, doc_id, text): whole rows in one column, so that no column of theirs meets one that an operator adds."""
    return docs.select(F.struct("*").alias("_all"), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_boxed(docs), model).where("score < 0.5").select("_all.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_boxed(docs))
    lost = (F.col("n_exact") + F.col("n_near") > 0) & (F.trim("kept_text") == "")
    changed = F.col("_all").withField("text", F.col("kept_text")).withField("n_chars", F.length("kept_text").cast("long"))
    return out.where(~lost).select(F.when(F.col("text").isNotNull(), changed).otherwise(F.col("_all")).alias("_all")).select("_all.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # by id and text: an id can carry several texts, which may belong to different groups, and rows may have no id
    own = ngram_join.jaccard_classes(docs).groupBy("id", "x", "component").agg(F.count("*").alias("rows"))
    own = stored(own, "pipeline-own")
    # a group's least id stays, and of several texts of it one; rows without an id come last
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "x")).alias("first")
    kept = own.where("component is not null").groupBy("component").agg(first, F.count("*").alias("texts")).where("texts > 1").select("component", "first")
    stays = F.col("first").isNull() | (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.x") == F.col("x")))
    own = own.join(kept, "component", "left").withColumn("goes", ~stays)
    # only the few that say something: texts that go, and those of several rows, which become one
    marks = stored(own.where("rows > 1 or goes").select(F.col("id").alias("_id"), F.col("x").alias("_x"), "rows", "goes"), "pipeline-marks")
    marked = _boxed(docs).withColumn("_y", F.xxhash64(text_of("text")))
    marked = marked.join(lean(marks, 1_000_000), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_y") == F.col("_x")), "left")
    once = marked.where("not goes and rows > 1").dropDuplicates(["doc_id", "_y"])
    return marked.where("rows is null").unionByName(once).select("_all.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.scan(_boxed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select("_all.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: No SQL expresses a trained model or byte-pair encoding; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
