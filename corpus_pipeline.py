"""The corpus pipeline: toxicity, SimHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in
the shared folder and hands what it reads back to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.llm import bpe, common, decontamination, simhash, toxicity
from sparkpact.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay.

    Null and empty texts are scored as texts without words; rows with a null id are scored like any
    other; repeated rows are scored alike and stay or go together. Texts are read whole. Empty
    table: empty result. Other columns stay as they are.
    """
    model = toxicity.train(docs, common.read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: that with the smallest id, null ids last, and
    of repeated ids any one.

    Null and empty texts and texts without words are one group. Empty table: empty result. Other
    columns stay as they are, whatever their names.
    """
    taken = {c.lower() for c in docs.columns}
    row, key = (next(n for k in range(len(taken) + 1) if (n := f"{base}_{k}") not in taken) for base in ("row", "row_key"))
    # written down with its row, so that the number stays what it is
    numbered = common.saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keyed = numbered.select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row")).alias(key), F.col("text").alias("text"))
    found = simhash.near_duplicates(keyed, key)
    kept = found.where(F.col(key) == F.col("component_id")).select(F.col(f"{key}.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs stay.

    Null and empty texts have no words and stay; null ids and repeated rows are looked at like any
    other. Empty benchmark: all stay. Empty table: empty result. Other columns stay as they are.
    """
    return decontamination.clean_documents(docs, common.read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their count and hashes, and the hash of what they decode to.

    Null texts count as empty: no tokens. One row for each row, null and repeated ids included.
    Empty table: empty result. Other columns are not read.
    """
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL cannot express these stages; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, as a written table. What the stages write on the way, and each
    stage's own table once the next is written, is deleted."""
    docs, before = common.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.fresh_path(spark, name)
        with common.temporary(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before is not None:
            common.delete(spark, before)
        before = path
    return docs
