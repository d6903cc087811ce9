"""Corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read
again as the next stage's docs.  All but the last return the columns of `documents`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchwright.llm.common import stored, table
from matchwright.llm.hilbert import hilbert_shards
from matchwright.llm.langid import predictions, train
from matchwright.llm.mixing import mixed_once
from matchwright.llm.simhash import deduplicated
from matchwright.llm.spaced_seeds import decontaminated


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the model accepts (operator 3).

    Texts that are null, empty or hold no letter go, as do all rows if no row has a language to learn from; very long
    texts count whole; repeated rows stay or go together; an empty table stays empty; columns may have any names.
    """
    prefix = "lang_"
    while {f"{prefix}{x}" for x in ("pred", "score", "accepted")} & set(docs.columns):
        prefix += "_"
    return predictions(docs, train(docs), prefix=prefix).where(f"{prefix}accepted").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id of each group of five-word shingles: SimHash within three bits, or a similarity of 0.8 (operator 2).

    Null and empty texts are one group; rows without a doc_id stay; an id with several texts comes back once, with the
    text of the least MD5; of repeated rows one stays; an empty table stays empty; columns may have any names.
    """
    return deduplicated(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of `benchmark` (operator 9).

    Null, empty and short texts stay; repeated rows stay or go together; an empty benchmark leaves all rows; an empty
    table stays empty; columns may have any names.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the target weights take when no row may come twice (operator 5).

    Texts without a word cost nothing and stay where their leaf takes any row before them; null languages and sources are
    leaves named `none`; rows that share an id within a leaf stay or go together; an empty table stays empty; columns may
    have any names.
    """
    return mixed_once(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, along the Hilbert curve (operator 8).

    Null texts have size 8; null languages and sources have codes of their own; repeated rows have neighbouring slots; an
    empty table gives no rows; other columns are not read.
    """
    return hilbert_shards(docs).withColumn("law", F.lit("rows"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: Trained and hashed stages are not expressible in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
