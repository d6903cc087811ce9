"""Reading and writing: TSV tables, records by id, diagnostic targets, and the projection of the driver's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalized, normalized_address, normalized_country, normalized_name
from .schema import PREDICTIONS, SOURCE, TRUTH, require_columns


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, na_values: tuple[str, ...] = ()) -> DataFrame:
    """A table of texts with a header; missing is empty, and the literals `na_values` (none by default) are missing too."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    if schema is None or all(isinstance(f.dataType, T.StringType) for f in schema):
        df = df.na.fill("")
        if na_values:
            df = df.select(*[F.when(F.col(c).isin(*na_values), "").otherwise(F.col(c)).alias(c) for c in df.columns])
    return df


def load_train(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return load_test(spark, folder, "train") | {"ground_truth": read_tsv(spark, f"{folder}/train_ground_truth.tsv", TRUTH)}


def load_test(spark: SparkSession, folder: str, split: str = "test") -> dict[str, DataFrame]:
    return {f"source{k}": read_tsv(spark, f"{folder}/{split}_source{k}.tsv", SOURCE) for k in (1, 2, 3)}


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, PREDICTIONS)


def write_tsv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of part files, or, for tables of a few rows, one file of that name; what was there is replaced."""
    out = f"{path}.parts" if one_file else path
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(out, sep="\t", header=True, quote='"', escape='"', emptyValue="")
    if one_file:
        fs, hadoop = file_system(df.sparkSession, out)
        (part,) = [s.getPath() for s in fs.listStatus(hadoop(out)) if s.getPath().getName().startswith("part-")]
        fs.delete(hadoop(path), True)
        fs.rename(part, hadoop(path))
        fs.delete(hadoop(out), True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the constructor of paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one UTF-8 file, in any store that Spark writes; folders above it are made."""
    fs, hadoop = file_system(spark, path)
    out = fs.create(hadoop(path), True)
    out.write(bytearray(text.encode()))
    out.close()


def written(df: DataFrame) -> DataFrame:
    """The rows written once to the checkpoint folder that all executors share, for plans that read them several times."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or f"/tmp/checkpoints/{sc.applicationId}")
    return df.checkpoint()


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of a folder's files in order, from any store that Spark reads; a missing folder raises."""
    fs, hadoop = file_system(spark, folder)
    if not fs.exists(hadoop(folder)):
        raise FileNotFoundError(folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(hadoop(folder)) if s.isFile())


def records_by_ids(df: DataFrame, ids: DataFrame, keep: str = "first", order: str | None = None) -> DataFrame:
    """The rows whose entity_id is in `ids`, one each: the first or last in `order` (by default the other columns)."""
    require_columns(df, ["entity_id"], "records")
    keys = [order] if order else [c for c in df.columns if c != "entity_id"]
    by = Window.partitionBy("entity_id").orderBy(*[F.col(k).asc() if keep == "first" else F.col(k).desc() for k in keys])
    found = df.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    return found.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def truth_for(truth: DataFrame, ids: DataFrame) -> DataFrame:
    return truth.join(ids.select(F.col("entity_id").alias("source1_entity_id")).distinct(), "source1_entity_id", "left_semi")


def keys(df: DataFrame) -> DataFrame:
    """The rows with normalised `k_name`, `k_address` and `k_country`."""
    return df.withColumns({"k_name": normalized_name(F.col("business_name")), "k_address": normalized_address(F.col("business_address")), "k_country": normalized_country(F.col("country"))})


def diagnostic_target(target: DataFrame, sample: DataFrame, cap: int, order: str, rows: int = 25_000) -> DataFrame:
    """Of the first `rows` rows: those that share (country, name) or (country, address) with the sample, and the first `cap` others of each sampled country.

    Only the key of two empty texts is left out, so ("us", "") matches every row of that country with an empty field.
    """
    s = keys(sample)
    t = keys(target.orderBy(order).limit(rows)).withColumn("_n", F.col(order))  # a bounded diagnostic of the first rows; `order` is unique
    hit = None
    for field in ("k_name", "k_address"):
        own = s.where((F.col("k_country") != "") | (F.col(field) != "")).select("k_country", field).distinct().withColumn(f"_{field}", F.lit(True))
        t = t.join(own, ["k_country", field], "left")
        found = F.coalesce(F.col(f"_{field}"), F.lit(False))
        hit = found if hit is None else hit | found
    countries = s.where("k_country <> ''").select("k_country").distinct().withColumn("_c", F.lit(True))
    t = t.join(countries, "k_country", "left").withColumn("_hit", hit)
    rank = F.row_number().over(Window.partitionBy("k_country", "_hit").orderBy("_n"))
    t = t.withColumn("_r", rank).where(F.col("_hit") | (F.coalesce(F.col("_c"), F.lit(False)) & (F.col("_r") <= cap)))
    first = F.row_number().over(Window.partitionBy("entity_id").orderBy("_n"))
    return t.withColumn("_f", first).where("_f = 1").select(*target.columns)


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` seen as business records, with the ordinal `doc_id` and the last 60 characters of the normalised text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.substring(text, 1, 60).alias("business_name"),
        F.substring(text, 61, 80).alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
        text.alias("text"),
    )


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = projection(spark, sf_dir).drop("text")
    return tuple(df.where(F.col("entity_id").startswith(f"S{k}-")) for k in (1, 2, 3))


def projected_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each Source-1 record, the sorted ids of the others with equal language and tail."""
    df = projection(spark, sf_dir).select("entity_id", "country", F.right(normalized(F.col("text")), F.lit(60)).alias("tail"))
    s1 = df.where(F.col("entity_id").startswith("S1-")).withColumnRenamed("entity_id", "source1_entity_id")
    pairs = s1.join(df.where(~F.col("entity_id").startswith("S1-")), ["country", "tail"], "left")
    return pairs.groupBy("source1_entity_id").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("matched_entity_ids"))


def normalized_tail(c: Column, n: int) -> Column:
    """The last n characters of the normalised text, read from the text's last 8 n if these give 4 n, else from all of it.

    Normalisation looks past a character only to those that compose with it, so a cut changes no more than the first few of the 4 n.
    """
    whole = lambda x: F.right(normalized(x), F.lit(n))
    part = F.right(c, F.lit(8 * n))
    short = F.length(normalized(part)) < 4 * n
    enough = F.when((F.length(c) > 8 * n) & short, c).otherwise(part)  # few texts are normalised whole
    return whole(enough)


def truth_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, truth) of every record: the smallest id of those with its language and tail.

    A Source-1 record and another one are a pair of `projected_truth` if theirs are equal, so the pairs need not be made.
    """
    df = written(projection(spark, sf_dir).select("entity_id", "country", normalized_tail(F.col("text"), 60).alias("tail")))
    return df.join(df.groupBy("country", "tail").agg(F.min("entity_id").alias("truth")), ["country", "tail"]).select("entity_id", "truth")
