"""Profiling of sources and ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_value
from ..sources.tables import write_text
from .evaluate import explode_truth, split_ids

FIELDS = ("business_name", "business_address", "country")


def expected_prefix(file_name: str) -> str | None:
    """`S1-` for a file of source 1, and so on."""
    for k in (1, 2, 3):
        if f"source{k}" in file_name.lower():
            return f"S{k}-"
    return None


def truth_distribution(truth: DataFrame) -> DataFrame:
    """(matches, entities): how many Source-1 ids have so many matches."""
    return truth.groupBy(F.size(split_ids(F.col("matched_entity_ids"))).cast("bigint").alias("matches")).agg(F.count("*").alias("entities"))


def truth_profile(truth: DataFrame) -> DataFrame:
    """Rows, and rows with no, one or several matches, and ids that do not begin with S2- or S3-."""
    n = F.size(split_ids(F.trim(F.col("matched_entity_ids"))))
    bad = F.filter(split_ids(F.col("matched_entity_ids")), lambda x: ~(x.startswith("S2-") | x.startswith("S3-")))
    return truth.agg(F.count("*").alias("rows"), F.count_if(n == 0).alias("empty_truth"), F.count_if(n == 1).alias("single_truth"), F.count_if(n > 1).alias("multiple_truth"), F.coalesce(F.sum(F.size(bad)), F.lit(0)).alias("invalid_ids"))


def source_profile(df: DataFrame, prefix: str, *by: str) -> DataFrame:
    """Rows, missing values, distinct and repeated ids and values, bad prefixes; per group of `by`."""
    name, address = ascii_value(F.col("business_name")), ascii_value(F.col("business_address"))
    out = df.groupBy(*by).agg(
        F.count("*").alias("rows"), *[F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(f"missing_{c}") for c in FIELDS], F.count_distinct("entity_id").alias("distinct_ids"), F.count_distinct("country").alias("countries"),
        F.count_distinct("business_name").alias("distinct_names"), F.count_distinct(name).alias("distinct_normalized_names"), F.count_distinct("business_address").alias("distinct_addresses"), F.count_distinct(address).alias("distinct_normalized_addresses"),
        F.count_if(~F.coalesce(F.col("entity_id").startswith(prefix), F.lit(False))).alias("bad_prefixes"),
    )
    return out.withColumns({"duplicate_ids": F.col("rows") - F.col("distinct_ids"), "duplicate_names": F.col("rows") - F.col("distinct_names"), "duplicate_addresses": F.col("rows") - F.col("distinct_addresses")})


def length_stats(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Count, least, greatest, mean and population deviation of a column's lengths."""
    n = F.length(F.coalesce(F.col(column), F.lit("")))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("mean_length"), F.stddev_pop(n).alias("std_length"))


def country_overlap(frames: dict[str, DataFrame]) -> DataFrame:
    """(country, sources): the sorted sources in which a country occurs."""
    rows = None
    for name, df in frames.items():
        own = df.select("country", F.lit(name).alias("source")).distinct()
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("country").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def match_coverage(truth: DataFrame) -> DataFrame:
    """Source-1 ids with a match in S2, in S3, in both, in none."""
    ids = split_ids(F.col("matched_entity_ids"))
    s2, s3 = F.exists(ids, lambda x: x.startswith("S2-")), F.exists(ids, lambda x: x.startswith("S3-"))
    return truth.agg(F.count_if(s2).alias("with_s2"), F.count_if(s3).alias("with_s3"), F.count_if(s2 & s3).alias("with_both"), F.count_if(~s2 & ~s3).alias("with_none"))


# The kinds of differences and their patterns.
NOISE = {
    "name differences": ("business_name", None),
    "address differences": ("business_address", None),
    "legal suffix or punctuation differences": ("business_name", r"\b(ltd|limited|inc|corp|llc|llp|pvt|private)\b|[^\p{L}\p{N}_\s]"),
    "address formatting differences": ("business_address", r"\b(st|street|rd|road|ave|avenue|blvd|boulevard)\b|[,.-]"),
}


def noise_examples(truth: DataFrame, records: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` confirmed pairs, in order of their ids, for each kind of difference: (kind, ids, both values)."""
    pairs = explode_truth(truth)
    for k, key in ((1, "source1_entity_id"), (2, "true_entity_id")):
        pairs = pairs.join(records.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{k}") for c in FIELDS[:2]]), key)
    out = None
    for kind, (field, pattern) in NOISE.items():
        a, b = F.col(f"{field}_1"), F.col(f"{field}_2")
        test = ascii_value(a) != ascii_value(b)
        if pattern:
            test = test & F.concat(F.lower(a), F.lit(" "), F.lower(b)).rlike(pattern)
        rows = pairs.where(test).select(F.lit(kind).alias("kind"), "source1_entity_id", "true_entity_id", a.alias("value_s1"), b.alias("value_true"))
        out = rows if out is None else out.unionByName(rows)
    by = Window.partitionBy("kind").orderBy("source1_entity_id", "true_entity_id")
    return out.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def prefix_violations(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(source, violations) of ids that do not begin with the source's prefix."""
    out = None
    for name, (df, prefix) in frames.items():
        own = df.agg(F.count_if(~F.coalesce(F.col("entity_id").startswith(prefix), F.lit(False))).alias("violations")).select(F.lit(name).alias("source"), "violations")
        out = own if out is None else out.unionByName(own)
    return out


def format_number(x: float) -> str:
    return f"{x:,.2f}"


def format_counter(counts: dict) -> str:
    """Lines `key: n`, most frequent first, with an empty key shown as [empty]."""
    return "\n".join(f"{k or '[empty]'}: {v:,}" for k, v in sorted(counts.items(), key=lambda x: (-x[1], str(x[0]))))


def truth_violations(truth: DataFrame, most: int = 10) -> DataFrame:
    """(kind, id): the first `most` Source-1 ids, and matched ids, without the prefix of a source."""
    first = lambda df, kind: df.distinct().orderBy("id").limit(most).select(F.lit(kind).alias("kind"), "id")
    own = truth.where(~F.col("source1_entity_id").startswith("S1-")).select(F.col("source1_entity_id").alias("id"))
    other = explode_truth(truth).where(~F.col("true_entity_id").rlike("^S[23]-")).select(F.col("true_entity_id").alias("id"))
    return first(own, "source1").unionByName(first(other, "matched"))


def country_counts(df: DataFrame, *by: str) -> DataFrame:
    """(by, country, records)."""
    return df.groupBy(*by, "country").agg(F.count("*").alias("records"))


def prefix_examples(df: DataFrame, prefix: str, most: int = 10) -> DataFrame:
    """The first `most` ids that do not begin with `prefix`."""
    return df.where(~F.coalesce(F.col("entity_id").startswith(prefix), F.lit(False))).select("entity_id").orderBy("entity_id").limit(most)


def matched_examples(df: DataFrame, truth: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` records, by id, that the truth names."""
    named = truth.select(F.col("source1_entity_id").alias("entity_id")).unionByName(explode_truth(truth).select(F.col("true_entity_id").alias("entity_id")))
    return df.join(named.distinct(), "entity_id", "left_semi").orderBy("entity_id").limit(most)


def repeated_ids(df: DataFrame, most: int = 5) -> DataFrame:
    """(entity_id, records) of the `most` ids that occur most often, more than once."""
    return df.groupBy("entity_id").agg(F.count("*").alias("records")).where("records > 1").orderBy(F.desc("records"), "entity_id").limit(most)


def inspect_table(df: DataFrame, file_name: str = "", head: int = 5) -> dict[str, DataFrame | int | dict | list]:
    """Shape, types, first rows, empty values, and, where there are such columns, repeated ids, countries and bad prefixes."""
    row = df.agg(F.count("*").alias("rows"), *empty_flags(*df.columns)).first()
    out = {"rows": row["rows"], "columns": df.columns, "types": dict(df.dtypes), "head": df.limit(head), "empty": {c: row[f"empty_{c}"] for c in df.columns}}
    if "entity_id" in df.columns:
        counts = df.groupBy("entity_id").count()
        out |= {"repeated_ids": counts.where("count > 1").count(), "repeated_examples": repeated_ids(df)}
    if "country" in df.columns:
        out["countries"] = country_counts(df)
    prefix = expected_prefix(file_name)
    if prefix and "entity_id" in df.columns:
        out |= {"prefix": prefix, "bad_prefixes": df.where(~F.coalesce(F.col("entity_id").startswith(prefix), F.lit(False))).count(), "bad_examples": prefix_examples(df, prefix, 5)}
    return out


def inspect_truth(truth: DataFrame) -> dict[str, DataFrame]:
    """Counts of empty, single and multiple truth, and ids without a prefix."""
    return {"profile": truth_profile(truth), "violations": truth_violations(truth, 5), "head": truth.limit(10)}


def report(sections: dict[str, DataFrame], most: int = 100) -> str:
    """A text of small aggregate tables, at most `most` rows of each."""
    lines = []
    for title, df in sections.items():
        lines.append(f"== {title} ==")
        for row in df.limit(most).collect():
            lines.append("  " + ", ".join(f"{k}: {format_number(v) if isinstance(v, float) else '[empty]' if v == '' else v}" for k, v in row.asDict().items()))
    return "\n".join(lines) + "\n"


def write_report(spark: SparkSession, sections: dict[str, DataFrame], path: str, most: int = 100) -> None:
    write_text(spark, path, report(sections, most))


def empty_flags(*columns: str) -> list[Column]:
    return [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"empty_{c}") for c in columns]
