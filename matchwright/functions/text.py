"""Text functions: normalisation in two modes, tokens, digits and character grams.

Missing text is the empty string everywhere.  NFKC and case folding are the one step that Spark lacks; it is a pandas
UDF, all else are built-in expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole tokens and what they become in names and in addresses.
LEGAL_SUFFIXES = {
    "ltd": "limited",
    "limited": "limited",
    "inc": "incorporated",
    "incorporated": "incorporated",
    "corp": "corporation",
    "corporation": "corporation",
    "llc": "llc",
    "pvt": "private",
    "private": "private",
    "co": "company",
    "company": "company",
}
ADDRESS_WORDS = {
    "st": "street",
    "street": "street",
    "rd": "road",
    "road": "road",
    "ave": "avenue",
    "avenue": "avenue",
    "blvd": "boulevard",
    "boulevard": "boulevard",
    "apt": "apartment",
    "apartment": "apartment",
    "no": "number",
    "number": "number",
}


def safe_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def folded(c: Column) -> Column:
    """NFKC and case folding."""

    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold())

    return F.pandas_udf(fold, T.StringType())(safe_text(c))


def normalized(c: Column, mode: str = "series") -> Column:
    """Folded text with all but letters and digits as single spaces.

    The mode `series`, of blocking and features, keeps `_` and drops combining marks; `scalar`, of miss analysis, keeps
    combining marks and drops `_`.
    """
    if mode not in ("series", "scalar"):
        raise ValueError(f"mode must be series or scalar, not {mode}")
    keep = r"\p{L}\p{N}_" if mode == "series" else r"\p{L}\p{N}\p{M}"
    spaced = F.regexp_replace(folded(c), rf"(?U)[^{keep}\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def replaced(c: Column, words: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def normalized_name(c: Column, mode: str = "series") -> Column:
    return replaced(normalized(c, mode), LEGAL_SUFFIXES)


def normalized_address(c: Column, mode: str = "series") -> Column:
    return replaced(normalized(c, mode), ADDRESS_WORDS)


def normalized_country(c: Column, mode: str = "series") -> Column:
    return normalized(c, mode)


def ascii_value(c: Column) -> Column:
    """The profiling key: lower case, `&` spelled out, ASCII letters and digits only."""
    lowered = F.regexp_replace(F.trim(F.lower(safe_text(c))), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, r"[^a-z0-9\s]", ""), r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def hashed(c: Column) -> Column:
    """Distinct 64-bit hashes of texts, which are compared much faster."""
    return F.array_distinct(F.transform(c, lambda x: F.xxhash64(x)))


def digits(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{Nd})"), 1))


def digit_runs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), 1))


def grams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams; none for a shorter text."""
    last = F.length(c) - (n - 1)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(n))))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Jaccard similarity of two arrays; `empty` if both have no element."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger, 0 if both are 0."""
    return F.coalesce(F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b)), F.lit(0.0))
