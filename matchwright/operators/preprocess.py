"""The enriched record: normalised fields, tokens, counts and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_address, normalized_country, normalized_name, tokens

FIELDS = {"business_name": normalized_name, "business_address": normalized_address, "country": normalized_country}


def preprocess(df: DataFrame, mode: str = "series") -> DataFrame:
    """`df` with 13 derived columns; a field that `df` lacks counts as empty.  Mode `scalar` is that of single records."""
    value = lambda f: F.col(f) if f in df.columns else F.lit("")
    out = df.withColumns({f"{f}_normalized": normalise(value(f), mode) for f, normalise in FIELDS.items()})
    derived: dict[str, Column] = {}
    for short in ("name", "address"):
        text = F.col(f"business_{short}_normalized")
        derived |= {f"{short}_tokens": tokens(text), f"{short}_token_count": F.size(tokens(text)), f"{short}_length": F.length(text), f"has_{short}": text != "", f"missing_{short}": text == ""}
    return out.withColumns(derived)
