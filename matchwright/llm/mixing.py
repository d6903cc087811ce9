"""Operator 5: mixing sources to target weights by budgets on a domain-language-source tree (DataFrame functions only).

The token budget of a node is shared among its children in proportion to their weights.  A child that cannot use its
share (tokens times epochs) gets all it has, and what it leaves goes to its siblings in proportion; a node's capacity is
the sum over its leaves, so only what no sibling can take moves up to the siblings of the parent.  The largest prefix of
saturated children, in order of capacity per weight, comes from running sums; all arithmetic is on integers.

A leaf takes full epochs of its documents and, of one epoch more, a prefix of tokens in the order of a seeded hash.  The
cut of that prefix is found in steps: token sums of 256 hash buckets, then of 256 parts of the one bucket that holds the
cut, and once more, so that a leaf with a third of all rows leaves one document in 16 million to be sorted in one task;
the documents are then chosen by comparing with the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Relative weights of the children of a node; names that are not listed weigh 1.
WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 2},
}
LEVELS = ["domain", "lang", "source"]
SEED = 20
#: Hex digits of the hash that the steps towards a leaf's cut look at.
DIGITS = (2, 4, 6)
WORDS = r"[^\x20\x09-\x0D]+"


def leaf_of(docs: DataFrame, domains: int = 3) -> dict[str, Column]:
    """Names of the three levels: a source belongs to the domain given by the first hex digit of its MD5; nulls are named `none`."""
    source = F.coalesce(docs["source"].cast("string"), F.lit("none"))
    digit = F.conv(F.substring(F.md5(source), 1, 1), 16, 10).cast("int")
    return {"domain": F.concat(F.lit("domain"), (digit % domains).cast("string")), "lang": F.coalesce(docs["lang"].cast("string"), F.lit("none")), "source": source}


def weight(level: str, weights: dict) -> Column:
    known = weights.get(level, {})
    if any(not isinstance(w, int) or w < 1 for w in known.values()):
        raise ValueError("weights must be positive integers")
    out = F.lit(1)
    for name, w in known.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("bigint")


def order_key(epoch: Column, seed: int, id_col: str | Column) -> Column:
    name = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(name.cast("string"), F.lit("null"))))


def shared_out(nodes: DataFrame, parents: list[str], level: str, weights: dict) -> DataFrame:
    """Replaces `budget` (of the parent) by the child's; nodes: parents, level, capacity, budget."""
    big = lambda c: c.cast("decimal(38,0)")
    w, cap = F.col("w"), F.col("capacity")
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    run = by.orderBy(cap / w, level).rowsBetween(Window.unboundedPreceding, 0)
    rows = nodes.withColumn("w", weight(level, weights))
    rows = rows.withColumns({"cum_w": F.sum(w).over(run), "cum_c": F.sum(cap).over(run), "all_w": F.sum(w).over(by)})
    rows = rows.withColumn("full", big(cap) * big(F.col("all_w") - F.col("cum_w") + w) <= big(F.col("budget") - F.col("cum_c") + cap) * big(w))
    rows = rows.withColumns({"left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), cap)).over(by), F.lit(0)), "free_w": F.sum(F.when(~F.col("full"), w)).over(by), "to": F.coalesce(F.sum(F.when(~F.col("full"), w)).over(run), F.lit(0))})
    part = F.expr("cast(left as decimal(38,0)) * cast(to as decimal(38,0)) div free_w - cast(left as decimal(38,0)) * cast(to - w as decimal(38,0)) div free_w")
    return rows.withColumn("budget", F.when(F.col("full"), cap).otherwise(part).cast("bigint")).select(*parents, level, "budget")


def allocate(leaves: DataFrame, budget: int | None, share: float, max_epochs: int, weights: dict) -> DataFrame:
    """Leaves (levels, tokens) with their `budget`; without a budget, it is `share` (in thousandths) of all tokens."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    everything = leaves.agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
    wanted = F.lit(budget) if budget is not None else F.expr(f"cast(tokens as decimal(38,0)) * {round(share * 1000)} div 1000")
    parents, given = [], everything.select(F.least(wanted, F.col("capacity")).cast("bigint").alias("budget"))
    for level in LEVELS:
        nodes = leaves.groupBy(*parents, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(given, parents) if parents else nodes.crossJoin(given)  # one row
        given = stored(shared_out(nodes, parents, level, weights), f"mixing-{level}")  # one row a node; a plan of all levels at once would be large
        parents = [*parents, level]
    return leaves.join(given, LEVELS)


def cuts(rows: DataFrame, leaves: DataFrame, seed: int, id_col: str) -> DataFrame:
    """Leaves with `full`, their whole epochs, and `cut`, the last key of the epoch after those that is taken."""
    leaves = leaves.select(*LEVELS, "tokens", "budget", F.expr("if(tokens > 0, budget div tokens, 0)").alias("full")).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    near = rows.join(leaves.where("rest > 0").select(*LEVELS, "full", F.col("rest").alias("room")), LEVELS)
    near = near.select(*LEVELS, "n_tokens", "room", order_key(F.col("full") + 1, seed, id_col).alias("key"))
    for digits in DIGITS:
        near = near.withColumn("bucket", F.substring("key", 1, digits))
        run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = near.groupBy(*LEVELS, "bucket", "room").agg(F.sum("n_tokens").alias("own")).withColumn("upto", F.sum("own").over(run))
        edge = sums.where("upto > room and upto - own <= room and own > 0").select(*LEVELS, "bucket", (F.col("room") - F.col("upto") + F.col("own")).alias("room"))
        near = stored(near.drop("room").join(edge, [*LEVELS, "bucket"]), "mixing-edge")
    inner = near.groupBy(*LEVELS, "bucket", "room", "key").agg(F.sum("n_tokens").alias("own"))
    inner = inner.withColumn("upto", F.sum("own").over(Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    cut = inner.groupBy(*LEVELS, "bucket").agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("key"))).alias("last")).select(*LEVELS, F.coalesce("last", "bucket").alias("cut"))
    return leaves.join(cut, LEVELS, "left").select(*LEVELS, "tokens", "budget", "full", "cut")


def plan(docs: DataFrame, budget: int | None = None, share: float = 0.6, max_epochs: int = 2, weights: dict = WEIGHTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The token counts of all rows, and the leaves with budget, whole epochs and cut."""
    named = leaf_of(docs)
    count = F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORDS)), F.lit(0)).cast("bigint")
    rows = stored(docs.select(F.col(id_col), *[c.alias(k) for k, c in named.items()], count.alias("n_tokens")), "mixing-rows", few=True)
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mixing-leaves")
    leaves = stored(allocate(leaves, budget, share, max_epochs, weights), "mixing-budgets")  # of known size, so that joins with all rows broadcast it
    return rows, stored(cuts(rows, leaves, seed, id_col), "mixing-cuts")


def mixed(docs: DataFrame, budget: int | None = None, share: float = 0.6, max_epochs: int = 2, weights: dict = WEIGHTS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """(id, domain, lang, source, n_tokens, epoch) of each chosen document, once for each epoch that takes it.

    A null text has no tokens, null languages and sources form leaves named `none`, rows with one id (or none) stand or
    fall together, and an empty table gives no rows.  A leaf's chosen tokens are at most its budget and short of it by
    less than the tokens of the next document in its order.
    """
    rows, leaves = plan(docs, budget, share, max_epochs, weights, seed, id_col)
    of = rows.join(leaves, LEVELS).withColumn("partly", F.coalesce(order_key(F.col("full") + 1, seed, id_col) <= F.col("cut"), F.lit(False)))
    last = F.col("full") + F.col("partly").cast("bigint")
    return of.where(last > 0).select(id_col, *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("epoch"))


def mixed_once(docs: DataFrame, share: float = 0.9, weights: dict = WEIGHTS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that the mixture takes when no document may come twice, with their own columns.

    Null texts have no tokens and null languages and sources form leaves named `none`; rows that share an id (or have
    none) within a leaf stand or fall together; ties in the order are rows of one id; an empty table gives no rows; the
    columns of `docs` may have any names, as the budgets are joined as a column whose name no column of `docs` has.
    """
    _, leaves = plan(docs, None, share, 1, weights, seed, id_col)
    own = "x"
    while own in {c.lower() for c in docs.columns}:
        own += "x"
    leaves = leaves.select(F.struct(*LEVELS, "full", "cut").alias(own))
    on = [c == F.col(f"{own}.{k}") for k, c in leaf_of(docs).items()]
    taken = (F.col(f"{own}.full") > 0) | F.coalesce(order_key(F.lit(1), seed, docs[id_col]) <= F.col(f"{own}.cut"), F.lit(False))
    return docs.join(leaves, on).where(taken).drop(own)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` mixed to 60 % of its tokens by WEIGHTS, two epochs at most."""
    return mixed(table(spark, sf_dir, "documents"))


def _level_sql(level: str, parents: list[str]) -> str:
    """SQL of one level of the tree: CTEs n_<level> (nodes) and b_<level> (their budgets)."""
    keys = ", ".join([*parents, level])
    case = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    up = f"JOIN b_{parents[-1]} USING ({', '.join(parents)})" if parents else "CROSS JOIN top"
    order = f"ORDER BY capacity / w, {level} ROWS UNBOUNDED PRECEDING"
    return f"""
n_{level} AS (SELECT {keys}, sum(capacity)::hugeint AS capacity, {case}::hugeint AS w FROM leaves GROUP BY {keys}),
s_{level} AS (SELECT *, capacity * (sum(w) OVER ({by}) - sum(w) OVER ({by} {order}) + w)
    <= (budget - sum(capacity) OVER ({by} {order}) + capacity) * w AS is_full FROM n_{level} {up}),
f_{level} AS (SELECT *, (budget - coalesce(sum(capacity) FILTER (is_full) OVER ({by}), 0))::hugeint AS rest,
    (sum(w) FILTER (NOT is_full) OVER ({by}))::hugeint AS free_w,
    coalesce(sum(w) FILTER (NOT is_full) OVER ({by} {order}), 0)::hugeint AS upto FROM s_{level}),
b_{level} AS (SELECT {keys}, CASE WHEN is_full THEN capacity ELSE (rest * upto) // free_w - (rest * (upto - w)) // free_w END::hugeint AS budget FROM f_{level}),"""


OP5_SQL = rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS n_tokens FROM documents),
d AS MATERIALIZED (SELECT *, 'domain' || (('0x' || substr(md5(source), 1, 1))::int % 3) AS domain FROM words),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::hugeint AS tokens, (sum(n_tokens) * 2)::hugeint AS capacity FROM d GROUP BY ALL),
top AS (SELECT least((sum(tokens) * 600)::hugeint // 1000, sum(capacity))::hugeint AS budget FROM leaves),
{_level_sql("domain", [])}{_level_sql("lang", ["domain"])}{_level_sql("source", ["domain", "lang"])}
l AS (SELECT domain, lang, source, tokens, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full_epochs, budget
  FROM leaves JOIN b_source USING (domain, lang, source)),
e AS (SELECT d.*, l.tokens, l.full_epochs, l.budget - l.full_epochs * l.tokens AS rest,
    md5('{SEED}:' || (l.full_epochs + 1) || ':' || coalesce(doc_id::varchar, 'null')) AS k FROM d JOIN l USING (domain, lang, source)),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS upto FROM e),
q AS (SELECT *, full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM p)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, n::bigint + 1))::bigint AS epoch FROM q WHERE n > 0
"""
