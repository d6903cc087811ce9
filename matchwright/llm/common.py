"""What the operators of this subpackage share: inputs, written cuts of the lineage, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch to Python workers, unless one row is larger.  Texts can be long, so less than Spark's 10,000 and 64 MB.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """`df.mapInArrow(run, schema)` by batches of bounded size; the two settings hold for the session from then on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only a local session may go without; it gets its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"/tmp/checkpoints/{sc.applicationId}"
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths in the shared folder that this process has given out.
_GIVEN: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _GIVEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _GIVEN[-1]


def clear(spark: SparkSession) -> int:
    """Deletes all that operators of this process have written to the shared folder; their results must have been read or written by then."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    gone = sum(hadoop(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(p), True) for p in _GIVEN)
    _GIVEN.clear()
    return gone


def relieved(spark: SparkSession) -> bool:
    """Gives back to the system what the driver's JVM holds without need; whether the JVM could trim its C heap.

    Hundreds of small plans leave hundreds of MB in the arenas of malloc (the compilers' and the network's, freed there and
    kept), which no garbage collection touches; HotSpot's `System.trim_native_heap` hands them back.  The Java heap is
    collected once more than half of what it may have is taken, since what one step leaves is garbage for the next.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        jvm.java.lang.System.gc()
    try:
        server, of = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.java.lang.Class.forName
        texts = gateway.new_array(jvm.java.lang.String, 0)
        kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for k, (kind, value) in enumerate((("javax.management.ObjectName", jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")), ("java.lang.String", "systemTrimNativeHeap"), ("[Ljava.lang.Object;", gateway.new_array(jvm.java.lang.Object, 0)), ("[Ljava.lang.String;", texts))):
            kinds[k], given[k] = of(kind), value
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JError:  # another JVM, or an older one
        return False
    return True


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Cuts the lineage: writes `df` as Parquet in the shared folder and reads it again.

    `few`: rows that come straight from a scan are dealt anew by size, so that a slim table is not a file for each split.
    """
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    (df.hint("rebalance") if few else df).write.option("compression", "zstd").parquet(path)
    relieved(spark)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def first_of_class(ids: DataFrame, class_col: str, limit: int, name: str, classes: int = 256) -> DataFrame:
    """Of each of the `classes` most frequent classes of `ids` (_id, class, _key), the `limit` rows that come first by (_key, _id); keys are hashes.

    Row counts of the classes tell how low a key must be for about eight times `limit` rows, so only those reach the
    task that ranks a class, at any size of the input.  The bound is raised until no class falls short (ids that repeat
    can leave gaps), so the rows are exactly the first ones.  The counts are one row a class, as the trained models
    are, and so few that they are broadcast.
    """
    sizes = stored(ids.groupBy(class_col).agg(F.count("*").alias("_size")).orderBy(F.desc("_size"), class_col).limit(classes), f"{name}-sizes")
    place = F.col("_key").cast("double") / 2.0**64 + 0.5
    wide = 8.0
    while True:
        low = stored(ids.join(F.broadcast(sizes), class_col).where(place * F.col("_size") <= wide * limit).drop("_size"), f"{name}-low", few=True)
        got = low.groupBy(class_col).agg(F.count("*").alias("_got"))
        if sizes.join(got, class_col, "left").where(F.coalesce("_got", F.lit(0)) < F.least("_size", F.lit(limit))).isEmpty():
            break
        wide *= 64
    ranked = low.withColumn("_n", F.row_number().over(Window.partitionBy(class_col).orderBy("_key", "_id")))
    return stored(ranked.where(F.col("_n") <= limit).drop("_n").distinct(), name)


def unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Joins the components of x[i] and y[i]; root holds each node's least node."""
    while True:
        a, b = root[x], root[y]
        unlike = a != b
        if not unlike.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[unlike], np.minimum(a, b)[unlike])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def contracted(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of each partition as stars (node, least node) with the same components: what a task holds is one partition of pairs of numbers."""

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        a, b = (np.concatenate(x) for x in zip(*got, strict=True))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = unite(np.arange(len(nodes)), place[: len(a)], place[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    return in_batches(edges, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b), two bigint columns without nulls: (node, root), root the least node.

    Each partition's edges are contracted to stars, then large-star and small-star steps alternate; each step is two
    keyed aggregations and a sort-merge join that AQE can split, and is written to the shared folder, so neither a hub
    nor a long chain gathers in one task or in the lineage.  A chain of n nodes needs about log2(n) steps at most, edges
    that fit one partition need one.  Nodes without an edge to another node are not returned.
    """

    def tally(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def written(pairs: DataFrame) -> DataFrame:
        return stored(contracted(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")

    now = written(edges.where("a <> b"))
    seen = tally(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))))
        got = tally(now)
        if got == seen:
            break
        seen = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
