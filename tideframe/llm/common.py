"""Helpers shared by the corpus operators: shared storage, row order, global ranks, components."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds of one Arrow batch sent to Python: whole texts travel, so its bytes are bounded beside its rows.
BATCH_ROWS = 4096
BATCH_BYTES = 4 << 20
#: Cut points of an id order are literals of the plan, so their number is bounded; larger blocks are sorted on disk.
MOST_BLOCKS = 1 << 16
#: Blocks of a hash order: 2 to this power. A group that holds a third of all rows is ranked in as many tasks.
HASH_BLOCK_BITS = 10


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the size of Arrow batches, unless the session has a smaller bound: whole texts travel to the workers.

    Spark reads these settings when a plan runs, which may be long after the operator returned, so they
    stay set in the session.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).removesuffix("b")
        if not (now.isdecimal() and 0 < int(now) <= most):
            spark.conf.set(name, most)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a private one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tideframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark deletes the shuffle files of an execution when it ends, rather than when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and safe when executors go.

    ``tidy`` deletes the shuffle files of this step as it ends; they are this write's own, so no other plan reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy and before is not None:
            spark.conf.set(_CLEANUP, before)
        elif tidy:
            spark.conf.unset(_CLEANUP)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    # The shuffle files of this step are garbage now; they go when the driver collects its own.
    spark._jvm.java.lang.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a table that ``keep`` stored, once nothing that is still to run reads it."""
    files = table.inputFiles()
    if files:
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(df: DataFrame, key: str, blocks: int) -> list[int]:
    """Ascending cut points that split ``key`` into about equal blocks; only the key column is read."""
    blocks = min(blocks, MOST_BLOCKS)
    if blocks < 2:
        return []
    probs = [i / blocks for i in range(1, blocks)]
    found = df.select(F.col(key).cast("double").alias("k")).na.drop().approxQuantile("k", probs, 0.25 / blocks)
    return sorted({int(x) for x in found})


def block_of(key: Column, bounds: list[int]) -> Column:
    """How many cut points lie at or below ``key``: 0 for null keys, len(bounds) for the largest.

    Looked up in two steps, of about the square root of their number each.
    """
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    firsts = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    cuts = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    group = F.size(F.filter(firsts, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(cuts, F.greatest(group, F.lit(1))), lambda b: b <= key))
    return F.coalesce(F.when(group > 0, (group - 1) * width + inside), F.lit(0)).cast("int")


def hash_block(key: Column) -> Column:
    """The block of a row in the order of a 64-bit hash: its leading bits, ascending with the signed hash."""
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(2**63))), 64 - HASH_BLOCK_BITS).cast("int")


def ranked(df: DataFrame, group: list[str], order: list[Column], block: Column, name: str = "rank") -> DataFrame:
    """1-based rank of each row inside its group, without sending a group to one task.

    ``block`` must not decrease along ``order``. Rows are numbered inside (group, block); the sizes of
    the blocks before it are added. The sizes table has a row per (group, block) only.
    """
    inner = df.withColumn("_block", block)
    sizes = inner.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inner = inner.withColumn("_row", F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order)))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_block"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = inner.alias("l").join(sizes.alias("r"), cond)
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("l._row") + F.col("r._before")).alias(name))


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of undirected ``links(a, b)`` as rows (node, component): its smallest node.

    Alternating large-star and small-star rounds; each is an aggregation (with map-side combine) and
    an equi-join that AQE can split, and the edge table never grows. Nodes without links are absent.
    """

    def fingerprint(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    last = None
    while (now := fingerprint(edges)) != last:
        last = now
        two = both(edges)
        low = two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = two.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), "m")
        small = small.where("a <> m").select("a", F.col("m").alias("b")).distinct()
        edges = keep(small, name)
    member = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = edges.select(F.col("b").alias("node")).distinct().join(member.select("node"), "node", "left_anti")
    return member.unionByName(roots.withColumn("component", F.col("node")))
