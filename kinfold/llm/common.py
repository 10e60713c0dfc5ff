"""Shared helpers: table access, tables written to the cluster's shared folder, connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tidy

#: Keys with more rows than HOT, or than a part in MOST_HOT of all rows, are joined by broadcast: there are at most MOST_HOT of them.
HOT, MOST_HOT = 1000, 100_000

_staged: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, outlives any executor, and leaves no shuffle files.

    What nobody unstages, because a result still reads it, is deleted when the driver ends, or by release_all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold-{label}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinfold_path = path
    _staged.add(path)
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete the files behind staged tables that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession.sparkContext, df._kinfold_path)


def _delete(context: SparkContext, name: str) -> None:
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    _staged.discard(name)


def release_all() -> None:
    """Delete every staged table; results that haven't been read yet are lost."""
    context = SparkContext._active_spark_context
    if context is not None:
        for name in sorted(_staged):
            _delete(context, name)


atexit.register(release_all)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_limit(total: int) -> int:
    """Keys with more rows than this are hot; total is the number of rows, so that at most MOST_HOT keys are."""
    return max(HOT, total // MOST_HOT)


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, how: str = "inner", most: int | None = None) -> DataFrame:
    """rows joined (inner or left) with facts, one row a key, whose column n counts the rows of the key.

    The few keys that hold many rows are joined by broadcast, so that their rows stay where they are; all others by
    shuffling, with at most hot_limit(total) rows of a key in a task. Column n doesn't come out. rows is read twice.
    most, where the caller knows it, is n of the largest key or more: if that isn't hot, one plain join is planned, without broadcasts.
    """
    limit = hot_limit(total)
    if min(total, total if most is None else most) <= limit:
        return rows.join(facts.drop(n), keys, how)
    hot, cold = F.broadcast(facts.where(F.col(n) > limit).drop(n)), facts.where(F.col(n) <= limit).drop(n)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(facts.where(F.col(n) > limit).select(*keys)), keys, "left_anti").join(cold, keys, how))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def hex64(value: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def long_array(values) -> Column:
    """A constant array of longs; the optimiser folds it, so that each row looks into the same array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once for each row however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), 0)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: two long columns, any names, read as undirected; nulls and self-loops are ignored.
    Returns (node, label) for every node that has an edge; label is the smallest node of its component.
    Each round is an aggregation with map-side combining and a join that leaves the edges of hubs where they are, so
    that a hub with a large share of the edges doesn't land in one task. The rounds are written
    to the shared folder. Their number grows with the logarithm of the component size; none follows once each component
    is a star around its smallest node. The driver's garbage is collected after each round, since plans and broadcasts
    of many rounds would otherwise widen its heap and stay in the executors' memory.
    """
    a, b = edges.columns[:2]
    now = stage(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    while True:
        n, most, most_up, is_open = _shape(now)
        if not is_open:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        met = join_hot(both, least, ["u"], "n", 2 * n, most=most)
        large = stage(met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        root = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # A node has at most one row in large for each of its edges to a smaller node.
        small = (
            join_hot(large, root, ["u"], "n", 2 * n, most=most_up).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(root.select("u", F.col("m").alias("v")))
            .where("u != v").distinct()
        )
        after = stage(small, "edges")
        unstage(now, large)
        now = after
        collect_garbage(now.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _shape(edges: DataFrame) -> tuple[int, int, int, bool]:
    """Of distinct edges (u, v) with u > v: their number, the most edges of a node, the most to smaller nodes, and whether a node has two smaller ones or both kinds."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    is_open = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    n, most, most_up, open_ = nodes.agg(F.sum("up"), F.max(F.col("up") + F.col("down")), F.max("up"), F.max(is_open)).first()
    return n or 0, most or 0, most_up or 0, bool(open_)


def collect_garbage(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage now: its heap shrinks to what it holds, and Spark removes broadcasts that no plan uses."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
