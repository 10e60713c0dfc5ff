"""Nearest neighbours by cosine, within a group, and their union with lexical candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most items and queries, about, that one task multiplies at a time.
ITEMS, QUERIES = 8192, 1024


def _best(k: int):
    """The k best items of a block for each query of a block, by one matrix product."""
    def unit(rows: pa.Table) -> np.ndarray:
        vectors = rows.column("vector").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        norms = np.linalg.norm(flat, axis=1, keepdims=True)
        return np.divide(flat, norms, out=np.zeros_like(flat), where=norms > 0)

    def run(cell: pa.Table) -> pa.Table:
        asks = cell.column("asks")
        queries, items = cell.filter(asks), cell.filter(pc.invert(asks))
        asked, ids, rows = [], [], []
        if queries.num_rows and items.num_rows:
            likeness = np.round(unit(queries) @ unit(items).T, 6) + 0.0
            names = items.column("id").to_numpy()
            for q, row in zip(queries.column("id").to_pylist(), likeness, strict=True):
                first = np.lexsort((names, -row))[:k]
                asked += [q] * len(first)
                ids += names[first].tolist()
                rows += row[first].tolist()
        return pa.table({"query_id": pa.array(asked, pa.int64()), "item_id": pa.array(ids, pa.int64()), "similarity": pa.array(rows, pa.float64())})

    return run


def nearest(queries: DataFrame, items: DataFrame, k: int, group: str) -> DataFrame:
    """The k items most like each query (long id, group, vector) in its group; ties go to the smaller id. Null vectors are left out.

    The items of a group fall into blocks, and so do its queries; each pair of blocks is one matrix product that keeps k items a
    query, so no row is made for a pair, and a group of any size is spread over tasks. All vectors have one length.
    """
    counts = lambda df, most, name: df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    queries, items = (df.select("id", group, "vector").where("vector is not null") for df in (queries, items))
    blocks = counts(queries, QUERIES, "q").join(counts(items, ITEMS, "i"), group)
    block, every = (lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    asked = queries.join(blocks, group).select("id", "vector", group, block("q").alias("qb"), every("i").alias("ib"), F.lit(True).alias("asks"))
    held = items.join(blocks, group).select("id", "vector", group, every("q").alias("qb"), block("i").alias("ib"), F.lit(False).alias("asks"))
    found = asked.unionByName(held).groupBy(group, "qb", "ib").applyInArrow(_best(k), "query_id long, item_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def union_dense(lexical: DataFrame, dense: DataFrame, bit: int = 62) -> DataFrame:
    """Lexical pairs (mask, hits) and dense ones; pairs found by vectors alone have no hits."""
    flag = F.lit(1 << bit).cast("long")
    both = lexical.select("s1_id", "cand_id", "mask", "hits").join(dense.select("s1_id", "cand_id", flag.alias("d")), ["s1_id", "cand_id"], "full")
    return both.select("s1_id", "cand_id", F.coalesce("mask", F.lit(0).cast("long")).bitwiseOR(F.coalesce("d", F.lit(0).cast("long"))).alias("mask"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))
