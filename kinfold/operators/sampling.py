"""Deterministic samples and splits: md5 gives the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order(seed: str, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *columns))


def bottom_k(df: DataFrame, n: int, seed: str, *columns: str) -> DataFrame:
    """n rows, the same in every run."""
    return df.orderBy(order(seed, *columns), *columns).limit(n)


def ranked(df: DataFrame, key: str, run: int = 4096, most: int = 50_000) -> DataFrame:
    """Adds rank, the row's place from 1 on in the order of key, a string column without repeats.

    Rows fall into about one cell for every `run` of them, at most about `most`, that begin at keys which a hash chooses; ranks within cells and the
    sums of the cells before give the place, so no task ranks all rows.
    """
    share = max(run, df.count() // most)
    begins = sorted(r[0] for r in df.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(key).distinct().collect())
    held = F.array(*map(F.lit, begins)).cast("array<string>")

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        more, going = F.get(held, middle) <= F.col(key), at["low"] < at["high"]
        return F.struct(F.when(going & more, middle + 1).otherwise(at["low"]).alias("low"), F.when(going & ~more, middle).otherwise(at["high"]).alias("high"))

    cell = F.aggregate(F.sequence(F.lit(0), F.lit(len(begins).bit_length())), F.struct(F.lit(0).alias("low"), F.lit(len(begins)).alias("high")), halve)["low"] if begins else F.lit(0)
    celled = df.withColumn("_cell", cell)
    before = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).drop("_n")  # one row a cell
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_cell").orderBy(key))
    return celled.join(before, "_cell").withColumn("rank", place).drop("_cell", "_before")


def stratified_split(entities: DataFrame, strata: list[str], ratio: float = 0.2, seed: str = "42") -> DataFrame:
    """Adds fold: the first floor(n * ratio) of each stratum are `val`, the others `train`.

    Strata may hold most rows, so ranks aren't taken over a stratum: its rows fall into 256 cells by the first
    digits of their md5, and only ranks within cells and sums over cells are needed.
    """
    keyed = entities.withColumn("_o", order(seed, "s1_id")).withColumn("_c", F.substring("_o", 1, 2))
    cells = keyed.groupBy(*strata, "_c").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*strata)
    cells = cells.withColumns({"_before": F.sum("_n").over(by.orderBy("_c")) - F.col("_n"), "_take": F.floor(F.sum("_n").over(by) * ratio)}).drop("_n")
    same = [keyed[c].eqNullSafe(cells[c]) for c in [*strata, "_c"]]
    met = keyed.join(cells, [*same], "left").select(keyed["*"], cells["_before"], cells["_take"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*strata, "_c").orderBy("_o", "s1_id"))
    return met.withColumn("fold", F.when(place <= F.col("_take"), "val").otherwise("train")).drop("_o", "_c", "_before", "_take")
