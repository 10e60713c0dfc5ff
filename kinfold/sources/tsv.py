"""Readers and writers of tab-separated sources, truth, id lists and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import raw

# The columns of source files.
COLUMNS = ["entity_id", "business_name", "business_address", "country"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def _reader(spark: SparkSession, mode: str, schema: str):
    # A row is whole or broken by all its columns, whichever of them a query asks for.
    return spark.read.schema(schema).options(sep="\t", header=True, quote='"', escape='"', mode=mode, nullValue="\u0000", emptyValue="", columnPruning=False)


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Lenient: rows with fewer than four fields go, fields are trimmed, missing ones are empty."""
    rows = _reader(spark, "PERMISSIVE", SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").csv(path)
    short = F.size(F.split(F.coalesce("_bad", F.lit("\t\t\t")), "\t")) < 4
    # Spark refuses to read the column of broken rows alone, as a mere count would: the second condition, always true, reads another.
    return rows.where(~short & (F.length(F.coalesce("entity_id", F.lit(""))) >= 0)).select(*[raw(F.col(c)).alias(c) for c in COLUMNS])


def read_source_strict(spark: SparkSession, path: str) -> DataFrame:
    """Raises on the first malformed row."""
    return _reader(spark, "FAILFAST", SCHEMA).csv(path).select(*[raw(F.col(c)).alias(c) for c in COLUMNS])


def audit_source(spark: SparkSession, path: str) -> DataFrame:
    """rows and bad_rows (not exactly four fields) below the header line, and whether the header is as it should be."""
    lines = spark.read.text(path)
    header = F.lower("value") == "\t".join(COLUMNS)
    fields = F.size(F.split("value", "\t"))
    return lines.agg(
        F.sum((~header).cast("long")).alias("rows"), F.sum((~header & (fields != len(COLUMNS))).cast("long")).alias("bad_rows"), F.max(header).alias("header_ok")
    )


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """Columns by the names in the header, in whatever order the file has them; others are left out."""
    rows = spark.read.options(sep="\t", header=True, quote='"', escape='"', nullValue="\u0000", emptyValue="").csv(path)
    return rows.select(*[raw(F.col(c)).alias(c) for c in COLUMNS])


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """A column `value` of finished lines below a header line in each file, nothing quoted."""
    lines.select(F.col("value").alias(header)).write.mode("overwrite").options(sep="\u0001", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """Rows below a header line; an empty text is written as "", so that it isn't read as a missing one."""
    report.write.options(sep="\t", header=True).csv(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t", header=True, nullValue="\u0000", emptyValue="").csv(path)


def id_array(column: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1_id, cand_ids: the distinct ids of each list, an empty array if there are none."""
    rows = _reader(spark, "PERMISSIVE", "s1_id string, ids string").csv(path)
    return rows.select(raw(F.col("s1_id")).alias("s1_id"), id_array(F.col("ids")).alias("cand_ids"))


def read_id_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ids, on one line or an id a line: every string in it is an id. Files are split at lines."""
    found = F.regexp_extract_all("value", F.lit(r'"((?:[^"\\]|\\.)*)"'), 0)
    return spark.read.text(path).select(F.explode(F.transform(found, lambda x: F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0)))).alias("id"))


def write_id_json(ids: DataFrame, path: str) -> None:
    """A column `id` without repeats as one JSON array, an id a line, in order; one task writes the one file, line by line."""
    last = ids.agg(F.max("id")).first()[0]
    one = F.to_json(F.array("id"))
    items = ids.select(F.lit(1).alias("part"), "id", F.concat(F.substring(one, F.lit(2), F.length(one) - 2), F.when(F.col("id") == last, "").otherwise(",")).alias("value"))
    ends = ids.sparkSession.createDataFrame([(0, None, "["), (2, None, "]")], "part int, id string, value string")
    items.unionByName(ends).repartition(1).sortWithinPartitions("part", "id").select("value").write.mode("overwrite").text(path)


def read_candidates_json(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """JSON objects of id -> ids as pairs: one object in the whole file, or with by_line one on each line."""
    return spark.read.text(path, wholetext=not by_line).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("s1_id", "ids")).select("s1_id", F.explode("ids").alias("cand_id"))


def write_candidates_json(pairs: DataFrame, path: str) -> None:
    """Pairs as JSON objects, one line for each id."""
    lists = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("ids"))
    lists.select(F.to_json(F.create_map("s1_id", "ids")).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def id_lists(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each entity, ids joined by commas in order, empty without any."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("ids"))
    return entities.select("s1_id").join(lists, "s1_id", "left").select("s1_id", F.coalesce("ids", F.lit("")).alias("ids"))


def write_id_lists(entities: DataFrame, pairs: DataFrame, path: str, header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> None:
    """Writes beside the target and renames, so that a reader never sees half of a result."""
    spark = entities.sparkSession
    id_lists(entities, pairs).toDF(*header).write.mode("overwrite").options(sep="\t", header=True, emptyValue="", quote="").csv(path + ".inprogress")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop(path), True)
    fs.rename(hadoop(path + ".inprogress"), hadoop(path))
