"""Checks of result files: id, list of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_lines(lines: DataFrame) -> DataFrame:
    """value -> id, ids, malformed; a line without a tab is malformed."""
    parts = F.split("value", "\t", 2)
    ids = F.filter(F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.select(F.trim(F.get(parts, F.lit(0))).alias("id"), ids.alias("ids"), (~F.contains(F.col("value"), F.lit("\t"))).alias("malformed"))


def check_header(line: str | None, expected: tuple[str, str]) -> str:
    """ok, empty, comma (a CSV header) or wrong."""
    if line is None or not line.strip():
        return "empty"
    found = [x.strip().lower() for x in line.rstrip("\r\n").split("\t")]
    if found == list(expected):
        return "ok"
    return "comma" if [x.strip().lower() for x in line.split(",")] == list(expected) else "wrong"


def issues(parsed: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """issue, n: how often each rule is broken. required: ids that must occur; known: ids that lists may hold."""
    good = parsed.where("not malformed")
    ids = F.col("ids")
    flags = {
        "intra_duplicate": F.size(ids) != F.size(F.array_distinct(ids)), "self_match": F.exists(ids, lambda x: F.startswith(x, F.lit("S1-"))),
        "bad_prefix": F.exists(ids, lambda x: ~x.rlike("^S[123]-")),
    }
    counts = good.agg(*[F.sum(c.cast("long")).alias(k) for k, c in flags.items()])
    rows = counts.unpivot([], list(flags), "issue", "n")
    repeats = good.groupBy("id").count().where("count > 1")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("issue"), "n")
    parts = [
        one("malformed", parsed.where("malformed")), one("duplicate_row", repeats), one("missing", required.select("id").join(good.select("id"), "id", "left_anti")),
        one("extra", good.select("id").distinct().join(required.select("id"), "id", "left_anti")),
    ]
    if known is not None:
        listed = good.select(F.explode("ids").alias("id")).distinct()
        parts.append(one("unknown", listed.join(known.select("id"), "id", "left_anti")))
    for part in parts:
        rows = rows.unionByName(part)
    return rows.select("issue", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched pairs that are no candidates: a warning for files, an error in the lockstep check."""
    return matches.join(candidates, ["s1_id", "cand_id"], "left_anti")


def lockstep(source: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Row-by-row check of three files of (pos, id[, ids]): positions whose ids differ or whose matches are no candidates."""
    met = source.select("pos", F.col("id").alias("s")).join(candidates.select("pos", F.col("id").alias("c"), F.col("ids").alias("cs")), "pos", "full").join(matches.select("pos", F.col("id").alias("m"), F.col("ids").alias("ms")), "pos", "full")
    wrong = ~(F.col("s").eqNullSafe(F.col("c")) & F.col("s").eqNullSafe(F.col("m"))) | (F.size(F.array_except("ms", "cs")) > 0)
    return met.where(F.coalesce(wrong, F.lit(True))).select("pos", "s", "c", "m")


def examples(parsed: DataFrame, required: DataFrame, known: DataFrame | None = None, most: int = 5) -> DataFrame:
    """issue, n and the first `most` ids of each broken rule, joined by commas; n is 0 for rules that hold. A file fails if any n is above 0."""
    good = parsed.where("not malformed")
    ids = F.col("ids")
    rules = {
        "malformed": F.col("malformed"), "intra_duplicate": ~F.col("malformed") & (F.size(ids) != F.size(F.array_distinct(ids))),
        "self_match": ~F.col("malformed") & F.exists(ids, lambda x: F.startswith(x, F.lit("S1-"))), "bad_prefix": ~F.col("malformed") & F.exists(ids, lambda x: ~x.rlike("^S[123]-")),
    }
    broken = parsed.select("id", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda k: k.isNotNull())).alias("issue"))
    tag = lambda name, df: df.select("id", F.lit(name).alias("issue"))
    broken = (
        broken.unionByName(tag("duplicate_row", good.groupBy("id").count().where("count > 1")))
        .unionByName(tag("missing", required.select("id").join(good.select("id"), "id", "left_anti")))
        .unionByName(tag("extra", good.select("id").distinct().join(required.select("id"), "id", "left_anti")))
    )
    names = [*rules, "duplicate_row", "missing", "extra"]
    if known is not None:
        broken = broken.unionByName(tag("unknown", good.select(F.explode("ids").alias("id")).distinct().join(known.select("id"), "id", "left_anti")))
        names.append("unknown")
    # Every task keeps its first few ids of a rule before anything is shuffled.
    first = broken.withColumn("r", F.row_number().over(Window.partitionBy("issue").orderBy("id"))).where(F.col("r") <= most)
    listed = first.groupBy("issue").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    counts = broken.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    rules_of = parsed.sparkSession.createDataFrame([(n,) for n in names], "issue string")
    return rules_of.join(counts, "issue", "left").join(listed, "issue", "left").select("issue", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("ids", F.lit("")).alias("ids"))


def strict(source: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """pos, problem: the first rule that each row of three files of lines (pos, value) breaks, read in step.

    Rows have 4, 2 and 2 columns; all three files have the same rows and ids at the same places; lists repeat no id and hold only S2 and S3
    records; matches are among the candidates.
    """
    def read(df: DataFrame, name: str) -> DataFrame:
        fields = F.split("value", "\t")
        ids = F.when(F.coalesce(F.get(fields, F.lit(1)), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(fields, F.lit(1)), ","))
        return df.select("pos", F.struct(F.get(fields, F.lit(0)).alias("id"), F.size(fields).alias("n"), ids.alias("ids")).alias(name))

    met = read(source, "s").join(read(candidates, "c"), "pos", "full").join(read(matches, "m"), "pos", "full")
    repeats = lambda x: F.size(x) != F.size(F.array_distinct(x))
    outside = lambda x: F.exists(x, lambda v: ~v.rlike("^S[23]-"))
    c, m = F.col("c.ids"), F.col("m.ids")
    problem = (
        F.when(F.col("s").isNull() | F.col("c").isNull() | F.col("m").isNull(), "row_count").when((F.col("s.n") != 4) | (F.col("c.n") != 2) | (F.col("m.n") != 2), "columns")
        .when((F.col("s.id") != F.col("c.id")) | (F.col("s.id") != F.col("m.id")), "id_order").when(repeats(c) | repeats(m), "duplicate")
        .when(outside(c) | outside(m), "prefix").when(F.size(F.array_except(m, c)) > 0, "subset")
    )
    return met.select("pos", problem.alias("problem")).where("problem is not null")
