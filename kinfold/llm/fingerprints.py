"""Canonical exact digests of documents, in DataFrame expressions only.

A text's canonical form is NFKC, then full case folding, NFKC again, white space runs to one space, trimmed. Its digest is
128 bits: two xxhash64 values with different seeds, as hex. Likeness is exact: digests are compared first and,
where they agree, the canonical bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hex64, let, long_array, text_or_empty

#: Documents in a run of the neighbour search, on average, and the most runs; every FINE-th of the sampled ids begins a run, which keeps runs even.
RUN, RUNS, FINE = 1024, 50_000, 16


def canonical(text: Column) -> Column:
    """ICU's normaliser and case folding through `reflect`; plain ASCII takes the short way to the same result."""
    def nfkc(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = nfkc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(plain, r"[\s\x1C-\x1F\x85\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    return F.concat(hex64(F.xxhash64(canon)), hex64(F.xxhash64(F.lit(0x5EED), canon)))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal canonical texts: fingerprint, group_id (smallest doc_id), copies.

    Grouping hashes the digest and compares the canonical bytes, in the map tasks first, so that copies of one text
    meet as one row. Texts that differ under one digest stay apart. A null text counts as empty; a null doc_id counts as a copy only.
    """
    canon = canonical(text_or_empty())
    return (
        docs.select("doc_id", canon.alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
        .groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
        .drop("canon")
    )


def _run_of(doc_id: Column, begins: list[int]) -> Column:
    """How many of the sorted begins are at most doc_id, by bisection in a constant array; -1 for null."""
    if not begins:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0))
    held = long_array(begins)

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        more = (at["low"] < at["high"]) & (F.get(held, middle) <= doc_id)
        return F.struct(
            F.when(more, middle + 1).otherwise(at["low"]).alias("low"),
            F.when((at["low"] < at["high"]) & ~more, middle).otherwise(at["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.lit(len(begins).bit_length()))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(begins)).alias("high")), halve)["low"]
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(found)


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document with its fingerprint and that of the text edited with the next document's beginning.

    The next document is that with the next smaller doc_id; after the last comes the first. The last
    floor(n_chars / 2) code points give way to the first as many, or all, of the next document. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty; null ids come
    after all others; rows with the same id follow by the hash of their text. A single document is its own next.

    Runs of about RUN documents begin at ids of a sample that a hash chooses, at most about RUNS of them, so that runs are even however
    the ids are spread; rows that share an id, or have none, lie in one run. One shuffle of the texts puts neighbours together,
    and the last row of each run gets the first of the next, found by an aggregation that keeps one row a run before anything is shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    low, known, n = docs.agg(F.min("doc_id"), F.count("doc_id"), F.count(F.lit(1))).first()
    share = max(1, RUN // FINE, -(-known // (RUNS * FINE)))
    sample = sorted(r[0] for r in docs.select("doc_id").where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(share)) == 0).where("doc_id is not null").distinct().collect())
    begins = sample[::FINE]
    # Runs in descending order of ids; null ids come last.
    runs = [*range(len(begins), 0, -1), *([0] if known and (not begins or low < begins[0]) else []), *([-1] if n > known else [])]
    runs = runs or [-1]
    before = F.when(F.col("run") == runs[0], runs[-1])
    for k in range(max(1, len(runs) - 2), len(runs)):  # the run before 0 or -1 need not be 1 or 0
        before = before.when(F.col("run") == runs[k], runs[k - 1])
    placed = docs.select(_run_of(F.col("doc_id"), begins).alias("run"), "doc_id", "text")
    first = F.min_by("text", F.struct(F.bitwise_not("doc_id"), F.xxhash64("text"), F.length("text").cast("long")))
    heads = placed.groupBy("run").agg(first.alias("head")).select(
        before.otherwise(F.col("run") + 1).cast("int").alias("run"), "head", digest(canonical(F.col("head"))).alias("head_fingerprint")
    )
    base = placed.select(
        "run", "doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("tie"), digest(canonical(F.col("text"))).alias("fingerprint")
    )
    by_run = Window.partitionBy("run").orderBy(F.col("doc_id").desc_nulls_last(), "tie", "n_chars")
    lined = base.select("*", F.lead("text").over(by_run).alias("next_text"), F.lead("fingerprint").over(by_run).alias("next_fingerprint"))
    last = (lined["run"] == heads["run"]) & lined["next_fingerprint"].isNull()
    both = lined.join(heads, last, "left").select(
        "doc_id", "text", "n_chars", "fingerprint", F.coalesce("next_text", "head").alias("next_text"), F.coalesce("next_fingerprint", "head_fingerprint").alias("next_fingerprint")
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))

    def judged(x: Column) -> Column:
        canon = canonical(x)
        return let(canon, lambda c: let(digest(c), lambda d: F.struct(
            F.sha2(x, 256).alias("sha"), d.alias("fp"),
            F.when(d != F.col("fingerprint"), 0.0).otherwise((c == canonical(F.col("text"))).cast("double")).alias("near"),
        )))

    near_next = F.when(F.col("fingerprint") != F.col("next_fingerprint"), 0.0).otherwise(
        (canonical(F.col("text")) == canonical(F.col("next_text"))).cast("double")
    )
    return both.select("doc_id", "n_chars", let(edited, judged).alias("e"), "fingerprint", near_next.alias("near_next")).select(
        "doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), "fingerprint", F.col("e.fp").alias("edited_fingerprint"),
        F.col("e.near").alias("near_edited"), "near_next",
    )
