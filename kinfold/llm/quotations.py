"""Quotation linking: conversations ordered by reply, without the quotes, in DataFrame expressions only.

A line that begins with > marks is a quotation whose level is the number of marks. Lines are normalised (lower case, white
space runs to one space, trimmed); runs of lines of one level are passages. Lines and passages are joined to the first message of the same
conversation that wrote them itself: as a line or the whole message or, where there is none such before, as whole words anywhere in its own
text. Runs of up to SPAN words are compared by their hashes; a longer one is looked up by one run of SPAN words of it, and the whole is then compared as text.
A table of bits lets the runs that nobody quotes go before anything is shuffled. A message replies to the message that most of its passages of the lowest level come from,
the latest of equals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex64, let, stage, text_or_empty, unstage
from .decontaminate import MAX_BITS, _bits, _cell, _is_set

SPAN = 6
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
SAID = r"(?i)^\s*(on\b.*\bwrote|.{0,200}\bwrote|.{0,200}\bwrites):\s*$"


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def _lines(text: Column) -> Column:
    """Structs of level and content, in order."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 1)
        return F.struct(F.length(F.regexp_replace(marks, r"[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("said"))

    return F.transform(F.split(text, "\r?\n"), line)


def _own(lines: Column) -> Column:
    """The message's own lines; a line that introduces a quotation ("... wrote:") goes with it."""
    def kept(x: Column, i: Column) -> Column:
        quoted_next = F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
        return (x["level"] == 0) & ~(x["said"].rlike(SAID) & quoted_next)

    return F.transform(F.filter(lines, kept), lambda x: x["said"])


def _passages(lines: Column) -> Column:
    """Quoted passages: runs of quoted lines of one level, each joined to one line; linear in the lines."""
    def level(i: Column) -> Column:
        return F.get(lines, i)["level"]

    def runs(begins: Column) -> Column:
        ends = F.transform(begins, lambda b, k: F.struct(b.alias("begin"), F.coalesce(F.get(begins, k + 1), F.size(lines)).alias("end")))
        return F.transform(
            F.filter(ends, lambda r: level(r["begin"]) > 0),
            lambda r: F.struct(
                level(r["begin"]).alias("level"),
                F.concat_ws(" ", F.transform(F.slice(lines, r["begin"] + 1, r["end"] - r["begin"]), lambda x: x["said"])).alias("said"),
            ),
        )

    begins = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    return let(begins, runs)


def _runs_of(said: Column, n: int) -> Column:
    """Hashes of all runs of n words of a normalised text."""
    def hashes(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))
        return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<bigint>"))

    return let(F.split(said, " "), hashes)


def _contained(quoted: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, passage and within, the first turn whose own text holds the passage as whole words."""
    units = quoted.select("conv_id", "passage", "said").dropDuplicates(["conv_id", "passage"])
    units = units.withColumn("n", F.size(F.split("said", " ")))
    seed = F.coalesce(*[F.when(F.least("n", F.lit(SPAN)) == n, F.array_min(_runs_of(F.col("said"), n))) for n in range(1, SPAN + 1)])
    units = stage(units.withColumn("seed", F.xxhash64("conv_id", seed)), "passages")
    size = units.agg(F.count(F.lit(1)), F.collect_set(F.least("n", F.lit(SPAN)))).first()
    bits = min(MAX_BITS, max(14, math.ceil(math.log2(32 * max(1, size[0])))))
    wanted = _bits(units.select(F.explode(F.array(_cell(F.col("seed"), bits), _cell(F.col("seed"), bits, 1))).alias("cell")), bits)

    def known(h: Column) -> Column:
        return _is_set(wanted, _cell(h, bits)) & _is_set(wanted, _cell(h, bits, 1))

    runs = [F.filter(F.transform(_runs_of(F.col("own"), n), lambda h: F.xxhash64("conv_id", h)), known) for n in sorted(size[1])]
    seeds = F.array_distinct(F.concat(F.array().cast("array<bigint>"), *runs))
    # Messages of one text count once, so that a line that very many messages share makes no row for each.
    held = messages.groupBy("conv_id", F.xxhash64("own").alias("whole"), "own").agg(F.min("turn").alias("turn")).select("conv_id", "turn", "whole", F.explode(seeds).alias("seed"))
    met = (
        held.join(units.select("conv_id", "seed", "passage", "n"), ["conv_id", "seed"])
        .groupBy("conv_id", "passage", "n", "whole").agg(F.min("turn").alias("turn"))
    )
    texts = messages.groupBy("conv_id", F.xxhash64("own").alias("whole"), "own").agg(F.min("turn").alias("turn"))
    long = (
        met.where(F.col("n") > SPAN).join(units.select("conv_id", "passage", "said"), ["conv_id", "passage"]).join(texts, ["conv_id", "turn", "whole"])
        .where(F.instr(F.concat(F.lit(" "), "own", F.lit(" ")), F.concat(F.lit(" "), "said", F.lit(" "))) > 0)
    )
    found = met.where(F.col("n") <= SPAN).select("conv_id", "passage", "turn").unionByName(long.select("conv_id", "passage", "turn"))
    return found.groupBy("conv_id", "passage").agg(F.min("turn").alias("within"))


def link_quotations(conversations: DataFrame) -> DataFrame:
    """One row per row of conversations: conv_id, turn, role, text, n_quoted, reply_to, thread_root, depth, order_key.

    text is the message without quotations and the lines that introduce them. n_quoted counts quoted lines;
    reply_to is the turn replied to, null if the message quotes nothing that an earlier turn wrote; thread_root
    and depth give the reply tree. Sorting a conversation by order_key gives its threads one after the other, each message
    after the one it replies to; `build_conversations` does so.
    Passages that a message quotes from itself or a later turn link nothing. A null text is empty; rows with a null conv_id or turn
    pass through without links; rows that repeat a turn share their links. Other columns are left out.
    """
    parsed = conversations.select("conv_id", "turn", "role", _lines(text_or_empty()).alias("lines"))
    parsed = parsed.select("conv_id", "turn", "role", "lines", F.aggregate("lines", F.lit(0), lambda n, x: n + (x["level"] > 0).cast("int")).alias("n_quoted"))
    quoting = parsed.where("n_quoted > 0 and conv_id is not null and turn is not null")
    single = F.filter("lines", lambda x: x["level"] > 0)
    quoted = (
        quoting.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(single, _passages(F.col("lines"))))).alias("q"))
        .select("conv_id", "turn", F.col("q.level").alias("level"), normal(F.col("q.said")).alias("said")).where("said <> ''")
        .select("conv_id", "turn", "level", F.xxhash64("said").alias("passage"), "said").dropDuplicates(["conv_id", "turn", "level", "passage"])
    )
    quoted = stage(quoted, "quoted")
    own = _own(F.col("lines"))
    # Conversations that quote something, and perhaps a few others: no conversation is shuffled as a whole.
    here = F.xxhash64("conv_id")
    named = quoted.select("conv_id").distinct()
    bits = min(MAX_BITS, max(14, math.ceil(math.log2(32 * max(1, named.count())))))
    quoting = _is_set(_bits(named.select(_cell(here, bits).alias("cell")), bits), _cell(here, bits))
    messages = stage(
        parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & quoting)
        .select("conv_id", "turn", own.alias("written"), normal(F.concat_ws(" ", own)).alias("own")).where("own <> ''"),
        "own",
    )
    written = (
        messages.select("conv_id", "turn", F.explode(F.concat(F.transform("written", normal), F.array("own"))).alias("said")).where("said <> ''")
        .groupBy("conv_id", F.xxhash64("said").alias("passage")).agg(F.min("turn").alias("origin"))
    )
    sources = (
        quoted.drop("said").join(written, ["conv_id", "passage"], "left").join(_contained(quoted, messages), ["conv_id", "passage"], "left")
        .withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")).otherwise(F.col("within")))
    )
    votes = (
        sources.where("origin < turn")
        .groupBy("conv_id", "turn", "origin").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("n"))
    )
    edges = stage(votes.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "n", "origin")).alias("reply_to")), "replies")
    unstage(quoted)
    unstage(messages)
    roots = _roots(edges)
    linked = parsed.join(roots, ["conv_id", "turn"], "left")
    text = F.regexp_replace(F.concat_ws("\n", own), r"^\s+|\s+$", "")
    root = F.coalesce("thread_root", "turn")
    return linked.select(
        "conv_id", "turn", "role", F.when(F.col("n_quoted") > 0, text).otherwise(F.concat_ws("\n", F.transform("lines", lambda x: x["said"]))).alias("text"),
        F.col("n_quoted").cast("long").alias("n_quoted"), "reply_to", root.alias("thread_root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.concat(_sortable(root), F.lit("."), _sortable(F.col("turn"))).alias("order_key"),
    )


def _sortable(turn: Column) -> Column:
    """A long as 16 hex digits that sort as the numbers do, negative ones first."""
    return hex64(turn.cast("long").bitwiseXOR(F.lit(-(2**63))))


def build_conversations(linked: DataFrame) -> DataFrame:
    """The rows of link_quotations in the order of their conversations: by conv_id and order_key over all partitions and within each.

    A long conversation may go on in the next partition; none has to fit into one task.
    """
    order = ["conv_id", "order_key"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)


def _roots(edges: DataFrame) -> DataFrame:
    """Root and depth of every replying message by pointer doubling; replies go back in turn, so there are no cycles."""
    now = stage(edges.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread_root"), F.lit(1).cast("long").alias("depth")), "roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread_root"), F.col("thread_root").alias("above"), F.col("depth").alias("more"))
        joined = now.join(up, ["conv_id", "thread_root"], "left")
        after = stage(
            joined.select("conv_id", "turn", "reply_to", F.coalesce("above", "thread_root").alias("thread_root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")),
            "roots",
        )
        moved = after.where("moved").limit(1).count()
        unstage(now)
        now = after
        if not moved:
            return now.drop("moved")
