"""Temperature mixing of sources, realised as budgeted block permutations, in DataFrame expressions only.

Sources have weights proportional to their share of the tokens to the power alpha. alpha is bisected
for the largest value whose weights reach a share of the largest possible entropy; if a source would then be repeated more than max_epochs times, for the
smallest that keeps to it. A source's part of the budget is spent on whole permutations of its documents and a part of one more: each epoch
orders a source's documents by a hash of id and epoch, cut into blocks by its first digits; the blocks that fit the rest
of the budget are taken whole, and in the block where it ends the documents that still fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_hot, stage, unstage

ENTROPY, EPOCHS, SEED = 0.95, 4.0, "mix"
DIGITS, GRID, ROUNDS = 3, 64, 5


def token_count(text: Column) -> Column:
    """Runs of bytes outside white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _least_true(test, low: float, high: float) -> float:
    """The edge of a monotonic test on [low, high], false below: GRID exponents are tried in one job, ROUNDS times."""
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        results = test(points)
        k = next((i for i, ok in enumerate(results) if ok), None)
        if k is None:
            return high
        if k == 0:
            return low
        low, high = points[k - 1], points[k]
    return high


def solve_alpha(sources: DataFrame, budget: float | None = None, entropy: float = ENTROPY, epochs: float = EPOCHS) -> float:
    """The exponent, from 0 to 1 in millionths, for a table of (source, tokens); tokens above 0."""
    base = sources.agg(F.sum("tokens").cast("double"), F.count(F.lit(1)), F.min("tokens").cast("double"), F.max("tokens").cast("double")).first()
    total, n, least, _ = base
    if not total or n < 2:
        return 1.0
    budget = total if budget is None else budget

    def sums(points: list[float]) -> list[tuple[float, float]]:
        share = F.col("tokens") / F.lit(total)
        columns = []
        for i, a in enumerate(points):
            columns += [F.sum(F.pow(share, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(a)) * F.ln(share)).alias(f"t{i}")]
        row = sources.agg(*columns).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(points))]

    import math

    wanted = entropy * math.log(n)

    def too_pointed(points):
        return [math.log(z) - a * t / z < wanted for a, (z, t) in zip(points, sums(points), strict=True)]

    def not_repeated(points):
        return [budget * (least / total) ** a / z / least <= epochs for a, (z, _) in zip(points, sums(points), strict=True)]

    alpha = _least_true(too_pointed, 0.0, 1.0)
    if not not_repeated([alpha])[0]:
        alpha = _least_true(not_repeated, alpha, 1.0)
    return round(alpha, 6)


def mix(docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Draws of documents: doc_id, source, epoch, block, order_key, n_tokens; sorting by order_key gives the mixture.

    The budget in tokens is that of docs unless given. A null source is the source ''. Texts without words are never
    drawn. Rows that repeat an id are drawn together as far as the budget allows; null ids count as the id ''.
    A source with no words has no part. An empty table gives no rows.
    """
    counted = stage(
        docs.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), token_count(F.col("text")).alias("n_tokens")).where("n_tokens > 0"),
        "counted",
    )
    sources = stage(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "sources")
    total, n_docs = sources.agg(F.sum("tokens").cast("double"), F.sum("n")).first()
    total, n_docs = total or 0.0, n_docs or 0
    budget = total if budget is None else float(budget)
    alpha = solve_alpha(sources, budget, entropy, epochs)
    raw = F.pow(F.col("tokens") / F.lit(total or 1.0), F.lit(alpha))
    norm = sources.agg(F.sum(raw)).first()[0] or 1.0
    part = F.floor(F.lit(budget) * raw / F.lit(round(norm, 9)))
    plan = sources.select("source", "n", F.floor(part / F.col("tokens")).alias("whole"), (part - F.floor(part / F.col("tokens")) * F.col("tokens")).cast("long").alias("rest"))

    key = F.md5(F.concat_ws("|", "source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("epoch").cast("string"), F.lit(seed)))
    drawn = (
        join_hot(counted, plan, ["source"], "n", n_docs).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
        .withColumn("order_key", key).withColumn("block", F.substring("order_key", 1, DIGITS))
    )
    full = drawn.where("epoch < whole").select("doc_id", "source", "epoch", "block", "order_key", "n_tokens")
    last = stage(drawn.where("epoch = whole"), "last")
    blocks = last.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.max("rest").alias("rest"))
    # At most 16**DIGITS rows of a source.
    blocks = blocks.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("block")))
    blocks = stage(blocks.where("upto - size < rest").select("source", "block", "upto", (F.col("rest") - F.col("upto") + F.col("size")).alias("room")), "blocks")
    fits = last.join(blocks, ["source", "block"])
    inner = fits.where("upto <= rest")
    cut = fits.where("upto > rest").withColumn("sum", F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("order_key"))).where("sum <= room")
    names = ["doc_id", "source", "epoch", "block", "order_key", "n_tokens"]
    return full.unionByName(inner.select(names)).unionByName(cut.select(names))
