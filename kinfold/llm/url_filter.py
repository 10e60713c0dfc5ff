"""URL filter by two character language models, in DataFrame expressions only.

One model counts the characters of accepted URLs, the other those of rejected ones, in contexts of 0 to DEPTH - 1
characters. A character's probability mixes all context lengths: each adds STRENGTH times the shorter context's
probability to its counts. A URL's score is log P(rejected) - log P(accepted) over its length. Rules on host and path come before the models.

No URL is judged by models that saw its own site: hosts fall into FOLDS folds by their hash, counts are kept by fold, and a URL
is scored with the counts of all other folds. So a label never reaches the verdict of its own site, be it given or missing; what the
other sites' characters say decides. These scores of labelled URLs also calibrate: a logistic curve, both classes weighing
the same, turns scores into probabilities, and a URL is blocked from one half on.

Counts are exact: one row for each distinct string of DEPTH characters and fold, so the table grows with the corpus and stays
distributed. A character's ratio depends on its string and the fold alone; it is worked out once and joined to every URL's positions.
The models read the whole URL, and every URL is counted.

Where the training URLs come from: a column of labels, if the caller has one. Without one, hosts with a word of `reject_terms` are
rejected, and other sites that no rule blocks are accepted. Blocked sites are policy rather than a way of writing, so they teach neither model.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, unstage

DEPTH, STRENGTH, ALPHABET, FOLDS = 5, 4.0, 64.0, 8
#: Scores are counted for the curve in bins of WIDTH, within BINS / 2 of them around 0.
PAD, BINS, WIDTH = "\u0002", 4000, 0.0025
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that public block lists use for categories of unwanted hosts.
REJECT_TERMS = (
    "ad ads adserver adult bet bets betting bingo casino cheap cialis clickbait crack escort free gambling jackpot loan loans lottery pharma pills poker porn replica sex"
    " slots spam tracker tracking track viagra warez win xxx"
).split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without a '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, a struct of rule and verdict, or null; of rules of one length the first."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        site, slash, rest = rule.partition("/")
        fit = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(slash + rest))
        fits.append(F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _shape(url: Column, host: Column) -> Column:
    """What the models read: the whole URL, its host lower-cased, digits alike, with an end mark and room for the first contexts."""
    at = F.instr(url, "://")
    whole = F.when(at > 0, F.concat(F.lower(F.substring(url, F.lit(1), at + 2)), host, F.substring(url, at + 3 + F.length(host), F.length(url)))).otherwise(url)
    return F.concat(F.lit(PAD * (DEPTH - 1)), F.regexp_replace(F.coalesce(whole, F.lit("")), "[0-9]", "0"), F.lit("\u0003"))


def _grams(shape: Column) -> Column:
    """For every character its string: the DEPTH - 1 characters before it, and itself."""
    return F.transform(F.sequence(F.lit(1), F.length(shape) - DEPTH + 1), lambda i: F.substring(shape, i, F.lit(DEPTH)))


def _ratios(grams: DataFrame) -> DataFrame:
    """gram, fold and ratio, log P(rejected) - log P(accepted) of the last character in billionths: a sum of longs has no order.

    grams has the training counts good and bad of each string in each fold; the models of a fold count all others.
    """
    def others(key: Column, name: str) -> DataFrame:
        """Counts of a context outside each fold; a context has FOLDS rows at most."""
        own = grams.groupBy(key.alias("key"), "fold").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        whole = Window.partitionBy("key")
        return own.select("key", "fold", *[(F.sum(c).over(whole) - F.col(c)).alias(f"{name}_{c}") for c in ("good", "bad")])

    out = grams.select("gram", "fold")
    for k in range(DEPTH):
        for name, length in (("pair", k + 1), ("whole", k)):
            key = F.substring("gram", DEPTH - k, length)
            out = out.withColumn("key", key).join(others(key, f"{name}{k}"), ["key", "fold"]).drop("key") if length else out.join(F.broadcast(_totals(grams, name)), "fold")

    def probability(kind: str) -> Column:
        p = F.lit(1.0 / ALPHABET)
        for k in range(DEPTH):
            p = (F.col(f"pair{k}_{kind}") + p * STRENGTH) / (F.col(f"whole{k}_{kind}") + STRENGTH)
        return p

    return out.select("gram", "fold", F.round((F.ln(probability("bad")) - F.ln(probability("good"))) * 1e9).cast("long").alias("ratio"))


def _totals(grams: DataFrame, name: str) -> DataFrame:
    """How many characters the models of each fold count: FOLDS rows."""
    own = grams.groupBy("fold").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    whole = Window.partitionBy(F.lit(0))
    return own.select("fold", *[(F.sum(c).over(whole) - F.col(c)).alias(f"{name}0_{c}") for c in ("good", "bad")])


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, reject_terms: Sequence[str] = tuple(REJECT_TERMS), rejected: str | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict, score, rejected_probability for each row of pages.

    rejected names a boolean column of pages that tells rejected URLs from accepted ones (null teaches nothing); by default hosts
    are told by reject_terms. verdict is the rule's where one fits, else block if the probability is at least one half and allow otherwise. A null url or
    one without '://' has empty host and path, teaches nothing by default and is judged on what it has. Without rejected or without accepted URLs to
    learn from all probabilities are 0. Repeated rows and null ids pass through; other columns are left out.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    label = F.lit(None).cast("boolean") if rejected is None else F.col(rejected).cast("boolean")
    split = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("url").cast("string").alias("url"), label.alias("label"))
    judged = split.withColumn("fit", first_rule(F.col("host"), F.col("path"), rules))
    terms = "|".join(reject_terms)
    marked = F.col("host").rlike(rf"(^|[.\-])({terms})($|[.\-])") if terms else F.lit(False)
    teaches = (F.col("host") != "") & (marked | F.coalesce(F.col("fit.verdict") != "block", F.lit(True)))
    urls = stage(
        judged.select(
            F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "fit", _shape(F.col("url"), F.col("host")).alias("shape"),
            (F.when(teaches, marked) if rejected is None else F.col("label")).alias("rejected"), F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"),
        ),
        "urls",
    )
    each = urls.select(F.explode(_grams(F.col("shape"))).alias("gram"), "fold", (~F.col("rejected")).cast("long").alias("good"), F.col("rejected").cast("long").alias("bad"))
    grams = stage(each.groupBy("gram", "fold").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "bad")]), "grams")
    ratios = stage(_ratios(grams), "ratios")
    sums = (
        urls.select("row", "fold", F.explode(_grams(F.col("shape"))).alias("gram")).join(ratios, ["gram", "fold"])
        .groupBy("row").agg((F.sum("ratio") / F.count(F.lit(1)) / 1e9).alias("score"))
    )
    scored = stage(urls.drop("shape").join(sums, "row"), "scores")
    unstage(grams, ratios, urls)
    bins = F.floor(F.least(F.greatest(F.col("score") / WIDTH, F.lit(-BINS // 2)), F.lit(BINS // 2 - 1))).cast("int")
    held = scored.where("rejected is not null").groupBy(bins.alias("bin")).agg(F.sum(F.col("rejected").cast("long")).alias("bad"), F.count(F.lit(1)).alias("n"))
    slope, middle = _curve([((r.bin + 0.5) * WIDTH, r.bad, r.n - r.bad) for r in held.collect()])
    probability = F.lit(0.0) if middle is None else 1 / (1 + F.exp((F.lit(middle) - F.col("score")) * F.lit(slope)))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(probability >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score", probability.alias("rejected_probability"))


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float | None]:
    """Slope and middle of a logistic curve through (score, rejected, accepted), both classes weighing the same; no middle if one is missing.

    Targets stay off 0 and 1 by what one more URL of either class would tell, so that the curve stays finite for classes that don't overlap.
    """
    x, bad, good = np.array(sorted(bins), dtype=float).reshape(-1, 3).T
    if not bad.sum() or not good.sum():
        return 1.0, None
    high, low = (bad.sum() + 1) / (bad.sum() + 2), 1 / (good.sum() + 2)
    weight = np.concatenate([bad / bad.sum(), good / good.sum()])
    target = np.concatenate([np.full(len(x), high), np.full(len(x), low)])
    a = np.column_stack([np.ones(2 * len(x)), np.concatenate([x, x])])
    w = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-9 * np.eye(2), a.T @ (weight * (target - p)))
        w = w + step * min(1.0, 10 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    slope = max(float(w[1]), 1e-6)
    return slope, -float(w[0]) / slope
