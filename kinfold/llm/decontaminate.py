"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

Tokens are maximal runs of letters and digits, lower-cased, as 64-bit hashes. A mask is a string of 1 and 0: a
window of a text gives the hash of its tokens at the mask's ones, so that tokens at its zeros may differ. Windows
of benchmark items and of texts that agree under a mask are joined; around each hit, item and text are laid
side by side and the best stretch of WINDOW tokens is counted. A text is contaminated by an item if
some stretch of min(WINDOW, item length) item tokens agrees in at least percent of its places. The masks depend on
the length of the stretch: however the substitutions that percent allows lie, some window of some mask has none.

Two tables of bits, sized from the benchmark and never above 2**MAX_BITS, let nearly all texts go before anything is
shuffled; if they fill up, more texts pass, and the join decides all the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, long_array, stage, text_or_empty, unstage

#: Masks by length of the stretch, for 80 % of at most 20 tokens; enumerated for every length in tests/llm. They begin
#: with two ones: the first table of bits holds pairs of neighbours.
LONG, MIDDLE = ("1101111", "1100010111", "11110111"), ("110111", "11001011", "110100111")
MASKS = {
    **{n: ("1" * n,) for n in range(1, 5)}, 5: ("111", "11011"), 6: ("1111", "11011"), 7: ("11111", "110111", "1111011"),
    **dict.fromkeys((8, 9, 10, 11, 12, 16), MIDDLE), 15: (*MIDDLE, "110100001111"), **dict.fromkeys((13, 14, 17, 18, 19, 20), LONG),
}
WINDOW = 20
MAX_BITS = 24


def masks_for(length: int, percent: int = 80, window: int = WINDOW) -> tuple[str, ...]:
    """Masks that find every stretch of length tokens that agrees in percent of its places; beyond MASKS, the longest run that substitutions can't all break."""
    if percent >= 80 and window <= WINDOW:
        return MASKS[length]
    agree = max(1, -(-length * percent // 100))
    return ("1" * -(-agree // (length - agree + 1)),)


def tokens(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(t: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(*[F.get(t, at + i) for i, c in enumerate(mask) if c == "1"])


def _starts(t: Column, span: int) -> Column:
    return F.when(F.size(t) >= span, F.sequence(F.lit(0), F.size(t) - span)).otherwise(F.array().cast("array<int>"))


def _pair(t: Column, at: Column) -> Column:
    return F.xxhash64(F.get(t, at), F.get(t, at + 1))


def _windows(t: Column, masks: dict[str, list[int]], window: int) -> Column:
    """Structs of mask number, position and hash of every window, under the masks for the item's length."""
    length = F.least(F.size(t), F.lit(window))
    none = F.array().cast("array<int>")
    return F.flatten(F.array(*[
        F.transform(F.when(length.isin(lengths), _starts(t, len(m))).otherwise(none), _window(t, k, m)) for k, (m, lengths) in enumerate(masks.items())
    ]))


def _window(t: Column, number: int, mask: str):
    return lambda i: F.struct(F.lit(number).alias("mask"), i.alias("pos"), _seed(t, i, mask).alias("seed"))


def _cell(h: Column, bits: int, probe: int = 0) -> Column:
    return F.shiftrightunsigned(h, 64 - bits if probe == 0 else 32 - bits // 2).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _bits(cells: DataFrame, bits: int) -> Column:
    """A literal of 2**bits bits, set where a cell occurs, packed into longs: at most 2**MAX_BITS / 64 of them."""
    word = F.shiftright("cell", 6)
    bit = F.expr("shiftleft(1L, cell & 63)")
    packed = {r[0]: r[1] for r in cells.groupBy(word.alias("word")).agg(F.bit_or(bit)).collect()}
    return long_array(packed.get(i, 0) for i in range(1 << bits - 6))


def _is_set(packed: Column, cell: Column) -> Column:
    return F.bit_get(F.get(packed, F.shiftright(cell, 6)), cell.bitwiseAND(63)) == 1


def overlaps(docs: DataFrame, benchmark: DataFrame, percent: int = 80, window: int = WINDOW) -> DataFrame:
    """Contaminated documents: doc_id, item_id, matched, compared, item_tokens; one row per document and item.

    matched of compared item tokens agree in the best stretch. Items without tokens match nothing. Null and empty texts match
    nothing. Rows that repeat an id count together, null ids as one group, on either side. An empty table gives no rows.
    """
    items = benchmark.select(F.col("item_id"), tokens(text_or_empty()).alias("it")).where("size(it) > 0").distinct()
    items = stage(items.withColumn("item", F.monotonically_increasing_id()), "items")
    shape = items.agg(F.count(F.lit(1)), F.sum(F.size("it")), F.collect_set(F.least(F.size("it"), F.lit(window)))).first()
    if not shape[0]:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched int, compared int, item_tokens int")
    masks: dict[str, list[int]] = {}
    for length in sorted(shape[2]):
        for m in masks_for(length, percent, window):
            masks.setdefault(m, []).append(length)
    single = "1" in masks
    seeds = stage(items.select("item", F.size("it").alias("size"), F.explode(_windows(F.col("it"), masks, window)).alias("w")).select("item", "size", "w.*"), "seeds")
    bits, wide = (min(MAX_BITS, max(14, math.ceil(math.log2(32 * n)))) for n in (shape[1], max(1, seeds.count())))
    pair_bits = _bits(
        items.select(F.explode(F.transform(_starts(F.col("it"), 2), lambda i: _cell(_pair(F.col("it"), i), bits))).alias("cell")), bits
    )
    seed_bits = _bits(seeds.select(F.explode(F.array(_cell(F.col("seed"), wide), _cell(F.col("seed"), wide, 1))).alias("cell")), wide)

    def starts(t: Column) -> Column:
        return _starts(t, 1) if single else F.filter(_starts(t, 2), lambda i: _is_set(pair_bits, _cell(_pair(t, i), bits)))

    def known(w: Column) -> Column:
        return w.isNotNull() & _is_set(seed_bits, _cell(w["seed"], wide)) & _is_set(seed_bits, _cell(w["seed"], wide, 1))

    def seeds_at(t: Column):
        return lambda i: F.filter(
            F.array(*[F.when(i + len(m) <= F.size(t), _window(t, k, m)(i)) for k, m in enumerate(masks)]), known
        )

    def suspect(t: Column) -> Column:
        found = F.flatten(F.transform(starts(t), seeds_at(t)))
        return let(found, lambda w: F.when(F.size(w) > 0, F.struct(t.alias("t"), w.alias("w"))))

    # The row number also keeps the optimiser from moving the filter below the projection and doing its work twice.
    hit = stage(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", let(tokens(text_or_empty()), suspect).alias("s"))
        .where("s is not null").select("row", "doc_id", "s.t", "s.w"),
        "hits",
    )
    met = (
        hit.select("row", F.explode("w").alias("w")).select("row", "w.*")
        .join(seeds.withColumnRenamed("pos", "at"), ["mask", "seed"])
        .select("row", "item", "size", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    )
    begin = F.greatest(F.lit(0), -F.col("shift"))
    # Of the text only the stretch beside the item goes on.
    beside = F.slice(F.col("t"), begin + F.col("shift") + 1, F.greatest(F.col("size") - begin, F.lit(0)))
    laid = met.join(hit.select("row", "doc_id", "t"), "row").select("doc_id", "item", "size", "shift", beside.alias("beside")).join(items, "item")
    size = F.col("size")
    same = F.zip_with(
        F.slice(F.col("it"), begin + 1, size), F.col("beside"),
        lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"),
    )
    laid = laid.withColumn("same", same).withColumn("need", F.least(size, F.lit(window)))
    best = F.array_max(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("same") - F.col("need") + 1, F.lit(1))),
        lambda i: F.aggregate(F.slice(F.col("same"), i, F.col("need")), F.lit(0), lambda n, x: n + x),
    ))
    found = (
        laid.select("doc_id", "item_id", best.alias("matched"), F.col("need").alias("compared"), size.alias("item_tokens"))
        .where(F.col("matched") * 100 >= F.col("compared") * percent)
        .groupBy("doc_id", "item_id")
        .agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"), F.max("item_tokens").alias("item_tokens"))
    )
    found = stage(found, "overlaps")
    unstage(items, seeds, hit)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 80, window: int = WINDOW) -> DataFrame:
    """The rows of docs that no benchmark item overlaps; every column is kept, and so are null ids."""
    gone = overlaps(docs, benchmark, percent, window).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
