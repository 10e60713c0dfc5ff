"""Blocking channels: from a record to its keys, an array of (ktype, kval). Keys meet only within a country."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.values import ADDRESS_STOP_WORDS, STOP_WORDS

KEYS = "array<struct<ktype:string,kval:string>>"


def key(ktype: Column | str, value: Column, when: Column | None = None) -> Column:
    made = F.struct((F.lit(ktype) if isinstance(ktype, str) else ktype).alias("ktype"), value.alias("kval"))
    return F.when(value.isNotNull() & (value != "") & (F.lit(True) if when is None else when), made)


def keys(*made: Column) -> Column:
    return F.filter(F.array(*made), lambda k: k.isNotNull())


def joined(*parts: Column) -> Column:
    """Parts with _ between; null if a part is missing."""
    return F.concat(*[x for p in parts for x in (F.lit("_"), p)][1:])


def at(words: Column, i: int) -> Column:
    return F.get(words, F.lit(i)) if i >= 0 else F.get(words, F.size(words) + i)


def _a() -> Column:
    return keys(key("legal", F.col("legal_name")))


def _c() -> Column:
    d, w = F.col("digits"), F.filter("addr_words3", lambda x: x.isNotNull())
    postal = at(T.postals(F.col("clean_addr")), 0)
    return keys(
        key("postal", postal), key("num_word", joined(at(d, 0), at(w, 0)), (F.size(d) > 0) & (F.size(w) > 0)),
        key("addr_words", joined(at(w, 0), at(w, 1)), ~((F.size(d) > 0) & (F.size(w) > 0)) & (F.size(w) >= 2)),
    )


def _e() -> Column:
    t = F.filter("legal_words", lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) >= 3))
    n = F.size(t)
    return keys(
        key("drop0", joined(at(t, 1), at(t, 2)), n >= 3), key("drop1", joined(at(t, 0), at(t, 2)), n >= 3), key("drop2", joined(at(t, 0), at(t, 1)), n >= 3),
        key("pair", joined(at(t, 0), at(t, 1)), n == 2),
    )


def _f() -> Column:
    w = F.col("addr_words4")
    return keys(key("addr_w1", at(w, 1)), key("addr_w2", at(w, 2)))


def _g() -> Column:
    packed = F.replace(F.col("legal_name"), F.lit(" "), F.lit(""))
    return keys(key("snk", F.substring(packed, 1, 8), F.length(packed) >= 5))


def _h() -> Column:
    d = F.filter("digits", lambda x: (F.length(x) <= 5) & (x != "0"))
    p = at(T.postals(F.col("clean_addr")), 0)
    other = F.filter(F.slice(d, 1, 2), lambda x: x != p)
    with_postal = p.isNotNull() & (F.size(d) > 0)
    near = F.flatten(F.transform(other, lambda x: F.array(
        F.struct(F.lit("num_post5").alias("ktype"), F.concat(x, F.lit("_"), F.substring(p, 1, 5)).alias("kval")),
        F.struct(F.lit("num_post3").alias("ktype"), F.concat(x, F.lit("_"), F.substring(p, 1, 3)).alias("kval")),
    )))
    return F.when(with_postal, near).otherwise(keys(key("num_pair", joined(at(d, 0), at(d, 1)), F.size(d) >= 2)))


def _i() -> Column:
    marks = F.filter(T.landmarks(F.col("addr")), lambda x: (F.length(x) >= 4) & ~F.lower(x).isin(*STOP_WORDS))
    w = F.col("addr_words4")
    return F.concat(
        F.transform(marks, lambda x: F.struct(F.lit("landmark").alias("ktype"), F.lower(x).alias("kval"))),
        keys(key("addr_edge", joined(at(w, 0), at(w, -1)), F.size(w) >= 4), key("addr_edge2", joined(at(w, 1), at(w, -1)), F.size(w) >= 4)),
    )


def _j() -> Column:
    rom = F.col("rom_name")
    packed = F.replace(rom, F.lit(" "), F.lit(""))
    t = F.filter(T.words(rom), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS))
    return keys(
        key("rom_exact", rom), key("rom_snk", F.substring(packed, 1, 8), F.length(packed) >= 5),
        key("rom_pair", joined(at(t, 0), at(t, 1)), F.size(t) >= 2), key("rom_word", at(t, 0), F.size(t) == 1),
    )


def _k() -> Column:
    w = F.slice(F.filter("name_words", lambda x: F.length(x) >= 5), 1, 2)
    p2 = F.substring(at(F.col("postals"), 0), 1, 2)
    ktype = F.when(p2.isNotNull(), F.concat(F.lit("del_"), p2)).otherwise(F.lit("del_rare"))
    squeezed = F.filter(F.transform(w, lambda x: F.struct(F.lit("sqz").alias("ktype"), T.squeeze(x).alias("kval"), x.alias("of"))), lambda k: (k["kval"] != k["of"]) & (F.length(k["kval"]) >= 4))
    used = F.filter(w, lambda x: F.length(x).between(6, 12) & (p2.isNotNull() | (F.length(x) >= 8)))

    def near(x: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        return F.transform(F.concat(F.array(x), cut), lambda v: F.struct(ktype.alias("ktype"), v.alias("kval")))

    return F.concat(F.transform(squeezed, lambda k: F.struct(k["ktype"].alias("ktype"), k["kval"].alias("kval"))), F.flatten(F.transform(used, near)))


def _l() -> Column:
    w = F.col("name_words")
    first = T.acronym(w)
    single = at(w, 0)
    acr = F.when((F.size(w) >= 2) & F.length(first).between(2, 6), first).when((F.size(w) == 1) & F.length(single).between(2, 5) & single.rlike(r"^\p{L}+$"), single)
    p3 = F.substring(at(F.col("postals"), 0), 1, 3)
    place = at(F.filter(T.words(F.col("clean_addr")), lambda x: (F.length(x) >= 4) & ~x.isin(*STOP_WORDS)), -1)
    return keys(key("acr_p3", joined(acr, p3)), key("acr_city", joined(acr, place), p3.isNull()))


def _cross(kind: int) -> Callable[[], Column]:
    def made() -> Column:
        n0 = at(F.filter("digits", lambda x: x != "0"), 0)
        names = F.filter("legal_words", lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
        addr = F.filter(F.array_distinct(F.filter(T.words(F.col("clean_addr")), lambda w: (F.length(w) >= 3) & ~T.is_digits(w) & ~w.isin(*ADDRESS_STOP_WORDS))), lambda w: w.isNotNull())
        one = lambda xs, other, flip=False: F.transform(xs, lambda x: F.concat(other, F.lit("_"), x) if flip else F.concat(x, F.lit("_"), other))
        if kind == 1:
            made = one(F.slice(addr, 1, 3), n0, True)
        elif kind == 2:
            made = one(F.slice(names, 1, 2), n0)
        elif kind == 3:
            made = one(_last(addr, 2), n0, True)
        else:
            made = F.flatten(F.transform(F.slice(names, 1, 2), lambda x: F.transform(_last(addr, 2), lambda y: F.concat(x, F.lit("_"), y))))
        made = F.filter(F.array_distinct(F.coalesce(made, F.array().cast("array<string>"))), lambda v: v.isNotNull())
        return F.transform(made, lambda v: F.struct(F.lit(f"h{kind}").alias("ktype"), v.alias("kval")))

    return made


def _last(words: Column, n: int) -> Column:
    return F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), F.lit(n))


@dataclass(frozen=True)
class Channel:
    """A channel's name, its bit in pair masks, and its keys. cap limits a key's postings that are probed, first ones first; whole drops keys with more.

    A whole channel is met under each of COMPOSITE_CAPS that its key keeps to: at bit, bit + 4 and so on.
    """

    name: str
    bit: int
    made: Callable[[], Column]
    cap: int = 15
    whole: bool = False


COMPOSITE_CAPS = (150, 300)
SIMPLE = [Channel("A", 0, _a, 30), Channel("C", 2, _c), Channel("E", 4, _e), Channel("F", 5, _f), Channel("G", 6, _g), Channel("H", 7, _h), Channel("I", 8, _i), Channel("J", 9, _j), Channel("K", 10, _k), Channel("L", 11, _l)]
CROSS = [Channel(f"H{n}", 11 + n, _cross(n), COMPOSITE_CAPS[-1], True) for n in (1, 2, 3, 4)]
CHANNELS = {c.name: c for c in [*SIMPLE, Channel("B", 1, lambda: keys()), Channel("D", 3, lambda: keys()), *CROSS]}


def mask_of(names) -> int:
    """The mask of channels; a name such as H2@300 gives a cap, the least of COMPOSITE_CAPS without."""
    out = 0
    for name in names:
        channel, _, cap = name.partition("@")
        out |= 1 << CHANNELS[channel].bit + (4 * COMPOSITE_CAPS.index(int(cap)) if cap else 0)
    return out


def channel_keys(records: DataFrame, names: list[str]) -> DataFrame:
    """entity_id, src, country, channel, ktype, kval: one scan and one Generate for all channels."""
    made = [_tagged(n) for n in names]
    every = F.concat(*made) if len(made) > 1 else made[0]
    return records.select("entity_id", "src", "country", F.explode(every).alias("k")).select("entity_id", "src", "country", "k.channel", "k.ktype", "k.kval")


def _tagged(name: str) -> Column:
    def tag(k: Column) -> Column:
        return F.struct(F.lit(name).alias("channel"), k["ktype"].alias("ktype"), k["kval"].alias("kval"))

    return F.transform(CHANNELS[name].made(), tag)


def document_frequency(records: DataFrame, tokens: Column) -> DataFrame:
    """How many candidate records (S2, S3) have a token, over all countries."""
    return records.where("src <> 'S1'").select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(records: DataFrame, tokens: Column, least: int, most: int) -> DataFrame:
    """Tokens of medium frequency with their idf, ln((N + 1) / (df + 1))."""
    n = records.where("src <> 'S1'").agg(F.count(F.lit(1)).alias("n")).scalar()
    return document_frequency(records, tokens).where(F.col("df").between(least, most)).withColumn("idf", F.ln((n + 1) / (F.col("df") + 1)))


def rare_keys(records: DataFrame, channel: str, tokens: Column, vocab: DataFrame, top: int) -> DataFrame:
    """A record's `top` tokens of highest idf, ties by position, as keys of one type."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("idf"), "pos")
    spread = records.select("entity_id", "src", "country", F.posexplode(tokens).alias("pos", "kval"))
    return (
        spread.join(vocab.select(F.col("token").alias("kval"), "idf"), "kval").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
        .select("entity_id", "src", "country", F.lit(channel).alias("channel"), F.lit("tok").alias("ktype"), "kval")
    )


def postings(keyed: DataFrame, names: list[str]) -> DataFrame:
    """Candidate postings that a probe reads, with the key's number of them: the first `cap` of a key, or all of a key with at most `cap`.

    Order is source, then id. The literal bound lets the planner cut each task's groups before the shuffle, so that n is right up to
    the largest cap; the count reads the same sorted groups as the ranks. A hash of the key goes first, so that sorting rarely compares strings.
    """
    return _postings(keyed, names).drop("_h")


GROUP = ["channel", "country", "ktype", "kval"]


def _hashed(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("_h", F.xxhash64(*GROUP))


def _postings(keyed: DataFrame, names: list[str]) -> DataFrame:
    cap = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(CHANNELS[n].cap))])[F.col("channel")]
    whole = F.col("channel").isin(*[n for n in names if CHANNELS[n].whole])
    most = max(CHANNELS[n].cap for n in names) + 1
    by_key = Window.partitionBy("_h", *GROUP)
    ranked = _hashed(keyed.where("src <> 'S1'")).withColumn("pos", F.row_number().over(by_key.orderBy("src", "entity_id"))).where(F.col("pos") <= most)
    ranked = ranked.withColumn("n", F.count(F.lit(1)).over(by_key))
    return ranked.where(F.when(whole, F.col("n") <= cap).otherwise(F.col("pos") <= cap)).select("_h", *GROUP, F.col("entity_id").alias("cand_id"), "n")


def candidate_pairs(keyed: DataFrame, names: list[str]) -> DataFrame:
    """s1_id, cand_id, mask of channels, hits: number of keys met, cross-field channels not counted.

    Probes meet the postings as these were dealt and sorted for their ranks, hash first, so postings are shuffled once.
    """
    bits = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(1 << CHANNELS[n].bit).cast("long"))])[F.col("channel")]
    cross = F.col("channel").isin(*[c.name for c in CROSS])
    kept = sum(F.when(F.col("n") <= c, F.lit(1 << 4 * j)).otherwise(F.lit(0)) for j, c in enumerate(COMPOSITE_CAPS))
    bits = F.when(cross, bits * kept).otherwise(bits)
    probes = _hashed(keyed.where("src = 'S1'").withColumnRenamed("entity_id", "s1_id").drop("src"))
    return (
        probes.join(_postings(keyed, names), ["_h", *GROUP]).groupBy("s1_id", "cand_id")
        .agg(F.bit_or(bits).alias("mask"), F.sum((~cross).cast("long")).alias("hits"))
    )
