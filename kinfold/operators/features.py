"""The 32 features of a pair of records, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T

# The order of the features.
FEATURES = (
    "name_clean_exact name_legal_exact name_fuzz_ratio name_token_sort_ratio name_token_jaccard name_token_dice name_token_overlap name_c3_jaccard name_c4_jaccard"
    " name_len_diff_ratio name_prefix_ratio name_translit_c3 name_translit_exact name_acronym_match name_squeezed_c3 addr_clean_exact addr_fuzz_ratio addr_token_sort_ratio"
    " addr_token_jaccard addr_token_dice addr_token_overlap addr_c3_jaccard addr_len_diff_ratio postal_exact_match postal_prefix3_match digits_overlap_ratio numeric_post_match"
    " landmark_match name_x_addr_jaccard name_c3_x_addr_c3 cand_is_s2 channel_hits"
).split()


def _flag(x: Column) -> Column:
    return x.cast("double")


def _meet(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) > 0


def _fields(n: Column, legal: Column, a: Column, name_words: Column, addr_words: Column, postals: Column, digits: Column, latin: Column, marks: Column, entity_id: Column) -> dict[str, Column]:
    squeezed = T.squeeze(n)
    return {
        "n": n, "l": legal, "a": a, "nw": name_words, "aw": addr_words, "postals": postals, "digits": digits, "n3": T.ngrams_bare(n), "n4": T.ngrams_bare(n, 4), "a3": T.ngrams_bare(a), "t": latin,
        "t3": T.ngrams_bare(latin), "sq": squeezed, "sq3": T.ngrams_bare(squeezed), "acr": T.acronym(name_words), "p3": F.transform(postals, lambda p: F.substring(p, 1, 3)), "marks": marks,
        "ns": S.sorted_tokens(n), "as_": S.sorted_tokens(a), "id": entity_id,
    }


def marks() -> Column:
    return F.filter(F.transform(T.landmarks(F.col("addr")), F.lower), lambda x: F.length(x) >= 3)


def feature_fields() -> Column:
    """A struct of what several features read of one record. Worked out before records meet in pairs, it is made once a record."""
    made = _fields(*map(F.col, ("clean_name", "legal_name", "clean_addr", "name_words", "addr_words", "postals", "digits", "latin_name")), marks(), F.col("entity_id"))
    return F.struct(*[c.alias(f) for f, c in made.items()])


def with_short_fields(records: DataFrame) -> DataFrame:
    """Records with a struct `short` of what all their fields can be made of again, without words and n-grams; null for a name that is as the cleaned one."""
    other = lambda x: F.when(F.col(x) != F.col("clean_name"), F.col(x))
    return records.withColumn("latin_name", T.transliterate(F.col("clean_name"))).withColumn("short", F.struct(
        F.col("clean_name").alias("n"), other("legal_name").alias("l"), F.col("clean_addr").alias("a"), "postals", "digits", other("latin_name").alias("t"), marks().alias("marks"), F.col("entity_id").alias("id"),
    )).drop("latin_name")


def with_fields_of(pairs: DataFrame, short: str) -> DataFrame:
    """Adds the fields of the struct `short` of with_short_fields, as columns named short_field. They are columns of their own so that each is made once a pair."""
    x = lambda f: F.col(f"{short}.{f}")
    n, a = x("n"), x("a")
    made = _fields(n, F.coalesce(x("l"), n), a, T.name_words(n), T.address_words(a), x("postals"), x("digits"), F.coalesce(x("t"), n), x("marks"), x("id"))
    grams = F.col(f"{short}_n3")
    made |= {"t3": F.when(x("t").isNull(), grams).otherwise(made["t3"]), "sq3": F.when(F.col(f"{short}_sq") == n, grams).otherwise(T.ngrams_bare(F.col(f"{short}_sq")))}
    first = ("n3", "sq")
    return pairs.withColumns({f"{short}_{f}": made[f] for f in first}).withColumns({f"{short}_{f}": c for f, c in made.items() if f not in first})


def with_feature_fields(records: DataFrame) -> DataFrame:
    """Records with a column `fields`, ready to be paired."""
    return records.withColumn("latin_name", T.transliterate(F.col("clean_name"))).withColumn("fields", feature_fields()).drop("latin_name")


def pair_features(pairs: DataFrame, strict: bool = True, a: str = "a.fields.") -> DataFrame:
    """Adds the features to pairs with channel_hits and structs a and b, which hold the `fields` of with_feature_fields; with a="a_", those of a are columns of with_fields_of.

    With strict, cand_is_s2 is always 0, as the published models were trained; otherwise it tells S2 from S3.
    """
    x, y = (lambda f: F.col(f"{a}{f}")), (lambda f: F.col(f"b.fields.{f}"))
    same = lambda f: _flag((x(f) == y(f)) & (x(f) != ""))
    digits, postal3 = _meet(x("digits"), y("digits")), _meet(x("p3"), y("p3"))
    made = {
        "name_clean_exact": same("n"), "name_legal_exact": same("l"), "name_fuzz_ratio": S.indel_ratio(x("n"), y("n")), "name_token_sort_ratio": S.indel_ratio(x("ns"), y("ns")),
        "name_token_jaccard": S.jaccard(x("nw"), y("nw")), "name_token_dice": S.dice(x("nw"), y("nw")), "name_token_overlap": S.overlap(x("nw"), y("nw")),
        "name_c3_jaccard": S.ngram_jaccard(x("n"), y("n"), x("n3"), y("n3")), "name_c4_jaccard": S.ngram_jaccard(x("n"), y("n"), x("n4"), y("n4")),
        "name_len_diff_ratio": S.length_difference(x("n"), y("n")), "name_prefix_ratio": S.prefix_ratio(x("n"), y("n"), T.prefix_length(x("n"), y("n"))),
        "name_translit_c3": S.ngram_jaccard(x("t"), y("t"), x("t3"), y("t3")), "name_translit_exact": same("t"),
        "name_acronym_match": _flag((x("acr") != "") & (y("acr") != "") & ((x("acr") == y("acr")) | (x("acr") == y("n")) | (y("acr") == x("n")))),
        "name_squeezed_c3": S.ngram_jaccard(x("sq"), y("sq"), x("sq3"), y("sq3")), "addr_clean_exact": same("a"), "addr_fuzz_ratio": S.indel_ratio(x("a"), y("a")),
        "addr_token_sort_ratio": S.indel_ratio(x("as_"), y("as_")), "addr_token_jaccard": S.jaccard(x("aw"), y("aw")), "addr_token_dice": S.dice(x("aw"), y("aw")),
        "addr_token_overlap": S.overlap(x("aw"), y("aw")), "addr_c3_jaccard": S.ngram_jaccard(x("a"), y("a"), x("a3"), y("a3")), "addr_len_diff_ratio": S.length_difference(x("a"), y("a")),
        "postal_exact_match": _flag(_meet(x("postals"), y("postals"))), "postal_prefix3_match": _flag(postal3), "digits_overlap_ratio": S.overlap(x("digits"), y("digits")),
        "numeric_post_match": _flag(postal3 & digits), "landmark_match": _flag(_meet(x("marks"), y("marks"))),
    }
    return pairs.withColumns(made).withColumns({
        "name_x_addr_jaccard": F.col("name_token_jaccard") * F.col("addr_token_jaccard"), "name_c3_x_addr_c3": F.col("name_c3_jaccard") * F.col("addr_c3_jaccard"),
        "cand_is_s2": F.lit(0.0) if strict else _flag(F.startswith(y("id"), F.lit("S2-"))), "channel_hits": F.col("channel_hits").cast("double"),
    })


# The order of the 19 features of earlier models; the first two are the same by definition.
LEGACY_FEATURES = (
    "name_exact_match name_clean_exact name_token_jaccard name_token_dice name_token_overlap name_c3_jaccard name_c4_jaccard name_len_diff_ratio name_prefix_ratio"
    " addr_exact_match addr_token_jaccard addr_token_dice addr_token_overlap addr_c3_jaccard addr_len_diff_ratio postal_exact_match digits_overlap_ratio name_x_addr_jaccard"
    " name_c3_x_addr_c3"
).split()


def with_legacy_fields(records: DataFrame) -> DataFrame:
    """Records with a column `fields` of what the earlier features read: legal names, and words of at least three characters."""
    return records.withColumn("fields", F.struct(*[c.alias(f) for f, c in _legacy_fields(F.col("legal_name"), F.col("clean_addr"), F.col("digits")).items()]))


def _legacy_fields(n: Column, a: Column, digits: Column) -> dict[str, Column]:
    return {
        "n": n, "a": a, "nw": T.name_tokens(n), "aw": T.name_tokens(a), "postals": T.postals(a), "digits": digits, "n3": T.ngrams_bare(n), "n4": T.ngrams_bare(n, 4), "a3": T.ngrams_bare(a),
    }


def short_legacy_fields() -> Column:
    """A struct of what the earlier features' fields can be made of again."""
    return F.struct(F.col("legal_name").alias("n"), F.col("clean_addr").alias("a"), "digits")


def with_legacy_fields_of(pairs: DataFrame, short: str) -> DataFrame:
    """As with_fields_of, from the struct `short` of short_legacy_fields."""
    return pairs.withColumns({f"{short}_{f}": c for f, c in _legacy_fields(*[F.col(f"{short}.{f}") for f in ("n", "a", "digits")]).items()})


def legacy_pair_features(pairs: DataFrame, a: str = "a.fields.") -> DataFrame:
    """Adds the 19 features to pairs with structs a and b, which hold the `fields` of with_legacy_fields; with a="a_", those of a are columns of with_legacy_fields_of."""
    x, y = (lambda f: F.col(f"{a}{f}")), (lambda f: F.col(f"b.fields.{f}"))
    same = lambda f: _flag((x(f) == y(f)) & (x(f) != ""))
    sets = lambda prefix, f: {f"{prefix}_token_{k}": g(x(f), y(f)) for k, g in (("jaccard", S.jaccard), ("dice", S.dice), ("overlap", S.overlap))}
    made = {
        "name_exact_match": same("n"), "name_clean_exact": same("n"), **sets("name", "nw"), "name_c3_jaccard": S.ngram_jaccard(x("n"), y("n"), x("n3"), y("n3")),
        "name_c4_jaccard": S.ngram_jaccard(x("n"), y("n"), x("n4"), y("n4")), "name_len_diff_ratio": S.length_difference(x("n"), y("n")),
        "name_prefix_ratio": S.prefix_ratio(x("n"), y("n"), T.prefix_length(x("n"), y("n"))), "addr_exact_match": same("a"), **sets("addr", "aw"),
        "addr_c3_jaccard": S.ngram_jaccard(x("a"), y("a"), x("a3"), y("a3")), "addr_len_diff_ratio": S.length_difference(x("a"), y("a")),
        "postal_exact_match": _flag(_meet(x("postals"), y("postals"))), "digits_overlap_ratio": S.overlap(x("digits"), y("digits")),
    }
    joint = {"name_x_addr_jaccard": F.col("name_token_jaccard") * F.col("addr_token_jaccard"), "name_c3_x_addr_c3": F.col("name_c3_jaccard") * F.col("addr_c3_jaccard")}
    return pairs.withColumns(made).withColumns(joint)
