"""Source records with the fields that keys and features are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def records(sources: DataFrame) -> DataFrame:
    """Adds src, cleaned names and addresses, and their words, to entity_id, business_name, business_address, country."""
    out = sources.withColumns({
        "src": F.substring("entity_id", 1, 2), "name": T.raw(F.col("business_name")), "addr": T.raw(F.col("business_address")),
    }).withColumns({"base_name": T.base(F.col("name")), "clean_name": T.clean(F.col("name")), "clean_addr": T.clean(F.col("addr"))})
    out = out.withColumn("legal_name", T.legal_from_clean(F.col("clean_name")))
    # The romanised legal name; that of an ASCII name is its legal name.
    out = out.withColumn("rom_name", F.when(T.is_non_ascii(F.col("name")), T.legal(T.transliterate(F.col("name")))).otherwise(F.col("legal_name")))
    n, a, legal = F.col("clean_name"), F.col("clean_addr"), F.col("legal_name")
    return out.withColumns({
        "name_words": T.name_words(n), "legal_words": T.words(legal), "name_tokens": T.name_tokens(legal), "addr_words": T.address_words(a),
        "addr_words3": T.address_words(a, 3), "addr_words4": T.address_words(a, 4), "digits": T.digit_runs(a), "postals": T.postals(F.col("addr")),
    })
