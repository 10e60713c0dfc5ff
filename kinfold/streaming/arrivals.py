"""Arriving records against a table of postings that is already there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.channels import channel_keys
from ..operators.records import records


def match_arrivals(arrivals: DataFrame, postings: DataFrame, names: list[str]) -> DataFrame:
    """Key hits of each arriving record, streaming or not, by a join of the stream with the static postings."""
    probes = channel_keys(records(arrivals), names).select(F.col("entity_id").alias("s1_id"), "channel", "country", "ktype", "kval")
    return probes.join(postings, ["channel", "country", "ktype", "kval"]).select("s1_id", "cand_id", "channel")
