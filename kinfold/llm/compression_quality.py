"""Quality scores from compression: how much better good text's dictionary packs a text than bad text's.

One Zstandard dictionary is built from text labelled good, one from text labelled bad. A text is cut into blocks of BLOCK
bytes, each block is packed with either dictionary, and the difference of the summed sizes over the text's length
goes through a logistic curve. For the curve each half of the labelled texts is packed with dictionaries of the other half; the scores use
dictionaries of both. Texts under SHORT bytes have a curve of
their own, since a difference over few bytes says less. Learning uses a sample of at most about PER_CLASS labelled rows of each class: the dictionaries take
at most about BLOCKS blocks of a text, chosen by hash from all over it, the curves and the scores use whole texts.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fresh

BLOCK, DICTIONARY, LEVEL = 1024, 112_640, 3
PER_CLASS, BLOCKS, SHORT = 2500, 8, 128
KEEP = 0.3


class Packer:
    """curves: intercept and slope for texts under SHORT bytes, and for longer ones."""

    def __init__(self, good: bytes, bad: bytes, curves: tuple[tuple[float, float], ...] = ((0.0, 0.0), (0.0, 0.0))) -> None:
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d) if d else None) for d in (good, bad)]
        self.good, self.bad, self.curves = good, bad, curves

    def difference(self, data: bytes | memoryview) -> float:
        """By how much the good dictionary packs data better, in parts of a hundred of its length."""
        good, bad = (x.compress for x in self.pair)
        gained = 0
        for i in range(0, len(data), BLOCK):
            block = data[i : i + BLOCK]
            gained += len(bad(block)) - len(good(block))
        return 100.0 * gained / (len(data) + 64)

    def score(self, data: bytes | memoryview) -> float:
        intercept, slope = self.curves[len(data) >= SHORT]
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, intercept + slope * self.difference(data)))))


def _dictionary(blocks: list[bytes]) -> bytes:
    if not blocks:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples to train on: their own bytes serve
        return b"".join(blocks)[-DICTIONARY:]


def _blocks(batches):
    """At most about BLOCKS blocks of each text, chosen by a hash of its id and their place."""
    for batch in batches:
        rows = []
        for doc_id, quality, half, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "quality", "half", "text")), strict=True):
            data = text.encode()
            share = BLOCKS * BLOCK / max(1, len(data))
            rows += [
                (doc_id, quality, half, i, data[i : i + BLOCK]) for i in range(0, len(data), BLOCK)
                if share >= 1 or zlib.crc32(f"{doc_id} {i}".encode()) < share * 2**32
            ]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "quality", "half", "place", "block"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _curve(x: np.ndarray, y: np.ndarray, shift: float, prior: float) -> tuple[float, float]:
    """Intercept and slope, moved by shift; the prior's log odds and no slope without both classes."""
    if len(set(y.tolist())) < 2:
        return prior, 0.0
    w = logistic(np.column_stack([np.ones(len(x)), x]), y)
    return float(w[0]) + shift, float(w[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Packer:
    """Learn from labelled documents (doc_id, quality 0 or 1). Ids with contradicting or other labels are left out.

    Rows are chosen by a hash of the id, about per_class of each class; of rows that repeat an id the first text in order teaches. Without rows of both classes the score is the share of good labels, or 0.5 without labels.
    """
    clean = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    )
    counts = {r.quality: r.n for r in clean.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("quality") == 1, per_class / max(1, counts.get(1, 0))).otherwise(per_class / max(1, counts.get(0, 0)))
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    chosen = clean.where(place < share)  # about 2 * per_class ids at most
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
        .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int"))
    )
    taken = rows.mapInArrow(_blocks, "doc_id long, quality int, half int, place long, block binary").toArrow()
    taken = taken.sort_by([("doc_id", "ascending"), ("place", "ascending")]).to_pylist()

    def dictionaries(*halves: int) -> tuple[bytes, bytes]:
        return tuple(_dictionary([r["block"] for r in taken if r["quality"] == q and r["half"] in halves]) for q in (1, 0))

    held = docs.sparkSession.sparkContext.broadcast((dictionaries(1), dictionaries(0)))

    def measure(batches):
        packers = [Packer(*x) for x in held.value]
        for batch in batches:
            data = [x.encode() for x in batch.column("text").to_pylist()]
            found = [packers[half].difference(x) for half, x in zip(batch.column("half").to_pylist(), data, strict=True)]
            columns = [batch.column("doc_id"), batch.column("quality"), pa.array([len(x) for x in data], pa.int64()), pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "quality", "size", "difference"])

    fit = rows.mapInArrow(measure, "doc_id long, quality int, size long, difference double").toArrow().sort_by("doc_id")
    x, y, size = (fit.column(c).to_numpy() for c in ("difference", "quality", "size"))
    prior = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    # The sample is balanced more than the labels are: shift the curves back to their odds.
    shift = prior + math.log(((y == 0).sum() + 1) / ((y == 1).sum() + 1))
    all_of = _curve(x, y.astype(float), shift, prior)
    curves = []
    for long in (False, True):
        part = (size >= SHORT) == long
        curves.append(_curve(x[part], y[part].astype(float), shift, prior) if len(set(y[part].tolist())) == 2 else all_of)
    return Packer(*dictionaries(0, 1), tuple(curves))


def score(docs: DataFrame, model: Packer, columns: list[str] | None = None, name: str = "quality_score") -> DataFrame:
    """The named columns of docs, or all, with column `name`, from 0 to 1; a null text is an empty one. A column of that name gives way.

    A text goes to Python once and is read where it lies; it comes back only if it is among the columns.
    """
    names = [c for c in (docs.columns if columns is None else columns) if c.lower() != name.lower()]
    sent, at = docs.select(*names), len(names)
    if "text" in names and docs.schema["text"].dataType == StringType():
        at = names.index("text")
    else:
        sent = docs.select(*names, F.col("text").cast("string").alias(fresh(docs, "_text")))
    held = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.curves))

    def run(batches):
        packer = Packer(*held.value)
        for batch in batches:
            raw = batch.column(at).cast(pa.binary())
            scores = pa.array([packer.score(memoryview(x.as_buffer()) if x.is_valid else b"") for x in raw], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), scores], names=[*names, name])

    schema = StructType([*(docs.schema[c] for c in names), StructField(name, DoubleType())])
    return sent.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP) -> DataFrame:
    """The rows of docs whose score is at least the threshold; every column is kept, whatever its name."""
    name = fresh(docs, "quality_score")
    return score(docs, train(docs, labels), name=name).where(F.col(name) >= threshold).drop(name)
