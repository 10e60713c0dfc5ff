"""N-gram Jaccard join by multiple-global-order filtering.

Two texts link when the Jaccard similarity of their sets of distinct k-word shingles is at least
percent / 100. The join is exact up to collisions of 64-bit shingle hashes.

Method. Texts with equal sets are one node. For any one order of all shingles, two linked sets share a
shingle within their first p = n - ceil(t n) + 1. Three global orders are used, so a pair has to share a
prefix shingle under each of them before it becomes a candidate. The orders put shingles with a small hash first, those by rising
document frequency, and differ in how ties are broken. A shingle that only one text has never makes a
candidate, so nearly all postings go before any pair exists.

Bounded work for hot shingles. A shingle with more than LIST nodes in its posting list makes no pairs: each
member gets one edge to the list's smallest node. Connected components of the candidate edges form clusters;
clusters are dealt, by rising size of the sets, into blocks of about BLOCK nodes or BLOCK_BYTES bytes, and each pair of blocks whose sizes allow links is compared in one task as a
blocked matrix product, which decides every pair exactly and returns one row for each node. No row is made for a pair. In clusters of
more than WHOLE nodes or WHOLE_BYTES bytes of sets a set travels as its symmetric difference from the set of the cluster's smallest node: for sets A, B and
any R, A ^ B = (A ^ R) ^ (B ^ R), so that intersections follow from the differences, which are short between near copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, join_hot, stage, unstage
from .shingles import many_word_hashes, mix, shingle_set

LIST = 64
#: Most nodes and bytes, about, of a block of whole sets, and of a block of differences to compare. One set alone may be larger.
WHOLE, WHOLE_BYTES, BLOCK, BLOCK_BYTES = 256, 4 << 20, 2048, 4 << 20
#: The bitmap of wanted texts has 2**BITS to 2**MOST_BITS bits, 16 for each if there is room.
BITS, MOST_BITS = 22, 27
#: Rows whose sets a worker makes at a time.
SLICE = 512
#: Bands of sizes between a size and the largest that can be linked with it.
STEPS = 8
U = np.uint64


def prefix_length(n: int, percent: int) -> int:
    return n + (-n * percent) // 100 + 1


def class_limit(percent: int) -> int:
    """Shingles whose hash is below this come first in every order: 1.6 times a prefix's share of all."""
    return int(min(0.5, 0.016 * (100 - percent)) * 2**64)


def _slices(batches):
    """Batches of at most SLICE rows, so that few sets are held at once."""
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            yield batch.slice(begin, SLICE)


def _signatures(k: int, percent: int):
    limit = U(class_limit(percent) - 1)

    def run(batches):
        for batch in _slices(batches):
            ids = batch.column("doc_id")
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            rows: dict[str, list] = {c: [] for c in ("n", "f1", "f2", "n0", "p", "toks")}
            for words in many_word_hashes(b"" if x is None else x for x in raw):
                s = shingle_set(words, k)
                n, n0 = len(s), int(np.searchsorted(s, limit, side="right"))
                p = prefix_length(n, percent) if n else 0
                rows["n"].append(n)
                rows["n0"].append(n0)
                rows["p"].append(p)
                rows["f1"].append(np.add.reduce(mix(s), dtype=U).view(np.int64).item() if n else 0)
                rows["f2"].append(np.add.reduce(mix(s ^ U(0xA5A5A5A5A5A5A5A5)), dtype=U).view(np.int64).item() if n else 0)
                rows["toks"].append(s[: max(n0, p)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64())] + [pa.array(rows[c], pa.int64()) for c in ("n", "f1", "f2", "n0", "p")] + [pa.array(rows["toks"], pa.list_(pa.int64()))],
                names=["doc_id", "n", "f1", "f2", "n0", "p", "toks"],
            )

    return run


def _full_sets(k: int, bits: int, wanted):
    """Sets of the texts whose id falls into one of 2**bits buckets that is wanted."""

    def run(batches):
        for batch in _slices(batches):
            ids = batch.column("doc_id")
            known = np.asarray(ids.is_valid())
            bucket = _buckets(np.asarray(ids.fill_null(0)).astype(np.int64), bits)
            keep = np.flatnonzero(known & (wanted.value[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool))
            raw = batch.column("text").cast(pa.binary()).take(pa.array(keep)).to_pylist()
            sets = [shingle_set(w, k) for w in many_word_hashes(b"" if x is None else x for x in raw)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()).take(pa.array(keep)),
                    pa.array([np.add.reduce(mix(s), dtype=U).view(np.int64).item() if len(s) else 0 for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "f1", "n", "shingles"],
            )

    return run


def _buckets(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(U)) >> U(64 - bits)).astype(np.int64)


def _bitmap(bits: int):
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("node")).astype(np.int64)
            bucket = np.unique(_buckets(ids, bits))
            yield pa.RecordBatch.from_arrays([pa.array(bucket >> 6), pa.array(np.left_shift(np.int64(1), bucket & 63))], names=["word", "bit"])

    return run


def _differences(key, rows):
    """Each set of a block as its symmetric difference from the cluster's reference, the same in all blocks."""
    sets = [np.frombuffer(x, dtype=U) for x in rows.column("shingles").to_pylist()]
    marked, f1 = rows.column("reference").to_pylist(), rows.column("f1").to_pylist()
    reference = sets[min((i for i, x in enumerate(marked) if x), key=f1.__getitem__)]
    keep = [i for i, x in enumerate(marked) if not x]
    differing = [np.setxor1d(sets[i], reference, assume_unique=True).tobytes() for i in keep]
    kept = rows.select(["cluster", "node", "copies", "n"]).take(pa.array(keep, pa.int64()))
    return kept.append_column("shingles", pa.array(differing, pa.binary()))


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered left with those numbered right; below 2**24, so that float32 is exact."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, where = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(where, minlength=1) > 1
    column = np.cumsum(shared) - 1
    row, where = row[shared[where]], column[where[shared[where]]]
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for begin in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(where, (begin, begin + 2048))
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[row[a:b], where[a:b] - begin] = 1
        common += part[left] @ part[right].T
    return common


def _spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray, total: int) -> np.ndarray:
    """For each of total nodes one that it was reached from by links between left and right, or -1 for the first of a component."""
    mate, seen = np.full(total, -1), np.zeros(total, dtype=bool)
    beside = [[] for _ in range(total)]
    for across, nodes, others in ((linked, left, right), (linked.T, right, left)):
        for i, x in enumerate(nodes):
            beside[x].append((across[i], others))
    for first in range(total):
        if seen[first]:
            continue
        seen[first], waiting = True, [first]
        while waiting:
            x = waiting.pop()
            for touches, others in beside[x]:
                found = others[touches & ~seen[others]]
                seen[found], mate[found] = True, x
                waiting.extend(found.tolist())
    return mate


def _compare(percent: int):
    """All pairs of a cell: links of each node, weighted by copies, and a neighbour towards a spanning forest.

    shingles holds sets, or their differences from one reference; n is the size of the set itself. Nodes without links give no row.
    """

    def run(key, rows):
        sets = [np.frombuffer(x, dtype=U) for x in rows.column("shingles").to_pylist()]
        node, n = np.asarray(rows.column("node")).astype(np.int64), np.asarray(rows.column("n")).astype(np.int64)
        copies, side = np.asarray(rows.column("copies")), np.asarray(rows.column("block"))
        outside = n - np.array([len(s) for s in sets], dtype=np.int64)
        within = key[1] == key[2]
        left = np.flatnonzero(side == key[1].as_py())
        right = left if within else np.flatnonzero(side == key[2].as_py())
        common = _intersections(sets, left, right)
        linked = np.zeros(common.shape, dtype=bool)
        for i, x in enumerate(left):
            both = common[i].astype(np.int64) + (outside[x] + outside[right]) // 2
            linked[i] = (100 * both >= percent * (n[x] + n[right] - both)) & (both > 0) & (node[right] != node[x])
        links = np.zeros(len(sets), dtype=np.int64)
        links[left] = linked @ copies[right]
        if not within:
            links[right] = copies[left] @ linked
        mate = _spanning(linked, left, right, len(sets))
        keep = np.flatnonzero(links)
        tree = [None if m < 0 else int(node[m]) for m in mate[keep]]
        return pa.table({"node": pa.array(node[keep]), "mate": pa.array(tree, pa.int64()), "links": pa.array(links[keep], pa.int64())})

    return run


def size_band(n: Column, percent: int) -> Column:
    """Sizes in geometric steps: those of linked sets lie at most STEPS + 1 bands apart."""
    return F.floor(F.ln(n) * (STEPS / math.log(100 / min(percent, 99))))


def _ranges(sets: DataFrame) -> DataFrame:
    """For each cluster and band of sizes: where its sets begin on a line of blocks, the length they take, and the first and last block that sets of linked sizes can lie in.

    A cluster's line is as long as its sets are many or large, in order of their sizes; block i is what lies from i to i + 1.
    """
    weight = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("shingles")) / BLOCK_BYTES)
    by = Window.partitionBy("cluster").orderBy("band")
    line = sets.groupBy("cluster", "band").agg(weight.alias("weight")).withColumn("begin", F.coalesce(F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    near = by.rangeBetween(-STEPS - 1, STEPS + 1)
    return line.withColumns({"first": F.floor(F.min("begin").over(near)), "last": F.floor(F.max(F.col("begin") + F.col("weight")).over(near))})


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, n_links.

    component_id is the smallest doc_id reachable by links, itself included; n_links counts the other
    rows linked with it, equal sets included. A null or empty text has n_shingles 0, is its own component and has no
    links. A null doc_id keeps its n_shingles, links with nothing, and has a null component. Rows that repeat
    a doc_id count as one document that has each of the texts. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = docs.mapInArrow(_signatures(k, percent), "doc_id long, n long, f1 long, f2 long, n0 long, p long, toks array<long>")
    all_sets = stage(made.withColumn("rid", F.monotonically_increasing_id()), "sets")
    live = all_sets.where("n > 0 and doc_id is not null")
    classes = live.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.min_by("rid", "doc_id").alias("kept"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))

    # Postings: one representative per class, its first shingles, those that other nodes have too.
    classes = stage(classes, "classes")
    size = classes.agg(F.sum("copies"), F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.max("copies")).first()
    n_live, n_copies, most_copies = (x or 0 for x in size)
    repeated = classes.where("copies > 1").select("f1", "f2", "kept", "copies")
    extra = stage(join_hot(live.select("rid", "f1", "f2"), repeated, ["f1", "f2"], "copies", n_copies, most=most_copies).where("rid <> kept").select("rid"), "extra")
    reps = live.join(extra, "rid", "left_anti")
    posted = reps.select("rid", F.explode("toks").alias("t"))
    df = stage(posted.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumn("rows", F.col("df")), "df")
    n_posted, most_posted = (x or 0 for x in df.agg(F.sum("df"), F.max("df")).first())
    shared = join_hot(posted, df, ["t"], "rows", n_posted, most=most_posted).join(reps.select("rid", F.col("doc_id").alias("node"), "n", "n0", "p"), "rid")

    first = (F.col("t") >= 0) & (F.col("t") < F.lit(min(class_limit(percent), 2**63 - 1)))
    by_set = Window.partitionBy("rid")
    ranked = shared.withColumn("tier", F.when(first, 0).otherwise(1))
    ranked = ranked.withColumn("room", F.col("p") - F.col("n0") + F.sum(1 - F.col("tier")).over(by_set))
    mask = F.lit(0)
    for bit, tie in enumerate((F.col("t"), F.xxhash64("t"), F.xxhash64("t", F.lit(7)))):
        rank = F.row_number().over(by_set.orderBy("tier", "df", tie))
        ranked = ranked.withColumn(f"r{bit}", rank)
        mask = mask + F.when((F.col("tier") == 1) | (F.col(f"r{bit}") <= F.col("room")), 1 << bit).otherwise(0)
    prefix = stage(ranked.withColumn("mask", mask).where("mask > 0").select("t", "node", "n", "mask"), "prefix")
    unstage(extra, df)

    lists = stage(prefix.groupBy("t").agg(F.count_distinct("node").alias("len"), F.min("node").alias("least"), F.count(F.lit(1)).alias("rows")).where("len > 1"), "lists")
    listed = join_hot(prefix, lists, ["t"], "rows", n_posted, most=lists.agg(F.max("rows")).first()[0] or 0)
    a, b = listed.where(f"len <= {LIST}").alias("a"), prefix.alias("b")
    pairs = (
        a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.node") < F.col("b.node"))
               & (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent))
        .groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
        .agg(F.bit_or(F.col("a.mask").bitwiseAND(F.col("b.mask"))).alias("mask"))
        .where("mask = 7").select("u", "v")
    )
    hubs = listed.where(f"len > {LIST}").select(F.col("least").alias("u"), F.col("node").alias("v"))
    clusters = stage(components(pairs.unionByName(hubs)).select("node", F.col("label").alias("cluster")), "clusters")
    unstage(prefix, lists)

    # Whole sets of the nodes in clusters; a bitmap of buckets skips nearly all other texts.
    bits = min(MOST_BITS, max(BITS, (16 * clusters.count()).bit_length()))
    words = clusters.select("node").mapInArrow(_bitmap(bits), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    packed = np.zeros(1 << bits - 6, dtype=np.int64)
    packed[words.column("word").to_numpy()] = words.column("bit").to_numpy()
    found = spark.sparkContext.broadcast(packed.view(np.uint8))
    sets = docs.mapInArrow(_full_sets(k, bits, found), "doc_id long, f1 long, n long, shingles binary")
    sized = clusters.join(classes.select("node", "f1", "copies", F.col("n").alias("size")), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / WHOLE, F.sum("size") * 8 / WHOLE_BYTES)).cast("long")
    by_cluster = stage(sized.groupBy("cluster").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("nodes")), "sizes")
    nodes, most_nodes = (x or 0 for x in by_cluster.agg(F.sum("nodes"), F.max("nodes")).first())
    placed = join_hot(sized.drop("size"), by_cluster, ["cluster"], "nodes", nodes, most=most_nodes).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = stage(placed.join(sets.withColumnRenamed("doc_id", "node"), ["node", "f1"]).dropDuplicates(["node", "f1"]), "members")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ["cluster", "blocks", "block", "node", "copies", "n", "f1", "shingles"]
    large = members.where("blocks > 1").select(*columns)
    references = large.where("node = cluster").withColumn("block", every).withColumn("reference", F.lit(True))
    differing = stage(
        large.withColumn("reference", F.lit(False)).unionByName(references).groupBy("cluster", "block")
        .applyInArrow(_differences, "cluster long, node long, copies long, n long, shingles binary"),
        "differences",
    )
    cells = differing.withColumn("band", size_band(F.col("n"), percent))
    cells = cells.join(_ranges(cells), ["cluster", "band"])
    share = F.shiftrightunsigned(F.xxhash64("node"), 11) / F.lit(2.0**53)
    cells = cells.withColumn("block", F.floor(F.col("begin") + share * F.col("weight"))).withColumn("other", F.explode(F.sequence("first", "last"))).select(
        "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block", "copies", "n", "shingles"
    )
    small = members.where("blocks = 1").select("cluster", F.col("block").alias("lo"), F.col("block").alias("hi"), "node", "block", "copies", "n", "shingles")
    compared = stage(
        small.unionByName(cells).groupBy("cluster", "lo", "hi").applyInArrow(_compare(percent), "node long, mate long, links long"), "links"
    )
    unstage(members, differing, clusters, by_cluster)
    joined = components(compared.where("mate is not null").select("node", "mate"))

    degree = compared.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        classes.join(joined, "node", "left").join(degree, "node", "left")
        .select("f1", "f2", "copies", F.coalesce("label", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("class_links"))
    )
    usable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    named = stage(named, "named")
    unstage(classes, compared)
    out = join_hot(all_sets.select("doc_id", "n", "f1", "f2"), named, ["f1", "f2"], "copies", n_live, "left", most_copies).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(usable, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(usable, F.col("class_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
    return out


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; every column is kept, whatever its name.

    Rows with an empty text or a null doc_id stay. A row repeated with its doc_id stays as often as it came.
    """
    gone = stage(jaccard_join(docs, k, percent).where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
