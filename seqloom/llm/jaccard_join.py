"""Similarity join of documents on word shingles, with Bayesian pruning of candidates.

Documents are sets of 5-word shingles (64-bit hashes); two are linked if the Jaccard similarity of
their sets is 0.8 or more.  Documents with equal sets are one node with a number of copies.

1. MinHash signatures of 128 values; two nodes that agree on all four values of one of 32 bands
   are a candidate pair (a pair at 0.8 is missed with probability 5e-8).
2. Each node is joined to the smallest node of its buckets; the components of these edges gather
   candidates without pairs.  A component is compared in pairs of blocks of about ``BLOCK`` nodes, each its own task:
   blocks of the whole component, or of each of its buckets where these hold fewer pairs together
   (chains).  Either way exactly the candidate pairs are judged, each once.
3. A pair's MinHash values are compared 32 at a time; it is dropped as soon as the posterior
   probability of a similarity of 0.8, from a uniform prior, falls below ``TOLERANCE``.
4. What is left is verified exactly on the sets.

A pair of blocks gives one row per linked node: how many documents it links to and the smallest node it
hangs together with there.  So no list of pairs is ever written, and nothing is capped.  A node's text is fetched once, its
set and signature are made once and sent to the tasks of its group, which are dealt round robin over the
partitions.  The number of links inside a group of near copies can only be counted by comparing them: that is the one
quadratic part, it is vectorised, and it spreads over tasks; a set travels to one task for every ``BLOCK`` nodes of its group.

Defined cases: texts of under 5 words have one shingle, all their words; documents without words
have no links and are classes of their own; so are rows with a null id (their class is null);
rows that share an id are judged each by its own text; other columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import components
from seqloom.llm.substring_dedup import by_group
from seqloom.llm.words import BASES, Roller, WordHashes, mix, split_words
from seqloom.session import checkpointed, forget, ship, without_shuffle_files

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS, STEP = 32, 4, 32
VALUES = BANDS * ROWS
TOLERANCE = 1e-9
BLOCK = 256
CHUNK = 1 << 16
#: Rows of tasks that a partition takes, and the most partitions.
PARTITION_ROWS = 8192
MOST_PARTITIONS = 20_000

_U = np.uint64
_random = np.random.default_rng(20240229)
MULTIPLY = _random.integers(1, 1 << 63, VALUES, _U) * _U(2) + _U(1)
ADD = _random.integers(0, 1 << 63, VALUES, _U)


class Shingler:
    """Shingle sets, signatures and keys of texts."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.words, self.roller = width, WordHashes(), Roller(BASES[0])

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingle hashes of a text, sorted."""
        words = split_words(text)
        if not words:
            return np.empty(0, _U)
        h = self.words.of(words)
        if len(words) < self.width:
            return mix(self.roller.windows(h, len(words)) + _U(len(words)))
        return np.unique(self.roller.windows(h, self.width))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, one row each."""
    out = np.empty((len(sets), VALUES), np.uint32)
    if sets:
        h = np.concatenate(sets)
        edges = np.cumsum([0, *map(len, sets[:-1])])
        for k in range(VALUES):
            out[:, k] = np.minimum.reduceat(((h * MULTIPLY[k] + ADD[k]) >> _U(32)).astype(np.uint32), edges)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(-1, BANDS, ROWS).astype(_U)
    h = np.broadcast_to(np.arange(BANDS, dtype=_U), bands.shape[:2])
    for r in range(ROWS):
        h = mix(h * _U(BASES[0]) + bands[:, :, r])
    return h.view(np.int64)


def set_keys(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that don't depend on the order of a set."""
    return [
        np.array([mix(s).sum(dtype=_U), mix(s ^ _U(BASES[1])).sum(dtype=_U)], "<u8").tobytes() if len(s) else None for s in sets
    ]


@functools.cache
def least_agreement(similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For 32, 64, ... values compared: how many must agree for a pair to stay."""
    x = np.linspace(0, 1, 100_001)[1:-1]
    least = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            density = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(density - density.max())
            if density[x >= similarity].sum() >= tolerance * density.sum():
                break
        least.append(m)
    return tuple(least)


def surviving_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature blocks that no step of the comparison drops."""
    agree = np.zeros((len(a), len(b)), np.uint8)
    for k in range(STEP):
        agree += a[:, k, None] == b[None, :, k]
    alive = agree >= least_agreement()[0]
    if same:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    count = agree[i, j].astype(np.int32)
    for step, least in enumerate(least_agreement()[1:], 1):
        part = slice(step * STEP, (step + 1) * STEP)
        stay = np.empty(len(i), bool)
        for at in range(0, len(i), CHUNK):
            s = slice(at, at + CHUNK)
            count[s] += (a[i[s], part] == b[j[s], part]).sum(axis=1)
            stay[s] = count[s] >= least
        i, j, count = i[stay], j[stay], count[stay]
    return i, j


def verified(i: np.ndarray, j: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs reach the similarity, from the sets themselves."""
    ok = np.zeros(len(i), bool)
    if not len(i):
        return ok
    edges = np.cumsum([0, *map(len, b)])
    values, ids = np.unique(np.concatenate(b), return_inverse=True)
    sizes = np.diff(edges)
    order = np.argsort(i, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        own = a[i[part[0]]]
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        mark = np.zeros(len(values), np.int32)
        mark[at[values[at] == own]] = 1
        if len(part) * 4 > len(b):
            common = np.add.reduceat(mark[ids], edges[:-1])[j[part]]
        else:
            common = np.array([mark[ids[edges[x] : edges[x + 1]]].sum() for x in j[part]])
        ok[part] = common >= similarity * (len(own) + sizes[j[part]] - common) - 1e-9
    return ok


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def comparer(similarity: float) -> type:
    class Pair:
        """The one or two blocks of nodes of a group, compared when all have come."""

        def __init__(self) -> None:
            self.rows: list[tuple] = []

        def add(self, row: tuple) -> None:
            self.rows.append(row)

        def finish(self) -> Iterator[tuple[int, int, int]]:
            """``node, least, n_links``."""
            # A node whose document is there more than once has come as often.
            rows = sorted({r[:2]: r for r in self.rows}.values(), key=lambda r: r[:2])
            self.rows = []
            blocks = np.array([r[0] for r in rows])
            sets = [np.frombuffer(r[6], "<u8") for r in rows]
            signature = np.frombuffer(b"".join(r[5] for r in rows), "<u4").reshape(-1, VALUES)
            if rows[0][3]:
                i, j = surviving_pairs(signature, signature, True)
            else:
                split = int(np.searchsorted(blocks, blocks[-1]))  # 0: the other block has no rows
                i, j = surviving_pairs(signature[:split], signature[split:], False)
                j = j + split
            i, j = candidates(signature, i, j, rows[0][4])
            linked = verified(i, j, sets, sets, similarity)
            i, j = i[linked], j[linked]
            if not len(i):
                return
            node = np.array([r[1] for r in rows], np.int64)
            copies = np.array([r[2] for r in rows], np.int64)
            n = np.zeros(len(rows), np.int64)
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            root = roots(len(rows), i, j)
            least = node.copy()
            np.minimum.at(least, root, node)
            for x in np.flatnonzero(n).tolist():
                yield int(node[x]), int(least[root[x]]), int(n[x])

    return Pair


def candidates(signature: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that share a band; if ``band`` is one of them, those that share it first."""
    stay = np.empty(len(i), bool)
    for at in range(0, len(i), CHUNK):
        s = slice(at, at + CHUNK)
        equal = (signature[i[s]] == signature[j[s]]).reshape(-1, BANDS, ROWS).all(axis=2)
        stay[s] = equal.any(axis=1) & ((band < 0) | (equal.argmax(axis=1) == band))
    return i[stay], j[stay]


def featured(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, hash, key, bands`` of each document; no key and bands where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            texts, at = batch.column(2), 0
            while at < len(batch):
                sets, held, first = [], 0, at
                while at < len(batch) and held < CHUNK:
                    sets.append(shingler.shingles(texts[at].as_py()))
                    held += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                hashes = iter(band_hashes(signatures(full)))
                bands = [next(hashes) if len(s) else None for s in sets]
                columns = [batch.column(0)[first:at], batch.column(1)[first:at], pa.array(set_keys(sets), pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, names=["doc_id", "hash", "key", "bands"])

    hashed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return hashed.mapInArrow(run, "doc_id long, hash long, key binary, bands array<bigint>")


def _tasks(members: DataFrame, parts: int) -> DataFrame:
    """``node, doc, copies, key`` of ``members``, and for each pair of blocks of its group with the node a task.

    ``members`` also has ``group, band, size``, the group's number of nodes.  The tasks of a group go to neighbouring partitions.
    """
    n = F.ceil(F.col("size") / BLOCK).cast("long")
    placed = members.withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    number = F.shiftright(high * (high + 1), 1) + low
    task = F.struct(
        F.concat_ws(" ", "group", "band", low, high).alias("task"),
        F.pmod(F.pmod(F.xxhash64("group", "band"), F.lit(parts)) + number, F.lit(parts)).cast("int").alias("part"),
        F.col("block").cast("int").alias("block"),
        (low == high).alias("same"),
        F.col("band").cast("int").alias("band"),
    )
    return spread.select("node", "doc", "copies", "key", task.alias("t"))


def sparse(pairs: Column, size: Column) -> Column:
    """Whether a component's buckets hold fewer pairs together than the component."""
    return pairs < size * size


def _compared(docs: DataFrame, nodes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``node, least, n``: per pair of blocks and linked node, what it hangs together with and how many documents it links to."""
    spark = docs.sparkSession
    in_bands = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    # Aggregates are kept before they are joined, so that a hot bucket or group can be split by the join.
    shared = in_bands.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("size"))
    shared = checkpointed(shared.where("size > 1"))
    stars = in_bands.join(shared, "bucket").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    joined = components(stars)
    found = checkpointed(joined.union(joined.select("root", "root").distinct()).toDF("node", "root"))
    in_buckets = shared.join(found, F.col("least") == F.col("node")).groupBy("root").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    sizes = found.groupBy("root").agg(F.count("*").alias("size")).join(in_buckets, "root")
    sizes = checkpointed(sizes.withColumn("sparse", sparse(F.col("pairs"), F.col("size"))))
    sent = F.col("size") * F.ceil(F.col("size") / BLOCK)
    with without_shuffle_files(spark):
        total = sizes.agg(F.max("sparse").alias("sparse"), F.sum(sent).alias("rows")).first()
    least_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = min(max(least_parts, (total["rows"] or 0) // PARTITION_ROWS), max(least_parts, MOST_PARTITIONS))

    members = nodes.select("node", "doc", "copies", "key").join(found, "node")
    whole = members.join(sizes.where("NOT sparse"), "root").withColumn("band", F.lit(-1)).withColumnRenamed("root", "group")
    tasks = _tasks(whole, parts)
    if total["sparse"]:
        inside = members.join(sizes.where("sparse").select("root"), "root").drop("root")
        of_buckets = in_bands.join(inside, "node").join(shared.select("bucket", "size"), "bucket").withColumnRenamed("bucket", "group")
        tasks = tasks.union(_tasks(of_buckets, parts))
    dealt = tasks.groupBy("node", "doc", "copies", "key").agg(F.collect_list("t").alias("tasks"))
    names = ["node", "copies", "signature", "set", "tasks"]
    with_text = dealt.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").select("node", "copies", "key", "tasks", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            sets = [shingler.shingles(t.as_py()) for t in batch.column(4)]
            # Documents that share an id bring each other's texts.
            own = [i for i, (k, key) in enumerate(zip(set_keys(sets), batch.column(2), strict=True)) if k is not None and k == key.as_py()]
            if not own:
                continue
            sets = [sets[i] for i in own]
            some = batch.take(pa.array(own))
            columns = [
                some.column(0),
                some.column(1),
                pa.array([x.astype("<u4").tobytes() for x in signatures(sets)], pa.binary()),
                pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary()),
                some.column(3),
            ]
            yield pa.record_batch(columns, names=names)

    task_type = "struct<task: string, part: int, block: int, same: boolean, band: int>"
    made = with_text.mapInArrow(make, f"node long, copies long, signature binary, set binary, tasks array<{task_type}>")
    each = made.select(F.explode("tasks").alias("t"), "node", "copies", "signature", "set")
    each = each.select("t.task", "t.block", "node", "copies", "t.same", "t.band", "signature", "set", "t.part")
    each = each.repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions("task")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["node", "least", "n"])

        for row in by_group(batches, comparer(similarity)):
            rows.append(row)
            if len(rows) >= 10_000:
                yield out()
                rows = []
        if rows:
            yield out()

    linked = checkpointed(each.mapInArrow(compare, "node long, least long, n long"))
    forget(shared, found, sizes)
    return linked


def _classified(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``doc_id, hash, root, class_id, n_links, n_copies`` of each document; no root where there are no words or no id."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    features = checkpointed(featured(docs, shingle))
    known = features.where("doc_id IS NOT NULL AND key IS NOT NULL")
    nodes = known.groupBy("key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # A number of its own for each set, fixed by the checkpoint: documents that share an id may have several.
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    linked = _compared(docs, nodes, similarity, shingle)
    counts = linked.groupBy("node").agg(F.sum("n").alias("n"))
    classes = components(linked.select(F.col("node").alias("a"), F.col("least").alias("b")))
    judged = nodes.select("key", "node", "doc", "copies").join(classes, "node", "left").join(counts, "node", "left")
    judged = checkpointed(judged.select("key", F.coalesce("root", "node").alias("root"), "doc", "copies", F.coalesce("n", F.lit(0)).alias("n")))
    least = judged.where("n > 0").groupBy("root").agg(F.min("doc").alias("class_id"))
    judged = judged.join(least, "root", "left").select(
        "key",
        "root",
        F.coalesce("class_id", "doc").alias("class_id"),
        (F.col("n") + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"),
    )
    alone = {"class_id": F.coalesce("class_id", "doc_id"), "n_links": F.coalesce("n_links", F.lit(0)), "n_copies": F.coalesce("n_copies", F.lit(1))}
    keyed = features.select("doc_id", "hash", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    found = keyed.join(judged, "key", "left").select("doc_id", "hash", "root", *[c.cast("long").alias(n) for n, c in alone.items()])
    forget(linked, nodes)
    return found


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` of each document.

    ``class_id`` is the smallest id that a document hangs together with by links; ``n_links``
    counts the other documents that it is linked to, copies included.
    """
    return _classified(docs, similarity, shingle).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class the row with the smallest id (and then text hash), once if it is repeated.

    Rows with a null id or without words stay.
    """
    hashed = "hash"
    while hashed.lower() in {c.lower() for c in docs.columns}:
        hashed = "_" + hashed
    groups = checkpointed(_classified(docs, SIMILARITY, SHINGLE).where("n_links > 0").select("doc_id", F.col("hash").alias(hashed), "root"))
    row = F.struct("doc_id", hashed)
    first = checkpointed(groups.groupBy("root").agg(F.min(row).alias("first")))
    judged = groups.join(first, "root")
    others = judged.where(row != F.col("first")).select("doc_id", hashed).distinct()
    repeated = checkpointed(groups.groupBy("doc_id", hashed).count().where("count > 1").select("doc_id", hashed))
    kept = docs.withColumn(hashed, F.xxhash64("text")).join(others, ["doc_id", hashed], "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, ["doc_id", hashed], "left_semi").dropDuplicates(["doc_id", hashed])
        kept = kept.join(repeated, ["doc_id", hashed], "left_anti").union(once)
    return kept.select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
