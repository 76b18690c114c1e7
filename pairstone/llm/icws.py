"""Near-duplicate groups by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (lower-cased, split at white space; a shorter text is one shingle)
and are hashed to 64 bits. A shingle's weight is its frequency in the text times its inverse document
frequency, in units of the logarithm of RARE and cut at 1: what fewer than one document in RARE has
weighs 1, commoner shingles less with the logarithm of their share, down to LEAST for those that every document
has. The cut is there because copies raise their own document frequency: without it, the words that a group of
hundreds shares would weigh so little against a copy's few own words that the group falls apart.
Document frequencies are counted over all documents in 2**IDF_BITS buckets, less the mean load of a
bucket. As only shares above 1 / RARE matter, and a bucket's chance load is a share of the mean number of
shingles of a document in 2**IDF_BITS, buckets do not fill up however many documents there are.

Texts that are equal are one text from here on, a node. Each node has HASHES consistent weighted samples,
in BANDS bands of ROWS; nodes that agree in a band meet. What is held against each other:

* in each meeting, the node with the smallest id against all others;
* in a meeting of more than HUB_FROM nodes that then still holds different groups, its hub against
  all others: copies that differ from a common original in places of their own resemble the original, not each other;
* in each meeting that still holds different groups, all nodes outside the largest group against
  every node, so no pair that met is left. Meetings of the same nodes are one.

Each comparison is the exact weighted Jaccard similarity of whole texts. Comparisons are made in
blocks of about 2 * BLOCK nodes, which are spread over all tasks, and a block gives only links that join its groups: no
pair that isn't a link leaves a task. The last step costs a meeting's nodes times those outside its largest group.
Links are closed to groups by spreading smallest nodes.

Null counts as the empty text; equal texts (also empty ones) are one group; texts without words
resemble no other text. A group's id is its smallest doc_id, null only if it has no other; of several
texts with that id the one with the smallest digest stays. Rows repeated with one doc_id and text stay or go
together; that holds for null ids, too. Ties between hubs go to the smallest node. An empty table
gives no rows. Other columns are never read, and keep_one returns them whatever their names.
A text is held whole in one task, as one row of its batch.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairstone.llm.runtime import apart, checkpointed, own_name, prepare, small_enough, texts

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
HASHES = BANDS * ROWS
#: Buckets of document frequencies, buckets of one row of the table on its way, and levels of the random variates.
IDF_BITS, IDF_ROW, LEVELS = 20, 4096, 1 << 16
#: Shingles sampled at once.
BATCH = 1 << 16
#: A shingle weighs 1 up to one document in RARE, and never less than LEAST.
RARE, LEAST = 64, 1 / 64
#: Nodes of about one side of a block; nodes from which a meeting has a hub; columns of shingles compared at once.
BLOCK, HUB_FROM, COLUMNS = 256, 256, 8_192

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: The base of the words' polynomial, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIERS[1])
#: What str.split() splits ASCII texts at.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


class _Powers:
    """Powers of a number modulo 2**64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            row = np.full(1 << n.bit_length(), self.base)
            row[0] = 1
            self.known = np.multiply.accumulate(row)
        return self.known[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in UTF-8: differences of one running polynomial, moved to a common place."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[raw], [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_OF_BYTE[raw] * _UP(len(raw)), out=upto[1:])
    return mix((upto[ends] - upto[starts]) * _DOWN(len(raw) + 1)[starts])


def shingle_runs(text: str) -> np.ndarray:
    """Hashes of the shingles of a whole text, in their order."""
    text = text.lower()
    if not text.isascii():
        text = " ".join(text.split())
    words = word_hashes(text.encode()) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    runs = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        runs += words[k : len(words) - width + 1 + k] * _MULTIPLIERS[k]
    return mix(runs)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, frequencies) of the shingles of a whole text."""
    runs = np.sort(shingle_runs(text))
    first = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1]))) if len(runs) else np.empty(0, np.int64)
    return runs[first], np.diff(np.append(first, len(runs)))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)


@functools.cache
def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) levels r, logarithms of Gamma(2, 1) levels c, and uniform levels beta, from a fixed seed."""
    random = np.random.default_rng(20100)
    return random.gamma(2.0, 1.0, LEVELS).astype(np.float32), np.log(random.gamma(2.0, 1.0, LEVELS)).astype(np.float32), random.random(LEVELS).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, one row of HASHES 32-bit values for each text; a text's shingles begin at its start.

    For shingle s and sample k, with r, c ~ Gamma(2, 1) and beta ~ U(0, 1) fixed by (s, k):
    t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1); the sample is (s, t) of the least a.
    Two texts' samples agree with the probability of their weighted Jaccard similarity.
    """
    r_of, c_of, beta_of = variates()
    log_w = np.log(weights).astype(np.float32)
    low = np.uint64(LEVELS - 1)
    size = np.diff(np.append(starts, len(hashes)))
    out = np.empty((HASHES, len(starts)), np.uint32)
    for k in range(HASHES):
        x = mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r, c, beta = r_of[x & low], c_of[x >> np.uint64(16) & low], beta_of[x >> np.uint64(32) & low]
        t = np.floor(log_w / r + beta)
        a = c - r * (t - beta + 1)
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == np.repeat(least, size))
        first = at[np.searchsorted(at, starts)]  # ties go to the smallest shingle
        out[k] = (mix(hashes[first] + np.uint64(k) + t[first].astype(np.int64).astype(np.uint64) * _MULTIPLIERS[0]) >> np.uint64(32)).astype(np.uint32)
    return out.T


def idf_table(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequencies of all buckets over all documents, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, slot, n = np.zeros(1 << IDF_BITS, np.uint32), np.zeros(1 << IDF_BITS, np.int32), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = bucket_of(shingle_runs(text))
                at = np.arange(len(found), dtype=np.int32)
                slot[found] = at  # the last of equal buckets stays, so each counts once
                seen[found[slot[found] == at]] += 1
            n += batch.num_rows
        rows = seen.reshape(-1, IDF_ROW)
        for i in np.flatnonzero(rows.any(1)):
            part = rows[i].astype(np.uint16) if rows[i].max() < 1 << 16 else rows[i]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([0], pa.int64())], names=["row", "seen", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([n], pa.int64())], names=["row", "seen", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            for row, seen in zip(batch.column("row").to_pylist(), batch.column("seen").to_pylist(), strict=True):
                if row >= 0:
                    sums.setdefault(row, np.zeros(IDF_ROW, np.int64))
                    sums[row] += np.frombuffer(seen, np.uint16 if len(seen) == 2 * IDF_ROW else np.uint32)
        for row, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([0], pa.int64())], names=["row", "seen", "n"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([n], pa.int64())], names=["row", "seen", "n"])

    schema = "row int, seen binary, n long"
    # One row for each IDF_ROW buckets: bounded by 2**IDF_BITS buckets, 8 MB.
    rows = docs.select("text").mapInArrow(count, schema).repartition("row").mapInArrow(add, schema).collect()
    table = np.zeros(1 << IDF_BITS, np.int64)
    for r in rows:
        if r.row >= 0:
            table[r.row * IDF_ROW : (r.row + 1) * IDF_ROW] += np.frombuffer(bytes(r.seen), np.int64)
    return table, sum(r.n for r in rows)


def idf_weights(table: np.ndarray, documents: int) -> np.ndarray:
    """The inverse document frequency of each bucket, by the share of documents alone (see above)."""
    own = np.maximum(table - table.mean(), 0)
    return np.clip(np.log((1 + documents) / (1 + own)) / np.log(RARE), LEAST, 1).astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater weights of two texts' shingles."""
    wa, wb = a[1] * idf[bucket_of(a[0])].astype(np.float64), b[1] * idf[bucket_of(b[0])].astype(np.float64)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(wa[i], wb[j]).sum()
    most = wa.sum() + wb.sum() - least
    return float(least / most) if most > 0 else 0.0


def sign(docs: DataFrame, idf) -> DataFrame:
    """doc_id, digest and samples (HASHES 32-bit values; null without words) of every row; idf: a broadcast of weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in batches:
            signed: list[bytes | None] = [None] * batch.num_rows
            waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush() -> None:
                if waiting:
                    hashes = np.concatenate([h for _, h, _ in waiting])
                    starts = np.cumsum([0, *(len(h) for _, h, _ in waiting)])[:-1]
                    found = samples(hashes, np.concatenate([n for _, _, n in waiting]) * weights[bucket_of(hashes)], starts)
                    for (i, _, _), row in zip(waiting, found, strict=True):
                        signed[i] = row.astype("<u4").tobytes()
                    waiting.clear()

            for i, text in enumerate(batch.column("text").to_pylist()):
                hashes, counts = shingles(text)
                if len(hashes):
                    waiting.append((i, hashes, counts))
                    if len(waiting) >= 64 or len(hashes) >= BATCH:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(signed, pa.binary())], names=["doc_id", "digest", "signature"])

    rows = texts(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    return rows.mapInArrow(run, "doc_id long, digest binary, signature binary")


def vectors(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, hashes and counts of the shingles of nodes(node, id): each text once, from the rows that have its smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x) for x in batch.column("text").to_pylist()]
            counts = [(n.astype(np.uint8) if n.max() < 256 else n.astype("<u4")).tobytes() for _, n in found]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array(counts, pa.binary())], names=["node", "hashes", "counts"])

    rows = texts(docs).withColumn("node", node_of(F.unhex(F.sha2("text", 256))))
    first = nodes.withColumnRenamed("node", "of").withColumnRenamed("id", "first")
    named = rows.join(small_enough(first), (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    return named.select("node", "text").mapInArrow(run, "node binary, hashes binary, counts binary").dropDuplicates(["node"])


def block_links(nodes: list[bytes], roots: list[bytes], sides: np.ndarray, hashes: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links of a block that join its groups: pairs of different roots that are similar enough.

    Nodes of side 2 are held against each other, those of side 0 against those of side 1. Texts whose total weights
    differ too much for the threshold are not compared: their similarity is at most the lesser over the greater.
    """
    n = len(nodes)
    every, owner = np.concatenate(hashes), np.repeat(np.arange(n), [len(h) for h in hashes])
    weight = np.concatenate(counts).astype(np.float64) * idf[bucket_of(every)]
    total = np.bincount(owner, weight, n)
    order = np.argsort(every, kind="stable")
    every = every[order]
    begins = np.concatenate(([True], every[1:] != every[:-1]))
    group = np.cumsum(begins) - 1
    shared = np.bincount(group)[group] > 1
    column = (np.cumsum(np.bincount(group) > 1) - 1)[group[shared]]  # ascending
    row, value = owner[order][shared], weight[order][shared]
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    root = np.array([number[r] for r in roots])
    wanted = (root[:, None] != root[None, :]) & (np.minimum.outer(total, total) >= THRESHOLD * np.maximum.outer(total, total))
    wanted &= ((sides[:, None] == 2) | (sides[:, None] != sides[None, :])) & np.triu(np.ones((n, n), bool), 1)
    if (wanted.any(1)).sum() > (wanted.any(0)).sum():
        wanted = wanted.T.copy()  # fewer nodes against more
    common = np.zeros((n, n))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        table = np.zeros((n, int(column[b - 1]) - low + 1))
        table[row[a:b], column[a:b] - low] = value[a:b]
        for i in np.flatnonzero(wanted.any(1)):
            at, others = np.flatnonzero(table[i]), np.flatnonzero(wanted[i])
            common[i, others] += np.minimum(table[np.ix_(others, at)], table[i, at]).sum(1)
    near = wanted & (common >= THRESHOLD * (total[:, None] + total[None, :] - common))
    out, parent = [], list(range(len(number)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = find(root[i]), find(root[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((nodes[i], nodes[j]))
    return out


def by_key(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """The rows of each key of a stream that is sorted by it."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = batch.column(name).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and keys[a] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def compare(blocks: DataFrame, vecs: DataFrame, idf) -> DataFrame:
    """Links (a, b) of blocks(block, node, root, side). Only the nodes' shingles are exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "block"):
            nodes, roots, hashes, counts = (table.column(c).to_pylist() for c in ("node", "root", "hashes", "counts"))
            links = block_links(
                nodes,
                roots,
                table.column("side").to_numpy(),
                [np.frombuffer(h, np.uint64) for h in hashes],
                [np.frombuffer(c, np.uint8 if 8 * len(c) == len(h) else "<u4") for c, h in zip(counts, hashes, strict=True)],
                idf.value,
            )
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], names=["a", "b"])

    rows = blocks.join(vecs.hint("merge"), "node").select("block", "node", "root", "side", "hashes", "counts")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes that have links; root is the smallest node of the connected group.

    Alternating star rounds: each node hangs its larger neighbours on the smallest node it sees,
    then its smaller ones. Rounds grow with the logarithm of the longest chain.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(apart("u").alias("key"), F.least("u", "m").alias("m"))
        large = both.withColumn("key", apart("u")).join(least.hint("merge"), "key").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.withColumn("key", apart("u")).join(least.select(apart("u").alias("key"), "m").hint("merge"), "key").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen


def node_of(digest: Column) -> Column:
    """The first half of a text's digest stands for the text."""
    return F.substring(digest, 1, 16)


def _meetings(nodes: DataFrame) -> DataFrame:
    """key, n, node, id, first: the members of each meeting of more than one node; first: the member with the smallest id."""
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", k * width + 1, width)) for k in range(BANDS)])
    members = nodes.where("signature IS NOT NULL").select(F.explode(keys).alias("key"), "node", "id")
    rank = F.struct(F.col("id").isNull(), "id", "node")
    met = members.groupBy("key").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").select(apart("key").alias("at"), "n", F.col("first.node").alias("first"))
    return checkpointed(members.withColumn("at", apart("key")).join(met.hint("merge"), "at").select("key", "n", "node", "id", "first"))


def _star_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks in which each center is held against its nodes: pairs(center, node), distinct."""
    pairs = checkpointed(pairs)
    sizes = pairs.groupBy("center").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = pairs.withColumn("at", apart("center")).join(sizes.select(apart("center").alias("at"), "parts").hint("merge"), "at").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    around = dealt.select(F.xxhash64("center", "part").alias("block"), "node", F.col("node").alias("root"), F.lit(1).alias("side"))
    centers = sizes.select("center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return around.unionByName(centers.select(F.xxhash64("center", "part").alias("block"), F.col("center").alias("node"), F.col("center").alias("root"), F.lit(0).alias("side")))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, n, main, outside, node, root of the meetings that hold several groups; outside: nodes that aren't in main, the largest one.

    Of meetings of the same nodes only one stays.
    """
    grouped = members.join(roots, "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("root"))
    sets = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"set{k}") for k in range(2)]
    per = grouped.groupBy("key", "n", "root").agg(F.count("*").alias("size"), *sets)
    mixed = per.groupBy("key", "n").agg(F.max(F.struct("size", "root")).alias("main"), F.count("*").alias("groups"), F.bit_xor("set0").alias("set0"), F.bit_xor("set1").alias("set1")).where("groups > 1")
    once = mixed.groupBy("n", "set0", "set1").agg(F.min(F.struct("key", "main")).alias("one"))
    chosen = once.select(F.struct("one.key").alias("at"), F.col("one.main.root").alias("main"), (F.col("n") - F.col("one.main.size")).alias("outside"))
    return checkpointed(grouped.withColumn("at", F.struct("key")).join(chosen.hint("merge"), "at").select("key", "n", "main", "outside", "node", "root"))


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of a meeting the member that has most of the part's commonest samples."""
    for table in by_key(batches, "block"):
        samples_of = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(table.num_rows, HASHES)
        commonest = [values[np.argmax(n)] for values, n in (np.unique(c, return_counts=True) for c in samples_of.T)]
        agreeing = (samples_of == commonest).sum(1)
        nodes = table.column("node").to_pylist()
        best = min(range(len(nodes)), key=lambda i: (-agreeing[i], nodes[i]))
        first = [pa.array([x], t) for x, t in ((table.column("key")[0].as_py(), pa.int64()), (-int(agreeing[best]), pa.int32()), (nodes[best], pa.binary()), (table.column("root")[best].as_py(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(first, names=["key", "rank", "node", "root"])


def _hub_pairs(opened: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (center, node) of the hubs of large open meetings with the members outside their groups."""
    large = opened.where(F.col("n") > HUB_FROM)
    block = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / (2 * BLOCK)).cast("int")))
    signed = large.join(nodes.select("node", "signature").hint("merge"), "node").select(block.alias("block"), "key", "node", "root", "signature")
    best = signed.repartition("block").sortWithinPartitions("block").mapInArrow(_hubs, "key long, rank int, node binary, root binary")
    hubs = best.groupBy("key").agg(F.min(F.struct("rank", "node", "root")).alias("hub")).select(apart("key").alias("at"), F.col("hub.node").alias("center"), F.col("hub.root").alias("of"))
    held = large.withColumn("at", apart("key")).join(hubs.hint("merge"), "at").where("root <> of")
    return held.select("center", "node").distinct()


def _open_blocks(opened: DataFrame) -> DataFrame:
    """Blocks in which the nodes outside an open meeting's largest group are held against all its nodes."""
    small, outer = F.col("n") <= BLOCK, F.col("root") != F.col("main")
    outside, inside = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("outside", "inside"))
    dealt = (
        opened.withColumn("inside", F.col("n") - F.col("outside"))
        .withColumn("parts", F.when(small, 1).otherwise(outside))
        .withColumn("all", F.when(small, 1).otherwise(outside + inside))
        .withColumn("part", F.when(small, 0).when(outer, F.pmod(F.xxhash64("node"), "parts")).otherwise(F.col("parts") + F.pmod(F.xxhash64("node"), F.col("all") - F.col("parts"))).cast("int"))
    )
    other = F.explode(F.sequence(F.lit(0), F.when(small | outer, F.col("all")).otherwise(F.col("parts")) - 1))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(low == high, 2).when(F.col("part") == low, 0).otherwise(1)
    return dealt.withColumn("other", other).select(F.xxhash64("key", low, high).alias("block"), "node", "root", side.alias("side"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, text_id (smallest id with the same text), group_id (smallest id of its group), kept."""
    return _grouped(docs).drop("digest")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which each group keeps the text with its smallest id."""
    at, of = own_name(docs, "_ps_id"), own_name(docs, "_ps_digest")
    gone = checkpointed(_grouped(docs).where(~F.col("kept")).select(F.col("doc_id").alias(at), F.col("digest").alias(of)).distinct())
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return docs.join(small_enough(gone), F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (digest == F.col(of)), "left_anti")


def _grouped(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    table, documents = idf_table(texts(docs))
    idf = spark.sparkContext.broadcast(idf_weights(table, documents))  # 2**IDF_BITS floats
    signed = checkpointed(sign(docs, idf))
    nodes = checkpointed(signed.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")).withColumn("node", node_of(F.col("digest"))))
    members = _meetings(nodes)
    vecs = checkpointed(vectors(docs, checkpointed(members.select("node", "id").distinct())))
    links = checkpointed(compare(_star_blocks(members.where("node <> first").select(F.col("first").alias("center"), "node").distinct()), vecs, idf))
    roots = components(links)
    opened = _open(members, roots)
    steps: list[Callable[[], DataFrame]] = [lambda: _star_blocks(_hub_pairs(opened, nodes)), lambda: _open_blocks(opened)]
    for step in steps if not opened.isEmpty() else []:
        if step is steps[0] and opened.where(F.col("n") > HUB_FROM).isEmpty():
            continue
        more = checkpointed(compare(step(), vecs, idf))
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
            opened = _open(members, roots) if step is steps[0] else opened
    grouped = nodes.join(roots, "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("first"))
    of_text = grouped.join(first, "root").select(apart("digest").alias("same"), F.col("id").alias("text_id"), F.col("first.id").alias("group_id"), (F.col("digest") == F.col("first.digest")).alias("stays"))
    kept = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("group_id"))
    return signed.select("doc_id", "digest", apart("digest").alias("same")).join(of_text.hint("merge"), "same").select("doc_id", "digest", "text_id", "group_id", kept.alias("kept"))
