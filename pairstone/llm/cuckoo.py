"""Exact dedup with a cuckoo-filter index over content digests.

Each task folds its own rows into an index first, so that a digest leaves a task once however
many copies there are (a hot group is gone before the shuffle). The partial entries are dealt
out by digest, and one index for each share merges them: the row with the largest doc_id of each
group stays. The groups are then joined back to all rows; that join has a hot key where a group
is large, and both its sides are plain exchanges, which AQE splits.

Texts are equal if their UTF-8 bytes are; the content kept in a bucket is the SHA-256 digest with
the length in bytes. Null counts as the empty text. A null doc_id never stays where its group has
another row; rows repeated with the same doc_id (a tie) all stay or all go. An empty table gives no rows. Other columns,
whatever their names, are not read. Of a text, however long, only the digest and the length leave the scan.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairstone.llm.runtime import prepare, texts

SLOTS, MOST_MOVES = 4, 200


class CuckooIndex:
    """Entries by key (bytes, well mixed): a cuckoo filter in front, and the keys themselves by bucket.

    A key has two buckets, i and i xor hash(fingerprint), so a fingerprint can move without its
    key. A hit in the filter is verified against the keys of the home bucket. Where an insertion
    finds no room after MOST_MOVES moves, the filter doubles and is filled again from the keys.
    """

    def __init__(self, buckets: int = 256):
        self.size = 0
        self._make(buckets)
        self.content: list[dict[bytes, list]] = [{} for _ in range(buckets)]

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = array("H", bytes(2 * SLOTS * buckets))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[8:10], "little") or 1
        home = int.from_bytes(key[:8], "little") & self.mask
        return print_, home, home ^ (print_ * 0x5BD1E995 >> 7 & self.mask)

    def _slot_with(self, bucket: int, print_: int) -> int:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.slots[i] == print_:
                return i
        return -1

    def may_contain(self, key: bytes) -> bool:
        """The filter's answer: no false negatives."""
        print_, home, other = self._places(key)
        return self._slot_with(home, print_) >= 0 or self._slot_with(other, print_) >= 0

    def get(self, key: bytes) -> list | None:
        """The live entry of a key; a hit in the filter is verified against the bucket's keys."""
        if not self.may_contain(key):
            return None
        return self.content[int.from_bytes(key[:8], "little") & self.mask].get(key)

    def insert(self, key: bytes, entry: list) -> None:
        """Add a key that is not live."""
        self.content[int.from_bytes(key[:8], "little") & self.mask][key] = entry
        self.size += 1
        if not self._place(key):
            self._grow()

    def _place(self, key: bytes) -> bool:
        print_, home, other = self._places(key)
        for bucket in (home, other):
            free = self._slot_with(bucket, 0)
            if free >= 0:
                self.slots[free] = print_
                return True
        bucket = other
        for move in range(MOST_MOVES):
            i = bucket * SLOTS + move % SLOTS
            self.slots[i], print_ = print_, self.slots[i]
            bucket ^= print_ * 0x5BD1E995 >> 7 & self.mask
            free = self._slot_with(bucket, 0)
            if free >= 0:
                self.slots[free] = print_
                return True
        return False

    def _grow(self) -> None:
        """Double the filter until the stored keys fit; the print that fell out comes back from its key."""
        entries = [x for bucket in self.content for x in bucket.items()]
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._make(buckets)
            if all(self._place(key) for key, _ in entries):
                break
        self.content = [{} for _ in range(buckets)]
        for key, entry in entries:
            self.content[int.from_bytes(key[:8], "little") & self.mask][key] = entry

    def delete(self, key: bytes) -> bool:
        """Remove a live key; False if it is not live (nothing is touched then)."""
        if self.get(key) is None:
            return False
        print_, home, other = self._places(key)
        i = self._slot_with(home, print_)
        self.slots[i if i >= 0 else self._slot_with(other, print_)] = 0
        del self.content[home][key]
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, list]]:
        return (x for bucket in self.content for x in bucket.items())


#: Entries that an index emits in one batch.
OUT_ROWS = 8192


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, keep_id, group_size) rows in, one row for each digest out."""
    index = CuckooIndex()
    for batch in batches:
        for digest, doc_id, count in zip(*(batch.column(c).to_pylist() for c in ("digest", "keep_id", "group_size")), strict=True):
            live = index.get(digest)
            if live is None:
                index.insert(digest, [doc_id, count])
            else:
                live[1] += count
                if live[0] is None or (doc_id is not None and doc_id > live[0]):
                    live[0] = doc_id
    out = [(key, *entry) for key, entry in index.items()]
    for i in range(0, len(out), OUT_ROWS):
        part = out[i : i + OUT_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.binary()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())], names=["digest", "keep_id", "group_size"])


def copies(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    prepare(spark)
    rows = texts(docs).select("doc_id", F.concat(F.unhex(F.sha2("text", 256)), F.unhex(F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0"))).alias("digest"))
    schema = "digest binary, keep_id long, group_size long"
    partial = rows.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInArrow(fold, schema)
    groups = partial.repartition(F.col("digest")).mapInArrow(fold, schema)
    joined = rows.join(groups.hint("merge"), "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"))
