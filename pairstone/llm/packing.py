"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are cut into pieces of CAPACITY tokens where they are longer; whole pieces are sequences
by themselves. Of the rest, pieces above a third of the capacity go first, the longest with the longest
that still fits, so that at most two of them meet; the smaller ones, from the longest on, go where the
remaining gap is tightest.

Only lengths matter to that, and there are at most CAPACITY of them. So the table is packed as a whole,
however large it is: Spark counts the pieces of each length, the driver matches and fits whole runs of equal
lengths at once (a plan: runs of sequences with places for pieces of a length), and each piece, by its rank among
the pieces of its length, finds its place in the plan. The plan gives what packing piece by piece would
give; it has at most a few runs for each pair of lengths, whatever their counts.

A null or empty text is one piece that holds the closing id alone. Rows repeated with the same
doc_id or without one are packed each, by where they are stored. Which of several pieces of equal length goes
where is open. An empty table gives no rows. Other columns, whatever their names, are not read. A very long
text is encoded whole by the one task that holds it; its pieces are spread like all others.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairstone.llm.bpe import WordEncoder, byte_alphabet
from pairstone.llm.runtime import apart, checkpointed, prepare, texts

CAPACITY = 2048
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class LibraryEncoder(WordEncoder):
    """Ids by the library's merges, which see each string between white space once while it is remembered."""

    #: About 150 MB in a worker.
    memo_words = 600_000

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.library.model
        self.shown = dict(enumerate(byte_alphabet()))

    def encode_word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):  # else each byte stands for itself
            word = word.encode().decode("latin-1").translate(self.shown)
        return array("I", [x.id for x in self.model.tokenize(word)]).tobytes()


@functools.cache
def load(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def cut_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The pieces of each document, without their ids; task and nth number the pieces of a length."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = load(vocabulary), np.array([END_ID], "<u4")
        task, counted = TaskContext.get().partitionId(), np.zeros(CAPACITY + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_batch(batch.column("text")), strict=True):
                ids = np.append(ids, closing)
                for piece, at in enumerate(range(0, len(ids), CAPACITY)):
                    part = ids[at : at + CAPACITY]
                    rows.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes()), task, counted[len(part)]))
                    counted[len(part)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return texts(docs).mapInArrow(run, f"{PIECES}, task int, nth long")


def _at_most(mask: int, size: int) -> int:
    """The highest set bit of mask at or below size, or -1."""
    return (mask & ((2 << size) - 1)).bit_length() - 1 if size >= 0 else -1


def _at_least(mask: int, size: int) -> int:
    """The lowest set bit of mask at or above size, or -1."""
    high = mask >> size
    return size + (high & -high).bit_length() - 1 if high else -1


#: A run of a plan: from this rank on among the pieces of a length, `each` pieces go in every sequence, the first of
#: them in `sequence` at `offset`. Without a length: the sequences so far, and their runs by the gap that is left.
Run = tuple[int, int, int, int]


class Plan:
    """Places for pieces, by length, from how many there are of each."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[Run]] = {}
        self._placed: dict[int, int] = {}
        #: Runs (first sequence, number) of sequences by gap, and the gaps there are as bits.
        self._open: dict[int, list[tuple[int, int]]] = {}
        self._gaps = 0
        self._match({n: c for n, c in counts.items() if c and 3 * n > capacity})
        for length in sorted((n for n, c in counts.items() if c and 3 * n <= capacity), reverse=True):
            self._fit(length, counts[length])

    def _new(self, number: int) -> int:
        self.sequences += number
        return self.sequences - number

    def _place(self, length: int, sequence: int, offset: int, number: int, each: int = 1) -> None:
        """The next number pieces of a length, each of them in one sequence."""
        rank = self._placed.get(length, 0)
        self.runs.setdefault(length, []).append((rank, sequence, offset, each))
        self._placed[length] = rank + number

    def _leave(self, gap: int, sequence: int, number: int) -> None:
        if gap and number:
            self._open.setdefault(gap, []).append((sequence, number))
            self._gaps |= 1 << gap

    def _match(self, counts: dict[int, int]) -> None:
        """Large pieces: the longest with the longest that still fits beside it."""
        left = dict(counts)
        lengths = sum(1 << n for n in left)
        while lengths:
            first = lengths.bit_length() - 1
            second = _at_most(lengths, self.capacity - first)
            if second == first:
                number = left[first] // 2
            else:
                number = left[first] if second < 0 else min(left[first], left[second])
            if number == 0:  # one of a length alone: its partner is shorter, if there is one
                second, number = _at_most(lengths ^ 1 << first, self.capacity - first), 1
            sequence = self._new(number)
            self._place(first, sequence, 0, number)
            if second >= 0:
                self._place(second, sequence, first, number)
            self._leave(self.capacity - first - max(second, 0), sequence, number)
            for length in (first, *([second] if second >= 0 else [])):
                left[length] -= number
                if not left[length]:
                    lengths &= ~(1 << length)

    def _fit(self, length: int, count: int) -> None:
        """Pieces of one small length, where the gap is tightest; new sequences where there is none."""
        while count:
            gap = _at_least(self._gaps, length)
            if gap < 0:
                gap, number = self.capacity, -(-count // (self.capacity // length))
                sequence = self._new(number)
            else:
                sequence, number = self._open[gap].pop()
                if not self._open[gap]:
                    self._gaps ^= 1 << gap
            each = min(gap // length, count)
            used = min(number, count // each)
            if used:
                self._place(length, sequence, self.capacity - gap, used * each, each)
                count -= used * each
                self._leave(gap - each * length, sequence, used)
            self._leave(gap, sequence + used, number - used)


def _at_rank(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    return {length: tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) for length, runs in plan.runs.items()}


def pack_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each piece, with its sequence and its place there."""
    spark = docs.sparkSession
    pieces = checkpointed(cut_pieces(docs, vocabulary))
    by_task = checkpointed(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most CAPACITY rows
    plan = spark.sparkContext.broadcast(_at_rank(Plan(counts)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_task.select(apart("task", "length").alias("at"), before.alias("before"))
    ranked = pieces.withColumn("at", apart("task", "length")).join(offsets.hint("merge"), "at").withColumn("rank", F.col("before") + F.col("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, start, place, each = runs[n]
                k = np.searchsorted(first, rank[at], "right") - 1
                within = rank[at] - first[k]
                sequence[at] = start[k] + within // each[k]
                offset[at] = place[k] + within % each[k] * n
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PACKED)
