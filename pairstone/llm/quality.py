"""Quality scores by nearest-neighbour voting in a latent-semantic space.

The terms of a text are its words (lower-cased, hashed to WORDS numbers), pairs of neighbouring character
shapes (runs of the same shape count once; punctuation marks are shapes of their own) and, by tenths, the share of its
words that repeat earlier ones. A term counts with the logarithm of its frequency in 10,000 and its inverse
document frequency; words and the other terms are two halves that are each brought to a length of their own, so that a
text of many rare words still has its shapes. The leading directions of the labelled sample's term matrix span the latent
space. Each text's cosines to all labelled vectors are computed exactly, in blocks; the K nearest
vote for their labels, weighted by similarity.

The model is fitted on at most SAMPLE labelled rows, chosen by a hash of their ids; that bounds
what is broadcast. Scoring reads every text whole. Null or empty texts, and all texts where there
are no labels, get the share of label 1 in the sample (0.5 without labels). Ties among neighbours
go to the earlier vector. Labels given twice for a doc_id count once, as the larger one; of several texts with
a labelled id, the one with the smallest hash is learnt from. Equal texts get equal scores, each row its own; doc_id may be null; an empty
table gives no rows. Other columns, whatever their names, are not read, and keep_good returns them as they are. A very long text is
read whole by the task that holds it, in memory proportional to its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairstone.llm.icws import word_hashes
from pairstone.llm.runtime import map_all, map_rows, prepare, texts

#: Bound of the labelled sample, latent dimensions, voting neighbours, documents in a block of products.
SAMPLE, DIMENSIONS, K, BLOCK = 4096, 24, 15, 256
THRESHOLD = 0.3

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
#: Shapes: lower case, upper case, digit, blank, line end, beyond ASCII, control, then each punctuation mark.
_SHAPES = 7 + len(_PUNCTUATION)
REPEAT_STEPS = 10
#: Terms: shapes and repeats first, then words. What the words' half weighs against the other; rounds and spare directions of the fit.
WORDS = 4096
FORMS = _SHAPES * _SHAPES + REPEAT_STEPS
TERMS = FORMS + WORDS
WORD_WEIGHT, ROUNDS, SPARE = 0.5, 8, 16


def _shape_table() -> np.ndarray:
    table = np.full(256, 6, np.int32)
    table[128:] = 5
    for first, last, shape in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 2)):
        table[ord(first) : ord(last) + 1] = shape
    table[[32, 9]], table[[10, 13]] = 3, 4
    table[_PUNCTUATION] = range(7, _SHAPES)
    return table


_SHAPE_OF = _shape_table()


def term_counts(text: str) -> np.ndarray:
    """The terms of one whole text, as log frequencies."""
    out = np.zeros(TERMS, np.float32)
    shapes = _SHAPE_OF[np.frombuffer(text.encode(), np.uint8)]
    if not len(shapes):
        return out
    shapes = shapes[np.concatenate(([True], shapes[1:] != shapes[:-1]))]
    pairs = np.bincount(shapes[:-1] * _SHAPES + shapes[1:], minlength=_SHAPES * _SHAPES)
    out[: len(pairs)] = np.log1p(pairs * (10_000 / max(1, len(shapes) - 1)))
    words = word_hashes(text.lower().encode())
    repeated = 1 - len(np.unique(words)) / len(words) if len(words) else 0.0
    out[len(pairs) + min(REPEAT_STEPS - 1, int(repeated * REPEAT_STEPS))] = np.log1p(10_000.0)
    found = np.bincount((words % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
    out[FORMS:] = np.log1p(found * (10_000 / max(1, len(words))))
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def weighted(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of terms by inverse document frequency, each half at its own length."""
    rows = terms * idf
    return np.concatenate((unit(rows[:, :FORMS]), WORD_WEIGHT * unit(rows[:, FORMS:])), axis=1)


def leading_directions(rows: np.ndarray, n: int) -> np.ndarray:
    """The n leading right singular vectors, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(5).normal(size=(rows.shape[1], min(n + SPARE, *rows.shape))).astype(np.float32)
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :n].astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled x dimensions, of unit length
    labels: np.ndarray
    prior: float

    def project(self, terms: np.ndarray) -> np.ndarray:
        return unit(weighted(terms, self.idf) @ self.basis)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Scores for a block of term vectors, by exact cosines to all labelled vectors."""
        if not len(self.labels):
            return np.full(len(terms), self.prior)
        cosines = self.project(terms) @ self.vectors.T
        k = min(K, len(self.labels))
        near = np.argsort(-cosines, axis=1, kind="stable")[:, :k] if cosines.shape[1] <= k else self._nearest(cosines, k)
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64)
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
        return np.where((total > 0) & terms.any(1), np.clip(vote, 0, 1), self.prior)

    @staticmethod
    def _nearest(cosines: np.ndarray, k: int) -> np.ndarray:
        """The k largest of each row; at the last place's value the earlier vector goes first."""
        edge = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
        order = np.where(cosines > edge, 2, cosines == edge)
        sure = np.cumsum(order == 1, axis=1)
        spare = k - (order == 2).sum(1, keepdims=True)
        chosen = (order == 2) | ((order == 1) & (sure <= spare))
        return np.nonzero(chosen)[1].reshape(len(cosines), k)


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, sample: int = SAMPLE) -> Model:
    """The model from at most `sample` rows of labels(doc_id, quality) for which trainable holds."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(trainable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # bounded by sample
    if not chosen:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    label_of = {r.doc_id: r.label for r in chosen}
    ids = spark.createDataFrame([(i,) for i in label_of], "doc_id long")
    picked = texts(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one")).select("doc_id", "one.text")

    def sparse(batch: list[str]) -> dict:
        found = [term_counts(x) for x in batch]
        at = [np.flatnonzero(x).astype(np.uint16) for x in found]
        return {"at": pa.array([x.tobytes() for x in at], pa.binary()), "size": pa.array([x[i].tobytes() for x, i in zip(found, at, strict=True)], pa.binary())}

    got = map_rows(picked, sparse, "at binary, size binary").collect()  # bounded by sample rows of TERMS at most
    rows = sorted((r.doc_id, bytes(r.at), bytes(r.size)) for r in got)
    prior = float(np.mean([label_of[i] for i in label_of]))
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    matrix = np.zeros((len(rows), TERMS), np.float32)
    seen = np.zeros(TERMS, np.int64)
    for row, (_, at, size) in zip(matrix, rows, strict=True):
        places = np.frombuffer(at, np.uint16)
        row[places] = np.frombuffer(size, np.float32)
        seen[places] += 1
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    for i in range(0, len(rows), BLOCK):  # in place: the driver holds the sample's matrix once
        matrix[i : i + BLOCK] = weighted(matrix[i : i + BLOCK], idf)
    basis = leading_directions(matrix, DIMENSIONS)
    return Model(idf, basis, unit(matrix @ basis), np.array([label_of[i] for i, _, _ in rows], np.float64), prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE, TERMS and DIMENSIONS

    def run(batch: list[str]) -> dict:
        found = shared.value
        parts = [found.score(np.stack([term_counts(x) for x in batch[i : i + BLOCK]])) for i in range(0, len(batch), BLOCK)]
        scores = np.concatenate(parts) if parts else np.zeros(0)
        return {"score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())}

    return map_rows(docs, run, "score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text the model doesn't reject. Texts are scored where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    prepare(docs.sparkSession)
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        found = shared.value
        for batch in batches:
            rows = ["" if x is None else x for x in batch.column(at).to_pylist()]
            keep = [found.score(np.stack([term_counts(x) for x in rows[i : i + BLOCK]])) >= THRESHOLD for i in range(0, len(rows), BLOCK)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return map_all(docs, run, docs)
