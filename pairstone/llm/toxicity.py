"""Toxicity by multiple-instance learning: documents are bags of sentences, labels are known for bags only.

A sentence's probability is logistic in the features of its words (the word, and its first four
to seven letters, so that changed endings of a stem still count). A document is toxic if any of its sentences
is, independently: 1 - prod(1 - p), the noisy-or. The weights are trained from document labels
through that product. A sentence without known features keeps the small probability SENTENCE_PRIOR,
chosen so that a clean document of thousands of sentences stays far below any threshold.

Training uses at most SAMPLE labelled rows of each class, chosen by a hash of their ids, and keeps
at most FEATURES features; that bounds what is broadcast. Of several texts with a labelled id, the one with
the smallest hash is learnt from; texts that are equal count once for each label; labels given twice for an id count once, as the
larger one. Scoring reads every text whole.

Null and empty texts have one empty sentence; without labels of both classes every sentence keeps its prior.
Equal texts get equal scores, each row its own; doc_id may be null; an empty table gives no rows. Ties among features go to
the smaller string. Other columns, whatever their names, are not read. A very long text is scored whole by the task that holds it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairstone.llm.runtime import checkpointed, map_rows, prepare, texts

#: Bounds of the training sample for each class, and of the features.
SAMPLE, FEATURES = 3000, 20_000
#: Toxic documents of the sample that a feature needs.
LEAST_DOCUMENTS = 3
THRESHOLD, OFFENDING = 0.3, 0.5
SENTENCE_PRIOR = 1e-6
STEMS = (4, 5, 6, 7)
STEPS, RATE, DECAY = 60, 0.5, 1e-4
#: Smaller weights are dropped: many of them together are still far from what a sentence needs.
LEAST_WEIGHT = 1.5
MEMO = 300_000

_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")
_MARKS = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans that cover the text: each ends after its closing marks or line ends."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.end() > m.start()] or [(0, 0)]


def count_sentences(text: str) -> int:
    """len(sentences(text)), without the spans."""
    return len(_MARKS.findall(text)) + (text[-1:] not in tuple(".!?\n")) or 1


def word_features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in STEMS if len(word) >= n)]


def text_features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


@dataclass
class Model:
    weight: dict[str, float]
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"weight": self.weight, "memo": {}}

    def _word(self, token: str) -> float:
        """The strongest evidence among the words of a string between white space."""
        weight = self.weight
        return max((sum(weight.get(f, 0.0) for f in word_features(w)) for w in _WORD.findall(token)), default=0.0)

    def evidence(self, text: str) -> float:
        """The sum of the known words' weights, for the whole text: 0 if no word is known."""
        memo, total = self.memo, 0.0
        for token in set(text.lower().split()):
            found = memo.get(token)
            if found is None:
                found = memo[token] = self._word(token)
            total += abs(found)
        if len(memo) > MEMO:
            memo.clear()
        return total

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        base = math.log(SENTENCE_PRIOR / (1 - SENTENCE_PRIOR))
        out = []
        for a, b in sentences(text):
            words = {w for w in _WORD.findall(text[a:b].lower())}
            known = {f for w in words for f in word_features(w) if f in self.weight}
            z = base + sum(self.weight[f] for f in known)
            out.append((a, b, 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of a text's sentences, and the offending ones."""
        if not self.evidence(text):
            return -math.expm1(count_sentences(text) * math.log1p(-SENTENCE_PRIOR)), []
        scored = self.sentence_scores(text)
        clean = math.fsum(math.log1p(-min(p, 1 - 1e-12)) for _, _, p in scored)
        return -math.expm1(clean), [x for x in scored if x[2] >= OFFENDING]


#: A document of the sample: its label and, for each sentence with known features, their numbers.
Bag = tuple[int, list[list[int]]]


def lifts(counts: list[tuple[str, int, int]], good: int, bad: int) -> dict[str, float]:
    """The features that are commoner in toxic documents, by smoothed log ratio; the strongest by evidence. counts: feature, good and bad documents that have it."""
    lift = {f: math.log((b + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1)) for f, g, b in counts if b >= LEAST_DOCUMENTS}
    evidence = {f: b * lift[f] for f, _, b in counts if f in lift}
    return {f: lift[f] for f in sorted((f for f in lift if lift[f] > 1), key=lambda f: (-evidence[f], f))[:FEATURES]}


def bag_of(text: str, number: dict[str, int]) -> list[list[int]]:
    """The numbers of the known features of each sentence that has any."""
    found = (sorted({number[f] for w in set(_WORD.findall(text[a:b].lower())) for f in word_features(w) if f in number}) for a, b in sentences(text))
    return [x for x in found if x]


def train(bags: list[Bag], lift: dict[str, float], good: int, bad: int) -> Model:
    """Weights by gradient ascent on the noisy-or's likelihood; classes weigh the same."""
    chosen = [*lift]
    known = sorted(b for b in bags if b[1])
    if not known:
        return Model({})
    y_ = np.array([y for y, _ in known])
    bag_ = np.repeat(np.arange(len(known)), [len(x) for _, x in known])
    sizes = [len(s) for _, x in known for s in x]
    sentence_, feature_ = np.repeat(np.arange(len(sizes)), sizes), np.array([f for _, x in known for s in x for f in s])
    base = math.log(SENTENCE_PRIOR / (1 - SENTENCE_PRIOR))
    # Each bag's share of its class; a document without any known feature has no gradient.
    share = np.where(y_ == 1, 1 / bad, 1 / good)
    w = np.array([-base * 0.5 * min(1.0, lift[f] / 6) for f in chosen])
    square = np.zeros(len(w))
    for _ in range(STEPS):
        z = base + np.bincount(sentence_, w[feature_], len(bag_))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(bag_, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y_))
        toxic = np.clip(-np.expm1(clean), 1e-12, 1)
        # d log L / dz of a sentence: p * (1 - P) / P in a toxic bag, -p in a clean one.
        pull = np.where(y_ == 1, (1 - toxic) / toxic, -1.0) * share
        grad = np.bincount(feature_, (pull[bag_] * p)[sentence_], len(w)) - DECAY * w / len(w)
        square = 0.9 * square + 0.1 * grad * grad
        w += RATE * grad / (np.sqrt(square) + 1e-8)
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True) if abs(x) >= LEAST_WEIGHT})


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, sample: int = SAMPLE) -> Model:
    """The model from labels(doc_id, toxic) for which trainable holds, at most `sample` rows of each class.

    Texts stay on the executors: the driver gets counts of the features that can be chosen, then the sentences' feature numbers.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(trainable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    rows = [r for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    chosen = spark.createDataFrame([(r.doc_id, r.label) for r in rows], "doc_id long, label int")
    labelled = texts(docs).join(F.broadcast(chosen), "doc_id")  # bounded by 2 * sample
    one = labelled.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
    bags = checkpointed(one.select("label", F.col("one.text").alias("text")).distinct())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for y, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for f in text_features(text):
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["feature", "good", "bad"])

    size = {r.label: r["count"] for r in bags.groupBy("label").count().collect()}
    good, bad = size.get(0, 0), size.get(1, 0)
    if not good or not bad:
        return Model({})
    counted = bags.mapInArrow(features, "feature string, good long, bad long").groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ratio = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1))
    strongest = counted.where((F.col("bad") >= LEAST_DOCUMENTS) & (ratio > 2)).orderBy(F.desc(F.col("bad") * F.log(ratio)), "feature").limit(2 * FEATURES)
    lift = lifts([(r.feature, r.good, r.bad) for r in strongest.collect()], good, bad)
    number = {f: i for i, f in enumerate(lift)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag_of(x, number) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["label", "bag"])

    got = bags.mapInArrow(numbered, "label int, bag array<array<int>>").collect()
    return train([(r.label, [[*x] for x in r.bag]) for r in got], lift, good, bad)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, and the offending sentences as spans 'start:end' joined by commas."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def run(batch: list[str]) -> dict:
        found = [shared.value.score(x) for x in batch]
        return {
            "score": pa.array([s for s, _ in found], pa.float64()),
            "predicted": pa.array([int(s >= THRESHOLD) for s, _ in found], pa.int32()),
            "offending": pa.array([",".join(f"{a}:{b}" for a, b, _ in x) for _, x in found], pa.string()),
        }

    return map_rows(docs, run, "score double, predicted int, offending string")
