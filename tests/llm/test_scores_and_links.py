"""Quality, toxicity, personal data, near copies and the pipeline, against plain versions."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairstone.llm import bpe, cuckoo, icws, line_dedup, ogg, packing, pii, quality, queries, token_fst, toxicity

SF = "/root/testdata/sf0.1"


def accuracy(spark, df, label):
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("truth"))
    return df.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double"))).first()[0]


def test_quality_on_held_out_rows(spark):
    assert accuracy(spark, queries.op5_quality_knn(spark, SF), "quality") >= 0.97


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op6_toxicity_mil(spark, SF)
    assert accuracy(spark, rows, "toxic") >= 0.95


def test_words_make_vectors():
    """Texts of the same shapes and different words differ, as do two scripts."""
    texts = ["the quick brown fox jumps", "zqx wvv kjh ppp qqqq", "در این روز باران آمد", "今天 下雨 了 我们 回家"]
    vectors = quality.weighted(np.stack([quality.term_counts(x) for x in texts]), np.ones(quality.TERMS, np.float32))
    cosines = quality.unit(vectors) @ quality.unit(vectors).T
    assert (cosines[np.triu_indices(4, 1)] < 0.95).all()
    assert np.allclose(quality.term_counts("The fox"), quality.term_counts("The fox"))


def test_scores_like_plain_votes():
    """The fitted space and the votes, against the plain decomposition and a loop over neighbours."""
    rnd = np.random.default_rng(2)
    rows = (rnd.normal(size=(60, 8)) @ rnd.normal(size=(8, 90)) + 0.01 * rnd.normal(size=(60, 90))).astype(np.float32)
    found, want = quality.leading_directions(rows, 5), np.linalg.svd(rows)[2][:5].T
    assert np.allclose(found @ found.T, want @ want.T, atol=1e-2)
    texts = [f"word{i % 7} other{i % 5} {'!' * (i % 3)} end{i % 11}" for i in range(80)]
    terms = np.stack([quality.term_counts(x) for x in texts])
    model = quality.Model(np.ones(quality.TERMS, np.float32), quality.leading_directions(quality.weighted(terms, np.ones(quality.TERMS, np.float32)), 6), np.zeros((0, 1)), rnd.integers(0, 2, 80).astype(float), 0.5)
    model.vectors = model.project(terms)
    got = model.score(terms[:20])
    for i in range(20):
        cosines = model.vectors @ model.project(terms[i : i + 1])[0]
        near = sorted(range(80), key=lambda j: (-cosines[j], j))[: quality.K]
        ties = abs(np.sort(cosines)[::-1][quality.K - 1] - np.sort(cosines)[::-1][quality.K]) < 1e-6
        weights = [max(0.0, cosines[j]) for j in near]
        assert ties or got[i] == pytest.approx(sum(w * model.labels[j] for w, j in zip(weights, near, strict=True)) / sum(weights), abs=1e-5)


def test_neighbours_are_exact():
    rnd = np.random.default_rng(1)
    vectors = rnd.normal(size=(300, 4)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[50] = vectors[7]
    cos = vectors @ vectors.T
    got = np.sort(quality.Model._nearest(cos, 15), axis=1)
    for i in range(len(cos)):
        assert np.allclose(np.sort(cos[i][got[i]]), np.sort(cos[i])[-15:])


def test_scores_of_awkward_rows(spark, awkward, docs_of):
    labels = spark.createDataFrame([(3, 1, 0), (8, 0, 1), (9, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(awkward, labels, F.lit(True))
        rows = module.score_documents(awkward, model).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
        empty = module.fit(docs_of([]), labels.limit(0), F.lit(True))
        assert module.score_documents(awkward, empty).count() == 12
        assert module.score_documents(docs_of([]), model).collect() == []
    assert quality.keep_good(awkward, quality.fit(awkward, labels, F.lit(True))).columns == awkward.columns


def test_offending_sentences_are_located(spark, docs_of):
    bags = [("All is well here. Nothing to see.", 0), ("A calm day. Rain fell.", 0)] * 40 + [("All is well here. You zorgly zorg. Rain fell.", 1), ("A calm day. Zorgly zorg!", 1)] * 40
    rows = [(i, f"{t} w{i}") for i, (t, _) in enumerate(bags)]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(bags)], "doc_id long, toxic int")
    # Rows repeated, also with another text, and labels given twice change little or nothing.
    model = toxicity.fit(docs_of(rows + rows[:50]), labels.union(labels), F.lit(True))
    text = "Rain fell. Such a zorgly zorg it was. All is well."
    score, where = model.score(text)
    assert score > 0.9 and [text[a:b].strip() for a, b, _ in where] == ["Such a zorgly zorg it was."]
    assert model.score("Rain fell. " * 5000)[0] < 0.1


@pytest.mark.parametrize("text", ["", "a", "One. Two. Three. Four.", "...a", "a...", "\n", "x\n\ny!? z", "long " * 300 + ". b"])
def test_noisy_or_of_the_sentences_at_every_length(text):
    assert toxicity.count_sentences(text) == len(toxicity.sentences(text))
    want = 1.0
    for _, _, p in toxicity.Model({"=q": 2.0}).sentence_scores(text):
        want *= 1 - p
    assert toxicity.Model({"=q": 2.0}).score(text)[0] == pytest.approx(1 - want, rel=1e-3)


BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == 1 and any(int(x) > 255 for x in m.group().split("."))) or (kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits))) or (kind == 3 and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["a@.b-1 ", "@@a.", "0123456789 -", "1.25 ", "+1() .-9", "a@b.c1 2+-.0(9)"])
def test_base_spans(alphabet):
    rnd = random.Random(6)
    for _ in range(5000):
        text = "".join(rnd.choices(alphabet, k=rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)


def test_contexts_find_unseen_identifiers(spark, docs_of):
    good = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011111111111117"]
    rows = [(i, f"please charge my card number {n} today") for i, n in enumerate(good)] + [(50, "please charge my card number 4111111111111112 today"), (60, "build 123456789012345678 failed")]
    got = {r.doc_id: (r.n_card, r.spans, r.n_added) for r in pii.report(docs_of(rows)).collect()}
    assert got[0] == (1, "card:29:45", 0)
    assert got[50] == (0, "card:29:45", 1)
    assert got[60] == (0, "", 0)
    red = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs_of(rows)).collect()}
    assert red[50] == ("please charge my card number <CARD> today", 41)


def test_contexts_are_whole_words_however_long():
    long = "w" * 300
    one, two = (pii._context(f"{first} {long} 12345", len(first) + 302) for first in ("one", "two"))
    assert one[0] == two[0] == pii._hash(long) and one[1] != two[1]
    assert pii._context("   12345", 3) is None and pii._context("12345", 0) is None
    assert pii._context(f"number{' ' * 500}12345", 506) == (pii._hash("number"), pii._hash("^ number"))


def test_clashing_names(clashing):
    labels = clashing.sparkSession.createDataFrame([(3, 1, 0), (8, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    want = clashing.count()
    model = quality.fit(clashing, labels, F.lit(True))
    for stage in (line_dedup.strip_repeats, pii.redact, icws.keep_one, lambda d: quality.keep_good(d, model)):
        out = stage(clashing)
        assert out.columns == clashing.columns and 0 < out.count() <= want
    for rows in (line_dedup.report, pii.report, icws.near_groups, cuckoo.copies, ogg.media_report):
        assert rows(clashing).count() == want
    assert toxicity.score_documents(clashing, toxicity.fit(clashing, labels, F.lit(True))).count() == want
    word, byte = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert bpe.digest_documents(clashing, word).count() == token_fst.count_documents(clashing, byte, 9).count() == want
    assert packing.pack_documents(clashing, word).where("piece = 0").count() == want


def test_pii_of_awkward_rows(awkward, docs_of):
    assert pii.report(awkward).count() == 12
    assert pii.report(docs_of([])).collect() == []
    assert pii.redact(awkward).columns == awkward.columns and pii.redact(awkward).count() == 12


def test_samples_agree_as_weighted_jaccard_says():
    rnd = np.random.default_rng(3)
    agree, want = [], []
    for _ in range(150):
        n, shared = 60, rnd.integers(5, 60)
        h = np.sort(rnd.integers(0, 1 << 62, 2 * n - shared).astype(np.uint64))
        a, b = np.sort(h[rnd.permutation(len(h))[:n]]), None
        rest = np.setdiff1d(h, a)
        b = np.sort(np.concatenate((rest, a[: n - len(rest)])))
        wa = {int(x): float(rnd.integers(1, 30)) for x in a}
        wb = {int(x): wa.get(int(x), float(rnd.integers(1, 30))) for x in b}
        x = icws.samples(a, np.array([wa[int(i)] for i in a]), np.array([0]))[0]
        y = icws.samples(b, np.array([wb[int(i)] for i in b]), np.array([0]))[0]
        agree.append((x == y).mean())
        keys = set(wa) | set(wb)
        want.append(sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys))
    assert abs(np.mean(agree) - np.mean(want)) < 0.02
    heavy = np.arange(1, 202, dtype=np.uint64) * np.uint64(977)
    weights = np.ones(201)
    weights[100] = 200
    alone = icws.samples(heavy[100:101], weights[100:101], np.array([0]))[0]
    assert 0.25 < (icws.samples(heavy, weights, np.array([0]))[0] == alone).mean() < 0.75


def test_near_groups_like_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rnd = random.Random(2)
    base = rows[3][1].split()[:300]
    for i in range(30):  # copies that resemble the original more than each other
        words = base[:]
        for at in rnd.sample(range(len(words)), 5):
            words[at] = f"w{i}x{at}"
        rows.append((10_000 + i, " ".join(words)))
    rows.append((9_000, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    distinct = {}
    for doc_id, text in sorted(rows):
        distinct.setdefault(text, doc_id)
    vectors = {i: icws.shingles(t) for t, i in distinct.items()}
    table = np.zeros(1 << icws.IDF_BITS, np.int64)
    for _, text in rows:
        table[np.unique(icws.bucket_of(icws.shingles(text)[0]))] += 1
    idf = icws.idf_weights(table, len(rows))
    parent = {i: i for i in vectors}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(vectors)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if icws.weighted_jaccard(vectors[a], vectors[b], idf) >= icws.THRESHOLD:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.group_id for r in icws.near_groups(docs).collect()}
    assert got == {i: find(distinct[t]) for i, t in rows}


def test_near_groups_of_a_family_of_chains(spark):
    """Every text resembles only its neighbours in a chain, and all meet in large meetings whose hub resembles few.

    Other texts stand around, as the family's own shingles would else be common ones, of little weight.
    """
    base, rnd = [f"b{i}" for i in range(600)], random.Random(7)
    rows, others = [], [f"o{i} p{i} q{i} r{i} s{i}" for i in range(20_000)]
    for chain in range(12):
        for at in range(0, 528, 24):
            rows.append(" ".join(f"c{chain}x{i}" if at <= i < at + 70 else w for i, w in enumerate(base)))
    rnd.shuffle(rows)
    vectors = [icws.shingles(t) for t in rows]
    table = np.zeros(1 << icws.IDF_BITS, np.int64)
    for hashes in [h for h, _ in vectors] + [icws.shingles(t)[0] for t in others]:
        table[np.unique(icws.bucket_of(hashes))] += 1
    idf = icws.idf_weights(table, len(rows) + len(others))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if group[a] != group[b] and icws.weighted_jaccard(vectors[a], vectors[b], idf) >= icws.THRESHOLD:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert len(set(group)) == 12
    docs = spark.createDataFrame(list(enumerate(rows + others)), "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in icws.near_groups(docs).collect()} == dict(enumerate(group + [*range(len(rows), len(rows) + len(others))]))


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_blocks_like_pairs(n, monkeypatch):
    """All links of a block, whatever the columns compared at once, against single pairs."""
    monkeypatch.setattr(icws, "COLUMNS", 16)
    rnd = np.random.default_rng(n)
    idf = rnd.uniform(0.1, 1, 1 << icws.IDF_BITS).astype(np.float32)
    pool = np.sort(rnd.integers(0, 1 << 63, 60).astype(np.uint64))
    texts = []
    for _ in range(n):
        own = np.sort(rnd.permutation(60)[: rnd.integers(1, 60)]) if rnd.random() < 0.5 else np.arange(3, 55 + rnd.integers(0, 5))
        texts.append((pool[own], rnd.integers(1, 3, len(own)) if rnd.random() < 0.3 else np.ones(len(own), np.int64)))
    names = [bytes([i]) for i in range(n)]
    for sides in (np.full(n, 2), np.arange(n) % 2):
        got = icws.block_links(names, names, sides, [h for h, _ in texts], [c for _, c in texts], idf)
        parent = list(range(n))
        for pairs in (got, [(names[i], names[j]) for i in range(n) for j in range(i) if (sides[i] == 2 or sides[i] != sides[j]) and icws.weighted_jaccard(texts[i], texts[j], idf) >= icws.THRESHOLD]):
            parent = list(range(n))
            for a, b in pairs:
                low, high = sorted((parent[a[0]], parent[b[0]]))
                parent = [low if p == high else p for p in parent]
            found = parent if pairs is got else found
        assert found == parent
        assert len(got) == n - len(set(parent))


def test_near_groups_of_awkward_rows(awkward, docs_of):
    rows = icws.near_groups(awkward).collect()
    assert len(rows) == 12
    ids = {r.doc_id: r.group_id for r in rows if r.doc_id is not None}
    assert ids[1] == ids[2] == 1 and ids[4] == ids[5] == 4 and ids[3] == 3
    kept = icws.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 3, 4, 6, 7, 8, 9]
    assert icws.near_groups(docs_of([])).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = {r.doc_id: r.text for r in docs.collect()}
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in packed} == set(left)
    assert not any(pii.base_spans(t) for t in left.values())
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048
