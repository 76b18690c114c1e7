"""BPE, token counts and packing against the libraries, on fixed and generated texts."""

import hashlib
import os
import random
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer

from pairstone.llm import bpe, packing, token_fst

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the", "ing", "'s", "'ll", "'re", "'", " ", "  ", "\n", "\t", "é", "ß", "Σ", "İ", "中文", "🙂", "12", "7", "!?", "…", "<|endoftext|>", "<|startoftext|>", "<|", "\x00", "\x1c", "\xa0", "é", "X"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encodings_are_the_library_s(libraries, text):
    word, byte = libraries
    want = word.encode(text, add_special_tokens=False).ids
    coder = bpe.load(WORD)
    got = coder.encode(text)
    assert got.tolist() == want
    assert coder.decode(got) == word.decode(want, skip_special_tokens=False)
    assert packing.load(WORD).encode_bytes(text) == got.tobytes()
    assert token_fst.load(BYTE).count([text]) == [len(byte.encode(text, add_special_tokens=False).ids)]


def test_every_code_point_is_the_library_s(libraries):
    """Also those that this Python's Unicode database doesn't know."""
    coder, packer = bpe.load(WORD), packing.load(WORD)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c > 0xA000 and c < 0xAC00 or c > 0xD7A0)]
    for i in range(0, len(chars), 40):
        text = "".join(f"a{c}b C{c}{c} {c} " for c in chars[i : i + 40])
        assert coder.encode(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids
        assert packer.encode_bytes(text) == coder.encode_bytes(text)
    assert coder.encode_batch(pa.array(["", "a<|endoftext|>b", " x ", chars[5]]))[1].tolist() == libraries[0].encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_counts_do_not_depend_on_neighbours_or_chunks(libraries):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 400))) for _ in range(60)] + [" " * 1000, "a" * 3000, "'" * 500]
    counter = token_fst.load(BYTE)
    assert counter.count(texts) == [counter.count([t])[0] for t in texts]
    assert counter.count(texts) == [len(x.ids) for x in libraries[1].encode_batch(texts, add_special_tokens=False)]


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(token_fst, "MEMO_TRANSITIONS", 50)
    monkeypatch.setattr(token_fst, "MEMO_PIECES", 5)
    small = token_fst.CountTransducer(BYTE)
    texts = [f"word{i} other{i * 7}" for i in range(200)]
    assert small.count(texts) == token_fst.load(BYTE).count(texts)


def test_op1_rows(awkward, docs_of):
    rows = bpe.digest_documents(awkward, WORD).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_tokens == 0 and by_id[1].ids_sha256 == hashlib.sha256(b"").hexdigest() == by_id[2].decoded_sha256
    assert by_id[4][1:] == by_id[5][1:]
    assert bpe.digest_documents(docs_of([]), WORD).collect() == []


def test_op4_rows(awkward, docs_of):
    rows = token_fst.count_documents(awkward, BYTE, 1024).collect()
    assert len(rows) == 12
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert token_fst.count_documents(docs_of([]), BYTE, 1024).collect() == []


def plain_pack(lengths, capacity):
    """The same packing piece by piece: the fills of the sequences (of gaps that are equally tight, any may be taken)."""
    left = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    bins = []
    while left:
        first = left.pop(0)
        second = next((n for n in left if first + n <= capacity), None)
        if second is not None:
            left.remove(second)
        bins.append([first] if second is None else [first, second])
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fitting = [b for b in bins if sum(b) + n <= capacity]
        if fitting:
            max(fitting, key=sum).append(n)
        else:
            bins.append([n])
    return sorted(map(sum, bins))


def planned(lengths, capacity):
    plan = packing.Plan({n: lengths.count(n) for n in set(lengths)}, capacity)
    bins = {}
    for n, runs in plan.runs.items():
        ends = [r[0] for r in runs[1:]] + [lengths.count(n)]
        assert runs[0][0] == 0
        for (rank, sequence, offset, each), end in zip(runs, ends, strict=True):
            for k in range(end - rank):
                bins.setdefault(sequence + k // each, []).append((offset + k % each * n, n))
    assert sorted(bins) == list(range(plan.sequences))
    return bins


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120) | st.lists(st.sampled_from([1, 3, 5, 20, 21, 22, 32, 33, 64]), max_size=300))
def test_plans_are_gapless_and_pack_like_the_plain_packer(lengths):
    bins = planned(lengths, 64)
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
        assert sum(3 * n > 64 for _, n in parts) <= 2
    assert sorted(sum(n for _, n in parts) for parts in bins.values()) == plain_pack(lengths, 64)


def test_a_plan_of_huge_counts_is_small():
    rnd = random.Random(5)
    few = {n: rnd.randint(1, 9) for n in range(1, 2049)}
    many = {n: c * 10**9 for n, c in few.items()}
    plan = packing.Plan(many)
    assert sum(map(len, plan.runs.values())) < 100_000
    tokens = sum(n * c for n, c in many.items())
    assert plan.sequences < tokens / 2048 * 1.01


def test_packing_without_ids_over_many_tasks(spark, libraries):
    """Rows without ids and repeated rows, in more tasks than cores, are each in one place, as densely as in one task."""
    rnd = random.Random(11)
    texts = [" ".join(rnd.choices(["one", "two", "three"], k=rnd.choice([1, 30, 700, 900, 1400]))) for _ in range(300)]
    docs = spark.createDataFrame([(None if i % 3 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = packing.pack_documents(docs.repartition(11), WORD).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    lengths = [len(libraries[0].encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert sorted(sum(n for _, n in parts) for parts in bins.values()) == plain_pack(lengths, 2048)


def test_op8_rows(awkward, docs_of, libraries):
    rows = packing.pack_documents(awkward, WORD).collect()
    text = {r.doc_id: r.text for r in awkward.where("doc_id IS NOT NULL").collect()}
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, set()).add((r.piece, r.start, r.length, r.ids_crc32))
    for doc_id, t in text.items():
        ids = [*libraries[0].encode(t or "", add_special_tokens=False).ids, 0]
        want = set()
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.add((n, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
        assert pieces[doc_id] == want
    assert packing.pack_documents(docs_of([]), WORD).collect() == []
