"""Ogg containers, the cuckoo index, exact copies, repeated lines."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairstone.llm import cuckoo, line_dedup, ogg


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=200))
def test_page_crc(data):
    assert ogg.page_crc(data) == slow_crc(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=4))
def test_packets_survive(sizes):
    packets = [(bytes([i % 251]) * n, i) for i, n in enumerate(sizes)]
    data = b"".join(ogg._stream(9, packets))
    assert ogg.read(data)[9].packets == [p for p, _ in packets]


@pytest.mark.parametrize("text", ["", "a", "x" * 64, "y" * 4096, "z" * 65_025, "é" * 90_000])
def test_round_trip(text):
    media = ogg.store_text(text)
    payload, n, sound = ogg.payload_of(media)
    raw = text.encode()
    assert n == len(raw) and payload == ogg.pad(raw) and len(payload) % 64 == 0 and payload
    assert sound.times[-1] == len(payload) / ogg.RATE


def test_damage_is_found():
    media = bytearray(ogg.store_text("some text " * 50))
    for at in (5, 30, 60, len(media) - 1):
        bad = bytes(media[:at]) + bytes([media[at] ^ 1]) + bytes(media[at + 1 :])
        with pytest.raises((ValueError, KeyError)):
            ogg.payload_of(bad)
    with pytest.raises(ValueError):
        ogg.read(bytes(media[:-3]))


def test_op2_rows(awkward, docs_of):
    rows = ogg.media_report(awkward).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].payload_bytes == 64 and by_id[1].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and by_id[1].tail_crc32 == zlib.crc32(bytes(64))
    assert by_id[4][1:] == by_id[5][1:]
    assert ogg.media_report(docs_of([])).collect() == []


def test_cuckoo_index_follows_a_dict():
    rnd = random.Random(4)
    index, live = cuckoo.CuckooIndex(2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(12_000):
        key = rnd.choice(keys)
        if key in live and rnd.random() < 0.5:
            assert index.delete(key)
            del live[key]
        elif key not in live:
            live[key] = [rnd.random()]
            index.insert(key, live[key])
        assert index.get(key) == live.get(key)
    assert dict(index.items()) == live and index.size == len(live)
    assert all(index.may_contain(k) for k in live)
    assert not index.delete(b"\0" * 32)


def test_op3_rows(awkward, docs_of):
    rows = {(r.doc_id, r.text_sha256): r for r in cuckoo.copies(awkward).collect()}
    abc = hashlib.sha256(b"a b c").hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    assert (rows[3, abc].keep_id, rows[3, abc].group_size, rows[3, abc].kept) == (3, 3, True)
    assert not rows[None, abc].kept
    assert (rows[1, none].keep_id, rows[1, none].group_size, rows[1, none].kept, rows[2, none].kept) == (2, 3, False, True)
    assert cuckoo.copies(awkward).count() == 12
    assert cuckoo.copies(docs_of([])).collect() == []


def plain_lines(docs):
    """Windows of three lines with a word; all but the first occurrence by (doc_id, place) cover their lines."""
    seen, gone = set(), {}
    for doc_id, text in sorted(docs):
        lines = (text or "").split("\n")
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not any(x.strip() for x in w):
                continue
            if w in seen:
                gone.setdefault(doc_id, set()).update((i, i + 1, i + 2))
            seen.add(w)
    return gone


def test_lines_like_the_plain_version(docs_of):
    rnd = random.Random(8)
    docs = [(i, "\n".join(rnd.choice(["a", "b", "", "c"]) for _ in range(rnd.randint(0, 9)))) for i in range(120)]
    want = plain_lines(docs)
    for r in line_dedup.report(docs_of(docs)).collect():
        assert r.removed == ",".join(map(str, sorted(want.get(r.doc_id, ()))))
        lines = dict(docs)[r.doc_id].split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in want.get(r.doc_id, ()))
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_lines_of_awkward_rows(awkward, docs_of):
    rows = line_dedup.report(awkward).collect()
    assert len(rows) == 12
    assert {r.doc_id: r.removed for r in rows}[9] == "1,2,3"
    kept = line_dedup.strip_repeats(awkward)
    assert kept.columns == awkward.columns and kept.count() == 12
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}[9] == ("zero", 4)
    assert line_dedup.strip_repeats(docs_of([])).collect() == []
