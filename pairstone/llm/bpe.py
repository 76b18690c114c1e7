"""Exact BPE by backtracking over longest matches, and decoding by offset tables.

A sequence of tokens is the result of the merges exactly if each neighbouring pair is
*compatible*: merging the concatenation of the two gives the two back. So the encoder walks
the text with the longest token at each place (all matches come from one Aho-Corasick pass),
keeps it if it is compatible with the token before, tries shorter ones otherwise, and goes
back where none is left. A place that was given up is never entered again, which makes the
walk linear in the text.

Null and empty texts give no tokens, an empty table no rows. Repeated rows and texts give equal results, each its
own row; doc_id may be null. There are no ties: the merges' ranks differ. Other columns, whatever their names,
are not read. A very long text is encoded whole by the one task that holds it, in memory proportional to its length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pairstone.llm.chars import LETTER, NUMBER, SPACE, ranges_of, unassigned
from pairstone.llm.runtime import map_column

#: Words and token pairs that one worker remembers; beyond that the memory starts anew.
MEMO_WORDS, MEMO_PAIRS = 500_000, 1_000_000
END = "</w>"
_END_SHIFT = 0x1000


@functools.cache
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in chars:
            chars[b], spare = chr(spare), spare + 1
    return [chars[b] for b in range(256)]


class PairTable:
    """Which tokens may stand side by side; answers are computed once and remembered.

    Ids must rise with the merges' ranks. To test (a, b), the merges that made a and b are
    undone from the latest on, at the seam; the pair is refused as soon as a merge across the
    seam would have come earlier than the one undone.
    """

    def __init__(self, merged: dict[tuple[int, int], int]):
        self.merged = {a << 20 | b: c for (a, b), c in merged.items()}
        self.parts = {c: pair for pair, c in merged.items()}
        self.known: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= MEMO_PAIRS:
                self.known.clear()
            found = self.known[key] = self._test(a, b)
        return found

    def _test(self, a: int, b: int) -> bool:
        merged, parts = self.merged, self.parts
        limit = 1 << 40  # rank of the merge that is undone next, exclusive
        while True:
            if merged.get(a << 20 | b, limit) < limit:
                return False
            # Undo whichever of the two was merged later; on equal rank the left one came first in the text.
            pa_, pb = parts.get(a), parts.get(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or (pa_ is not None and a > b):
                limit, a = a, pa_[1]
            else:
                limit, b = b + 1, pb[0]


class OffsetTable:
    """Byte strings by number, laid end to end; a sequence of numbers is gathered in one step."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.length = np.array([len(x) for x in entries], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]

    def gather(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        length = self.length[ids]
        before = np.cumsum(length) - length
        at = np.arange(int(length.sum())) + np.repeat(self.start[ids] - before, length)
        return self.data[at].tobytes()


class WordEncoder:
    """Encodes texts as a lower-casing vocabulary with word ends does (a tokenizers .json file).

    No token crosses white space, so a batch of texts is split at it, each different string of the batch is
    encoded once while it is remembered, and the ids are gathered by offsets. A string is lower-cased and split to
    words by the vocabulary's pattern; how a word becomes ids is up to the subclass. Strings with
    code points that this Python doesn't know are lower-cased and split by the library, which may know them.
    """

    memo_words = MEMO_WORDS

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        letter, number, space = map(ranges_of, (LETTER, NUMBER, SPACE))
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
        self.unknown = re.compile(f"[{unassigned()}]")
        self.byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.memo: dict[str, bytes] = {}

    def encode_word(self, word: str) -> bytes:
        """Little-endian 32-bit ids of one word that the pattern gave."""
        raise NotImplementedError

    def _words(self, chunk: str) -> list[str]:
        if not chunk.isascii():
            if not chunk.isprintable() and self.unknown.search(chunk):
                found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
                return [bytes(map(self.byte_of.__getitem__, x)).decode() for x, _ in found]
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # lower() would else see word ends
        return self.words.findall(chunk.lower())

    def _encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.encode_word, self._words(chunk)))

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of each string. Strings that are new are remembered; a full memory starts anew."""
        memo = self.memo
        found = [*map(memo.get, chunks)]
        if None in found:
            if len(memo) > self.memo_words:
                memo.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[i]
                    found[i] = memo[chunk] = self._encode_chunk(chunk)
        return found

    def encode_bytes(self, text: str | None) -> bytes:
        """All ids of a text; the strings of special tokens become their ids, as the library does by default."""
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else b"".join(self._known(x.split(" "))) for x in self.splitter.split(text or ""))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow column without nulls."""
        special = pc.match_substring(texts, "<|")
        lists = pc.ascii_split_whitespace(pc.if_else(special, "", texts))
        strings = lists.flatten().dictionary_encode()
        at = strings.indices.to_numpy()
        known = self._known(strings.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        offsets = np.concatenate(([0], np.cumsum(size)))
        of_string = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(known), "<u4")))
        ids = of_string.take(strings.indices).flatten().to_numpy()
        upto = np.concatenate(([0], np.cumsum(size[at])))
        bounds = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out = np.split(ids, bounds[1:-1])
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
            out[i] = self.encode(texts[i].as_py())
        return out


class WordBpe(WordEncoder):
    """The encoder by backtracking, and the decoder."""

    def __init__(self, path: str):
        super().__init__(path)
        spec = self.spec
        vocab = spec["model"]["vocab"]
        names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name
        merged: dict[tuple[int, int], int] = {}
        for a, b in (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]):
            merged.setdefault((vocab[a], vocab[b]), vocab[a + b])
        self.pairs = PairTable(merged)
        byte_of = {c: chr(b) for b, c in enumerate(byte_alphabet())}
        symbols = {}
        for name, i in vocab.items():
            word = "".join(map(byte_of.__getitem__, name.removesuffix(END)))
            symbols[word if word and not name.endswith(END) else word[:-1] + chr(ord(word[-1]) + _END_SHIFT)] = i
        self.finder = ahocorasick.Automaton()
        #: By token: symbols in it, and the longest token that is a proper prefix of it, or -1.
        self.length, self.shorter = [0] * len(names), [-1] * len(names)
        for word, i in symbols.items():
            self.finder.add_word(word, i)
            self.length[i] = len(word)
            self.shorter[i] = next((symbols[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in symbols), -1)
        self.finder.make_automaton()
        self.names = OffsetTable([f"{x} ".encode() for x in names])
        self.digits = OffsetTable([f"{i} ".encode() for i in range(len(names))])
        self.word_memo: dict[str, bytes] = {}

    def encode_symbols(self, symbols: str) -> list[int]:
        """The tokens of one word whose last symbol is a word end."""
        size, length, shorter, known, compatible = len(symbols), self.length, self.shorter, self.pairs.known, self.pairs.compatible
        longest = [-1] * size
        for end, token in self.finder.iter(symbols):  # of the matches from one place the longest comes last
            longest[end - length[token] + 1] = token
        taken: list[int] = []
        dead = bytearray(size + 1)
        at, before, token = 0, -1, longest[0]
        while True:
            end = at + length[token]
            if not dead[end] and (before < 0 or known.get(before << 20 | token) or compatible(before, token)):
                taken.append(token)
                if end == size:
                    return taken
                at, before, token = end, token, longest[end]
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token = taken.pop()  # IndexError: a symbol is not in the vocabulary
                at -= length[token]
                before = taken[-1] if taken else -1
                token = shorter[token]

    def encode_word(self, word: str) -> bytes:
        memo = self.word_memo
        ids = memo.get(word)
        if ids is None:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            symbols = word if word.isascii() else word.encode().decode("latin-1")
            ids = memo[word] = array("I", self.encode_symbols(symbols[:-1] + chr(ord(symbols[-1]) + _END_SHIFT))).tobytes()
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The names of the tokens with spaces between: the file names no decoder that would join them."""
        return self.names.gather(ids)[:-1].decode()


@functools.cache
def load(path: str) -> WordBpe:
    """One encoder for each worker."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of each document."""

    def run(batch: pa.Array) -> dict:
        bpe = load(vocabulary)
        ids = bpe.encode_batch(batch)
        return {"ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), "decoded": pa.array([bpe.decode(x) for x in ids], pa.string())}

    return map_column(docs, run, "ids array<int>, decoded string")


def digest_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode each document in its worker and keep digests only, so that ids never leave it."""

    def run(batch: pa.Array) -> dict:
        bpe = load(vocabulary)
        count, ids_sha, text_sha = [], [], []
        for ids in bpe.encode_batch(batch):
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(bpe.digits.gather(ids)[:-1]).hexdigest())
            text_sha.append(hashlib.sha256(bpe.names.gather(ids)[:-1]).hexdigest())
        return {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return map_column(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
