"""Token counts by finite-state transducers.

Two deterministic machines in a row count the tokens of a byte-level BPE vocabulary.

*Splitter.* Eight states over eight character classes; a transition says whether a piece begins
at the character. Texts are cut into chunks of equal length; for each chunk the map from each
entry state to its exit state is computed, for all chunks and states at once. The maps compose
associatively, so a parallel prefix scan (doubling strides) gives each chunk its entry state,
and a second pass gives the places where pieces begin.

*Counter.* A transducer over bytes, compiled on demand. After a prefix of a piece, a place is
*live* if a token that began there may still end later; what counts at a live place is the trie
node of what was read since, the token before it, and how many tokens there are before it,
relative to the least of the live places. Such sets are the states; the change of the least
count is the number of tokens that a transition emits, the rest comes out at the end of the piece.

Null and empty texts have no tokens. Strings of special tokens inside a text count as that one
token, the library's default. Repeated rows and texts give equal results, each its own row; doc_id may be null; an empty
table gives no rows. There are no ties: the merges' ranks differ. Other columns, whatever their names, are not read. A very
long text is counted whole by the task that holds it, in memory proportional to its length.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairstone.llm.bpe import PairTable, byte_alphabet
from pairstone.llm.chars import SPACE, class_table
from pairstone.llm.runtime import map_rows

#: Characters in a chunk; transitions and pieces that one worker remembers before it starts anew; characters split at once.
CHUNK, MEMO_TRANSITIONS, MEMO_PIECES, BLOCK = 128, 400_000, 400_000, 1 << 20

# Input classes of the splitter. An apostrophe is CUT2 or CUT3 if a contraction of that length begins there.
# White space is INNER if more of it (or the end) follows; else LAST_BLANK (' ') or LAST_OTHER.
IN_L, IN_N, IN_O, IN_CUT2, IN_CUT3, IN_INNER, IN_LAST_BLANK, IN_LAST_OTHER = range(8)
FIRST = 8  # added to the class of a text's first character: whatever the state, a piece begins
# States: at a boundary; in a run of letters, numbers, others, white space; after a blank that the next run takes in;
# one or two letters of a contraction to come.
AT_EDGE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, HELD_BLANK, ONE_MORE, TWO_MORE = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by state * 16 + class."""
    step, begin = np.zeros((8, 16), np.uint8), np.ones((8, 16), bool)
    runs = {IN_L: IN_LETTERS, IN_N: IN_NUMBERS, IN_O: IN_OTHERS}
    for state in range(8):
        for kind in range(8):
            if kind in runs:
                step[state, kind], begin[state, kind] = runs[kind], state not in (runs[kind], HELD_BLANK)
            elif kind in (IN_CUT2, IN_CUT3):
                if state in (IN_OTHERS, HELD_BLANK):  # swallowed by the run
                    step[state, kind], begin[state, kind] = IN_OTHERS, False
                else:
                    step[state, kind] = ONE_MORE if kind == IN_CUT2 else TWO_MORE
            elif kind == IN_INNER:
                step[state, kind], begin[state, kind] = IN_SPACE, state != IN_SPACE
            else:
                step[state, kind] = HELD_BLANK if kind == IN_LAST_BLANK else AT_EDGE
    step[TWO_MORE], begin[TWO_MORE] = ONE_MORE, False
    step[ONE_MORE], begin[ONE_MORE] = AT_EDGE, False
    step[:, FIRST:], begin[:, FIRST:] = step[AT_EDGE, :FIRST], True
    return step.reshape(-1), begin.reshape(-1)


STEP, BEGIN = _splitter()


def input_classes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The splitter's input for texts laid end to end; ends: where each stops. Nothing is seen beyond a text's end."""
    kind = class_table()[codes]
    out = kind.copy()  # LETTER, NUMBER and OTHER are IN_L, IN_N and IN_O
    room = np.full(len(codes), 3, np.uint8)  # characters that follow in the text, up to 3
    for k in range(3):
        at = ends - 1 - k
        room[at[at >= 0]] = np.minimum(room[at[at >= 0]], k)
    at = np.flatnonzero(kind == SPACE)
    inner = (room[at] == 0) | (kind[np.minimum(at + 1, len(codes) - 1)] == SPACE)
    out[at] = np.where(inner, IN_INNER, np.where(codes[at] == ord(" "), IN_LAST_BLANK, IN_LAST_OTHER))
    at = np.flatnonzero((codes == ord("'")) & (room >= 1))
    out[at[np.isin(codes[at + 1], [ord(c) for c in "stmd"])]] = IN_CUT2
    at = at[room[at] >= 2]
    for a, b in ("re", "ve", "ll"):
        out[at[(codes[at + 1] == ord(a)) & (codes[at + 2] == ord(b))]] = IN_CUT3
    out[np.concatenate(([0], ends[:-1]))] |= FIRST
    return out


def piece_begins(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each place, by chunk maps and a prefix scan."""
    size = len(kinds)
    chunks = -(-size // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[:size] = kinds
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], chunks, 1)  # [entry state, chunk]
    for column in columns:
        maps = STEP[maps << 4 | column]
    stride = 1
    where = np.arange(chunks)
    while stride < chunks:  # after each round a map covers twice as many chunks, up to its own
        maps[:, stride:] = maps[maps[:, :-stride], where[stride:]]
        stride *= 2
    state = np.concatenate((np.array([AT_EDGE], np.uint8), maps[AT_EDGE, :-1]))
    out = np.empty((CHUNK, chunks), bool)
    for i, column in enumerate(columns):
        at = state << 4 | column
        out[i] = BEGIN[at]
        state = STEP[at]
    return out.T.reshape(-1)[:size]


class CountTransducer:
    """The counter for one vocabulary (a tokenizers .json file of a byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]))
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        merged: dict[tuple[int, int], int] = {}
        # The alphabet's ids are not ranks, but no merge makes them, so only their order among merged tokens matters.
        for a, b in (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]):
            merged.setdefault((vocab[a], vocab[b]), vocab[a + b])
        self.pairs = PairTable(merged)
        #: The trie: node * 256 + byte gives the next node; token_at gives a node's token.
        self.next_node: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for name, token in vocab.items():
            if any(c not in byte_of for c in name):
                continue  # a special token
            node = 0
            for c in name:
                key = node << 8 | byte_of[c]
                if key not in self.next_node:
                    self.next_node[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.next_node[key]
            self.token_at[node] = token
        self.pieces: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        start = ((0, -1, 0),)
        self.states: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.rest = [0]  # tokens that come out if the piece ends in the state
        self.arcs: dict[int, tuple[int, int]] = {}

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        live, ended = [], None
        for node, before, count in self.states[state]:
            node = self.next_node.get(node << 8 | byte)
            if node is not None:
                live.append((node, before, count))
                token = self.token_at[node]
                if ended is None and token >= 0 and (before < 0 or self.pairs.compatible(before, token)):
                    ended = (0, token, count + 1)
        live.append(ended)
        least = min(x[2] for x in live)
        key = tuple((node, before, count - least) for node, before, count in live)
        target = self.number.get(key)
        if target is None:
            target = self.number[key] = len(self.states)
            self.states.append(key)
            self.rest.append(key[-1][2])
        self.arcs[state << 8 | byte] = out = (target, least)
        return out

    def count_piece(self, piece: bytes) -> int:
        if len(self.arcs) > MEMO_TRANSITIONS:
            self._restart()
        state, total, arcs = 0, 0, self.arcs
        for byte in piece:
            arc = arcs.get(state << 8 | byte) or self._arc(state, byte)
            state = arc[0]
            total += arc[1]
        return total + self.rest[state]

    def _segments(self, texts: list[str]) -> tuple[list[str], list[int], list[int]]:
        """Texts without special strings, the text that each belongs to, and the special tokens of each text."""
        parts, owner, special = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            found = self.special.split(text) if "<|" in text else [text]
            special[i] = len(found) - 1
            for x in found:
                if x:
                    parts.append(x)
                    owner.append(i)
        return parts, owner, special

    def count(self, texts: list[str]) -> list[int]:
        parts, owner, totals = self._segments(texts)
        block, size = [], 0
        for i, part in enumerate(parts):
            block.append((part, owner[i]))
            size += len(part)
            if size >= BLOCK or i + 1 == len(parts):
                for (_, text), n in zip(block, self._count_block([x for x, _ in block]), strict=True):
                    totals[text] += n
                block, size = [], 0
        return totals

    def _count_block(self, parts: list[str]) -> list[int]:
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in parts])
        begins = piece_begins(input_classes(codes, ends))
        at = np.flatnonzero(begins)
        places = [*at.tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(places, places[1:], strict=False)]
        memo = self.pieces
        counts = [*map(memo.get, pieces)]
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    piece = pieces[i]
                    counts[i] = memo[piece] = memo.get(piece) or self.count_piece(piece.encode())
            if len(memo) > MEMO_PIECES:
                memo.clear()
        upto = np.concatenate(([0], np.cumsum(counts)))
        edge = np.searchsorted(at, np.concatenate(([0], ends)))
        return (upto[edge[1:]] - upto[edge[:-1]]).tolist()


@functools.cache
def load(path: str) -> CountTransducer:
    return CountTransducer(path)


def count_documents(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether there are more than limit tokens."""

    def run(batch: list[str]) -> dict:
        tokens = load(vocabulary).count(batch)
        return {"n_bytes": pa.array([len(x.encode()) for x in batch], pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": [n > limit for n in tokens]}

    return map_rows(docs, run, "n_bytes long, n_tokens long, over_limit boolean")
