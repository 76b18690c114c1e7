"""Constrained decoding of a recogniser's frame scores: the best path that a small grammar admits.

Frames give log scores for blank and each symbol; repeated symbols without a blank between are one.
The grammar is a deterministic automaton, so the search keeps one best path for each (state, last
symbol) and is linear in the frames. What the constraint costs is the score lost against the
unconstrained best path.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from pairstone.workers import importable

BLANK = 0


def greedy(frames: Sequence[Sequence[float]], symbols: str) -> tuple[str, float]:
    """The unconstrained best path: the best symbol of each frame, repeats and blanks removed."""
    out, last, score = [], BLANK, 0.0
    for row in frames:
        best = max(range(len(row)), key=lambda k: row[k])
        score += row[best]
        if best not in (last, BLANK):
            out.append(symbols[best - 1])
        last = best
    return "".join(out), score


def constrained(frames: Sequence[Sequence[float]], symbols: str, steps: Mapping[tuple[int, str], int], accepting: set[int], start: int = 0) -> tuple[str, float] | None:
    """(text, cost) of the best path whose text the automaton accepts, or None if there is none."""
    live: dict[tuple[int, int], tuple[float, str]] = {(start, BLANK): (0.0, "")}
    for row in frames:
        following: dict[tuple[int, int], tuple[float, str]] = {}

        def offer(key: tuple[int, int], score: float, text: str, best: dict = following) -> None:
            held = best.get(key)
            if held is None or (score, held[1]) > (held[0], text):
                best[key] = (score, text)

        for (state, last), (score, text) in live.items():
            offer((state, BLANK), score + row[BLANK], text)
            if last != BLANK:
                offer((state, last), score + row[last], text)
            for k, symbol in enumerate(symbols, 1):
                target = steps.get((state, symbol))
                if target is not None and k != last and row[k] > -math.inf:
                    offer((target, k), score + row[k], text + symbol)
        live = following
    ends = [(score, text) for (state, _), (score, text) in live.items() if state in accepting]
    if not ends:
        return None
    score, text = max(ends, key=lambda x: (x[0], x[1]))
    return text, greedy(frames, symbols)[1] - score


def allele_grammar(families: set[str]) -> tuple[dict[tuple[int, str], int], set[int]]:
    """An automaton for two-digit families, perhaps with a second field of two or three digits after a colon."""
    steps: dict[tuple[int, str], int] = {}
    after = 1
    for first in sorted({f[0] for f in families}):
        after += 1
        steps[0, first] = after
        for f in families:
            if f[0] == first:
                steps[after, f[1]] = 1
    colon, one, two, three = after + 1, after + 2, after + 3, after + 4
    steps[1, ":"] = colon
    for digit in "0123456789":
        steps[colon, digit], steps[one, digit], steps[two, digit] = one, two, three
    return steps, {1, two, three}


def decoded(rows: DataFrame, symbols: str, families: set[str]) -> DataFrame:
    """id, text, cost, free: the best admitted text of rows(id, frames), what the grammar costs, and the unconstrained text.

    text is null where no path is admitted; so is everything where there are no frames. Frames go through in Arrow batches.
    """
    importable(rows.sparkSession)
    steps, accepting = allele_grammar(families)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, cost, free = [], [], []
            for frames in batch.column("frames").to_pylist():
                found = constrained(frames, symbols, steps, accepting) if frames else None
                text.append(found[0] if found else None)
                cost.append(found[1] if found else None)
                free.append(greedy(frames, symbols)[0] if frames else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string()), pa.array(cost, pa.float64()), pa.array(free, pa.string())], names=["id", "text", "cost", "free"])

    return rows.select("id", "frames").mapInArrow(run, "id long, text string, cost double, free string")
