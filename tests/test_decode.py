"""Constrained decoding against trying every path."""

import itertools
import math
import random

from pairstone.operators import decode


def every_path(frames, symbols, accepts):
    """The best score of each text over all frame labellings."""
    best = {}
    for path in itertools.product(range(len(symbols) + 1), repeat=len(frames)):
        text = "".join(symbols[k - 1] for i, k in enumerate(path) if k != decode.BLANK and (i == 0 or path[i - 1] != k))
        if accepts(text):
            score = sum(row[k] for row, k in zip(frames, path, strict=True))
            best[text] = max(best.get(text, -math.inf), score)
    return max(((s, t) for t, s in best.items()), default=None)


def test_best_admitted_path():
    rnd = random.Random(5)
    symbols = "02:"
    steps, accepting = decode.allele_grammar({"02", "20"})

    def accepts(text):
        state = 0
        for c in text:
            state = steps.get((state, c))
            if state is None:
                return False
        return state in accepting

    for _ in range(30):
        frames = [[math.log(rnd.random()) for _ in range(4)] for _ in range(rnd.randint(1, 6))]
        want = every_path(frames, symbols, accepts)
        got = decode.constrained(frames, symbols, steps, accepting)
        if want is None:
            assert got is None
        else:
            assert math.isclose(decode.greedy(frames, symbols)[1] - got[1], want[0])
            assert got[1] >= -1e-9 and accepts(got[0])


def test_no_frames():
    steps, accepting = decode.allele_grammar({"02"})
    assert decode.constrained([], "02:", steps, accepting) is None
    assert decode.greedy([], "02:") == ("", 0.0)
