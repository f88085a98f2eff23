"""Lives of pivots in keyed state: restarts and batch bounds make no difference."""

import random

from tidemark.config import Settings
from tidemark.storage import Workspace
from tidemark.streaming.lives import TOUCH, PivotLives, ticks_to_live

FAST = Settings(decay=4.0)


def expected(touches):
    ticks, last = ticks_to_live(FAST), max(t for _, _, t in touches)
    out = []
    for key in {(a, b) for a, b, _ in touches}:
        run = []
        for t in sorted(t for a, b, t in touches if (a, b) == key) + [None]:
            if run and (t is None or t - run[-1] >= ticks):
                out.append((*key, run[0], run[-1], len(run), run[-1] + ticks))
                run = []
            run.append(t)
    return sorted(r for r in out if r[-1] <= last)


def test_lives_with_restarts(spark):
    assert ticks_to_live(FAST) == 9 and 2 ** (-4.0 * 9) < FAST.min_keep < 2 ** (-4.0 * 8)
    rng = random.Random(3)
    touches = [(p % 3, p, t) for t in range(1, 161) for p in [rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7])]]
    touches += [(1, 4, 80), (1, 4, 80), (9, 9, 151), (9, 8, 151), (9, 8, 160), (9, 7, 152)]  # over at the last tick, by the clock and by a touch
    for bounds in ([200], [30, 31, 90, 200]):
        root, low = Workspace(spark, "test-lives").path, 0
        for high in bounds:
            part = [r for r in touches if low < r[2] <= high] + [(None, 1, high), (1, None, high)]
            lives = PivotLives(spark, root, FAST)  # a restart each time
            lives.add(spark.createDataFrame(part, TOUCH))
            lives.advance()
            low = high
        assert sorted(map(tuple, lives.ended().collect())) == expected(touches)
    assert {(9, 9, 151, 151, 1, 160), (9, 8, 151, 151, 1, 160)} <= set(expected(touches))
