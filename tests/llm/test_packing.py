import random
from collections import Counter

import numpy as np
import pytest

from tallywright.llm import packing
from tallywright.llm.packing import _segments, brackets, pack
from tallywright.session import cut


def check(spark, sizes, capacity):
    df = spark.createDataFrame([(n, s, "clash") for n, s in enumerate(sizes)], "doc_id long, n long, key string")
    rows = pack(df, "doc_id", "n", capacity).collect()
    filled = Counter()
    pieces: dict = {}
    for r in rows:
        filled[r["container_id"]] += r["size"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["size"]))
    assert set(pieces) == set(range(len(sizes))) and all(v <= capacity for v in filled.values())
    for n, s in enumerate(sizes):
        size = max(0, s or 0)
        own = sorted(pieces[n])
        assert sum(p[2] for p in own) == size and [p[1] for p in own] == [capacity * i for i in range(len(own))]
        assert len(own) == max(1, -(-size // capacity))
    return len([c for c, v in filled.items() if v])


def best_fit(sizes, capacity):
    gaps: list[int] = []
    full = 0
    for s in sorted((x for x in sizes if x), reverse=True):
        full += s // capacity
        s %= capacity
        if not s:
            continue
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps[gaps.index(min(fits))] -= s
        else:
            gaps.append(capacity - s)
    return full + len(gaps)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_good_as_best_fit(spark, seed):
    rng = random.Random(seed)
    sizes = [min(4000, int(rng.lognormvariate(4.5, 1.2))) for _ in range(600)]
    used = check(spark, sizes, 512)
    assert used <= best_fit(sizes, 512) * 1.02 + 1


def test_edges(spark):
    assert check(spark, [0, None, -5, 0], 10) == 0
    assert check(spark, [10, 10, 20, 21], 10) == 7
    assert check(spark, [6] * 7, 10) == 7
    assert check(spark, [3] * 9, 9) == 3
    assert check(spark, [1000], 10) == 100
    assert check(spark, [], 10) == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, 4), (1, 4), (None, 4)], "doc_id long, n long")
    assert sorted(str(r["doc_id"]) for r in pack(df, "doc_id", "n", 8).collect()) == ["1", "1", "None"]


def test_brackets_between_partitions():
    # items left in partition 0 (3) and 1 (2); gaps left in 1 (1) and 2 (6): the nearest items below go first
    assert _segments([(0, 0, 3), (1, 1, 2), (2, 6, 0)]) == [(0, 2, 1, 0, 1), (1, 1, 2, 0, 2), (0, 1, 2, 2, 2)]


def test_vectorized_brackets():
    rng = random.Random(5)
    for _ in range(50):
        row = [rng.random() < 0.5 for _ in range(rng.randrange(30))]
        waiting, want = [], set()
        for n, gap in enumerate(row):
            if not gap:
                waiting.append(n)
            elif waiting:
                want.add((waiting.pop(), n))
        items, gaps = brackets(np.array(row, bool))
        assert set(zip(items.tolist(), gaps.tolist(), strict=True)) == want


def test_between_partitions(spark, monkeypatch):
    """With many small partitions, none merged: as good as best fit, and the work is spread."""
    seen = []
    monkeypatch.setattr(packing, "ROWS_A_TASK", 60)
    monkeypatch.setattr(packing, "WORTH_A_TASK", 60)
    monkeypatch.setattr(packing, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    rng = random.Random(6)
    sizes = [min(2000, int(rng.lognormvariate(4.5, 1.2))) for _ in range(600)]
    used = check(spark, sizes, 512)
    assert used <= best_fit(sizes, 512) * 1.02 + 1
    swept = [x for x in seen if "pid" in x.columns]
    rows = Counter(r["pid"] for r in swept[0].collect())
    assert len(rows) >= 8 and max(rows.values()) < 3 * sum(rows.values()) / len(rows)
    assert len(swept) < 25
