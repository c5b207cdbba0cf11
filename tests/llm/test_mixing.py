"""Mixing: targets against a brute-force sharing, copies against the definition, edge cases."""

import hashlib
from collections import defaultdict

import pytest

from kdframe.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share all by weight, stop at the caps, share the excess again until none is above."""
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


@pytest.mark.parametrize("case", [
    {"a": [5] * 40, "b": [7] * 3, "c": [1] * 10, None: [9] * 20},
    {"z": [100] * 30, "é": [1], "": [2, 3], "B": [10] * 5, "a": [50] * 8},
    {"only": [3, 1, 4]},
])
def test_targets_and_copies(docs_of, case):
    rows, i = [], 0
    for s, sizes in case.items():
        for n in sizes:
            rows.append((i, " ".join(["w"] * n), "en", s))
            i += 1
    got = mixing.mix(docs_of(rows)).collect()
    want = brute_targets({s: sum(v) for s, v in case.items()})
    per = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sum(case[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        rate = r.target / r.source_size
        assert r.copies in (int(rate + 1e-9), -int(-rate // 1)) or abs(rate - round(rate)) < 1e-9
        per[r.source] += r.taken
    for s, taken in per.items():
        assert abs(taken - want[s]) <= max(case[s]) + 1e-6


def test_brute_force_positions(spark):
    """Copies equal integer boundaries crossed on the prefix sum of the documented order."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    cls = lambda n: n if n < 64 else 64 * (n.bit_length() - 1) + (n >> (n.bit_length() - 7)) - 64
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by = defaultdict(list)
    for r in docs.collect():
        by[r.source].append(r.doc_id)
    for s, ids in by.items():
        ids.sort(key=lambda i: (cls(got[i].size), md5(f"mix-1|{i}")))
        u = int(md5(f"mix-1|offset|+{s}")[:13], 16) / 2 ** 52
        for n, i in enumerate(ids, 1):
            rate = got[i].target / got[i].source_size
            assert got[i].copies == int(rate * n + u) - int(rate * (n - 1) + u)


def test_edges(docs_of, words):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, words(5000, 3), "en", "a"), (4, "one two", "en", None), (4, "one two", "en", None),
            (None, "x y z", None, "b"), (None, "x y z", None, "b")]
    a = sorted(mixing.mix(docs_of(rows)).collect(), key=str)
    b = sorted(mixing.mix(docs_of(rows[::-1]).repartition(5)).collect(), key=str)
    assert a == b and len(a) == len(rows)
    assert all(r.size == 0 and r.taken == 0 for r in a if r.doc_id in (1, 2))
    assert mixing.mix(docs_of([])).collect() == []
    zero = mixing.mix(docs_of([(1, None), (2, " ")])).collect()
    assert [(r.target, r.taken) for r in zero] == [(0.0, 0), (0.0, 0)]


def test_emit(docs_of, words):
    rows = [(i, words(20, i), "en", "big") for i in range(60)] + [(100 + i, words(5, i), "en", "small") for i in range(4)]
    rows += [rows[0], (None, "a b c", "en", "small")]
    docs = docs_of(rows)
    mixed = mixing.mix(docs)
    out = mixing.emit(docs, mixed)
    assert out.columns == [*docs.columns, "copy"]
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
    want = defaultdict(int)
    for r in mixed.collect():
        want[r.doc_id] += r.copies
    assert count == {k: v for k, v in want.items() if v}
    assert mixing.emit(docs_of([]), mixing.mix(docs_of([]))).collect() == []
