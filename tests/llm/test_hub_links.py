"""Documents of one hub are compared in blocks; pairs of one token leave them out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sigloom.llm import ngramjoin


def _edited(seed: int, n_docs: int):
    rng = np.random.default_rng(seed)
    hub = np.unique(rng.integers(1, 1 << 44, 120))
    sets = []
    for _ in range(n_docs):
        kept = hub[rng.random(len(hub)) < rng.uniform(0.75, 1)]
        sets.append(np.unique(np.concatenate([kept, rng.integers(1, 1 << 44, rng.integers(0, 25))])))
    return hub, sets


def test_links_of_a_hub_in_two_blocks_equal_brute_force():
    hub, sets = _edited(4, 60)
    root, part = np.arange(60) // 3, np.arange(60) % 2
    over = [len(np.intersect1d(s, hub)) for s in sets]
    raw = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets]
    rows = [(9, i, j, part[d], d, len(sets[d]), root[d], over[d], over[d], raw[d])
            for i, j in ((0, 0), (0, 1), (1, 1)) for d in range(60) if part[d] in (i, j)]
    names = ["hub", "i", "j", "part", "k", "n", "root", "low", "high", "toks"]
    batch = pa.RecordBatch.from_pydict({c: pa.array([r[x] if c == "toks" else int(r[x]) for r in rows]) for x, c in enumerate(names)})
    got = [p for out in ngramjoin._hub_links(75)(iter([batch])) for p in zip(*(out.column(c).to_pylist() for c in "uv"))]
    want = set()
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if root[a] != root[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                want.add((b, a))
    assert {tuple(sorted(p)) for p in got} == want and len(got) == len(want) > 5


def test_pairs_of_a_token_leave_out_those_of_one_hub():
    hub = [7, 7, 7, -1, -1]
    batch = pa.RecordBatch.from_pydict({"tok": pa.array([1] * 5), "k": pa.array(range(10, 15)), "n": pa.array([100] * 5),
                                        "root": pa.array([1, 2, 3, 4, 5]), "hub": pa.array(hub)})
    pairs = [p for out in ngramjoin._open_pairs(75)(iter([batch])) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
    assert sorted(pairs) == [(10, 13), (10, 14), (11, 13), (11, 14), (12, 13), (12, 14), (13, 14)]
