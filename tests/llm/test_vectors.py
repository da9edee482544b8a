import numpy as np
import pytest

from clewline.llm import vectors as v

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows):
    good = [(i, np.array(x, dtype=float)) for i, x in rows if x and None not in x and np.isfinite(x).all() and np.any(x)]
    n, parent = [0] * len(good), list(range(len(good)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95 - 1e-12:
                n[a] += 1
                n[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k in range(len(good)):
        least[root(k)] = min(least.get(root(k), 1 << 60), good[k][0])
    got = [(good[k][0], n[k], least[root(k)]) for k in range(len(good))]
    names = {i for i, _ in good}
    return sorted(got + [(i, 0, i) for i, x in rows if not (x and None not in x and np.isfinite(x).all() and np.any(x))]), names


def compare(frame, rows):
    got = v.near_vectors(frame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)[0]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("tile,block", [(4096, v.BLOCK_BYTES), (16, v.BLOCK_BYTES), (7, 20 * 8 * 32)])
def test_clusters(frame, monkeypatch, tile, block):
    monkeypatch.setattr(v, "TILE", tile)
    monkeypatch.setattr(v, "BLOCK_BYTES", block)
    monkeypatch.setattr(v, "FAN", 2)
    rng = np.random.default_rng(8)
    rows = []
    for c in range(30):
        centre = rng.normal(size=32)
        for k in range(rng.integers(1, 9)):
            rows.append((len(rows), ((centre + rng.normal(size=32) * rng.choice([0, 0.05, 0.25, 0.4])) * rng.choice([1e-20, 1, 1e20])).astype(np.float32).tolist()))
    compare(frame, rows)


def test_edge_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, -0.0]), (9, [2.0, 0.1]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [3.0]), (13, [5.0])]
    compare(frame, rows)


def test_repeated_rows_and_empty_table(frame):
    df = frame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 2.0])], SCHEMA)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in v.near_vectors(df).collect())
    assert got == [(0, 1, 2, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True)]
    assert v.near_vectors(df.where("false")).collect() == []
    assert len(v.near_vectors(frame([(1, None)], SCHEMA)).collect()) == 1


def test_pruned_product_equals_full_product():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 40)) * np.linspace(2, 0.2, 40)
    x[300:400] = x[:100] + rng.normal(size=(100, 40)) * 0.1
    u = v.unit(x)
    want = {(a, b) for a, b in zip(*np.nonzero(u @ u.T >= 0.95))}
    for turn in (None, v.rotation(x)):
        tile, got = v.prepared(x, turn), set()
        for rows, columns, near in v.hits(tile, tile, 0.95):
            i, j = np.nonzero(near)
            got |= set(zip(rows[i], columns[j]))
        assert got == want


def test_pair_of_blocks_counts_links_and_joins_components():
    """A chain, where each row is near the next only: one component over many tiles, each link counted on both sides."""
    angles = np.arange(60) * 0.3
    x = np.stack([np.cos(angles / 4), np.sin(angles / 4)], axis=1)
    keys = [bytes([k]) * 16 for k in range(60)]
    near = x @ x.T >= 0.995
    pair = v.BlockPair(0.995)
    for low in range(0, 60, 8):
        part = slice(low, low + 8)
        pair.add(keys[part], np.full(len(keys[part]), 3), v.prepared(x[part], None), True, True)
    out = pair.result().to_pylist()
    assert {r["key"]: r["links"] for r in out if r["other"] is None} == {k: 3 * (int(n) - 1) for k, n in zip(keys, near.sum(axis=1))}
    edges = [(r["key"], r["other"]) for r in out if r["other"] is not None]
    assert len(edges) == 59 and max(sum(k in e for e in edges) for k in keys) <= v.FAN + 1
    only = v.BlockPair(0.995)
    only.add(keys[:4], np.ones(4), v.prepared(x[:4], None), True, False)
    assert only.result() is None
    only.add(keys[4:8], np.ones(4), v.prepared(x[4:8], None), False, True)
    assert {r["key"]: r["links"] for r in only.result().to_pylist() if r["other"] is None} == {keys[3]: 1, keys[4]: 1}


def test_blocks_hold_what_fits_and_skip_the_far(monkeypatch):
    counts = [(4, 0, 10), (4, 1, 10), (4, 4000, 500), (8, 7, 3)]
    monkeypatch.setattr(v, "BLOCK_BYTES", 100 * 8 * 4)
    homes, boxes = v.blocks(counts)
    assert homes == [(4, 0, 0, 1), (4, 1, 0, 1), (4, 4000, 1, 5), (8, 7, 6, 3)]
    assert len(boxes) == 9 and boxes[0][2:] == (-1.0, -1.0, -1.0, -1 + 2 / 32, -1 + 2 / 16, -1 + 2 * 2 / 8)
    assert v.blocks([]) == ([], [])
