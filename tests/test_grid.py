"""Links over a grid of blocks: what all pairs connect, without a list of pairs."""

import numpy as np
import pyarrow as pa
import pytest

from photarium.operators import dedup, graph, grid, threshold, vectors


def components(n, pairs):
    low = list(range(n))

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        low[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def prints(rng, groups, each, flips):
    """Rows (k, dhash, hist, gray) in groups of near prints."""
    out = []
    for _ in range(groups):
        h, v, g = int(rng.integers(0, 1 << 63)), rng.random(6) ** 3, rng.normal(size=6)
        for _ in range(each):
            turned = 0
            for b in rng.choice(64, int(rng.integers(0, flips)), replace=False):
                turned |= 1 << int(b)
            w, c = v + rng.random(6) * 0.05, g + rng.normal(size=6) * 0.05
            bits = h ^ turned
            out.append((len(out), bits - (1 << 64) if bits >> 63 else bits, (w / w.sum()).tolist(), (c / np.linalg.norm(c)).tolist()))
    return out


DDL = "k long, dhash long, hist array<double>, gray array<double>"


@pytest.mark.parametrize("threshold", [0.75, 0.80])
def test_quality_links(spark, monkeypatch, threshold):
    """The components of all pairs, over one block and several, with odd rows; equal prints cost a link each, not a pair."""
    rows = prints(np.random.default_rng(3), 30, 6, 24)
    h = [r[1] % (1 << 64) for r in rows]
    u = np.array([r[2] for r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if 0.6 * (1 - (h[a] ^ h[b]).bit_count() / 64) + 0.3 * u[a] @ u[b] + 0.1 >= threshold]
    odd = [(len(rows) + k, *r) for k, r in enumerate([(None, [1.0] * 6, None), (7, None, None), (7, [1.0, None, 0.0, 0.0, 0.0, 0.0], None), (7, [float("nan")] * 6, None)])]
    df = spark.createDataFrame(rows + odd, DDL)
    for alone in (4096, 1):
        monkeypatch.setattr(grid, "ALONE", alone)
        got = dict(map(tuple, dedup.quality_groups(df, "k", threshold).collect()))
        assert [got[k] for k in range(len(rows) + len(odd))] == components(len(rows), near) + [k for k, *_ in odd]
    same = spark.createDataFrame([(k, *rows[0][1:]) for k in range(500)], DDL)
    assert dedup.quality_links(same, "k", threshold).count() <= 500 * grid.BLOCKS


def test_near_duplicate_groups(spark, monkeypatch):
    """Groups, sizes and scores against all pairs, with ignored pairs, over one block and several; equal prints cost no pairs."""
    rows = prints(np.random.default_rng(5), 25, 10, 30)
    h, v, g = [r[1] % (1 << 64) for r in rows], *(np.array([r[n] for r in rows]) for n in (2, 3))
    d = np.array([[1 - (a ^ b).bit_count() / 64 for b in h] for a in h])
    score = 0.45 * d + 0.25 * np.maximum(0, 1 - np.abs(v[:, None] - v[None]).sum(axis=2) / 2) + 0.30 * np.clip(g @ g.T, 0, 1)
    ok = {(a, b) for b in range(len(rows)) for a in range(b) if d[a, b] >= 0.78 and (score[a, b] >= 0.93 or d[a, b] >= 0.96)}
    ignored = sorted(ok)[::3]
    df = spark.createDataFrame(rows, DDL)
    for alone, gone in ((4096, []), (1, []), (4096, ignored), (1, ignored)):
        monkeypatch.setattr(grid, "ALONE", alone)
        left = ok - set(gone)
        label, want = np.array(components(len(rows), left)), {}
        for c in set(label):
            members = np.flatnonzero(label == c).tolist()
            if len(members) > 1:
                some = [score[p] for p in left if p[0] in members[:8] and p[1] in members[:8]]
                want |= {m: (c, len(members), round(float(np.mean(some)) if some else 0.0, 6)) for m in members[:8]}
        asked = spark.createDataFrame([(b, a) for a, b in gone], "x long, y long") if gone else None
        got = dedup.near_duplicate_groups(df, "k", asked, 0.93, 0.96).collect()
        assert {r["k"]: (r["group_id"], r["group_size"], round(r["score"], 6)) for r in got} == want
    same = spark.createDataFrame([(k, *rows[0][1:]) for k in range(500)], DDL)
    assert dedup.combined_links(same, 14, 0.86, 0.9).count() <= 500 * grid.BLOCKS


def test_threshold_links_without_pruning(spark, monkeypatch):
    """Vectors that pivots don't part travel once for each block, and what all pairs connect is connected."""
    x = np.random.default_rng(7).normal(size=(1500, 16))
    x[1000:] = x[:500] + np.random.default_rng(8).normal(size=(500, 16)) * 0.3
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.argwhere(np.triu(u @ u.T >= 0.75, 1)).tolist()
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (5004, x[0].tolist())]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + odd, "k long, v array<double>")
    monkeypatch.setattr(grid, "ALONE", 1)
    monkeypatch.setattr(threshold, "PIVOT_ROWS", 20)
    (cells,) = [c for c in threshold.threshold_cells(df, "k", "v", 0.75) if c.dim == 16]
    assert not cells.pruned() and cells.dealt.count() > 2 * grid.BLOCKS * len(x)
    got = dict(map(tuple, graph.connected_components(df.select("k"), threshold.threshold_links(df, "k", "v", 0.75)).collect()))
    want = components(len(x), near)
    assert [got[k] for k in range(len(x))] == want and got[5004] == want[0] and all(got[k] == k for k in range(5000, 5004))
    assert threshold.threshold_links(df, "k", "v", 0.75).count() <= grid.BLOCKS * len(x) + 1


def test_similar_assets(spark, monkeypatch):
    """The likest of each query by brute force, over several blocks of assets and queries, with odd rows."""
    rows = prints(np.random.default_rng(11), 12, 8, 30)
    rows += [(100, 5, None, rows[0][3]), (101, 5, rows[0][2], None), (102, None, rows[0][2], rows[0][3]), (103, 5, [-0.5, 1.5] + [0.0] * 4, rows[1][3]), (104, 5, [0.5, 0.5], [1.0]), (105, 5, [9.0] * 6, rows[2][3])]
    monkeypatch.setattr(dedup, "SIDE_BYTES", 4000)

    def sim(a, b):
        d = 1 - ((a[1] ^ b[1]) % (1 << 64)).bit_count() / 64
        color = max(0.0, min(1.0, 1 - sum(abs(x - y) for x, y in zip(a[2], b[2])) / 2)) if a[2] and b[2] and len(a[2]) == len(b[2]) else 0.0
        if a[3] is None or b[3] is None:
            return 0.7 * d + 0.3 * color
        return 0.45 * d + 0.25 * color + 0.3 * (max(0.0, min(1.0, sum(x * y for x, y in zip(a[3], b[3])))) if len(a[3]) == len(b[3]) else 0.0)

    want = []
    for a in rows:
        if a[1] is not None and a[0] % 3 < 2:
            best = sorted((-sim(a, b), b[0]) for b in rows if b[1] is not None and b[0] != a[0])
            want += [(a[0], k, n, round(-s, 6)) for n, (s, k) in enumerate(best[:5], 1) if -s >= 0.5]
    df = spark.createDataFrame(rows, DDL)
    got = dedup.similar_assets(df, df.where("k % 3 < 2").select("k"), "k", 5, 0.5).collect()
    assert sorted((r["query"], r["key"], r["rank"], round(r["similarity"], 6)) for r in got) == sorted(want)


def test_topk_passes_on_few_rows(spark):
    """A task passes on what is among its best so far, not the best of each slice."""
    x = np.random.default_rng(2).normal(size=(4000, 3))
    q, top, passed = np.random.default_rng(3).normal(size=(5, 3)), np.full((2, 5), -np.inf), 0
    for k in range(0, len(x), 20):
        i, who, sim = vectors._best_of_block(pa.array(range(k, k + 20)), x[k : k + 20], q, np.arange(5), {}, top, None)
        passed += len(i)
    assert np.allclose(np.sort(top, axis=0), np.sort(x @ q.T, axis=0)[-2:]) and passed < 0.2 * 2 * 5 * 200


@pytest.mark.parametrize("alone", [4096, 1])
def test_rows_pass_by(spark, monkeypatch, alone):
    """A task takes a few rows at a time, and what all pairs connect is connected, without banned pairs."""
    x = np.random.default_rng(13).normal(size=(900, 8))
    x[600:] = x[:300] + np.random.default_rng(14).normal(size=(300, 8)) * 0.2
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = [tuple(p) for p in np.argwhere(np.triu(u @ u.T >= 0.9, 1)).tolist()]
    bans = near[::3]

    def prepare(rows):
        assert len(rows) <= 20
        return (vectors.units(grid.matrix(rows["v"])),)

    test = grid.Test(prepare, lambda one, two: grid.near_units(one[0], two[0], 0.9), lambda one, two, i, j: grid.products(one[0], two[0], i, j) >= 0.9)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    monkeypatch.setattr(grid, "ALONE", alone)
    for gone in ([], bans):
        asked = spark.createDataFrame([(b, a) for a, b in gone], "x long, y long") if gone else None
        links = grid.grid_links(df, len(x), grid.PASSING // 20, test, asked)
        got = dict(map(tuple, graph.connected_components(df.select("k"), links).collect()))
        assert [got[k] for k in range(len(x))] == components(len(x), set(near) - set(gone))


def test_a_task_holds_one_block():
    """Of rows that pass by a held block nothing stays but keys and components."""
    x = np.random.default_rng(15).normal(size=(1000, 64))
    rows = lambda n: pa.table({"k": np.arange(n, n + 1000), "v": pa.array(list(x + n), pa.list_(pa.float64()))})
    test = grid.Test(lambda t: (vectors.units(grid.matrix(t["v"])),), lambda one, two: iter(()), lambda one, two, i, j: i < j)
    before, meeting = pa.total_allocated_bytes(), grid.Meeting(test)
    meeting.add(rows(0), stay=True, meet=False)
    for n in range(1, 41):
        meeting.add(rows(1000 * n), stay=False, meet=True)
    assert [len(one[0]) for _, one in meeting.held] == [1000] and len(meeting.forest.top) == 41_000
    assert pa.total_allocated_bytes() - before < 41_000 * 8 * 2  # the vectors are 21 MB


@pytest.mark.parametrize("row_bytes", [64 + 8 * 128, 320 + 12 * 64, 32 + 12 * 64])
def test_rows_travel_alike(row_bytes):
    """Up to 800,000 prints or vectors of 64 dimensions a row travels as often as of a few."""
    assert grid.block_count(5000, row_bytes) == grid.block_count(800_000, row_bytes) == grid.BLOCKS
