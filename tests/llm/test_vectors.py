"""Operators on vectors against brute force, and on awkward tables."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from curatrix.llm import clusters as K
from curatrix.llm import neighbours as P
from curatrix.llm import subset as S
from curatrix.llm import tree as Y
from curatrix.llm import vectors as V

TABLES = "/root/testdata/sf0.01"
SCHEMA = "id string, embedding array<float>, node int, file int, vec string"


def table(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1, 2, "x") for i, v in rows], SCHEMA)


def crowds(sizes, dim=256, spread=1.0, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for c, n in enumerate(sizes):
        centre = rng.standard_normal(dim)
        out += [(f"c{c:02d}-{i:04d}", centre + spread * rng.standard_normal(dim)) for i in range(n)]
    return out


def brute(rows, k):
    ids = sorted(i for i, _ in rows)
    x = np.stack([dict(rows)[i] for i in ids]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((x @ x.T).astype(float), 6)
    np.fill_diagonal(s, -2)
    return {i: [ids[j] for j in np.argsort(-s[a], kind="stable")[:k]] for a, i in enumerate(ids)}, s


def test_overlap_is_the_footrule():
    rng = np.random.default_rng(1)
    a = np.stack([rng.permutation(20)[:5] for _ in range(12)]).astype(np.int16)
    got = P.footrule_overlap(a, a)
    for i in range(12):
        for j in range(12):
            at = lambda r, p: r.index(p) if p in r else 5
            x, y = a[i].tolist(), a[j].tolist()
            d = sum(abs(at(x, p) - at(y, p)) for p in set(x) | set(y))
            assert 2 * got[i, j] == 30 - d


def test_ids_survive():
    ids = ["00ff", "00FF", "abc", "é", "", "0" * 40]
    assert P.long_ids(P.short_ids(ids).to_pylist()) == ids


def test_neighbours_recall(spark):
    rows = crowds([60, 40, 30, 20], spread=0.4)
    truth, _ = brute(rows, 5)
    got = {}
    for r in P.permutation_neighbours(table(spark, rows)).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert sum(len(set(got[i]) & set(truth[i])) for i in truth) / (5 * len(truth)) >= 0.9
    assert all(len(v) == 5 and i not in v for i, v in got.items())


def test_neighbours_in_files_of_over_a_thousand(spark, tmp_path, monkeypatch):
    from curatrix.llm.queries import p3_neighbours

    rng = np.random.default_rng(4)
    rows = [(f"r{i:04d}", rng.standard_normal(256)) for i in range(1500)]
    table(spark, rows).select("id", "embedding").write.parquet(f"{tmp_path}/embedding_shards.parquet")
    monkeypatch.setattr(P, "pivot_count", lambda n: 6)
    truth, _ = brute(rows, 5)
    got = {}
    for r in p3_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert sum(len(got[i] & set(truth[i])) for i in truth) / (5 * len(truth)) >= 0.98


def test_lonely_vectors_get_all_their_neighbours(spark):
    """A file of fewer than k others is no limit: such ids are held against all rows."""
    rng = np.random.default_rng(9)
    rows = crowds([40, 40], spread=0.2) + [(f"l{i}", v) for i, v in enumerate(rng.standard_normal((3, 256)))]
    got = {}
    for r in P.permutation_neighbours(table(spark, rows), pivots=30, posts=1).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    truth, _ = brute(rows, 5)
    assert all(len(set(v)) == 5 for v in got.values()) and len(got) == len(rows)
    found = P.permutation_neighbours(table(spark, rows), pivots=30, posts=1).where("id <> 'l1'")
    rest = [r.neighbour for r in P.completed(found, V.usable_rows(table(spark, rows)), 5).where("id = 'l1'").collect()]
    assert sorted(rest) == sorted(truth["l1"])


def test_posts_grow_with_the_rows():
    assert [P.posts_for(n) for n in (0, 1_000, 12_298, 122_644, 1_226_440)] == [5, 5, 5, 6, 7]


@pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")
def test_found_pairs_recall(spark):
    from curatrix.llm.queries import p3_found
    from curatrix.session import read_table

    rows = {r.id: np.array(r.vec, np.float32) for r in V.usable_rows(read_table(spark, TABLES, "embedding_shards")).collect()}
    truth, s = brute(list(rows.items()), 5)
    at = {i: k for k, i in enumerate(sorted(rows))}
    want = {tuple(sorted((i, j))) for i, js in truth.items() for j in js if s[at[i], at[j]] >= 0.8}
    got = {(r.id_a, r.id_b) for r in p3_found(spark, TABLES).collect()}
    assert len(got & want) / len(want) >= 0.98 and len(got & want) / len(got) >= 0.98


def test_a_vector_that_most_rows_share(spark):
    v = np.ones(256)
    w = np.r_[np.ones(128), -np.ones(128)]
    rows = [(f"a{i:05d}", v) for i in range(1500)] + [(f"b{i}", w + 0.001 * i) for i in range(6)]
    got = {}
    for r in P.permutation_neighbours(table(spark, rows), pivots=8).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert got["a01499"] == {f"a{i:05d}" for i in range(5)} and got["a00000"] == {f"a{i:05d}" for i in range(1, 6)}
    assert len(got) == 1506 and all(len(x) == 5 for x in got.values())


def test_unusable_and_repeated_rows(spark):
    good = crowds([12], spread=0.3)
    bad = [(None, good[0][1]), ("n", None), ("s", [1.0] * 3), ("e", []), ("z", np.zeros(256)), ("q", np.full(256, np.nan)), ("i", np.r_[np.inf, np.ones(255)])]
    df = table(spark, good + good[:3] + bad)
    got = P.permutation_neighbours(df).collect()
    assert {r.id for r in got} == {i for i, _ in good} and len(got) == 60
    assert K.density_clusters(df).count() == 12
    assert {r.id for r in S.varied_subset(df, 50).collect()} == {i for i, _ in good}


def test_no_rows(spark):
    for rows in ([], [("z", np.zeros(256))]):
        df = table(spark, rows)
        assert P.permutation_neighbours(df).count() == 0
        assert K.density_clusters(df).count() == 0
        assert K.consecutive(K.density_clusters(df), 2).count() == 0
        assert S.varied_subset(df, 5).count() == 0


def test_clusters_of_planted_crowds(spark):
    rng = np.random.default_rng(7)
    rows = crowds([80, 40, 25, 12]) + [(f"n{i:03d}", rng.standard_normal(256)) for i in range(60)]
    members = K.density_clusters(table(spark, rows)).collect()
    by = {}
    for r in members:
        by.setdefault(r.cluster, set()).add(r.id)
    want = [{i for i, _ in rows if i.startswith(f"c{c:02d}")} for c in range(4)]
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want))
    assert all(r.own_cosine >= 0.45 for r in members)


def test_loose_clusters(spark):
    rng = np.random.default_rng(11)
    rows = crowds([40, 25, 12], spread=1.6, seed=3) + [(f"n{i:03d}", rng.standard_normal(256)) for i in range(300)]
    rows += [(f"k{g}-{i}", v + 0.01 * rng.standard_normal(256)) for g, v in enumerate(rng.standard_normal((3, 256))) for i in range(4)]  # no cluster
    rows += [(f"t{i:02d}", v) for i, (_, v) in enumerate(crowds([30], seed=5))]
    x = V.unit(np.stack([v for _, v in rows]).astype(np.float32))
    want = [{i for i, _ in rows if i.startswith(p)} for p in ("c00", "c01", "c02", "t")]
    for ids in want:  # as the definition asks
        mine = np.array([i in ids for i, _ in rows])
        cos = x @ V.unit(x[mine].sum(0, keepdims=True))[0]
        assert cos[mine].min() >= 0.45 and cos[~mine].max() < 0.4
    by = {}
    for r in K.density_clusters(table(spark, rows)).collect():
        by.setdefault(r.cluster, set()).add(r.id)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want))


def test_cells_of_any_size_are_compared_whole(monkeypatch):
    """The tree of a cell is that of all its pairs, also where its similarities don't fit at once."""
    x = V.unit(np.stack([v for _, v in crowds([30, 20, 9, 25], spread=0.8)]).astype(np.float32))
    x[40:44] = x[40]
    weight = lambda t: np.sort(np.round(t[2], 5))
    whole = K.cell_tree(x, 3, 0.8, 10)
    monkeypatch.setattr(K, "CELL", 5), monkeypatch.setattr(K, "BLOCK", 7)
    assert np.array_equal(weight(K.cell_tree(x, 3, 0.8, 10)), weight(whole)) and len(whole[0]) == len(x) - 1
    # by brute force: the greatest spanning tree of mutual reachability between leaders
    s = x @ x.T
    lead = [i for i in range(len(x)) if not (s[i, :i][[j for j in range(i) if s[j, :j].max(initial=-1) < 0.8]] >= 0.8).any()]
    y = s[np.ix_(lead, lead)].copy()
    np.fill_diagonal(y, -2)
    core = np.sort(y, 1)[:, -3]
    reach = np.minimum(np.minimum(y, core[:, None]), core[None, :])
    left, inside, total = set(range(1, len(lead))), {0}, []
    while left:
        w, j = max((reach[i, j], j) for i in inside for j in left)
        total.append(w), inside.add(j), left.remove(j)
    hung = len(x) - len(lead)
    assert np.isclose(sorted(total), np.sort(whole[2][hung:]), atol=1e-5).all()


def random_edges(n, m, seed):
    rng = np.random.default_rng(seed)
    e = {(min(a, b), max(a, b)): float(np.round(s, 2)) for a, b, s in zip(rng.integers(0, n, m).tolist(), rng.integers(0, n, m).tolist(), rng.random(m)) if a != b}
    return [(a * 7919, b * 7919, s) for (a, b), s in e.items()]


def test_tree_is_the_same_by_rounds_and_at_once(spark):
    rows = random_edges(300, 900, 3)  # with many equal weights
    edges = spark.createDataFrame(rows + rows[:50], "u long, v long, s double")
    once = {tuple(r) for r in Y.spanning_tree(edges, least_rounds=0).collect()}
    rounds = {tuple(r) for r in Y.spanning_tree(edges, rest=0).collect()}
    assert once == rounds and len(once) > 250


def test_bands_condense_as_the_whole(spark):
    rows = random_edges(400, 3000, 5)
    tree = Y.spanning_tree(spark.createDataFrame(rows, "u long, v long, s double")).cache()

    def result(band):
        joined, clusters = Y.condense(tree, 4, 0.0, band)
        sizes = sorted((round(r.level, 6), r.rows, round(r.mass, 6)) for r in clusters.collect())
        return sorted((r.row, r.level) for r in joined.collect()), sizes

    assert result(10_000) == result(60)


def test_selection_by_stability():
    import pyarrow as pa

    # 1 and 2 meet in 3; what they have above it is more than 3 has below
    c = pa.table({"cluster": [1, 2, 3], "parent": [3, 3, -1], "level": [0.3, 0.3, 0.25], "mass": [Y.density(0.6) * 20, Y.density(0.6) * 30, Y.density(0.3) * 50], "rows": [20, 30, 50]})
    assert dict(zip(*Y.select_stable(c).to_pydict().values())) == {3: -1, 2: 2, 1: 1}
    assert dict(zip(*Y.select_stable(c, apart=0.3).to_pydict().values())) == {3: 3, 2: 3, 1: 3}
    thin = c.set_column(3, "mass", pa.array([Y.density(0.31) * 20, Y.density(0.31) * 30, Y.density(0.3) * 50]))
    assert dict(zip(*Y.select_stable(thin).to_pydict().values())) == {3: 3, 2: 3, 1: 3}


def test_led_pivots_find_the_nearest(monkeypatch):
    rng = np.random.default_rng(8)
    x, pivots = (V.unit(rng.standard_normal((n, 32)).astype(np.float32)) for n in (200, 600))
    flat = P.Pivots(pivots).orders(x, 4)
    monkeypatch.setattr(P, "FLAT", 100)
    led = P.Pivots(pivots).orders(x, 4)
    assert led.shape == flat.shape and np.mean([len(set(a) & set(b)) / 4 for a, b in zip(flat.tolist(), led.tolist())]) > 0.7


def test_candidates_by_footrule_before_cosines():
    rows = crowds([400, 300], spread=0.3)
    x = V.unit(np.stack([v for _, v in rows]).astype(np.float32))
    perm = P.orders(x, x[::20], 16)
    names = np.array([i for i, _ in rows], dtype=object)
    q, d, c = P.search_file(names, x, perm, 5, 48, None)
    all_q, all_d, _ = P.search_file(names, x, perm, 5, None, None)
    assert np.allclose(c, np.einsum("ij,ij->i", x[q], x[d]), atol=1e-5) and len(q) == len(all_q) == 5 * len(rows)
    assert {*zip(q.tolist(), d.tolist())} != {*zip(all_q.tolist(), all_d.tolist())}  # the footrule decides what is compared


def test_consecutive_ids(spark):
    df = spark.createDataFrame([("a", 1), ("c", 1), ("b", 1), ("x", 2), ("d", 3), ("e", 3)], "id string, cluster long")
    for parts in (1, 2, 5):
        assert {(r.id_a, r.id_b) for r in K.consecutive(df, parts).collect()} == {("a", "b"), ("b", "c"), ("d", "e")}


def test_pivoted_rows_are_independent():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 40)).astype(np.float32)
    x = V.unit(np.concatenate([base, base + 1e-4]))
    got = S.pivoted(x, 12)
    assert len(got) == 6 and len({g % 6 for g in got}) == 6


def test_subset_reaches_every_crowd(spark):
    rows = crowds([120, 30, 15, 8], spread=0.25)
    picked = S.varied_subset(table(spark, rows), 16).collect()
    assert {r.id[:3] for r in picked} == {"c00", "c01", "c02", "c03"}
    assert sorted(r.rank for r in picked) == list(range(1, 17)) and len({r.id for r in picked}) == 16
