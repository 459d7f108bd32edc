"""Chain and trace features on small structures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steinlake.operators import structure


def test_trace_angles(spark):
    rng = np.random.default_rng(3)
    x = [np.zeros(3)]
    for k in range(7):
        u = rng.normal(size=3)
        x.append(x[-1] + (3.8 if k != 4 else 5.0) * u / np.linalg.norm(u))
    df = spark.createDataFrame([("s", "A", k, v.tolist()) for k, v in enumerate(x)], "name string, chain string, pos int, xyz array<double>")
    got = structure.trace_angles(df, ["name", "chain"], "pos", "xyz").orderBy("pos").collect()
    d = [b - a for a, b in zip(x, x[1:], strict=False)]
    good = [3.6 < np.linalg.norm(v) < 4.0 for v in d]
    u = [v / np.linalg.norm(v) for v in d]
    for k, r in enumerate(got):
        bend = k >= 1 and k < 7 and good[k - 1] and good[k]
        assert r.cos_bend == pytest.approx(u[k - 1] @ u[k] if bend else 0.0)
        if k >= 2 and k < 7 and all(good[k - 2 : k + 1]):
            n1, n2 = np.cross(u[k - 2], u[k - 1]), np.cross(u[k - 1], u[k])
            angle = math.copysign(math.acos(np.clip(n1 @ n2 / np.linalg.norm(n1) / np.linalg.norm(n2), -1, 1)), u[k - 2] @ n2)
            assert (r.cos_twist, r.sin_twist) == (pytest.approx(math.cos(angle)), pytest.approx(math.sin(angle)))
        else:
            assert (r.cos_twist, r.sin_twist) == (0.0, 0.0)


def test_chain_pairs(spark):
    df = spark.createDataFrame([("s", "A", "B", 0.9, 0.8, 0.95)], "name string, chain_a string, chain_b string, tm_a double, tm_b double, seqid double")
    out = structure.chain_pairs(df, ["name"], "chain", {"tm_a": ("tm_b", F.lit(1.0)), "tm_b": ("tm_a", F.lit(1.0)), "seqid": ("seqid", F.lit(1.0))})
    assert {(r.chain_a, r.chain_b): (r.tm_a, r.tm_b) for r in out.collect()} == {("A", "B"): (0.9, 0.8), ("B", "A"): (0.8, 0.9), ("A", "A"): (1.0, 1.0), ("B", "B"): (1.0, 1.0)}
    assert {r.chain: r.others for r in structure.homologous(out, ["name"]).collect()} == {"A": ["A", "B"], "B": ["A", "B"]}


def test_promote_identical(spark):
    df = spark.createDataFrame([("s", "A", "ACD", True), ("s", "B", "ACD", False), ("s", "C", "EEE", False), ("t", "A", "ACD", False)], "name string, chain string, seq string, masked boolean")
    out = structure.promote_identical(df, ["name"])
    assert {(r.name, r.chain): r.masked for r in out.collect()} == {("s", "A"): True, ("s", "B"): True, ("s", "C"): False, ("t", "A"): False}


def test_edges(spark):
    n = spark.createDataFrame([("s", k, [float(k), 0.0, 0.0]) for k in (0, 1, 2, 5)], "name string, node int, xyz array<double>")
    seq = structure.sequential_edges(n)
    assert {(r.src, r.dst) for r in seq.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0)}
    both = structure.edge_union(structure.knn_edges(n, 2).filter("src <> dst"), seq)
    kinds = {(r.src, r.dst): r.kinds for r in both.collect()}
    assert kinds[(0, 1)] == [0, 1] and kinds[(5, 2)] == [0] and kinds[(0, 2)] == [1]


def test_features_without_sql(spark):
    r = spark.range(1).select(structure.relative_class(F.lit(-40), F.lit(True)), structure.relative_class(F.lit(3), F.lit(True)), structure.relative_class(F.lit(3), F.lit(False))).first()
    assert tuple(r) == (0, 35, 65)
    p = spark.range(1).select(structure.affine(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), [[0, -1, 0], [1, 0, 0], [0, 0, 1]], [5, 0, 0])).first()[0]
    assert p == [3.0, 1.0, 3.0]


def test_assembly_search(spark):
    """Chain names are matched whole, blanks do not matter, a chain named twice counts once, and nulls match nothing."""
    a = spark.createDataFrame([("p", 1, "A, B"), ("p", 2, "AB,C,C"), ("q", 1, "A"), ("q", 2, None)], "name string, id int, chains string")
    w = spark.createDataFrame([("p", "A"), ("p", "C"), ("p", "C"), ("q", "B"), (None, None)], "name string, chain string")
    assert sorted((r.name, r.chain, r.id) for r in structure.assemblies_with(a, w).collect()) == [("p", "A", 1), ("p", "C", 2)]


def brute_knn(rows, k):
    """Plain search: valid nodes by distance, then masked ones in order at the farthest distance."""
    out = set()
    for name, i, p, ok in rows:
        mine = [(j, q, m) for n, j, q, m in rows if n == name]
        if ok:
            near = sorted((math.sqrt(((np.array(p) - np.array(q)) ** 2).sum() + 1e-6), j) for j, q, m in mine if m)
            far = near[-1][0]
            near += [(far, j) for j in sorted(j for j, _, m in mine if not m)]
        else:
            near = [(0.0, j) for j in sorted(j for j, _, _ in mine)]
        out |= {(name, i, j, r, round(d, 9)) for r, (d, j) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("valid", [1.0, 0.9, 0.01])
def test_knn_by_cells_is_exact(spark, monkeypatch, valid):
    monkeypatch.setattr(structure, "WHOLE", 20)
    rng = np.random.default_rng(2)
    rows = []
    for name, n, make in (("ball", 150, lambda: rng.normal(size=3)), ("line", 90, lambda: np.array([rng.random() * 100, 0, 0])), ("clumps", 120, lambda: rng.integers(0, 3, 3) * 50.0 + rng.normal(size=3) * 0.01), ("point", 40, lambda: np.ones(3)), ("few", 12, lambda: rng.normal(size=3))):
        rows += [(name, k, make().tolist(), bool(rng.random() < valid) or k == 0) for k in range(n)]
    df = spark.createDataFrame(rows, "name string, node int, xyz array<double>, ok boolean")
    got = structure.knn_edges(df, 7, mask="ok").collect()
    assert {(r.name, r.src, r.dst, r.rank, round(r.dist, 9)) for r in got} == brute_knn(rows, 7)
    assert len(got) == 7 * len(rows)


def test_cells_join_in_proportion_to_nodes(spark, monkeypatch):
    """Rows that meet in the joins by cells, for one structure of n and of 4 n nodes of the same density."""
    import re

    def met(n):
        side = (n / 0.05) ** (1 / 3)
        rng = np.random.default_rng(n)
        df = spark.createDataFrame([("s", k, (rng.random(3) * side).tolist()) for k in range(n)], "name string, node int, xyz array<double>").repartition(2)
        monkeypatch.setattr(structure, "FEW", 10)
        edges = structure.radius_edges(df, 4.0)
        count = edges.count()
        seen = structure._near_cells(df.select("name", F.col("node").alias("src"), F.col("xyz").alias("p")), "p", F.lit(4.0)).join(df.select("name", F.col("node").alias("dst"), *(c.alias(f"_c{i}") for i, c in enumerate(structure._cell("xyz", F.lit(4.0))))), ["name", "_c0", "_c1", "_c2"]).count()
        assert "SortMergeJoin" in (text := edges._jdf.queryExecution().toString()) or "HashJoin" in text
        assert not re.search("CartesianProduct|NestedLoop", text)
        return count, seen

    small, large = met(1500), met(6000)
    assert large[0] < 5 * small[0] and large[1] < 5 * small[1] and large[1] < 6000 * 100


@pytest.mark.parametrize("few", [5, 500])
def test_radius_edges_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(structure, "FEW", few)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(80, 3)) * 6 - 3, [[-6.0, 0, 0], [0, 0, 0], [6.0, 0, 0]]])
    df = spark.createDataFrame([("s", k, v.tolist()) for k, v in enumerate(x)] + [("s", 900, None), ("s", 901, [1.0, float("nan"), 0.0])], "name string, node int, xyz array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    for apart in (0, 3):
        expected = {(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and d[i, j] < 6.0 and abs(i - j) >= apart}
        assert {(r.src, r.dst) for r in structure.radius_edges(df, 6.0, apart=apart).collect()} == expected


def test_edge_features_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = [np.zeros(3)]
    for k in range(11):
        u = rng.normal(size=3)
        x.append(x[-1] + (3.8 if k != 6 else 5.0) * u / np.linalg.norm(u))
    x = np.array(x)
    n = len(x)
    df = spark.createDataFrame([("s", k, v.tolist()) for k, v in enumerate(x)], "name string, node int, xyz array<double>")
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v
    u = [unit(b - a) if 3.6 < np.linalg.norm(b - a) < 4 else np.zeros(3) for a, b in zip(x, x[1:], strict=False)]
    frames, angles = np.zeros((n, 3, 3)), np.zeros((n, 3))
    for p in range(1, n - 2):
        n2, n1, o = unit(np.cross(u[p - 1], u[p])), unit(np.cross(u[p], u[p + 1])), unit(u[p - 1] - u[p])
        frames[p] = [o, n2, np.cross(o, n2)]
        a, d = np.arccos(np.clip(-u[p] @ u[p + 1], -1 + 1e-6, 1 - 1e-6)), np.sign(u[p - 1] @ n1) * np.arccos(np.clip(n2 @ n1, -1 + 1e-6, 1 - 1e-6))
        angles[p] = [np.cos(a), np.sin(a) * np.cos(d), np.sin(a) * np.sin(d)]
    told = structure.trace_frames(df).orderBy("node").collect()
    assert np.array([r.angles for r in told]) == pytest.approx(angles, abs=1e-9) and np.array([r.frame for r in told]) == pytest.approx(frames, abs=1e-9)
    e = structure.along_edges(structure.knn_edges(df, 5), structure.trace_frames(df), ["xyz", "frame"])
    for r in structure.oriented_edges(e).select("src", "dst", F.col("direction").alias("d"), F.col("rotation").alias("q")).collect():
        assert r.d == pytest.approx(unit(frames[r.src] @ (x[r.dst] - x[r.src])), abs=1e-9)
        m = frames[r.src].T @ frames[r.dst]
        if abs(np.linalg.det(m) - 1) < 1e-6 and np.trace(m) > -0.9:
            i, j, k, w = r.q
            back = np.array([[1 - 2 * (j * j + k * k), 2 * (i * j - k * w), 2 * (i * k + j * w)], [2 * (i * j + k * w), 1 - 2 * (i * i + k * k), 2 * (j * k - i * w)], [2 * (i * k - j * w), 2 * (j * k + i * w), 1 - 2 * (i * i + j * j)]])
            assert back == pytest.approx(m, abs=1e-6)


def test_edge_rbf_by_hand(spark):
    """All pairs of an edge's atoms on their centres; an atom without a coordinate has nulls, in its pairs only."""
    rng = np.random.default_rng(3)
    atoms = ("n", "ca", "c", "o", "cb")
    ends = [[{x: rng.normal(size=3).tolist() for x in atoms} for _ in "ab"] for _ in range(5)]
    ends[4][1]["o"] = [1.0, None, 2.0]
    kind = "struct<" + ", ".join(f"{x}: array<double>" for x in atoms) + ">"
    edges = spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], f"k int, a {kind}, b {kind}")
    got = {r.k: r.p for r in structure.edge_rbf(edges, count=3, low=0.0, high=4.0, width=0.5).collect()}
    for k, (a, b) in enumerate(ends):
        want = []
        for x, y in structure.BACKBONE_PAIRS:
            if None in a[x] + b[y]:
                want += [None] * 3
                continue
            d = (sum((u - v) ** 2 for u, v in zip(a[x], b[y], strict=True)) + 1e-6) ** 0.5
            want += [np.exp(-(((d - c) / 0.5) ** 2)) for c in (0.0, 2.0, 4.0)]
        assert [v is None for v in got[k]] == [v is None for v in want]
        assert np.allclose([v for v in got[k] if v is not None], [v for v in want if v is not None])
    assert structure.edge_rbf(edges.filter("k > 9")).count() == 0


@pytest.mark.parametrize("whole", [512, 4])
def test_ends_of_nearest_edges_are_those_of_joins(spark, monkeypatch, whole):
    """Nodes bring their columns along, through arrays (no join) and through cells, masked ones as well; a node without a number is no end."""
    monkeypatch.setattr(structure, "WHOLE", whole)
    rng = np.random.default_rng(5)
    rows = [(name, k, rng.normal(size=3).tolist(), bool(rng.random() < 0.8), f"{name}{k}", float(k)) for name, n in (("s", 9), ("t", 4), ("u", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "name string, node int, xyz array<double>, ok boolean, told string, at double")
    got = structure.knn_ends(df, 3, ["told", "at"], mask="ok")
    want = structure.along_edges(structure.knn_edges(df, 3, mask="ok"), df, ["told", "at"])
    columns = ["name", "src", "dst", "rank", "dist", "a", "b"]
    found = sorted(map(tuple, got.select(columns).collect()))
    assert found == sorted(map(tuple, want.select(columns).collect())) and len(found) == 3 * 9 + 3 * 4 + 1
    if whole == 512:
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
        more = df.unionByName(spark.createDataFrame([("s", None, [9.0, 9.0, 9.0], True, "none", 0.0)], df.schema))
        want = structure.along_edges(structure.knn_edges(more, 3, mask="ok"), more, ["told", "at"])
        assert sorted(map(tuple, structure.knn_ends(more, 3, ["told", "at"], mask="ok").select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_sums_of_edge_rbf(spark):
    """One sum for each pair of atoms leaves the workers in place of the values; null where an atom has no coordinate."""
    rng = np.random.default_rng(6)
    rows = [(k, *({"ca": rng.normal(size=3).tolist(), "n": [1.0, None, 2.0] if k == 2 else rng.normal(size=3).tolist()} for _ in "ab")) for k in range(4)]
    kind = "struct<ca: array<double>, n: array<double>>"
    edges = spark.createDataFrame(rows, f"k int, a {kind}, b {kind}")
    pairs = (("ca", "ca"), ("ca", "n"), ("n", "n"))
    both = structure.edge_rbf(structure.edge_rbf(edges, pairs, sums=True), pairs, "q").orderBy("k").collect()
    for r in both:
        parts = [r.q[16 * i : 16 * i + 16] for i in range(3)]
        assert r.p == [None if None in v else pytest.approx(sum(v), abs=1e-12) for v in parts]
    assert both[2].p[0] is not None and both[2].p[1:] == [None, None]


@pytest.mark.parametrize("name", ["edge_atom_rbf", "ca_edge_features"])
def test_edge_features_join_nothing(spark, name):
    """Both ends of an edge come from its structure's array, and lines are exchanged once, by structure."""
    from steinlake.plans import graph_queries

    plan = getattr(graph_queries, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Exchange") == 1


def test_design_table_exchanges_narrow_lines_only(spark):
    """Every exchange is one of lines by structure; wide residues and rules are not exchanged again."""
    import re

    from steinlake.plans import graph_queries

    plan = graph_queries.design_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    kinds = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert kinds and set(kinds) == {"l_suppkey"} and plan.count("Exchange ") == len(kinds)
