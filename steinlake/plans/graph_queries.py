"""Registered queries on features of edges: frames of traces, distances of all atoms, places in chains; orders are structures, their lines residues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import rounded, total
from ..operators import features, structure
from .queries import query, read
from .table_queries import KNN_SQL, _nodes


def _minus_sql(a: str, b: str) -> str:
    return f"[{a}[1] - {b}[1], {a}[2] - {b}[2], {a}[3] - {b}[3]]"


def _dot_sql(a: str, b: str) -> str:
    return f"({a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3])"


def _cross_sql(a: str, b: str) -> str:
    return f"[{a}[2] * {b}[3] - {a}[3] * {b}[2], {a}[3] * {b}[1] - {a}[1] * {b}[3], {a}[1] * {b}[2] - {a}[2] * {b}[1]]"


def _unit_sql(a: str) -> str:
    return f"CASE WHEN {_dot_sql(a, a)} > 0 THEN list_transform({a}, lambda v: v / sqrt({_dot_sql(a, a)})) ELSE [0.0, 0.0, 0.0]::DOUBLE[] END"


def _dist_sql(a: str, b: str) -> str:
    return f"sqrt({_dot_sql(_minus_sql(a, b), _minus_sql(a, b))} + 1e-6)"


def _rbf_sql(d: str) -> str:
    return f"list_sum(list_transform(range(16), lambda k: exp(-power(({d} - (2 + k * 20 / 15.0)) / 1.25, 2))))"


ZERO = "[0.0, 0.0, 0.0]::DOUBLE[]"
FRAMES_SQL = KNN_SQL + f""", w1 AS (SELECT name, node, xyz, lead(xyz) OVER w AS nx, lag(xyz) OVER w AS pv, lag(node) OVER w IS NOT NULL AND lead(node, 2) OVER w IS NOT NULL AS inside FROM n WINDOW w AS (PARTITION BY name ORDER BY node)),
w2 AS (SELECT *, {_minus_sql('nx', 'xyz')} AS s FROM w1), w3 AS (SELECT *, CASE WHEN sqrt({_dot_sql('s', 's')}) > 2 AND sqrt({_dot_sql('s', 's')}) < 40 THEN list_transform(s, lambda v: v / sqrt({_dot_sql('s', 's')})) ELSE {ZERO} END AS u FROM w2),
w4 AS (SELECT *, lag(u) OVER w AS u2, lead(u) OVER w AS u0 FROM w3 WINDOW w AS (PARTITION BY name ORDER BY node)),
w5 AS (SELECT *, {_cross_sql('u2', 'u')} AS x2, {_cross_sql('u', 'u0')} AS x1, {_minus_sql('u2', 'u')} AS o FROM w4), w6 AS (SELECT *, {_unit_sql('x2')} AS n2, {_unit_sql('x1')} AS n1, {_unit_sql('o')} AS o1 FROM w5),
w7 AS (SELECT *, least(greatest(-{_dot_sql('u', 'u0')}, -1 + 1e-6), 1 - 1e-6) AS bond, least(greatest({_dot_sql('n2', 'n1')}, -1 + 1e-6), 1 - 1e-6) AS twist, sign({_dot_sql('u2', 'n1')}) AS side FROM w6),
fr AS MATERIALIZED (SELECT name, node, xyz, coalesce(pv, {ZERO}) AS before, coalesce(nx, {ZERO}) AS after, CASE WHEN inside THEN o1 ELSE {ZERO} END AS f1, CASE WHEN inside THEN n2 ELSE {ZERO} END AS f2, CASE WHEN inside THEN {_cross_sql('o1', 'n2')} ELSE {ZERO} END AS f3,
  CASE WHEN inside THEN [bond, sqrt(1 - bond * bond) * CASE WHEN side = 0 THEN 1.0 ELSE twist END, sqrt(1 - bond * bond) * side * sqrt(1 - twist * twist)] ELSE {ZERO} END AS angles FROM w7)"""


def _traces(spark, sf_dir):
    return structure.trace_frames(_nodes(spark, sf_dir), low=2.0, high=40.0)


@query(FRAMES_SQL + " SELECT name, node, round(angles[1], 6) + 0.0 AS bond, round(angles[2], 6) + 0.0 AS cosine, round(angles[3], 6) + 0.0 AS sine, round(f1[1], 6) + 0.0 AS f11, round(f2[2], 6) + 0.0 AS f22, round(f3[3], 6) + 0.0 AS f33 FROM fr")
def trace_frames(spark, sf_dir):
    """Frames and angles of the traces."""
    f = _traces(spark, sf_dir)
    at = lambda i, j: rounded(F.get(F.get("frame", i), j))
    return f.select("name", "node", *(rounded(F.get("angles", i)).alias(c) for i, c in enumerate(("bond", "cosine", "sine"))), at(0, 0).alias("f11"), at(1, 1).alias("f22"), at(2, 2).alias("f33"))


def _r(i: int, j: int) -> str:
    return "(" + " + ".join(f"a.f{k}[{i}] * b.f{k}[{j}]" for k in (1, 2, 3)) + ")"


TRACE_RBF_SQL = " + ".join(_rbf_sql(_dist_sql(f"a.{x}", f"b.{y}")) for x, y in ((("xyz" if x == "at" else x), ("xyz" if y == "at" else y)) for x, y in structure.TRACE_PAIRS))


@query(FRAMES_SQL + f""", e AS (SELECT r.name, src, dst, [{', '.join(_dot_sql(f'a.f{k}', _minus_sql('b.xyz', 'a.xyz')) for k in (1, 2, 3))}] AS du, {', '.join(f'{_r(i, j)} AS r{i}{j}' for i in (1, 2, 3) for j in (1, 2, 3))}, {TRACE_RBF_SQL} AS total
  FROM r JOIN fr a ON a.name = r.name AND a.node = src JOIN fr b ON b.name = r.name AND b.node = dst WHERE rank <= 3),
q AS (SELECT *, {_unit_sql('du')} AS d, [sign(r32 - r23) * 0.5 * sqrt(abs(1 + r11 - r22 - r33)), sign(r13 - r31) * 0.5 * sqrt(abs(1 - r11 + r22 - r33)), sign(r21 - r12) * 0.5 * sqrt(abs(1 - r11 - r22 + r33)), sqrt(greatest(1 + r11 + r22 + r33, 0)) / 2] AS q FROM e),
z AS (SELECT *, sqrt(list_sum(list_transform(q, lambda v: v * v))) AS m FROM q)
SELECT name, src, dst, round(d[1], 5) + 0.0 AS d1, round(d[2], 5) + 0.0 AS d2, round(d[3], 5) + 0.0 AS d3, CASE WHEN m > 0 THEN round(q[1] / m, 5) + 0.0 ELSE 0.0 END AS q1, CASE WHEN m > 0 THEN round(q[2] / m, 5) + 0.0 ELSE 0.0 END AS q2, CASE WHEN m > 0 THEN round(q[3] / m, 5) + 0.0 ELSE 0.0 END AS q3, CASE WHEN m > 0 THEN round(q[4] / m, 5) + 0.0 ELSE 0.0 END AS q4, round(total, 5) AS total FROM z""")
def ca_edge_features(spark, sf_dir):
    """Edges of traces: the direction in a node's frame, the rotation between the frames of both ends (zeros where it has no quaternion), and nine pairs' distances."""
    f = _traces(spark, sf_dir).withColumn("at", F.col("xyz"))
    e = structure.knn_ends(f, 3, ["xyz", "frame", "at", "before", "after"])
    e = structure.oriented_edges(structure.edge_rbf(e, structure.TRACE_PAIRS, sums=True))
    return e.select("name", "src", "dst", *(rounded(F.get("direction", k), 5).alias(f"d{k + 1}") for k in range(3)), *(rounded(F.get("rotation", k), 5).alias(f"q{k + 1}") for k in range(4)), rounded(total("p"), 5).alias("total"))


CB_SQL = "list_transform([1, 2, 3], lambda i: -0.58273431 * aa[i] + 0.56802827 * bb[i] - 0.54067466 * cc[i] + ca[i])"
BACKBONE_SQL = KNN_SQL + f""", b0 AS (SELECT name, node, xyz AS ca, [xyz[1] - 1.0, xyz[2] + 0.5, xyz[3] + xyz[1] / 40] AS n, [xyz[1] + 1.1, xyz[2] - xyz[3] / 9, xyz[3] + 0.7] AS c, [xyz[1] + 1.5, xyz[2] - 1.9, xyz[3] - xyz[2] / 7] AS o, l_partkey % 2 AS chain FROM n),
b1 AS (SELECT *, {_minus_sql('ca', 'n')} AS bb, {_minus_sql('c', 'ca')} AS cc FROM b0), b2 AS (SELECT *, {_cross_sql('bb', 'cc')} AS aa FROM b1), bk AS MATERIALIZED (SELECT *, {CB_SQL} AS cb FROM b2)"""


@query(BACKBONE_SQL + f""", e AS (SELECT r.name, src, dst, a.chain = b.chain AS same_chain, CAST(CASE WHEN a.chain = b.chain THEN least(greatest(src - dst + 32, 0), 64) ELSE 65 END AS INTEGER) AS class, [{', '.join(_rbf_sql(_dist_sql(f'a.{x}', f'b.{y}')) for x, y in structure.BACKBONE_PAIRS)}] AS p
  FROM r JOIN bk a ON a.name = r.name AND a.node = src JOIN bk b ON b.name = r.name AND b.node = dst WHERE rank <= 3)
SELECT name, src, dst, same_chain, class, round(list_sum(p), 5) AS total, round(p[5], 5) AS cb_cb, round(p[25], 5) AS c_o FROM e""")
def edge_atom_rbf(spark, sf_dir):
    """All 25 pairs of atoms of an edge's ends, on sixteen radial basis functions each, and the ends' places."""
    x, y, z = (F.get("xyz", k) for k in range(3))
    n = _nodes(spark, sf_dir).select("name", "node", "xyz", F.col("xyz").alias("ca"), F.array(x - 1.0, y + 0.5, z + x / 40).alias("n"), F.array(x + 1.1, y - z / 9, z + 0.7).alias("c"), F.array(x + 1.5, y - 1.9, z - y / 7).alias("o"), (F.col("l_partkey") % 2).alias("chain"), F.col("node").alias("residue_index"))
    e = structure.knn_ends(structure.backbone(n), 3, ["n", "ca", "c", "o", "cb", "chain", "residue_index"])
    same, place = structure.edge_places(F.col("a"), F.col("b"))
    basis = structure.edge_rbf(e, sums=True).select("name", "src", "dst", same.alias("same_chain"), place.alias("class"), "p")
    part = lambda k: rounded(F.get("p", k), 5)
    return basis.select("name", "src", "dst", "same_chain", "class", rounded(total("p"), 5).alias("total"), part(4).alias("cb_cb"), part(24).alias("c_o"))


# Residue tables: suppliers are structures, their lines of one flag and part are residues.

RESIDUE_SQL = """r AS MATERIALIZED (SELECT l_suppkey AS name, l_returnflag AS chain, l_partkey AS pos, min('ACDEFGHIKL'[l_linenumber + 1:l_linenumber + 1]) AS aa, min(l_quantity)::DOUBLE AS q, min(l_discount)::DOUBLE * 10 AS d, min(l_linenumber) AS k, bool_or(l_tax > 0.07) AS gone FROM lineitem GROUP BY 1, 2, 3)"""


def _residues(spark, sf_dir):
    # By structure while lines are narrow, for all that follows.
    line = read(spark, sf_dir, "lineitem").repartition("l_suppkey").groupBy(F.col("l_suppkey").alias("name"), F.col("l_returnflag").alias("chain"), F.col("l_partkey").alias("pos")).agg(
        F.min(F.substring(F.lit("ACDEFGHIKL"), F.col("l_linenumber") + 1, F.lit(1))).alias("aa"), F.min("l_quantity").cast("double").alias("q"), (F.min("l_discount").cast("double") * 10).alias("d"), F.min("l_linenumber").alias("k"), F.bool_or(F.col("l_tax") > 0.07).alias("gone"))
    point = F.array("q", "d", F.lit(1.0))
    return line.withColumns({"n": point, "ca": F.when(~F.col("gone"), point), "c": point, "o": point})


@query(f"""WITH {RESIDUE_SQL}, c AS (SELECT name, chain, count(*) AS n, name % 2 = 0 OR chain <> 'A' AS designed FROM r GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER w AS chain_no, coalesce(sum(n) OVER (PARTITION BY name ORDER BY designed DESC, chain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c WINDOW w AS (PARTITION BY name ORDER BY designed DESC, chain)),
p AS (SELECT r.*, o.n, designed, chain_no, row_number() OVER (PARTITION BY r.name, r.chain ORDER BY pos) - 1 AS i, s FROM r JOIN o USING (name, chain))
SELECT name, chain, pos, CAST(strpos('ACDEFGHIKLMNPQRSTVWYX', aa) - 1 AS INTEGER) AS letter, NOT gone AS observed, designed, designed AND k <> 2 AS free, CAST(CASE WHEN k = 3 THEN 2 ELSE 0 END AS INTEGER) AS omitted, CASE WHEN k = 4 THEN d ELSE 0.0 END::DOUBLE AS profile_weight, CASE WHEN k = 4 THEN q ELSE 1e4 END::DOUBLE AS odds,
  round(CASE WHEN k = 5 THEN 3 * d ELSE 0 END, 6)::DOUBLE AS bias_c, CASE WHEN k = 1 THEN CAST(pos % 3 AS VARCHAR) END AS tie, CASE WHEN k = 1 THEN -0.5 ELSE 1.0 END::DOUBLE AS beta, CAST(chain_no AS INTEGER) AS chain_no, CAST(s + i AS INTEGER) AS place, CAST(100 * (chain_no - 1) + s + i AS INTEGER) AS residue_index, i > 0 AS phi, i + 1 < n AS psi FROM p""")
def design_table(spark, sf_dir):
    """The whole input of designs: residues in the models' order with fixed places, omissions, profiles, biases and ties, from one exchange."""
    r = _residues(spark, sf_dir)
    key, seen = ["name", "chain", "pos"], r.select("name", "chain", "pos", "k", "q", "d")
    over = lambda v: F.array(*(v for _ in features.ALPHABET))
    out = features.design_table(
        r, designed=r.filter("name % 2 = 0 or chain <> 'A'").select("name", "chain").distinct(), fixed=seen.filter("k = 2").select(*key),
        omitted=seen.filter("k = 3").select(*key, F.explode(F.array(F.lit("A"), F.lit("CA"))).alias("letters")), profiles=seen.filter("k = 4").select(*key, F.col("d").alias("coef"), over(F.lit(0.5)).alias("bias"), over(F.col("q")).alias("log_odds")),
        bias=seen.filter("k = 5").select(*key, F.explode(F.array(F.struct(F.lit("C").alias("aa"), F.col("d").alias("bias")), F.struct(F.lit("C").alias("aa"), (2 * F.col("d")).alias("bias")))).alias("b")).select(*key, "b.*"),
        ties=seen.filter("k = 1").select(*key, (F.col("pos") % 3).alias("tie"), F.lit(-0.5).alias("beta"), F.lit(0).alias("member")), dealt=True,
    )
    return out.select(*key, "letter", "observed", "designed", "free", F.size(F.filter("omit", lambda x: x)).alias("omitted"), "profile_weight", F.get("log_odds", 7).alias("odds"), rounded(F.get("bias", 1)).alias("bias_c"), "tie", "beta", "chain_no", "place", "residue_index", "phi", "psi")


@query(f"""WITH {RESIDUE_SQL}, c AS (SELECT name, chain, count(*) AS n, string_agg(aa, '' ORDER BY pos) AS seq, md5('41:' || name || ':' || chain) AS h FROM r GROUP BY 1, 2), k AS (SELECT name, min(chain) AS chain FROM c GROUP BY 1),
m AS (SELECT c.*, bool_or(k.chain IS NOT NULL OR (name % 5 = 0 AND chain = 'R')) OVER (PARTITION BY name, seq) AS masked FROM c LEFT JOIN k USING (name, chain)),
o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY h, chain) AS chain_no, coalesce(sum(n) OVER (PARTITION BY name ORDER BY h, chain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM m)
SELECT name, chain, pos, CAST(strpos('ACDEFGHIKLMNPQRSTVWYX', aa) - 1 AS INTEGER) AS letter, NOT gone AS observed, masked, CAST(chain_no AS INTEGER) AS chain_no, CAST(s + row_number() OVER (PARTITION BY name, chain ORDER BY pos) - 1 AS INTEGER) AS place FROM r JOIN o USING (name, chain)""")
def training_table(spark, sf_dir):
    """The input of training: one chain of each structure is predicted, with those like it and those of its sequence; chains in a random order."""
    r = _residues(spark, sf_dir)
    picked = r.groupBy("name").agg(F.min("chain").alias("chain"))
    like = picked.filter("name % 5 = 0").withColumn("others", F.array(F.lit("R")))
    out = features.training_table(r, picked, like, seed="41")
    return out.select("name", "chain", "pos", "letter", "observed", "masked", "chain_no", "place")


@query(f"""WITH {RESIDUE_SQL}, p AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY chain, pos) AS i, aa, CASE WHEN gone THEN 0 ELSE q END AS q FROM r)
SELECT name, CAST(count(*) AS INTEGER) AS length, string_agg(aa, '' ORDER BY i) AS seq, round(sum(q), 6)::DOUBLE AS total FROM p GROUP BY 1""")
def structure_forms(spark, sf_dir):
    """The same table as one row per structure, coordinates that were not observed being zeros."""
    # Only what is read below: a gathered struct keeps every column that is put into it.
    table = features.design_table(_residues(spark, sf_dir)).select("name", "place", "aa", "ca", "observed")
    whole = features.form(table, "file", atoms=("ca",))
    return whole.select("name", "length", F.array_join("aa", "").alias("seq"), rounded(F.aggregate("ca", F.lit(0.0), lambda s, p: s + F.get(p, 0))).alias("total"))
