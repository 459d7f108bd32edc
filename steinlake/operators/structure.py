"""Structures as residue tables (name, chain, pos, ...): neighbours, geometry and chain bookkeeping.

A structure is a bounded group, so windows and self-joins are keyed by its name and never cross structures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import sqdist

#: Nodes up to which a structure's nodes meet all in one row; larger structures are searched by cells.
WHOLE, FEW = 512, 64


def knn_edges(nodes: DataFrame, k: int, name: str = "name", node: str = "node", xyz: str = "xyz", mask: str | None = None) -> DataFrame:
    """(name, src, dst, rank, dist): the k nearest nodes of each node, itself among them; ties to the smaller dst.

    Distances are sqrt(sum of squares + 1e-6), 0 where an end is masked. Masked nodes come after all others, in order of dst, and count as far as the
    farthest of those; a masked node's own row is in order of dst. Small structures meet as arrays, one row each, with one exchange; structures of
    more than WHOLE nodes are searched by cells (whether there are any is asked when this is called).
    """
    return _knn(nodes, k, [], name, node, xyz, mask).drop("a", "b")


def knn_ends(nodes: DataFrame, k: int, columns: list[str], name: str = "name", node: str = "node", xyz: str = "xyz", mask: str | None = None) -> DataFrame:
    """knn_edges with structs a and b of the nodes' columns at both ends. Nodes that meet as arrays bring their columns along, so no join
    follows; only the ends of larger structures are joined to their edges. A node is one row; as in a join, one without a name or number is no end.
    """
    found = _knn(nodes, k, columns, name, node, xyz, mask)
    return found.filter(F.col(name).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())


def _knn(nodes: DataFrame, k: int, columns: list[str], name: str, node: str, xyz: str, mask: str | None) -> DataFrame:
    brought = F.struct(*columns) if columns else F.lit(None)
    n = nodes.select(F.col(name).alias("name"), F.col(node).alias("node"), F.col(xyz).alias("xyz"), F.coalesce(F.col(mask), F.lit(False)).alias("ok") if mask else F.lit(True).alias("ok"), brought.alias("f"))
    sizes = n.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE).select("name")
    if sizes.isEmpty():
        found = _knn_whole(n, k)
    else:
        large = n.join(sizes, "name", "left_semi").checkpoint()
        far = _knn_large(large, k)
        if columns:
            far = along_edges(far, large, ["f"]).withColumns({"a": F.col("a.f"), "b": F.col("b.f")})
        found = _knn_whole(n.join(sizes, "name", "left_anti"), k).unionByName(far, allowMissingColumns=True)
    return found.select(F.col("name").alias(name), "src", "dst", "rank", "dist", "a", "b")


def _knn_whole(n: DataFrame, k: int) -> DataFrame:
    every = n.groupBy("name").agg(F.collect_list(F.struct("node", "xyz", "ok", "f")).alias("nodes"))
    each = every.select("name", "nodes", F.explode("nodes").alias("q"))
    both = lambda o: o["ok"] & F.col("q.ok")
    # A node's place in the array leads back to its columns, which take no part in the order.
    d = F.transform("nodes", lambda o, i: F.struct((~both(o)).alias("last"), F.when(both(o), F.sqrt(sqdist(F.col("q.xyz"), o["xyz"]) + 1e-6)).otherwise(0.0).alias("d"), o["node"].alias("dst"), i.alias("i")))
    wide = each.select("name", "nodes", "q", F.array_sort(d).alias("d"))
    near = F.transform(F.slice("d", 1, k), lambda e: F.struct(e["last"].alias("last"), e["d"].alias("d"), e["dst"].alias("dst"), F.get("nodes", e["i"])["f"].alias("f")))
    out = wide.select("name", "q", F.array_max(F.transform("d", lambda x: x["d"])).alias("far"), F.posexplode(near).alias("rank", "e"))
    return out.select("name", F.col("q.node").alias("src"), F.col("e.dst").alias("dst"), (F.col("rank") + 1).alias("rank"), F.when(F.col("e.last"), F.col("far")).otherwise(F.col("e.d")).alias("dist"), F.col("q.f").alias("a"), F.col("e.f").alias("b"))


def _knn_large(n: DataFrame, k: int) -> DataFrame:
    """Large structures: the nearest by cells, then masked nodes where there are not k others."""
    found = nearest_by_cells(n.filter("ok"), k)
    w = Window.partitionBy("name").orderBy("node")
    masked = n.filter(~F.col("ok"))
    if masked.isEmpty():
        return found
    head = lambda rows: rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("name", F.col("node").alias("dst"), "r")  # noqa: E731  at most k of a structure
    have = found.groupBy("name", "src").agg(F.count(F.lit(1)).alias("have"), F.max("dist").alias("far")).filter(F.col("have") < k)
    more = have.join(head(masked), "name").withColumn("rank", (F.col("have") + F.col("r")).cast("int")).filter(F.col("rank") <= k).select("name", "src", "dst", "rank", F.col("far").alias("dist"))
    own = masked.select("name", F.col("node").alias("src")).join(head(n), "name").select("name", "src", "dst", F.col("r").cast("int").alias("rank"), F.lit(0.0).alias("dist"))
    return found.unionByName(more).unionByName(own)


def _cell(xyz, h: Column) -> list[Column]:
    return [F.floor(F.get(xyz, i) / h).cast("long") for i in range(3)]


def _near_cells(rows: DataFrame, xyz: str, h: Column) -> DataFrame:
    """rows, once for each of the 27 cells around their own."""
    offsets = F.array(*(F.array(*(F.lit(x) for x in (i, j, l))) for i in (-1, 0, 1) for j in (-1, 0, 1) for l in (-1, 0, 1)))
    wide = rows.withColumn("_o", F.explode(offsets))
    return wide.withColumns({f"_c{i}": c + F.get("_o", i) for i, c in enumerate(_cell(xyz, h))}).drop("_o")


def nearest_by_cells(n: DataFrame, k: int) -> DataFrame:
    """(name, src, dst, rank, dist) of n(name, node, xyz): the k nearest, by cells that grow for the nodes that need it.

    A round joins each open node to the 27 cells around it: all nodes within a cell's width are there. A node is done when its k-th neighbour lies within that
    width, or all nodes of the structure were met; the others go on with cells of twice the width. The first width has about k nodes to a cell,
    so the joined rows grow with the nodes, and a round costs a job.
    """
    n = n.filter(F.col("xyz").isNotNull() & F.forall("xyz", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    sides = [F.max(F.get("xyz", i)) - F.min(F.get("xyz", i)) for i in range(3)]
    shape = n.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.greatest(*sides).alias("side"))
    width = F.greatest(F.col("side") / F.greatest(F.floor(F.cbrt(F.col("n") / k)), F.lit(1)), F.lit(1e-6))
    placed = n.join(shape.select("name", "n", width.alias("h")), "name").checkpoint()
    rest, done = placed.select("name", F.col("node").alias("src"), F.col("xyz").alias("q"), "n", "h"), None
    order = Window.partitionBy("name", "src").orderBy("dist", "dst")
    whole = Window.partitionBy("name", "src")
    scale = 1.0
    while not rest.isEmpty():
        h = F.col("h") * scale
        others = placed.select("name", F.col("node").alias("dst"), F.col("xyz").alias("p"), *(c.alias(f"_c{i}") for i, c in enumerate(_cell("xyz", h))))
        met = _near_cells(rest, "q", h).join(others, ["name", "_c0", "_c1", "_c2"]).select("name", "src", "q", "n", "h", "dst", sqdist("q", "p").alias("d2"))
        ranked = met.withColumn("dist", F.sqrt(F.col("d2") + 1e-6)).withColumn("rank", F.row_number().over(order)).withColumn("met", F.count(F.lit(1)).over(whole)).filter(F.col("rank") <= k)
        # Complete: the k-th lies within the width, or nothing is left to meet.
        sure = F.max(F.when(F.col("rank") == k, F.sqrt("d2") <= F.col("h") * scale)).over(whole)
        ranked = ranked.withColumn("sure", F.coalesce(sure, F.lit(False)) | (F.col("met") == F.col("n"))).checkpoint()
        sure_rows = ranked.filter("sure").select("name", "src", "dst", "rank", "dist")
        done = sure_rows if done is None else done.unionByName(sure_rows)
        rest = ranked.filter("not sure and rank = 1").select("name", "src", "q", "n", "h")
        scale *= 2
    return done if done is not None else n.select("name", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1).alias("rank"), F.lit(0.0).alias("dist"))


def rbf(dist: Column, low: float = 2.0, high: float = 22.0, count: int = 16, width: float = 1.25) -> Column:
    """Radial basis values of a distance (a column, not an expression, as each function reads it) on evenly spaced centres."""
    step = (high - low) / (count - 1)
    z = [(dist - (low + i * step)) / width for i in range(count)]
    return F.array(*(F.exp(-(v * v)) for v in z))


def virtual_beta(n: Column, ca: Column, c: Column) -> list[Column]:
    """The coordinates of an idealised C-beta from the backbone."""
    b = [F.get(ca, i) - F.get(n, i) for i in range(3)]
    d = [F.get(c, i) - F.get(ca, i) for i in range(3)]
    a = [b[1] * d[2] - b[2] * d[1], b[2] * d[0] - b[0] * d[2], b[0] * d[1] - b[1] * d[0]]
    # The geometry of an ideal alanine.
    return [-0.58273431 * a[i] + 0.56802827 * b[i] - 0.54067466 * d[i] + F.get(ca, i) for i in range(3)]


def residue_index(df: DataFrame, name: str, chain: str, pos: str, gap: int = 100) -> DataFrame:
    """df with residue_index: consecutive over a structure, plus a gap for every chain before."""
    w = Window.partitionBy(name)
    place = F.row_number().over(w.orderBy(chain, pos)) - 1
    number = F.dense_rank().over(w.orderBy(chain)) - 1
    return df.withColumn("residue_index", gap * number + place)


def chain_offsets(df: DataFrame, name: str, chain: str) -> DataFrame:
    """(name, chain, length, start): lengths of chains and where each begins."""
    sizes = df.groupBy(name, chain).agg(F.count(F.lit(1)).alias("length"))
    w = Window.partitionBy(name).orderBy(chain).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("length").over(w), F.lit(0)))


def torsion_masks(df: DataFrame, chain: list[str], pos: str) -> DataFrame:
    """df with phi, psi, omega: whether the residue before, the one after, and again the one after are consecutive."""
    w = Window.partitionBy(*chain).orderBy(pos)
    before = F.coalesce(F.col(pos) - F.lag(pos).over(w) == 1, F.lit(False))
    after = F.coalesce(F.lead(pos).over(w) - F.col(pos) == 1, F.lit(False))
    return df.withColumns({"phi": before, "psi": after, "omega": after})


def fill_gaps(df: DataFrame, chain: list[str], pos: str, value: str, unknown: str = "X") -> DataFrame:
    """(chain, pos, value, observed): every place from the first to the last, unknown where nothing was observed."""
    whole = df.groupBy(*chain).agg(F.min(pos).alias("_a"), F.max(pos).alias("_b"))
    places = whole.select(*chain, F.explode(F.sequence("_a", "_b")).alias(pos))
    got = df.select(*chain, pos, value).withColumn("observed", F.lit(True))
    out = places.join(got, [*chain, pos], "left")
    return out.select(*chain, pos, F.coalesce(F.col(value).cast("string"), F.lit(unknown)).alias(value), F.coalesce("observed", F.lit(False)).alias("observed"))


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key (ties by the other columns), by a pre-aggregated minimum rather than a window over the group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(order), *rest)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def max_occupancy(df: DataFrame, keys: list[str], value: str, occupancy: str, tie: str) -> DataFrame:
    """(keys, value): the value of largest occupancy, ties to the least `tie`, then the largest value."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(F.col(occupancy), -F.col(tie), F.col(value))).alias(value))


def affine(xyz: Column, rotation: list[list[float]], shift: list[float]) -> Column:
    """A rotated and shifted point."""
    return F.array(*(sum((F.get(xyz, j) * rotation[i][j] for j in range(3)), F.lit(0.0)) + shift[i] for i in range(3)))


def relative_class(offset: Column, same_chain: Column, most: int = 32) -> Column:
    """The class of a relative position: clipped and shifted to 0 .. 2 * most, one more for another chain."""
    return F.when(same_chain, F.least(F.greatest(offset + most, F.lit(0)), F.lit(2 * most))).otherwise(2 * most + 1)


def centred(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Coordinates less their mean over the structure; nulls stay null and do not count."""
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)


def _cross(a: Column, b: Column) -> Column:
    g = [(F.get(a, i), F.get(b, i)) for i in range(3)]
    return F.array(*(g[i][0] * g[j][1] - g[j][0] * g[i][1] for i, j in ((1, 2), (2, 0), (0, 1))))


def _unit(a: Column) -> Column:
    n = F.sqrt(_dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0))


# The same on points of three numbers, written out: no lambdas, so they are compiled, and equal parts are computed once.


def _three(a: Column) -> list[Column]:
    return [F.get(a, i) for i in range(3)]


def _minus3(a: Column, b: Column) -> Column:
    return F.array(*(x - y for x, y in zip(_three(a), _three(b), strict=True)))


def _dot3(a: Column, b: Column) -> Column:
    (x, y, z), (u, v, w) = _three(a), _three(b)
    return x * u + y * v + z * w


def _unit3(a: Column) -> Column:
    n = F.sqrt(_dot3(a, a))
    return F.array(*(F.when(n > 0, x / n).otherwise(0.0) for x in _three(a)))


def distance3(a: Column, b: Column) -> Column:
    """sqrt(sum of squares + 1e-6) of two points."""
    d = [x - y for x, y in zip(_three(a), _three(b), strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 1e-6)


def trace_angles(df: DataFrame, chain: list[str], pos: str, xyz: str, low: float = 3.6, high: float = 4.0) -> DataFrame:
    """df with cos_bend, cos_twist and sin_twist of the C-alpha trace: the angle of the steps into and out of a residue, and
    the dihedral of the step before, into and out of it. A step whose length is outside the bounds counts as none, and an
    angle with such a step, or at an end, is 0.
    """
    w = Window.partitionBy(*chain).orderBy(pos)  # a chain is a bounded group
    step = _minus(F.lead(xyz).over(w), F.col(xyz))
    out = df.withColumn("_s", step).withColumn("_n", F.sqrt(_dot(F.col("_s"), F.col("_s"))))
    out = out.withColumn("_u", F.when((F.col("_n") > low) & (F.col("_n") < high), F.transform("_s", lambda x: x / F.col("_n"))))
    out = out.withColumn("_u1", F.lag("_u").over(w)).withColumn("_u2", F.lag("_u", 2).over(w))
    n1, n2 = _unit(_cross(F.col("_u2"), F.col("_u1"))), _unit(_cross(F.col("_u1"), F.col("_u")))
    clip = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))  # noqa: E731  least and greatest skip nulls
    cos_twist, side = clip(_dot(n1, n2)), F.signum(_dot(F.col("_u2"), n2))
    return out.withColumns({"cos_bend": F.coalesce(clip(_dot(F.col("_u1"), F.col("_u"))), F.lit(0.0)), "cos_twist": F.coalesce(cos_twist, F.lit(0.0)), "sin_twist": F.coalesce(side * F.sqrt(1 - cos_twist * cos_twist), F.lit(0.0))}).drop("_s", "_n", "_u", "_u1", "_u2")


def chain_pairs(df: DataFrame, keys: list[str], chain: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """All ordered pairs of chains of a structure from measured pairs a < b: mirrored, and each with itself.

    df has keys, chain_a, chain_b and the named columns; values gives, for each, its mirrored column and its own-pair value.
    """
    swapped = df.select(*keys, F.col(f"{chain}_b").alias(f"{chain}_a"), F.col(f"{chain}_a").alias(f"{chain}_b"), *(F.col(m).alias(c) for c, (m, _) in values.items()))
    ends = df.select(*keys, F.explode(F.array(f"{chain}_a", f"{chain}_b")).alias(f"{chain}_a")).distinct()
    own = ends.select(*keys, f"{chain}_a", F.col(f"{chain}_a").alias(f"{chain}_b"), *(v.alias(c) for c, (_, v) in values.items()))
    return df.select(*keys, f"{chain}_a", f"{chain}_b", *values).unionByName(swapped).unionByName(own)


def homologous(pairs: DataFrame, keys: list[str], chain: str = "chain", identity: str = "seqid", least: float = 0.7) -> DataFrame:
    """(keys, chain, others): chains of sequence identity above a bound."""
    return pairs.filter(F.col(identity) > least).groupBy(*keys, F.col(f"{chain}_a").alias(chain)).agg(F.array_sort(F.collect_set(f"{chain}_b")).alias("others"))


def promote_identical(chains: DataFrame, keys: list[str], seq: str = "seq", masked: str = "masked") -> DataFrame:
    """chains with masked also true where an equal sequence of the same structure is masked."""
    hidden = chains.filter(F.col(masked)).select(*keys, seq).distinct().withColumn("_h", F.lit(True))
    out = chains.join(hidden, [*keys, seq], "left")
    return out.withColumn(masked, F.col(masked) | F.coalesce("_h", F.lit(False))).drop("_h")


def assemblies_with(assemblies: DataFrame, wanted: DataFrame, chain: str = "chain", chains: str = "chains") -> DataFrame:
    """Rows of assemblies(name, chains, ...), chains being a comma list, that hold a wanted (name, chain), once for each such chain.

    The lists are opened and joined by equality, so a list is read once whatever is wanted.
    """
    opened = assemblies.withColumn(chain, F.explode(F.array_distinct(F.transform(F.split(chains, ","), lambda c: F.trim(c)))))
    return opened.join(wanted.select("name", chain).distinct(), ["name", chain])


def edge_union(*edges: DataFrame) -> DataFrame:
    """One edge table of several (spatial, nearest, sequential), each (name, src, dst) once with its kinds."""
    out = None
    for k, e in enumerate(edges):
        one = e.select("name", "src", "dst", F.lit(k).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("name", "src", "dst").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def sequential_edges(nodes: DataFrame, reach: int = 2, name: str = "name", node: str = "node") -> DataFrame:
    """Edges between nodes at most `reach` apart in number, by equi-joins."""
    a = nodes.select(F.col(name).alias("name"), F.col(node).alias("src"))
    wide = a.withColumn("dst", F.explode(F.sequence(F.col("src") - reach, F.col("src") + reach))).filter("src <> dst")
    return wide.join(nodes.select(F.col(name).alias("name"), F.col(node).alias("dst")), ["name", "dst"], "left_semi").select("name", "src", "dst")


def decoding_order(df: DataFrame, name: str, pos: str, mask: Column, noise: Column) -> DataFrame:
    """df with rank from 0: places in the order of (mask + 1e-4) * |noise|, so that masked-out (fixed) places come first."""
    w = Window.partitionBy(name).orderBy((mask.cast("double") + 1e-4) * F.abs(noise), pos)
    return df.withColumn("rank", F.row_number().over(w) - 1)


def alignment_index(df: DataFrame, name: str, pos: str, observed: Column) -> DataFrame:
    """df with index: for each place, how many observed ones come before it; null where it is not observed."""
    w = Window.partitionBy(name).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("index", F.when(observed, F.sum(observed.cast("int")).over(w) - 1))


def radius_edges(nodes: DataFrame, radius: float, name: str = "name", node: str = "node", xyz: str = "xyz", apart: int = 0) -> DataFrame:
    """(name, src, dst, dist): ordered pairs within a radius, at least `apart` places apart.

    Structures of up to FEW nodes meet as arrays, one row each. Nodes of larger ones are hashed to cells as wide as the radius; a node meets those of the
    27 cells around it, so joined rows grow with the nodes and not with the square of a structure (whether there are larger ones is asked when this is called).
    A node without three finite coordinates has no edges.
    """
    n = nodes.select(F.col(name).alias("name"), F.col(node).alias("node"), F.col(xyz).alias("xyz"))
    large = n.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).select("name")
    if large.isEmpty():
        return _radius_whole(n, radius, apart)
    cells = _radius_cells(n.join(large, "name", "left_semi"), radius, "name", "node", "xyz", apart)
    return _radius_whole(n.join(large, "name", "left_anti"), radius, apart).unionByName(cells)


def _radius_whole(n: DataFrame, radius: float, apart: int) -> DataFrame:
    every = n.groupBy("name").agg(F.collect_list(F.struct("node", "xyz")).alias("nodes")).select("name", "nodes", F.explode("nodes").alias("q"))
    d = F.transform("nodes", lambda o: F.struct(o["node"].alias("dst"), F.sqrt(sqdist(F.col("q.xyz"), o["xyz"])).alias("dist")))
    near = F.filter(d, lambda e: (e["dist"] < radius) & (e["dst"] != F.col("q.node")) & (F.abs(e["dst"] - F.col("q.node")) >= apart))
    return every.select("name", F.col("q.node").alias("src"), F.explode(near).alias("e")).select("name", "src", "e.dst", "e.dist")


def _radius_cells(nodes: DataFrame, radius: float, name: str, node: str, xyz: str, apart: int) -> DataFrame:
    finite = F.forall("p", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    a = nodes.select(F.col(name).alias("name"), F.col(node).alias("src"), F.col(xyz).alias("p")).filter(F.col("p").isNotNull() & finite)
    h = F.lit(float(radius))
    b = a.select("name", F.col("src").alias("dst"), F.col("p").alias("q"), *(c.alias(f"_c{i}") for i, c in enumerate(_cell("p", h))))
    both = _near_cells(a, "p", h).join(b, ["name", "_c0", "_c1", "_c2"]).filter((F.col("src") != F.col("dst")) & (F.abs(F.col("src") - F.col("dst")) >= apart))
    return both.select("name", "src", "dst", F.sqrt(sqdist("p", "q")).alias("dist")).filter(F.col("dist") < radius)


def atom_pair_distances(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The distance of every atom of one residue to every atom of another (25 for a backbone with the virtual C-beta)."""
    return {f"{x}_{y}": F.sqrt(sqdist(a[x], b[y]) + 1e-6) for x in a for y in b}


def local_frame(ca0: Column, ca1: Column, ca2: Column) -> list[Column]:
    """Rows of the rotation of a C-alpha trace at its middle: the bisector, the normal, and their cross product."""
    u, v = _unit(_minus(ca1, ca0)), _unit(_minus(ca2, ca1))
    b, n = _unit(_minus(u, v)), _unit(_cross(u, v))
    return [b, n, _cross(b, n)]


def quaternion(r: list[Column]) -> Column:
    """(x, y, z, w), of length 1, of a rotation given by its rows."""
    g = lambda i, j: F.get(r[i], j)
    xx, yy, zz = g(0, 0), g(1, 1), g(2, 2)
    sizes = [0.5 * F.sqrt(F.abs(1 + s)) for s in (xx - yy - zz, -xx + yy - zz, -xx - yy + zz)]
    signs = [F.signum(g(2, 1) - g(1, 2)), F.signum(g(0, 2) - g(2, 0)), F.signum(g(1, 0) - g(0, 1))]
    w = F.sqrt(F.greatest(1 + xx + yy + zz, F.lit(0.0))) / 2
    return _unit(F.array(*(s * z for s, z in zip(signs, sizes, strict=True)), w))


#: Pairs of atoms whose distances an edge of a backbone graph holds, in the models' order: every atom of one end with every atom of the other.
BACKBONE_PAIRS = (
    ("ca", "ca"), ("n", "n"), ("c", "c"), ("o", "o"), ("cb", "cb"), ("ca", "n"), ("ca", "c"), ("ca", "o"), ("ca", "cb"), ("n", "c"), ("n", "o"), ("n", "cb"), ("cb", "c"),
    ("cb", "o"), ("o", "c"), ("n", "ca"), ("c", "ca"), ("o", "ca"), ("cb", "ca"), ("c", "n"), ("o", "n"), ("cb", "n"), ("c", "cb"), ("o", "cb"), ("c", "o"),
)
#: The same for traces: a C-alpha, the one before it and the one after it.
TRACE_PAIRS = (("at", "at"), ("before", "before"), ("after", "after"), ("before", "at"), ("before", "after"), ("at", "before"), ("at", "after"), ("after", "before"), ("after", "at"))


def trace_frames(nodes: DataFrame, name: str = "name", node: str = "node", xyz: str = "xyz", low: float = 3.6, high: float = 4.0) -> DataFrame:
    """nodes with before and after (the neighbours' points, zeros at the ends), frame (three rows) and angles (three numbers) of the trace.

    A step whose length is outside the bounds counts as none. Frame: the bisector of the steps into and out of a node, their normal, and the cross product of
    both. Angles: the cosine of the bond angle of the next two steps, and its sine times the cosine and sine of the dihedral. Frame and angles are
    zeros at the first node and the last two.
    """
    w = Window.partitionBy(name).orderBy(node)
    zero = F.array(*(F.lit(0.0) for _ in range(3)))
    out = nodes.withColumns({"before": F.lag(xyz).over(w), "after": F.lead(xyz).over(w), "_inside": F.lag(node).over(w).isNotNull() & F.lead(node, 2).over(w).isNotNull()})
    out = out.withColumn("_s", _minus3(F.col("after"), F.col(xyz))).withColumn("_m", F.sqrt(_dot3(F.col("_s"), F.col("_s"))))
    out = out.withColumn("_u", F.when((F.col("_m") > low) & (F.col("_m") < high), F.array(*(v / F.col("_m") for v in _three(F.col("_s"))))).otherwise(zero))
    out = out.withColumns({"_u2": F.lag("_u").over(w), "_u0": F.lead("_u").over(w), "before": F.coalesce("before", zero), "after": F.coalesce("after", zero)})
    out = out.withColumns({"_n2": _unit3(_cross(F.col("_u2"), F.col("_u"))), "_n1": _unit3(_cross(F.col("_u"), F.col("_u0"))), "_o": _unit3(_minus3(F.col("_u2"), F.col("_u")))})
    clip = lambda c: F.least(F.greatest(c, F.lit(-1 + 1e-6)), F.lit(1 - 1e-6))
    out = out.withColumns({"_b": clip(-_dot3(F.col("_u"), F.col("_u0"))), "_t": clip(_dot3(F.col("_n2"), F.col("_n1"))), "_side": F.signum(_dot3(F.col("_u2"), F.col("_n1")))})
    bond, twist, side = F.col("_b"), F.col("_t"), F.col("_side")
    sine = F.sqrt(1 - bond * bond)
    # sign(s) * acos(c): the cosine is c, or 1 where the sign is 0.
    angles = F.array(bond, sine * F.when(side == 0, 1.0).otherwise(twist), sine * side * F.sqrt(1 - twist * twist))
    frame = F.array("_o", "_n2", _cross(F.col("_o"), F.col("_n2")))
    inside = F.col("_inside")
    out = out.withColumns({"frame": F.when(inside, frame).otherwise(F.array(zero, zero, zero)), "angles": F.when(inside, angles).otherwise(zero)})
    return out.drop("_s", "_m", "_u", "_u2", "_u0", "_n2", "_n1", "_o", "_inside", "_b", "_t", "_side")


def along_edges(edges: DataFrame, nodes: DataFrame, columns: list[str], name: str = "name", node: str = "node") -> DataFrame:
    """edges(name, src, dst, ...) with structs a and b of the nodes' columns at both ends: two equi-joins, whatever number of features is made of them."""
    one = nodes.select(F.col(name).alias("name"), F.col(node).alias("_node"), F.struct(*columns).alias("_f"))
    out = edges.join(one.select("name", F.col("_node").alias("src"), F.col("_f").alias("a")), ["name", "src"])
    return out.join(one.select("name", F.col("_node").alias("dst"), F.col("_f").alias("b")), ["name", "dst"])


def _basis(low: float, high: float, count: int, width: float, sums: bool):
    """A function of arrays of distances over Arrow batches: count values for each distance, or their sum; nulls for a null one."""
    centres = np.linspace(low, high, count)

    @F.arrow_udf("array<double>")
    def basis(far: pa.Array) -> pa.Array:
        d = far.flatten()
        at, absent = d.to_numpy(zero_copy_only=False), d.is_null().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(far.value_lengths().to_numpy(zero_copy_only=False))])
        if sums:
            # One centre at a time, so that a batch's values are never all there at once.
            values = sum(np.exp(-np.square((at - c) / width)) for c in centres)
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, mask=absent))
        values = np.exp(-np.square((at[:, None] - centres) / width)).ravel()
        return pa.ListArray.from_arrays(pa.array((ends * count).astype(np.int32)), pa.array(values, mask=np.repeat(absent, count)))

    return basis


def edge_rbf(edges: DataFrame, pairs: tuple = BACKBONE_PAIRS, name: str = "p", low: float = 2.0, high: float = 22.0, count: int = 16, width: float = 1.25, sums: bool = False) -> DataFrame:
    """edges with structs a and b (a point for each atom), and the radial basis values of all pairs of their atoms: one array in the order of pairs.

    The distances are generated code; their 400 exponentials an edge are evaluated over Arrow batches, as generated code of that many expressions
    exceeds a method's size and is interpreted. sums: a pair's values are added where they are made, and the array has one sum for each pair.
    """
    far = F.array(*(distance3(F.col("a")[x], F.col("b")[y]) for x, y in pairs))
    return edges.withColumn(name, _basis(low, high, count, width, sums)(far))


def oriented_edges(edges: DataFrame, xyz: str = "xyz", frame: str = "frame") -> DataFrame:
    """edges with structs a and b of points and frames (along_edges), and with direction and rotation: the unit vector to the other end in the frame of
    this one, and the rotation between both frames as a quaternion (x, y, z, w).
    """
    rows = lambda f: [F.get(F.col(f)[frame], i) for i in range(3)]
    p, q = rows("a"), rows("b")
    apart = _minus3(F.col("b")[xyz], F.col("a")[xyz])
    out = edges.withColumn("_d", F.array(*(_dot3(r, apart) for r in p)))
    entry = lambda i, j: sum((F.get(p[k], i) * F.get(q[k], j) for k in range(1, 3)), F.get(p[0], i) * F.get(q[0], j))
    out = out.withColumn("_r", F.array(*(F.array(*(entry(i, j) for j in range(3))) for i in range(3))))
    g = lambda i, j: F.get(F.get("_r", i), j)
    xx, yy, zz = g(0, 0), g(1, 1), g(2, 2)
    sizes = [0.5 * F.sqrt(F.abs(1 + s)) for s in (xx - yy - zz, -xx + yy - zz, -xx - yy + zz)]
    signs = [F.signum(g(2, 1) - g(1, 2)), F.signum(g(0, 2) - g(2, 0)), F.signum(g(1, 0) - g(0, 1))]
    out = out.withColumn("_q", F.array(*(s * z for s, z in zip(signs, sizes, strict=True)), F.sqrt(F.greatest(1 + xx + yy + zz, F.lit(0.0))) / 2))
    four = [F.get("_q", k) for k in range(4)]
    out = out.withColumn("_m", F.sqrt(four[0] * four[0] + four[1] * four[1] + four[2] * four[2] + four[3] * four[3]))
    return out.withColumns({"direction": _unit3(F.col("_d")), "rotation": F.array(*(F.when(F.col("_m") > 0, v / F.col("_m")).otherwise(0.0) for v in four))}).drop("_d", "_r", "_q", "_m")


def backbone(rows: DataFrame) -> DataFrame:
    """rows(n, ca, c, o) with cb, the idealised C-beta."""
    return rows.withColumn("cb", F.array(*virtual_beta(F.col("n"), F.col("ca"), F.col("c"))))


def edge_places(a: Column, b: Column, index: str = "residue_index", chain: str = "chain", most: int = 32) -> tuple[Column, Column]:
    """(same_chain, class) of an edge: whether its ends are of one chain, and the class of their relative position."""
    same = a[chain] == b[chain]
    return same, relative_class(a[index] - b[index], same, most)


def tied_features(residues: DataFrame, designed: DataFrame) -> DataFrame:
    """One row per residue of residues(name, chain, pos, ...) in the model's order: designed chains first, then visible ones, each sorted.

    Adds chain_no (from 1), place (from 0, over the structure), residue_index (100 more for each chain before) and mask (1 where designed).
    designed: (name, chain). Structures are bounded groups.
    """
    marked = residues.join(designed.select("name", "chain").distinct().withColumn("mask", F.lit(1)), ["name", "chain"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    w = Window.partitionBy("name")
    number = F.dense_rank().over(w.orderBy(F.desc("mask"), "chain"))
    place = F.row_number().over(w.orderBy(F.desc("mask"), "chain", "pos")) - 1
    return marked.withColumns({"chain_no": number, "place": place, "residue_index": 100 * (number - 1) + place})
