"""Registered queries on selections, features, constraints and scores; orders are chains or structures, lines are residues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.arrays import rounded
from ..functions.randomness import digest
from ..operators import constraints, dataset, metrics, pairs, structure
from .queries import E_SQL, query, read, samples
from .table_queries import NODES_SQL, XYZ_SQL, _nodes

# Selections and joins.


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def isin_filter(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return dataset.where_in(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", c)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def cross_section(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    return dataset.cross_section(x, {"l_returnflag": "A", "l_linestatus": "F"})


@query("SELECT doc_id, quality IS NULL AS missing FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 100 OR quality IS NOT NULL")
def null_mask(spark, sf_dir):
    """A row mask of nulls, joined with another by or."""
    d = dataset.reindex(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return d.filter((F.col("n_chars") > 100) | F.col("quality").isNotNull()).select("doc_id", F.col("quality").isNull().alias("missing"))


@query("SELECT doc_id, lang, quality, event_n FROM (SELECT doc_id, lang FROM documents) FULL JOIN (SELECT doc_id, quality FROM labels) USING (doc_id) FULL JOIN (SELECT vec_id AS doc_id, len(embedding) AS event_n FROM embeddings) USING (doc_id)")
def side_by_side(spark, sf_dir):
    """Columns of three tables beside each other by id."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("event_n"))
    return dataset.beside("doc_id", read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id", "quality"), e)


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def strict_lookup(spark, sf_dir):
    """A dictionary's value for every row; a key without an entry would stop the job."""
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return dataset.looked_up(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), d, ["l_orderkey"], "o_orderstatus")


@query("""WITH m AS (SELECT o_custkey AS g, o_orderkey AS pos, o_orderstatus <> 'P' AS mask FROM orders), v AS (SELECT o_custkey AS g, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_totalprice < 200000),
p AS (SELECT *, CASE WHEN mask THEN sum(CASE WHEN mask THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY pos) END AS n FROM m) SELECT p.g, p.pos, mask, o_totalprice FROM p LEFT JOIN v ON v.g = p.g AND v.n = p.n""")
def positional_zip(spark, sf_dir):
    """Values put one after another into the true places of a mask."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("pos"), "o_orderstatus", "o_totalprice")
    mask = o.select("g", "pos", (F.col("o_orderstatus") != "P").alias("mask"))
    return dataset.zipped(o.filter("o_totalprice < 200000"), mask, "g", "pos", "o_totalprice").select("g", "pos", "mask", "o_totalprice")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def longest_first(spark, sf_dir):
    """A head in descending order."""
    return read(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY md5('8:' || o_orderkey), o_orderkey) AS INTEGER) AS place FROM orders")
def shuffled_batches(spark, sf_dir):
    return dataset.shuffled(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "8")


@query("SELECT l_orderkey, arg_min(l_returnflag, md5('6:' || l_returnflag) || l_returnflag) AS assembly FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY 1")
def random_assembly(spark, sf_dir):
    """One assembly of each structure, by hashes."""
    a = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("assembly")).distinct()
    return dataset.pick_one(a, "l_orderkey", "assembly", "6")


@query("""WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000), o_orderkey) AS k FROM orders),
b AS (SELECT o_custkey, o_orderkey, l, k, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n FROM r WHERE k = 1
  UNION ALL SELECT r.o_custkey, r.o_orderkey, r.l, r.k, CASE WHEN r.l * (b.n + 1) > 600 THEN b.batch + 1 ELSE b.batch END, CASE WHEN r.l * (b.n + 1) > 600 THEN 1 ELSE b.n + 1 END FROM b JOIN r ON r.o_custkey = b.o_custkey AND r.k = b.k + 1)
SELECT o_custkey, o_orderkey, batch FROM b""")
def padded_batches(spark, sf_dir):
    """Batches whose padded size, longest times rows, stays within a budget."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("l"))
    return dataset.padded_batches(o, "o_orderkey", "l", 600, ["o_custkey"]).select("o_custkey", "o_orderkey", "batch")


@query("SELECT doc_id, lang, 'train' AS part FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, 'test' FROM documents WHERE lang <> 'en'")
def union_of_batches(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.filter("lang = 'en'").withColumn("part", F.lit("train")).unionByName(d.filter("lang <> 'en'").withColumn("part", F.lit("test")))


# Features.


@query("SELECT vec_id, round(list_avg([x[1] for x in t]), 6) + 0.0 AS first, round(list_avg([x[4] for x in t]), 6) + 0.0 AS last FROM (SELECT vec_id, [e[1 + 4 * k:4 + 4 * k] for k in range(1, 15)] AS t FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def token_mean_pooling(spark, sf_dir):
    """The mean of a row's token vectors, without the marks at both ends."""
    v = A.doubles("embedding")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice(v, 1 + 4 * k, 4))
    p = read(spark, sf_dir, "embeddings").select("vec_id", tokens.alias("t")).select("vec_id", A.mean_pool("t", 1, 1).alias("p"))
    return p.select("vec_id", rounded(F.get("p", 0)).alias("first"), rounded(F.get("p", 3)).alias("last"))


@query("SELECT p_partkey, list_concat([length(p_name)::DOUBLE, p_size::DOUBLE], ['infinity'::DOUBLE, 'infinity'::DOUBLE]) AS v FROM part")
def infinite_padding(spark, sf_dir):
    v = F.array(F.length("p_name"), F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", A.pad_infinite(v.cast("array<double>"), 4).alias("v"))


NOISE_SQL = "('0x' || substr(md5('4:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY (CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0.0 END + 1e-4) * ({NOISE_SQL}), l_linenumber) - 1 AS INTEGER) AS rank FROM lineitem")
def decoding_order(spark, sf_dir):
    """The order in which places are decoded: fixed ones first, then at random."""
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    noise = F.conv(F.substring(digest("4", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return structure.decoding_order(x, "l_orderkey", "l_linenumber", F.col("l_quantity") > 20, noise).select("l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) END AS index FROM orders")
def alignment_index(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return structure.alignment_index(o, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "index")


@query(f"WITH {NODES_SQL}, d AS (SELECT a.name, a.node AS src, b.node AS dst, sqrt(list_sum(list_transform(list_zip(a.xyz, b.xyz), lambda q: (q[1] - q[2]) * (q[1] - q[2])))) AS dist FROM n a JOIN n b ON a.name = b.name AND abs(a.node - b.node) >= 2) SELECT name, src, dst, round(dist, 6) AS dist FROM d WHERE dist < 10")
def radius_edges(spark, sf_dir):
    """Spatial edges within a radius of 10, at least two places apart."""
    return structure.radius_edges(_nodes(spark, sf_dir), 10.0, apart=2).withColumn("dist", rounded("dist"))


ATOMS_SQL = f"x AS (SELECT l_orderkey AS name, l_linenumber AS node, min({XYZ_SQL}) AS n, min([l_tax::DOUBLE * 50, l_quantity::DOUBLE / 2, l_discount::DOUBLE * 30]) AS ca FROM lineitem GROUP BY 1, 2)"
SQD = "list_sum(list_transform(list_zip({}, {}), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"


@query(f"WITH {ATOMS_SQL} SELECT a.name, a.node, " + ", ".join(f"round(sqrt({SQD.format('a.' + p, 'b.' + q)} + 1e-6), 6) AS {p}_{q}" for p in ("n", "ca") for q in ("n", "ca")) + " FROM x a JOIN x b ON b.name = a.name AND b.node = a.node + 1")
def atom_pair_distances(spark, sf_dir):
    """Distances of every atom of a residue to every atom of the next."""
    q, d, t = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("node")).agg(F.min(F.array(q, d * 100, t * 100)).alias("n"), F.min(F.array(t * 50, q / 2, d * 30)).alias("ca"))
    nxt = rows.select("name", (F.col("node") - 1).alias("node"), F.col("n").alias("n2"), F.col("ca").alias("ca2"))
    found = structure.atom_pair_distances({"n": F.col("n"), "ca": F.col("ca")}, {"n": F.col("n2"), "ca": F.col("ca2")})
    return rows.join(nxt, ["name", "node"]).select("name", "node", *(rounded(v).alias(k) for k, v in found.items()))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS name, l_returnflag AS chain FROM lineitem WHERE l_returnflag <> 'A'), r AS (SELECT l_orderkey AS name, l_returnflag AS chain, l_linenumber AS pos, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT r.*, CASE WHEN d.chain IS NULL THEN 0 ELSE 1 END AS mask FROM r LEFT JOIN d USING (name, chain)), k AS (SELECT *, dense_rank() OVER (PARTITION BY name ORDER BY mask DESC, chain) AS chain_no, row_number() OVER (PARTITION BY name ORDER BY mask DESC, chain, pos) - 1 AS place FROM m)
SELECT name, chain, pos, CAST(mask AS INTEGER) AS mask, CAST(chain_no AS INTEGER) AS chain_no, CAST(place AS INTEGER) AS place, CAST(100 * (chain_no - 1) + place AS INTEGER) AS residue_index FROM k""")
def tied_features(spark, sf_dir):
    """Residues in the model's order: designed chains first, then visible ones."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_returnflag").alias("chain"), F.col("l_linenumber").alias("pos")).distinct()
    out = structure.tied_features(line, line.filter("chain <> 'A'"))
    return out.select("name", "chain", "pos", "mask", "chain_no", "place", "residue_index")


# Constraints and scores.


@query("SELECT o_orderkey, [CASE WHEN o_orderstatus = 'F' THEN 0.1 ELSE 0.0 END::DOUBLE, 0.0::DOUBLE, -0.5::DOUBLE] AS bias FROM orders")
def global_bias(spark, sf_dir):
    """A bias by letter, for the structures that it holds for."""
    one, none = constraints.bias_vector({"A": 0.1, "D": -0.5}), constraints.bias_vector({"D": -0.5})
    return read(spark, sf_dir, "orders").select("o_orderkey", F.slice(F.when(F.col("o_orderstatus") == "F", one).otherwise(none), 1, 3).alias("bias"))


@query("SELECT l_orderkey AS name, l_linenumber AS pos, round(coalesce(sum(l_discount::DOUBLE) FILTER (WHERE l_returnflag = 'A'), 0), 6) AS a, round(coalesce(sum(l_discount::DOUBLE) FILTER (WHERE l_returnflag = 'R'), 0), 6) AS r FROM lineitem GROUP BY 1, 2")
def residue_bias(spark, sf_dir):
    """A bias by position and letter."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.lit("A").alias("chain"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("aa"), F.col("l_discount").cast("double").alias("bias"))
    out = constraints.with_residue_bias(line.select("name", "chain", "pos").distinct(), line, "AR")
    return out.select("name", "pos", rounded(F.get("bias", 0)).alias("a"), rounded(F.get("bias", 1)).alias("r"))


@query("SELECT l_orderkey AS grp, l_returnflag AS aa, round(avg(l_quantity::DOUBLE * CASE WHEN l_linenumber = 1 THEN 1.0 ELSE -0.5 END), 6) + 0.0 AS z FROM lineitem GROUP BY 1, 2")
def tied_logits(spark, sf_dir):
    """Logits of tied positions, averaged with their weights."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_returnflag").alias("aa"), F.col("l_quantity").cast("double").alias("z"), F.when(F.col("l_linenumber") == 1, 1.0).otherwise(-0.5).alias("beta"))
    return constraints.tied_logits(line, ["grp"], "aa", "z", "beta").withColumn("z", rounded("z"))


@query("SELECT o_custkey, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(*) AS n FROM orders GROUP BY 1")
def score_summary(spark, sf_dir):
    out = metrics.score_summary(read(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("SELECT l_orderkey, round(avg(l_quantity::DOUBLE) FILTER (WHERE l_returnflag = 'A' AND l_linenumber > 1), 6) AS design, round(avg(l_quantity::DOUBLE) FILTER (WHERE l_linenumber > 1), 6) AS whole FROM lineitem GROUP BY 1")
def design_and_global_loss(spark, sf_dir):
    design, whole = metrics.two_losses(F.col("l_quantity").cast("double"), F.col("l_returnflag") == "A", F.col("l_linenumber") > 1)
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rounded(design).alias("design"), rounded(whole).alias("whole"))


@query(f"WITH {E_SQL}, k AS (SELECT a.i AS a_i, b.i AS b_i, list_sum(list_transform(list_zip(a.x, b.x), lambda q: q[1] * q[2])) AS k FROM e a JOIN e b ON b.i > a.i AND b.i <= a.i + 2) SELECT a_i, b_i, round(k / (SELECT max(k) FROM k), 6) + 0.0 AS k FROM k")
def max_normalised_gram(spark, sf_dir):
    p = pairs.superdiagonals(samples(spark, sf_dir).select("i", "x"), 2)
    return metrics.max_normalised(p.select("a_i", "b_i", A.dot("a_x", "b_x").alias("k")), "k").withColumn("k", rounded("k"))
