"""Registered queries that write a given table in a file format and read it back. Suppliers stand for structures, their lines for residues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import rounded
from ..operators import constraints, dataset, stages
from ..session import new_folder
from ..sources import mmcif, records, structures, writers
from ..sources import sequences as files
from .queries import query, read

NAMES = [*structures.RESIDUES, "MSE", "UNK"]
LETTERS = [*structures.RESIDUES.values(), "M", "X"]
LINES_SQL = f"""l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY name ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax) AS k FROM
  (SELECT 'S' || l_suppkey AS name, l_returnflag AS chain, l_partkey % 50 + 1 AS resnum, {LETTERS!r}[(l_partkey + l_linenumber) % 22 + 1] AS aa, * FROM lineitem)),
r AS MATERIALIZED (SELECT name, chain, resnum, arg_min(aa, k) AS aa, arg_min(l_quantity, k)::DOUBLE AS x, round(arg_min(l_discount, k) * 100, 3)::DOUBLE AS y FROM l GROUP BY 1, 2, 3),
g AS (SELECT name, chain, unnest(range(min(resnum), max(resnum) + 1)) AS resnum FROM r GROUP BY 1, 2),
s AS MATERIALIZED (SELECT name, chain, resnum, row_number() OVER (PARTITION BY name, chain ORDER BY resnum) AS pos, coalesce(aa, 'X') AS aa, x, y FROM g LEFT JOIN r USING (name, chain, resnum))"""
CHAINS_SQL = LINES_SQL + ", c AS (SELECT name, chain, string_agg(aa, '' ORDER BY pos) AS seq FROM s GROUP BY 1, 2), t AS (SELECT name, CAST(count(*) AS INTEGER) AS num_of_chains, string_agg(seq, '' ORDER BY chain) AS seq FROM c GROUP BY 1)"
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    """(name, chain, resnum, resname, ...) of every line of its supplier's structure."""
    line = read(spark, sf_dir, "lineitem")
    resname = F.get(F.array(*map(F.lit, NAMES)), ((F.col("l_partkey") + F.col("l_linenumber")) % 22).cast("int"))
    return line.select(F.concat(F.lit("S"), "l_suppkey").alias("name"), F.col("l_returnflag").alias("chain"), (F.col("l_partkey") % 50 + 1).alias("resnum"), resname.alias("resname"), *ORDER)


def _pdb_folder(spark, sf_dir) -> str:
    """A folder with one PDB file per supplier."""
    rows = _lines(spark, sf_dir)
    kind = F.when(F.col("resname") == "MSE", "HETATM").otherwise("ATOM  ")
    text = F.format_string("%s%5d  CA  %s %s%4d    %8.3f%8.3f%8.3f", kind, F.lit(1), "resname", "chain", "resnum", F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100, F.col("l_tax").cast("double") * 100)
    return writers.write_named(writers.joined_lines(rows, "name", ORDER, text), new_folder(spark, "pdb"), ".pdb")


@query(f"WITH {LINES_SQL} SELECT name, chain, pos, resnum, aa, x, y FROM s")
def pdb_residues(spark, sf_dir):
    """PDB files written and parsed: first line of a residue wins, gaps become X, selenomethionine is methionine."""
    got = structures.read_pdb(spark, _pdb_folder(spark, sf_dir))
    return got.select("name", "chain", F.col("pos").cast("long").alias("pos"), F.col("resnum").cast("long").alias("resnum"), "aa", F.get("ca", 0).alias("x"), F.get("ca", 1).alias("y"))


@query(f"WITH {CHAINS_SQL} SELECT * FROM t")
def pdb_chains(spark, sf_dir):
    """The chains of each structure, sorted, as one sequence."""
    return structures.structures(structures.read_pdb(spark, _pdb_folder(spark, sf_dir))).select("name", "num_of_chains", "seq")


@query(f"WITH {CHAINS_SQL} SELECT name, string_agg(seq, '/' ORDER BY chain) AS seq, string_agg(chain, ',' ORDER BY chain) AS chains FROM c WHERE chain <> 'N' GROUP BY 1")
def chain_segments(spark, sf_dir):
    """The sequences of the designed chains of each structure, separated by slashes."""
    r = structures.read_pdb(spark, _pdb_folder(spark, sf_dir))
    designed = _lines(spark, sf_dir).filter("chain <> 'N'").select("name", "chain")
    return structures.chain_segments(r, designed).select("name", "seq", F.array_join("chains", ",").alias("chains"))


@query(f"WITH {LINES_SQL}, n AS (SELECT name FROM l GROUP BY 1 HAVING count(*) <= 600) SELECT name, chain, CAST(count(*) AS BIGINT) AS n FROM s WHERE name IN (SELECT name FROM n) GROUP BY 1, 2")
def short_files(spark, sf_dir):
    """Residues by chain of the files with at most 600 lines; longer ones are not parsed."""
    return structures.read_pdb(spark, _pdb_folder(spark, sf_dir), most_lines=600).groupBy("name", "chain").agg(F.count(F.lit(1)).alias("n"))


def _json_lines(spark, sf_dir) -> str:
    path = new_folder(spark, "structures")
    records.write_records(records.records(structures.read_pdb(spark, _pdb_folder(spark, sf_dir))), path)
    return path


@query(f"WITH {LINES_SQL} SELECT name, chain, CAST(pos AS INTEGER) AS pos, aa, x, y FROM s")
def structure_records(spark, sf_dir):
    """PDB files composed to JSON lines with their coordinates under keys by chain, and opened to residues again."""
    got = records.record_residues(records.read_records(spark, _json_lines(spark, sf_dir)))
    return got.select("name", "chain", "pos", "aa", F.get("ca", 0).alias("x"), F.get("ca", 1).alias("y"))


@query(f"WITH {LINES_SQL} SELECT name, chain, count(*) AS n, count(x) AS points FROM s GROUP BY 1, 2")
def record_points(spark, sf_dir):
    """How many places and points each chain of a record has, atom by atom; these files have one atom a residue."""
    got = records.record_atoms(records.read_records(spark, _json_lines(spark, sf_dir)))
    return got.filter("atom = 'CA'").groupBy("name", "chain").agg(F.count(F.lit(1)).alias("n"), F.count("xyz").alias("points"))


@query(f"WITH {CHAINS_SQL} SELECT name, seq, num_of_chains FROM t WHERE length(seq) < 150 AND contains(seq, 'X')")
def folder_to_json_lines(spark, sf_dir):
    """A folder of structures composed to JSON lines, and read with the filters of the scan."""
    return structures.read_structure_lines(spark, _json_lines(spark, sf_dir), longest=149).filter(F.col("seq").contains("X")).select("name", "seq", "num_of_chains")


@query(f"WITH {CHAINS_SQL} SELECT CASE WHEN length(seq) > 149 THEN 'too_long' ELSE 'kept' END AS reason, count(*) AS n FROM t GROUP BY 1")
def json_lines_discards(spark, sf_dir):
    """How many structures of a scan are kept or discarded, and why."""
    return structures.structure_discards(spark, _json_lines(spark, sf_dir), "ACDEFGHIKLMNPQRSTVWYX", 149)


CIF_HEAD = "data_x\n_exptl.method 'X-RAY DIFFRACTION'\nloop_\n_atom_site.label_asym_id\n_atom_site.label_seq_id\n_atom_site.label_comp_id\n_atom_site.label_atom_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n_atom_site.occupancy\n_atom_site.pdbx_PDB_model_num\n"
CIF_TAIL = """#
loop_
_pdbx_struct_oper_list.id
_pdbx_struct_oper_list.matrix[1][1]
_pdbx_struct_oper_list.matrix[1][2]
_pdbx_struct_oper_list.matrix[1][3]
_pdbx_struct_oper_list.vector[1]
_pdbx_struct_oper_list.matrix[2][1]
_pdbx_struct_oper_list.matrix[2][2]
_pdbx_struct_oper_list.matrix[2][3]
_pdbx_struct_oper_list.vector[2]
_pdbx_struct_oper_list.matrix[3][1]
_pdbx_struct_oper_list.matrix[3][2]
_pdbx_struct_oper_list.matrix[3][3]
_pdbx_struct_oper_list.vector[3]
1 1 0 0 0 0 1 0 0 0 0 1 0
2 0 -1 0 1 1 0 0 2 0 0 1 3
3 1 0 0 5 0 1 0 0 0 0 1 0
#
loop_
_pdbx_struct_assembly_gen.assembly_id
_pdbx_struct_assembly_gen.oper_expression
_pdbx_struct_assembly_gen.asym_id_list
1 1 A,N
2 (1-2)(3) R
"""


def _cif_folder(spark, sf_dir) -> str:
    rows = _lines(spark, sf_dir)
    text = F.format_string("%s %d %s CA %.3f %.3f %.3f %.2f 1", "chain", "resnum", "resname", F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100, F.col("l_tax").cast("double") * 100, (F.col("l_linenumber") % 4 / 4).cast("double"))
    one = writers.joined_lines(rows, "name", ORDER, text)
    return writers.write_named(one.select("name", F.concat(F.lit(CIF_HEAD), "text", F.lit("\n" + CIF_TAIL)).alias("text")), new_folder(spark, "cif"), ".cif")


CIF_SQL = f"WITH {LINES_SQL}, b AS (SELECT name, chain, resnum, arg_max(struct_pack(aa, x := l_quantity::DOUBLE, y := round(l_discount * 100, 3)::DOUBLE, occ := l_linenumber % 4 / 4.0), (l_linenumber % 4) * 1000000 - k) AS v FROM l GROUP BY 1, 2, 3)"


@query(CIF_SQL + " SELECT name, chain, resnum AS seq_id, v.aa AS aa, v.x AS x, v.y AS y, v.occ::DOUBLE AS occupancy FROM b")
def mmcif_best_atoms(spark, sf_dir):
    """mmCIF files written and parsed: of an atom's alternatives the one of largest occupancy, then the first."""
    got = mmcif.mmcif_atoms(spark, _cif_folder(spark, sf_dir))
    aa = F.when(F.col("resname") == "MSE", "M").otherwise(mmcif.one_letter(F.col("resname")))
    return got.select("name", "chain", F.col("seq_id").cast("long").alias("seq_id"), aa.alias("aa"), "x", "y", "occupancy")


@query(CIF_SQL + """ SELECT name, assembly, chain, seq_id, operation, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM (
  SELECT name, '1' AS assembly, chain, resnum AS seq_id, '1' AS operation, v.x AS x, v.y AS y FROM b WHERE chain IN ('A', 'N')
  UNION ALL SELECT name, '2', chain, resnum, '1x3', v.x + 5, v.y FROM b WHERE chain = 'R'
  UNION ALL SELECT name, '2', chain, resnum, '2x3', 1 - v.y, v.x + 5 + 2 FROM b WHERE chain = 'R')""")
def mmcif_assemblies(spark, sf_dir):
    """Atoms of the assemblies, one of them by a product of operations: the right factor is applied first."""
    got = mmcif.assembled_files(mmcif.mmcif_files(spark, _cif_folder(spark, sf_dir)))
    return got.select("name", "assembly", "chain", F.col("seq_id").cast("long").alias("seq_id"), "operation", rounded("x", 3).alias("x"), rounded("y", 3).alias("y"))


@query(f"WITH {LINES_SQL}, b AS (SELECT DISTINCT name, resnum FROM l), c AS (SELECT name, string_agg(chain, ',' ORDER BY chain) AS chains FROM (SELECT DISTINCT name, chain FROM l) GROUP BY 1) SELECT name, 'X-RAY DIFFRACTION' AS method, chains FROM c")
def mmcif_metadata(spark, sf_dir):
    """Method and chains of each file."""
    chains = F.array_join(F.array_sort(F.array_distinct(F.transform("residues", lambda r: r["chain"]))), ",")
    return mmcif.mmcif_files(spark, _cif_folder(spark, sf_dir)).select("name", "method", chains.alias("chains"))


#: An entity of fifty residues, every seventh of which the sequence has no letter for; the three chains are its strands.
ENTITY = "".join("X" if k % 7 == 0 else "ACDEFGHIKLMNPQRSTVWY"[k % 20] for k in range(1, 51))
CIF_ENTITY = f"""#
_entry.id 9XYZ
_pdbx_database_status.recvd_initial_deposition_date 2020-01-02
_refine.ls_d_res_high 1.75
_pdbx_struct_mod_residue.label_comp_id MSE
_pdbx_struct_mod_residue.parent_comp_id MET
_entity_poly.entity_id 1
_entity_poly.type 'polypeptide(L)'
_entity_poly.pdbx_strand_id a,n,r
_entity_poly.pdbx_seq_one_letter_code_can
;{ENTITY[:30]}
{ENTITY[30:]}
;
loop_
_pdbx_poly_seq_scheme.asym_id
_pdbx_poly_seq_scheme.pdb_strand_id
A a
N n
R r
"""
CIF_CHAINS_SQL = CIF_SQL + f""", p AS (SELECT name, chain, CAST(k AS INTEGER) AS pos, '{ENTITY}'[k:k] AS letter FROM (SELECT DISTINCT name FROM l), (SELECT unnest(['A', 'N', 'R']) AS chain), (SELECT unnest(range(1, 51)) AS k)),
m AS (SELECT name, chain, resnum AS pos, arg_max({NAMES!r}[(l_partkey + l_linenumber) % 22 + 1], (l_linenumber % 4) * 1000000 - k) AS resname, arg_max(l_quantity::DOUBLE, (l_linenumber % 4) * 1000000 - k) AS x FROM l GROUP BY 1, 2, 3),
j AS (SELECT name, chain, pos, CASE WHEN letter = 'X' AND resname = 'MSE' THEN 'M' ELSE letter END AS aa, resname, x, x IS NOT NULL AS observed FROM p LEFT JOIN m USING (name, chain, pos))"""


def _cif_entities(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    text = F.format_string("%s %d %s CA %.3f %.3f %.3f %.2f 1", "chain", "resnum", "resname", F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100, F.col("l_tax").cast("double") * 100, (F.col("l_linenumber") % 4 / 4).cast("double"))
    one = writers.joined_lines(rows, "name", ORDER, text)
    folder = writers.write_named(one.select("name", F.concat(F.lit(CIF_HEAD), "text", F.lit("\n" + CIF_ENTITY + CIF_TAIL)).alias("text")), new_folder(spark, "cif"), ".cif")
    return mmcif.mmcif_files(spark, folder)


@query(CIF_CHAINS_SQL + " SELECT name, chain, pos, aa, resname, observed, x FROM j")
def mmcif_chains(spark, sf_dir):
    """The full sequence of each chain's entity, merged with what was observed; modified residues count as their parents."""
    got = mmcif.chain_residues(_cif_entities(spark, sf_dir), ("CA",), ("CA",))
    return got.select("name", "chain", "pos", "aa", "resname", "observed", F.get("ca", 0).alias("x"))


@query(CIF_CHAINS_SQL + """ SELECT name, chain, '>9XYZ_' || chain || ' 2020-01-02 X-RAY_DIFFRACTION 1.75 50 ' || count(*) FILTER (WHERE observed) AS header, string_agg(aa, '' ORDER BY pos) AS seq,
  string_agg(CASE WHEN observed THEN aa ELSE '-' END, '' ORDER BY pos) AS seen FROM j GROUP BY 1, 2""")
def mmcif_headers(spark, sf_dir):
    """The line that describes each chain of a file, and its sequence."""
    parsed = _cif_entities(spark, sf_dir).checkpoint()  # read twice below, parsed once
    return mmcif.chain_headers(parsed, mmcif.chain_residues(parsed, ("CA",), ("CA",)))


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS number FROM d)
SELECT 'S' || l_suppkey AS file, CAST(number AS INTEGER) AS number, p_name AS sequence, printf('%.4f', p_retailprice / 1000) AS score FROM n JOIN part ON p_partkey = l_partkey""")
def fasta_files(spark, sf_dir):
    """One FASTA file per structure, records in order (the native first), read back with a header field."""
    d = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_retailprice")
    rows = d.join(p, "l_partkey").withColumn("name", F.concat(F.lit("S"), "l_suppkey"))
    text = writers.fasta_text(writers.design_header({"score": F.col("p_retailprice") / 1000, "part": F.col("l_partkey")}), F.col("p_name"))
    folder = writers.write_named(writers.joined_lines(rows, "name", ["l_partkey"], text), new_folder(spark, "fasta"), ".fa")
    got = files.read_fasta(spark, folder)
    return got.select(F.regexp_replace("file", r"\.fa$", "").alias("file"), "number", "sequence", files.header_field(F.col("header"), "score").alias("score"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings WHERE label <> 3")
def csv_encodings(spark, sf_dir):
    """Encodings as CSV with an index column; a row with a NaN comes back as a null vector."""
    e = read(spark, sf_dir, "embeddings")
    width = 64
    value = lambda k: F.when((F.col("label") == 3) & (F.lit(k) == 5), F.lit(float("nan"))).otherwise(F.get("embedding", k).cast("double"))
    path = new_folder(spark, "encodings")
    e.select(F.col("vec_id").alias("id"), *(value(k).alias(f"v{k}") for k in range(width))).write.csv(path, header=True)
    got = files.read_encodings(spark, path, width).filter("v is not null")
    return got.select("id", rounded(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS pdb, p_size % 4 AS class, count(*) OVER (PARTITION BY p_size % 4) AS n FROM part WHERE p_size <= 20")
def csv_reference(spark, sf_dir):
    """A reference table written as CSV, scanned with its schema and queried by equality on one level."""
    p = read(spark, sf_dir, "part")
    path = new_folder(spark, "reference")
    p.select(F.col("p_partkey").cast("string").alias("pdb"), F.lit("A").alias("chain"), (F.col("p_size") % 4).alias("Class Number"), F.lit(1).alias("Architecture Number"), F.lit(2).alias("Topology Number"), F.lit(3).alias("Superfamily Number"), F.col("p_size").alias("L")).write.csv(path, header=True)
    got = files.read_reference(spark, path)
    kept = got.filter(F.col("L") <= 20)
    n = kept.groupBy(F.col("Class Number").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return dataset.where_equal(kept, {"chain": "A"}).select("pdb", F.col("Class Number").alias("class")).join(n, "class").select("pdb", "class", "n")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS CHAINID, o_orderpriority AS HASH, CAST(o_custkey AS INTEGER) AS CLUSTER FROM orders WHERE o_totalprice / 100000 <= 2.5 AND CAST(o_orderdate AS DATE) <= DATE '1996-06-30'")
def csv_chain_list(spark, sf_dir):
    """A list of chains as CSV, read with its predicates on resolution and date."""
    o = read(spark, sf_dir, "orders")
    path = new_folder(spark, "chains")
    o.select(F.col("o_orderkey").cast("string").alias("CHAINID"), F.to_date("o_orderdate").alias("DEPOSITION"), (F.col("o_totalprice") / 100000).cast("double").alias("RESOLUTION"), F.col("o_orderpriority").alias("HASH"), F.col("o_custkey").cast("int").alias("CLUSTER"), F.lit("ACD").alias("SEQUENCE")).write.csv(path, header=True)
    return files.read_chain_list(spark, path, 2.5, "1996-06-30")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1")
def id_list(spark, sf_dir):
    """A list of ids as text, read and used as a semi-join."""
    path = new_folder(spark, "ids")
    read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit(" "), F.col("l_orderkey").cast("string"))).write.text(path)
    ids = files.read_ids(spark, path).distinct()
    return read(spark, sf_dir, "orders").join(ids.toDF("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(p_size % 5 AS INTEGER) AS class, CAST(length(p_type) AS INTEGER) AS architecture, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1, 2")
def json_queries(spark, sf_dir):
    """A JSON document with a list of queries; each is joined to the table that it selects from."""
    p = read(spark, sf_dir, "part").select((F.col("p_size") % 5).cast("int").alias("Class Number"), F.length("p_type").alias("Architecture Number"), "p_size")
    asked = p.filter("p_size > 25").select("Class Number", "Architecture Number").distinct()
    path = new_folder(spark, "queries")
    # The distinct levels of a hierarchy are few.
    asked.agg(F.to_json(F.struct(F.collect_list(F.struct(*asked.columns)).alias("queries"))).alias("value")).write.text(path)
    got = files.read_queries(spark, path).select("Class Number", "Architecture Number")
    both = p.filter("p_size > 25").join(got, ["Class Number", "Architecture Number"])
    return both.groupBy(F.col("Class Number").alias("class"), F.col("Architecture Number").alias("architecture")).agg(F.count(F.lit(1)).alias("n"))


FIXED = "SELECT 'S' || l_suppkey AS name, l_returnflag AS chain, list_sort(list(DISTINCT l_linenumber))::INTEGER[] AS positions FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2"


@query(FIXED)
def json_dictionaries(spark, sf_dir):
    """Dictionaries of positions as one JSON object a line, two lines a file: the last line counts."""
    line = read(spark, sf_dir, "lineitem").filter("l_quantity > 40")
    by_chain = line.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("name"), F.col("l_returnflag").alias("chain")).agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("int"))).alias("v"))
    json = constraints.one_row_json(by_chain, "name", "chain", "v")
    text = F.concat(F.lit('{"old":{"Z":[9]}}\n'), "json")
    folder = writers.write_named(json.select("name", text.alias("text")), new_folder(spark, "dictionaries"), ".jsonl")
    got = files.read_dictionary(spark, folder, T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
    return got.select("name", F.explode("value").alias("chain", "positions"))


PROFILE_SQL = "WITH p AS (SELECT 'S' || l_suppkey AS name, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax) AS pos, l_quantity, l_linenumber FROM lineitem), v AS (SELECT name, pos, list_transform(range(20), lambda k: CASE WHEN k = l_linenumber THEN l_quantity::DOUBLE / 10 ELSE k / 10.0 END) AS v FROM p)"


@query(PROFILE_SQL + ", e AS (SELECT name, pos, list_transform(v, lambda x: exp(x)) AS e, v FROM v) SELECT name, CAST(pos AS INTEGER) AS pos, round(e[1] / list_sum(e), 6) AS first, round(list_max(e) / list_sum(e), 6) AS top, 0.0::DOUBLE AS unknown FROM e")
def profile_probabilities(spark, sf_dir):
    """Profiles as text, read and made probabilities; the unknown letter has none."""
    line = read(spark, sf_dir, "lineitem").withColumn("name", F.concat(F.lit("S"), "l_suppkey"))
    numbers = [F.format_string("%.2f", F.when(F.lit(k) == F.col("l_linenumber"), F.col("l_quantity").cast("double") / 10).otherwise(k / 10)) for k in range(20)]
    one = writers.joined_lines(line, "name", ORDER, F.concat(F.lit("xxxx "), F.concat_ws(" ", *numbers)))
    folder = writers.write_named(one.select("name", F.concat(F.lit("head\nhead\n"), "text").alias("text")), new_folder(spark, "profiles"), ".txt")
    got = files.read_profile(spark, folder)
    got = got.withColumn("p", constraints.profile_softmax(F.col("values")))
    return got.select(F.regexp_replace("file", r"\.txt$", "").alias("name"), "pos", rounded(F.get("p", 0)).alias("first"), rounded(F.array_max("p")).alias("top"), F.get("p", 20).alias("unknown"))


@query(PROFILE_SQL + """, o AS (SELECT name, pos, v, list_transform(v, lambda x: exp(x)) AS e FROM v)
SELECT name, CAST(pos AS INTEGER) AS pos, round(v[5], 2) AS c_odds, round(v[2], 2) AS r_odds, round(e[4] / list_sum(e), 6) AS d_share, round(v[20], 2) AS v_odds, 0.0::DOUBLE AS x_odds FROM o""")
def profile_letters(spark, sf_dir):
    """Profiles as text, their letters put in the order of the models' alphabet."""
    line = read(spark, sf_dir, "lineitem").withColumn("name", F.concat(F.lit("S"), "l_suppkey"))
    numbers = [F.format_string("%.2f", F.when(F.lit(k) == F.col("l_linenumber"), F.col("l_quantity").cast("double") / 10).otherwise(k / 10)) for k in range(20)]
    one = writers.joined_lines(line, "name", ORDER, F.concat(F.lit("xxxx "), F.concat_ws(" ", *numbers)))
    folder = writers.write_named(one.select("name", F.concat(F.lit("head\nhead\n"), "text").alias("text")), new_folder(spark, "profiles"), ".txt")
    got = files.read_profile(spark, folder)
    got = got.withColumns({"odds": files.permuted(F.col("values"), constraints.ALPHABET), "share": files.permuted(constraints.profile_softmax(F.col("values")), constraints.ALPHABET)})
    odds, share = F.col("odds"), F.col("share")
    at = {a: constraints.ALPHABET.index(a) for a in "CRDVX"}
    return got.select(F.regexp_replace("file", r"\.txt$", "").alias("name"), "pos", F.get(odds, at["C"]).alias("c_odds"), F.get(odds, at["R"]).alias("r_odds"), rounded(F.get(share, at["D"])).alias("d_share"), F.get(odds, at["V"]).alias("v_odds"), F.get(odds, at["X"]).alias("x_odds"))


@query(PROFILE_SQL.replace("SELECT 'S' || l_suppkey AS name", "SELECT 'S' || l_suppkey AS name, l_returnflag AS chain, l_discount").replace("PARTITION BY l_suppkey", "PARTITION BY l_suppkey, l_returnflag").replace("SELECT name, pos, list_transform", "SELECT name, chain, pos, l_discount, list_transform") + """
SELECT name, chain, CAST(pos AS INTEGER) AS pos, CASE WHEN chain = 'R' THEN 0.5 ELSE l_discount END::DOUBLE AS coef, round(list_sum(v), 6) AS odds, round(list_sum(v) / 2, 6) AS bias FROM v""")
def profile_dictionary(spark, sf_dir):
    """Profile dictionaries by structure and chain: a first line for all chains, then one that overrides it, folded in order."""
    # Lines are dealt out by structure while they are narrow; the profiles are made there.
    line = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("name"), F.col("l_returnflag").alias("chain"), *ORDER).repartition("name")
    v = F.array(*(F.when(F.lit(k) == F.col("l_linenumber"), F.col("l_quantity").cast("double") / 10).otherwise(k / 10) for k in range(20)))
    rows = line.withColumn("pos", F.row_number().over(Window.partitionBy("name", "chain").orderBy(*ORDER))).withColumn("log_odds", v)
    coef = F.when(F.col("chain") == "R", 0.5).otherwise(F.col("l_discount").cast("double"))
    rows = rows.select("name", "chain", "pos", F.lit(-1.0).alias("old"), coef.alias("coef"), F.transform("log_odds", lambda x: x / 2).alias("bias"), "log_odds")
    folder = writers.write_named(files.profile_lines(rows, ("old", "coef")), new_folder(spark, "profile-dictionaries"), ".jsonl")
    sums = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda s, x: s + x))
    return files.read_profiles(spark, folder).select("name", "chain", "pos", "coef", sums("log_odds").alias("odds"), sums("bias").alias("bias"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def results_log(spark, sf_dir):
    """Results appended to a CSV log in two goes; the draws of the null distribution are left out of it."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").cast("double").alias("val"), "o_orderstatus", F.array(F.lit(0.5)).alias("h0"))
    path = new_folder(spark, "log")
    writers.append_results(o.drop("o_orderstatus"), path, "csv")
    writers.append_results(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), path, "csv")
    got = spark.read.csv(path, header=True, schema="o_custkey bigint, val double")
    return got.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val"), 2).alias("total"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def results_once(spark, sf_dir):
    """A log that batches are appended to, some of which come again: no result is in it twice."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("val"), "o_orderstatus")
    path = new_folder(spark, "once")
    for kinds in (["F"], ["F", "O"], ["O"]):
        stages.append_new(o.filter(F.col("o_orderstatus").isin(kinds)).drop("o_orderstatus"), path, ["o_orderkey"])
    return spark.read.parquet(path).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val"), 2).alias("total"))


@query(r"SELECT page_id, regexp_replace(replace(regexp_replace(url, '^[/.]+', ''), '/', '_'), '(.)\.[^.]+$', '\1') || '.csv' AS file FROM pages")
def result_names(spark, sf_dir):
    """The names of the files that results of each path would go to."""
    return read(spark, sf_dir, "pages").select("page_id", writers.result_name("url").alias("file"))


@query("SELECT CAST(o_orderkey AS INTEGER) AS epoch, CAST(o_custkey AS INTEGER) AS step, round(o_totalprice / 1000, 3)::DOUBLE AS train FROM orders WHERE o_orderstatus <> 'P'")
def training_log(spark, sf_dir):
    """A training log as text, and its fields."""
    o = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    path = new_folder(spark, "training")
    text = F.concat(F.lit("epoch: "), F.col("o_orderkey").cast("string"), F.lit(", step: "), F.col("o_custkey").cast("string"), F.lit(", time: 1.0, train: "), F.round(F.col("o_totalprice").cast("double") / 1000, 3).cast("decimal(18,3)").cast("string"), F.lit(", valid: 2.0, train_acc: 0.5, valid_acc: 0.25"))
    o.select(text).write.text(path)
    return files.read_training_log(spark, path).select("epoch", "step", "train")


@query("SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 6 AND l_discount > 0.06) AS present FROM supplier")
def listed_files(spark, sf_dir):
    """Which structures have a file: the folder is listed and joined to the ids."""
    rows = _lines(spark, sf_dir).filter("l_quantity > 49 and l_linenumber = 6 and l_discount > 0.06")
    folder = writers.write_named(writers.joined_lines(rows, "name", ORDER, F.col("chain")), new_folder(spark, "some"), ".pdb")
    ids = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("S"), "s_suppkey").alias("name"))
    return dataset.with_presence(ids, structures.listed(spark, folder, "*.pdb"), "name").select("s_suppkey", "present")
