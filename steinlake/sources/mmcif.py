"""mmCIF files as tables: atoms of the first model, entities' sequences merged with what was observed, assemblies' transforms, metadata.

A file is small and parsed once, whole, to one row that holds its tables; everything else is taken from such rows by column expressions
without an exchange. A file that cannot be parsed is a row with an error; an atom without three numbers as coordinates is
left out and counted. .gz files are opened by the text reader itself.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .structures import RESIDUES

#: One row per file. residues: the observed ones of the first model, with their atoms (of alternatives the largest occupancy, then the first).
FILES = (
    "name string, error string, id string, method string, date string, resolution double, skipped int, "
    "chains array<struct<chain:string,entity:string,seq:string>>, parents map<string,string>, "
    "residues array<struct<chain:string,seq_id:int,resname:string,atoms:array<struct<atom:string,resname:string,x:double,y:double,z:double,occupancy:double>>>>, "
    "transforms array<struct<assembly:string,chains:string,operation:string,rotation:array<array<double>>,shift:array<double>>>"
)
_TOKEN = re.compile(r"'(?:[^']|'(?=\S))*'|\"(?:[^\"]|\"(?=\S))*\"|#.*|\S+")


#: What only a line with a quote, a comment, a name or a keyword has.
_MARKED = re.compile(r"['\"#_]")


def _lines(text: str) -> Iterator[tuple[list[str], list[bool] | None]]:
    """Each line's values with whether each was quoted; None where a line has values only, as most lines have, which are split without a pattern."""
    lines = iter(text.splitlines())
    for line in lines:
        if line.startswith(";"):
            block = [line[1:]]
            for line in lines:
                if line.startswith(";"):
                    break
                block.append(line)
            yield ["\n".join(block)], [True]
            continue
        if not _MARKED.search(line):
            yield line.split(), None
            continue
        values, quoted = [], []
        for m in _TOKEN.finditer(line):
            t = m[0]
            if t.startswith("#"):
                break
            marks = len(t) > 1 and t[0] in "'\"" and t[-1] == t[0]
            values.append(t[1:-1] if marks else t)
            quoted.append(marks)
        yield values, quoted


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """The values of a file in order, with whether each was quoted."""
    for values, quoted in _lines(text):
        yield from zip(values, quoted or itertools.repeat(False))


def categories(text: str) -> dict[str, list[dict[str, str]]]:
    """Every category's rows; an item outside a loop makes one row."""
    out: dict[str, list[dict[str, str]]] = {}
    names: list[str] = []
    values: list[str] = []
    looping, item = False, None

    def flush() -> None:
        if names and values:
            fields = [n.split(".", 1)[1] for n in names]
            rows = [dict(zip(fields, values[k : k + len(names)], strict=False)) for k in range(0, len(values), len(names))]
            out.setdefault(names[0].split(".", 1)[0], []).extend(rows)
        names.clear()
        values.clear()

    for line, marks in _lines(text):
        if looping and marks is None:
            values += line
            continue
        for value, quoted in zip(line, marks or itertools.repeat(False)):
            if not quoted and value == "loop_":
                flush()
                looping, item = True, None
            elif not quoted and value.startswith("_") and "." in value:
                if looping and not values:
                    names.append(value)
                else:
                    flush()
                    looping, item = False, value
            elif not quoted and value.startswith("data_"):
                flush()
                looping, item = False, None
            elif looping:
                values.append(value)
            elif item is not None:
                category, field = item.split(".", 1)
                rows = out.setdefault(category, [{}])
                rows[-1][field] = value
                item = None
    flush()
    return out


def _number(value: str | None) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _residues(c: dict) -> tuple[list[dict], int]:
    """The residues of the first model with the best alternative of each atom, in the order of their first lines, and how many lines had no coordinates."""
    rows = c.get("_atom_site", [])
    model = rows[0].get("pdbx_PDB_model_num", "1") if rows else "1"
    best: dict[tuple, tuple] = {}
    skipped = 0
    for r in rows:
        place = r.get("label_seq_id", ".")
        if r.get("pdbx_PDB_model_num", "1") != model or place in (".", "?"):
            continue
        xyz = _number(r.get("Cartn_x")), _number(r.get("Cartn_y")), _number(r.get("Cartn_z"))
        if None in xyz or not place.lstrip("-").isdigit():
            skipped += 1
            continue
        key = r["label_asym_id"], int(place), r["label_atom_id"]
        occupancy = _number(r.get("occupancy")) or 0.0
        if key not in best or occupancy > best[key][-1]:
            best[key] = (key[2], r["label_comp_id"], *xyz, occupancy)
    out: dict[tuple, list[tuple]] = {}
    for (chain, number, _), atom in best.items():
        out.setdefault((chain, number), []).append(atom)
    named = ("atom", "resname", "x", "y", "z", "occupancy")
    return [{"chain": k[0], "seq_id": k[1], "resname": atoms[0][1], "atoms": [dict(zip(named, a, strict=True)) for a in atoms]} for k, atoms in out.items()], skipped


def _first(c: dict, category: str, field: str) -> str | None:
    return next((r.get(field) for r in c.get(category, [])), None)


def _chains(c: dict) -> list[tuple[str, str, str]]:
    """(chain, entity, sequence) of the polypeptides: strands are named by their authors, and by the scheme of the sequences as chains."""
    asym = {r["pdb_strand_id"]: r["asym_id"] for r in c.get("_pdbx_poly_seq_scheme", [])}
    out = []
    for r in c.get("_entity_poly", []):
        if r.get("type") == "polypeptide(L)":
            seq = re.sub(r"\s", "", r.get("pdbx_seq_one_letter_code_can") or "")
            out += [(asym.get(s.strip(), s.strip()), r.get("entity_id"), seq) for s in (r.get("pdbx_strand_id") or "").split(",") if s.strip()]
    return out


def parse_file(name: str, text: str) -> tuple:
    """A file's row of FILES."""
    try:
        c = categories(text)
        resolution = next((v for v in (_number(_first(c, *at)) for at in (("_refine", "ls_d_res_high"), ("_em_3d_reconstruction", "resolution"), ("_reflns", "d_resolution_high"))) if v is not None), None)
        residues, skipped = _residues(c)
        parents = {r["label_comp_id"]: r["parent_comp_id"] for r in c.get("_pdbx_struct_mod_residue", []) if r.get("parent_comp_id", "?") not in (".", "?")}
        return (
            name, None, _first(c, "_entry", "id"), _first(c, "_exptl", "method"), _first(c, "_pdbx_database_status", "recvd_initial_deposition_date"), resolution, skipped,
            _chains(c), list(parents.items()), residues, _transforms(c),
        )
    except Exception as e:
        return (name, f"{type(e).__name__}: {e}", *[None] * 9)


def operation_numbers(expression: str) -> list[str]:
    """The operations of an expression without products: (1-3,5) is 1, 2, 3, 5."""
    out = []
    for part in re.sub(r"[()\s]", "", expression).split(","):
        a, _, b = part.partition("-")
        out.extend(map(str, range(int(a), int(b) + 1)) if b and a.isdigit() else [a])
    return out


def operation_products(expression: str) -> list[tuple[str, ...]]:
    """The factors of every operation of an expression: (1-2)(3) is 1 after 3, and 2 after 3."""
    factors = re.findall(r"\([^)]*\)", expression)
    return list(itertools.product(*map(operation_numbers, factors if len(factors) > 1 else [expression])))


def _transforms(c: dict) -> list[tuple]:
    by_id = {r["id"]: np.array([[float(r[f"matrix[{i}][{j}]"]) for j in (1, 2, 3)] + [float(r[f"vector[{i}]"])] for i in (1, 2, 3)] + [[0.0, 0.0, 0.0, 1.0]]) for r in c.get("_pdbx_struct_oper_list", [])}
    out = []
    for g in c.get("_pdbx_struct_assembly_gen", []):
        for factors in operation_products(g["oper_expression"]):
            if all(n in by_id for n in factors):
                whole = functools.reduce(np.matmul, (by_id[n] for n in factors))
                out.append((g["assembly_id"], g["asym_id_list"], "x".join(factors), whole[:3, :3].tolist(), whole[:3, 3].tolist()))
    return out


def mmcif_files(spark: SparkSession, path: str) -> DataFrame:
    """(columns of FILES): every *.cif and *.cif.gz under a path, each parsed once."""
    schema = _schema()
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*batch.to_pydict().values(), strict=True):
                row = parse_file(name, text or "")
                yield pa.RecordBatch.from_arrays([pa.array([_named(v, f.type)], f.type) for v, f in zip(row, kinds, strict=True)], kinds.names)

    files = spark.read.option("pathGlobFilter", "*.cif*").text(path, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.cif(\.gz)?$", "").alias("name"), "value").mapInArrow(run, schema)


def _schema() -> T.StructType:
    return T.StructType.fromDDL(FILES)


def _named(value, kind: pa.DataType):
    """Tuples of a list of structs as dictionaries, as Arrow takes them."""
    if not value or not pa.types.is_list(kind) or not isinstance(value[0], tuple):
        return value
    names = [f.name for f in kind.value_type]
    return [dict(zip(names, v, strict=True)) for v in value]


def atoms_of(files: DataFrame) -> DataFrame:
    """(name, chain, seq_id, atom, resname, x, y, z, occupancy) of the first model."""
    each = files.select("name", F.explode("residues").alias("r")).select("name", "r.chain", "r.seq_id", F.explode("r.atoms").alias("a"))
    return each.select("name", "chain", "seq_id", "a.*")


def transforms_of(files: DataFrame) -> DataFrame:
    """(name, assembly, chains, operation, rotation, shift): the transforms of biological assemblies."""
    return files.select("name", F.explode("transforms").alias("t")).select("name", "t.*")


def mmcif_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of the first model of every file; of an atom's alternatives the one of largest occupancy, then the first."""
    return atoms_of(mmcif_files(spark, path))


def mmcif_meta(spark: SparkSession, path: str) -> DataFrame:
    """(name, method, date, resolution): the resolution of refinement, else of the reconstruction, else of the data."""
    return mmcif_files(spark, path).filter("error is null").select("name", "method", "date", "resolution")


def mmcif_transforms(spark: SparkSession, path: str) -> DataFrame:
    return transforms_of(mmcif_files(spark, path))


def chain_residues(files: DataFrame, atoms: tuple[str, ...] = ("N", "CA", "C", "O"), need: tuple[str, ...] = ("N", "CA", "C")) -> DataFrame:
    """(name, chain, entity, pos, aa, resname, observed, one column of coordinates per atom): every residue of each polypeptide's full sequence.

    What was not observed has nulls. A letter of the sequence that names no residue is replaced by that of the parent of the observed
    residue, where a table of modified residues names one. observed: all atoms of `need` are there.
    """
    each = files.select("name", F.explode("chains").alias("c"), "parents", "residues")
    # The chain's residues by their places in the sequence.
    mine = F.transform(F.filter("residues", lambda r: r["chain"] == F.col("c.chain")), lambda r: F.struct(r["seq_id"], r))
    rows = each.select("name", "c.*", "parents", F.map_from_entries(mine).alias("seen")).select("*", F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("k", "letter"))
    at = rows.select("name", "chain", "entity", (F.col("k") + 1).alias("pos"), "letter", "parents", F.try_element_at("seen", F.col("k") + 1).alias("r"))
    known = F.col("letter").isin(*RESIDUES.values())
    parent = F.try_element_at("parents", F.col("r.resname"))
    aa = F.when(known, F.col("letter")).otherwise(F.coalesce(F.try_element_at(_letters(), parent), F.col("letter")))
    point = lambda a: F.get(F.transform(F.filter("r.atoms", lambda v: v["atom"] == a), lambda v: F.array(v["x"], v["y"], v["z"])), F.lit(0))
    xyz = {a: point(a) for a in dict.fromkeys((*atoms, *need))}
    seen = F.lit(True)
    for a in need:
        seen = seen & F.coalesce(xyz[a], F.lit(None).cast("array<double>")).isNotNull()
    return at.select("name", "chain", "entity", "pos", aa.alias("aa"), F.col("r.resname").alias("resname"), seen.alias("observed"), *(xyz[a].alias(a.lower()) for a in atoms))


def chain_headers(files: DataFrame, residues: DataFrame) -> DataFrame:
    """(name, chain, header, seq, seen): the line that describes each chain, `>id_chain date method resolution length observed`, its sequence, and the
    sequence with "-" where nothing was observed. residues: those of chain_residues.
    """
    at = F.array_sort(F.collect_list(F.struct("pos", "aa", "observed")))
    chains = residues.groupBy("name", "chain").agg(at.alias("r"))
    joined = lambda f: F.array_join(F.transform("r", f), "")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    meta = files.select("name", F.concat_ws(" ", text("date"), F.replace(text("method"), F.lit(" "), F.lit("_")), text("resolution")).alias("told"), F.coalesce("id", "name").alias("id"))
    out = chains.join(meta, "name")
    n, seen = F.size("r").cast("string"), F.size(F.filter("r", lambda x: x["observed"])).cast("string")
    header = F.concat(F.lit(">"), "id", F.lit("_"), "chain", F.lit(" "), F.concat_ws(" ", "told", n, seen))
    return out.select("name", "chain", header.alias("header"), joined(lambda x: x["aa"]).alias("seq"), joined(lambda x: F.when(x["observed"], x["aa"]).otherwise("-")).alias("seen"))


def assembled_files(files: DataFrame) -> DataFrame:
    """(name, assembly, operation, chain, seq_id, atom, resname, x, y, z) of every assembly, from each file's own row."""
    atoms = files.select("name", "transforms", F.explode("residues").alias("r")).select("name", "transforms", "r.chain", "r.seq_id", F.explode("r.atoms").alias("a"))
    mine = F.filter("transforms", lambda t: F.array_contains(F.split(t["chains"], ","), F.col("chain")))
    both = atoms.select("name", "chain", "seq_id", "a.*", F.explode(mine).alias("t")).select("*", "t.assembly", "t.operation", "t.rotation", "t.shift")
    return _moved(both)


def assembled(atoms: DataFrame, transforms: DataFrame) -> DataFrame:
    """Atoms of every assembly: each chain joined to its transforms, rotated and shifted."""
    t = transforms.withColumn("chain", F.explode(F.split("chains", ",")))
    return _moved(atoms.join(t, ["name", "chain"]))


def _moved(both: DataFrame) -> DataFrame:
    at = [sum((F.col("rotation")[i][j] * F.col(c) for j, c in enumerate("xyz")), F.lit(0.0)) + F.col("shift")[i] for i in range(3)]
    return both.select("name", "assembly", "operation", "chain", "seq_id", "atom", "resname", *(v.alias(c) for v, c in zip(at, "xyz", strict=True)))


def _letters() -> F.Column:
    return F.create_map(*(F.lit(x) for kv in RESIDUES.items() for x in kv))


def one_letter(resname) -> F.Column:
    return F.coalesce(F.try_element_at(_letters(), resname), F.lit("X"))
