"""The mmCIF reader on a small file with loops, quotes, text blocks, two models and alternatives."""

import gzip

import pytest
from pyspark.sql import functions as F

from steinlake.sources import mmcif

TEXT = """data_1ABC
#
_exptl.method 'X-RAY DIFFRACTION'
_pdbx_database_status.recvd_initial_deposition_date 2001-02-03
_refine.ls_d_res_high ?
_reflns.d_resolution_high 2.10
_struct.title
;A title
loop_ of text
;
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.pdbx_PDB_model_num
ATOM CA GLY A 1 1.0 2.0 3.0 0.40 1
ATOM CA GLY A 1 9.0 2.0 3.0 0.60 1
ATOM "C1'" ALA A 2 4.0 5.0 6.0 1.00 1
HETATM O HOH B . 7.0 8.0 9.0 1.00 1
ATOM CA GLY A 1 0.0 0.0 0.0 1.00 2
loop_
_pdbx_struct_assembly_gen.assembly_id
_pdbx_struct_assembly_gen.oper_expression
_pdbx_struct_assembly_gen.asym_id_list
1 (1-2) A,B
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
2 0 -1 0 5 1 0 0 0 0 0 1 0
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("cif")
    (path / "1abc.cif.gz").write_bytes(gzip.compress(TEXT.encode()))
    return str(path)


def test_atoms(spark, folder):
    rows = mmcif.mmcif_atoms(spark, folder).orderBy("seq_id").collect()
    assert [(r.name, r.chain, r.seq_id, r.atom, r.resname, r.x) for r in rows] == [("1abc", "A", 1, "CA", "GLY", 9.0), ("1abc", "A", 2, "C1'", "ALA", 4.0)]
    letters = mmcif.mmcif_atoms(spark, folder).orderBy("seq_id").select(mmcif.one_letter(F.col("resname"))).collect()
    assert [r[0] for r in letters] == ["G", "A"]


def test_meta(spark, folder):
    assert tuple(mmcif.mmcif_meta(spark, folder).first()) == ("1abc", "X-RAY DIFFRACTION", "2001-02-03", 2.1)


def test_assembly(spark, folder):
    out = mmcif.assembled(mmcif.mmcif_atoms(spark, folder), mmcif.mmcif_transforms(spark, folder)).filter("seq_id = 1").orderBy("operation").collect()
    assert [(r.operation, r.x, r.y, r.z) for r in out] == [("1", 9.0, 2.0, 3.0), ("2", 3.0, 9.0, 3.0)]


def test_plain_lines_need_no_pattern(monkeypatch):
    """Only lines with a quote, a comment, a name or a keyword are searched; what is read is the same as by the pattern alone."""
    atoms = [f"A {k} GLY CA {k}.5 0.25 -1.0 0.50 1" for k in range(1, 200)]
    names = "label_asym_id label_seq_id label_comp_id label_atom_id Cartn_x Cartn_y Cartn_z occupancy pdbx_PDB_model_num".split()
    text = "\n".join(["data_q", "_exptl.method 'X-RAY # DIFFRACTION'", "loop_", *(f"_atom_site.{n}" for n in names), *atoms, "B 1 'C D' \"N'\" 1 2 3 . 1 # end", "A 7 x#y CA 1 2", "? 0.5 1", "_entry.id", "9ABC", ";", ""])
    pattern, searched = mmcif._TOKEN, []

    class Counted:
        def finditer(self, line):
            searched.append(line)
            return pattern.finditer(line)

    monkeypatch.setattr(mmcif, "_TOKEN", Counted())
    got, found = mmcif.categories(text), list(mmcif.tokens(text))
    assert len(searched) <= 2 * (text.count("\n") - len(atoms))
    rows = got["_atom_site"]
    assert got["_entry"] == [{"id": "9ABC"}] and got["_exptl"] == [{"method": "X-RAY # DIFFRACTION"}] and len(rows) == 201
    assert [list(r.values()) for r in rows[:199]] == [a.split() for a in atoms] and list(rows[0]) == names
    assert list(rows[199].values()) == ["B", "1", "C D", "N'", "1", "2", "3", ".", "1"] and list(rows[200].values()) == ["A", "7", "x#y", "CA", "1", "2", "?", "0.5", "1"]
    assert [v for v, quoted in found if quoted] == ["X-RAY # DIFFRACTION", "C D", "N'", ""]
