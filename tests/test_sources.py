"""Records, mmCIF files with faults, dictionaries, kept stages and batches for external models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steinlake.operators import rebatch, stages
from steinlake.sources import mmcif, records
from steinlake.sources import sequences as files

# Records.


def residue_rows(spark):
    rows = [("s1", "B", 1, "M", [1.0, 2.0, 3.0], [4.0, 5.5, 6.25]), ("s1", "B", 2, "X", None, None), ("s1", "A", 1, "G", [0.1, -0.2, 1e-3], [float("nan")] * 3), ("s2", "A", 1, "K", [7.0, 8.0, 9.0], None)]
    return spark.createDataFrame(rows, "name string, chain string, pos int, aa string, n array<double>, ca array<double>")


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "records")
    records.write_records(records.records(residue_rows(spark), ("N", "CA")), path)
    lines = {json.loads(x)["name"]: json.loads(x) for x in spark.read.text(path).toPandas()["value"]}
    assert lines["s1"]["seq"] == "GMX" and lines["s1"]["num_of_chains"] == 2 and lines["s1"]["seq_chain_B"] == "MX"
    assert lines["s1"]["coords_chain_B"] == {"N_chain_B": [[1.0, 2.0, 3.0], None], "CA_chain_B": [[4.0, 5.5, 6.25], None]}
    back = records.record_residues(records.read_records(spark, path), ("N", "CA"))
    expected = residue_rows(spark).withColumn("ca", F.when(F.col("chain") != "A", F.col("ca")))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_records_as_others_write_them(spark, tmp_path):
    one = '{"seq_chain_A": "MK", "coords_chain_A": {"CA_chain_A": [[1.0, NaN, NaN], [4, 5, 6]]}, "name": "x, NaN", "num_of_chains": 1, "seq": "MK", "more": [1]}'
    path = tmp_path / "r.jsonl"
    path.write_text(one + "\n\nno json\n[1, 2]\n" + one.replace("x, NaN", "second").replace("_A", "_0") + "\n")
    read = records.read_records(spark, str(path))
    assert sorted(read.filter("error is not null").toPandas()["error"]) == ["[1, 2]", "no json"]
    rows = records.record_atoms(read).orderBy("name", "pos").collect()
    assert [(r.name, r.chain, r.atom, r.pos, r.xyz) for r in rows] == [("second", "0", "CA", 1, [1.0, None, None]), ("second", "0", "CA", 2, [4.0, 5.0, 6.0]), ("x, NaN", "A", "CA", 1, [1.0, None, None]), ("x, NaN", "A", "CA", 2, [4.0, 5.0, 6.0])]
    assert records.record_residues(read, ("N", "CA")).filter("n is null").count() == 4
    assert records.read_records(spark, str(path), limit=2).count() == 2


# mmCIF.

CIF = """data_x
_entry.id 1XYZ
_exptl.method 'ELECTRON MICROSCOPY'
_refine.ls_d_res_high ?
_em_3d_reconstruction.resolution 3.1
loop_
_entity_poly.entity_id
_entity_poly.type
_entity_poly.pdbx_strand_id
_entity_poly.pdbx_seq_one_letter_code_can
1 'polypeptide(L)' X,Y GXAX
2 polyribonucleotide Z ACGU
loop_
_pdbx_poly_seq_scheme.pdb_strand_id
_pdbx_poly_seq_scheme.asym_id
X A
Y B
Z C
loop_
_pdbx_struct_mod_residue.label_comp_id
_pdbx_struct_mod_residue.parent_comp_id
MSE MET
UNK ?
loop_
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.label_comp_id
_atom_site.label_atom_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
A 1 GLY N 0 0 1 1
A 1 GLY CA 0 0 2 0.4
A 1 GLY CA 0 0 9 0.6
A 1 GLY C 0 0 3 1
A 2 MSE CA 0 0 4 ?
A 4 UNK CA ? 0 5 1
A x UNK CA 0 0 5 1
C 1 A P 0 0 5 1
"""


def test_mmcif_entities_and_faults(spark, tmp_path):
    (tmp_path / "good.cif").write_text(CIF)
    (tmp_path / "bad.cif").write_text("data_y\nloop_\n_atom_site.label_asym_id\n_atom_site.label_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\nA 1 1 1 1\n")
    (tmp_path / "none.cif").write_text("#\n")
    parsed = mmcif.mmcif_files(spark, str(tmp_path))
    told = {r.name: r for r in parsed.collect()}
    assert "label_atom_id" in told["bad"].error and told["good"].error is None and told["good"].skipped == 2 and told["none"].residues == []
    assert (told["good"].id, told["good"].method, told["good"].resolution) == ("1XYZ", "ELECTRON MICROSCOPY", 3.1)
    rows = mmcif.chain_residues(parsed).orderBy("chain", "pos").collect()
    assert [(r.chain, r.entity, r.pos, r.aa, r.resname, r.observed) for r in rows] == [
        ("A", "1", 1, "G", "GLY", True), ("A", "1", 2, "M", "MSE", False), ("A", "1", 3, "A", None, False), ("A", "1", 4, "X", None, False),
        ("B", "1", 1, "G", None, False), ("B", "1", 2, "X", None, False), ("B", "1", 3, "A", None, False), ("B", "1", 4, "X", None, False),
    ]
    assert rows[0].ca == [0.0, 0.0, 9.0] and rows[1].ca == [0.0, 0.0, 4.0] and rows[1].n is None
    heads = mmcif.chain_headers(parsed, mmcif.chain_residues(parsed)).orderBy("chain").collect()
    assert [(r.header, r.seq, r.seen) for r in heads] == [(">1XYZ_A None ELECTRON_MICROSCOPY 3.1 4 1", "GMAX", "G---"), (">1XYZ_B None ELECTRON_MICROSCOPY 3.1 4 0", "GXAX", "----")]
    assert mmcif.mmcif_atoms(spark, str(tmp_path)).count() == 5


# Dictionaries.


def test_folded_dictionary(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"a": {"x": 1}, "b": {"x": 2}}\n\nbroken\n{"b": {"y": 3}}\n')
    got = {r.name: r.value for r in files.folded_dictionary(spark, str(tmp_path / "d.jsonl"), T.MapType(T.StringType(), T.IntegerType())).collect()}
    assert got == {"a": {"x": 1}, "b": {"y": 3}}


def test_permuted_letters(spark):
    row = spark.createDataFrame([([float(k) for k in range(20)],)], "v array<double>")
    got = row.select(files.permuted(F.col("v"), "ACDX")).first()[0]
    assert got == [0.0, 4.0, 3.0, 0.0]


# Stages.


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_stage_is_computed_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).select((F.col("id") % 7).alias("k"), "id").write.parquet(source)
    cache, calls = stages.StageCache(spark, f"file://{tmp_path}/stages"), []

    def build(df, by):
        calls.append(by)
        return df.groupBy("k").agg((F.sum("id") * by).alias("s"))

    read = lambda: spark.read.parquet(source).filter(F.exists(F.array("id"), lambda v: v >= 0))
    first = cache.stage("sums", build, [read()], {"by": 2}).orderBy("k").collect()
    assert cache.stage("sums", build, [read()], {"by": 2}).orderBy("k").collect() == first and calls == [2]
    cache.stage("sums", build, [read()], {"by": 3})
    cache.stage("sums", build, [read()], {"by": 2}, version="2")
    cache.stage("sums", build, [read().filter("id < 50")], {"by": 2})
    assert calls == [2, 3, 2, 2]
    spark.range(100, 110).select((F.col("id") % 7).alias("k"), "id").write.mode("append").parquet(source)
    again = cache.stage("sums", build, [read()], {"by": 2}).agg(F.sum("s")).first()[0]  # a new file is a new version
    assert again == 2 * sum(range(110)) and calls == [2, 3, 2, 2, 2]
    path = f"{cache.folder}/{cache.key('sums', [read()], {'by': 2})}".removeprefix("file://")
    import os

    os.remove(f"{path}/_SUCCESS")  # as a run leaves it that is killed while it writes
    assert cache.stage("sums", build, [read()], {"by": 2}).agg(F.sum("s")).first()[0] == again and len(calls) == 6


def test_batches_resume(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(200).write.parquet(source)
    cache, seen = stages.StageCache(spark, f"file://{tmp_path}/stages"), []
    batch = stages.hash_batch(4, "id")

    def build(df, fail):
        seen.append(df.count())
        if len(seen) == 3 and fail:
            raise RuntimeError("stopped")
        return df.select("id", (F.col("id") * 2).alias("v"))

    ever = lambda df, fail=False: build(df, fail)
    with pytest.raises(RuntimeError):
        cache.batches("twice", lambda df: build(df, True), spark.read.parquet(source), batch, 4)
    assert len(seen) == 3
    got = cache.batches("twice", lambda df: ever(df), spark.read.parquet(source), batch, 4)
    assert len(seen) == 5  # the third again, and the fourth
    assert got.agg(F.count("id"), F.sum("v"), F.countDistinct("batch")).first()[:] == (200, 2 * sum(range(200)), 4)
    assert cache.batches("twice", lambda df: ever(df), spark.read.parquet(source), batch, 4).count() == 200 and len(seen) == 5


def test_append_new(spark, tmp_path):
    path, rows = f"file://{tmp_path}/log", lambda a, b: spark.range(a, b).select("id", F.lit(1.5).alias("v"))
    assert stages.append_new(rows(0, 10).unionByName(rows(0, 5)), path, ["id"]) == 10
    assert stages.append_new(rows(5, 12), path, ["id"]) == 2 and stages.append_new(rows(5, 12), path, ["id"]) == 0
    assert spark.read.parquet(path).count() == 12


# Batches.


def test_modes_agree_and_pad_less(spark):
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.geometric(0.01, size=400), 900).tolist()
    rows = [(k, rng.integers(1, 30, n).tolist()) for k, n in enumerate(lengths)] + [(1000, None), (1001, [])]
    df = spark.createDataFrame(rows, "id long, tokens array<int>").repartition(3)
    most = spark.sparkContext.accumulator(0)

    def load():
        def model(b):
            most.add(1)
            if b.mode == "padded":
                assert b.tokens.size <= 2000 or len(b.lengths) == 1
                assert (b.mask.sum(1) == b.lengths).all()
                return (b.tokens * b.mask * np.arange(1, b.tokens.shape[1] + 1)).sum(1).tolist()
            parts = [b.tokens[x:y] for x, y in zip(b.offsets[:-1], b.offsets[1:], strict=True)]
            assert b.mode == "ragged" or len(parts) == 1
            return [int((p * np.arange(1, len(p) + 1)).sum()) for p in parts]

        return model

    expected = {i: None if t is None else sum(v * k for k, v in enumerate(t, 1)) for i, t in rows}
    for mode in rebatch.MODES:
        got = {r.id: r.result for r in rebatch.modelled(df, "id", "tokens", load, "long", mode, budget=2000, buffer=5000, pad=-7).collect()}
        assert got == expected
    assert rebatch.padded_cells(lengths, 2000) < 0.6 * rebatch.padded_cells(lengths, 2000, by_length=False)
    assert sum(lengths) <= rebatch.padded_cells(lengths, 2000)
    with pytest.raises(ValueError, match="mode"):
        rebatch.modelled(df, "id", "tokens", load, "long", "other")


def test_softmax_of_a_profile_of_many_letters(spark):
    """The largest value and the sum are made once a profile, not once a letter, so the work is linear in the letters."""
    from steinlake.operators import constraints

    values = [(k * 37 % 101) / 10 for k in range(1500)]
    got = spark.createDataFrame([(0, values), (1, None)], "i int, v array<double>").select("i", constraints.profile_softmax(F.col("v"), 1500).alias("p"))
    rows = {r["i"]: r["p"] for r in got.collect()}
    e = np.exp(np.array(values) - max(values))
    assert len(rows[0]) == 1501 and rows[0][-1] == 0.0 and rows[1] is None
    assert np.allclose(rows[0][:-1], e / e.sum(), rtol=1e-12)


def test_permuted_profile_evaluates_its_values_once(spark):
    """Values that are an expression are put in order in one pass."""
    from steinlake.operators import constraints

    values = F.transform("v", lambda x: x * 2)
    got = spark.createDataFrame([([float(k) for k in range(20)],), (None,)], "v array<double>").select(files.permuted(values, constraints.ALPHABET).alias("p"))

    rows = [r["p"] for r in got.collect()]
    assert rows[0] == [2.0 * files.PROFILE_LETTERS.index(a) if a in files.PROFILE_LETTERS else 0.0 for a in constraints.ALPHABET]
    assert rows[1][-1] == 0.0 and rows[1][0] is None
