"""Readers, writers, sequences, constraints, alignment and streaming on small inputs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steinlake.functions import sequences as Q
from steinlake.operators import alignment, constraints, dataset, structure
from steinlake.operators import statistics as S
from steinlake.sources import sequences as files
from steinlake.sources import structures, writers
from steinlake.streaming import linear

ATOM = "{kind:<6}{no:>5} {atom:<4} {res:>3} {chain}{num:>4}{icode} {x:>10.3f}{y:>8.3f}{z:>8.3f}\n"


def pdb(*rows):
    return "".join(ATOM.format(kind=k, no=i, atom=a, res=r, chain=c, num=n, icode=ic or " ", x=1.0 * i, y=2.0, z=3.0) for i, (k, a, r, c, n, ic) in enumerate(rows))


def test_pdb_reader(spark, tmp_path):
    (tmp_path / "one.pdb").write_text(pdb(("ATOM", " N", "GLY", "B", 1, ""), ("ATOM", " CA", "GLY", "A", 5, ""), ("ATOM", " CA", "GLY", "A", 5, ""), ("HETATM", " CA", "MSE", "A", 7, ""), ("ATOM", " CA", "TRP", "A", 7, "A"), ("HETATM", " O", "HOH", "A", 9, ""), ("ATOM", " CA", "UNK", "A", 8, "")))
    res = structures.read_pdb(spark, str(tmp_path)).orderBy("chain", "pos").collect()
    assert [(r.chain, r.resnum, r.icode, r.aa) for r in res] == [("A", 5, "", "G"), ("A", 6, "", "X"), ("A", 7, "", "M"), ("A", 7, "A", "W"), ("A", 8, "", "X"), ("B", 1, "", "G")]
    assert res[0].ca == [1.0, 2.0, 3.0] and res[1].ca is None and res[0].n is None
    one = structures.structures(structures.read_pdb(spark, str(tmp_path))).first()
    assert (one.name, one.num_of_chains, one.seq) == ("one", 2, "GXMWXG")
    assert structures.read_pdb(spark, str(tmp_path), most_lines=3).count() == 0


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">toy, score=2.25, designed_chains=['A', 'B'], seed=4\nACD\nEF-\n>T=0.3, sample=1, seq_recovery=0.75\nGH\n")
    rows = files.read_fasta(spark, str(path), omit="-").orderBy("number")
    assert [(r.number, r.sequence) for r in rows.collect()] == [(0, "ACDEF"), (1, "GH")]
    f = rows.select(files.header_field(F.col("header"), "score"), files.header_field(F.col("header"), "designed_chains"), files.header_field(F.col("header"), "seq_recovery")).collect()
    assert [tuple(r) for r in f] == [("2.25", "['A', 'B']", None), (None, None, "0.75")]
    assert files.read_fasta(spark, str(path), limit=1).count() == 1
    out = str(tmp_path / "out")
    writers.write_fasta(rows, out)
    assert files.read_fasta(spark, out).count() == 2


def test_tables_from_text(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,v0,v1\na,1.0,2.0\nb,NaN,1.0\n")
    assert {r.id: r.v for r in files.read_encodings(spark, str(tmp_path / "e.csv"), 2).collect()} == {"a": [1.0, 2.0], "b": None}
    (tmp_path / "d.jsonl").write_text('{"x": {"A": [9]}}\n{"x": {"A": [1, 2]}, "y": {"B": []}}\n')
    d = files.read_dictionary(spark, str(tmp_path / "d.jsonl"), T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
    assert {r.name: r.value for r in d.collect()} == {"x": {"A": [1, 2]}, "y": {"B": []}}
    (tmp_path / "p.txt").write_text("head\nhead\n  1 0.5 1.5\n  2 2.5 3.5\n")
    assert [(r.pos, r["values"]) for r in files.read_profile(spark, str(tmp_path / "p.txt"), letters=2).collect()] == [(1, [0.5, 1.5]), (2, [2.5, 3.5])]
    (tmp_path / "log.txt").write_text("Epoch\tTrain\nepoch: 3, step: 12, time: 8.5, train: 4.25, valid: 5.5, train_acc: 0.5, valid_acc: 0.25\n")
    assert tuple(files.read_training_log(spark, str(tmp_path / "log.txt")).first()) == (3, 12, 8.5, 4.25, 5.5, 0.5, 0.25)
    (tmp_path / "s.jsonl").write_text('{"name": "a", "seq": "ACX-", "num_of_chains": 1}\n{"name": "b", "seq": "ABZ", "num_of_chains": 1}\n')
    assert [r.name for r in structures.read_structure_lines(spark, str(tmp_path / "s.jsonl")).collect()] == ["a"]


def test_result_log(spark, tmp_path):
    r = spark.createDataFrame([(0.5, [0.1, 0.2])], "val double, h0 array<double>")
    for _ in range(2):
        writers.append_results(r, str(tmp_path / "r"))
        writers.append_results(r, str(tmp_path / "c"), "csv")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["val"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(Q.PROTEIN_X, max_size=12), min_size=1, max_size=6))
def test_encode_decode(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in rows.select(Q.decode(Q.encode(F.col("s"), Q.PROTEIN_X), Q.PROTEIN_X)).collect()] == texts


def test_sequence_helpers(spark):
    s = spark.createDataFrame([("AC?",)], "s string")
    assert s.select(Q.encode(F.col("s"), "ACD")).first()[0] == [0, 1, None]
    assert s.select(Q.bits(F.col("s"), "ACD", 5)).first()[0] == [2, 4, 1, 1, 1]
    assert s.select(Q.with_stop(F.col("s"))).first()[0] == "AC?]"
    t = spark.createDataFrame([("MHHHHHHACDEFG",), ("ACDEFGHHHHHH",), ("HHHHHHACD",), ("ACDEFG",)], "s string")
    assert [r[0] for r in t.select(Q.trim_tags(F.col("s"))).collect()] == ["ACDEFG", "ACDEFG", None, "ACDEFG"]
    assert spark.range(1).select(Q.operations(F.lit("(1-3,5)"))).first()[0] == [1, 2, 3, 5]
    assert spark.range(1).select(Q.chain_number(F.lit("C")), Q.chain_letter(F.lit(2))).first()[:] == (2, "C")


def test_one_hot_stops_and_fill(spark):
    s = spark.createDataFrame([(0, "AC?D"), (1, ""), (2, None), (3, "A]")], "k int, s string").coalesce(1)
    hot = lambda *a, **k: [r[0] for r in s.orderBy("k").select(Q.one_hot(F.col("s"), "ACD", *a, **k)).collect()]
    assert hot() == [[[1, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 1]], [], None, [[1, 0, 0], [0, 0, 0]]]
    assert hot(3)[0] == [[1, 0, 0], [0, 1, 0], [0, 0, 0]] and hot(2)[1] == [[0, 0, 0]] * 2 and hot(2)[2] is None
    assert hot(5, stop=True)[3] == [[1, 0, 0, 0], [0, 0, 0, 1], *[[0] * 4] * 3]
    assert hot(5, stop=True, fill=True)[0] == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1]]
    with pytest.raises(ValueError, match="column for them"):
        Q.one_hot(F.col("s"), "ACD", fill=True)
    rows = spark.createDataFrame([([0, 2, None],), ([],), ([1],)], "t array<int>").select(Q.one_hot_tokens(F.col("t"), 3).alias("h"))
    got = rows.select("h", Q.one_hot_lengths("h").alias("n"), Q.one_hot_stops("h").alias("w")).collect()
    assert got[0].h == [[1, 0, 0], [0, 0, 1], [0, 0, 0]] and [r.n for r in got] == [2, 0, 1]
    assert got[0].w == [[1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0]] and got[1].w is None and got[2].w == [[0, 1, 0, 0], [0, 0, 0, 1]]


def test_indices_are_padded_within_groups(spark):
    rows = spark.createDataFrame([(0, "a", "AC"), (1, "a", "D?CA"), (2, "b", ""), (3, None, "C"), (4, None, None)], "k int, g string, s string")
    rows = rows.withColumn("t", Q.indices(F.col("s"), "ACD")).drop("s")
    nan = float("nan")
    plain = lambda df: {r.k: None if r.t is None else [None if x != x else x for x in r.t] for r in df.collect()}
    assert plain(dataset.padded_to_longest(rows, "t", F.lit(nan), ["g"])) == {0: [0.0, 1.0, None, None], 1: [2.0, None, 1.0, 0.0], 2: [], 3: [1.0], 4: None}
    assert plain(dataset.padded_to_longest(rows, "t", F.lit(nan), extra=1))[3] == [1.0, None, None, None, None]
    assert dataset.padded_to_longest(rows.limit(0), "t", F.lit(nan)).count() == 0
    stops = spark.createDataFrame([("AC]",)], "s string").select(Q.indices(F.col("s"), "ACD", F.lit(2), stop=True), Q.indices(F.col("s"), "ACD", F.lit(3), stop=True))
    assert stops.first()[:] == ([0.0, 1.0], [0.0, 1.0, 3.0])


def test_condition_index(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 9), ("b", 2), (None, 1), ("b", 1)], "x string, y int")
    assert {(r.x, r.y): r.k for r in dataset.condition_index(rows, ["x", "y"]).collect()} == {(None, 1): 0, ("a", 9): 1, ("b", 1): 2, ("b", 2): 3}


def test_chain_segments(spark):
    rows = spark.createDataFrame([("s", "B", 2, "C"), ("s", "B", 1, "A"), ("s", "A", 1, "G"), ("t", "C", 1, "K")], "name string, chain string, pos int, aa string")
    assert {r.name: (r.seq, r.chains) for r in structures.chain_segments(rows).collect()} == {"s": ("G/AC", ["A", "B"]), "t": ("K", ["C"])}
    only = spark.createDataFrame([("s", "B"), ("s", "B")], "name string, chain string")
    assert [tuple(r) for r in structures.chain_segments(rows, only).collect()] == [("s", "AC", ["B"])]


def test_result_names(spark):
    paths = spark.createDataFrame([(0, "../models/run.1/v_48.ckpt"), (1, "plain"), (2, None)], "k int, p string").orderBy("k")
    assert [r[0] for r in paths.select(writers.result_name("p")).collect()] == ["models_run.1_v_48.csv", "plain.csv", None]


def test_constraints(spark):
    chains = spark.createDataFrame([("x", "A"), ("x", "B"), ("x", "C")], "name string, chain string")
    assert tuple(constraints.assign_chains(chains, ["A", "B"]).first()) == ("x", ["A", "B"], ["C"])
    lengths = spark.createDataFrame([("x", "A", 4), ("x", "B", 4)], "name string, chain string, length int")
    listed = spark.createDataFrame([("x", "A", 2), ("x", "A", 9)], "name string, chain string, pos int")
    assert {r.chain: r.positions for r in constraints.fixed_positions(lengths, listed).collect()} == {"A": [2], "B": []}
    assert {r.chain: r.positions for r in constraints.fixed_positions(lengths, listed, True).collect()} == {"A": [1, 3, 4], "B": [1, 2, 3, 4]}
    assert constraints.tied_homomer(lengths).count() == 4
    assert constraints.tied_explicit(["A", "B"], [[1, 2], [3, 4]], [1.0, -1.0]) == [(0, "A", 1, 1.0), (0, "B", 3, -1.0), (1, "A", 2, 1.0), (1, "B", 4, -1.0)]
    with pytest.raises(ValueError):
        constraints.tied_explicit(["A"], [[1], [2]])
    j = constraints.one_row_json(spark.createDataFrame([("x", "A", [1, 2])], "name string, chain string, v array<int>"), "name", "chain", "v").first()
    assert j.json == '{"x":{"A":[1,2]}}'


def test_dataset_helpers(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 3), (3, "a", 3)], "id int, k string, v int")
    assert [r.id for r in dataset.where_equal(rows, {"k": "a", "v": 3}).collect()] == [3]
    assert dataset.where_equal(rows, {}).count() == 3 and dataset.where_equal(rows, {"v": None}).count() == 1
    assert [r.id for r in dataset.head(rows, 2, "id").collect()] == [1, 2]
    g = dataset.grid(spark, a=[1, 2], b=["x", "y", "z"])
    assert g.count() == 6
    nan = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0]), (3, None)], "id int, v array<double>")
    assert [r.id for r in dataset.align(rows.select("id"), nan, "id", ("v",)).collect()] == [2]


def test_knn_mask(spark):
    n = spark.createDataFrame([("s", 0, [0.0, 0.0, 0.0], True), ("s", 1, [1.0, 0.0, 0.0], True), ("s", 2, [5.0, 0.0, 0.0], True), ("s", 3, [0.1, 0.0, 0.0], False)], "name string, node int, xyz array<double>, ok boolean")
    e = structure.knn_edges(n, 2, mask="ok").filter("src = 0").orderBy("rank").collect()
    assert [x.dst for x in e] == [0, 1] and e[1].dist == pytest.approx((1 + 1e-6) ** 0.5)
    assert structure.knn_edges(n, 9).filter("src = 0").count() == 4


def naive(k, gamma):
    h, w = k.shape
    m = np.full((h + 1, w + 1), -np.inf)
    m[0, 0] = 0
    for i in range(h):
        for j in range(w):
            m[i + 1, j + 1] = k[i, j] + gamma * np.logaddexp.reduce(np.array([m[i, j], m[i, j + 1], m[i + 1, j]]) / gamma)
    return m[h, w]


@pytest.mark.parametrize("shape", [(1, 1), (1, 2), (2, 1), (3, 5)])
def test_alignment_against_direct_recursion(spark, shape):
    rng = np.random.default_rng(3)
    p, q = rng.normal(size=(shape[0], 2)), rng.normal(size=(shape[1], 2))
    row = spark.createDataFrame([(0, 1, p.tolist(), q.tolist())], "a_i long, b_i long, a_points array<array<double>>, b_points array<array<double>>")
    expected = naive(-((p[:, None] - q) ** 2).sum(-1) / 2, 0.7)
    assert alignment.soft_alignment(row, gamma=0.7).first().log_k == pytest.approx(expected)


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=2).tolist(), rng.normal(size=2).tolist()) for i in range(20)], "i long, x array<double>, y array<double>")
    rows.filter("i < 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.filter("i >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = linear.start(stream, S.mmd(), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    from steinlake.plans import hypothesis as H

    a, b = linear.current(spark, str(tmp_path / "out")).first(), H.run_test(rows, S.mmd(), H.TestConfig(diagonals=1)).first()
    assert a.m == b.m == 10 and a.val == pytest.approx(b.val) and a.quantile == pytest.approx(b.quantile)


def test_stream_carries_rows_over_batch_borders(spark, tmp_path):
    """A pair whose rows come in different micro-batches counts as in one table, however far apart they come."""
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, rng.normal(size=2).tolist(), rng.normal(size=2).tolist()) for i in range(21)], "i long, x array<double>, y array<double>")
    for k, part in enumerate(("i < 7", "i >= 7 and i < 10 or i = 13", "i >= 10 and i <> 13 and i < 20", "i = 20")):
        rows.filter(part).coalesce(1).write.mode("append" if k else "error").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = linear.start(stream, S.mmd(), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    from steinlake.plans import hypothesis as H

    a, b = linear.current(spark, str(tmp_path / "out")).first(), H.run_test(rows, S.mmd(), H.TestConfig(diagonals=1)).first()
    assert a.m == b.m == 10 and a.val == pytest.approx(b.val) and a.quantile == pytest.approx(b.quantile)


def test_quantile_by_counting(spark, monkeypatch):
    from steinlake.operators import bandwidth

    monkeypatch.setattr(bandwidth, "SORTED", 20)
    monkeypatch.setattr(bandwidth, "ACCURACY", 10)
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.exponential(size=500), np.full(200, 0.7), [1e6]])
    rows = spark.createDataFrame([(float(v),) for v in values], "d double").persist()
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert bandwidth.exact_quantile(rows, q).first()[0] == pytest.approx(np.quantile(values, q))
    assert bandwidth.exact_quantiles(rows, [0.5, 0.1, 0.95]) == pytest.approx([np.quantile(values, q) for q in (0.5, 0.1, 0.95)])
    assert bandwidth.exact_quantile(rows.limit(0)).first()[0] is None


def test_quantiles_of_values_that_are_not_finite(spark, monkeypatch):
    from steinlake.operators import bandwidth

    monkeypatch.setattr(bandwidth, "SORTED", 10)
    inf, nan = float("inf"), float("nan")
    values = [-inf] * 100 + [float(k % 50) for k in range(300)] + [inf] * 50 + [nan] * 50
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "d double")
    found = bandwidth.exact_quantiles(rows, [0.0, 0.1, 0.5, 0.85, 0.95, 1.0])
    assert found[:2] == [-inf, -inf] and found[2] == np.quantile([v for v in values[:400]], 249.5 / 399) and found[3] == inf and all(np.isnan(found[4:]))
    assert bandwidth.exact_quantiles(spark.createDataFrame([(inf,)] * 30, "d double"), [0.5]) == [inf]
    assert np.isnan(bandwidth.exact_quantile(spark.createDataFrame([(nan,)] * 30, "d double")).first()[0])
    two = spark.createDataFrame([(float(k % 2),) for k in range(60)], "d double")  # ties only
    assert bandwidth.exact_quantiles(two, [0.25, 0.5, 0.75]) == [0.0, 0.5, 1.0]


def test_distances_are_evaluated_once(spark, monkeypatch):
    """Two ranks of an even median, bracketed and counted, read one evaluation."""
    from steinlake.operators import bandwidth

    monkeypatch.setattr(bandwidth, "SORTED", 10)
    seen = spark.sparkContext.accumulator(0)

    def note(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.range(1000).select(F.col("id").cast("double").alias("d")).mapInPandas(note, "d double")
    assert bandwidth.exact_quantiles(rows, [0.5, 0.9]) == [499.5, pytest.approx(899.1)]
    assert seen.value == 1000


def test_missing_lookup_stops(spark):
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "name string, n int")
    d = spark.createDataFrame([("x", 5.0)], "name string, v double")
    with pytest.raises(Exception, match="no entry for y"):
        dataset.looked_up(rows, d, ["name"], "v").collect()


def test_quaternions_of_frames(spark):
    t = 0.6
    r = [[np.cos(t), -np.sin(t), 0.0], [np.sin(t), np.cos(t), 0.0], [0.0, 0.0, 1.0]]
    q = spark.range(1).select(structure.quaternion([F.array(*map(F.lit, map(float, x))) for x in r])).first()[0]
    assert q == pytest.approx([0, 0, np.sin(t / 2), np.cos(t / 2)], abs=1e-7)
    rng = np.random.default_rng(9)
    p = rng.normal(size=(3, 3))
    frame = spark.range(1).select(*(c.alias(f"r{k}") for k, c in enumerate(structure.local_frame(*(F.array(*map(F.lit, map(float, x))) for x in p))))).first()
    m = np.array([list(x) for x in frame])
    assert m @ m.T == pytest.approx(np.eye(3), abs=1e-9) and np.linalg.det(m) == pytest.approx(1)


def test_residues_of_gaps_and_insertions_read_their_lines_once(spark):
    """Missing numbers become X, insertion codes follow their number, first lines win; the lines are scanned once."""
    rows = [
        ("s", 0, "CA", "GLY", "A", 3, "", 1.0), ("s", 1, "CA", "ALA", "A", 3, "", 2.0), ("s", 2, "N", "GLY", "A", 3, "", 5.0), ("s", 3, "CA", "TRP", "A", 3, "B", 3.0),
        ("s", 4, "CB", "LYS", "A", -1, "", 4.0), ("s", 5, "CA", "ZZZ", "B", 7, "", 6.0), ("s", 6, "CA", "LYS", "B", None, "", 7.0),
    ]
    atoms = spark.createDataFrame(rows, "name string, line_no int, atom string, resname string, chain string, resnum int, icode string, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = structures.residues(atoms, ("N", "CA"))
    found = sorted((r.chain, r.pos, r.resnum, r.icode, r.aa, r.n and r.n[0], r.ca and r.ca[0]) for r in got.collect())
    expected = [("A", 1, -1, "", "K", None, None), *(("A", k + 2, k, "", "X", None, None) for k in range(3)), ("A", 5, 3, "", "G", 5.0, 1.0), ("A", 6, 3, "B", "W", None, 3.0), ("B", 1, 7, "", "X", None, 6.0)]
    assert found == expected
    assert dict(got.dtypes) | {"pos": "int", "resnum": "int", "icode": "string"} == dict(got.dtypes)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_files_come_to_workers_in_small_batches(spark, tmp_path):
    """Each text is the size of its batch; the session's own setting is back afterwards."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"name": [f"f{i}" for i in b.column(0).to_pylist()], "text": [f"{b.num_rows} é"] * b.num_rows})

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    folder = writers.write_named(spark.range(0, 300, 1, 1).mapInArrow(sizes, "name string, text string"), f"file://{tmp_path}/out", ".txt")
    texts = [p.read_bytes().decode() for p in (tmp_path / "out").iterdir() if p.suffix == ".txt" and not p.name.startswith(".")]
    assert len(texts) == 300 and all(t.endswith(" é\n") and int(t.split()[0]) <= 64 for t in texts)
    assert folder.endswith("/out") and spark.conf.get(setting) == before


def test_profile_dictionaries_are_made_in_one_exchange_and_parsed_once(spark, tmp_path):
    """A line for each column of coefficients, the last one counting, from one exchange; blank lines are none, and no filter parses the text as well."""
    rows = [(n, c, k, -1.0, k / 4, [k / 2] * 3, [float(k)] * 3) for n in ("s", "t") for c in "BA" for k in (2, 1)]
    df = spark.createDataFrame(rows, "name string, chain string, pos int, old double, coef double, bias array<double>, log_odds array<double>").repartition("name")
    text = files.profile_lines(df, ("old", "coef"))
    assert text._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.name: r.text for r in text.collect()}
    one = {r.name: r.text for r in files.profile_lines(df.drop("old")).collect()}
    assert got["s"].split("\n\n")[1] == one["s"] and got["s"].count('"pssm_coef":[-1.0,-1.0]') == 2
    (tmp_path / "p.jsonl").write_text("\r\n \n" + got["s"] + "\r\n\r\n" + one["t"] + "\n \r\n")
    read = files.read_profiles(spark, str(tmp_path / "p.jsonl"))
    assert sorted(map(tuple, read.collect())) == sorted((n, c, k, k / 4, [k / 2] * 3, [float(k)] * 3) for n in ("s", "t") for c in "AB" for k in (1, 2))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
