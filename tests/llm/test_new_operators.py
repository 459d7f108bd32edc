"""License scans, whitening and hard negatives against brute force, with awkward rows in every table."""

import math
import random
import re
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from steinlake.llm import licenses, near_duplicates, negatives, vectors, whitening

UPPER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# Licenses.


def brute_base(text):
    """n_words, n_base, first, last and labels of the base phrases, by looking at every place."""
    words = WORD.findall((text or "").translate(UPPER))
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def brute_labels(text):
    words = WORD.findall((text or "").translate(UPPER))
    return {label for phrase, label in (licenses.BASE | licenses.NOTICES).items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()}


def test_licenses_against_brute_force(spark):
    rng = random.Random(5)
    pieces = [*licenses.BASE, *licenses.NOTICES, "Under The MIT-License", "apache license version", "cc by", "Ünder the mit license", "x", "mit", "İstanbul", "\n", "license 2 0", "。", "ⅷ by nc"]
    texts = [rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [None, "", "...", "under the mit license" * 2, "under the mit license " * 5, "UNDER THE MIT LICENSE under the mit license", "cc by nc " * 40_000, "w" * 300_000 + " cc by nc"]
    df = spark.createDataFrame([(k, t, 1, "x", 0.5) for k, t in enumerate([*texts, texts[5]])], "doc_id long, text string, n_words int, labels string, kept0 double")
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = [*texts, texts[5]][r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text)
        assert set(r.labels.split(",")) - {""} == brute_labels(text) and len(r.places) >= r.n_base and r.expressions == []
        assert r.score == max((licenses.level_of(x) for x in brute_labels(text)), default=0.0)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    kept = licenses.scan_licenses(df.withColumn("a.b", F.lit(1)), keep=("doc_id", "a.b", "n_words")).columns
    assert kept[:3] == ["doc_id", "a.b", "n_words"]


@pytest.mark.parametrize(
    ("line", "form", "labels", "level"),
    [
        ("SPDX-License-Identifier: MIT", "mit", "mit", 0.25),
        ("// spdx-license-identifier:MIT OR Apache-2.0 */", "mit apache-2.0 or", "apache-2,mit", 0.25),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", "gpl-2.0-only classpath-exception-2.0 with mit and", "classpath-exception-2,gpl-2,mit", 0.5),
        ("SPDX-License-Identifier: MIT or GPL-3.0+ and CC-BY-NC-4.0", "mit gpl-3.0+ cc-by-nc-4.0 and or", "cc-by-nc,gpl-3,mit", 0.25),
        ("SPDX-License-Identifier: (MIT or GPL-3.0) and AGPL-3.0", "mit gpl-3.0 or agpl-3.0 and", "agpl-3,gpl-3,mit", 0.85),
        ("License-Expression: Some-Own-Terms", "some-own-terms", "some-own-terms", 1.0),
        ("SPDX-License-Identifier: MIT. Or so they say", "mit", "mit", 0.25),
        ("SPDX-License-Identifier: MIT OR (GPL-2.0", "mit", "mit", 0.25),
        ("SPDX-License-Identifier: MIT BSD-3-Clause", "mit", "bsd-3-clause,mit", 0.25),
        ("SPDX-License-Identifier: MIT CC-BY-NC", "mit", "cc-by-nc,mit", 1.0),
        ("SPDX-License-Identifier: OR MIT", None, "", 0.0),
        ("SPDX-License-Identifier: (MIT", None, "", 0.0),
        ("SPDX-License-Identifier:\nMIT", None, "", 0.0),
        ("the SPDX license identifier is short", None, "", 0.0),
    ],
)
def test_tagged_expressions(line, form, labels, level):
    row = licenses.scan_text(licenses.automaton(), ("ä before\n" + line + "\nafter").encode())
    assert [x["postfix"] for x in row[7 + 1]] == ([form] if form else [])
    assert row[5] == labels and row[6] == level


def naive_level(node):
    if isinstance(node, str):
        return licenses.level_of(licenses.label_of(node))
    op, a, b = node
    x, y = naive_level(a), naive_level(b)
    return max(x, y) if op == "and" else min(x, y)


NODES = st.recursive(st.sampled_from(["mit", "gpl-3.0-only", "cc0-1.0", "agpl-3.0", "lgpl-2.1", "cc-by-nc-nd-4.0", "odd"]), lambda s: st.tuples(st.sampled_from(["and", "or"]), s, s), max_leaves=12)


def written(node):
    return node if isinstance(node, str) else f"({written(node[1])} {node[0].upper()} {written(node[2])})"


@settings(max_examples=200, deadline=None)
@given(NODES)
def test_parser_against_trees(node):
    tokens, _ = licenses.tokens_after((" " + written(node)).lower().encode())
    assert licenses.postfix(tokens)[1] == len(tokens) and licenses.evaluated(licenses.postfix(tokens)[0])[0] == naive_level(node)
    for cut in range(len(tokens)):  # a beginning never fails, and is an expression or nothing
        part, _ = licenses.postfix(tokens[:cut])
        assert not part or licenses.evaluated(part)[0] >= 0.1


# Vectors.


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(-300, 300), max_size=20))
def test_packed_vectors(x):
    a = np.array(x, np.int64)
    assert np.array_equal(np.pad(vectors.unpack(vectors.pack(a)), (0, len(x)))[: len(x)], a)
    assert vectors.pack(np.append(a, [0, 0])) == vectors.pack(a)
    planes = negatives.stacked(negatives.bit_planes(a[None, :]), -(-max(1, len(x)) // 8))
    assert np.array_equal(negatives.values(planes)[0, : len(x)], a)


def awkward(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, lab, 1.0, "z") for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label long, n double, v string")


# Whitening.


def exact_whitening(x, k=4):
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    white = (x - total / n) @ q[:, :k] / np.sqrt(e[:k])
    return n, ((n * x.astype(object) - total) ** 2).sum(axis=1), white, e[:k] / e.sum()


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening(spark, parts):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 70)) * np.linspace(0.1, 2, 70)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(7, rows[7][1], 1)] * 60 + [(None, rows[9][1], 1), (1000, [0.5] * 3, 2), (1001, [], 2)]
    bad = [(2000, None, 0), (2001, [None] * 70, 0), (2002, [float("nan")] * 70, 0), (2003, [float("-inf")] + [0.0] * 69, 0)]
    got = whitening.whiten(awkward(spark, rows + bad).repartition(parts)).collect()
    full = np.array([np.pad(np.array(v, float), (0, 70 - len(v))) for _, v, _ in rows])
    whole = np.floor(256 * full).astype(np.int64)
    n, deviation, white, explained = exact_whitening(whole)
    assert len(got) == 4 * len(rows)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    sign = {}
    for (i, _, _), d, w in zip(rows, deviation, white, strict=True):
        mine = by[(i, Decimal(int(d)))]
        for c in range(1, 5):
            r = mine[c]
            if abs(w[c - 1]) > 1e-3:
                sign.setdefault(c, np.sign(r.whitened * w[c - 1]))
            assert r.n == n and r.explained == pytest.approx(explained[c - 1], rel=1e-10) and r.identity_error < 1e-9
            assert r.whitened * sign.get(c, 1) == pytest.approx(w[c - 1], abs=1e-8)


def test_whitening_rest(spark):
    none = awkward(spark, [(1, None, 0)])
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none.limit(0)).count() == 0
    one = whitening.whiten(awkward(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)] * 2
    flat = whitening.whiten(awkward(spark, [(1, [1.0, 2.0, 3.0], 0), (2, [2.0, 2.0, 3.0], 0)])).orderBy("vec_id", "component").collect()
    assert [abs(r.whitened) if r.whitened is not None else None for r in flat] == [1.0, None, None] * 2 and flat[0].identity_error == 0
    far = whitening.whiten(awkward(spark, [(1, [2.0**52], 0), (2, [-(2.0**52)], 0), (3, [1.0], 0)])).orderBy("vec_id").collect()
    x = [2**60, -(2**60), 256]
    assert [int(r.deviation) for r in far] == [(3 * v - sum(x)) ** 2 for v in x]
    with pytest.raises(ValueError, match="does not fit the driver"):
        whitening.whiten(awkward(spark, [(1, [0.0] * 2049, 0)]))


@pytest.mark.parametrize("gaps", [[1.0] * 8, [1, 1 + 1e-9, 1 + 2e-9, 2, 2 + 1e-12, 3, 4, 5], [1e-6, 1e-6 * (1 + 1e-8), 1e-3, 1, 1 + 1e-15, 7, 7, 9]])
def test_refinement_of_clusters(gaps):
    """Residuals and right angles at the rounding of doubles, and vectors of a cluster apart, against rational-size arithmetic in long doubles."""
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    a = (q * np.array(gaps)) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.eigenpairs(a)
    assert list(e) == sorted(e, reverse=True)
    assert np.abs(a @ x - x * e).max() < 4e-15 * max(gaps) and np.abs(x.T @ x - np.eye(8)).max() < 2e-15
    assert np.abs(np.sort(e) - np.linalg.eigvalsh(a)).max() < 1e-14 * max(gaps)


def test_refinement_resolves_what_float32_cannot():
    """Diagonal blocks with a known rotation: eigenvalues 1e-8 apart, far below float32, whose vectors are known."""
    c, s = math.cos(0.3), math.sin(0.3)
    turn = np.eye(4)
    turn[:2, :2] = [[c, -s], [s, c]]
    a = turn @ np.diag([1.0, 1.0 + 2.0**-26, 3.0, 5.0]) @ turn.T
    _, x = whitening.eigenpairs((a + a.T) / 2)
    assert abs(abs(x[:2, 2] @ np.array([-s, c])) - 1) < 1e-12
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert max(abs(start[:2, k] @ np.array([-s, c])) for k in range(4)) < 1 - 1e-9


# Hard negatives.


def brute_negatives(rows, factor=256):
    d = max((len(v) for _, v, _ in rows), default=0)
    x = {k: [int(math.floor(factor * c)) for c in v] + [0] * (d - len(v)) for k, (_, v, _) in enumerate(rows)}
    out = []
    for a in sorted({i for i, _, _ in rows if i % 100 == 0}):
        ka = min((k for k in x if rows[k][0] == a), key=lambda k: (rows[k][2], negatives.bit_planes(np.array([x[k]]))[0]))
        score = {k: sum(p * q for p, q in zip(x[ka], x[k], strict=True)) for k in x if rows[k][0] != a}
        order = sorted(score, key=lambda k: (-score[k], rows[k][0]))
        for p in [k for k in order if rows[k][2] == rows[ka][2]][:5]:
            fit = [k for k in order if rows[k][2] != rows[ka][2] and 80 * score[p] <= 100 * score[k] <= 100 * score[p]][:5]
            out += [(a, rows[p][0], r, rows[k][0], score[p], score[k]) for r, k in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "part", "bins"), [(4096, 8192, 256), (3, 11, 2)])
def test_negatives_against_brute_force(spark, block, part, bins):
    rng = np.random.default_rng(9)
    rows = [(10 * k, (rng.normal(size=11) + (k % 3 == 0)).tolist(), int(k % 4 if k % 3 else 0)) for k in range(160)]
    rows += [(2001 + k, rows[40][1], k % 2) for k in range(60)]  # one vector many times: ties
    rows += [(100, rows[3][1], 1), (2030, rows[40][1], 0), (3000, [1.0, 2.0], 1), (3001, [], 1), (3100, [-0.5] * 11, 99)]
    bad = [(4000, None, 1), (4001, [None], 1), (4100, [float("nan")] * 11, 1), (4200, [float("inf")] * 11, 1), (4300, [1.0] * 11, None), (None, [1.0] * 11, 1)]
    df = awkward(spark, rows + bad).withColumn("p", F.lit(1)).withColumn("bin", F.lit("q"))
    got = negatives.mine_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"), block=block, part=part, bins=bins).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows)
    assert {r.rank for r in got} == {1, 2, 3, 4, 5}


def test_negatives_rest(spark):
    few = awkward(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)])
    run = lambda df: [tuple(r) for r in negatives.mine_negatives(df, F.col("vec_id") % 100 == 0, F.col("label")).collect()]
    assert run(few) == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert run(few.limit(0)) == [] and run(few.filter("vec_id > 0")) == [] and run(few.filter("label = 1")) == [] and run(few.filter("vec_id = 0")) == []
    large = awkward(spark, [(0, [2.0**23, 1.0], 1), (1, [2.0**23, 0.0], 1), (2, [2.0**23, -1.0], 2)])
    assert run(large) == [(0, 1, 1, 2, 2**62, 2**62 - 65536)]
    with pytest.raises(Exception, match="Overflow|too large|too big|does not fit|out of bounds"):
        run(awkward(spark, [(0, [2.0**40], 1), (1, [2.0**40], 1), (2, [2.0**40], 2)]))


def test_every_pair_is_scored_by_lookups():
    """Table sizes and exactness at all widths, and that the subsets' sums are those of the bits."""
    rng = np.random.default_rng(2)
    for wide in (3, 1 << 9, 1 << 20, 1 << 40):
        a, c = rng.integers(-wide, wide, (5, 19)), rng.integers(-wide, wide, (300, 19))
        found = [s for _, s in negatives.scores(negatives.bit_planes(a), negatives.bit_planes(c))]
        assert (np.concatenate(found) == a.astype(object) @ c.T.astype(object)).all()
    table = negatives.subset_sums(np.arange(16)[None, :])
    assert table.shape == (2, 256, 1) and all(table[1, m, 0] == sum(8 + j for j in range(8) if m >> j & 1) for m in range(256))


# The forest of the near-duplicate operator.


def spy(monkeypatch, names):
    """What near_duplicates stores under these names."""
    seen, stored = {}, near_duplicates.stored

    def counted(df, name):
        out = stored(df, name)
        if name in names:
            seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(near_duplicates, "stored", counted)
    return seen


def test_depth_grows_where_a_region_is_crowded(spark, monkeypatch):
    from test_operators import documents, near_copies, prose
    from test_whole_job import linked_groups

    monkeypatch.setattr(near_duplicates, "REGION", 12)
    rng = random.Random(21)
    texts = [t for _ in range(3) for t in near_copies(40, prose(150, rng), 2, rng)] + [t for _ in range(20) for t in near_copies(2, prose(120, rng), 1, rng)]
    rows = list(enumerate(texts))
    docs = documents(spark, rows)
    signed = near_duplicates.sign(docs)
    classes = signed.groupBy("n_shingles", "key1", "key2").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig"))
    forest, placed = near_duplicates.regions(classes, docs, 85)
    depths = {r.depth: r.n for r in forest.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert depths[4] > 0 and max(depths) > 4 and len(depths) >= 3 and max(depths) <= near_duplicates.DEPTH
    sizes = [r["count"] for r in forest.groupBy("region").count().collect()]
    assert max(sizes) <= 12 and min(sizes) >= 2
    # Members of a region share the prefix of its depth, and no lesser depth would do.
    sig = {r.id: np.frombuffer(r.sig, "<u2") for r in classes.collect()}
    shared = {}
    for r in forest.collect():
        own = sig[r.id][8 * r.tree : 8 * r.tree + 8]
        shared.setdefault(r.region, set()).add((r.tree, r.depth, tuple(own[: r.depth])))
        if r.depth > 4:
            shorter = sum((v[8 * r.tree : 8 * r.tree + r.depth - 1] == own[: r.depth - 1]).all() for v in sig.values())
            assert shorter > 12
    assert all(len(x) == 1 for x in shared.values())
    assert placed.filter("keyed").count() > 0
    got = near_duplicates.near_duplicates(docs)
    assert {r.doc_id: r.component_id for r in got.collect()} == linked_groups(rows, 85)


def test_neighbours_have_the_longest_common_prefix():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 3, (40, near_duplicates.TREES * near_duplicates.DEPTH)).astype("<u2")

    def lcp(a, b, tree):
        x = np.concatenate([sig[a][8 * tree : 8 * tree + 8], sig[a]])
        y = np.concatenate([sig[b][8 * tree : 8 * tree + 8], sig[b]])
        return int(np.argmax(x != y)) if (x != y).any() else len(x)

    for tree in (0, 5):
        pairs = near_duplicates._neighbours(sig, tree, 0)
        assert len(pairs) == 39
        for k in range(40):
            best = max(lcp(k, j, tree) for j in range(40) if j != k)
            assert best == max(lcp(a, b, tree) for a, b in pairs if k in (a, b))


@pytest.mark.parametrize(("percent", "region"), [(80, 2), (85, 2), (80, 512), (85, 40)])
def test_planted_pairs_are_found_at_every_depth(spark, monkeypatch, percent, region):
    from test_operators import documents
    from test_whole_job import linked_groups, pairs_between

    monkeypatch.setattr(near_duplicates, "REGION", region)
    rng = random.Random(percent + region)
    pairs = pairs_between(percent / 100, percent / 100 + 0.06, 40, rng)
    rows = list(enumerate(t for pair in pairs for t in pair))
    got = near_duplicates.near_duplicates(documents(spark, rows), percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == linked_groups(rows, percent)


def test_few_other_texts_are_shuffled(spark, monkeypatch):
    """Without a broadcast of ids, what passes the filter has hardly more bytes than the texts that are wanted."""
    from test_operators import documents, prose

    monkeypatch.setattr(near_duplicates, "BROADCAST_IDS", 0)
    rng = random.Random(2)
    docs = documents(spark, [(k, prose(30, rng)) for k in range(4000)] + [(None, prose(30, rng))])
    ids = spark.range(0, 4000, 40).select("id")
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    passed = near_duplicates._filtered(rows, ids, 100)
    wanted = rows.join(ids, "id").agg(F.sum(F.length("text"))).first()[0]
    assert passed.agg(F.sum(F.length("text"))).first()[0] <= 1.2 * wanted
    assert passed.join(ids, "id", "left_semi").count() == 100
    assert near_duplicates._texts(docs, ids, "texts").count() == 100
