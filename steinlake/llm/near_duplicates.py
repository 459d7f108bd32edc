"""Near-duplicate documents by an LSH forest over MinHash signatures, with every link confirmed on full shingle sets.

A document's set holds its distinct runs of five words (a shorter text is one run). Documents with the same set are one class;
the work below is on one representative per class.

Candidates. A signature has TREES orders of DEPTH MinHash values. In each order, representatives are sorted by their values. Those with
a common prefix of the first depth (layout) form a region; where a region has more than REGION members, its depth grows, value by value, only for
them, until the part that shares the longer prefix has at most REGION. In a region, neighbours in the sorted order are candidates: no other member has a
longer common prefix with either of them, and together they are a spanning tree of the region by longest common prefix. A candidate's
signatures must agree in enough of all places (layout).

Deepening may part a linked pair, so members of regions that are crowded at the first depth are also placed by exact
keys: with a set's shingles in the order of how many crowded members have them, rarest first, two sets
of sizes m and n at the threshold have some number t of shingles in common, and so one of their first m - t + 1 and n - t + 1.
Sets are put into classes of nearly equal sizes, and a key is such a shingle together with the two classes that meet by it.
What many share, as a template, comes last there and puts nobody together: in a family whose members share a template and are
not linked, the shingles of one member alone fill those first places. Keys of more than REGION members are dealt into parts
of that size, differently for each key.

Two rounds: first the forest's candidates, and a spanning forest of those of each key, are confirmed; then, with the components
so found, every pair of a region of the first depth, or of a key, whose signatures agree in enough places and whose ends are still in different
components is tested where the region is, and
only links leave the task. In the second round a crowded key's main component and the rest of its members are cut into blocks,
and each block of the rest meets each block of both, two blocks to a region (meetings); texts are sent only for members that
have a candidate there. A task holds one region of about REGION members; the regions of a crowd grow with the product of its
size and its rest.

Texts are looked up by id. Up to BROADCAST_IDS ids are broadcast; more are sent as a Bloom filter of at most FILTER_BITS bits that drops other
texts before the exchange (beyond about a twentieth of that number of ids it drops fewer, and loses none).

At 0.85 the first depth is 4: all 16 orders miss such a pair with probability 7e-6, and it agrees in under 90 of 128 places
with probability 7e-6. At 0.80 the depth is 3 (1e-5) and the agreement 82 (9e-6).

Components. Every node points to the least of itself and its neighbours, pointers are doubled until they end at roots, and
edges are rewritten to the roots until none is left. From the fourth round on, every second round compares nodes by a hash that
changes with the round, so that at least half of them, on average, are no roots. No task holds more than the pre-aggregated minimum of a node.

Classes of equal sets are told by the set's size and two independent 64-bit sums of hashes over the whole set: sets that
differ agree in all three with probability about 2**-128, so such a class is a link on full sets.

Cases: texts that are null or have no word have an empty set and are linked with nothing; a row without a doc_id is linked
with nothing and kept; rows with one doc_id and one text are one document each and are kept or dropped together; where one
doc_id has several texts, its links are confirmed on the first of them in their order, and its rows share one component for each
set of equal texts. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fields, join_spread, prepared, stored
from .textkernel import LOWER, VISIBLE, U, chunks, mix, shingle_hashes, unique_in_groups, word_bounds, word_hashes

SHINGLE, TREES, DEPTH, REGION = 5, 16, 8, 512
#: Size classes from one size to the largest that it can be linked with.
CLASSES = 4
#: The chance of a pair at the threshold to share the first depth in no order, or to agree in too few places, is at most this.
LOSS = 1.1e-5
#: Ids up to this many (8 bytes each) are broadcast to filter the texts; more go as a Bloom filter of at most so many bits, before a join.
BROADCAST_IDS, FILTER_BITS = 500_000, 1 << 28
_RANDOM = np.random.default_rng(20240501).integers(1, 1 << 63, (2, TREES * DEPTH), dtype=np.uint64)
_TIMES, _PLUS = _RANDOM[0] * U(2) + U(1), _RANDOM[1]


@cache
def layout(percent: int) -> tuple[int, int]:
    """The first depth of the orders, and the places in which signatures of candidates agree at least, for a threshold in percent."""
    p, places = percent / 100, TREES * DEPTH
    depth = max(d for d in range(1, DEPTH + 1) if d == 1 or (1 - p**d) ** TREES <= LOSS)
    below, agree = 0.0, 0
    while agree < places:
        below += comb(places, agree) * p**agree * (1 - p) ** (places - agree)
        if below > LOSS:
            break
        agree += 1
    return depth, agree


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and their bounds."""
    low = LOWER[raw]
    starts, ends, first = word_bounds(low, offs, VISIBLE)
    return unique_in_groups(*shingle_hashes(word_hashes(low, starts, ends), first, size))


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value, one row per text; zeros for an empty set."""
    n = len(at) - 1
    out = np.zeros((n, TREES * DEPTH), "<u2")
    some = np.flatnonzero(np.diff(at))
    if len(some):
        start = at[:-1][some]
        for k in range(TREES * DEPTH):
            least = np.minimum.reduceat(sets * _TIMES[k] + _PLUS[k], start)
            out[some, k] = mix(least).astype(np.uint16)
    return out


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, sig): the set's size, two sums that identify the set, and the signature."""
    schema = fields("doc_id long, n_shingles long, key1 long, key2 long, sig binary")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a, b, raw, offs in chunks(batch.column(1)):
                sets, at = shingle_sets(raw, offs)
                sums = [np.concatenate([np.zeros(1, U), np.cumsum(x)]) for x in (mix(sets + U(77)), mix(sets ^ U(0x5BD1E995)))]
                keys = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                sig = signatures(sets, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(keys[0]), pa.array(keys[1]), pa.array([x.tobytes() for x in sig], pa.binary())], schema.names)

        return each

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)


def _prefix(depth: int) -> F.Column:
    """A hash of the first values of an order."""
    return F.xxhash64("tree", F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * depth})"))


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """(id, key, half, n, and rows' other columns): rows(id, key, half) whose key n > 1 members share, of both halves where it has halves."""
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("half").alias("_low"), F.max("half").alias("_high")).filter("n > 1 and (_low = 0 or _low < _high)")
    shared = stored(shared.select("key", "n", F.col("n").alias("rows")), "shared")
    return stored(join_spread(rows, shared, ["key"], "n", "rows", F.xxhash64("id")).filter("n is not null").select("id", "key", "half", "n", *(c for c in rows.columns if c not in ("id", "key", "half"))), name)


@cache
def size_classes(percent: int) -> np.ndarray:
    """The least size of each class."""
    out, ratio = [1], (100 / percent) ** (1 / CLASSES)
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, np.int64)


def meeting_classes(size: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, lesser class, larger class, half): with which classes a set of that size meets by its shingle of that place (from 1).

    half tells which of two classes is the set's own, the lesser (1) or the larger (2); 0 where both are one.
    """
    least = size_classes(percent)
    own = np.searchsorted(least, size, "right") - 1
    low, high = (np.searchsorted(least, x, "right") - 1 for x in (-(-percent * size // 100), size * 100 // percent))
    found = []
    for other in range(int((low - own).min(initial=0)), int((high - own).max(initial=0)) + 1):
        to = own + other
        common = -(-percent * (size + least[np.clip(to, 0, len(least) - 1)]) // (100 + percent))
        row = np.flatnonzero((to >= low) & (to <= high) & (place <= size - common + 1))
        found.append((row, np.minimum(own, to)[row], np.maximum(own, to)[row], np.full(len(row), 0 if not other else 1 if other > 0 else 2, np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def rare_keys(texts: DataFrame, percent: int) -> DataFrame:
    """(id, key, half) of texts(id, text): the shingles of which two sets at the threshold share one, rarest first; those of one text only are left out."""
    schema = fields("id long, size long, shingle long")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a, b, raw, offs in chunks(batch.column(1)):
                sets, at = shingle_sets(raw, offs)
                size = np.diff(at)
                ids = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), size)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(size, size)), pa.array(sets.view(np.int64))], schema.names)

        return each

    def meet():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, size, shingle, place = (c.to_numpy() for c in batch.columns)
            row, low, high, half = meeting_classes(size, place.astype(np.int64), percent)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(shingle[row]), pa.array(low), pa.array(high), pa.array(half)], ["id", "shingle", "low", "high", "half"])

        return each

    rows = stored(arrow_map(texts.select("id", "text"), make, schema), "shingles")
    held = stored(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).withColumn("rows", F.col("held")), "held")
    place = F.row_number().over(Window.partitionBy("id").orderBy("held", "shingle"))
    # A template's shingle has as many rows as the family has members: such are answered by broadcast.
    first = join_spread(rows, held, ["shingle"], "held", "rows", F.xxhash64("id")).withColumn("place", place).filter(F.col("place") <= F.col("size") - F.expr(f"({percent} * size + 99) div 100") + 1)
    met = arrow_map(first.filter("held > 1").select("id", "size", "shingle", "place"), meet, fields("id long, shingle long, low long, high long, half int"))
    return met.select("id", F.xxhash64("shingle", "low", "high").alias("key"), "half")


def regions(classes: DataFrame, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(forest, placed). forest: (id, region, tree, depth) of each region of at least two members, at the depth where it has at most REGION.

    placed: (id, region, crowd, parts, half, keyed), where linked pairs meet surely (see the module's text) or with the chance of layout: the regions of the first depth
    that are not crowded, and the exact keys (keyed) of members of those that are. parts > 1: one of the parts of region crowd.
    """
    first = layout(percent)[0]
    trees = classes.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    live = _placed(trees.select("id", _prefix(first).alias("key"), F.lit(0).alias("half"), "tree"), "live")
    out = live.filter(F.col("n") <= REGION)
    forest = out.select("id", F.col("key").alias("region"), "tree", F.lit(first).alias("depth"))
    crowded = live.filter(F.col("n") > REGION)
    out = out.drop("tree").withColumn("keyed", F.lit(False))
    if not crowded.isEmpty():
        forest = forest.unionByName(deepened(classes, crowded.select("id", "tree"), first))
        ids = stored(crowded.select("id").distinct(), "crowded")
        out = out.unionByName(_placed(rare_keys(_texts(docs, ids, "crowded_texts"), percent), "rare").withColumn("keyed", F.lit(True)))
    parts = F.ceil(F.col("n") / REGION)
    region = F.when(parts > 1, F.xxhash64("key", F.pmod(F.xxhash64("id", "key"), parts))).otherwise(F.col("key"))
    return forest, stored(out.select("id", region.alias("region"), F.col("key").alias("crowd"), parts.alias("parts"), "half", "keyed"), "regions")


def deepened(classes: DataFrame, crowded: DataFrame, first: int) -> DataFrame:
    """(id, region, tree, depth) of crowded(id, tree): each at the least depth beyond the first where its region has at most REGION members, and at least two.

    What is crowded at all depths has none: its members share an order's values whole, and meet by their keys.
    """
    depths = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.xxhash64("tree", F.lit(d), F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * d})")).alias("key")) for d in range(first + 1, DEPTH + 1))))
    if first >= DEPTH:
        return crowded.select("id", F.lit(0).cast("long").alias("region"), "tree", F.lit(first).alias("depth")).limit(0)
    keyed = crowded.join(classes.select("id", "sig"), "id").select("id", "tree", depths.alias("d")).select("id", "tree", "d.depth", "d.key", F.lit(0).alias("half"))
    found = _placed(keyed, "deeper").filter(F.col("n") <= REGION)
    least = found.groupBy("id", "tree").agg(F.min_by(F.struct("key", "depth"), "depth").alias("d"))
    return stored(least.select("id", F.col("d.key").alias("region"), "tree", F.col("d.depth").alias("depth")), "forest")


def meetings(crowded: DataFrame) -> DataFrame:
    """(id, component, region, side): regions of two blocks in which all pairs of crowded(id, crowd, component[, half]) meet but those within a crowd's main component or one of its halves.

    Members of sides 1 and 2 are tested against each other, those of side 0 among themselves; a pair meets once in a crowd.
    """
    rows = crowded if "half" in crowded.columns else crowded.withColumn("half", F.lit(0))
    counts = rows.groupBy("crowd", "component", "half").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("crowd", "component").agg(F.sum("n").alias("n"))
    main = sizes.groupBy("crowd").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    blocks = [F.ceil(F.sum(F.when((F.col("half") == h) & ((F.col("component") == F.col("main")) == bool(m)), F.col("n")).otherwise(0)) / max(1, REGION // 2)) for m in (0, 1) for h in (0, 1, 2)]
    top = counts.join(main, "crowd").groupBy("crowd", "main").agg(F.array(*blocks).alias("blocks"), F.sum("n").alias("rows"))
    top = stored(top.select("crowd", F.struct("main", "blocks").alias("top"), "rows"), "tops")
    # A unit is a kind (of the rest or of the main component, by half) and a block of it.
    rows = join_spread(rows, top, ["crowd"], "top", "rows", F.xxhash64("id")).withColumns({"main": F.col("top.main"), "blocks": F.col("top.blocks")})
    rows = rows.withColumn("kind", F.when(F.col("component") == F.col("main"), 3).otherwise(0) + F.col("half"))
    rows = rows.withColumn("unit", F.expr("shiftleft(CAST(kind AS BIGINT), 40) + pmod(xxhash64(id, crowd), blocks[kind])"))
    other = F.expr("""flatten(transform(filter(array(0, 3), m -> m = 0 OR kind < 3), m -> transform(
      filter(sequence(-1L, blocks[m + CASE half WHEN 0 THEN 0 ELSE 3 - half END] - 1), b -> b >= 0), b -> shiftleft(CAST(m + CASE half WHEN 0 THEN 0 ELSE 3 - half END AS BIGINT), 40) + b)))""")
    met = rows.withColumn("other", F.explode(other))
    side = F.when(F.col("unit") == F.col("other"), 0).when(F.col("unit") < F.col("other"), 1).otherwise(2)
    return met.select("id", "component", F.xxhash64("crowd", F.least("unit", "other"), F.greatest("unit", "other")).alias("region"), side.alias("side"))


def _neighbours(sig: np.ndarray, tree: int, least: int) -> list[tuple[int, int]]:
    """Neighbours in the sorted order of a tree (ties by the whole signature) that agree in at least `least` places."""
    rows = sig.astype(">u2")
    own = rows[:, tree * DEPTH : (tree + 1) * DEPTH]
    keys = [a.tobytes() + b.tobytes() for a, b in zip(own, rows, strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return [(i, j) for i, j in zip(order[:-1], order[1:], strict=True) if np.count_nonzero(sig[i] == sig[j]) >= least]


def _forest(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that agree in at least `least` places, best first."""
    n = len(sig)
    best, link, left, edges = np.full(n, -1), np.zeros(n, int), np.ones(n, bool), []
    at = 0
    for _ in range(n - 1):
        left[at] = False
        agree = np.where(left, np.count_nonzero(sig == sig[at], axis=1), -1)
        better = agree > best
        best[better], link[better] = agree[better], at
        best[~left] = -1
        at = int(np.argmax(best))
        if best[at] >= least:
            edges.append((int(link[at]), at))
        elif not left[at]:
            at = int(np.argmax(left))
    return edges


def _across(sig: np.ndarray, component: np.ndarray, side: np.ndarray, size: np.ndarray, percent: int, i: int) -> np.ndarray:
    """The places after i of i's candidates in other components."""
    rest = slice(i + 1, None)
    other = (component[rest] != component[i]) & ((side[rest] != side[i]) | (side[i] == 0))
    other &= 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
    other = np.flatnonzero(other) + i + 1
    return other[np.count_nonzero(sig[other] == sig[i], axis=1) >= layout(percent)[1]] if len(other) else other


def _linked_across(sig: np.ndarray, component: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components, confirmed on full sets; a pair that an earlier link has joined is not tested again."""
    component, edges = component.copy(), []
    size = np.array([len(x) for x in sets])
    for i in range(len(sig) - 1):
        for j in _across(sig, component, side, size, percent, i):
            if component[j] != component[i] and similar(sets[i], sets[j], percent):
                component[component == component[j]] = component[i]
                edges.append((i, int(j)))
    return edges


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets, neither empty."""
    if not len(p) or not len(q):
        return False
    at = np.minimum(np.searchsorted(p, q), len(p) - 1)
    both = int(np.count_nonzero(p[at] == q))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _by_region(members: DataFrame, find) -> DataFrame:
    """Distinct (a, b) found in each region of members(region, id, sig, ...): find gets the region, the ids, the signatures and the other columns.

    Regions are dealt out by their key and read one after another, sorted by signature; one region is in memory at a time.
    """
    rest = [c for c in members.columns if c not in ("region", "id", "sig")]
    dealt = members.select("region", "id", "sig", *rest).repartition("region").sortWithinPartitions("region", "sig", "id")
    schema = fields("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> pa.RecordBatch:
            region = table.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(region)) + 1).tolist(), len(region)]
            out: set[tuple[int, int]] = set()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a > 1:
                    part = table.slice(a, b - a)
                    ids = part.column(1).to_pylist()
                    sig = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").reshape(b - a, -1)
                    out.update(find(int(region[a]), ids, sig, *part.columns[3:]))
            x = np.array(sorted(out), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], schema.names)

        for batch in batches:
            region = batch.column(0).to_numpy()
            if not len(region):
                continue
            last = int(np.searchsorted(region, region[-1]))  # the last region may go on in the next batch
            if last or kept and kept[-1].column(0)[0].as_py() != region[0]:
                yield pairs(pa.Table.from_batches([*kept, batch.slice(0, last)]))
                kept = []
            kept.append(batch.slice(last))
        if kept:
            yield pairs(pa.Table.from_batches(kept))

    return dealt.mapInArrow(run, schema).distinct()


def _ordered(ids: list[int], places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in places if ids[i] != ids[j]]


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """The pairs of a spanning forest of each region of members(region, id, sig)."""
    least = layout(percent)[1]
    return _by_region(members.select("region", "id", "sig"), lambda region, ids, sig: _ordered(ids, _forest(sig, least)))


def neighbours(members: DataFrame, percent: int) -> DataFrame:
    """The pairs of neighbours by longest common prefix in each region of members(region, id, sig, tree)."""
    least = layout(percent)[1]
    return _by_region(members.select("region", "id", "sig", "tree"), lambda region, ids, sig, tree: _ordered(ids, _neighbours(sig, tree[0].as_py(), least)))


def with_candidates(members: DataFrame, percent: int) -> DataFrame:
    """(region, id) of those members(region, id, sig, component, side, n_shingles) that have a candidate in another component of their region."""

    def find(region: int, ids: list[int], sig: np.ndarray, *columns: pa.ChunkedArray) -> list[tuple[int, int]]:
        component, side, size = (c.to_numpy() for c in columns)
        some = np.zeros(len(ids), bool)
        for i in range(len(ids) - 1):
            found = _across(sig, component, side, size, percent, i)
            some[found] = True
            some[i] |= len(found) > 0
        return [(region, ids[i]) for i in np.flatnonzero(some)]

    return _by_region(members.select("region", "id", "sig", "component", "side", "n_shingles"), find).toDF("region", "id")


def linked_across(members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between the components of each region of members(region, id, sig, component, side, text).

    All candidate pairs of a region are tested where they are; only links leave the task, fewer than the region has members.
    """

    def find(region: int, ids: list[int], sig: np.ndarray, component: pa.ChunkedArray, side: pa.ChunkedArray, text: pa.ChunkedArray) -> list[tuple[int, int]]:
        got = [shingle_sets(raw, offs) for _, _, raw, offs in chunks(text)]
        sets = [x[a:b] for x, at in got for a, b in zip(at[:-1], at[1:], strict=True)]
        return _ordered(ids, _linked_across(sig, component.to_numpy(), side.to_numpy(), sets, percent))

    return _by_region(members.select("region", "id", "sig", "component", "side", "text"), find)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    schema = fields("a long, b long")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            good = np.zeros(batch.num_rows, bool)
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                sets = []
                for k in (2, 3):
                    got = [(raw, offs) for _, _, raw, offs in chunks(part.column(k), 1 << 62)]
                    sets.append(shingle_sets(*got[0]))
                (x, at_x), (y, at_y) = sets
                for i in range(part.num_rows):
                    good[row + i] = similar(x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]], percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

        return each

    return arrow_map(both.select("a", "b", "text_a", "text_b"), make, schema)


def _roots(edges: DataFrame, by: F.Column) -> DataFrame:
    """(id, to): the root that each node of edges(a, b) reaches by pointers to the least neighbour, in the order of by (a column of other)."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
    to = stored(both.groupBy("id").agg(F.min_by("other", F.struct(by, "other")).alias("to")), "to")
    while True:
        twice = to.join(to.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
        twice = stored(twice, "to")
        to = twice.select("id", "to")
        if twice.filter("moved").isEmpty():
            return to


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges(a, b): the least id that it can reach."""
    now, found, turn = edges, None, 0
    while not now.isEmpty():
        to = _roots(now, F.xxhash64("other", F.lit(turn)) if turn > 2 and turn % 2 else F.col("other"))
        found = to if found is None else stored(found.join(to.toDF("to", "_root"), "to", "left").select("id", F.coalesce("_root", "to").alias("to")), "found")
        moved = now.join(to.toDF("a", "_a"), "a").join(to.toDF("b", "_b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        now, turn = stored(moved.filter("a <> b").distinct(), "edges"), turn + 1
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    least = found.groupBy("to").agg(F.min("id").alias("component"))
    return stored(found.join(least, "to").select("id", "component"), "components")


def _known(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows(id, ...) with their component, which is the id itself for those without a link."""
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of n ids(id) as 64-bit words: twenty to forty bits an id, at most FILTER_BITS; tasks send words, merged before they reach the driver."""
    bits = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (20 * n).bit_length()))

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at = _bits_of(batch.column(0).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).view(np.int64)), pa.array((U(1) << (at & U(63))).view(np.int64))], ["word", "mask"])

        return each

    words = arrow_map(ids.select("id"), make, fields("word long, mask long")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)
    return out.view(U)


def _bits_of(ids: np.ndarray, bits: int) -> np.ndarray:
    """The places of ids in a filter, four for each, one after another."""
    h = mix(ids.astype(np.int64).view(U))
    step = mix(h) | U(1)
    return np.concatenate([(h + U(k) * step) & U(bits - 1) for k in range(4)])


def _filtered(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows(id, text) whose id passes the filter of ids: those of ids, and few others."""
    held = rows.sparkSession.sparkContext.broadcast(id_filter(ids, n))

    def make():
        words = held.value

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            known = batch.column(0).is_valid()
            at = _bits_of(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), 64 * len(words))
            passed = ((words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)).reshape(4, -1).all(axis=0)
            yield batch.filter(pa.array(passed & known.to_numpy(zero_copy_only=False)))

        return each

    return arrow_map(rows, make, rows.schema)


def _texts(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(id, text) of ids(id), which are stored; only these texts, and what a filter lets pass beside them, are shuffled. Repeated rows of one id give one text."""
    n = ids.count()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(ids), "id", "left_semi") if n <= BROADCAST_IDS else _filtered(rows, ids, n).join(ids, "id", "left_semi")
    return stored(found.groupBy("id").agg(F.min("text").alias("text")), name)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document: linked at 100 * intersection >= percent * union.

    percent must be at least 80: the first depth and the least agreement follow from it (layout).
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    spark = prepared(docs.sparkSession)
    signed = stored(sign(docs), "signed")
    part = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(part.groupBy("n_shingles", "key1", "key2").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("rows")), "classes")
    forest, placed = regions(classes, docs, percent)
    sigs = classes.select("id", "sig", "n_shingles")
    first = neighbours(forest.join(sigs, "id"), percent).union(candidates(placed.filter("keyed").join(sigs, "id"), percent))
    first = stored(first.distinct(), "pairs")
    involved = stored(first.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
    edges = stored(confirmed(first, _texts(docs, involved, "texts"), percent), "links")
    found = components(edges)

    known = _known(placed.drop("keyed"), found)
    mixed = known.groupBy("crowd").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low < high")
    mixed = stored(mixed.select("crowd", F.lit(True).alias("mixed"), "rows"), "crowds")
    known = stored(join_spread(known, mixed, ["crowd"], "mixed", "rows", F.xxhash64("id")).filter("mixed").drop("mixed"), "mixed")
    met = known.filter("parts = 1").select("id", "component", "region", F.col("half").alias("side"))
    met = stored(met.unionByName(meetings(known.filter("parts > 1"))), "met")
    some = stored(with_candidates(met.join(sigs, "id"), percent), "some")
    texts = _texts(docs, stored(some.select("id").distinct(), "involved"), "texts")
    more = stored(linked_across(met.join(some, ["region", "id"]).join(sigs, "id").join(texts, "id"), percent), "more")
    by_class = _known(classes.select("id", "n_shingles", "key1", "key2", "rows"), found).select("component", "n_shingles", "key1", "key2", "rows")
    if not more.isEmpty():
        ends = [_known(more.select("a", "b", F.col(x).alias("id")), found).select("a", "b", F.col("component").alias(f"c_{x}")) for x in "ab"]
        joint = components(stored(ends[0].join(ends[1], ["a", "b"]).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), "joint"))
        by_class = by_class.join(joint.toDF("component", "_joint"), "component", "left").withColumn("component", F.coalesce("_joint", "component")).drop("_joint")
    joined = join_spread(signed.drop("sig"), by_class, ["n_shingles", "key1", "key2"], "component", "rows", F.xxhash64("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def one_of_each_group(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents that stay, one of each group, all columns kept."""
    gone = near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias("_gone"))
    gone = stored(gone.distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
