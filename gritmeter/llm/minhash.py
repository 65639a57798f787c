"""Near-duplicates by a MinHash LSH forest, with an exact search of its dense regions, confirmed on full shingle sets.

Equal shingle sets are one class, found by a 128-bit digest, so copies never meet
in pairs. Each class enters ``TREES`` orders; in an order it stands in the region of
classes with which it shares the order's first ``DEPTH`` minima, sorted by the next
minima, so those that follow one another have the longest common prefixes. A
class is a candidate for the ``NEIGHBOURS`` that follow it, so a region of up to
NEIGHBOURS + 1 classes is compared whole; denser ones are searched at the depth that
their neighbours share, and those of over REGION_ROWS classes are cut at a greater
depth, again and again, until no region is larger. A candidate is dropped if its
signatures agree in under LEAST_AGREEING places (over seven standard deviations
below the bound), else its texts are compared by full sets.

What the forest may have left in dense regions is searched exactly: classes of dense
regions that hold several components are joined by prefix filter. In one order of all
shingles, two sets at the bound share one among the first n - ceil(0.7 n) + 1 of
each. Shingles that a sample shows to be frequent come last in that order, which decides
the cost and not the result. Bounds on the sizes and on the number of first shingles
shared thin the pairs out, and all that remain are compared by full sets. So of linked
classes only those are lost that share no region in any order: at 0.7 with a
probability of (1 - 0.7 ** DEPTH) ** TREES = 2e-9, and far less above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowmap import map_slices
from .ordering import LEAST
from .storage import bounded_broadcast, stash
from .wordhash import Words, mix

SHINGLE = 5
TREES, DEPTH, NEIGHBOURS = 48, 3, 12
HASHES = TREES * DEPTH
#: Linked are documents with PERCENT * union <= 100 * intersection.
PERCENT = 70
#: Agreeing places of two signatures, of HASHES, below which full sets aren't compared.
LEAST_AGREEING = 60
#: Regions of more rows, by a sample of one class of REGION_SAMPLE, are cut at the next of DEPTHS before they are sorted.
REGION_ROWS, REGION_SAMPLE, DEPTHS = 200_000, 64, (DEPTH, 5, 7, 9, 11)
#: Ids that are broadcast at most to fetch texts.
BROADCAST_IDS = 500_000
#: One class of so many is sampled for frequent shingles: those of at least OFTEN sampled texts, MOST_FREQUENT of them at most.
SAMPLE, OFTEN, MOST_FREQUENT = 16, 3, 500_000
_SLICE = 1_000_000
_RNG = np.random.Generator(np.random.PCG64(8675309))
_STEP = _RNG.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a shorter text is one shingle, one without words has none."""
    w = Words(texts)
    n = len(w.hash)
    runs = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        runs += w.hash[k : k + len(runs)] * _STEP[k]
    runs = mix(runs)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            terms = np.append(w.hash[a:b] * _STEP[: b - a], np.array([b - a], np.uint64) * _STEP[size : size + 1])
            out.append(mix(terms.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of HASHES hash functions over each of the non-empty ``sets``."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((values * _TIMES[k] + _PLUS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _profile(part: pa.RecordBatch) -> dict:
    sets = shingle_sets(part.column("text").cast(pa.binary()).to_pylist())
    full = [i for i, s in enumerate(sets) if len(s)]
    sig: list = [None] * len(sets)
    if full:
        for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
            sig[i] = row.tobytes()
    # Two sums of scrambled hashes and the size tell sets apart.
    one = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    two = np.array([mix(s ^ _PLUS[0]).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return {"doc_id": part.column("doc_id"), "th": part.column("th"), "n": [len(s) for s in sets], "d1": pa.array(one), "d2": pa.array(two), "sig": sig}


def _places(part: pa.RecordBatch, cut: list[dict[int, np.ndarray]]) -> pa.RecordBatch:
    """Per class and order: tree, key of the region at DEPTH and of the deeper one it was cut into, order in it, node, its size. ``cut`` has, by step of DEPTHS and tree, ascending keys of the regions to be cut."""
    rows = part.num_rows
    sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(rows, HASHES)
    wide = sig.astype(np.uint64)
    # High bits of a minimum tell little, as it is small in a large set: bytes of the scrambled minima are equal where the minima are, and else by chance alone.
    byte = (mix(wide + np.uint64(1)) >> np.uint64(56)).astype(np.uint8)
    bases, regions, places = [], [], []
    for t in range(TREES):
        cols = [(t * DEPTH + i) % HASHES for i in range(DEPTHS[-1])]
        h = np.zeros(rows, np.uint64)
        for k in cols[:DEPTH]:
            h = mix(h + wide[:, k] + np.uint64(k))
        bases.append(h.view(np.int64))
        for step, (at, stop) in enumerate(zip(DEPTHS, DEPTHS[1:])):
            dense = cut[step].get(t) if step < len(cut) else None
            if dense is None:
                break
            deeper = h
            for k in cols[at:stop]:
                deeper = mix(deeper + wide[:, k] + np.uint64(k))
            h = np.where(np.isin(h.view(np.int64), dense), deeper, h)
        regions.append(h.view(np.int64))
        places.append(np.ascontiguousarray(byte[:, cols[DEPTH:]]).view(">u8").astype(np.uint64)[:, 0])
    return pa.RecordBatch.from_pydict(
        {
            "tree": np.repeat(np.arange(TREES, dtype=np.int32), rows),
            "base": np.concatenate(bases),
            "region": np.concatenate(regions),
            "place": (np.concatenate(places) ^ np.uint64(1 << 63)).view(np.int64),
            "node": np.tile(part.column("node").to_numpy(), TREES),
            "n": np.tile(part.column("n").to_numpy(), TREES),
        }
    )


def _forest(classes: DataFrame, cut: list[dict[int, np.ndarray]]) -> DataFrame:
    def spread(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                yield _places(b.slice(i, 2000), cut)

    return classes.select("node", "n", "sig").mapInArrow(spread, "tree int, base long, region long, place long, node long, n long")


def _cuts(classes: DataFrame) -> list[dict[int, np.ndarray]]:
    """The regions of over REGION_ROWS classes at each step of DEPTHS; the driver holds one key for REGION_ROWS classes and order at most."""
    cut: list[dict[int, np.ndarray]] = []
    if classes.count() <= REGION_ROWS:
        return cut
    sample = classes.where(F.pmod(F.xxhash64("node"), F.lit(REGION_SAMPLE)) == 0)
    while len(cut) < len(DEPTHS) - 1:
        rows = _forest(sample, cut).groupBy("tree", "region").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") * REGION_SAMPLE > REGION_ROWS).select("tree", "region").collect()
        if not rows:
            break
        found: dict[int, list[int]] = {}
        for r in rows:
            found.setdefault(r["tree"], []).append(r["region"])
        cut.append({t: np.array(sorted(x), np.int64) for t, x in found.items()})
    return cut


def _overlap(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes that follow one another in some order and whose set sizes allow a link; and the rows (tree, base, node) of regions that weren't compared whole."""
    forest = _forest(classes, _cuts(classes))
    region = Window.partitionBy("tree", "region")
    w = region.orderBy("place", "node")
    following = [F.struct(F.lead("node", k).over(w).alias("node"), F.lead("n", k).over(w).alias("n")) for k in range(1, NEIGHBOURS + 1)]
    # A region is compared whole if it has no more rows than a row and its neighbours, and is all that its three minima have.
    dense = (F.count(F.lit(1)).over(region) > NEIGHBOURS + 1) | (F.col("base") != F.col("region"))
    near = F.filter(F.array(*following), lambda o: o["node"].isNotNull() & (100 * F.least("n", o["n"]) >= PERCENT * F.greatest("n", o["n"])))
    found = stash(
        forest.select("tree", "base", "node", "n", dense.alias("dense"), near.alias("near")).where(F.col("dense") | (F.size("near") > 0))
        .select("tree", "base", "node", "dense", F.transform("near", lambda o: o["node"]).alias("near")), "regions",
    )
    pairs = found.select("node", F.explode("near").alias("o")).select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).where("a < b").distinct()
    return pairs, found.where("dense").select("tree", "base", "node")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose signatures agree in enough places."""

    def alike(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, HASHES) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array((x == y).sum(1) >= LEAST_AGREEING))

    sig = classes.select("node", "sig")
    with_sigs = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return stash(with_sigs.mapInArrow(alike, "a long, b long"), "likely")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the stashed ``pairs`` whose full shingle sets reach the bound."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stash(classes.join(nodes, "node", "left_semi").select("node", "th"), "wanted")
    wanted = bounded_broadcast(wanted, wanted.count(), BROADCAST_IDS)
    texts = docs.join(wanted, (docs["node"] == wanted["node"]) & (docs["th"] == wanted["th"]), "left_semi").dropDuplicates(["node", "th"]).select("node", "text")

    def compare(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch.slice(i, 64)
                sets = [shingle_sets(b.column(c).cast(pa.binary()).to_pylist()) for c in ("ta", "tb")]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array([_overlap(x, y) for x, y in zip(*sets, strict=True)], pa.bool_()))

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(compare, "a long, b long")


def frequent(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the shingles that are frequent in a sample of ``members`` (th, text), and their counts."""

    def work(part):
        return {"h": pa.array(np.concatenate(shingle_sets(part.column("text").cast(pa.binary()).to_pylist())).view(np.int64))}

    sample = members.where(F.pmod("th", F.lit(SAMPLE)) == 0).select("text")
    counts = stash(map_slices(sample, "text", lambda: work, "h long", _SLICE).groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= OFTEN), "frequent")
    least = total = 0
    for r in sorted(counts.groupBy("k").agg(F.count(F.lit(1)).alias("shingles")).collect(), reverse=True):
        total += r["shingles"]
        if total > MOST_FREQUENT:
            break
        least = r["k"]
    got = counts.where(F.col("k") >= (least or 2**62)).toArrow()
    h, k = (got.column(c).to_numpy() for c in ("h", "k"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], k[order]


def suspects(dense: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes of those ``dense`` regions (tree, base, node) that hold several components of ``found`` (node, component)."""
    named = stash(dense.join(found, "node", "left").select("tree", "base", "node", F.coalesce("component", "node").alias("comp")), "dense")
    mixed = stash(named.groupBy("tree", "base").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tree", "base"), "mixed")
    return named.join(bounded_broadcast(mixed, mixed.count(), BROADCAST_IDS), ["tree", "base"], "left_semi").select("node").distinct()


def missed(classes: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``classes`` in different components of ``found`` (node, component) that may be linked: all that are, by the prefix filter."""
    comp = stash(classes.select("node", "th", "n").join(found, "node", "left").select("node", "th", F.coalesce("component", "node").alias("comp")), "comp")
    members = docs.join(bounded_broadcast(comp, comp.count(), BROADCAST_IDS), ["node", "th"]).select("node", "th", "comp", "text")
    shared = docs.sparkSession.sparkContext.broadcast(frequent(members))

    def work():
        seen, often = shared.value

        def prefixes(part):
            sets = shingle_sets(part.column("text").cast(pa.binary()).to_pylist())
            n = np.array([len(s) for s in sets])
            size = np.where(n > 0, n - (PERCENT * n + 99) // 100 + 1, 0)
            values = np.concatenate(sets)
            at = np.minimum(np.searchsorted(seen, values), max(0, len(seen) - 1))
            rank = np.where(seen[at] == values, often[at], 0) if len(seen) else np.zeros(len(values), np.int64)
            out, first = [], 0
            for s, k in zip(sets, size.tolist(), strict=True):
                r = rank[first : first + len(s)]
                first += len(s)
                out.append(s[np.argsort(r, kind="stable")[:k]] if r.any() else s[:k])
            return {
                # 40 bits shuffle in less space; a clash only adds a candidate.
                "h": pa.array((np.concatenate(out) >> np.uint64(24)).view(np.int64)),
                "node": pa.array(np.repeat(part.column("node").to_numpy(), size)),
                "comp": pa.array(np.repeat(part.column("comp").to_numpy(), size)),
                "n": pa.array(np.repeat(n, size).astype(np.int32)),
            }

        return prefixes

    rows = map_slices(members.select("node", "comp", "text"), "text", work, "h long, node long, comp long, n int", _SLICE)
    w = Window.partitionBy("h")
    mixed = stash(rows.withColumns({"lo": F.min("comp").over(w), "hi": F.max("comp").over(w)}).where("lo < hi").drop("lo", "hi"), "mixed")
    x, y = (mixed.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "comp", "n")]) for s in "ab")
    possible = (F.col("comp_a") < F.col("comp_b")) & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    pairs = x.join(y, "h").where(possible).groupBy("node_a", "node_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("first"))
    # Of the two, one's first shingles end earlier in the order: what they share with the other is among the other's first ones, so only its rest can add to that.
    most = F.col("first") + F.floor((PERCENT * F.greatest("n_a", "n_b").cast("long") + 99) / 100) - 1
    near = pairs.where((100 + PERCENT) * most >= PERCENT * (F.col("n_a") + F.col("n_b")).cast("long"))
    return stash(near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct(), "missed")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b), component the least node reachable; by alternating stars, each round written to the shared folder."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        sides = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stash(small.where("u != v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): n_shingles, component_id, kept.

    Null texts and texts without words have no shingles and are linked with
    nothing. Rows of one id are one document: their links are shared, and kept
    is true for each of them. A null id sorts before all others and is given back
    as null. An empty table gives an empty result; other columns are ignored.
    """
    docs = documents.select(F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("node"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    profiles = stash(map_slices(docs.select(F.col("node").alias("doc_id"), "text", "th"), "text", lambda: _profile, "doc_id long, th long, n long, d1 long, d2 long, sig binary", _SLICE), "profiles")
    classes = stash(
        profiles.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "th", "sig")).alias("r")).select("d1", "d2", "n", F.col("r.doc_id").alias("node"), "r.th", "r.sig"),
        "classes",
    )
    pairs, dense = candidates(classes)
    links = confirmed(likely(pairs, classes), classes, docs)
    # Classes that share an id, by its repeated rows, belong together.
    member = profiles.where("n > 0").join(classes.select("d1", "d2", "n", "node"), ["d1", "d2", "n"]).select("doc_id", "node")
    own = member.where("doc_id != node").select(F.col("doc_id").alias("b"), F.col("node").alias("a"))
    twice = own.select("b").union(member.where("doc_id = node").select(F.col("node").alias("b"))).groupBy("b").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("b")
    found = components(links.union(own.join(twice, "b", "left_semi").select("a", "b")))
    open_ = stash(suspects(dense, found), "suspects")
    more = None if open_.isEmpty() else stash(confirmed(missed(classes.join(open_, "node", "left_semi"), docs, found), classes, docs), "more")
    if more is not None and not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    labelled = (
        profiles.select("doc_id", "n", "d1", "d2")
        .join(classes.select("d1", "d2", "n", "node"), ["d1", "d2", "n"], "left")
        .withColumn("node", F.coalesce("node", "doc_id"))
        .join(found, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    )
    given = lambda c: F.when(F.col(c) != LEAST, F.col(c)).alias(c)
    return labelled.select(given("doc_id"), "n_shingles", given("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, g from (
    select doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)
    union all
    select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all
), link as (
  select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 70 * (na.n + nb.n - shared)
), side as (
  select a, b from link union all select b, a from link
), reach(x, y) as (
  select a, b from side union select reach.x, side.b from reach join side on reach.y = side.a
), comp as (
  select x, min(y) as m from reach group by x
)
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) as component_id, least(w.doc_id, coalesce(m, w.doc_id)) = w.doc_id as kept
from w left join n using (doc_id) left join comp on x = w.doc_id
"""
