"""Near copies among embeddings by a random-projection tree forest.

The top of each tree is fitted on a bounded sample: random directions, one per
level, split near the median where vectors are sparse, and vectors close to a
split go to both sides. Every vector is routed to its buckets; a bucket's own
rows split it further, down to small leaves or leaves so tight that a split would
only part near copies. A dense group that fills buckets would be cut by every level,
so those seen in the sample are taken out first: each is one leaf of its own, with all
that can link with its core. Vectors meet in leaves; the cosine of every pair in a leaf
is computed in double precision, and a pair is counted in the first leaf that
both share, so no pair leaves a task. Links are united into components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import block_pairs, components, dealt, group_bounds, local_roots, pairs_of, saved, whole_groups

THRESHOLD = 0.95
#: Trees, vectors of a leaf, vectors of a bucket, vectors of the sample (per dimension), fewest sample vectors of a bucket.
TREES, LEAF, BUCKET, SAMPLE, SAMPLE_LEAF = 8, 256, 2048, 50_000, 8
#: Share of the vectors, on either side of a split, that go to both sides; the middle share where a split may lie.
SPILL, MIDDLE = 0.05, 0.4
#: Levels that a bucket may be split beyond the forest's top; vectors of a block in large leaves.
DEEPER, BLOCK = 8, 1024
#: Sample vectors of a bucket looked at for dense groups, fewest of them near each other, share of a group's sample outside its core.
LOOKED_AT, ALIKE, OUTSIDE = 64, 4, 0.01


def directions(tree: int, dim: int, levels: int) -> np.ndarray:
    """Unit directions of a tree, one per level, the same for everyone who asks."""
    rng = np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest(f"{tree} {dim}")))
    d = rng.standard_normal((levels, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def cut(p: np.ndarray) -> tuple[float, float, float]:
    """(split, low, high) of projections: the split where they are sparsest near the
    median; values in [low, high] go to both sides."""
    s = np.sort(p)
    n = len(s)
    a, b = max(0, int(n * (0.5 - MIDDLE / 2)) - 1), min(n - 1, int(math.ceil(n * (0.5 + MIDDLE / 2))))
    k = max(1, min(n // 64, (b - a) // 2))  # over so many neighbours, a dense group of near copies shows
    at = a + int(np.argmax(s[a + k:b + 1] - s[a:b + 1 - k])) + (k - 1) // 2
    reach = int(n * SPILL)
    return (s[at] + s[at + 1]) / 2, s[max(0, at + 1 - reach)], s[min(n - 1, at + reach)]


def tight(p: np.ndarray, dim: int, threshold: float) -> bool:
    """Whether vectors with these projections (rows) lie as close as near copies:
    a pair at the threshold is sqrt(2 - 2 * threshold) apart, and differs by that
    over sqrt(dim) along a random direction."""
    return bool(p.std(axis=0).max() <= math.sqrt(1 - threshold) / math.sqrt(dim) * 1.2)


def grown(points: np.ndarray, levels: int) -> dict[int, tuple[float, float, float]]:
    """Splits of the top of a tree, by node number (root 1), from projections of the sample."""
    splits: dict[int, tuple[float, float, float]] = {}
    nodes = {1: np.arange(len(points))}
    for level in range(levels):
        below = {}
        for node, rows in nodes.items():
            if len(rows) < 2 * SAMPLE_LEAF:
                continue
            p = points[rows, level]
            splits[node] = split, low, high = cut(p)
            below[2 * node] = rows[p < split]
            below[2 * node + 1] = rows[p >= split]
        nodes = below
    return splits


def routed(splits: dict[int, tuple[float, float, float]], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of every bucket that the rows of ``p`` reach."""
    rows, nodes = [], []
    open_nodes = [(1, np.arange(len(p)))]
    while open_nodes:
        node, at = open_nodes.pop()
        if node not in splits:
            rows.append(at)
            nodes.append(np.full(len(at), node, np.int64))
            continue
        split, low, high = splits[node]
        v = p[at, node.bit_length() - 1]
        open_nodes.append((2 * node, at[(v < split) | (v <= high)]))
        open_nodes.append((2 * node + 1, at[(v >= split) | (v >= low)]))
    return np.concatenate(rows), np.concatenate(nodes)


def dense_groups(x: np.ndarray, tops: list[dict], p: list[np.ndarray], threshold: float, least: float) -> list[tuple[np.ndarray, float, float]]:
    """(centre, cosine from which a vector is of the core, cosine from which one can
    link with the core) of groups of ``least`` or more of the unit vectors ``x`` of a
    sample that are near copies of a centre; ``p`` has their projections per tree. A
    group that fills a bucket shows in it."""
    found = []
    for splits, q in zip(tops, p, strict=True):
        rows, nodes = routed(splits, q)
        order = np.argsort(nodes, kind="stable")
        for lo, hi in group_bounds(nodes[order]):
            at = rows[order[lo:hi][:LOOKED_AT]]
            near = x[at] @ x[at].T >= threshold
            while (n := near.sum(axis=1)).max() >= ALIKE:
                group = near[int(n.argmax())].copy()
                found.append((int(n.max()), x[at[group]].mean(axis=0)))
                near[group] = near[:, group] = False
    found.sort(key=lambda f: -f[0])
    centres = np.array([c / np.linalg.norm(c) for _, c in found]).reshape(-1, x.shape[1])
    groups, free, left = [], np.ones(len(x), bool), np.ones(len(centres), bool)
    for k in range(len(centres)):
        if not left[k]:
            continue
        left &= centres @ centres[k] < threshold
        near = free & (x @ centres[k] >= threshold)
        if near.sum() < least:
            continue
        c = x[near].mean(axis=0)
        c /= np.linalg.norm(c)
        core = max(threshold, float(np.quantile(x[near] @ c, OUTSIDE)))
        if (free & (x @ c >= core)).sum() * 2 < least:
            continue
        groups.append((c, core, math.cos(min(math.pi, math.acos(min(1.0, core)) + math.acos(threshold))) - 1e-9))
        free &= x @ c < core
        left &= centres @ c < threshold
    return groups


def leaves(p: np.ndarray, dim: int, threshold: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for the rows of one bucket, by its projections beyond the top."""
    rows, names = [], []
    nodes = [(1, 0, np.arange(len(p)))]
    while nodes:
        name, level, at = nodes.pop()
        if len(at) <= leaf or level == p.shape[1] or tight(p[at, level:], dim, threshold):
            rows.append(at)
            names.append(np.full(len(at), name, np.int64))
            continue
        split, low, high = cut(p[at, level])
        v = p[at, level]
        left, right = (v < split) | (v <= high), (v >= split) | (v >= low)
        if left.all() and right.all():
            nodes.append((2 * name, level + 1, at))
            continue
        nodes.append((2 * name, level + 1, at[left]))
        nodes.append((2 * name + 1, level + 1, at[right]))
    return np.concatenate(rows), np.concatenate(names)


def usable(vector) -> np.ndarray | None:
    """The vector in double precision, scaled to a largest component of 1; None for
    null, empty or zero vectors and those with null or non-finite components."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    if not len(v) or not np.isfinite(v).all() or not v.any():
        return None
    return v / np.abs(v).max()


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, units, dims = [], [], []
        for x in b["embedding"].to_pylist():
            v = usable(x)
            keys.append(None if v is None else xxhash.xxh3_128_digest((v + 0.0).tobytes()))
            units.append(None if v is None else (v / np.linalg.norm(v)).tobytes())
            dims.append(0 if v is None else len(v))
        yield pa.record_batch({"vec_id": b["vec_id"], "key": pa.array(keys, pa.binary()), "dim": pa.array(dims, pa.int32()), "unit": pa.array(units, pa.binary())})


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``
    (vec_id, embedding).

    Two vectors of the same dimension are linked if their cosine is ``threshold`` or
    more and they meet in a leaf; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id reachable, ``kept`` marks that vector.
    Vectors without a direction (:func:`usable`) link with nothing; a row without
    vec_id links with nothing and has no component. Vectors of one direction are one node
    with a count of copies, so repeated rows cost nothing in the trees. An empty table
    gives no rows; other columns, whatever their names, are not read.

    The sample for the tops of the trees is chosen by a hash and bounded; every
    vector is indexed. Vectors of the core of a dense group (:func:`dense_groups`) meet
    all they can link with in the group's leaf, however large, and no others. Buckets have about BUCKET vectors, or the number of vectors
    over the sample's buckets where there are more."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = saved(v.mapInArrow(_prepared, "vec_id long, key binary, dim int, unit binary"), "vectors")
    nodes = saved(rows.where("key is not null and vec_id is not null").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("unit").alias("unit")), "nodes")

    tops: dict[int, tuple[int, list]] = {}
    groups: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per dimension
        dim, n = r["dim"], r["n"]
        part = nodes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < sample / n * 1_000_000))
        points = np.array([np.frombuffer(x["unit"]) for x in part.select("key", "unit").orderBy("key").collect()]).reshape(-1, dim)  # bounded by ``sample``
        share, dense = n / max(1, len(points)), []
        while True:  # the trees of what is in no dense group; each round takes out groups of ``least`` or more
            levels = max(0, min(math.ceil(math.log2(max(1, len(points) * share / BUCKET))), int(math.log2(max(1, len(points) / SAMPLE_LEAF)))))
            p = [points @ directions(t, dim, levels + DEEPER)[:levels].T for t in range(trees)]
            tops[dim] = levels, [grown(q, levels) for q in p]
            more = dense_groups(points, tops[dim][1], p, threshold, max(SAMPLE_LEAF, LEAF / share)) if levels else []
            if not more:
                break
            dense += more
            for centre, core, _ in more:
                points = points[points @ centre < core]
        if dense:
            groups[dim] = tuple(map(np.array, zip(*dense, strict=True)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        for b in batches:
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                yield dim, part, _matrix(part["unit"], dim)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, x in parts(batches):
            if dim not in groups:
                continue
            centres, _, reach = groups[dim]
            at, k = np.nonzero(x @ centres.T >= reach)
            leaf = np.array([xxhash.xxh3_64_intdigest(f"{dim} group {i}") for i in range(len(centres))], np.uint64).view(np.int64)
            yield pa.record_batch({"node": part["key"].take(pa.array(at)), "tree": pa.array(np.zeros(len(at), np.int32)), "leaf": pa.array(leaf[k])})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, x in parts(batches):
            if dim in groups:  # all that a vector of a core can link with is in its group
                centres, core, _ = groups[dim]
                rest = np.flatnonzero(~(x @ centres.T >= core).any(axis=1))
                part, x = part.take(pa.array(rest)), x[rest]
            levels, tree_tops = tops[dim]
            for t, splits in enumerate(tree_tops):
                p = x @ directions(t, dim, levels + DEEPER).T
                at, node = routed(splits, p)
                key = np.array([xxhash.xxh3_64_intdigest(f"{dim} {t} {k}") for k in node.tolist()], np.uint64).view(np.int64)
                yield pa.record_batch({"key": pa.array(key), "dim": pa.array(np.full(len(at), dim, np.int32)), "tree": pa.array(np.full(len(at), t + 1, np.int32)),
                                       "node": part["key"].take(pa.array(at)), "p": pa.array((p[at][:, levels:]).astype(np.float32).tolist(), pa.list_(pa.float32()))})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            keys = t["key"].to_numpy()
            for lo, hi in group_bounds(keys):
                g = t.slice(lo, hi - lo)
                p = np.array(g["p"].to_pylist(), np.float64)
                at, name = leaves(p, g["dim"][0].as_py(), threshold)
                leaf = np.array([xxhash.xxh3_64_intdigest(f"{keys[lo]} {k}") for k in name.tolist()], np.uint64).view(np.int64)
                yield pa.record_batch({"node": g["node"].combine_chunks().take(pa.array(at)), "tree": g["tree"].combine_chunks().take(pa.array(at)), "leaf": pa.array(leaf)})

    routes = nodes.select("key", "dim", "unit").mapInArrow(route, "key long, dim int, tree int, node binary, p array<float>")
    members = dealt(routes, "node").mapInArrow(split, "node binary, tree int, leaf long")
    if groups:  # as the leaves of tree 0
        members = members.union(nodes.select("key", "dim", "unit").mapInArrow(grouped, "node binary, tree int, leaf long"))
    members = saved(members, "leaves")
    # the leaves of a vector: a bounded list, at most 2 ** (levels) per tree and in practice one to three
    listed = members.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("tree", "leaf"))).alias("found")).select(
        "node", F.col("found.tree").alias("trees"), F.col("found.leaf").alias("all_leaves"))
    met = block_pairs(members.select("leaf", "node"), "leaf", "node", BLOCK)
    full = nodes.select(F.col("key").alias("node"), "rep", "copies", "dim", "unit").join(listed, "node")
    met = met.join(full, "node").select("key", "leaf", "side", "same", "node", "rep", "copies", "dim", "unit", "trees", "all_leaves")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            for lo, hi in group_bounds(t["key"].to_numpy()):
                g = t.slice(lo, hi - lo)
                x = _matrix(g["unit"], g["dim"][0].as_py())
                earlier = _earlier_leaves(g["trees"].to_pylist(), g["all_leaves"].to_pylist(), g["leaf"][0].as_py())
                reps, copies = g["rep"].to_numpy(), g["copies"].to_numpy()
                links, xs, ys = np.zeros(len(reps), np.int64), [], []
                for a, b in pairs_of(g["side"].to_numpy(), bool(g["same"][0].as_py())):
                    hit = _cosines(x, a, b) >= threshold
                    a, b = a[hit], b[hit]
                    xs.append(a)
                    ys.append(b)
                    for leaves_of, valid in earlier:  # pairs that share an earlier leaf were counted there
                        met = np.zeros(len(a), bool)
                        for k in range(leaves_of.shape[1]):
                            for m in range(leaves_of.shape[1]):
                                met |= valid[a, k] & valid[b, m] & (leaves_of[a, k] == leaves_of[b, m])
                        a, b = a[~met], b[~met]
                    links += np.bincount(a, copies[b], len(reps)).astype(np.int64)
                    links += np.bincount(b, copies[a], len(reps)).astype(np.int64)
                if not xs:
                    continue
                root = local_roots(len(reps), np.concatenate(xs), np.concatenate(ys))
                some = np.flatnonzero((links > 0) | (root != np.arange(len(reps))))
                yield pa.record_batch({"node": g["node"].combine_chunks().take(pa.array(some)), "rep": pa.array(reps[some], pa.int64()),
                                       "to": pa.array(reps[root[some]], pa.int64()), "links": pa.array(links[some], pa.int64())})

    links = saved(dealt(met, "rep").mapInArrow(compare, "node binary, rep long, to long, links long"), "links")
    roots = components(links.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = (nodes.join(counts.withColumnRenamed("node", "key"), "key", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .select("key", F.coalesce("root", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    named = F.col("vec_id").isNotNull()
    own_id = F.when(named, F.coalesce("component", "vec_id"))
    return rows.select("vec_id", F.when(named, F.col("key")).alias("key")).join(known, "key", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == own_id, F.lit(False)).alias("kept"))


def _earlier_leaves(trees: list[list[int]], all_leaves: list[list[int]], name: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree up to that of the leaf ``name``, in order: the leaves of every
    row in it that come before ``name`` (rows x places), and which places are filled."""
    own = trees[0][all_leaves[0].index(name)]
    out = []
    for tree in range(own + 1):
        found = [[x for s, x in zip(t, a, strict=True) if s == tree and (tree < own or x < name)] for t, a in zip(trees, all_leaves, strict=True)]
        width = max(map(len, found))
        if width:
            out.append((np.array([f + [0] * (width - len(f)) for f in found], np.int64),
                        np.array([[True] * len(f) + [False] * (width - len(f)) for f in found])))
    return out


def _cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of pairs of unit rows, some at a time."""
    return np.concatenate([np.einsum("ij,ij->i", x[a[i:i + 65536]], x[b[i:i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)])


def query(spark, sf_dir: str) -> DataFrame:
    """op2: near copies among all ``embeddings``."""
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
