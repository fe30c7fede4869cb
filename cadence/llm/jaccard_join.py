"""Jaccard join of word 5-grams by Bayesian candidate pruning.

Every text gets a MinHash signature; texts that agree in a whole band of it are
candidates. Their signatures are compared some values at a time, and a pair is
dropped as soon as the posterior probability that its likeness reaches the
threshold falls below a tolerance. What survives is verified exactly on the sets.
Pairs live inside the tasks: out of them come a count and one link per text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from cadence.llm.common import (SIMILAR, arrow_texts, block_pairs, components, dealt, group_bounds, local_roots,
                                pairs_of, saved, shingles, whole_groups)

#: Hashes of a signature and of a band (4: at likeness 0.8, all 32 bands differ for one pair in 20 million);
#: hashes compared at a time; posterior probability below which a pair is dropped.
HASHES, BAND, STEP, TOLERANCE = 128, 4, 16, 1e-6
#: Texts of a block, in the comparison of signatures and in that of sets.
BLOCK, SET_BLOCK = 512, 128
_FACTORS = np.array([xxhash.xxh3_64_intdigest(str(i)) | 1 for i in range(HASHES)], np.uint64)[:, None]
_MIX = np.uint64(0xD6E8FEB86659FD93)


def signature(h: np.ndarray) -> np.ndarray:
    """Low 16 bits of HASHES minimums over a set of shingle hashes."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 2048):
        out = np.minimum(out, ((h[None, at:at + 2048] * _FACTORS) >> np.uint64(32)).astype(np.uint32).min(1))
    return out.astype(np.uint16)


def least_matches(threshold: float, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """For each number of compared hashes (step, 2 * step, ...), the least number of
    matches with which a pair stays. With m of n matches and a uniform prior the
    likeness is Beta(m + 1, n - m + 1), and it reaches the threshold with the
    probability that a binomial of n + 1 trials has m successes or fewer."""
    def reaches(m: int, n: int) -> float:
        return sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
    return [next(m for m in range(n + 1) if reaches(m, n) >= tolerance) for n in range(step, hashes + 1, step)]


def surviving(sig: np.ndarray, x: np.ndarray, y: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step drops."""
    seen = np.zeros(len(x), np.int32)
    for k, m in enumerate(least):
        if not len(x):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        seen = seen + (sig[x, part] == sig[y, part]).sum(1, dtype=np.int32)
        keep = seen >= m
        x, y, seen = x[keep], y[keep], seen[keep]
    return x, y


def shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs of sets (sorted, distinct values)."""
    n = len(sets)
    if len(x) <= 2 * n:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    common = times[at] > 1
    column = (np.cumsum(times > 1) - 1)[at[common]]
    row = row[common]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = 4096
    for first in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        dense = np.zeros((n, width), np.float32)
        dense[row[a:b], column[a:b] - first] = 1
        out += dense @ dense.T
    return out[x, y].astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, t, key, n, sig): t tells texts of one id apart, key names the shingle set; null for texts without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sigs = [], [], []
            for text in arrow_texts(b["text"]):
                h = np.unique(shingles(text))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sizes.append(len(h))
                sigs.append(signature(h).tobytes() if len(h) else None)
            yield pa.record_batch({"doc_id": b["doc_id"], "t": b["t"], "key": pa.array(keys, pa.binary()), "n": pa.array(sizes, pa.int32()),
                                   "sig": pa.array(sigs, pa.binary())})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return d.mapInArrow(run, "doc_id long, t long, key binary, n int, sig binary")


def _signature_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _candidates(threshold: float, tolerance: float):
    """Links of a bucket's pairs that pass the Bayesian test, as one edge per text."""
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            sigs, reps = _signature_rows(t["sig"]), t["rep"].to_numpy()
            side, same = t["side"].to_numpy(), t["same"].to_numpy(zero_copy_only=False)
            a, b = [], []
            for lo, hi in group_bounds(t["key"].to_numpy()):
                found = [surviving(sigs[lo:hi], x, y, least) for x, y in pairs_of(side[lo:hi], bool(same[lo]))]
                x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
                root = local_roots(hi - lo, x, y)
                linked = np.flatnonzero(root != np.arange(hi - lo))
                a.append(reps[lo:hi][linked])
                b.append(reps[lo:hi][root[linked]])
            yield pa.record_batch({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})
    return run


def _verified(threshold: float, tolerance: float):
    """For each text of a pair of blocks: linked documents, and the first text it is linked to."""
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            for lo, hi in group_bounds(t["key"].to_numpy()):
                g = t.slice(lo, hi - lo)
                sets = [np.unique(shingles(x)) for x in arrow_texts(g["text"])]
                keys = g["set_key"].to_pylist()
                seen: set = set()  # one row per set: repeated rows and other texts of the same id go
                rows = [i for i, (s, k) in enumerate(zip(sets, keys, strict=True))
                        if k not in seen and xxhash.xxh3_128_digest(s.tobytes()) == k and not seen.add(k)]
                if len(rows) < 2:
                    continue
                sets = [sets[i] for i in rows]
                g = g.take(rows)
                sigs, copies, reps = _signature_rows(g["sig"]), g["copies"].to_numpy(), g["rep"].to_numpy()
                size = np.array([len(s) for s in sets])
                xs, ys = [], []
                for x, y in pairs_of(g["side"].to_numpy(), bool(g["same"][0].as_py())):
                    x, y = surviving(sigs, x, y, least)
                    if len(x):
                        both = shared(sets, x, y)
                        link = both >= threshold * (size[x] + size[y] - both) - 1e-9
                        xs.append(x[link])
                        ys.append(y[link])
                if not xs:
                    continue
                x, y = np.concatenate(xs), np.concatenate(ys)
                links = np.bincount(x, copies[y], len(rows)) + np.bincount(y, copies[x], len(rows))
                root = local_roots(len(rows), x, y)
                hit = np.flatnonzero(links > 0)
                yield pa.record_batch({"set_key": pa.array([keys[rows[i]] for i in hit], pa.binary()), "rep": pa.array(reps[hit], pa.int64()),
                                       "to": pa.array(reps[root[hit]], pa.int64()), "links": pa.array(links[hit].astype(np.int64), pa.int64())})
    return run


def _classes(docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(doc_id, t, n_links, head), a row for each row: ``head`` is the least (doc_id, t) that the
    row's text reaches over links, its own included; null without words or without doc_id."""
    s = saved(signatures(docs), "signatures")
    sets = s.where("key is not null and doc_id is not null").groupBy("key").agg(
        F.min(F.struct("doc_id", "t")).alias("own"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    sets = saved(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")  # written: a set keeps its number

    width = 2 * BAND
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda i: F.substring(F.col("sig"), i * width + 1, F.lit(width))))
    bands = sets.select("key", band.alias("band", "part")).select(F.xxhash64("band", "part").alias("bucket"), F.col("key").alias("set_key"))
    met = block_pairs(bands, "bucket", "set_key", BLOCK)
    met = met.join(sets.select(F.col("key").alias("set_key"), "rep", "sig"), "set_key").select("key", "side", "same", "rep", "sig")
    edges = saved(dealt(met, "rep").mapInArrow(_candidates(threshold, tolerance), "a long, b long").distinct(), "candidates")

    near = components(edges).withColumnRenamed("node", "rep").join(sets, "rep")
    near = saved(near.select("root", "rep", "own", F.col("key").alias("set_key"), "copies", "sig"), "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), "text")
    texts = texts.join(near, (F.col("id") == F.col("own.doc_id")) & (F.col("t") == F.col("own.t")))
    blocks = block_pairs(near.select("root", "set_key"), "root", "set_key", SET_BLOCK)
    blocks = blocks.join(texts.select("set_key", "rep", "copies", "sig", "text"), "set_key")
    blocks = dealt(blocks.select("key", "side", "same", "rep", "set_key", "copies", "sig", "text"), "rep", "set_key")
    links = saved(blocks.mapInArrow(_verified(threshold, tolerance), "set_key binary, rep long, to long, links long"), "links")

    roots = saved(components(links.select(F.col("rep").alias("a"), F.col("to").alias("b"))), "roots")
    heads = roots.join(sets, F.col("node") == F.col("rep")).groupBy("root").agg(F.min("own").alias("head"))
    heads = roots.join(saved(heads, "heads"), "root").select("node", "head")  # written: a large class may be split
    counts = links.groupBy("set_key").agg(F.sum("links").alias("links"))
    known = (sets.join(counts, sets["key"] == counts["set_key"], "left").join(heads, F.col("rep") == F.col("node"), "left")
             .select("key", F.coalesce("head", "own").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    named = F.col("doc_id").isNotNull()
    return s.select("doc_id", "t", F.when(named, F.col("key")).alias("key")).join(known, "key", "left").select(
        "doc_id", "t", "head", F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = SIMILAR, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links, kept), a row for each row of ``docs`` (doc_id, text).

    Two documents are linked if the sets of their word 5-grams have a Jaccard
    likeness of ``threshold`` or more; ``n_links`` counts the other rows linked,
    ``class_id`` is the smallest doc_id reachable over links, ``kept`` marks the
    document of that id. Texts of fewer than five words are one n-gram; texts
    without words (null, empty, white space) link with nothing. A row without
    doc_id links with nothing and has no class. Repeated rows are copies; different
    texts of one id are different documents. Very long texts are compared whole, an
    empty table gives no rows, columns other than doc_id and text are not read.

    Equal sets are one node with a count of copies. A bucket or a group of near
    copies, however large, is compared in pairs of blocks, so no task holds more
    than two; nothing is capped. Only texts with a surviving candidate are read
    again for the exact check."""
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("head.doc_id", "doc_id"))
    return _classes(docs, threshold, tolerance).select(
        "doc_id", own.alias("class_id"), "n_links", F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` (all columns) with one document of each class of near copies:
    the one of the smallest doc_id, and of several texts of that id the one of the least
    hash. A document is an id with its text: another text of an id that goes stays.
    Of repeated rows one stays; rows without doc_id all stay, rows without words
    stay unless repeated. An empty table stays empty; other columns, whatever their names, are
    carried along, and of repeated rows that differ in them the least stays."""
    c = _classes(docs, threshold, TOLERANCE)
    gone = c.where("doc_id is not null and head is not null and (doc_id <> head.doc_id or t <> head.t)").select(
        F.col("doc_id").alias("__gone"), F.col("t").alias("__t")).distinct()
    named = docs.where("doc_id is not null")
    left = named.join(gone, (F.col("doc_id").cast("long") == F.col("__gone")) & (F.xxhash64("text") == F.col("__t")), "left_anti")
    rest = [f.name for f in docs.schema.fields if f.name != "text" and isinstance(f.dataType, AtomicType)]
    least = F.min_by(F.struct(*[F.col(f"`{x}`") for x in docs.columns]), F.struct(*[F.col(f"`{x}`") for x in rest]))
    one = left.groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__t")).agg(least.alias("__row")).select("__row.*")
    return one.unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: near copies among all ``documents``."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
