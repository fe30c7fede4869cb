"""What several operators need: saved tables, word shingles, groups that arrive
whole in a task, pairs within a group in blocks, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.session import written_path

#: Words of a shingle, and the likeness from which texts count as near copies.
SHINGLE_WORDS, SIMILAR = 5, 0.8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder (``spark.checkpoint.dir``) and read
    back: what feeds several consumers is computed once, and it outlives executors.
    The table stays until the process ends or ``session.drop_written`` is called."""
    path = written_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hash of every run of ``words`` words (maximal runs of anything but
    ASCII white space), in text order. A shorter text is one shingle of all its
    words; a text without words has none."""
    found = text.split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    out = np.zeros(len(h) - width + 1 if width else 0, np.uint64)
    for i in range(width):
        out = (out + h[i:i + len(out)]) * _ODD
        out ^= out >> _SHIFT
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by the long column ``key``."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        k = t[key].to_numpy()
        if held and k[0] != held_key:
            yield pa.concat_tables(held)
            held = []
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held = []
        held.append(t.slice(cut))
        held_key = k[-1]
    if held:
        yield pa.concat_tables(held)


def group_bounds(key: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of equal keys."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True))


def dealt(df: DataFrame, *order: str, key: str = "key") -> DataFrame:
    """Rows of a key in one partition, sorted by ``key`` and then ``order``."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def block_pairs(df: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """Cuts each group of two or more members into blocks of about ``size`` and
    returns a row per member and pair of blocks it takes part in: ``key`` names the
    pair, ``side`` (0 or 1) the block, ``same`` whether both blocks are one. Every
    pair of members meets under exactly one key, and no task gets more than two
    blocks, however large the group."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    d = df.join(n, group).withColumn("_nb", F.ceil(F.col("_n") / size)).drop("_n")
    d = d.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_nb")))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
    return d.select(
        *df.columns,
        F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"),
        (F.col("_own") > F.col("_other")).cast("int").alias("side"),
        (F.col("_own") == F.col("_other")).alias("same"),
    )


def pairs_of(side: np.ndarray, same: bool, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one key of :func:`block_pairs`, some ``rows`` members at a time."""
    if same:
        for a in range(0, len(side), rows):
            x, y = np.meshgrid(np.arange(a, min(a + rows, len(side))), np.arange(a, len(side)), indexing="ij")
            keep = y > x
            yield x[keep], y[keep]
        return
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for a in range(0, len(left), rows):
        x, y = np.meshgrid(left[a:a + rows], right, indexing="ij")
        yield x.ravel(), y.ravel()


def local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` members reaches over the links (x, y)."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the
    smallest node reachable, itself included. Nulls and loops are left out.

    Alternating stars (large star, then small star): each round is two grouped
    minimums and two joins over the edges, so a node with very many edges is a
    partial aggregate and a join that adaptive execution can split; only a row
    count and a checksum of a round reach the driver."""
    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").distinct()

    def mark(table: DataFrame):
        return table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    e = saved(linked(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                     .where("a is not null and b is not null")), "edges")
    seen = mark(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = linked(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = saved(linked(small.union(low)), "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
