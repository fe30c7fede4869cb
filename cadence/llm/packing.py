"""Best-fit packing after exact fills.

An index holds the single lengths, pairs and triples by their sum. What a sequence
lacks is looked up there, and a combination that fills it exactly is used as often as
the counts of its lengths allow; what is left goes where it fits best. Exact fills
serve the longest lengths first and stop at the length below which they would cost
sequences, because they use up short lengths that best fit needs. The plan is made on
the histogram of lengths, which has as many entries as a sequence has tokens whatever
the corpus; the pieces then find their places by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import saved
from cadence.llm.tokens import default_path, encoder

#: Tokens of a sequence, and the id after each document.
SEQUENCE, END = 1024, 2
#: Least number of rank buckets a length, and pieces of a larger bucket.
LEAST_BUCKETS, BUCKET_ROWS = 64, 50_000
#: Lengths at which exact fills may stop, evenly spread over a sequence.
STOPS = 16

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text and
    ``end``, cut into pieces of ``size`` where longer; only the first piece may be
    shorter. A null or empty text is the one id ``end``."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tail = np.array([end], np.uint32)
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = np.concatenate([enc.ids(text or ""), tail]).astype("<u4")
                first = len(ids) % size or size
                for k, start in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[start:start + (size if k else first)]
                    out.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


class Sums:
    """Combinations of at most three available lengths by their sum. Counts only fall,
    so a combination that they no longer cover leaves the index for good."""

    def __init__(self, have: list[int]) -> None:
        self.have = have
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.triples: dict[int, list[int]] = {}  # the largest of three, by the sum of all

    def covered(self, *lengths: int) -> bool:
        return all(self.have[x] >= k for x, k in Counter(lengths).items())

    def pair(self, total: int, beside: tuple[int, ...], most: int) -> tuple[int, int] | None:
        """Two lengths with this sum that are there besides ``beside``: none above
        ``most``, the larger one as large as can be."""
        if total not in self.pairs:
            both = [(a, total - a) for a in range((total + 1) // 2, min(total, len(self.have)))]
            self.pairs[total] = [x for x in both if self.covered(*x)]
        found = self.pairs[total]
        for i in range(len(found) - 1, -1, -1):
            if not self.covered(*found[i]):
                found.pop(i)
            elif found[i][0] <= most and self.covered(*found[i], *beside):
                return found[i]
        return None

    def fill(self, length: int, gap: int, parts: int) -> tuple[int, ...] | None:
        """At most ``parts`` (up to three) lengths that fill exactly the ``gap`` that
        ``length`` leaves."""
        if self.covered(gap, length):
            return (gap,)
        if parts > 1 and (two := self.pair(gap, (length,), gap)):
            return two
        if parts > 2:
            if gap not in self.triples:
                self.triples[gap] = [a for a in range((gap + 2) // 3, gap - 1) if self.have[a]]
            largest = self.triples[gap]
            for i in range(len(largest) - 1, -1, -1):
                a = largest[i]
                if not self.have[a]:
                    largest.pop(i)
                elif two := self.pair(gap - a, (a, length), a):
                    return a, *two
        return None


def exact_fills(have: list[int], size: int, parts: int, down_to: int) -> list[tuple[tuple[int, ...], int]]:
    """Full sequences as (lengths, times), for the longest lengths first and none below
    ``down_to``; takes what it uses from ``have``."""
    sums, made = Sums(have), []
    for length in range(size - 1, down_to - 1, -1):
        while have[length] and (rest := sums.fill(length, size - length, parts)):
            use = Counter((length, *rest))
            times = min(have[x] // k for x, k in use.items())
            for x, k in use.items():
                have[x] -= k * times
            made.append(((length, *rest), times))
    return made


def best_fit(have: list[int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, times) of all of ``have``: longest first, each into the
    smallest gap that holds it."""
    open_by_gap: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, times]
    gaps: list[int] = []
    for length in range(size, 0, -1):
        left = have[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = min(left, size // length)
                times = left // each
                _open(open_by_gap, gaps, size - length * each, (length,) * each, times)
                left -= times * each
                continue
            gap = gaps[at]
            entry = open_by_gap[gap][-1]
            times = min(left, entry[1])
            entry[1] -= times
            if not entry[1]:
                open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    gaps.pop(at)
            _open(open_by_gap, gaps, gap - length, (*entry[0], length), times)
            left -= times
    return [(lengths, times) for entries in open_by_gap.values() for lengths, times in entries]


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, times) for a histogram of lengths from 1 to ``size``.

    Made for fills of one, two and three lengths and for each of STOPS lengths at which
    exact fills stop, the last being best fit alone; the plan with the fewest sequences
    is taken, among equal ones that with the most exact fills."""
    best: tuple[tuple[int, int], list] | None = None
    for parts in (1, 2, 3):
        for stop in sorted({max(1, size * k // STOPS) for k in range(STOPS + 1)}):
            have = [counts.get(x, 0) for x in range(size + 1)]
            exact = exact_fills(have, size, parts, stop)
            made = exact + best_fit(have, size)
            rank = sum(n for _, n in made), -sum(n for _, n in exact)
            if best is None or rank < best[0]:
                best = rank, made
    return best[1]


def _open(open_by_gap: dict, gaps: list[int], gap: int, lengths: tuple[int, ...], times: int) -> None:
    if not open_by_gap[gap]:
        insort(gaps, gap)
    open_by_gap[gap].append([lengths, times])


def places(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, sequence, offset): pieces of a length with a rank in
    [low, high) go to the sequences from ``sequence`` on, at ``offset``."""
    used: Counter = Counter()
    out, sequence = [], 0
    for lengths, times in made:
        offset = 0
        for x in lengths:
            out.append((x, used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of
    :func:`pieces` and its place in a sequence of at most ``size`` tokens.

    Repeated rows are packed as often as they occur; a null doc_id is kept; a very long
    text is encoded whole and cut; an empty table gives no rows; other columns, whatever
    their names, are not read. Places depend on the rows alone, not on the
    partitioning. The driver sees the histogram only (``size`` numbers); a length
    that very many pieces share is ranked in buckets, and full pieces need no
    rank order beyond that. The plan's table is bounded by the histogram and
    broadcast."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, tokenizer, size, end), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(LEAST_BUCKETS, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    table = places(plan(counts, size))
    names = ["low", "high", "first", "offset"]
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for length, *rest in table:
        by_length[length].append(tuple(rest))
    where = saved(spark.createDataFrame([(k, [dict(zip(names, p, strict=True)) for p in v]) for k, v in by_length.items()],
                                        "length long, place array<struct<low: long, high: long, first: long, offset: long>>"), "places")
    where = F.broadcast(where.select("length", F.inline("place")))  # bounded by the histogram
    order = ["doc_id", "piece", "start", "ids_crc32"]
    c = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    n = c.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = n.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    ranked = c.repartition("length", "bucket").withColumn("rank", rank).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    return (ranked.alias("r").join(where.alias("w"), (F.col("r.length") == F.col("w.length")) & F.col("rank").between(F.col("low"), F.col("high") - 1))
            .select("doc_id", "piece", "start", "r.length", "ids_crc32",
                    (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all ``documents`` packed."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
