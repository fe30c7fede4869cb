"""Repeated passages by suffix arrays and longest-previous-factor arrays.

Every byte string of LENGTH bytes names one of its own GRAM-byte substrings, the
one with the least hash, as its anchor; equal strings have equal anchors. Strings
that start one after another and share an anchor make one context, a piece of
text of less than twice LENGTH. Anchors are counted over all texts; only contexts
whose anchor occurs again can hold a repeated string. Equal contexts repeat as a
whole. The different contexts of an anchor meet in one task, where a suffix array
is built over them: the previous and the next smaller position in suffix order
give the longest earlier match of each string, the larger ones the longest later
match. Very many different contexts of one anchor are compared string by string
instead, by digests dealt over all tasks.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import arrow_texts, dealt, group_bounds, saved, whole_groups

#: Bytes of a string that counts as repeated, and of an anchor.
LENGTH, GRAM = 200, 60
#: Different contexts of one anchor beyond which strings are dealt by their digests; bytes of a text looked at
#: together; bytes of a suffix array, or those of one anchor's contexts.
GROUP, CHUNK, ARRAY = 2048, 1 << 20, 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MIX, _HALF, _LOW = np.uint64(0xD6E8FEB86659FD93), np.uint64(32), np.uint64(0xFFFFFFFF)


# --------------------------------------------------------------------------- suffix arrays

def ranks(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(width, rank of each position among all substrings of that width): widths of
    8 bytes, twice as many, and so on, the last of ``depth``. ``text`` counts as
    followed by zeros."""
    n = len(text)
    padded = np.r_[text, np.zeros(2 * depth + 8, np.uint8)].astype(np.uint64)
    width = min(8, depth)
    word = np.zeros(n + depth, np.uint64)
    for i in range(width):
        word = (word << np.uint64(8)) | padded[i:i + n + depth]
    out = [(width, np.unique(word, return_inverse=True)[1].astype(np.int32))]
    while width < depth:
        step = min(width, depth - width)
        rank = out[-1][1]
        after = np.r_[rank[step:], np.full(step, rank[-1], np.int32)]
        both = rank.astype(np.int64) * (int(rank.max()) + 1) + after
        out.append((width + step, np.unique(both, return_inverse=True)[1].astype(np.int32)))
        width += step
    return out


def common_prefix(levels: list[tuple[int, np.ndarray]], text: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at x and y, depth at most."""
    depth = levels[-1][0]
    whole = levels[-1][1][x] == levels[-1][1][y]
    out = np.zeros(len(x), np.int64)
    for width, rank in reversed(levels[:-1]):
        out += width * (rank[x + out] == rank[y + out])
    padded = np.r_[text, np.zeros(2 * depth + 8, np.uint8)]
    going = np.ones(len(x), bool)
    for _ in range(min(8, depth)):
        going = going & (padded[x + out] == padded[y + out])
        out += going
    return np.where(whole, depth, np.minimum(out, depth - 1))


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the last smaller value before each one, -1 without: from minimums of
    1, 2, 4, ... values, skipping the largest runs without a smaller one first."""
    n = len(values)
    least = [values]
    while 2 << (len(least) - 1) <= n:
        half = 1 << (len(least) - 1)
        m = least[-1].copy()
        m[half:] = np.minimum(m[half:], least[-1][:-half])
        least.append(m)  # of the 2 * half values that end here, or fewer at the front
    at = np.arange(n) - 1
    for k in range(len(least) - 1, -1, -1):
        skip = (at >= 0) & (least[k][np.maximum(at, 0)] >= values)
        at = np.where(skip, np.maximum(at - (1 << k), -1), at)
    return at


def longest_factors(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``starts`` (ascending positions with ``depth`` bytes after them) the
    length, ``depth`` at most, of the longest match with an earlier one, and with a
    later one: the longest-previous-factor array and its mirror image."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = ranks(text, depth)
    order = np.argsort(levels[-1][1][starts], kind="stable")  # the suffix array of the starts
    found = []
    for place in (order, len(starts) - 1 - order):  # smaller places are earlier, then later
        best = np.zeros(len(starts), np.int64)
        for back in (False, True):
            near = nearest_smaller(place[::-1] if back else place)
            near = len(place) - 1 - near[::-1] if back else near
            has = np.flatnonzero((near >= 0) & (near < len(place)))
            match = common_prefix(levels, text, starts[order[has]], starts[order[near[has]]])
            best[order[has]] = np.maximum(best[order[has]], match)
        found.append(best)
    return found[0], found[1]


# --------------------------------------------------------------------------- anchors

@functools.cache
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers of the base and of its inverse modulo 2 ** 64."""
    byte = np.array([xxhash.xxh3_64_intdigest(bytes([i])) | 1 for i in range(256)], np.uint64)
    up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
    np.cumprod(np.full(size - 1, _BASE, np.uint64), out=up[1:])
    np.cumprod(np.full(size - 1, pow(_BASE, -1, 2**64), np.uint64), out=down[1:])
    return byte, up, down


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last): hash of each anchor, and the first and last start of the
    strings of ``length`` bytes that share it. Of equal least hashes the leftmost
    is the anchor. Long texts are looked at in chunks, between which a context
    may be cut in two."""
    size, keys, firsts, lasts = CHUNK + length, [], [], []
    byte, up, down = _tables(size)
    span = length - gram + 1
    for at in range(0, len(text) - length + 1, CHUNK):
        b = np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - at), at)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(byte[b] * up[:len(b)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[:len(b) - gram + 1]
        h ^= h >> _HALF
        h *= _MIX
        h ^= h >> _HALF
        least, width = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < span:
            least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
        own = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        keys.append(h[own[first]])
        firsts.append(first + at)
        lasts.append(np.r_[first[1:], len(own)] - 1 + at)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(firsts), np.concatenate(lasts)


def context_hash(text: bytes, first: int, last: int, length: int) -> int:
    """64-bit hash, signed, of the context whose strings start from ``first`` to ``last``."""
    h = xxhash.xxh3_64_intdigest(memoryview(text)[first:last + length])
    return h - (h >> 63 << 64)


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, contexts, rows = [], [], []
            for row, text in zip(b["row"].to_pylist(), arrow_texts(b["text"]), strict=True):
                key, first, last = anchors(text, length, gram)
                keys.append(key)
                contexts += [context_hash(text, i, j, length) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                rows.append(np.full(len(key), row, np.int64))
            yield pa.record_batch({"key": np.concatenate(keys), "context": pa.array(contexts, pa.int64()), "row": np.concatenate(rows)})
    return run


# --------------------------------------------------------------------------- contexts

def _lists(column: pa.Array, *names: str) -> Iterator[list[tuple]]:
    """The structs of each row's array as tuples; none for a null one."""
    offsets, values = column.offsets.to_numpy(), column.values
    fields = [values.field(n).to_pylist() for n in names]
    known = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        yield list(zip(*(f[a:b] for f in fields), strict=True)) if known[i] else []


def _context_rows(length: int, gram: int):
    """The bytes of the contexts that a row is asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            asked = _lists(b["asked"], "key", "context", "alone", "large")
            for row, text, asks in zip(b["row"].to_pylist(), arrow_texts(b["text"]), asked, strict=True):
                want = {(k, c): rest for k, c, *rest in asks}
                known = {k for k, _ in want}
                for k, i, j in zip(*(x.tolist() for x in anchors(text, length, gram)), strict=True):
                    if k in known and (rest := want.pop((k, c := context_hash(text, i, j, length)), None)):
                        out.append((k, c, row, *rest, text[i:j + length]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 6, CONTEXT_TYPES, strict=True)], CONTEXT_NAMES)
    return run


CONTEXT = "key long, context long, row long, alone boolean, large boolean, bytes binary"
CONTEXT_NAMES = [c.split()[0] for c in CONTEXT.split(", ")]
CONTEXT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
RUN = "row long, key long, context long, first long, last long"


def _array_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of a key, as many together as make up ARRAY bytes."""
    for t in whole_groups(batches):
        total = np.r_[0, np.cumsum(pa.compute.binary_length(t["bytes"]).to_numpy())]
        first = 0
        for _, end in group_bounds(t["key"].to_numpy()):
            if total[end] - total[first] >= ARRAY or end == t.num_rows:
                yield t.slice(first, end - first)
                first = end


def _compared(length: int):
    """Runs of strings of a context found in another one, by the factor arrays of some keys' contexts at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _array_tables(batches):
            pieces = t["bytes"].to_pylist()
            text = np.frombuffer(b"".join(pieces), np.uint8)
            sizes = np.array([len(p) for p in pieces], np.int64)
            begin = np.cumsum(sizes) - sizes
            count = sizes - length + 1
            owner = np.repeat(np.arange(len(pieces)), count)
            starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
            previous, following = longest_factors(text, starts, length)
            hit = np.flatnonzero((np.maximum(previous, following) >= length) & t["alone"].to_numpy(zero_copy_only=False)[owner])
            edge = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)]) if len(hit) else np.zeros(0, np.int64)
            first, last = hit[edge], hit[np.r_[edge[1:], len(hit)] - 1] if len(hit) else hit
            own = owner[first]
            yield pa.record_batch({c: t[c].to_numpy()[own] for c in ("row", "key", "context")}
                                  | {"first": starts[first] - begin[own], "last": starts[last] - begin[own]})
    return run


def _strings(length: int):
    """Digests of all strings of the contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b["bytes"].to_pylist()
            count = np.array([len(p) - length + 1 for p in pieces], np.int64)
            owner = np.repeat(np.arange(len(pieces)), count)
            digests = b"".join(xxhash.xxh3_128_digest(p[i:i + length]) for p in pieces for i in range(len(p) - length + 1))
            two = np.frombuffer(digests, np.int64).reshape(-1, 2)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            for a in range(0, len(owner), 100_000):
                o = pa.array(owner[a:a + 100_000])
                yield pa.record_batch({"d1": two[a:a + 100_000, 0], "d2": two[a:a + 100_000, 1], "at": at[a:a + 100_000]}
                                      | {c: b[c].take(o) for c in ("row", "key", "context", "alone")})
    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(row, key, context, first, last): for the text of a row, by its hash, which strings
    of which of its contexts occur elsewhere; first is null where all do."""
    texts = docs.select("row", "text")
    found = texts.mapInArrow(_anchor_rows(length, gram), "key long, context long, row long")
    again = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    again = saved(again.where("n > 1").select("key", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    hits = saved(found.join(again, "key"), "hits")

    kinds = hits.where("mixed").groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    kinds = saved(kinds, "contexts")
    many = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > group).select("key", F.lit(True).alias("large"))
    many = saved(many, "large")  # a table of its own, so that a join with it may split a frequent anchor
    ask = F.struct("key", "context", (F.col("n") == 1).alias("alone"), F.coalesce("large", F.lit(False)).alias("large"))
    asked = kinds.join(many, "key", "left").groupBy("row").agg(F.collect_list(ask).alias("asked"))
    held = saved(texts.join(asked, "row").mapInArrow(_context_rows(length, gram), CONTEXT), "context-texts")

    small = held.where("not large").select("key", "context", "row", "alone", "bytes")
    runs = dealt(small, "context").mapInArrow(_compared(length), RUN)
    strings = held.where("large").select("key", "context", "row", "alone", "bytes").mapInArrow(
        _strings(length), "d1 long, d2 long, at long, row long, key long, context long, alone boolean")
    strings = saved(strings, "strings")
    twice = strings.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    single = strings.where("alone").join(twice, ["d1", "d2"]).select("row", "key", "context", F.col("at").alias("first"), F.col("at").alias("last"))
    whole = hits.where("not mixed").select("row", "key", "context").union(
        hits.where("mixed").join(kinds.where("n > 1").select("key", "context"), ["key", "context"]).select("row", "key", "context"))
    nothing = F.lit(None).cast("long")
    return runs.unionByName(single).unionByName(whole.distinct().select("*", nothing.alias("first"), nothing.alias("last")))


SPANS = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _cut(length: int, gram: int):
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, cuts, kept = [], [], []
            for text, marks in zip(arrow_texts(b["text"]), _lists(b["marks"], "key", "context", "first", "last"), strict=True):
                at = defaultdict(list)
                for k, c, first, last in marks:
                    at[k, c].append((first, last))
                known = {k for k, _ in at}
                found = []
                if known:
                    for k, i, j in zip(*(x.tolist() for x in anchors(text, length, gram)), strict=True):
                        if k in known:
                            found += [(i, j + length) if f is None else (i + f, i + g + length)
                                      for f, g in at.get((k, context_hash(text, i, j, length)), ())]
                merged: list[list[int]] = []
                for i, j in sorted(found):
                    if merged and i <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], j)
                    else:
                        merged.append([i, j])
                ends = [0, *(x for m in merged for x in m), len(text)]
                sizes.append(len(text))
                cuts.append([{"start": i, "end": j} for i, j in merged])
                kept.append(b"".join(text[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True)))
            yield pa.record_batch({"doc_id": b["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(cuts, spans),
                                   "kept": pa.array(kept, pa.binary())})
    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), a row for each row of ``docs`` (doc_id, text).

    ``spans`` are the maximal runs (start, end, in UTF-8 bytes) of bytes covered by
    a string of ``length`` bytes that starts anywhere else too, in the same or
    in another text; ``kept`` is the rest, which a cut inside a character may leave
    invalid as UTF-8. All copies go, the first included. A null text is empty; texts
    shorter than ``length`` stay whole. Repeated rows and equal texts of that length
    go altogether. Null ids are kept, an empty table gives no rows; very long texts
    are looked at in chunks, without effect on the result. Columns other than
    doc_id and text are not read.

    A text is shuffled twice, once to give its contexts and once to be cut; anchors,
    hits and contexts only besides. A frequent passage is a count for its anchors
    and one text for each different context; contexts of an anchor beyond ``group``
    are dealt string by string, so no task holds more of them."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("row", F.xxhash64("doc_id", "text"))  # a collision hands a text marks of contexts it doesn't have
    marks = repeated_strings(d, length, gram, group).groupBy("row").agg(F.collect_list(F.struct("key", "context", "first", "last")).alias("marks"))
    return d.join(saved(marks, "marks"), "row", "left").select("doc_id", "text", "marks").mapInArrow(_cut(length, gram), SPANS)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: all ``documents``."""
    d = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                    F.sha2("kept", 256).alias("kept_sha256"))
