"""Document fingerprints: one-permutation MinHash.

Each shingle is hashed once; the top bits choose a bin and the least rest of a
bin is its value. Empty bins take the value of a bin picked by a sequence of
hashes of the empty bin's number (optimal densification). Only the low bits of
each value are kept, packed; the likeness of two fingerprints corrects for the
chance agreement of so few bits.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import arrow_texts, shingles

#: Bins (a power of two) and bits kept of each; 256 bytes a text, standard error about 0.02.
BINS, BITS = 512, 4
_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_REST = np.uint64((1 << int(_BIN_SHIFT)) - 1)
_EMPTY = np.uint64(2**64 - 1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Rows of a range of ids, and the most ranges; they size tasks and change no result.
RANGE_ROWS, MOST_RANGES = 500, 8192


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: Tries that are looked at together.
TRIES = 8, 64


@functools.lru_cache(maxsize=128)
def _probes(first: int, end: int) -> np.ndarray:
    """The bins that each bin looks at in its tries from ``first`` to ``end``, a row a try."""
    tries = np.arange(first + 1, end + 1, dtype=np.uint64)[:, None] * np.uint64(BINS)
    return (_mixed(np.arange(1, BINS + 1, dtype=np.uint64) + tries) % np.uint64(BINS)).astype(np.int16)


def fingerprint(text: bytes) -> bytes:
    """Packed low bits of the BINS bin values; b"" for a text without words."""
    h = _mixed(shingles(text))
    if not len(h):
        return b""
    least = np.full(BINS, _EMPTY)
    np.minimum.at(least, (h >> _BIN_SHIFT).astype(np.int64), h & _REST)
    full = least != _EMPTY
    todo, first, out = np.flatnonzero(~full), 0, least.copy()
    while len(todo):
        end = TRIES[0] if not first else first - first % TRIES[1] + TRIES[1]
        at = _probes(first, end)[:, todo]
        hit = full[at]
        some = hit.any(0)
        out[todo[some]] = least[at[hit.argmax(0), np.arange(len(todo))][some]]
        todo, first = todo[~some], end
    low = (out & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - BITS:].ravel()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard likeness of two fingerprints' shingle sets: the share of
    equal values, less the 2**-BITS that agree by chance. Two texts without words
    are alike (1.0); one without and one with words are not (0.0)."""
    if a == b or not a or not b:
        return float(a == b)
    bits = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(BINS, BITS)
    agree = float((~bits.any(axis=1)).mean())
    chance = 2.0 ** -BITS
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def as_text(fp: bytes) -> str:
    return base64.b64encode(fp).decode()


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def in_order(docs: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text): documents dealt into ranges of doc_id, with the
    first document of the next range (for the last range: of all) as a guest at
    the end of each. Documents without doc_id are dealt anywhere.

    The cuts are quantiles of doc_id (a bounded list on the driver); the texts are
    shuffled once."""
    n, low = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    parts = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * parts)).first()[0]
    cuts = np.array(sorted({low, *cuts} - {None}), np.int64)
    last = max(0, len(cuts) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc_id"].to_pandas()
            known = ids.notna().to_numpy()
            v = ids.fillna(0).to_numpy(np.int64)
            part = np.where(known, np.searchsorted(cuts, v, side="right") - 1, -1).astype(np.int32)
            first = np.flatnonzero(known & np.isin(v, cuts)) if len(cuts) else np.zeros(0, np.int64)
            before = np.where(part[first] == 0, last, part[first] - 1).astype(np.int32)
            rows = np.r_[np.arange(len(v)), first]
            out = b.take(pa.array(rows))
            yield pa.record_batch({"part": pa.array(np.r_[part, before], pa.int32()),
                                   "guest": pa.array(np.arange(len(rows)) >= len(v)),
                                   "doc_id": out["doc_id"], "text": out["text"]})

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.mapInArrow(deal, "part int, guest boolean, doc_id long, text string")
    d = d.repartition("part", F.when(F.col("part") < 0, F.xxhash64("text")))
    return d.sortWithinPartitions("part", "guest", "doc_id", "text")


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each range in order; a row is finished when the next one is known."""
    held = None  # (part, doc_id, text, fingerprint)
    out: list[tuple] = []

    def finish(row: tuple, text: str, fp: bytes) -> None:
        _, doc_id, own, own_fp = row
        new = edited(own, text)
        raw = new.encode()
        new_fp = fingerprint(raw)
        out.append((doc_id, len(own), hashlib.sha256(raw).hexdigest(), as_text(own_fp), as_text(new_fp),
                    likeness(own_fp, new_fp), likeness(own_fp, fp)))

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, NAMES)

    for b in batches:
        for part, guest, doc_id, text in zip(*(b[c].to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True):
            fp = fingerprint(text.encode())
            if part < 0:
                finish((part, doc_id, text, fp), text, fp)
                continue
            if held is not None and held[0] == part:
                finish(held, text, fp)
            held = None if guest else (part, doc_id, text, fp)
        if out:
            yield flush()


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in SCHEMA.split(", ")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each whole text and of its edited form (SCHEMA), a row for each
    row of ``docs`` (doc_id, text).

    The next document is that with the next larger doc_id, for the last the first;
    among equal ids, the order is that of the texts. A row without doc_id, or an
    only row, is its own next document. A null text is empty. Texts without words
    have the empty fingerprint: alike among themselves, unlike all others. Very long
    texts are hashed whole; repeated rows come back as often; an empty table gives no
    rows; other columns, whatever their names, are not read."""
    return in_order(docs).mapInArrow(_fingerprinted, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: fingerprints of all ``documents``."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
