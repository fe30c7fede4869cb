"""Token counts that follow edits.

A document's text is split at special tokens and into pre-tokens, which byte-level
BPE encodes one by one. A segment tree over runs of pre-tokens holds the characters and tokens below
each node. An edit finds its place by descending the tree, splits and encodes the
touched pre-tokens and some context anew, and updates the sums above them; the
rest of the document is not looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.tokens import Encoder, default_path, encoder

#: Pre-tokens of a leaf; characters before an edit on which a pre-token may depend
#: (contractions look two ahead); entries after which a worker's cache of counts is begun anew.
LEAF, CONTEXT, CACHE = 64, 4, 1_000_000


class PieceCounts(dict):
    """Tokens of a pre-token, encoded when first asked for."""

    def __init__(self, enc: Encoder) -> None:
        super().__init__()
        self.count = enc.piece_tokens

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = self.count(piece)
        return n


class SegmentTree:
    """Pre-tokens of one text in leaves, with sums of characters and tokens."""

    def __init__(self, text: str, enc: Encoder, counts: PieceCounts) -> None:
        self.split, self.counts = enc.split, counts
        self.context = CONTEXT + max(0, enc.longest_special - 1)  # an edit may complete or break a special token
        self._build(self.split(text))
        self.encoded = 0  # pre-tokens encoded for edits

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.base + i] = sum(map(len, leaf))
            self.tokens[self.base + i] = sum(map(self.counts.__getitem__, leaf))
        for node in range(self.base - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _at(self, offset: int) -> tuple[int, int]:
        """Leaf that holds the character at ``offset``, and where the leaf begins;
        for the end of the text, the last leaf."""
        if offset >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, self.chars[1] - self.chars[self.base + last]
        node, begin = 1, 0
        while node < self.base:
            node *= 2
            if offset >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.base, begin

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` characters from ``start`` on by ``inserted``; places
        beyond the text are its end."""
        start = min(max(start, 0), self.n_chars)
        end = start + min(max(removed, 0), self.n_chars - start)
        a, begin = self._at(max(0, start - self.context))
        k, at = 0, begin  # first pre-token that may change, and its first character
        leaf = self.leaves[a]
        while k < len(leaf) and at + len(leaf[k]) <= max(0, start - self.context):
            at += len(leaf[k])
            k += 1
        kept, region = leaf[:k], leaf[k:]
        b, _ = self._at(end)
        region += [p for x in self.leaves[a + 1:b + 1] for p in x]
        old = "".join(region)
        text = old[:start - at] + inserted + old[end - at:]
        shift = len(inserted) - (end - start)
        ends, x = set(), 0  # beginnings of old pre-tokens behind the edit, as places of the new text
        for p in region:
            if at + x >= end:
                ends.add(x + shift)
            x += len(p)
        more, last = b + 1, len(self.leaves)
        while True:  # until a new boundary is an old one behind the edit, or the text ends
            fresh, done, x = [], False, 0
            whole = more >= last
            for p in self.split(text):
                if x in ends:
                    done = True
                    break
                fresh.append(p)
                x += len(p)
            if whole or done and x < len(text) - self.context:
                break
            for p in self.leaves[more]:  # the tail of the region depends on what follows
                ends.add(len(text))
                text += p
                region.append(p)
            more += 1
        tail, y = [], 0
        if done:
            old_x = x - shift
            for i, p in enumerate(region):
                if y == old_x:
                    tail = region[i:]
                    break
                y += len(p)
        self.encoded += len(fresh)
        self._replace(a, more, kept + fresh + tail)

    def _replace(self, a: int, b: int, pieces: list[str]) -> None:
        """Leaves a to b - 1 now hold ``pieces``; sums above them are updated. A leaf
        that has grown too much has the leaves dealt anew."""
        n = b - a
        share = -(-len(pieces) // n)
        if share > 8 * LEAF:
            self._build([p for leaf in (*self.leaves[:a], pieces, *self.leaves[b:]) for p in leaf])
            return
        for i in range(a, b):
            part = pieces[(i - a) * share:(i - a + 1) * share]
            self.leaves[i] = part
            self.chars[self.base + i] = sum(map(len, part))
            self.tokens[self.base + i] = sum(map(self.counts.__getitem__, part))
        lo, hi = (self.base + a) // 2, (self.base + b - 1) // 2
        while lo:
            for node in range(lo, hi + 1):
                self._sum(node)
            lo, hi = lo // 2, hi // 2

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)


SCHEMA = ("doc_id long, n_chars long, n_tokens long, n_edits long, edited_chars long, edited_tokens long, reencoded long")


def count_tokens(docs: DataFrame, edits: DataFrame | None = None, tokenizer: str | None = None) -> DataFrame:
    """Tokens of each whole text before and after its edits (SCHEMA), a row for each
    row of ``docs`` (doc_id, text).

    ``edits`` (doc_id, seq, start, removed, inserted) apply in the order of seq,
    then of the other columns; each counts characters of the text as it then is.
    Places beyond the text are its end, nulls are 0 and the empty string; edits
    of unknown documents change nothing. ``reencoded`` is the number of pre-tokens
    that the edits had split and encoded anew. A special token written out in a text
    counts as one token, as the tokenizers library has it, also where an edit completes
    or breaks it. A null text is empty; rows without doc_id have no edits; repeated rows
    are edited alike; an empty table gives no rows; further columns, whatever their
    names, are not looked at. A very long text is one tree in its task.

    Texts and edits meet in one sorted shuffle and are read as a stream: a task
    holds the edits of one document and one tree at a time."""
    path = tokenizer or default_path()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"),
                    F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("removed"), F.coalesce("text", F.lit("")).alias("text"))
    if edits is not None:
        zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
        e = edits.where("doc_id is not null").select(
            F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("kind"), zero("seq"), zero("start"), zero("removed"),
            F.coalesce("inserted", F.lit("")).alias("text"))
        spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
        d = d.union(e).repartition("doc_id", spread).sortWithinPartitions("doc_id", "kind", "seq", "start", "removed", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        counts = PieceCounts(enc)
        pending_id, pending = None, []
        for b in batches:
            out: list[tuple] = []
            for doc_id, kind, start, removed, text in zip(*(b[c].to_pylist() for c in ("doc_id", "kind", "start", "removed", "text")), strict=True):
                if kind == 0:
                    if doc_id != pending_id:
                        pending_id, pending = doc_id, []
                    pending.append((start, removed, text))
                    continue
                tree = SegmentTree(text, enc, counts)
                n_chars, n_tokens = tree.n_chars, tree.n_tokens
                mine = pending if doc_id is not None and doc_id == pending_id else []
                for edit in mine:
                    tree.edit(*edit)
                out.append((doc_id, n_chars, n_tokens, len(mine), tree.n_chars, tree.n_tokens, tree.encoded))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                                 [c.split()[0] for c in SCHEMA.split(", ")])

    return d.mapInArrow(run, SCHEMA)


def query_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document: a twelfth part cut out at a third, a piece
    from the middle put at the front, and eight characters at two thirds replaced."""
    n = F.length(F.coalesce("text", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    edit = lambda seq, start, removed, inserted: F.struct(
        F.lit(seq).cast("long").alias("seq"), start.cast("long").alias("start"), removed.cast("long").alias("removed"), inserted.alias("inserted"))
    three = F.array(edit(1, F.floor(n / 3), F.floor(n / 12), F.lit("")),
                    edit(2, F.lit(0), F.lit(0), F.substring(text, F.floor(n / 2).cast("int"), F.lit(24))),
                    edit(3, F.floor(2 * n / 3), F.lit(8), F.concat(F.lit(" revised "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    return docs.select("doc_id", F.inline(three))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: token counts of all ``documents``, before and after three edits each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, query_edits(docs))
