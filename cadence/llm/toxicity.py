"""Toxicity by weak supervision.

Many weak voters look at a text: lexicons of words and word stems (a fixed list,
and lists learned from a bounded sample of labelled rows) and patterns. A
generative label model, begun from the labelled sample, estimates from the votes
over the whole corpus how accurate each voter is, and which are correlated beyond
what the class explains. Its posteriors are the labels on which a linear classifier
over the single lexicon entries is trained.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import saved, shingles

#: Abusive words in the languages of the tables.
INSULTS = ("idiot idiots moron morons stupid scum loser losers worthless pathetic disgusting trash clown imbecile cretin dumbass "
           "bastard bitch asshole fucker retard arschloch hurensohn wichser dummkopf vollidiot abschaum connard connasse salope "
           "enculé ordure débile gilipollas cabrón pendejo imbécil estúpido basura puta").split()
#: Bound of the labelled sample and of the rows the classifier is trained on.
LABELLED_ROWS, TRAINING_ROWS = 20_000, 20_000
#: Word stems that are looked at, besides whole words (length 0); the share of a
#: text's words from which on a stem counts; voters per learned lexicon.
STEMS, DENSE, VOTERS_EACH = (0, 4, 5, 6), 0.01, 3
#: Weight of a silent voter's evidence: the stems of one language say little of texts in another.
SILENCE = 0.5
#: Rates of the fixed list's votes among toxic and clean texts that are assumed without labels.
UNLABELLED = (0.5, 0.005)
#: Weight of all rows without a label, as a share of that of the labelled, at most.
OTHERS = 0.25
#: From this score on a text counts as toxic.
TOXIC = 0.7
_INNER = re.compile(r"\w+")
_SHOUT = re.compile(r"!{2,}")
PATTERNS = ("shouting", "many exclamations")


def words_of(text: str) -> Counter:
    """Lower-cased words (runs of letters, digits and underscores) and their counts."""
    out: Counter = Counter()
    for w, n in Counter(text.lower().split()).items():
        if w.isalnum():
            out[w] += n
        else:
            for part in _INNER.findall(w):
                out[part] += n
    return out


def entries_of(words: Counter, known=None) -> set[tuple[int, str]]:
    """What lexicons can hold of a text: (0, word), and (length, stem) for stems that
    begin a share of DENSE or more of its words (a stem may begin harmless words
    too, and does so now and then in long texts). Of ``known`` entries only, if given."""
    found = {(0, w) for w in words if known is None or (0, w) in known}
    stems: Counter = Counter()
    for w, n in words.items():
        for k in STEMS[1:]:
            if len(w) > k and (known is None or (k, w[:k]) in known):
                stems[k, w[:k]] += n
    least = DENSE * words.total()
    found.update(e for e, n in stems.items() if n >= least)
    return found


def pattern_votes(text: str) -> tuple[float, float]:
    """Share of the words that are all capitals, and runs of exclamation marks per word."""
    words = text.split()
    n = max(1, len(words))
    return sum(len(w) > 3 and w.isupper() for w in words) / n, len(_SHOUT.findall(text)) / n


def in_training(doc_id):
    """Rows whose labels may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) != 1


def _sampled(labels: DataFrame, bound: int) -> tuple[DataFrame, float]:
    """Up to about ``bound`` labelled training rows (doc_id, toxic), half of it for
    each class where there are so many, chosen by a hash of doc_id; and the share of
    toxic rows among all labelled training rows."""
    y = labels.where("toxic in (0, 1) and doc_id is not null").where(in_training("doc_id"))
    y = saved(y.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labelled")
    n = {r["toxic"]: r["n"] for r in y.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    spare = max(0, bound // 2 - n.get(1, 0))
    rate = F.when(F.col("toxic") == 1, bound / 2 / max(1, n.get(1, 0))).otherwise((bound / 2 + spare) / max(1, n.get(0, 0)))
    kept = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    return kept, n.get(1, 0) / max(1, sum(n.values()))


def learned_lexicons(docs: DataFrame, sample: DataFrame) -> dict:
    """{(length, entry): log odds} from the bounded labelled ``sample`` (doc_id, toxic).

    Near copies of one label in the sample (equal least shingle hash) are one trial, which
    holds the entries of all of them; a toxic text made from a clean one is a trial
    beside it. An entry is taken if its likelihood ratio is so large that chance finds
    about one of all that are tried, and it is nine times as frequent in toxic trials.
    Only the sample bounds how many there are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            keys = [int(s.min()) if len(s := shingles(t.encode())) else 0 for t in texts]
            yield pa.record_batch({"copy": pa.array(np.array(keys, np.uint64).view(np.int64)), "toxic": b["toxic"], "text": pa.array(texts, pa.string())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = (Counter(), Counter()), [0, 0]
        trial, held = None, set()
        for b in batches:
            for key, y, text in zip(b["copy"].to_pylist(), b["toxic"].to_pylist(), b["text"].to_pylist(), strict=True):
                if (key, y) != trial:
                    if trial:
                        seen[trial[1]].update(held)
                    trial, held = (key, y), set()
                    n[y] += 1
                held |= entries_of(words_of(text))
        if trial:
            seen[trial[1]].update(held)
        clean, toxic = seen
        found = [*(toxic | clean)]
        yield pa.record_batch({
            "length": pa.array([-1, *(k for k, _ in found)], pa.int32()), "entry": pa.array(["", *(e for _, e in found)], pa.string()),
            "toxic": pa.array([n[1], *(toxic[k] for k in found)], pa.int64()), "clean": pa.array([n[0], *(clean[k] for k in found)], pa.int64())})

    trials = rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(keyed, "copy long, toxic int, text string")
    trials = trials.repartition("copy", "toxic").sortWithinPartitions("copy", "toxic")  # at most the sample's rows
    counts = trials.mapInArrow(counted, "length int, entry string, toxic long, clean long")
    counts = saved(counts.groupBy("length", "entry").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean")]), "entries")
    total = counts.where("length = -1").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return {}
    pos, neg = total["toxic"], total["clean"]
    tried = {r["length"]: r["n"] for r in counts.where("toxic > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per length
    p, q = (F.col("toxic") + 0.5) / (pos + 1), (F.col("clean") + 0.5) / (neg + 1)
    both = (F.col("toxic") + F.col("clean")) / (pos + neg)
    # likelihood ratio of "occurs", given toxic and given clean
    ratio = 2 * (F.col("toxic") * F.log(p / both) + F.when(F.col("clean") > 0, F.col("clean") * F.log(q / both)).otherwise(0.0))
    good = (counts.where("length >= 0 and toxic >= 3").withColumn("ratio", ratio).withColumn("odds", F.log(p / q))
            .where(F.col("toxic") * neg > 9 * F.col("clean") * pos))
    lexicon: dict = {}
    for k in STEMS:
        for r in good.where((F.col("length") == k) & (F.col("ratio") > 2 * math.log(tried.get(k, 1) + 1))).orderBy(F.desc("ratio"), "entry").collect():  # bounded by the sample
            lexicon[(k, r["entry"])] = r["odds"]
    return lexicon


@dataclass
class Toxicity:
    """A fitted scorer; everything in it is bounded by the parameters above."""
    entries: list[tuple[int, str]]
    bits: list[int]  # voters of each entry and pattern, as a bit set
    n_voters: int
    limits: tuple[float, float] = (0.05, 0.02)  # from which on the patterns vote
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0
    accuracies: list[tuple[float, float]] = field(default_factory=list)
    correlated: list[tuple[int, int]] = field(default_factory=list)

    def hits(self, text: str, index: dict | None = None) -> list[int]:
        """Sorted features of a text: the lexicon entries in it, then the patterns that vote."""
        index = index or {e: i for i, e in enumerate(self.entries)}
        out, n = {index[e] for e in entries_of(words_of(text), index)}, len(self.entries)
        out.update(n + i for i, (v, least) in enumerate(zip(pattern_votes(text), self.limits, strict=True)) if v >= least)
        return sorted(out)

    def score_hits(self, hits: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(self.weights[hits].sum())))))

    def score_column(self, hits: str) -> Column:
        """Score of a column of features, batch by batch in Arrow."""
        @F.pandas_udf("double")
        def score(found: pd.Series) -> pd.Series:
            return pd.Series([self.score_hits(list(h)) for h in found], dtype="float64")
        return score(F.col(hits))


def voters(lexicon: dict) -> Toxicity:
    """The fixed list is one voter; each learned lexicon is dealt into VOTERS_EACH,
    by a hash; each pattern is one. An entry of two lists votes for both."""
    bits: dict[tuple[int, str], int] = {(0, w): 1 for w in INSULTS}
    for k, e in sorted(lexicon):
        at = 1 + STEMS.index(k) * VOTERS_EACH + xxhash.xxh3_64_intdigest(e) % VOTERS_EACH
        bits[k, e] = bits.get((k, e), 0) | 1 << at
    n = 1 + len(STEMS) * VOTERS_EACH
    return Toxicity(list(bits), [*bits.values(), *(1 << n + i for i in range(len(PATTERNS)))], n + len(PATTERNS))


def label_model(votes: np.ndarray, label: np.ndarray, count: np.ndarray, share: float,
                rounds: int = 40) -> tuple[list[tuple[float, float]], list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Rates (vote given toxic, vote given clean), correlated pairs, the discount of
    each voter, and the posterior of each pattern.

    ``votes`` are the distinct patterns (rows of 0 and 1), ``label`` their class or -1
    where none is known, ``count`` their rows. Expectation maximization begins with
    the labelled patterns, whose class is fixed, and goes on over all; the unlabelled
    weigh OTHERS times as much as the labelled at most, so a common cause of votes
    that isn't toxicity can't take over. Voters that go together among toxic texts more than
    their rates explain are correlated; each one's evidence is divided by the root of
    1 + the sum of its correlations."""
    known = (label >= 0) & (set(label.tolist()) >= {0, 1})  # labels of one class tell nothing
    weight = count.astype(float)
    n_known, n_other = weight[known].sum(), weight[~known].sum()
    if n_known and n_other:
        weight[~known] *= min(1.0, OTHERS * n_known / n_other)
    toxic = np.where(known, label, 0.0) * weight * known
    clean = np.where(known, 1 - label, 0.0) * weight * known
    first = [(np.full(votes.shape[1], r), 20.0) for r in UNLABELLED]  # what is believed without labels
    if toxic.sum() and clean.sum():
        first = [((w @ votes + 0.5) / (w.sum() + 1), 2.0) for w in (toxic, clean)]
    else:
        for rates, _ in first:
            rates[1:] = 0.1  # nothing is known of the others
    p1, p0 = first[0][0].copy(), first[1][0].copy()
    discount = np.ones(len(p1))
    for _ in range(rounds):
        posterior = np.where(known, label, _posterior(votes, p1, p0, discount, share))
        w1, w0 = weight * posterior, weight * (1 - posterior)
        p1 = np.clip((w1 @ votes + first[0][1] * first[0][0]) / (w1.sum() + first[0][1]), 1e-4, 1 - 1e-4)
        p0 = np.clip((w0 @ votes + first[1][1] * first[1][0]) / (w0.sum() + first[1][1]), 1e-6, 1 - 1e-4)
        seen = votes - p1
        cov = (seen * w1[:, None]).T @ seen / max(w1.sum(), 1e-9)
        corr = np.clip(cov / np.sqrt(np.outer(p1 * (1 - p1), p1 * (1 - p1))), 0, 1) * ~np.eye(len(p1), dtype=bool)
        corr[corr < 0.1] = 0
        discount = 1 / np.sqrt(1 + corr.sum(1))
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(corr >= 0.25)), strict=True)]
    return list(zip(p1.tolist(), p0.tolist(), strict=True)), pairs, discount, _posterior(votes, p1, p0, discount, share)


def _posterior(votes: np.ndarray, p1: np.ndarray, p0: np.ndarray, discount: np.ndarray, share: float) -> np.ndarray:
    yes, no = discount * np.log(p1 / p0), SILENCE * discount * np.log((1 - p1) / (1 - p0))
    z = math.log(share / (1 - share)) + votes @ yes + (1 - votes) @ no
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS, carry: bool = False) -> tuple[Toxicity, DataFrame]:
    """A scorer for ``docs`` (doc_id, text) and their features, (__id, __hits, __mask),
    beside all columns of ``docs`` if ``carry``.

    Labels (doc_id, toxic) are read of training rows only (:func:`in_training`).
    Without any, or with one class only, the fixed list and the patterns vote
    alone and the share of toxic rows is taken as a tenth.

    The label model sees all documents, as counts of vote patterns; there are at most
    2 ** voters of them (a bound of the parameters) for each label."""
    sample, share = _sampled(labels, bound)
    lexicon = learned_lexicons(docs, sample)
    share = min(max(share, 0.01), 0.5) if lexicon else 0.1
    model = voters(lexicon)

    @F.pandas_udf("hits array<int>, mask int")
    def featured(texts: pd.Series) -> pd.DataFrame:
        index = {e: i for i, e in enumerate(model.entries)}
        hits = [model.hits(t or "", index) for t in texts]
        return pd.DataFrame({"hits": hits, "mask": [functools.reduce(operator.or_, (model.bits[i] for i in h), 0) for h in hits]})

    d = docs.select(*(docs.columns if carry else []), F.col("doc_id").cast("long").alias("__id"), featured("text").alias("__seen"))
    hits = saved(d.withColumns({"__hits": F.col("__seen.hits"), "__mask": F.col("__seen.mask")}).drop("__seen"), "hits")
    known = sample.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic"))
    seen = (hits.select("__id", "__mask").join(F.broadcast(known), "__id", "left")
            .groupBy(F.col("__mask").alias("mask"), F.col("__toxic").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not seen:
        return model, hits
    masks = np.array([r["mask"] for r in seen])
    votes = (masks[:, None] >> np.arange(model.n_voters) & 1).astype(float)
    label = np.array([-1 if r["toxic"] is None else r["toxic"] for r in seen], float)
    model.accuracies, model.correlated, _, posterior = label_model(votes, label, np.array([r["n"] for r in seen]), share)
    by_mask = dict(zip(masks.tolist(), posterior.tolist(), strict=True))

    some = F.size("__hits") > 0
    n = sum(r["n"] for r in seen)
    n_some = sum(r["n"] for r in seen if r["mask"])
    rate = F.when(some, TRAINING_ROWS / 2 / max(1, n_some)).otherwise(TRAINING_ROWS / 2 / max(1, n - n_some))
    train = hits.where(F.pmod(F.xxhash64("__id", "__hits"), F.lit(1_000_000)) < rate * 1_000_000)
    grouped = train.groupBy(F.col("__hits").alias("hits"), F.col("__mask").alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.first(rate).alias("rate")).collect()  # bounded by TRAINING_ROWS
    weight = np.array([r["n"] / min(1.0, r["rate"]) for r in grouped], float)
    model.weights, model.bias = linear([r["hits"] for r in grouped], np.array([by_mask[r["mask"]] for r in grouped]), weight,
                                       len(model.entries) + len(PATTERNS))
    return model, hits


def linear(x: list[list[int]], y: np.ndarray, weight: np.ndarray, size: int, steps: int = 1500, penalty: float = 0.003) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features with probabilities as labels, by
    gradient steps with momentum, scaled per coordinate."""
    w, bias = np.zeros(size), -4.0
    if not x:
        return w, bias
    rows = np.repeat(np.arange(len(x)), [len(h) for h in x])
    cols = np.array([c for h in x for c in h], np.int64)
    some = np.array([len(h) > 0 for h in x])
    weight = weight / (weight[some].mean() if some.any() else weight.mean())
    m, v, at = np.zeros(size + 1), np.zeros(size + 1), np.append(w, bias)
    for step in range(1, steps + 1):
        z = at[-1] + np.bincount(rows, at[cols], minlength=len(x))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(cols, err[rows], minlength=size) + penalty * at[:-1], err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        at -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, bias = at[:-1], float(at[-1])
    return w, bias


def score(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    The score is a function of the text alone (null: empty), from 0 to 1; texts
    without any feature all get the same low score. ``predicted`` is 1 from TOXIC
    on; ``held_out`` is false for rows without doc_id. Repeated rows come back as
    often; an empty table gives no rows; further columns, whatever their names, are not
    looked at; a very long text is scored whole."""
    model, hits = fit(docs, labels, bound)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score_hits(h) for h in b["__hits"].to_pylist()]
            yield pa.record_batch({"doc_id": b["__id"], "score": pa.array(s, pa.float64())})

    s = hits.select("__id", "__hits").mapInArrow(scored, "doc_id long, score double")
    return s.select("doc_id", F.coalesce(~in_training("doc_id"), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that are not predicted toxic, repeated rows as
    often. Null and empty texts are not toxic; an empty table stays empty. The texts are
    looked at once: their features are written beside their rows."""
    model, seen = fit(docs, labels, carry=True)
    return seen.where(model.score_column("__hits") < TOXIC).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: toxicity of all ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
