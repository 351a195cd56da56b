"""Toxicity scores by a logistic regression with a counterfactual penalty.

A text is the set of its words and of the word beginnings of 4 to 6 letters, hashed. Beginnings
carry what a stem says about words that training never saw. Features enter the model if they
separate the classes of the training rows by more than ``least_z`` standard errors and occur in
``least_rows`` of them, the ``most_features`` strongest; the terms for groups of people always enter,
so that the penalty can act on them.

Training minimises log loss + ridge + ``penalty`` times the mean squared change of the logit
when, in a labelled sentence, every identity term is swapped for another one of its group. A
neutral mention of a group then can't raise the score by much, however the labels are biased.
Every sentence of the sampled texts counts; sentences that change by the same features are one
weighted pair, so a long text sends as many pairs as it has kinds of change.

Labels are taken from a bounded, documented sample: the ``rows_per_class`` ids of each class with
the smallest hashes, which is what lets them be broadcast; one text of each id trains.

Defined cases: null and empty texts get the score of no feature at all. Texts are read whole,
however long. Several labels of one id count as toxic if any is; labels other than 0 and 1, and
null ids, train nothing. Of several texts under one id that with the smallest hash trains. Ids
without a text row train nothing. Of features that separate equally the smaller bin enters first.
Without labels of both classes the score is 0. Repeated rows are scored alike. Empty tables give empty
results. Columns other than id, text and label, of any name, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmend.llm.common import drop_staged, staged

BINS = 1 << 20
TOKEN = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Terms for groups of people; those of one line stand in for one another.
IDENTITY_GROUPS = (
    "muslim christian jewish hindu buddhist atheist catholic",
    "muslims christians jews hindus buddhists atheists catholics",
    "black white asian latino african european arab",
    "woman man girl boy",
    "women men girls boys",
    "gay straight lesbian bisexual transgender queer",
    "immigrant refugee foreigner citizen",
    "immigrants refugees foreigners citizens",
    "deaf blind disabled elderly young",
    "muslimisch christlich jüdisch",
    "frauen männer mädchen jungen",
    "femmes hommes filles garçons",
    "mujeres hombres niñas niños",
)
SWAP = {term: line.split()[(i + 1) % len(line.split())] for line in IDENTITY_GROUPS for i, term in enumerate(line.split())}


def features(word: str) -> tuple[int, ...]:
    """The bins of one lower-cased word: the word itself and its beginnings."""
    stems = [f"{word[:n]}~" for n in (4, 5, 6) if len(word) > n]
    return tuple(crc32(x.encode("utf-8", "surrogatepass")) & (BINS - 1) for x in (word, *stems))


def tokens(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


def swapped_sentences(text: str | None) -> list[tuple[set[str], set[str]]]:
    """Words of every sentence with an identity term, as they are and with the terms swapped."""
    lowered = (text or "").lower()
    if not any(term in lowered for term in SWAP):
        return []
    every = (set(TOKEN.findall(sentence)) for sentence in SENTENCE.findall(lowered))
    return [(found, {SWAP.get(w, w) for w in found}) for found in every if found & SWAP.keys()]


def changes(text: str | None) -> Counter[tuple[frozenset[str], frozenset[str]]]:
    """How often a swap takes which words out of a sentence and puts which in."""
    return Counter((frozenset(a - b), frozenset(b - a)) for a, b in swapped_sentences(text))


@dataclass
class ToxicityModel:
    """Weights of the selected bins; ``bias`` is None where nothing could be learned."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float | None = None

    def scorer(self, cache_size: int = 200_000):
        cache: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            if self.bias is None:
                return 0.0
            nonlocal cache
            held: set[int] = set()
            for word in tokens(text):
                own = cache.get(word)
                if own is None:
                    if len(cache) >= cache_size:
                        cache = {}
                    own = cache[word] = tuple(b for b in features(word) if b in self.weights)
                if own:
                    held.update(own)
            z = self.bias + sum(self.weights[b] for b in sorted(held))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def sample_labels(labels: DataFrame, rows_per_class: int) -> DataFrame:
    """The ``rows_per_class`` ids of each class (id, toxic) with the smallest hashes."""
    ids = labels.filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ranked = [ids.filter(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(rows_per_class) for label in (0, 1)]
    return ranked[0].union(ranked[1])


def select_bins(rows: DataFrame, least_z: float, least_rows: int, most: int) -> list[int]:
    """Bins whose share of toxic rows is off by ``least_z`` standard errors, the strongest ``most``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BINS), np.int32)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = {b for w in tokens(text) for b in features(w)}
                seen[label, np.fromiter(held, np.int64, len(held))] += 1
        bins = np.flatnonzero(seen.any(axis=0))
        for at in range(0, len(bins), 100_000):
            own = bins[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(seen[0, own].astype(np.int64)), pa.array(seen[1, own].astype(np.int64))], names=["bin", "n0", "n1"])

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return []
    rate = totals[1] / (totals[0] + totals[1])
    n = F.col("n0") + F.col("n1")
    z = (F.col("n1") - n * rate) / F.sqrt(n * (rate * (1 - rate)))
    counted = rows.select("toxic", "text").mapInArrow(count, "bin int, n0 long, n1 long").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    strong = counted.filter(n >= least_rows).withColumn("z", F.abs(z)).filter(F.col("z") > least_z).orderBy(F.desc("z"), "bin").limit(most)
    return [r["bin"] for r in strong.select("bin").collect()]  # at most ``most`` rows


def optimise(size: int, rows: list[list[int]], y: np.ndarray, pairs: dict[tuple[tuple[int, ...], tuple[int, ...]], int], penalty: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Adam on the full sample: rows are lists of feature numbers, pairs those that a swap takes out and puts in, with their number."""

    def flat(lists) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([f for x in lists for f in x], dtype=np.int64)

    at, what = flat(rows)
    one, two = flat([a for a, _ in pairs]), flat([b for _, b in pairs])
    often = np.array(list(pairs.values()), dtype=np.float64)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    # Both classes weigh the same, so that one telling word can outweigh the bias.
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for t in range(1, steps + 1):
        z = np.bincount(at, w[what], len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight / len(rows)
        g = np.append(np.bincount(what, error[at], size), error.sum())
        g[:-1] += ridge * w[:-1]
        if pairs:
            change = (np.bincount(one[0], w[one[1]], len(pairs)) - np.bincount(two[0], w[two[1]], len(pairs))) * often * (2 * penalty / often.sum())
            g[:-1] += np.bincount(one[1], change[one[0]], size) - np.bincount(two[1], change[two[0]], size)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 8000, penalty: float = 1.0, ridge: float = 2e-4, least_z: float = 4.5, least_rows: int = 3, most_features: int = 4000, steps: int = 600) -> ToxicityModel:
    """Train on ``docs`` (id, text) and ``labels`` (id, toxic)."""
    picked = F.broadcast(sample_labels(labels, rows_per_class))  # at most 2 * rows_per_class rows
    # One text of each id: the sample is bounded by its labels, whatever ids repeat.
    single = docs.join(picked, "id").groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = staged(single.select("toxic", "t.text"), "toxicity")
    bins = select_bins(rows, least_z, least_rows, most_features)
    if not bins:
        drop_staged(rows)
        return ToxicityModel()
    terms = {b for t in SWAP for b in features(t)}
    order = {b: i for i, b in enumerate(sorted({*bins, *terms}))}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lambda found: sorted({order[b] for w in found for b in features(w) if b in order})
        kind = pa.list_(pa.int32())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            swaps = [changes(t) for t in texts]
            sides = [pa.array([[known(pair[side]) for pair in s] for s in swaps], pa.list_(kind)) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([known(tokens(t)) for t in texts], kind), *sides, pa.array([list(s.values()) for s in swaps], pa.list_(pa.int64()))],
                names=["y", "f", "a", "b", "n"],
            )

    sample = rows.select("toxic", "text").mapInArrow(project, "y int, f array<int>, a array<array<int>>, b array<array<int>>, n array<long>").collect()  # at most 2 * rows_per_class rows
    drop_staged(rows)
    sample.sort(key=lambda r: (r["y"], r["f"]))
    pairs: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()
    for r in sample:
        for a, b, n in zip(r["a"], r["b"], r["n"], strict=True):
            shared = {*a} & {*b}  # beginnings that a term and its stand-in have in common
            pairs[tuple(x for x in a if x not in shared), tuple(x for x in b if x not in shared)] += n
    w, bias = optimise(len(order), [r["f"] for r in sample], np.array([r["y"] for r in sample], float), dict(sorted(pairs.items())), penalty, ridge, steps)
    return ToxicityModel({b: float(w[i]) for b, i in order.items() if w[i]}, bias)


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, score, predicted (1 if score >= 0.5). Only the text decides."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            made = np.array([score(t.as_py()) for t in batch.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), pa.array((made >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(each, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def training_labels(labels: DataFrame, held_out: Column, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    return labels.filter(~held_out).select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic"))
