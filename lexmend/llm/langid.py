"""Language identification in two levels: the family, then the languages inside it.

A one-versus-rest linear SVM for each family picks the family; inside a family one-versus-one
linear SVMs vote between its languages. Features are hashed byte n-grams (1 to 4) of the lower-
cased letters of the whole text, in relative frequencies, so a document's score is the mean
weight over its n-grams and long texts need no cut: they are summed up in blocks.

Training takes a bounded, documented sample of labelled rows: the ``docs_per_lang`` documents of
each language with the smallest hashes of id and text, each with its whole text, counted where it
lies; what reaches the driver is a vector of ``BINS`` frequencies for each. A language is learned from
``least_docs`` documents on; a table with more than ``most_langs`` such languages raises, because
the classifiers of a family grow with the square of its languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Null languages
train nothing, and languages with too few documents are not learned. Repeated rows train once and
are scored alike. Of families or languages that score alike the first by name of the family and the last by
name of the language is told. Without any labelled row every text is ``und``. Empty tables give
empty results. Columns other than id, text and language, of any name, are not read; :func:`keep_known` passes them on.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmend.llm.arrow import slices
from lexmend.llm.ngrams import byte_grams, groups

#: ISO 639-1 codes by family. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tt",
    "indic": "hi bn mr gu pa ur ne",
    "semitic": "ar he mt am",
    "hellenic": "el",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

SIZES = (1, 2, 3, 4)
BINS = 1 << 13
NOT_LETTERS = re.compile(r"[\W\d_]+")


def prepared(text: str | None) -> bytes:
    """Lower-cased runs of letters between blanks; empty where there is no letter."""
    low, parts, blank = (text or "").lower(), [], False
    for at in range(0, len(low), BLOCK):  # what a long text is taken apart to is held for a block at a time
        part = NOT_LETTERS.sub(" ", low[at : at + BLOCK])
        parts.append(part[1:] if blank and part.startswith(" ") else part)
        blank = part.endswith(" ")
    body = "".join(parts).strip()
    return f" {body} ".encode("utf-8", "surrogatepass") if body else b""


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, f"other:{lang}")


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, c: float = 10.0, seed: int = 3, rows: np.ndarray | None = None) -> np.ndarray:
    """Linear SVM with squared hinge by dual coordinate descent; the last weight is the bias. ``rows`` are those of ``x`` that ``y`` belongs to, all by default; they aren't copied."""
    n, d = len(y), x.shape[1]
    at = list(range(n)) if rows is None else rows.tolist()
    weight = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1)))
    ridge = 1.0 / (2 * c * weight)
    square = np.einsum("ij,ij->i", x, x)[at].astype(np.float64) + 1.0 + ridge
    alpha, w, b = np.zeros(n), np.zeros(d, np.float32), 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(n):
            own = x[at[i]]
            g = y[i] * (float(w @ own) + b) - 1 + alpha[i] * ridge[i]
            new = max(alpha[i] - g / square[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w += np.float32(step) * own
                b += step
                most = max(most, abs(step))
            alpha[i] = new
        if most < 1e-3:
            break
    return np.append(w, np.float32(b))


@dataclass
class LanguageModel:
    """``weights`` has a row of hashed weights for each classifier: families first, then pairs."""

    families: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS + 1), np.float32))
    scales: np.ndarray = field(default_factory=lambda: np.zeros(0))

    #: For each language: log frequencies of the hashed n-grams, and mean and deviation of a text's mean of them.
    profiles: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS), np.float32))
    typical: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))

    def margins(self, texts: list[bytes]) -> np.ndarray:
        return self.means(texts, self.weights[:, :-1]) * SCALE + self.weights[:, -1]

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """How far the likeliest language's n-grams are from typical, in deviations of held-out texts; short texts vary more."""
        if not len(self.profiles):
            return np.zeros(len(texts))
        off = (self.means(texts, self.profiles) / len(SIZES) - self.typical[:, 0]) / self.typical[:, 1]
        return off.max(axis=1) / np.sqrt(1 + SHORT / np.maximum([len(t) for t in texts], 1))

    @staticmethod
    def means(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
        """For each row of ``weights`` the mean weight over a text's n-grams, summed over their sizes."""
        out = np.zeros((len(texts), len(weights)))
        table = np.ascontiguousarray(weights.T)
        for a, b in groups(texts, BLOCK):
            if b - a == 1 and len(texts[a]) > BLOCK:
                out[a] = long_mean(texts[a], table)
                continue
            data = np.frombuffer(b"".join(texts[a:b]), np.uint8).astype(np.uint64)
            lengths = np.array([len(t) for t in texts[a:b]])
            ends = np.cumsum(lengths)
            for grams, n in zip(byte_grams(data, SIZES, BINS), SIZES, strict=True):
                start = np.minimum(ends - lengths, len(grams))
                stop = np.maximum(start, np.minimum(ends - n + 1, len(grams)))
                # Sums over [start, stop) of every text; what lies between is n-grams across two texts.
                held = np.zeros((len(grams) + 1, table.shape[1]), np.float32)
                table.take(grams, axis=0, out=held[:-1], mode="clip")
                sums = np.add.reduceat(held, np.column_stack((start, stop)).ravel(), axis=0, dtype=np.float64)[::2]
                some = stop > start
                out[a:b][some] += sums[some] / (stop - start)[some, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the product of the logistic margins of the family and of the language inside it."""
        return self.predict_prepared([prepared(t) for t in texts])

    def predict_prepared(self, ready: list[bytes]) -> tuple[list[str], np.ndarray]:
        """:meth:`predict` of texts that went through :func:`prepared`."""
        langs, scores = ["und"] * len(ready), np.zeros(len(ready))
        if not self.families:
            return langs, scores
        chance = 1 / (1 + np.exp(-np.clip(self.margins(ready) * self.scales, -30, 30)))
        names = list(self.families)
        top = chance[:, : len(names)].argmax(axis=1)
        votes = {pair: chance[:, len(names) + i] for i, pair in enumerate(self.pairs)}
        for i, body in enumerate(ready):
            if not body:
                continue
            inside = self.families[names[top[i]]]
            # The language with the best worst duel: with two languages, the winner of the one duel.
            duel = {x: min([1.0, *(votes[x, y][i] if (x, y) in votes else 1 - votes[y, x][i] for y in inside if y != x)]) for x in inside}
            langs[i] = max(duel, key=lambda x: (duel[x], x))
            scores[i] = (chance[i, top[i]] if len(names) > 1 else 1.0) * duel[langs[i]]
        return langs, scores


#: Mean weights are small numbers; frequencies are scaled so that the margin's step is of order one.
SCALE = 40.0
#: Bytes of a text that are looked at together.
BLOCK = 1 << 18
#: Frequency of an unseen n-gram in a profile, the letters under which chance doubles a text's variance, and the fewest held-out texts that tell a deviation.
UNSEEN, SHORT, LEAST_HELD = 1e-5, 30, 10


def blocks(text: bytes):
    """For each block of a text and size n the bins of the n-grams that start in it."""
    for at in range(0, len(text), BLOCK):
        data = np.frombuffer(text[at : at + BLOCK + max(SIZES) - 1], np.uint8).astype(np.uint64)
        for n in SIZES:
            if len(data) >= n:
                yield n, byte_grams(data, (n,), BINS)[0][:BLOCK]


def long_mean(text: bytes, table: np.ndarray) -> np.ndarray:
    """:meth:`LanguageModel.means` of one text, a block at a time; ``table`` has a row for each bin."""
    return (counts(text) / np.maximum([len(text) - n + 1 for n in SIZES], 1)[:, None]).sum(axis=0) @ table.astype(np.float64)


def counts(text: bytes) -> np.ndarray:
    """How often each bin occurs, a row for each size of n-grams."""
    out = np.zeros((len(SIZES), BINS))
    for n, grams in blocks(text):
        out[SIZES.index(n)] += np.bincount(grams, minlength=BINS)[:BINS]
    return out


def vector(text: bytes) -> np.ndarray:
    """Relative frequencies of the n-grams of a whole text, summed over their sizes."""
    return (counts(text) * (SCALE / np.maximum([len(text) - n + 1 for n in SIZES], 1)[:, None])).sum(axis=0).astype(np.float32)


def learned(rows: DataFrame, least_docs: int, most_langs: int) -> dict[str, int]:
    """The languages with enough documents, and their numbers."""
    seen = rows.filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs)
    found = {r["lang"]: r["n"] for r in seen.orderBy(F.desc("n"), "lang").limit(most_langs + 1).collect()}
    if len(found) > most_langs:
        raise ValueError(f"more than {most_langs} languages have {least_docs} documents or more; is the column clean? (most_langs, least_docs)")
    return found


def fit(rows: DataFrame, docs_per_lang: int = 400, least_docs: int = 5, most_langs: int = 100) -> LanguageModel:
    """Train on ``rows`` (id, text, lang), of which a bounded number for each language is used."""
    langs = learned(rows, least_docs, most_langs)
    if not langs:
        return LanguageModel()
    rank = F.pmod(F.xxhash64(F.col("id").cast("string"), F.col("text")), F.lit(1 << 40))
    labelled = rows.filter(F.col("lang").isin(list(langs))).select("lang", "text", rank.alias("rank"))
    below = lambda most: F.col("rank") < F.element_at(F.create_map(*[x for lang, n in most.items() for x in (F.lit(lang), F.lit(n).cast("long"))]), F.col("lang"))
    # About twice as many as are needed pass the first look; the smallest ranks of these are taken.
    near = labelled.filter(below({lang: int(min(1.0, 2.0 * docs_per_lang / n) * (1 << 40)) for lang, n in langs.items()}))
    ranks: dict[str, list[int]] = {lang: [] for lang in langs}
    for r in near.select("lang", "rank").distinct().orderBy("rank", "lang").limit(3 * docs_per_lang * len(langs)).collect():
        ranks[r["lang"]].append(r["rank"])
    picked = near.filter(below({lang: (x[docs_per_lang] if len(x) > docs_per_lang else 1 << 40) for lang, x in ranks.items()}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            ready = [prepared(t) for t in batch.column(2).to_pylist()]
            made = [vector(t) for t in ready]
            at = [np.flatnonzero(v) for v in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in ready], pa.int64()), pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())), pa.array([v[x] for v, x in zip(made, at, strict=True)], pa.list_(pa.float32()))],
                names=["lang", "rank", "size", "bins", "shares"],
            )

    # Rows that repeat id and text train once.
    single = picked.groupBy("lang", "rank").agg(F.first("text").alias("text"))
    sample = single.mapInArrow(count, "lang string, rank long, size long, bins array<int>, shares array<float>").filter("size > 0").toArrow()
    # Sorted by places, not copied: the driver holds the sample once, and its vectors once.
    order = pc.sort_indices(sample, [("rank", "ascending"), ("lang", "ascending")])
    x, place = np.zeros((sample.num_rows, BINS), np.float32), np.argsort(order.to_numpy()).tolist()
    for i, bins, shares in zip(place, sample["bins"], sample["shares"], strict=True):
        x[i, bins.values.to_numpy()] = shares.values.to_numpy()
    langs, sizes = sample["lang"].take(order).to_pylist(), sample["size"].take(order).to_numpy()
    del sample
    return fit_vectors(x, langs, sizes)


def fit_vectors(x: np.ndarray, langs: list[str], sizes: np.ndarray) -> LanguageModel:
    """Train on the :func:`vector` of each text, its language and its bytes."""
    if not len(x):
        return LanguageModel()
    y = np.array(langs)
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    of = np.array([family_of(v) for v in langs])
    weights, scales = [], []

    def add(rows: np.ndarray, positive: np.ndarray) -> None:
        goal = np.where(positive, 1.0, -1.0)
        w = fit_svm(x, goal, rows=rows)
        own = (np.array([x[i] @ w[:-1] for i in rows.tolist()]) + w[-1]) * goal
        weights.append(w)
        # Margins are put on one scale: a typical training margin means a chance of about 0.98.
        scales.append(4.0 / max(float(np.median(own)), 0.05))

    for name in families:
        add(np.arange(len(of)), of == name)
    pairs = [p for inside in families.values() for p in itertools.combinations(inside, 2)]
    for p, q in pairs:
        rows = np.flatnonzero((y == p) | (y == q))
        add(rows, y[rows] == p)
    return LanguageModel(families, pairs, np.array(weights), np.array(scales), *fit_profiles(x, y, sizes))


def fit_profiles(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Profiles of the languages, and what is typical of texts that they weren't made from: a mean of each, and one deviation of all; none if a language has too few such texts."""
    profiles, means, off, per_size = [], [], [], len(SIZES) * SCALE
    for lang in sorted(set(y)):
        own, chance = np.flatnonzero(y == lang), np.sqrt(1 + SHORT / sizes[y == lang])
        held = np.arange(len(own)) % 5 == 0
        if held.sum() < LEAST_HELD or held.all():
            return np.zeros((0, BINS), np.float32), np.zeros((0, 2))
        profiles.append(np.log(sum(x[i] for i in own[~held].tolist()) / (~held).sum(dtype=np.float32) / per_size + UNSEEN))
        z, spread = x[own[held]] @ profiles[-1] / per_size, chance[held]
        means.append(np.average(z, weights=1 / spread**2))
        off.append(np.mean(((z - means[-1]) / spread) ** 2))
    return np.array(profiles, np.float32), np.array([(m, max(float(np.sqrt(np.mean(off))), 0.05)) for m in means])


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, lang_pred, score. Only the text decides."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float = 0.0, least_fit: float | None = None) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text has a known language with at least ``least_score``, and one that fits by ``least_fit``."""
    at = df.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.string()).to_pylist()
            ready = [prepared(t) for t in texts]
            langs, scores = model.predict_prepared(ready)
            fits = np.zeros(len(texts)) if least_fit is None else model.fits(ready)
            yield batch.filter(pa.array([x != "und" and s >= least_score and (least_fit is None or f >= least_fit) for x, s, f in zip(langs, scores, fits.tolist(), strict=True)], pa.bool_()))

    return df.mapInArrow(each, df.schema)


def training_rows(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return df.filter(~held_out).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
