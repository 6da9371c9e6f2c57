"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts to Latin, digits and signs inside words to the
letters they stand for, everything else to one space. Lexicon entries are beginnings of words and whole words; an
automaton finds all of them in one pass. An occurrence inside an exception phrase doesn't count. An entry counts once
its occurrences, divided by the number of words, reach the entry's level: words that are an insult anywhere have level
0, beginnings that clean texts have now and then a higher one. The sum of the weights and the sum of weighted
occurrences per word go through a logistic curve.

Entries, weights, exception phrases and the curve are learned from the whole texts of at most SAMPLE labelled ids of
each class, those with the smallest hash; an id with several texts gives the one with the smallest hash, so copies push
nothing out. Executors count fragments and phrases; the driver gets counts of what toxic texts share, for each toxic
text the numbers of those fragments, and two figures a text for the curve.

Defined cases: null, empty and signs-only texts score as texts without matches; without labels of both kinds the
lexicon is empty and every score is 0; null labels are left out, and an id with both labels is toxic; repeated rows are
scored alike; of entries that stand out alike the shorter, then the later in order is taken; an empty table gives an
empty one; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop, extended, free, table, tidy

#: Labelled ids of each class to learn from, and texts whose fragments are counted at once.
SAMPLE, AT_ONCE = 2000, 100
#: Lengths of word beginnings; least documents, share of the toxic ones and log-odds of an entry; the limit of a toxic score.
PREFIXES, LEAST, SHARE, ODDS, LIMIT = (4, 5, 6, 7, 8), 3, 0.02, 2.0, 0.7
#: Levels: occurrences per word that an entry can ask for.
LEVELS = (0.0, 1 / 150, 1 / 40)

# Letters of other scripts, digits and signs that stand for Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

_SIGN = re.compile(r"(?<=[^\W\d_])[@$!|€]+(?=[^\W\d_])")
_APART = re.compile(r"[\W\d_]+")
_ZERO_WIDTH = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_FOLD = {ord(k): v for k, v in (LOOKALIKES | {d: c for d, c in DIGITS.items() if d.isdigit()}).items()} | _ZERO_WIDTH
_PLAIN = {ord(d): c for d, c in DIGITS.items() if d.isdigit()}


def fold(text: str | None) -> str:
    """The text as words of letters, one space before, between and after them."""
    text = (text or "").lower()
    if any(s in text for s in "@$!|€"):
        text = _SIGN.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)
    text = text.translate(_PLAIN) if text.isascii() else unicodedata.normalize("NFKC", text).translate(_FOLD)
    return f" {_APART.sub(' ', text).strip()} "


def fragments(folded: str) -> set[tuple[str, int]]:
    """Beginnings of words, and whole words, as they stand in a folded text, each with the levels that it reaches."""
    words = Counter(folded.split())
    n, counts = sum(words.values()), Counter()
    for w, k in words.items():
        for size in PREFIXES:
            if len(w) >= size:
                counts[" " + w[:size]] += k
        if len(w) > 2:
            counts[f" {w} "] += k
    return {(x, i) for x, k in counts.items() for i, level in enumerate(LEVELS) if k >= level * n}


@dataclass
class Model:
    #: For each entry the weights at its levels (level number to weight).
    weights: dict[str, dict[int, float]] = field(default_factory=dict)
    #: Phrases with a word before or after an entry that make it harmless.
    exceptions: tuple[str, ...] = ()
    #: Of the logistic curve: intercept, slope of the sum, slope of the sum by length.
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)


class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.automaton = model, ahocorasick.Automaton()
        for x in model.weights:
            self.automaton.add_word(x, (len(x), x))
        for x in model.exceptions:
            self.automaton.add_word(x, (len(x), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, folded: str) -> dict[str, int]:
        """Occurrences of each entry outside exception phrases."""
        if not len(self.automaton):
            return {}
        found, harmless = [], set()
        for end, (size, x) in self.automaton.iter(folded):
            if x is None:
                harmless.update(at for at in range(end - size + 1, end) if folded[at] == " ")
            else:
                found.append((end - size + 1, x))
        return Counter(x for at, x in found if at not in harmless)

    def features(self, folded: str) -> tuple[float, float]:
        found = self.matches(folded)
        if not found:
            return 0.0, 0.0
        n = max(1, folded.count(" ") - 1)
        total = dense = 0.0
        for x, k in found.items():
            w = max((w for i, w in self.model.weights[x].items() if k >= LEVELS[i] * n), default=0.0)
            total, dense = total + w, dense + w * k / n
        return min(total, MOST), min(dense, 1.0)

    def score(self, text: str | None) -> float:
        a, b, c = self.model.curve
        x, y = self.features(fold(text))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * x + c * y))))


#: The sum of weights counts up to here, so that one rare entry and many have slopes of one kind.
MOST = 8.0


def _strength(p: np.ndarray, n: np.ndarray, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds, and how far p of `toxic` texts is from chance given n of `clean` ones (twice the log-likelihood ratio)."""
    rate = (p + n) / (toxic + clean)
    odds = np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
    return odds, 2 * (p * np.log(np.maximum(p, 1) / toxic / rate) + n * np.log(np.maximum(n, 1) / clean / rate))


def choose(known: list[tuple[str, int]], p: np.ndarray, n: np.ndarray, texts: list[np.ndarray], clean: int) -> dict[str, dict[int, float]]:
    """Entries and their weights. known: fragments, which p toxic and n clean texts have; texts: of each toxic text the
    places of its fragments in `known`."""
    weights: dict[str, dict[int, float]] = {}
    toxic, chosen = len(texts), set()
    bar = 2 * math.log(max(2, len(known)))
    # Entries that stand out among all toxic texts; of beginnings that say the same, the shortest.
    odds, far = _strength(p, n, toxic, clean)
    good = np.flatnonzero((p >= max(LEAST, SHARE * toxic)) & (odds >= ODDS) & (far >= 2 * bar))
    for k in sorted(good.tolist(), key=lambda k: (len(known[k][0]), known[k])):
        x, i = known[k]
        near = [w for j in range(2, len(x)) for w in weights.get(x[:j], {}).values()] + list(weights.get(x, {}).values())
        if not any(w >= odds[k] - 0.3 for w in near):
            weights.setdefault(x, {})[i] = float(odds[k])
            chosen.add(k)
    # Then, again and again, the entry that stands out most among the toxic texts that have no entry yet.
    left = [t for t in texts if not chosen.intersection(t.tolist())]
    while left:
        counts = np.bincount(np.concatenate(left), minlength=len(known))
        some = np.flatnonzero(counts >= LEAST)
        odds, far = _strength(counts[some], n[some], len(left), clean)
        far = np.where(odds >= ODDS, far, 0.0)
        if not len(far) or far.max() < bar:
            break
        at = max(np.flatnonzero(far == far.max()).tolist(), key=lambda j: (-len(known[some[j]][0]), known[some[j]]))
        k = int(some[at])
        weights.setdefault(known[k][0], {})[known[k][1]] = float(odds[at])
        left = [t for t in left if k not in t]
    return weights


def curve_of(features: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """The logistic curve over (sum, sum by length, label): Newton's method with a small ridge."""
    x = np.array([(1.0, a, b) for a, b, _ in features])
    y = np.array([float(y) for *_, y in features])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    beta, ridge = np.zeros(3), np.array([0, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip((x / scale) @ beta, -60, 60)))
        grad = (x / scale).T @ (p - y) + ridge * beta
        hess = ((x / scale) * (p * (1 - p))[:, None]).T @ (x / scale) + np.diag(ridge + 1e-6)
        beta -= np.clip(np.linalg.solve(hess, grad), -5, 5)
    return tuple(float(v) for v in beta / scale)


def phrases_of(folded: str, entries: Scorer) -> set[str]:
    """Each entry of a folded text with the word before, and with the word after."""
    words = folded.split()
    hit = {w: bool(entries.matches(f" {w} ")) for w in set(words)}
    return {f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if hit[a] or hit[b]}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: the fragments of a text are many times as large as it."""
    for batch in batches:
        for a in range(0, len(batch), AT_ONCE):
            yield batch.slice(a, AT_ONCE)


def fit(rows: DataFrame) -> Model:
    """Learn from rows (doc_id, text, toxic 0 or 1)."""
    spark = rows.sparkSession
    bounded_batches(spark)
    sizes = dict(rows.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model()
    schema = "x string, i int, p long, n long"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            seen = {1: Counter(), 0: Counter()}
            for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[y].update(fragments(fold(t)))
            every = list(seen[1] | seen[0])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in every], pa.string()), pa.array([i for _, i in every], pa.int32()), *(pa.array([seen[y][k] for k in every], pa.int64()) for y in (1, 0))], ["x", "i", "p", "n"])

    table_ = rows.mapInArrow(tidy(counted), schema).groupBy("x", "i").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).filter(F.col("p") >= LEAST).orderBy("x", "i").toArrow()
    known = list(zip(table_["x"].to_pylist(), table_["i"].to_pylist(), strict=True))
    p, n = (table_[c].to_numpy().astype(np.int64) for c in ("p", "n"))
    shared = spark.sparkContext.broadcast(known)  # what LEAST of at most SAMPLE texts share

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: k for k, x in enumerate(shared.value)}
        for batch in _slices(batches):
            found = [sorted(place[x] for x in fragments(fold(t)) if x in place) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "found"])

    found = rows.filter("toxic = 1").mapInArrow(tidy(placed), "doc_id long, found array<int>").orderBy("doc_id").toArrow()
    texts = [x.values.to_numpy().astype(np.int64) for x in found["found"]]
    weights = choose(known, p, n, texts, clean)
    shared.unpersist()
    if not weights:
        return Model()

    def phrased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Scorer(Model(weights))
        for batch in batches:
            seen = {1: Counter(), 0: Counter()}
            for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                folded = fold(t)
                if entries.matches(folded):
                    seen[y].update(phrases_of(folded, entries))
            every = list(seen[1] | seen[0])
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.nulls(len(every), pa.int32()), *(pa.array([seen[y][k] for k in every], pa.int64()) for y in (1, 0))], ["x", "i", "p", "n"])

    # A phrase of an entry and the next or previous word is an exception if clean texts have it and no toxic one does.
    harmless = rows.mapInArrow(tidy(phrased), schema).groupBy("x").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).filter((F.col("p") == 0) & (F.col("n") >= LEAST)).orderBy("x").toArrow()
    lexicon = Model(weights, tuple(harmless["x"].to_pylist()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            two = [scorer.features(fold(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in two], pa.float64()) for k in (0, 1)), batch.column(2)], ["doc_id", "a", "b", "toxic"])

    features = rows.mapInArrow(tidy(measured), "doc_id long, a double, b double, toxic int").orderBy("doc_id").select("a", "b", "toxic").collect()
    return Model(weights, lexicon.exceptions, curve_of([tuple(r) for r in features]))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows that are not held out. Ids are chosen first, so few texts move."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids: dict[int, int] = {}
    for y in (1, 0):
        rows = known.filter(F.col("toxic") == y).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
        ids |= {r[0]: y for r in rows}
    if not ids:
        return Model()
    # Nulls have no place, so an id gives its empty text only where it has no other.
    text = F.col("text").cast("string")
    place = F.when(text.isNotNull(), F.xxhash64(text))
    rows = docs.filter(F.col("doc_id").isin(list(ids))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min_by(text, place).alias("text"))
    rows = rows.withColumn("toxic", F.col("doc_id").isin([i for i, y in ids.items() if y]).cast("int"))
    rows, path = cut(rows, "toxicity-sample")
    model = fit(rows)
    drop(docs.sparkSession, path)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", flag: str = "toxic", limit: float = LIMIT) -> DataFrame:
    """docs with a score from 0 to 1 and whether it reaches the limit (0 or 1), in columns `out` and `flag`; a name that
    docs has already gets a number behind it."""
    bounded_batches(docs.sparkSession)
    out = free(out, docs.columns)
    flag = free(flag, [*docs.columns, out])
    schema, place = extended(docs, (out, "double"), (flag, "int")), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(place).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= limit) for s in scores], pa.int32())], schema.names)

    return docs.mapInArrow(tidy(run), schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")), out="score", flag="predicted")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
