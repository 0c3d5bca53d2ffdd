"""Reading level of documents from the grades of their words.

Every word gets an acquisition grade from the graded texts it occurs in: the mean level of
its documents, each level weighed alike. A document is described by quantiles of the grades
of its known words, and a calibration fitted on graded documents turns these quantiles into
a level. Grades used for calibration come from the other folds, so a document never grades
its own words. Whether a text is English is told by its script and function words, so a small
or skewed sample of graded texts drops none; where these tell nothing, a text is English if most
of its letters are in words known from the graded texts. A graded document always is. The column
``lang`` isn't used.

Fitting uses at most ``max_labels`` graded documents, the first by a hash of their id. That
bounds the vocabulary, the matrices on the driver, and what goes to every executor. All
documents are then graded where they are read; only the graded sample is moved.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.checkpoints import saved
from tagloom.llm.english import is_english

LEVELS = (1, 2, 3, 4)
#: Quantiles that describe a document.
QUANTILES = np.arange(1, 20) / 20
_WORD = re.compile(r"[^\W\d_]+")
_PLACE = [f"q{int(100 * q):02d}" for q in QUANTILES]


@dataclass(frozen=True)
class Params:
    """max_labels: most graded documents used to fit. folds: for cross-fitting. least_docs:
    documents a word needs. english: share of letters in known words from which a text is
    English that has too few function words to tell.
    longer_than: characters a text must exceed. ridge: penalty of the calibration."""

    max_labels: int = 20_000
    folds: int = 4
    least_docs: int = 2
    english: float = 0.7
    longer_than: int = 40
    ridge: float = 1e-3


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.casefold()) if text else []


def grade(per_level: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Mean level of each word; rows: words, columns: levels. documents: per level."""
    rate = (per_level + 0.1) / (documents + 0.4)
    return (rate * np.array(LEVELS)).sum(1) / rate.sum(1)


@dataclass(frozen=True)
class Grades:
    words: dict[str, float]

    def describe(self, found: list[str]) -> tuple[np.ndarray, float]:
        """(quantiles of the known words' grades and their mean, share of letters in them)."""
        if not found:
            return np.zeros(len(QUANTILES) + 1), 0.0
        grades = list(map(self.words.get, found))
        sizes = list(map(len, found))
        share = sum(n for n, g in zip(sizes, grades, strict=True) if g is not None) / sum(sizes)
        known = np.array([g for g in grades if g is not None])
        if not len(known):
            return np.zeros(len(QUANTILES) + 1), 0.0
        known.sort()
        at = QUANTILES * (len(known) - 1)
        low = at.astype(int)
        part = at - low
        quantiles = known[low] * (1 - part) + known[np.minimum(low + 1, len(known) - 1)] * part
        return np.append(quantiles, known.mean()), share


@dataclass(frozen=True)
class Calibration:
    """Multinomial logistic regression on standardised quantiles."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.centre) / self.scale, np.ones(len(x))]) @ self.weights
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def level(self, x: np.ndarray) -> np.ndarray:
        return np.array(LEVELS)[self.probabilities(x).argmax(1)]


def calibrate(x: np.ndarray, level: np.ndarray, ridge: float) -> Calibration:
    """Fit by Newton steps; levels without a document get none of the weight."""
    centre, scale = x.mean(0), x.std(0) + 1e-6
    design = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    target = (level[:, None] == np.array(LEVELS)).astype(float)
    n, d, k = len(x), design.shape[1], len(LEVELS)
    weights = np.zeros((d, k))
    for _ in range(60):
        z = design @ weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = design.T @ (p - target) / n + ridge * weights
        curve = np.zeros((d * k, d * k))
        for a in range(k):
            for b in range(k):
                w = p[:, a] * ((a == b) - p[:, b])
                curve[a * d : a * d + d, b * d : b * d + d] = (design * w[:, None]).T @ design / n
        curve += ridge * np.eye(d * k)
        step = np.linalg.solve(curve, slope.T.reshape(-1)).reshape(k, d).T
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return Calibration(centre, scale, weights)


@dataclass(frozen=True)
class Model:
    grades: Grades
    calibration: Calibration | None
    params: Params

    def predict(self, texts: list[str | None]) -> list[tuple[int | None, float, int | None]]:
        """(level, share of letters in known words, level if it is English) of each text; no
        level if it isn't English, and none at all if it isn't longer than the least, or
        nothing was graded. A text without a known word is described by the average."""
        found = [tokens(t) if t and len(t) > self.params.longer_than else [] for t in texts]
        described = [self.grades.describe(f) for f in found]
        out: list[tuple[int | None, float, int | None]] = [(None, share, None) for _, share in described]
        if self.calibration is None:
            return out
        long = [k for k, f in enumerate(found) if f]
        if not long:
            return out
        x = np.array([described[k][0] if described[k][1] else self.calibration.centre for k in long])
        for k, level in zip(long, self.calibration.level(x).tolist(), strict=True):
            told = is_english(texts[k], found[k])
            english = described[k][1] >= self.params.english if told is None else told
            out[k] = (level if english else None, described[k][1], level)
        return out


def _word_counts(folds: int):
    """Partial document counts of (word, level, fold), with how many documents there are
    (word NULL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for fold, level, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count[(None, level, fold)] += 1
                count.update((w, level, fold) for w in set(tokens(text)))
        rows = list(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array(list(count.values()), pa.int64())],
            ["word", "level", "fold", "n"],
        )

    return run


def fit(documents: DataFrame, graded: DataFrame, params: Params | None = None) -> Model:
    """graded: ``(doc_id, level)``. Levels other than 1 to 4 and ids without a text are
    left out; a document graded twice takes the lower level."""
    params = params or Params()
    spark = documents.sparkSession
    labels = (
        graded.filter(F.col("level").isin(*LEVELS)).groupBy("doc_id").agg(F.min("level").cast("int").alias("level"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_labels).collect()
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    local = spark.createDataFrame([(r["doc_id"], r["level"]) for r in labels], f"doc_id {kind}, level int")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(params.folds)).cast("int").alias("fold")
    texts = saved(documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(local), "doc_id").select(fold, "level", "text"))
    counts = (
        texts.mapInArrow(_word_counts(params.folds), "word string, level int, fold int, n bigint")
        .groupBy("word", "level", "fold").agg(F.sum("n").alias("n")).toPandas()
    )
    if counts.empty:
        return Model(Grades({}), None, params)
    sizes = np.zeros((params.folds, len(LEVELS)))
    here = counts[counts.word.isna()]
    sizes[here.fold, here.level - 1] = here.n
    rest = counts[counts.word.notna()]
    codes, names = rest.word.factorize()
    per = np.zeros((params.folds, len(names), len(LEVELS)))
    per[rest.fold, codes, rest.level - 1] = rest.n

    def graded_words(table: np.ndarray, documents_: np.ndarray) -> Grades:
        kept = table.sum(1) >= params.least_docs
        return Grades(dict(zip(names[kept], grade(table[kept], documents_).tolist(), strict=True)))

    whole = per.sum(0)
    others = [graded_words(whole - per[f], sizes.sum(0) - sizes[f]) for f in range(params.folds)]
    shared = spark.sparkContext.broadcast(others)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lv, *shared.value[f].describe(tokens(t))[0]) for f, lv, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(_PLACE) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[1:]]], ["level", *_PLACE, "mean"])

    described = texts.mapInArrow(describe, "level int, " + ", ".join(f"{c} double" for c in [*_PLACE, "mean"])).toPandas()
    x, level = described[[*_PLACE, "mean"]].to_numpy(), described.level.to_numpy()
    return Model(graded_words(whole, sizes.sum(0)), calibrate(x, level, params.ridge), params)


def reading_levels(documents: DataFrame, graded: DataFrame, params: Params | None = None) -> DataFrame:
    """``(doc_id, level, known)`` of every row of ``documents``: level 1 to 4, or NULL for
    texts that are null, too short or not English; known is the share of letters
    in known words. Graded
    documents are predicted like all others, but are English whatever their text looks like.
    Without graded documents all levels are NULL."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, graded, params))
    narrow = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = model.value.predict(batch.column(1).to_pylist())
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "level", "known", "if_english"])

    found = narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, level bigint, known double, if_english bigint")
    marked = graded.filter(F.col("level").isin(*LEVELS)).select("doc_id", F.lit(True).alias("marked")).distinct()
    level = F.when(F.col("level").isNull() & F.col("marked"), F.col("if_english")).otherwise(F.col("level"))
    return found.join(marked, "doc_id", "left").select("doc_id", level.alias("level"), "known")
