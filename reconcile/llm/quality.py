"""Quality classifier by co-training of two views of a document.

One classifier sees what the text is like, the other the record around it: source, language and
size. Both begin with the labelled documents. In each round, each labels the unlabelled ones it
is most sure of, and these join the other's training rows. In the end both are calibrated on
labelled documents that neither was trained on, and a combination of the calibrated views, fitted
there as well, scores every document.

The unlabelled documents are all of them, and stay in Spark. A round is a few passes over their
features: one counts how sure each view is of how many, which gives the margins from which on
they are labelled; the others sum up, at the weights so far, the gradient and the curvature of those
that a view was given. Which rows these are follows from the models and margins of the rounds
before, so nothing is kept for a row. What the driver gets is as large for any corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconcile.llm.batches import written
from reconcile.llm.bytes_of import _LOWER, text_bytes, text_slices, word_bounds, word_hashes
from reconcile.session import write_through

# The labelled documents that training may take, chosen by a hash of their features.
MOST_LABELLED = 20_000

ROUNDS = 5

# The share of the pool that each classifier labels in a round, and how sure it must be.
ROUND_SHARE = 0.05
SURE = 0.95

# Steps of a round towards the best weights, each with a pass over the pool.
STEPS = 1

# How sure a view is, as its margin beyond that of SURE, in steps; the last one is open.
_SURE_MARGIN, _STEP, _STEPS = float(np.log(SURE / (1 - SURE))), 0.01, 4_000

# One labelled document in so many is kept for calibration.
CALIBRATION = 5

# The share of good calibration documents that the rejection threshold may cost, at most.
MOST_LOST = 0.002

SOURCES, LANGUAGES = 32, 8

TEXT_FEATURES = 24
RECORD_FEATURES = 4 + SOURCES + LANGUAGES


def text_features(column: pa.Array) -> np.ndarray:
    """What each text is like: its characters, words and lines as counts and shares."""
    data, offsets = text_bytes(column)
    n_docs, sizes = len(offsets) - 1, np.diff(offsets).astype(np.float64)
    owner = np.repeat(np.arange(n_docs), np.diff(offsets))
    kinds = np.bincount(owner * 10 + _KIND[data], minlength=10 * n_docs).reshape(n_docs, 10)
    shares = kinds / np.maximum(sizes, 1)[:, None]
    low = _LOWER[data]
    starts, stops, first = word_bounds(_KIND[data] != 0, offsets)
    words = np.diff(first).astype(np.float64)
    of = np.repeat(np.arange(n_docs), np.diff(first))
    hashes = word_hashes(low, starts, stops)
    lengths = (stops - starts).astype(np.float64)
    some = np.maximum(words, 1)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, x, n_docs) / some

    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(n_docs)
    np.maximum.at(most, o[new], runs)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    last, begin = data[stops - 1] if len(stops) else data[:0], data[starts]
    marked = (_KIND[last] == 5) | (_KIND[last] == 6)
    lines = kinds[:, 9] + 1.0
    features = [
        np.log1p(sizes),
        np.log1p(words),
        mean(lengths),
        np.sqrt(np.maximum(mean(lengths**2) - mean(lengths) ** 2, 0)),
        np.bincount(o[new], minlength=n_docs) / some,
        most / some,
        mean(again),
        mean((lengths <= 3).astype(float)),
        mean(marked.astype(float)),
        mean((_KIND[last] == 6).astype(float)),
        mean((_KIND[begin] == 2).astype(float)),
        mean((lengths == 1).astype(float)),
        words / lines,
        np.log1p(lines),
        *shares.T,
    ]
    return np.stack(features, axis=1).astype(np.float32)


def _kinds() -> np.ndarray:
    """0 white space, 1 a-z, 2 A-Z, 3 digits, 4 other ASCII, 5 sentence marks, 6 symbols, 7 and 8 beyond, 9 newline."""
    kind = np.full(256, 4, np.int64)
    kind[[9, 11, 12, 13, 32]] = 0
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    kind[[ord(c) for c in ".,;:?\"'()-"]] = 5
    kind[[ord(c) for c in "!#$%&*|<>{}[]=~^+@\\/_`"]] = 6
    kind[128:192], kind[192:] = 7, 8
    kind[10] = 9
    return kind


_KIND = _kinds()


def record_features(n_chars: np.ndarray, source: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The record around the text. Missing values are a case of their own."""
    missing = np.isnan(n_chars)
    size = np.log1p(np.maximum(np.where(missing, 0, n_chars), 0))
    one = [source[:, None] == np.arange(SOURCES), lang[:, None] == np.arange(LANGUAGES)]
    short = size < np.log(200)
    return np.column_stack([size, size**2, missing, short, *one]).astype(np.float32)


@dataclass(frozen=True)
class Logistic:
    """Weights over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[1:] + self.weights[0]


@dataclass(frozen=True)
class Curved:
    """What further rows add to a fit: their gradient at the weights of a model, and a curvature."""

    at: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])


def fit_logistic(
    x: np.ndarray, y: np.ndarray, penalty: float = 1.0, like: Logistic | None = None, more: Curved | None = None
) -> Logistic:
    """Logistic regression by Newton's method; ``like`` gives the standardisation, ``more`` further rows."""
    x = x.astype(np.float64)
    mean, scale = (x.mean(0), x.std(0)) if like is None else (like.mean, like.scale)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = _standard(x, mean, scale)
    ridge = np.full(z.shape[1], penalty)
    ridge[0] = 1e-6
    w = np.zeros(z.shape[1]) if more is None else more.at
    for _ in range(25):
        p = _chance(z @ w)
        slope, curve = z.T @ (y - p) - ridge * w, (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        if more is not None:
            slope, curve = slope + more.gradient - more.curvature @ (w - more.at), curve + more.curvature
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


@dataclass(frozen=True)
class Model:
    """Both views, the calibration of each, their combination, and the rejection threshold.

    ``lost`` and ``kept`` are the shares of the good calibration documents that the threshold
    rejects, and of the bad ones that it does not.
    """

    text: Logistic
    record: Logistic
    calibration: tuple[Logistic, Logistic]
    combined: Logistic
    threshold: float
    lost: float = 0.0
    kept: float = 1.0

    def score(self, text: np.ndarray, record: np.ndarray) -> np.ndarray:
        return _chance(self.combined.margin(self.calibrated(text, record)))

    def calibrated(self, text: np.ndarray, record: np.ndarray) -> np.ndarray:
        margins = (self.text.margin(text), self.record.margin(record))
        views = [c.margin(m[:, None]) for c, m in zip(self.calibration, margins, strict=True)]
        return np.clip(np.column_stack(views), -12, 12)


@dataclass(frozen=True)
class Round:
    """The models of a round, and the step of sureness from which on each labels, good and bad."""

    models: tuple[Logistic, Logistic]
    steps: tuple[tuple[int, int], tuple[int, int]]


Views = tuple[np.ndarray, np.ndarray]


def _step_of(margin: np.ndarray) -> np.ndarray:
    """The step of sureness of a margin; below 0 for one that is not sure."""
    return np.minimum(np.floor((margin - _SURE_MARGIN) / _STEP), _STEPS - 1).astype(np.int64)


def _given(rounds: list[Round], views: Views) -> list[np.ndarray]:
    """The label that each view was given for each row by the other one, NaN where it was given none."""
    labels = [np.full(len(views[0]), np.nan) for _ in views]
    for r in rounds:
        for teacher in (0, 1):
            label, margin = labels[1 - teacher], r.models[teacher].margin(views[teacher])
            free = np.isnan(label)
            for value, sure, step in ((1.0, margin, r.steps[teacher][0]), (0.0, -margin, r.steps[teacher][1])):
                label[free & (_step_of(sure) >= step)] = value
    return labels


def _sureness(rounds: list[Round], models: tuple[Logistic, Logistic], views: Views) -> np.ndarray:
    """Rows by teacher, label and step of sureness that the other view was not given yet; then all rows."""
    counts = np.zeros(4 * _STEPS + 1)
    given = _given(rounds, views)
    for teacher in (0, 1):
        margin = models[teacher].margin(views[teacher])
        for i, sure in enumerate((margin, -margin)):
            step = _step_of(sure)[np.isnan(given[1 - teacher])]
            counts[(2 * teacher + i) * _STEPS :][:_STEPS] += np.bincount(step[step >= 0], minlength=_STEPS)
    counts[-1] = len(views[0])
    return counts


def _added(rounds: list[Round], models: tuple[Logistic, Logistic], views: Views) -> np.ndarray:
    """Gradient, at ``models``, and curvature of the rows that each view was given, end to end.

    The curvature is the largest that a logistic loss has anywhere, so that a step under it never
    goes too far, as it would where a row is labelled against what its view was sure of.
    """
    found = []
    for view, label in enumerate(_given(rounds, views)):
        model, rows = models[view], ~np.isnan(label)
        z = _standard(views[view][rows].astype(np.float64), model.mean, model.scale)
        found += [z.T @ (label[rows] - _chance(z @ model.weights)), (z.T @ z / 4).ravel()]
    return np.concatenate(found)


def _first_steps(counts: np.ndarray, share: float) -> tuple[tuple[int, int], tuple[int, int]]:
    """From which step on each teacher labels: as many rows as the share of the pool, or the surest step."""
    steps = []
    for teacher in (0, 1):
        for i, part in enumerate((share, 1 - share)):
            surest = np.cumsum(counts[(2 * teacher + i) * _STEPS :][:_STEPS][::-1])
            most = np.ceil(ROUND_SHARE * counts[-1] * part)
            first = _STEPS - int(np.searchsorted(surest, most, "right"))
            if first == _STEPS and surest[-1]:
                first = _STEPS - 1 - int(np.flatnonzero(surest)[0])
            steps.append(first)
    return (steps[0], steps[1]), (steps[2], steps[3])


# Sums a function of the views over all rows of the pool.
Pool = Callable[[Callable[[Views], np.ndarray]], np.ndarray]


def co_train(
    text: np.ndarray, record: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_record: np.ndarray,
    calibrates: np.ndarray, rounds: int = ROUNDS,
) -> Model:
    """``train`` with a pool of arrays."""
    return train(text, record, y, lambda of: of((pool_text, pool_record)), calibrates, rounds)


def train(text: np.ndarray, record: np.ndarray, y: np.ndarray, pool: Pool, calibrates: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Train on rows whose ``calibrates`` is false, with the pool; calibrate on the others.

    A row of the pool counts as one labelled row does where they are as many, and for less in a
    larger pool, so that the labels keep their weight at every size.
    """
    views = (text[~calibrates], record[~calibrates])
    known = y[~calibrates].astype(np.float64)
    models = tuple(fit_logistic(v, known) for v in views)
    past: list[Round] = []
    for _ in range(rounds):
        counts = pool(partial(_sureness, past, models))
        if not counts[-1]:
            break
        past.append(Round(models, _first_steps(counts, known.mean())))
        for _ in range(STEPS):
            sums, at, new = pool(partial(_added, past, models)) * min(1.0, len(known) / counts[-1]), 0, []
            for view, model in zip(views, models, strict=True):
                n = len(model.weights)
                gradient, curvature = sums[at : at + n], sums[at + n : at + n + n * n].reshape(n, n)
                new.append(fit_logistic(view, known, like=model, more=Curved(model.weights, gradient, curvature)))
                at += n + n * n
            models = tuple(new)
    held = calibrates if len(set(y[calibrates])) == 2 else np.ones(len(y), bool)
    margins = [m.margin(v[held])[:, None] for m, v in zip(models, (text, record), strict=True)]
    calibration = tuple(fit_logistic(m, y[held]) for m in margins)
    draft = Model(*models, calibration, None, 0.5)
    combined = fit_logistic(draft.calibrated(text[held], record[held]), y[held])
    score = _chance(combined.margin(draft.calibrated(text[held], record[held])))
    good, bad = score[y[held] == 1], score[y[held] == 0]
    threshold = min(0.5, float(np.quantile(good, MOST_LOST)))
    return Model(*models, calibration, combined, threshold, float((good < threshold).mean()), float((bad >= threshold).mean()))


@dataclass(frozen=True)
class Columns:
    """The columns that the classifier reads."""

    doc_id: str = "doc_id"
    text: str = "text"
    lang: str = "lang"
    source: str = "source"
    n_chars: str = "n_chars"

    def record(self) -> list[Column]:
        source = F.when(F.col(self.source).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(self.source).cast("string")), F.lit(SOURCES - 1)))
        lang = F.when(F.col(self.lang).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(self.lang).cast("string")), F.lit(LANGUAGES - 1)))
        return [F.col(self.n_chars).cast("double"), source.cast("int"), lang.cast("int")]


def fit(
    docs: DataFrame, labels: DataFrame, columns: Columns = Columns(), label_id: str = "doc_id", quality: str = "quality",
    most_labelled: int = MOST_LABELLED,
) -> Model | None:
    """Co-train on documents with a quality label, 1 for good and 0 for bad.

    Training takes at most ``most_labelled`` labelled rows, so what the driver gets of them does
    not grow, and all other documents as the pool. Labels that are null or neither 0 nor 1, and
    documents labelled both ways, are left out; of repeated documents each row counts. A document
    without an id is in the pool. Without labelled documents of both classes there is no model.
    """
    labelled = labels.select(F.col(label_id).cast("long").alias("label_id"), F.col(quality).cast("int").alias("label"))
    labelled = labelled.filter("label_id IS NOT NULL AND label IN (0, 1)")
    labelled = labelled.groupBy("label_id").agg(F.min("label").alias("y"), F.max("label").alias("most")).filter("y = most").drop("most")
    rows = docs.select(
        F.col(columns.doc_id).cast("long").alias("doc_id"),
        F.col(columns.text).cast("string").alias("text"),
        *(c.alias(n) for c, n in zip(columns.record(), ("n_chars", "source", "lang"), strict=True)),
    )
    featured = written(rows.mapInArrow(_featured, "doc_id long, features array<float>, record array<float>"), "features")
    featured = write_through(featured.join(labelled, F.col("doc_id") == F.col("label_id"), "left").drop("label_id"), "labelled")
    # The order of rows must not decide which are taken, nor between equal ones.
    order = (F.xxhash64("doc_id", "features", "record"), "doc_id")
    table = featured.filter("y IS NOT NULL").orderBy(*order).limit(most_labelled).toArrow()
    y, ids = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "doc_id"))
    if len(set(y.tolist())) < 2:
        return None
    text, record = _views(table.combine_chunks())
    calibrates = ids // 3 % CALIBRATION == 0
    if len(set(y[~calibrates].tolist())) < 2:
        calibrates[:] = False
    return train(text, record, y.astype(np.float64), _pool_of(featured.filter("y IS NULL").select("features", "record")), calibrates)


def _views(rows: pa.RecordBatch | pa.Table) -> Views:
    """Both views of rows with their features as lists."""
    found = []
    for name, n in (("features", TEXT_FEATURES), ("record", RECORD_FEATURES)):
        column = rows.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        found.append(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n))
    return found[0], found[1]


def _pool_of(rows: DataFrame) -> Pool:
    """Sums over the rows of a frame: each task sums up its own, and then the tasks' are added."""

    def summed(of: Callable[[Views], np.ndarray]) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: np.ndarray | int = 0
            for batch in batches:
                total = total + of(_views(batch))
            if isinstance(total, np.ndarray):
                place = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(total[place], pa.float64())], ["place", "value"])

        size = len(of((np.zeros((0, TEXT_FEATURES), np.float32), np.zeros((0, RECORD_FEATURES), np.float32))))
        sums = rows.mapInArrow(work, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
        total = np.zeros(size)
        for place, value in sums.collect():
            total[place] = value
        return total

    return summed


def _record_of(part: pa.RecordBatch) -> np.ndarray:
    n_chars = part.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    return record_features(n_chars, part.column("source").to_numpy(), part.column("lang").to_numpy())


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            text, record = text_features(part.column("text")), _record_of(part)
            columns = [part.column("doc_id"), pa.array(list(text), pa.list_(pa.float32())), pa.array(list(record), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "features", "record"])


def with_score(docs: DataFrame, model: Model | None, name: str = "quality_score", columns: Columns = Columns()) -> DataFrame:
    """Add the chance that a document is good. All columns are kept; ``name`` is replaced.

    A null text is scored as an empty one, and null record fields as a case of their own.
    Without a model every score is 1.
    """
    if model is None:
        return docs.withColumn(name, F.lit(1.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for arrays in parts:
            batch = pa.RecordBatch.from_arrays(list(arrays), ["text", "n_chars", "source", "lang"])
            scores = [
                shared.value.score(text_features(part.column("text")), _record_of(part))
                for part in text_slices(batch, "text")
            ]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return docs.withColumn(name, F.arrow_udf(score, "double")(F.col(columns.text).cast("string"), *columns.record()))


def keep_good(docs: DataFrame, model: Model | None, columns: Columns = Columns()) -> DataFrame:
    """The documents whose score reaches the model's threshold, with the columns they came with."""
    name = "quality_score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    scored = with_score(docs, model, name, columns)
    return scored.filter(F.col(name) >= (model.threshold if model else 0.0)).drop(name)
