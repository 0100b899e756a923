"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and the beginnings of words, each hashed into a table.
The machine adds a weight for each chosen term and, through factors, one for each pair, so that
words which are harmless alone can count together.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import byte_set, ids_of, map_arrow, mixed, slices, utf8, words

#: Words are runs of A-Z, a-z and bytes from 0x80.
NO_LETTER = ~byte_set(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
#: Lengths in bytes of the beginnings of words.
HEADS = (4, 5, 6)
TABLE = 1 << 22


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit; scoring has none.

    rows_per_class: labelled rows of either class that are fitted, those of the smallest hash.
    terms: terms kept, those whose presence tells most about the label (chi-squared).
    """

    rows_per_class: int = 3000
    terms: int = 2048
    factors: int = 8
    epochs: int = 30
    least_chi2: float = 10.0
    least_rows: int = 3


@dataclass(frozen=True)
class Model:
    """Chosen slots of the term table (sorted), weights, factors, and the constant."""

    slots: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    constant: float

    def scores(self, sums: np.ndarray, squares: np.ndarray, linear: np.ndarray) -> np.ndarray:
        logit = self.constant + linear + 0.5 * (sums**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def term_slots(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of every term of consecutive texts, with repetitions."""
    index, _, hashes = words(data, at, NO_LETTER, HEADS)
    text = np.repeat(np.arange(len(at) - 1), np.diff(index))
    slots = [(mixed(h, k) & np.uint64(TABLE - 1)).astype(np.int64) for k, h in enumerate(hashes)]
    return np.tile(text, len(slots)), np.concatenate(slots)


def fit_sample(x: np.ndarray, y: np.ndarray, limits: Limits, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, factors and constant for a 0/1 matrix, by Adam on the logistic loss.

    prior: log odds by which the classes of the sample differ from those of all labelled rows.
    """
    rng = np.random.default_rng(7)
    n, d = x.shape
    params = [np.zeros(d), rng.normal(0, 0.05, (d, limits.factors)), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(limits.epochs):
        order = rng.permutation(n)
        for low in range(0, n, 128):
            rows = order[low : low + 128]
            xb, yb = x[rows], y[rows]
            sums = xb @ params[1]
            logit = params[2][0] + xb @ params[0] + 0.5 * (sums**2 - xb @ params[1] ** 2).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - yb) / len(rows)
            grads = [
                xb.T @ g + 1e-4 * params[0],
                xb.T @ (g[:, None] * sums) - (xb.T @ g)[:, None] * params[1] + 1e-3 * params[1],
                np.array([g.sum()]),
            ]
            step += 1
            for p, grad, a, b in zip(params, grads, first, second):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad**2 - b)
                p -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return params[0], params[1], float(params[2][0] - prior)


def _bytes_of(model: Model) -> bytes:
    out = io.BytesIO()
    np.savez(out, slots=model.slots, weights=model.weights, factors=model.factors, constant=model.constant)
    return out.getvalue()


def _model_of(raw: bytes) -> Model:
    with np.load(io.BytesIO(raw)) as x:
        return Model(x["slots"], x["weights"], x["factors"], float(x["constant"]))


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """doc_id and y of the rows whose labels may be learned: crc32(doc_id) mod 3 is not 1.

    Rows without id or label are left out; a document with several labels counts as toxic if one
    of them says so.
    """
    rows = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    rows = rows.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.where(~held_out(F.col("doc_id")))


def held_out(doc_id):
    """Whether a document's label is kept for tests; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """Fit the machine to a sample of the labelled rows of at most 2 * limits.rows_per_class.

    The ids of the sample are chosen among the labels alone and are few enough to be broadcast.
    Terms are hashed where the texts lie; one task fits the bounded sample, and only the chosen
    terms and their weights come to the driver.
    """
    rows = labelled(labels, id_col, label_col)
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    key = F.xxhash64(F.col("doc_id"), F.lit(20))
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(key, "doc_id").limit(limits.rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    s0, s1 = min(n0, limits.rows_per_class), min(n1, limits.rows_per_class)
    prior = float(np.log((s1 + 0.5) / (s0 + 0.5)) - np.log((n1 + 0.5) / (n0 + 0.5)))
    empty = Model(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, limits.factors)), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    if not s0 or not s1:
        return empty

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            slots = []
            for low, high in slices(at):
                text, slot = term_slots(data, at[low : high + 1])
                pairs = np.unique(text * TABLE + slot)
                cuts = np.searchsorted(pairs, np.arange(high - low + 1) * TABLE)
                found = (pairs % TABLE).astype("<i4")
                slots += [found[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            if slots:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(slots, pa.binary())], names=["y", "slots"])

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, slots = [], []
        for batch in batches:
            y += batch.column(0).to_pylist()
            slots += [np.frombuffer(s.as_py(), "<i4") for s in batch.column(1)]
        if not y:
            return
        order = sorted(range(len(y)), key=lambda i: (y[i], slots[i].tobytes()))  # not the order of arrival
        y, slots = np.array([y[i] for i in order], float), [slots[i] for i in order]
        keep = informative(slots, y, limits)
        x = np.zeros((len(y), len(keep)), np.float64)
        for i, s in enumerate(slots):
            x[i, np.searchsorted(keep, s[np.isin(s, keep)])] = 1
        weights, factors, constant = fit_sample(x, y, limits, prior)
        yield pa.RecordBatch.from_arrays([pa.array([_bytes_of(Model(keep, weights, factors, constant))], pa.binary())], names=["model"])

    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sample = map_arrow(texts.join(F.broadcast(chosen), "doc_id").select("y", "text"), terms, "y int, slots binary")
    made = map_arrow(sample.repartition(1), train, "model binary").collect()
    return _model_of(bytes(made[0]["model"])) if made else empty


def informative(slots: list[np.ndarray], y: np.ndarray, limits: Limits) -> np.ndarray:
    """The slots whose presence depends most on the label, sorted."""
    n1, n0 = y.sum(), len(y) - y.sum()
    with_y = [np.zeros(TABLE, np.float32), np.zeros(TABLE, np.float32)]
    for s, label in zip(slots, y):
        with_y[int(label)][s] += 1
    met = np.flatnonzero(with_y[0] + with_y[1] >= limits.least_rows)
    a, b = with_y[1][met].astype(float), with_y[0][met].astype(float)
    seen = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = (n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (seen * (n0 + n1 - seen) * n1 * n0)
    chi2 = np.where(np.isfinite(chi2), chi2, 0)
    best = np.argsort(-chi2, kind="stable")[: limits.terms]
    return met[np.sort(best[chi2[best] >= limits.least_chi2])]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text.

    The score is the machine's probability for the set of the text's terms. A null or empty text
    has no terms and gets the score of the constant alone. Rows are independent: repeated rows give
    repeated results, a null id stays null, an empty table gives an empty result, and further
    columns are ignored. The model is bounded by its limits and goes to the tasks with their code;
    nothing is shuffled.
    """
    from_arrow = scorer(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(from_arrow(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return map_arrow(ids_of(docs, id_col, text_col), run, "doc_id long, score double")


def scorer(model: Model):
    """A function from a column of texts to their scores."""

    def scores(column: pa.Array) -> np.ndarray:
        place = np.full(TABLE, -1, np.int16 if len(model.slots) < 1 << 15 else np.int32)
        place[model.slots] = np.arange(len(model.slots))
        squares = model.factors**2
        data, at = utf8(column)
        out = [np.zeros(0)]
        for low, high in slices(at):
            n = high - low
            text, slot = term_slots(data, at[low : high + 1])
            term = place[slot]
            hit = term >= 0
            pairs = np.unique(text[hit] * (len(model.slots) + 1) + term[hit])
            text, term = np.divmod(pairs, len(model.slots) + 1)
            sums, squared = np.zeros((n, model.factors.shape[1])), np.zeros((n, model.factors.shape[1]))
            linear = np.zeros(n)
            np.add.at(sums, text, model.factors[term])
            np.add.at(squared, text, squares[term])
            np.add.at(linear, text, model.weights[term])
            out.append(model.scores(sums, squared, linear))
        return np.concatenate(out)

    return scores


THRESHOLD = 0.7


def predictions(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, fit(docs, labels, limits))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    scores = scorer(model)
    where = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(where)) < threshold))

    return map_arrow(docs, run, docs.schema)
