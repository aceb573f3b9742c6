"""Language identification by multilingual mixture inference.

Every language has a distribution over hashed character trigrams.  A document
is a mixture: expectation-maximisation estimates the proportions of its
languages from the trigram likelihoods.  The set of languages is chosen by
penalised likelihood among all nested sets that follow from the proportions of
all learned languages: a further language must raise the log likelihood by more
than the penalty.  The prediction is the largest proportion in that set.

Spark plan
----------
Training sums trigram counts per (language, cell) with one exchange after
in-task aggregation, and packs them into one array for each language; the model
has languages x cells numbers, whatever the corpus, and is checked against
``most_model_bytes`` before it is fetched and broadcast.
Prediction is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import U, mix

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: is it a letter?"""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(text: str | None, bits: int) -> np.ndarray:
    """Hash cells of the letter trigrams of the lower-cased text; runs of other characters are one gap."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, 0)
    codes = codes[letter | np.concatenate([[True], letter[:-1]])]
    codes = np.concatenate([[0], codes, [0, 0]]).astype(U)
    keys = codes[:-2] | codes[1:-1] << U(21) | codes[2:] << U(42)
    keys = keys[codes[1:-1] > 0]  # a trigram for each letter, at its centre
    return (mix(keys) >> U(64 - bits)).astype(np.int64)


def _train(bits: int):
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for table in tables:
            for lang, text in zip(table.column("lang").to_pylist(), table.column("text"), strict=True):
                total = totals.setdefault(lang, np.zeros(1 << bits, np.int64))
                total += np.bincount(trigrams(text.as_py(), bits), minlength=1 << bits)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], schema=schema)

    return run


def _blobs(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        blobs = [[np.asarray(x.values, kind).tobytes() for x in table.column(name)] for name, kind in (("at", np.int32), ("n", np.int64))]
        yield pa.RecordBatch.from_arrays([table.column("lang"), *(pa.array(b, pa.binary()) for b in blobs)], names=["lang", "at", "n"])


class Mixture:
    """Trigram log likelihoods of the languages, [cell, language]."""

    def __init__(self, names: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.names = names
        total = counts.sum(1, keepdims=True)
        self.likelihood = ((counts + smoothing) / (total + smoothing * counts.shape[1])).T.copy()

    def proportions(self, p: np.ndarray, n: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation from likelihoods p [cell, language], and the log likelihood."""
        weights = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(rounds if p.shape[1] > 1 else 1):
            mixed = p @ weights
            new = weights * (p.T @ (n / mixed)) / n.sum()
            done = np.abs(new - weights).max() < 1e-4
            weights = new
            if done:
                break
        return weights, float(n @ np.log(p @ weights))

    def infer(self, cells: np.ndarray, penalty: float) -> list[tuple[str, float]]:
        """The chosen languages with their proportions, largest first."""
        if not len(cells) or not self.names:
            return []
        counts = np.bincount(cells)
        at = np.flatnonzero(counts)
        n, p = counts[at].astype(np.float64), self.likelihood[at]
        weights, _ = self.proportions(p, n)
        order = np.argsort(-weights, kind="stable")
        best, chosen = -np.inf, None
        for size in range(1, len(order) + 1):
            got, likelihood = self.proportions(p[:, order[:size]], n)
            value = likelihood - penalty * size * np.log(n.sum() + 1)
            if value > best:
                best, chosen = value, (order[:size], got)
            elif penalty * (size + 1) * np.log(n.sum() + 1) >= -best:
                break  # a log likelihood is at most 0, so no larger set can do better
        names, got = chosen
        rank = sorted(range(len(names)), key=lambda k: (-got[k], self.names[names[k]]))
        return [(self.names[names[k]], float(got[k])) for k in rank]


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))])


def _predict(shared, bits: int, penalty: float):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for table in tables:
            found = [model.infer(trigrams(t.as_py(), bits), penalty) for t in table.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id"),
                    pa.array([f[0][0] if f else "und" for f in found], pa.string()),
                    pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                    pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[x for _, x in f] for f in found], pa.list_(pa.float64())),
                ],
                schema=_PREDICTED,
            )

    return run


def identify_languages(docs: DataFrame, training: DataFrame, *, bits: int = 15, penalty: float = 4.0, most_model_bytes: int = 256 << 20) -> DataFrame:
    """Predict the languages of every row of ``docs`` (doc_id, text) from ``training`` (text, lang).

    Results: doc_id, lang_pred, score (the proportion of lang_pred), langs and proportions (the
    chosen set, largest first).

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing
    was learned; rows of ``training`` with a null text or lang are ignored.  Equal proportions go by
    name.  Repeated rows count and are answered each.  Other columns are ignored.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = training.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_train(bits), "lang string, cell int, n long")
    counts = rows.groupBy("lang", "cell").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    names = sorted(r[0] for r in training.filter("lang is not null and text is not null").select("lang").distinct().limit(1 + most_model_bytes // (8 << bits)).collect())
    if len(names) * (8 << bits) > most_model_bytes:
        raise ValueError(f"a model of more than {most_model_bytes} bytes; use fewer bits")
    table = np.zeros((len(names), 1 << bits))
    place = {x: k for k, x in enumerate(names)}
    packed = counts.select("lang", F.col("cells.cell").alias("at"), F.col("cells.n").alias("n")).mapInArrow(_blobs, "lang string, at binary, n binary")
    for r in packed.collect():  # a row for each language, languages x cells numbers at most, as checked
        table[place[r.lang], np.frombuffer(r.at, np.int32)] = np.frombuffer(r.n, np.int64)
    shared = spark.sparkContext.broadcast(Mixture(names, table))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predict(shared, bits, penalty), "doc_id long, lang_pred string, score double, langs array<string>, proportions array<double>")
