"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are estimated: one of target text
(labelled good and not toxic), one of raw text (all documents).  n-grams are
words, signs and their pairs; a word that follows itself is a pair of its own,
by the length of the run.  A document's log weight is the sum over its n-grams
of the log ratio of the two, and documents are drawn without replacement by
Gumbel top-k: the k largest of log weight + standard Gumbel noise.

An n-gram's chance is the share of documents that hold it, so a text that says
one thing often is one witness.  Chance differences of rare n-grams would swamp
long texts; so a log ratio shrinks by 1 - shrink / z^2 (positive-part
James-Stein), where z is the difference of the two models in standard
deviations, and the sum over a text of n words is divided by sqrt(n / 100) if it
has over 100.  A document is weighed without its own counts in either model, so
labelled and other documents are treated alike.

k is a parameter, or follows from ``recall``: the number of documents whose key
is at least the (1 - recall) quantile of the keys of labelled target documents.

Spark plan
----------
Labels are a bounded sample (``most_labels`` rows by hash), shipped to the
tasks.  Counts of all documents are summed per task into vectors of fixed
length and added up in two exchanges of compact blobs; the model has a fixed
size and is broadcast.  Texts are never exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import BY_SIGNS, U, chain, distinct, lower_utf8, mix, pack, pack_sorted, unpack, unpack_sorted, word_hashes
from .store import Workspace, small_batches

_PARTS = 16
_KINDS = ("words", "pairs")


def grams(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash cells of the words and of the pairs of a text; where a word follows itself, the pair is the
    length of the run so far in powers of two, up to 8, whatever the word."""
    h, _ = word_hashes(lower_utf8(text), BY_SIGNS)
    pairs = chain(h[:-1], h[1:]) if len(h) > 1 else h[:0]
    if len(pairs):
        at = np.arange(len(pairs))
        run = at - np.maximum.accumulate(np.where(h[1:] != h[:-1], at, -1))
        again = mix(np.minimum(np.log2(np.maximum(run, 1)), 3).astype(U) + U(1))
        pairs = np.where(run > 0, again, pairs)
    return (h >> U(64 - bits)).astype(np.int64), (pairs >> U(64 - bits)).astype(np.int64)


class Labels:
    """Sorted ids of labelled documents, each target or not."""

    def __init__(self, ids: np.ndarray, target: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.target = ids[order], target[order]

    def of(self, doc_id: int | None) -> bool | None:
        at = np.searchsorted(self.ids, doc_id) if doc_id is not None else len(self.ids)
        return bool(self.target[at]) if at < len(self.ids) and self.ids[at] == doc_id else None


_COUNTS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("cells", pa.binary()), ("raw", pa.binary()), ("target", pa.binary())])
_COUNTS_SQL = "kind int, part int, cells binary, raw binary, target binary"


def _blobs(kind: int, part: int, cells: np.ndarray, raw: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    row = (kind, part, pack_sorted(cells.astype(U)), pack(raw), pack(target))
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _COUNTS, strict=True)], schema=_COUNTS)


def _count(shared, bits: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, size = shared.value, 1 << bits
        raw = [np.zeros(size, np.int64) for _ in _KINDS]
        target = [np.zeros(size, np.int64) for _ in _KINDS]
        for table in tables:
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text"), strict=True):
                good = labels.of(doc_id)
                for k, cells in enumerate(grams(text.as_py(), bits)):
                    cell, _ = distinct(cells)
                    raw[k][cell] += 1
                    if good:
                        target[k][cell] += 1
        step = size // _PARTS
        for k in range(len(_KINDS)):
            for part in range(_PARTS):
                at = np.flatnonzero(raw[k][part * step : (part + 1) * step]) + part * step
                if len(at):
                    yield _blobs(k, part, at, raw[k][at], target[k][at])

    return run


def _sum_counts(bits: int):
    def run(table: pa.Table) -> pa.Table:
        size = 1 << bits
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r in table.select(["cells", "raw", "target"]).to_pylist():
            at = unpack_sorted(r["cells"]).astype(np.int64)
            raw[at] += unpack(r["raw"]).astype(np.int64)
            target[at] += unpack(r["target"]).astype(np.int64)
        at = np.flatnonzero(raw)
        return pa.Table.from_batches([_blobs(table.column("kind")[0].as_py(), table.column("part")[0].as_py(), at, raw[at], target[at])])

    return run


class Model:
    """Documents with each n-gram of one kind, and the log ratios they give."""

    def __init__(self, raw: np.ndarray, target: np.ndarray, share: float, pseudo: float, shrink: float):
        self.raw, self.target, self.share, self.pseudo, self.shrink = raw.astype(np.float32), target.astype(np.float32), share, pseudo, shrink

    def ratio(self, target: np.ndarray, raw: np.ndarray) -> np.ndarray:
        mean = self.share * raw
        z2 = np.square(target - mean) / (mean * (1 - min(self.share, 0.9)) + 1)
        return np.maximum(0, 1 - self.shrink / np.maximum(z2, 1e-9)) * np.log((target + self.pseudo) / (mean + self.pseudo))

    def weight(self, cells: np.ndarray, good: bool) -> float:
        """The log weight of a document, without its own counts in the models."""
        cell, n = distinct(cells)
        return float((n * self.ratio(self.target[cell] - good, self.raw[cell] - 1)).sum())


def usual_share(raw: np.ndarray, target: np.ndarray) -> float:
    """The target's share of the documents with a word: the median over all of them, which neither junk nor rare words move."""
    some = raw > 0
    share = target[some] / raw[some]
    order = np.argsort(share)
    weight = np.cumsum(raw[some][order])
    return (float(share[order][np.searchsorted(weight, weight[-1] / 2)]) if len(weight) else 0.0) or float(target.sum()) / max(1.0, float(raw.sum()))


def gumbel(doc_id: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise that depends on the id and the seed only."""
    u = (mix(doc_id.astype(np.int64).view(U) ^ mix(np.array([seed], U))[0]) >> U(11)).astype(np.float64) + 0.5
    return -np.log(-np.log(u / (1 << 53)))


_SCORED = pa.schema([("doc_id", pa.int64()), ("label", pa.bool_()), ("log_weight", pa.float64()), ("key", pa.float64())])


def _weigh(models: list[Model], cells: tuple[np.ndarray, np.ndarray], own: bool) -> float:
    """The log weight: the sum over both kinds of n-gram, tempered beyond 100 words."""
    return sum(m.weight(c, own) for m, c in zip(models, cells, strict=True)) / max(1.0, len(cells[0]) / 100) ** 0.5


def _score(shared_labels, shared_models, bits: int, seed: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, models = shared_labels.value, shared_models.value
        for table in tables:
            ids = table.column("doc_id").to_pylist()
            good = [labels.of(i) for i in ids]
            weights = np.array([_weigh(models, grams(t.as_py(), bits), bool(own)) for own, t in zip(good, table.column("text"), strict=True)], np.float64)
            noise = gumbel(np.array([-1 if i is None else i for i in ids], np.int64), seed)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(good, pa.bool_()), pa.array(weights), pa.array(weights + noise)], schema=_SCORED)

    return run


class Resampler:
    """Importance weights of documents against ``labels`` (doc_id, quality, toxic)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, *, bits: int = 20, pseudo: float = 0.5, shrink: float = 4.0, seed: int = 17, most_labels: int = 50_000):
        spark = docs.sparkSession
        self.bits, self.seed = bits, seed
        sample = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"), F.max("toxic").alias("toxic"))
        got = sample.select("doc_id", (F.col("good") & (F.col("toxic") == 0)).alias("target")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).toPandas()
        self.labels = spark.sparkContext.broadcast(Labels(got["doc_id"].to_numpy(np.int64), got["target"].to_numpy(bool)))
        counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count(self.labels, bits), _COUNTS_SQL)
        some = counted.withColumn("salt", F.spark_partition_id() % 32).groupBy("kind", "part", "salt").applyInArrow(_sum_counts(bits), _COUNTS_SQL)
        total = np.zeros((2, len(_KINDS), 1 << bits))
        for r in some.groupBy("kind", "part").applyInArrow(_sum_counts(bits), _COUNTS_SQL).collect():  # 32 blobs of fixed length
            at = unpack_sorted(r.cells).astype(np.int64)
            total[0, r.kind, at], total[1, r.kind, at] = unpack(r.raw), unpack(r.target)
        share = usual_share(total[0, 0], total[1, 0])
        self.models = spark.sparkContext.broadcast([Model(total[0, k], total[1, k], share, pseudo, shrink) for k in range(len(_KINDS))])

    def release(self) -> None:
        """Frees the models on the executors; call it when what score() returned was written."""
        self.labels.destroy()
        self.models.destroy()

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, label (in the sample: target or not), log_weight and key."""
        source = docs.select(F.col("doc_id").cast("long"), "text")
        return source.mapInArrow(_score(self.labels, self.models, self.bits, self.seed), "doc_id long, label boolean, log_weight double, key double")

    def weighed(self, docs: DataFrame) -> DataFrame:
        """Every row of ``docs`` whole, as ``row``, with its label and key; only doc_id and text go through Python."""
        score = _score(self.labels, self.models, self.bits, self.seed)

        @F.arrow_udf("struct<label: boolean, key: double>")
        def weigh(doc_id: pa.Array, text: pa.Array) -> pa.Array:
            (scored,) = score([pa.RecordBatch.from_arrays([doc_id, text], names=["doc_id", "text"])])
            return pa.StructArray.from_arrays([scored.column("label"), scored.column("key")], names=["label", "key"])

        out = docs.select(F.struct("*").alias("row"), weigh(F.col("doc_id").cast("long"), F.col("text")).alias("weight"))
        return out.select("row", "weight.label", "weight.key")


def kth_key(keys: DataFrame, k: int, cells: int = 4096) -> float:
    """The k-th largest value of ``key``: its interval is cut into ``cells`` until it holds one value.

    Each round is one aggregation into at most ``cells`` rows, so memory does not grow with k.
    """
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not 1 <= k <= n:
        raise ValueError(f"k must be between 1 and {n}")
    while low < high:
        width = (high - low) / cells
        cell = F.least(F.floor((F.col("key") - low) / width), F.lit(cells - 1)) if low + width > low else F.when(F.col("key") >= high, 1).otherwise(0)
        rows = keys.filter((F.col("key") >= low) & (F.col("key") <= high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        for r in sorted(rows, key=lambda r: -r.cell):
            if k <= r.n:
                low, high = r.a, r.b
                break
            k -= r.n
    return high


def resample(docs: DataFrame, labels: DataFrame, *, recall: float = 0.985, k: int | None = None, **options) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with doc_id, log_weight, key and selected.

    ``labels``: doc_id, quality, toxic; of repeated labels the worst counts, null ones are ignored,
    and at most ``most_labels`` are used.  Without target labels every weight is one, and every row
    is selected.  Selected are the k largest keys and all equal to the least of them.

    Null and blank texts have weight one (log 0).  Repeated rows are weighed and drawn each, with
    the same noise.  A null doc_id has no label.  Other columns are ignored.  An empty table gives
    no rows.
    """
    work = Workspace(docs.sparkSession, "resample")
    sampler = Resampler(docs, labels, **options)
    scored = work.table("scored", sampler.score(docs))
    sampler.release()
    return scored.select("doc_id", "log_weight", "key", (F.col("key") >= F.lit(_cut(scored, recall, k))).alias("selected"))


def _cut(scored: DataFrame, recall: float, k: int | None) -> float:
    if k is not None:
        n = scored.count()
        return float("inf") if k <= 0 or not n else kth_key(scored, min(k, n))
    cut = scored.filter("label").agg(F.percentile("key", F.lit(1 - recall))).first()[0]
    return float("-inf") if cut is None else cut


def keep_selected(docs: DataFrame, labels: DataFrame, *, recall: float = 0.985, k: int | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that resample() selects, all columns kept (any name is free).

    Texts are weighed once: the rows are written with their keys and read again from the cut on.  Nulls,
    blank texts, repeated rows, ties and empty tables are as in resample().
    """
    work = Workspace(docs.sparkSession, "resample")
    with small_batches(docs.sparkSession):
        sampler = Resampler(docs, labels, **options)
        weighed = work.table("weighed", sampler.weighed(docs))
    sampler.release()
    cut = _cut(weighed, recall, k)
    return weighed.filter(F.col("key") >= F.lit(cut)).select("row.*")
