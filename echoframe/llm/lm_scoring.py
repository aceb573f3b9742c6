"""LM scoring by deleted interpolation.

Trigram, bigram and unigram maximum-likelihood estimates are mixed with
weights that depend on how often the two contexts were seen.  The weights of
each context-frequency bucket are learned by expectation-maximisation on
counts that were held out of the estimates.

Spark plan
----------
1. Documents are packed into chunks of bounded size (one narrow pass, written
   to the shared folder), each chunk of one class: unseen, held out for the
   weights, or retained.
2. Every chunk sends its distinct n-gram keys with counts to ranges of the hash
   space: one exchange of compact blobs, pre-aggregated in the chunk.
3. Every range adds up the counts and answers each chunk in the order of its
   keys, with counts alone.
4. Chunks meet their answers and score their tokens.  The weights come from
   the same step over the held-out chunks, as a histogram of bounded size.

No key, document or source can be hot: work is dealt by hash range and chunk.
The n-gram tables are never gathered in one place or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import U, chain, distinct, lower_utf8, mix, pack, pack_sorted, ranges, unpack, unpack_sorted, word_hashes
from .store import Workspace

UNSEEN, HELD, RETAINED = 0, 1, 2
_END, _BEGIN = U(0x5EED0E4D), U(0x5EEDBE61)
#: Context-frequency buckets: log2 classes of the bigram context and of the unigram context.
_B2, _B1 = 8, 16
#: Likelihood-ratio bins of the held-out histogram, half an octave each; bin 0 is a ratio of zero.
_BINS, _MID = 64, 20


class _Chunk:
    """The tokens of a chunk as hashed n-gram keys, with the place of each document."""

    def __init__(self, blob: bytes, sizes: np.ndarray, bits: int):
        text = zstandard.ZstdDecompressor().decompress(blob) if blob else b""
        hashes, starts = word_hashes(text)
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        words = np.diff(np.searchsorted(starts, offsets))
        self.lengths = words + 1
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        last = self.first + words
        token = np.empty(len(hashes) + len(sizes), U)
        rest = np.ones(len(token), bool)
        rest[last] = False
        token[rest], token[last] = hashes, mix(np.array([_END], U))[0]
        one = np.empty_like(token)
        one[1:] = token[:-1]
        one[self.first] = _BEGIN
        two = np.empty_like(token)
        two[1:] = one[:-1]
        two[self.first] = _BEGIN
        with np.errstate(over="ignore"):
            self.keys = [token, chain(one, token) >> U(64 - bits), chain(two, one, token) >> U(64 - bits)]
        self.bits = [64, bits, bits]

    def answered(self, answers: list[list[bytes]]) -> list[np.ndarray]:
        """Counts at every token, from the answers of all ranges in order."""
        out = []
        for keys, blobs in zip(self.keys, answers, strict=True):
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            index = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
            counts = np.concatenate([unpack(b) for b in blobs])
            at = np.empty(len(keys), np.float64)
            at[order] = counts[index]
            out.append(at)
        return out


def _chunks(limit: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        weight = dict.fromkeys((UNSEEN, HELD, RETAINED), 0)

        def row(kind: int) -> pa.RecordBatch:
            ids, sizes, texts = held.pop(kind)
            weight[kind] = 0
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(t + b"\n" for t in texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["kind", "ids", "sizes", "texts"],
            )

        for table in tables:
            for doc_id, kind, text in zip(*(table.column(n) for n in ("doc_id", "kind", "text")), strict=True):
                kind, text = kind.as_py(), lower_utf8(text.as_py())
                ids, sizes, texts = held.setdefault(kind, ([], [], []))
                ids.append(doc_id.as_py())
                sizes.append(len(text))
                texts.append(text)
                weight[kind] += len(text) + 16
                if weight[kind] >= limit:
                    yield row(kind)
        for kind in sorted(held):
            yield row(kind)

    return run


def _requests(parts: int, bits: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for r in table.to_pylist():
                chunk = _Chunk(r["texts"], np.array(r["sizes"], np.int64), bits)
                columns: dict[str, list] = {"part": list(range(parts)), "chunk": [r["chunk"]] * parts, "kind": [r["kind"]] * parts}
                for n, (keys, width) in enumerate(zip(chunk.keys, chunk.bits, strict=True), 1):
                    keys, counts = distinct(keys)
                    cut = ranges(keys, width, parts)
                    columns[f"k{n}"] = [pack_sorted(keys[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                    columns[f"c{n}"] = [pack(counts[a:b]) if r["kind"] else b"" for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_pydict(columns, schema=_REQUEST)

    return run


_REQUEST = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), *((f"{x}{n}", pa.binary()) for n in (1, 2, 3) for x in "kc")])
_REQUEST_SQL = "part int, chunk long, kind int, " + ", ".join(f"{x}{n} binary" for n in (1, 2, 3) for x in "kc")
_ANSWER = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), *((f"{x}{n}", pa.binary()) for n in (1, 2, 3) for x in "ar"), ("types", pa.int64()), ("tokens", pa.int64()), ("kept_tokens", pa.int64())])
_ANSWER_SQL = "chunk long, kind int, part int, " + ", ".join(f"{x}{n} binary" for n in (1, 2, 3) for x in "ar") + ", types long, tokens long, kept_tokens long"


def _add_up(table: pa.Table) -> pa.Table:
    """All requests of one range: total counts, and the counts of retained documents for those held out."""
    chunks, kinds = table.column("chunk").to_pylist(), table.column("kind").to_pylist()
    n_rows = len(chunks)
    part = table.column("part")[0].as_py()
    out: dict[str, list] = {"chunk": [*chunks, -1], "kind": [*kinds, -1], "part": [part] * (n_rows + 1)}
    stats = [0, 0, 0]
    for n in (1, 2, 3):
        keys = [unpack_sorted(x.as_py()) for x in table.column(f"k{n}")]
        known = distinct(np.concatenate(keys))[0]
        places = [np.searchsorted(known, k).astype(np.int32) for k in keys]
        del keys
        total, kept = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        for place, kind, blob in zip(places, kinds, table.column(f"c{n}"), strict=True):
            if kind != UNSEEN:
                counts = unpack(blob.as_py()).astype(np.int64)
                total[place] += counts
                if kind == RETAINED:
                    kept[place] += counts
        out[f"a{n}"] = [*(pack(total[p]) for p in places), b""]
        out[f"r{n}"] = [*(pack(kept[p]) if kind == HELD else b"" for p, kind in zip(places, kinds, strict=True)), b""]
        if n == 1:
            stats = [int((total > 0).sum()), int(total.sum()), int(kept.sum())]
    for name, value in zip(("types", "tokens", "kept_tokens"), stats, strict=True):
        out[name] = [0] * n_rows + [value]
    return pa.Table.from_pydict(out, schema=_ANSWER)


def _estimates(chunk: _Chunk, counts: list[np.ndarray], docs: int, base: np.ndarray):
    """Ratios of the trigram and bigram estimates to ``base``, and the bucket of every token."""
    c1, c2, c3 = counts
    first = chunk.first
    ctx1, ctx2 = np.empty_like(c1), np.empty_like(c1)
    ctx1[1:], ctx2[1:] = c1[:-1], c2[:-1]
    ctx1[first] = ctx2[first] = docs
    f2 = np.divide(c2, ctx1, out=np.zeros_like(c1), where=ctx1 > 0)
    f3 = np.divide(c3, ctx2, out=np.zeros_like(c1), where=ctx2 > 0)
    level = lambda c, most: np.minimum(np.log2(c + 1).astype(np.int64), most - 1)
    return np.minimum(f3, 1) / base, np.minimum(f2, 1) / base, level(ctx2, _B2) * _B1 + level(ctx1, _B1)


def _bin(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        at = np.rint(2 * np.log2(ratio)) + _MID
    return np.where(ratio > 0, np.clip(at, 1, _BINS - 1), 0).astype(np.int64)


def _joined(left: pa.Table, right: pa.Table, bits: int, prefix: str) -> Iterator[tuple[dict, _Chunk, list]]:
    """The chunk of a co-group with its counts; answers are ordered by range."""
    answers = sorted(right.select(["part", *(f"{prefix}{n}" for n in (1, 2, 3))]).to_pylist(), key=lambda r: r["part"])
    for r in left.to_pylist():
        chunk = _Chunk(r["texts"], np.array(r["sizes"], np.int64), bits)
        yield r, chunk, chunk.answered([[a[f"{prefix}{n}"] for a in answers] for n in (1, 2, 3)])


def _held_out_cells(bits: int, tokens: int, types: int, docs: int):
    schema = pa.schema([("cell", pa.int64()), ("n", pa.float64()), ("x", pa.float64()), ("y", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros((3, _B2 * _B1 * _BINS * _BINS))
        for _, chunk, counts in _joined(left, right, bits, "r"):
            x, y, bucket = _estimates(chunk, counts, docs, (counts[0] + 0.1) / (tokens + 0.1 * (types + 1)))
            cell = (bucket * _BINS + _bin(x)) * _BINS + _bin(y)
            for row, weights in zip(total, (None, x, y), strict=True):
                row += np.bincount(cell, weights, minlength=total.shape[1])
        at = np.flatnonzero(total[0])
        return pa.Table.from_arrays([pa.array(at), *(pa.array(row[at]) for row in total)], schema=schema)

    return run


def learn_weights(cells: np.ndarray, rounds: int = 60, prior: float = 10.0) -> np.ndarray:
    """Mixture weights [bucket, (trigram, bigram, unigram)] by expectation-maximisation.

    cells: rows (bucket, tokens, mean trigram ratio, mean bigram ratio), ratios to the unigram
    estimate.  A bucket leans on ``prior`` tokens' worth of the weights learned over all buckets.
    """

    def em(n: np.ndarray, values: np.ndarray, bucket: np.ndarray, lean: np.ndarray, size: int) -> np.ndarray:
        weights = np.tile(np.full(3, 1 / 3), (size, 1))
        for _ in range(rounds):
            share = weights[bucket] * values
            share *= (n / share.sum(1))[:, None]
            got = np.stack([np.bincount(bucket, share[:, k], minlength=size) for k in range(3)], 1) + lean
            weights = got / got.sum(1, keepdims=True)
        return weights

    size = _B2 * _B1
    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (size, 1))
    bucket, n = cells[:, 0].astype(np.int64), cells[:, 1]
    values = np.column_stack([cells[:, 2], cells[:, 3], np.ones(len(cells))])
    pooled = em(n, values, np.zeros(len(n), np.int64), np.zeros(3) + 1e-9, 1)[0]
    return em(n, values, bucket, prior * pooled + 1e-9, size)


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(bits: int, tokens: int, types: int, docs: int, weights: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        done = []
        for r, chunk, counts in _joined(left, right, bits, "a"):
            base = (counts[0] + 0.1) / (tokens + 0.1 * (types + 1))
            x, y, bucket = _estimates(chunk, counts, docs, base)
            w = weights[bucket]
            gain = np.log10(w[:, 0] * x + w[:, 1] * y + w[:, 2])
            base = np.log10(base)
            add = lambda v: np.add.reduceat(v, chunk.first)
            n = len(chunk.first)
            done.append(pa.Table.from_arrays([pa.array(r["ids"], pa.int64()), pa.array([r["kind"] == UNSEEN] * n), pa.array(chunk.lengths), pa.array(add((counts[0] > 0).astype(np.int64))), pa.array([tokens] * n, pa.int64()), pa.array(add(base)), pa.array(add(base) + add(gain))], schema=_SCORES))
        return pa.concat_tables(done) if done else _SCORES.empty_table()

    return run


def score_documents(docs: DataFrame, *, folds: int = 10, test_fold: int = 0, weight_fold: int = 1, chunk_bytes: int = 6 << 20, range_bytes: int = 16 << 20) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) with a trigram model of the other folds.

    A document's fold is crc32(doc_id as text) mod ``folds``.  Fold ``test_fold`` is never learned
    from; ``weight_fold`` is held out of the estimates while the mixture weights are learned, and
    counts in the final estimates.  Results: doc_id, held_out, n_tokens (words and one end),
    n_known, train_tokens, base_score, score (both log10).

    Null or blank texts hold the end token only.  A null doc_id belongs to ``test_fold``.  Repeated
    rows are scored and counted each.  Other columns of ``docs`` are ignored.  An empty table gives
    no rows; without training documents every estimate is the unigram floor.
    Bigrams and trigrams are told apart by hashes of 48 bits or more, growing with the input so
    that fewer than one lookup in 2^20 meets another n-gram's count; words by 64 bits.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lm")
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    kind = F.when(fold.isNull() | (fold == test_fold), UNSEEN).when(fold == weight_fold, HELD).otherwise(RETAINED)
    source = docs.select(F.col("doc_id").cast("long"), kind.alias("kind"), F.col("text"))
    packed = source.mapInArrow(_chunks(chunk_bytes), "kind int, ids array<long>, sizes array<long>, texts binary")
    chunks = work.table("chunks", packed.withColumn("chunk", F.monotonically_increasing_id()))
    size = chunks.select("kind", F.size("ids").alias("d"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("b")).groupBy("kind").agg(F.sum("d"), F.sum("b")).collect()
    rows, total = {r[0]: r[1] for r in size}, sum(r[2] for r in size)
    parts = max(12, total // range_bytes)
    bits = min(64, max(48, (total // 4).bit_length() + 21))

    asked = chunks.mapInArrow(_requests(parts, bits), _REQUEST_SQL)
    answers = work.table("answers", asked.groupBy("part").applyInArrow(_add_up, _ANSWER_SQL))
    types, tokens, kept = (x or 0 for x in answers.filter("chunk = -1").agg(F.sum("types"), F.sum("tokens"), F.sum("kept_tokens")).first())

    def met(test, f, schema: str, *columns: str) -> DataFrame:
        a = chunks.filter(test).groupBy("chunk")
        b = answers.filter(test & (F.col("chunk") >= 0)).select("chunk", "part", *columns).groupBy("chunk")
        return a.cogroup(b).applyInArrow(f, schema)

    cells = met(F.col("kind") == HELD, _held_out_cells(bits, kept, types, rows.get(RETAINED, 0)), "cell long, n double, x double, y double", "r1", "r2", "r3")
    got = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).toPandas().to_numpy(np.float64)
    weights = learn_weights(np.column_stack([got[:, 0] // (_BINS * _BINS), got[:, 1], got[:, 2] / got[:, 1], got[:, 3] / got[:, 1]]))
    final = _scores(bits, tokens, types, rows.get(RETAINED, 0) + rows.get(HELD, 0), weights)
    return met(F.lit(True), final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", "a1", "a2", "a3")
