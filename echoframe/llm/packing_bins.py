"""Best-fit packing by minimum bin slack.

Every document becomes its token ids and one end id.  Only what is longer than
a sequence is cut, into full pieces; the first piece takes the rest.  The
lengths 1..capacity form a histogram of at most ``capacity`` rows, whatever the
number of documents.  Minimum bin slack works on that histogram: the longest
length left opens a bin, a subset-sum dynamic program over the available
lengths (bitsets) finds the fullest feasible combination, and that combination
is removed as many times as the counts allow.

Spark plan
----------
1. One narrow pass tokenises and cuts, and numbers the pieces of each length
   within its batch; written to the shared folder.
2. Counts by (batch, length) turn those numbers into ranks among all pieces of
   a length: an exclusive running sum over batches, never over pieces, so equal
   lengths or copies cannot make one task large.
3. The plan (bounded by ``capacity``, not by the input) is shipped with the
   closure; ranks look up their sequence and offset by binary search.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

_CACHE_WORDS = 300_000
_ENCODERS: dict[str, _Encoder] = {}


def _bytes_by_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Encoder:
    """Token ids as little-endian 32-bit bytes, those of the vocabulary's file with its added tokens.

    The pre-tokenizer never joins a space that stands before a non-space character to what
    precedes it.  So a text whose spaces all stand single, between two such characters, is the
    concatenation of its space-separated parts, and the ids of a part can be kept.  Other texts,
    and those that hold an added token, are encoded whole.
    """

    def __init__(self, vocabulary: str):
        import json

        import public_tokenizers
        import tiktoken

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        with open(path, encoding="utf-8") as file:
            file = json.load(file)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        sign = _bytes_by_sign()
        ranks = {bytes(sign[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in self.added}
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special="all"), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if len(self.parts) > _CACHE_WORDS:
            self.parts.clear()
        if any(t in text for t in self.added):
            return self.whole(text)
        first, *rest = text.split(" ")
        known = self.parts
        out = [self.whole(first)]
        for part in rest:
            ids = known.get(part)
            if ids is None:
                if not part or part[0].isspace():
                    return self.whole(text)
                ids = self.whole(" " + part)
                if len(part) < 64:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)


def encoder(vocabulary: str) -> _Encoder:
    """One encoder for each vocabulary and Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = _Encoder(vocabulary)
    return _ENCODERS[vocabulary]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("batch", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())])


def _pieces(vocabulary: str, capacity: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for number, table in enumerate(tables):
            rows: list[tuple] = []
            payload: list[bytes | None] = []
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                a, piece = 0, 0
                while a < n:
                    b = a + ((n - 1) % capacity + 1 if a == 0 else capacity)
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(part)))
                    payload.append(part if keep_ids else None)
                    a, piece = b, piece + 1
            if not rows:
                continue
            columns = list(zip(*rows, strict=True))
            lengths = np.array(columns[3])
            order = np.argsort(lengths, kind="stable")
            ranked = lengths[order]
            first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            at = np.arange(len(ranked))
            nth = np.empty(len(ranked), np.int64)
            nth[order] = at - np.maximum.accumulate(np.where(first, at, 0))
            batch = TaskContext.get().partitionId() << 32 | number  # alike whenever the task runs again
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=False)), pa.array([batch] * len(rows), pa.int64()), pa.array(nth), pa.array(payload, pa.binary())], schema=_PIECES)

    return run


def fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``; long lengths first among equals.

    Subset sums are bits of an integer; counts are split into powers of two, so each length costs
    a logarithmic number of shifts.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(left, reverse=True):
        if length > room:
            continue
        count, times = min(left[length], room // length), 1
        while count > 0:
            take = min(times, count)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            count, times = count - take, 2 * times
        if reach >> room:
            break
    target = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + take
            target -= length * take
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as (combination of (length, times), number of equal bins), for counts by length."""
    left = {k: v for k, v in histogram.items() if v}
    plan = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        combination = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        combination[longest] = combination.get(longest, 0) + 1
        bins = min(left[k] // v for k, v in combination.items())
        plan.append((sorted(combination.items(), reverse=True), bins))
        for k, v in combination.items():
            left[k] -= v * bins
            if not left[k]:
                del left[k]
    return plan


def _slots(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, pieces a bin, first sequence, offset in the bin), ordered by rank."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for combination, bins in plan:
        offset = 0
        for length, times in combination:
            out.setdefault(length, []).append((taken.get(length, 0), times, sequence, offset))
            taken[length] = taken.get(length, 0) + times * bins
            offset += length * times
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _place(slots: dict[int, np.ndarray]) -> Callable:
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            lengths, ranks = table.column("length").to_numpy(), table.column("rank").to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                rows = slots[int(length)]
                row = rows[np.searchsorted(rows[:, 0], ranks[here], side="right") - 1]
                within = ranks[here] - row[:, 0]
                sequence[here] = row[:, 2] + within // row[:, 1]
                offset[here] = row[:, 3] + within % row[:, 1] * length
            names = [n for n in table.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(table.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, *, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with
    ``keep_ids``, ids (little-endian unsigned 32-bit).  Sequences have no gaps.  ``vocabulary`` is a
    byte-level vocabulary, by name among the public tokenizers or by absolute path on every executor;
    ids are those of tokenizers with add_special_tokens=False, so an added token's string is one id.

    A null text is empty: one piece, the end id.  A null doc_id stays null.  Repeated rows are packed
    each.  Other columns are ignored.  An empty table gives no rows.  A text is encoded in one task;
    its pieces are then independent rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "pack")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, batch long, nth long, ids binary"
    pieces = work.table("pieces", docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, capacity, end_id, keep_ids), schema))
    counts = work.table("counts", pieces.groupBy("batch", "length").count())
    plan = minimum_bin_slack({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}, capacity)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("batch", "length", before.alias("before")), ["batch", "length"])
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    out = ranked.select(*kept, (F.col("before") + F.col("nth")).alias("rank"))
    return out.mapInArrow(_place(_slots(plan)), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema if f.name != "rank") + ", sequence_id long, offset long")
