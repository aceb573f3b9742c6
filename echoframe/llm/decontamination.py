"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive benchmark words.  Patterns of one
length m share a shift table over blocks of two words: a block that no pattern
holds lets the search skip m - 1 words, other blocks skip as far as their last
place in any pattern allows.  At a shift of zero the block selects a bucket of
patterns that end with it, and a direct comparison of all their words confirms
the occurrence.

Spark plan
----------
The benchmark is measured first and dealt, by hash of the item, to as many
blocks as keep the compiled size near ``block_bytes``.  Blocks are compiled in
tasks, into arrays (about ``_EACH`` bytes for each byte of text) and written;
the driver fetches one blob at a time, checks its size and broadcasts it.  Each
block is one narrow pass over the documents, so a usual benchmark needs no
exchange at all.  A benchmark of several blocks is searched block by block, and
the hits of a document are then merged by document.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import U, chain, word_hashes
from .store import Workspace

#: A-Z to lower case; every byte that is not a digit, a letter or above 0x7F becomes a space.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Compiled bytes for each byte of benchmark text, at most: hashes, block and suffix tables of its words, and the text.
_EACH = 24
#: A blob beyond this is refused: only one item of some tens of MB makes it.
_MOST_BLOB = 1 << 30


class Words:
    """The words of texts: runs of digits, letters a-z and non-ASCII characters, A-Z lowered first."""

    def __init__(self, *texts: str | None):
        parts = [b"" if t is None else t.encode("utf-8", "surrogatepass").translate(_WORD_BYTES) for t in texts]
        self.bytes = b" ".join(parts)
        self.hashes, self.starts = word_hashes(self.bytes)
        ends = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        self.first = np.searchsorted(self.starts, ends)  # the first word of each text, and the end

    def __len__(self) -> int:
        return len(self.hashes)

    def run(self, at: int, m: int) -> list[bytes]:
        """The m words from ``at``."""
        end = int(self.starts[at + m]) if at + m < len(self.starts) else len(self.bytes)
        return self.bytes[int(self.starts[at]) : end].split()


class WuManber:
    """Patterns of one length: the windows of m words that begin at ``at`` in ``words``, each of the item with that number."""

    def __init__(self, words: Words, at: np.ndarray, items: np.ndarray, m: int):
        self.words, self.m, self.size = words, m, min(2, m)
        self.skip = m - self.size + 1
        h = words.hashes
        blocks, shifts = [], []
        for end in range(self.size, m + 1):
            blocks.append(self.block(h[at + end - 2], h[at + end - 1]) if self.size == 2 else h[at + end - 1])
            shifts.append(np.full(len(at), m - end, np.uint8 if m < 256 else np.int64))
        block, shift = np.concatenate(blocks), np.concatenate(shifts)
        order = np.lexsort((shift, block))
        block, shift = block[order], shift[order]
        new = np.concatenate([[True], block[1:] != block[:-1]])
        self.blocks, self.shifts = block[new], shift[new]
        suffix = blocks[-1]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.at, self.items = suffix[order], at[order].astype(np.int32), items[order].astype(np.int32)

    @staticmethod
    def block(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return chain(one, two)

    def search(self, doc: Words) -> Iterator[tuple[int, int]]:
        """(start, item) of every occurrence, by start; the hashes select, the words themselves decide."""
        m, n = self.m, len(doc)
        if n < m:
            return
        block = self.block(doc.hashes[:-1], doc.hashes[1:]) if self.size == 2 else doc.hashes
        place = np.searchsorted(self.blocks, block)
        known = self.blocks[np.minimum(place, len(self.blocks) - 1)] == block
        steps = np.where(known, self.shifts[np.minimum(place, len(self.shifts) - 1)], self.skip).tolist()
        at, last, before = m - self.size, len(steps), self.size - 1
        while at < last:
            step = steps[at]
            if step:
                at += step
                continue
            start = at + before - m + 1
            lo, hi = np.searchsorted(self.suffix, block[at]), np.searchsorted(self.suffix, block[at], side="right")
            alike = lo + np.flatnonzero(self.words.hashes[self.at[lo:hi]] == doc.hashes[start])
            mine = doc.run(start, m) if len(alike) else []
            for k in alike:
                if self.words.run(int(self.at[k]), m) == mine:
                    yield start, int(self.items[k])
            at += 1


def compile_items(items: list[tuple[int, str | None]], window: int) -> list[WuManber]:
    """A search for each pattern length: ``window``, and that of each shorter item.  A pattern that an item holds twice is one."""
    words = Words(*(text for _, text in items))
    by_length: dict[int, tuple[list, list]] = {}
    for number in range(len(items)):
        a, b = int(words.first[number]), int(words.first[number + 1])
        m = min(window, b - a)
        if m:
            at = np.arange(a, b - m + 1)
            key = chain(*(words.hashes[at + k] for k in range(m)))
            at = at[np.sort(np.unique(key, return_index=True)[1])]
            places, numbers = by_length.setdefault(m, ([], []))
            places.append(at)
            numbers.append(np.full(len(at), number))
    return [WuManber(words, np.concatenate(p), np.concatenate(n), m) for m, (p, n) in sorted(by_length.items())]


class Block:
    """A compiled part of the benchmark."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.ids = [i for i, _ in items]
        self.searches = compile_items(items, window)


_HITS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])


def _search(shared):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = pickle.loads(shared.value)
        for table in tables:
            out: dict[str, list] = {name: [] for name in _HITS.names}
            for doc_id, row, text in zip(table.column("doc_id").to_pylist(), table.column("row").to_pylist(), table.column("text"), strict=True):
                words = Words(text.as_py())
                found: set[int] = set()
                spans: list[list[int]] = []
                for s in block.searches:
                    for start, item in s.search(words):
                        found.add(item)
                        spans.append([start, start + s.m])
                for name, value in zip(_HITS.names, (doc_id, row, len(words), [x for span in _union(spans) for x in span], sorted({block.ids[i] for i in found})), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_HITS)

    return run


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _compile(window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0], r[1] or ""))
        return pa.table({"block": table.column("block")[:1], "blob": pa.array([pickle.dumps(Block(rows, window))], pa.binary())})

    return run


def _blocks(benchmark: DataFrame, window: int, block_bytes: int, work: Workspace) -> DataFrame:
    """(block, blob): the compiled benchmark, written; an item is never split, so a block may exceed the limit by one item."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").dropDuplicates()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size * _EACH // block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
    return work.table("blocks", dealt.groupBy("block").applyInArrow(_compile(window), "block long, blob binary"))


def _each_block(benchmark: DataFrame, window: int, block_bytes: int, work: Workspace) -> Iterator[bytes]:
    """One blob after the other on the driver, each within twice the limit but for a single item beyond it."""
    blocks = _blocks(benchmark, window, block_bytes, work)
    for r in blocks.select("block", F.octet_length("blob").alias("bytes")).orderBy("block").collect():
        if r.bytes > _MOST_BLOB:
            raise ValueError(f"a block of the benchmark takes {r.bytes} bytes; its largest item must be cut")
        yield blocks.filter(F.col("block") == r.block).first().blob


def find_occurrences(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 64 << 20) -> DataFrame:
    """Benchmark windows in every row of ``docs`` (doc_id, text) for ``benchmark`` (item_id, text).

    One row for each row of ``docs``: doc_id, row (a number of the row), n_words, spans (word
    offsets start, end, start, end ... of the hit words, disjoint and ascending) and items (ids with
    an occurrence, ascending).  A window is ``window`` consecutive words; a shorter item is one window.

    Null or wordless texts have no words and no hits; null or wordless items are in no document.
    Repeated items count once by their id; a null item_id is dropped.  Repeated documents give a row
    each.  Other columns are ignored.  Empty documents give no rows; an empty benchmark no hits.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "find")
    source = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    schema = "doc_id long, row long, n_words long, spans array<long>, items array<long>"
    blobs = _each_block(benchmark, window, block_bytes, work)
    first = next(blobs, pickle.dumps(Block([], window)))
    second = next(blobs, None)
    if second is None:
        return source.mapInArrow(_search(spark.sparkContext.broadcast(first)), schema)
    source = work.table("docs", source)  # numbers of rows must hold in every pass
    parts = []
    for n, blob in enumerate(_chained(first, second, blobs)):
        shared = spark.sparkContext.broadcast(blob)
        found = source.mapInArrow(_search(shared), schema)
        parts.append(work.table(f"hits-{n}", found if n == 0 else found.filter(F.size("items") > 0)))
        shared.destroy()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    merged = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("doc_id", "row", "n_words", "spans", "items").mapInArrow(_merge, schema)


def _chained(first: bytes, second: bytes, others: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield second
    yield from others


def _merge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        spans = [[x for s in _union(np.array(v).reshape(-1, 2).tolist()) for x in s] for v in table.column("spans").to_pylist()]
        yield table.set_column(3, "spans", pa.array(spans, pa.list_(pa.int64())))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_occurrences(docs, benchmark, **options)
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` without an occurrence, all columns kept (any name is free); one narrow pass for each block.

    Null or wordless texts stay, and so do rows that repeat; null or wordless items are in no document.
    An empty benchmark drops nothing; an empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    for blob in _each_block(benchmark, window, block_bytes, Workspace(docs.sparkSession, "clean")):
        docs = docs.filter(_clean(sc.broadcast(blob))(F.col("text")))
    return docs


def _clean(shared):
    held: list[Block] = []  # in a task, the block once it is unpacked

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        if not held:
            held.append(pickle.loads(shared.value))
        return pa.array([not any(next(s.search(w), None) for s in held[0].searches) for w in map(Words, text.to_pylist())], pa.bool_())

    return clean
