"""N-gram Jaccard join with PartEnum signatures.

Documents are sets of word shingles.  Sets are put in size bands; within the
reach of one band, similar sets differ in at most k elements.  The hash domain
is cut into n1 first-level parts of n2 second-level parts each, and a set's
signatures are the hashes of its elements in every subset of n2 - k2 of the
second-level parts of a first-level part (PartEnum, Arasu, Ganti and Kaushik
2006): of n1 >= (k + 1) / (k2 + 1) first-level parts, one holds at most k2 of
the k differences, so that a subset of its parts agrees.  Small sets (k up to 5)
take all pairs of k + 2 parts, since a single part would hold too few elements to
tell them apart.  Larger ones take n2 = k2 + 1, subsets of one part: no choice
needs fewer signatures.

Three lossless refinements keep the candidates few:

* Equal sets are one class from the start; signatures are made for classes.
* With m parts and subsets of one, of which e are empty for a set, every similar
  set shares at least m - e - k of its non-empty signatures.  So a set with fewer crowded
  signatures than that finds all partners through the others: a passage that
  many documents share crowds a few signatures and costs nothing.
* Parity sketches bound the difference of two sets from below; a pair whose
  sketches differ in more than the allowed number of bits is dropped unread.

* A set with u elements that no other crowded set has shares at most n - u
  elements with any of them; where that is too few, the set is dropped, which
  leaves more elements of others alone (a few rounds).

Crowded signatures that remain come from large groups of near copies.  There a
first round compares members with one pivot of the signature only, the one with
the least share of elements of its own (the text that was copied).  A second
round compares members that are still in different components and whose common
elements can be enough; pairs inside a component need no look, as the result is
the components.

Spark plan: signatures travel as sorted key blobs by hash range (see packing); a
task sends no more than ``_CROWD`` + 1 members of a signature to its range, which
is enough to know it as crowded, and deals the others out by salt, so a family of
a third of all rows is never gathered.  Candidates and sketches are narrow rows;
only the sets of candidates that pass their sketches are compared, element by
element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .packing import U, chain, lower_utf8, mix, pack, pack_sorted, ranges, unpack, unpack_sorted, word_hashes
from .store import Workspace

_BITS = 48
#: Words of 64 bits in the sketch of fixed length that joins compare.
_PARITY = 8
#: A signature with more classes than this is crowded.
_CROWD = 8
#: Sets that differ in up to so many elements make signatures of pairs of parts.
_PAIRED = 5


class Measure:
    """Jaccard similarity of at least ``percent`` / 100, in whole numbers."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 99:
            raise ValueError("percent must be between 50 and 99")
        self.percent = percent
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(self.edges[-1] * 100 // percent + 1)

    def difference(self, total: int) -> int:
        """The most elements by which two similar sets of ``total`` elements together can differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def parts(self, band: int) -> tuple[int, int, int]:
        """(m, k, size) of the sets in a band and the one before: parts, the most differing elements, parts in a subset."""
        k = self.difference(2 * (self.edges[band + 1] - 1))
        if k == 0:
            return 0, 0, 0
        return (k + 2, k, 2) if k <= _PAIRED else (k + 1 + k * 3 // 20, k, 1)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def sketch_bits(self, size: int) -> int:
        """A power of two of about eight times the difference, alike for sets that can be similar or double."""
        return 1 << max(6, int(self.difference(2 * size) * 6).bit_length())


def shingles(text: str | None, words: int, seed: int = 0) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; fewer words are one run, none an empty set."""
    h, _ = word_hashes(lower_utf8(text))
    if not len(h):
        return h
    h = h ^ mix(np.array([seed], U))[0] if seed else h
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        return np.unique(chain(*(h[k : len(h) - n + 1 + k] for k in range(n))))


def signatures(s: np.ndarray, measure: Measure) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, shared, keys) for both bands of a set; every similar set shares ``shared`` keys or more.

    Empty parts make signatures only for a set with so few others that none of those need agree.
    Two such sets then agree in some part, empty or not; with any other set, one of the other's
    non-empty parts agrees.
    """
    own = measure.band(len(s))
    for band in (own, own + 1):
        m, k, size = measure.parts(band)
        if not m:
            continue
        part = ((s >> U(32)) * U(m)) >> U(32)
        full, first = np.unique(part, return_index=True)
        sums = np.add.reduceat(mix(s), first)
        least = len(full) - k
        if size == 2:
            every, some = np.zeros(m, U), np.zeros(m, bool)
            every[full.astype(np.int64)], some[full.astype(np.int64)] = sums, True
            one, two = np.triu_indices(m, 1)
            if least > 0:  # two parts agree, one of them not empty
                both = some[one] | some[two]
                one, two = one[both], two[both]
            yield band, 1, chain(np.full(len(one), band, U), one.astype(U) * U(m) + two.astype(U), every[one], every[two]) >> U(64 - _BITS)
            continue
        if least <= 0:
            every = np.zeros(m, U)
            every[full.astype(np.int64)] = sums
            full, sums, least = np.arange(m, dtype=U), every, 1
        yield band, least, chain(np.full(len(full), band, U), full, sums) >> U(64 - _BITS)


def sketch(s: np.ndarray, bits: int) -> bytes:
    """Parities of the elements by hash cell: each differing element changes one bit at most."""
    odd = np.bincount((mix(s ^ U(0x5EED)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fold(blob: bytes, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes from a longer one: cells that meet add their parities."""
    return np.bitwise_xor.reduce(np.frombuffer(blob, np.uint8).reshape(-1, size), axis=0)


def _classes(words: int, seed: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("check", pa.int64())])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = []
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text"), strict=True):
                s = shingles(text.as_py(), words, seed)
                rows.append((doc_id, len(s), *fingerprint(s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, schema=schema)

    return run


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = (int(mix(np.sum(mix(s ^ U(k)), keepdims=True) + U(len(s) + k))[0]) for k in (11, 12))
    return a - (1 << 63), b - (1 << 63)


_SENT = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("who", pa.binary()), ("cls", pa.binary()), ("shared", pa.binary())])


def _send(words: int, seed: int, percent: int, parts: int, flush: int):
    """Signatures by hash range; a class that this task has sent already is skipped."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure, sent = Measure(percent), set()
        keys: list[np.ndarray] = []
        cls: list[int] = []
        shared: list[int] = []
        waiting, flushed = 0, [0]

        def rows() -> pa.RecordBatch:
            key = np.concatenate(keys)
            who = np.repeat(np.arange(len(keys), dtype=U), [len(k) for k in keys])
            order = np.argsort(key, kind="stable")
            key, who = key[order], who[order]
            at = np.arange(len(key))
            nth = at - np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
            more = nth > _CROWD  # as many of a task's classes as make a signature crowded go to its range, the others apart
            out: dict[str, list] = {name: [] for name in _SENT.names}
            names, most = np.array(cls, np.int64).view(U), np.array(shared, U)
            if more.any():
                salt = (TaskContext.get().partitionId() * 31 + flushed[0]) % parts
                for name, value in zip(_SENT.names, (-1 - salt, pack_sorted(key[more]), pack(np.arange(more.sum())), pack(names[who[more].astype(np.int64)]), pack(most[who[more].astype(np.int64)])), strict=True):
                    out[name].append(value)
                key, who = key[~more], who[~more]
            flushed[0] += 1
            cut = ranges(key, _BITS, parts)
            for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if a < b:
                    here, local = np.unique(who[a:b], return_inverse=True)
                    here = here.astype(np.int64)
                    for name, value in zip(_SENT.names, (p, pack_sorted(key[a:b]), pack(local), pack(names[here]), pack(most[here])), strict=True):
                        out[name].append(value)
            keys.clear(), cls.clear(), shared.clear()
            return pa.RecordBatch.from_pydict(out, schema=_SENT)

        for table in tables:
            for text in table.column("text"):
                s = shingles(text.as_py(), words, seed)
                name = fingerprint(s)[0]
                if not len(s) or name in sent:
                    continue
                sent.add(name)
                for _, least, k in signatures(s, measure):
                    keys.append(k)
                    cls.append(name)
                    shared.append(least)
                    waiting += len(k)
                if waiting >= flush:
                    yield rows()
                    waiting = 0
        if keys:
            yield rows()

    return run


_FOUND = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("shared", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _gather(table: pa.Table) -> pa.Table:
    """Pairs (a, b) of the classes of uncrowded signatures; memberships (key, cls, shared) of crowded ones."""
    columns = []
    for keys, who, cls, shared in zip(*(table.column(n) for n in _SENT.names[1:]), strict=True):
        who = unpack(who.as_py()).astype(np.int64)
        columns.append((unpack_sorted(keys.as_py()), unpack(cls.as_py()).view(np.int64)[who], unpack(shared.as_py()).astype(np.int64)[who]))
    key, cls, shared = (np.concatenate(c) for c in zip(*columns, strict=True))
    del columns
    none = lambda k: pa.nulls(k, pa.int64())
    if table.column("part")[0].as_py() < 0:
        return pa.Table.from_arrays([*(pa.array(x.astype(np.int64)) for x in (key, cls, shared)), none(len(key)), none(len(key))], schema=_FOUND)
    order = np.lexsort((cls, key))
    key, cls, shared = key[order], cls[order], shared[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
    key, cls, shared = key[new], cls[new], shared[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    pairs = [np.empty((0, 2), np.int64)]
    for n in range(2, _CROWD + 1):
        at = first[size == n]
        for i in range(n):
            pairs += [np.column_stack([cls[at + i], cls[at + j]]) for j in range(i + 1, n)]
    pair = np.unique(np.concatenate(pairs), axis=0)
    crowded = np.repeat(size > _CROWD, size)
    n, h = len(pair), int(crowded.sum())
    return pa.Table.from_arrays(
        [pa.concat_arrays([none(n), pa.array(x[crowded].astype(np.int64))]) for x in (key, cls, shared)] + [pa.concat_arrays([pa.array(np.ascontiguousarray(pair[:, k])), none(h)]) for k in (0, 1)],
        schema=_FOUND,
    )


def _sets(words: int, seed: int, percent: int):
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("elements", pa.binary()), ("parity", pa.list_(pa.int64()))])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(percent)
        for table in tables:
            rows = []
            for text in table.column("text"):
                s = shingles(text.as_py(), words, seed)
                rows.append((fingerprint(s)[0], len(s), sketch(s, measure.sketch_bits(len(s))), s.tobytes(), np.frombuffer(sketch(s, _PARITY * 64), np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _elements(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (element, cls) for each element of each set, set by set."""
    for table in tables:
        for cls, blob in zip(table.column("cls").to_pylist(), table.column("elements"), strict=True):
            e = np.frombuffer(blob.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(np.full(len(e), cls, np.int64))], names=["element", "cls"])


def _peel(crowded: DataFrame, sets: DataFrame, work: Workspace, percent: int, rounds: int = 4) -> DataFrame:
    """(key, cls, n, own) of the crowded sets that can have a partner among themselves."""
    left = work.table("peel-0", sets.join(crowded.select("cls").distinct(), "cls", "left_semi").select("cls", "n", F.lit(0).cast("long").alias("own")))
    for k in range(1, rounds + 1):
        alone = sets.join(left.select("cls"), "cls", "left_semi").select("cls", "elements").mapInArrow(_elements, "element long, cls long")
        alone = alone.groupBy("element").agg(F.count("*").alias("times"), F.min("cls").alias("cls")).filter("times = 1").groupBy("cls").agg(F.count("*").alias("more"))
        met = left.join(alone, "cls", "left").select("cls", "n", F.coalesce("more", F.lit(0)).cast("long").alias("own"))
        before, left = left, work.table(f"peel-{k}", met.filter((F.col("n") - F.col("own")) * 100 >= percent * F.col("n")))
        if left.count() == before.count():
            break
    return work.table("members", crowded.join(left, "cls"))


def _near(percent: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(percent)
        for table in tables:
            keep = []
            for na, nb, sa, sb in zip(*(table.column(n).to_pylist() for n in ("na", "nb", "sa", "sb")), strict=True):
                if min(na, nb) * 100 < percent * max(na, nb):
                    keep.append(False)
                    continue
                size = min(len(sa), len(sb))
                keep.append(int(np.bitwise_count(_fold(sa, size) ^ _fold(sb, size)).sum()) <= measure.difference(na + nb))
            yield table.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _equal(percent: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(percent)
        for table in tables:
            keep = [measure.linked(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)) for x, y in zip(table.column("ea"), table.column("eb"), strict=True)]
            yield table.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def group_documents(docs: DataFrame, *, words: int = 5, percent: int = 80, range_bytes: int = 8 << 20, flush: int = 1 << 20) -> DataFrame:
    """Groups of the rows of ``docs`` (doc_id, text) whose shingle sets have Jaccard >= percent / 100.

    One row for each row: doc_id, n_shingles, component_id (the least doc_id that links reach, itself
    included), class_id (equal for equal sets; null without words) and n_copies (rows of the class).

    A document with fewer than ``words`` words is one shingle.  Null and wordless texts have none and
    link with nothing.  Repeated rows are copies of one another.  Null doc_ids take part; a
    component of null ids only has a null component_id.  Other columns are ignored.  An empty table
    gives no rows.  Links are exact up to collisions of 64-bit hashes among shingles; classes are
    checked by a second hash, and hashed anew with another seed on a collision.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "join")
    source = docs.select(F.col("doc_id").cast("long"), "text")
    for seed in range(8):
        rows = work.table(f"classes-{seed}", source.mapInArrow(_classes(words, seed), "doc_id long, n long, cls long, check long"))
        facts = rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        classes = work.table(f"facts-{seed}", facts)
        if classes.filter("c0 != c1").isEmpty():
            break
    else:
        raise RuntimeError("class hashes collide with every seed")

    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(12, total * 8 // range_bytes)
    sent = source.mapInArrow(_send(words, seed, percent, parts, flush), "part int, keys binary, who binary, cls binary, shared binary")
    found = work.table("found", sent.groupBy("part").applyInArrow(_gather, "key long, cls long, shared long, a long, b long"))
    crowded = found.filter("key is not null").select("key", "cls", "shared")
    busy = crowded.groupBy("cls", "shared").agg(F.count("*").alias("h")).filter("h >= shared").select("cls", "shared")
    crowded = work.table("crowded", crowded.join(busy, ["cls", "shared"]).select("key", "cls").distinct())
    pairs = found.filter("a is not null").select("a", "b").distinct()

    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(crowded.select("cls")).distinct()
    chosen = rows.filter("n > 0").join(wanted, "cls").groupBy("cls").agg(F.min("doc_id").alias("chosen"))
    texts = source.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(words, seed, percent), "cls long, n long, sketch binary, elements binary, parity array<long>")
    sets = work.table("sets", sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]))

    member = _peel(crowded, sets, work, percent)
    pivots = member.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "cls")).alias("pivot"))
    stars = member.join(pivots, "key").select(F.least("pivot.cls", "cls").alias("a"), F.greatest("pivot.cls", "cls").alias("b"))
    first = work.table("first", pairs.union(stars.filter("a != b")).distinct())

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        def side(x: str, *columns: str) -> DataFrame:
            return sets.select(F.col("cls").alias(x), *(F.col(c).alias(c[0] + x) for c in columns))

        near = pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").mapInArrow(_near(percent), "a long, b long")
        near = work.table(f"near-{name}", near)
        return work.table(f"links-{name}", near.join(side("a", "elements"), "a").join(side("b", "elements"), "b").mapInArrow(_equal(percent), "a long, b long"))

    links = verified(first, "1")
    groups = connected_components(links, work, "groups-1")
    member = member.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    split = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
    member = work.table("split", member.join(split, "key", "left_semi").select("key", "cls", "n", "own", "component"))
    if not member.isEmpty():
        member = member.join(sets.select("cls", "parity"), "cls")
        one, two = (member.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("cls", "n", "own", "component")), *(F.get("parity", F.lit(k)).alias(f"{x}_{k}") for k in range(_PARITY))) for x in "ab")
        common = F.least(F.col("a_n") - F.col("a_own"), F.col("b_n") - F.col("b_own"))
        enough = (F.col("a_cls") < F.col("b_cls")) & (F.col("a_component") != F.col("b_component")) & (common * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent)
        apart = sum((F.bit_count(F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}"))) for k in range(1, _PARITY)), F.bit_count(F.col("a_0").bitwiseXOR(F.col("b_0"))))
        enough = enough & (apart * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent))
        across = one.join(two, "key").filter(enough).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct()
        links = links.union(verified(across, "2"))
        groups = connected_components(links, work, "groups-2")

    for name in ("found", "crowded", "sets", "members", "first", "near-1", "links-1", "split", "near-2", "links-2", *(f"peel-{k}" for k in range(5))):
        work.drop(name)
    named = classes.join(groups, F.col("cls") == F.col("node"), "left").select("cls", "least", "n_copies", F.coalesce("component", "cls").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cls", "n_copies", "component_id")
    out = rows.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("cls")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_one_of_each_group(docs: DataFrame, *, most_broadcast: int = 16 << 20, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their group, all columns kept (any name is free).

    Rows that repeat doc_id and text stay once.  Texts without words are in no group and stay, null
    ones included.  Of rows that share a doc_id all stay if one of them is its group's least; a null
    doc_id stays where its group has no other id.  An empty table gives no rows.

    The ids that go are a list, broadcast up to ``most_broadcast`` bytes as counted; texts are not
    exchanged, but for rows whose doc_id occurs more than once.
    """
    work = Workspace(docs.sparkSession, "keep")
    groups = group_documents(docs, **options)
    ids = work.table("ids", groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).filter("n > 1 or not stays"))

    def listed(test: str, name: str) -> tuple[DataFrame, int]:
        some = ids.filter(test).select(F.col("doc_id").alias(name))
        n = some.count()
        return (F.broadcast(some) if 16 * n <= most_broadcast else some), n

    gone, _ = listed("not stays", "gone")
    again, repeated = listed("stays and n > 1", "again")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti")
    if repeated:
        same = F.col("id").eqNullSafe(F.col("again"))
        once = rows.join(again, same, "left_semi").withColumn("digest", F.md5("row.text")).dropDuplicates(["id", "digest"]).drop("digest")
        rows = rows.join(again, same, "left_anti").unionByName(once)
    return rows.select("row.*")
