"""Line dedup with content-defined chunks of lines; DataFrame functions only.

A text is cut after every line whose rolling hash (a polynomial of the hashes
of the last ``window`` lines) is a local maximum.  A boundary so depends on the
lines around it alone, not on what stands before: inserted or removed lines
move no other boundary (shift resistance), and chunks hold two lines or more.
A line of ``long_words`` words or more is a chunk of its own: it is a passage
without line breaks.  Chunks of several lines, and such long lines, are removed
wherever they repeat one that stands earlier, by (doc_id, place).

The first and last lines of a copied passage share their chunks with what
stands around them.  So the lines between two neighbours are a unit as well: a
passage is a longest run of lines whose every two neighbours stand side by side
earlier too, and it is removed if it has ``long_words`` words or more.

All repeats are compared byte by byte with the earlier copy.  The text of every
removed line stays at the earliest of its places.

Spark plan
----------
1. One narrow pass makes a row of fixed size (line numbers, hash, length) for
   each unit; bodies stay where they are.
2. Units are counted by hash with map-side pre-aggregation (a passage in a third
   of all rows is one row for each task), and those that repeat get the place of
   the earliest.
3. Only repeats fetch their bodies, as slices of their documents, and meet the
   earliest body in a join that the skew handling can split.
4. What is to go is a short list for each document.  Lists are broadcast up to
   ``most_broadcast`` bytes as measured, beyond that joined by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Workspace

_PRIME = (1 << 31) - 1
_WORD = "[^\\x20\\x09-\\x0D]+"
_CHUNK, _PAIR = 0, 1
_DOC, _SAME = ["id", "key"], ["kind", "hash", "chars"]


def _settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that no later expression evaluates them again for each element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _units(df: DataFrame, window: int, long_words: int) -> DataFrame:
    """Units of (id, key, text): id, key, kind, a, b (first and last line), wa, wb (words of the first line
    and of the others), hash, chars."""
    df = _settle(df, lines=F.split("text", "\n", -1)).drop("text")
    boundary_hash = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")
    df = _settle(
        df,
        g=F.transform("lines", boundary_hash),
        n=F.transform("lines", lambda x: F.regexp_count(x, F.lit(_WORD))),
        x=F.transform("lines", lambda x: F.xxhash64(x)),
        c=F.transform("lines", lambda x: F.length(x)),
        last=F.size("lines") - 1,
    ).drop("lines")

    def rolling(x: Column, i: Column) -> Column:
        out, power = x, 1
        for back in range(1, window):
            power = power * 31 % _PRIME
            out = out + F.coalesce(F.get("g", i - back), F.lit(0)) * power
        return out % _PRIME

    df = _settle(df, r=F.transform("g", rolling)).drop("g")

    def cut(i: Column) -> Column:
        peak = (i > 0) & (F.get("r", i) > F.get("r", i - 1)) & (F.get("r", i) >= F.get("r", i + 1))
        return (i == F.col("last")) | F.coalesce(peak, F.lit(False)) | (F.get("n", i) >= long_words) | F.coalesce(F.get("n", i + 1) >= long_words, F.lit(False))

    df = _settle(df, ends=F.filter(F.sequence(F.lit(0), "last"), cut)).drop("r")

    def unit(kind: int, a: Column, b: Column, wa: Column, wb: Column, hashed: Column, chars: Column) -> Column:
        values = {"kind": F.lit(kind).cast("byte"), "a": a.cast("int"), "b": b.cast("int"), "wa": wa.cast("int"), "wb": wb.cast("int"), "hash": F.xxhash64(hashed), "chars": chars.cast("int")}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    def chunk(end: Column, k: Column) -> Column:
        first = F.coalesce(F.get("ends", k - 1) + 1, F.lit(0))
        part = lambda c, skip=0: F.slice(c, first + 1 + skip, end - first + 1 - skip)
        total = lambda c, skip=0: F.aggregate(part(c, skip), F.lit(0), lambda a, x: a + x)
        return unit(_CHUNK, first, end, F.when(F.size(F.filter(part("n"), lambda x: x > 0)) >= 2, F.lit(long_words)).otherwise(F.lit(0)), total("n"), part("x"), total("c") + end - first)

    def pair(i: Column) -> Column:
        at = lambda c, k: F.get(c, k)
        return unit(_PAIR, i - 1, i, at("n", i - 1), at("n", i), F.array(at("x", i - 1), at("x", i)), at("c", i - 1) + at("c", i) + 1)

    chunks = F.filter(F.transform("ends", chunk), lambda u: (u["wa"] > 0) | (u["wb"] >= long_words))
    pairs = F.when(F.col("last") > 0, F.transform(F.sequence(F.lit(1), F.greatest("last", F.lit(1))), pair)).otherwise(F.slice(chunks, 1, 0))
    return df.select(*_DOC, F.inline(F.concat(chunks, pairs)))


def _with_lists(docs: DataFrame, lists: DataFrame, how: str, bytes_each: int, most_broadcast: int) -> DataFrame:
    """``docs`` with the list (id, key, spans) of their document; the plan follows the lists' measured size."""
    size = lists.agg(F.sum(64 + bytes_each * F.size("spans"))).first()[0] or 0
    lists = F.broadcast(lists) if size <= most_broadcast else lists.hint("shuffle_hash")
    named = lists.withColumnsRenamed({"id": "l_id", "key": "l_key"})
    return docs.join(named, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("key") == F.col("l_key")), how).drop("l_id", "l_key")


def _passages(pairs: DataFrame, long_words: int) -> DataFrame:
    """The pairs that lie in a passage, with its number in the document."""
    of_doc = Window.partitionBy(*_DOC).orderBy("a")
    run = Window.partitionBy(*_DOC, "run")
    pairs = pairs.withColumn("run", F.col("a") - F.row_number().over(of_doc))
    return pairs.withColumn("words", F.sum("wb").over(run) + F.min_by("wa", "a").over(run)).filter(F.col("words") >= long_words).drop("words")


def dedup_lines(docs: DataFrame, *, window: int = 2, long_words: int = 50, most_broadcast: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without repeated chunks and passages of lines.

    All columns stay; text loses the removed lines, and removed_chunks, removed_passages and
    removed_lines (long) are added (columns of these names are replaced; any other name is free).
    The first copy, by (doc_id, place in the text), stays; a repeat within one text goes too.  A text
    may become empty; no row goes.

    Null texts stay null, empty ones empty.  Rows that share doc_id and text count as one document:
    they lose the same lines.  A null doc_id comes before all others.  An empty table gives no rows.
    Repeats whose hashes agree but whose bytes differ both stay.
    """
    work = Workspace(docs.sparkSession, "lines")
    source = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    units = work.table("units", _units(source.filter("text is not null"), window, long_words))
    often = units.groupBy(*_SAME).agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    again = work.table("again", units.join(often, _SAME))
    work.drop("units")
    place = F.struct(*_DOC, "a")
    first = again.groupBy(*_SAME).agg(F.min(place).alias("first"))
    later = work.table("later", again.join(first, _SAME).filter(~place.eqNullSafe(F.col("first"))).dropDuplicates([*_DOC, "kind", "a"]))
    chunks, passages = later.filter(F.col("kind") == _CHUNK), _passages(later.filter(F.col("kind") == _PAIR), long_words)
    met = work.table("met", chunks.withColumn("run", F.lit(None).cast("int")).unionByName(passages))

    span = F.struct("a", "b", *_SAME, "earlier").alias("span")
    here = met.select(*_DOC, "a", "b", *_SAME, F.lit(False).alias("earlier"))
    there = met.select("first.id", "first.key", "first.a", (F.col("first.a") + F.col("b") - F.col("a")).alias("b"), *_SAME, F.lit(True).alias("earlier")).dropDuplicates(_SAME)
    spans = work.table("spans", here.unionByName(there).groupBy(*_DOC).agg(F.collect_list(span).alias("spans")))
    found = _with_lists(source, spans, "inner", 40, most_broadcast)
    found = _settle(found, lines=F.split("text", "\n", -1)).select(*_DOC, "lines", F.explode("spans").alias("u"))
    found = found.select(*_DOC, "u.*", F.array_join(F.slice("lines", F.col("u.a") + 1, F.col("u.b") - F.col("u.a") + 1), "\n").alias("body"))
    kept = found.filter("earlier").dropDuplicates(_SAME).select(*_SAME, F.col("body").alias("kept"))
    differ = found.filter("not earlier").join(kept, _SAME).filter("body != kept").select(*_DOC, "kind", "a")
    if not differ.isEmpty():
        differ = work.table("differ", differ)
        same = later.join(differ.withColumnsRenamed({c: f"d_{c}" for c in differ.columns}), F.col("id").eqNullSafe(F.col("d_id")) & (F.col("key") == F.col("d_key")) & (F.col("kind") == F.col("d_kind")) & (F.col("a") == F.col("d_a")), "left_anti")
        met = same.filter(F.col("kind") == _CHUNK).withColumn("run", F.lit(None).cast("int")).unionByName(_passages(same.filter(F.col("kind") == _PAIR), long_words))

    ranges = met.filter(F.col("kind") == _CHUNK).select(*_DOC, "kind", "a", "b")
    ranges = ranges.unionByName(met.filter(F.col("kind") == _PAIR).groupBy(*_DOC, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(*_DOC, F.lit(_PAIR).cast("byte").alias("kind"), "a", "b"))
    cuts = work.table("cuts", ranges.groupBy(*_DOC).agg(F.collect_list(F.struct("kind", "a", "b")).alias("spans")))

    columns = [c for c in docs.columns if c not in ("removed_chunks", "removed_passages", "removed_lines")]
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    rows = _with_lists(rows, cuts, "left", 16, most_broadcast)
    changed = F.col("spans").isNotNull() & F.col("row.text").isNotNull()
    rows = _settle(rows, lines=F.when(changed, F.split("row.text", "\n", -1)), gone=F.when(changed, F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"]))))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    text = F.when(changed, F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).otherwise(F.col("row.text"))
    count = lambda kind: F.when(changed, F.size(F.filter("spans", lambda s: s["kind"] == kind))).otherwise(0).cast("long")
    shown = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in columns]
    return rows.select(*shown, count(_CHUNK).alias("removed_chunks"), count(_PAIR).alias("removed_passages"), F.when(changed, F.size("gone")).otherwise(0).cast("long").alias("removed_lines"))
