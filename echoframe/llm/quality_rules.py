"""Quality rules with robust multivariate outliers.

Texts get plain statistics.  Those that pass the base rules are compared with
their language and source: the minimum covariance determinant is estimated by
concentration steps (FAST-MCD, Rousseeuw and Van Driessen 1999) from two
deterministic starts, coordinate MADs and spatial signs about the coordinate
medians; after two steps the start with the lesser determinant goes on until the
determinants stand still.  A text is rejected if its Mahalanobis distance
exceeds a cutoff.  Covariances are regularised by the MADs, with the weight of
``PRIOR`` rows, so small groups are judged by the same method.

Spark plan
----------
One narrow pass over whole texts makes a table of a few numbers a row.  All
else works on that table: the h-subset of a group is "distance at most the
group's h-quantile" (a mergeable sketch), and its mean and covariance are sums
with map-side pre-aggregation, so a source with a third of all rows is no more
than one row for each task.  Estimates are a row or two for each group, and are
broadcast up to ``MOST_GROUPS`` groups as counted.  Groups with no more rows than
there are features are pooled by language, and then all together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import chain, word_hashes
from .store import Workspace

#: Statistic vector: name, and the least standard deviation that it is taken to have.
FEATURES = {"log_words": 0.25, "log_word_length": 0.05, "symbols": 0.04, "dup_lines": 0.1, "repeats": 0.1, "capitals": 0.05, "marks": 0.05}
#: Normal quantile of one text in a million: by chi-square, squared distances of ordinary texts lie above its quantile that rarely.
LEAST_Z = 4.753
#: Rows' worth of the MADs in every covariance.
PRIOR = 30
#: Beyond so many groups (below 1 KB each) estimates are joined by group, not broadcast.
MOST_GROUPS = 10_000
_SPACES = b" \t\n\x0b\x0c\r"
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "#*$%&|<>.,")
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines")


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of ``_COLUMNS`` of a whole text; all zero for null."""
    if not text:
        return (0,) * len(_COLUMNS)
    raw = text.encode("utf-8", "surrogatepass")
    count = lambda some: len(raw) - len(raw.translate(None, some))
    words, _ = word_hashes(raw)
    repeated = 0
    if len(words) >= 3:
        windows = chain(words[:-2], words[1:-1], words[2:])
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        edge = np.zeros(len(words) + 1, np.int64)
        at = np.flatnonzero(times[inverse] > 1)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 3, -1) if len(at) else None
        repeated = int((np.cumsum(edge)[:-1] > 0).sum())
    lines, seen, dup = 0, set(), 0
    for line in raw.split(b"\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return len(words), len(text) - count(_SPACES), count(b"#*$%&|<>"), dup, repeated, count(bytes(range(0x41, 0x5B))), count(_MARKS), lines


def _statistics(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        rows = [statistics(t.as_py()) for t in table.column("text")]
        columns = list(zip(*rows, strict=True)) or [[]] * len(_COLUMNS)
        keep = [n for n in table.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(table.column(n) for n in keep), *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, *_COLUMNS])


def _vector() -> dict[str, Column]:
    c = F.col
    words, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    return {
        "log_words": F.log1p("n_words"),
        "log_word_length": F.log(chars / words),
        "symbols": F.sqrt(c("n_symbols") / chars),
        "dup_lines": F.sqrt(c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))),
        "repeats": F.sqrt(c("n_repeat_words") / words),
        "capitals": F.sqrt(c("n_capitals") / chars),
        "marks": F.sqrt(c("n_marks") / chars),
    }


def _distance(p: int) -> Column:
    """Squared Mahalanobis distance of array x to (mean, precision)."""
    d = [F.get("x", F.lit(i)) - F.get("mean", F.lit(i)) for i in range(p)]
    return sum((d[i] * d[j] * F.get("precision", F.lit(i * p + j)) * (1 if i == j else 2) for i in range(p) for j in range(i, p)), F.lit(0.0))


def chi_square(p: int, z: float) -> float:
    """The chi-square quantile with p degrees at the normal quantile z (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


_KEYS = "group string, start int, rows long, spread array<double>"


def _estimates(p: int, floor: list[float]):
    """Mean, precision and log determinant of each group and start from its sums."""
    schema = pa.schema([("group", pa.string()), ("start", pa.int32()), ("rows", pa.int64()), ("spread", pa.list_(pa.float64())), ("mean", pa.list_(pa.float64())), ("precision", pa.list_(pa.float64())), ("log_det", pa.float64())])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            out = []
            for r in table.to_pylist():
                n, s = r["n"], np.array(r["s"])
                mean = s[:p] / n
                cov = np.zeros((p, p))
                cov[np.triu_indices(p)] = s[p:] / n
                cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
                cov = (n * cov + PRIOR * np.diag(r["spread"])) / (n + PRIOR) + np.diag(np.square(floor))
                out.append((r["group"], r["start"], r["rows"], r["spread"], mean.tolist(), np.linalg.inv(cov).reshape(-1).tolist(), float(np.linalg.slogdet(cov)[1])))
            columns = list(zip(*out, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _first(p: int, floor: list[float]):
    """Both starts of each group: the MADs, and the spatial signs scaled by them."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            out = []
            for r in table.to_pylist():
                spread, signs = np.array(r["spread"]), np.zeros((p, p))
                signs[np.triu_indices(p)] = r["signs"]
                signs = (np.triu(signs) + np.triu(signs, 1).T) * p * np.sqrt(np.outer(spread, spread))
                signs = (r["rows"] * signs + PRIOR * np.diag(spread)) / (r["rows"] + PRIOR)
                for start, cov in enumerate((np.diag(spread), signs)):
                    out.append((r["group"], start, r["rows"], spread.tolist(), r["mean"], np.linalg.inv(cov + np.diag(np.square(floor))).reshape(-1).tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["group", "start", "rows", "spread", "mean", "precision"])

    return run


def covariance_distances(rows: DataFrame, work: Workspace, *, features: dict[str, float] = FEATURES, share: float = 0.75, most_steps: int = 20) -> DataFrame:
    """Adds rows and distance2 to ``rows`` (group string, x array of the features): squared robust distance
    within the group, scaled so that its median is that of chi-square.

    The h-subset is ``share`` of a group.  Steps end when no log determinant falls by more than 0.001, or
    after ``most_steps``.  Groups are joined, not gathered."""
    p, floor = len(features), list(features.values())
    x = [F.get("x", F.lit(i)) for i in range(p)]
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    median = work.table("median", rows.groupBy("group").agg(F.count("*").alias("rows"), F.array(*(F.percentile_approx(v, 0.5, 2000) for v in x)).alias("mean")))
    few = median.count() <= MOST_GROUPS

    def with_group(df: DataFrame, small: DataFrame, *keys: str) -> DataFrame:
        return df.join(F.broadcast(small) if few else small, ["group", *keys])

    away = with_group(rows, median).groupBy("group").agg(*(F.percentile_approx(F.abs(v - F.get("mean", F.lit(i))), 0.5, 2000).alias(f"d{i}") for i, v in enumerate(x)))
    scales = work.table("scales", median.join(away, "group").select("group", "rows", "mean", F.array(*(F.pow(F.col(f"d{i}") * 1.4826, F.lit(2.0)) for i in range(p))).alias("spread")))
    scaled = [(v - F.get("mean", F.lit(i))) / F.sqrt(F.get("spread", F.lit(i)) + floor[i] ** 2) for i, v in enumerate(x)]
    signed = with_group(rows, scales).select("group", F.array(*scaled).alias("u"))
    signed = signed.select("group", "u", F.greatest(F.aggregate("u", F.lit(0.0), lambda a, v: a + v * v), F.lit(1e-12)).alias("norm"))
    signs = signed.groupBy("group").agg(F.array(*(F.avg(F.get("u", F.lit(i)) * F.get("u", F.lit(j)) / F.col("norm")) for i, j in upper)).alias("signs"))
    now = work.table("estimates-0", scales.join(signs, "group").mapInArrow(_first(p, floor), f"{_KEYS}, mean array<double>, precision array<double>"))
    before: dict[str, float] = {}
    settled: list[DataFrame] = []
    for k in range(1, most_steps + 1):
        measured = with_group(rows, now).select("group", "start", "rows", "spread", "x", _distance(p).alias("d"))
        cut = measured.groupBy("group", "start").agg(F.percentile_approx("d", share, 2000).alias("cut"))
        inner = with_group(measured, cut, "start").filter("d <= cut")
        sums = inner.groupBy("group", "start").agg(F.first("rows").alias("rows"), F.first("spread").alias("spread"), F.count("*").alias("n"), F.array(*(F.sum(v) for v in [*x, *(x[i] * x[j] for i, j in upper)])).alias("s"))
        now = work.table(f"estimates-{k}", sums.mapInArrow(_estimates(p, floor), f"{_KEYS}, mean array<double>, precision array<double>, log_det double"))
        if k == 2:
            lesser = now.groupBy("group").agg(F.min(F.struct("log_det", "start")).alias("best")).select("group", "best.start")
            now = work.table("estimates-best", now.join(lesser, ["group", "start"]))
        if k >= 2 and few:  # groups that stand still take no part in further steps
            after = {r.group: r.log_det for r in now.select("group", "log_det").collect()}  # at most MOST_GROUPS rows
            moving = [(g,) for g in after if g not in before or before[g] - after[g] > 1e-3]
            before = after
            falling = F.broadcast(rows.sparkSession.createDataFrame(moving, "group string"))
            settled.append(now.join(falling, "group", "left_anti"))
            now = now.join(falling, "group", "left_semi")
            if not moving:
                break
    for done in settled:
        now = now.unionByName(done)
    now = work.table("estimates", now)
    measured = with_group(rows, now.drop("spread", "log_det", "start")).withColumn("d", _distance(p))
    scale = work.table("scale", measured.groupBy("group").agg((F.percentile_approx("d", 0.5, 2000) / chi_square(p, 0)).alias("scale")))
    return with_group(measured, scale).withColumn("distance2", F.col("d") / F.greatest("scale", F.lit(1.0))).drop("mean", "precision", "d", "scale")


def apply_rules(docs: DataFrame, *, cutoff: float | None = None, least_words: int = 50) -> DataFrame:
    """Judge every row of ``docs`` (doc_id, text, lang, source).

    Results: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and distance2 (null where no verdict was needed or possible).

    ``cutoff``: the greatest squared distance that is kept; the chi-square quantile at ``LEAST_Z`` by
    default.

    Null and blank texts have no words and fail the base rules.  A null lang or source is a value of
    its own.  Repeated rows count and are judged each.  A group needs more rows than features; where
    even all rows of the groups too small together are no more, no covariance can be estimated and
    the base rules decide alone.  Other columns are ignored.  An empty table gives no rows.
    """
    least_rows = len(FEATURES) + 1
    cutoff = chi_square(len(FEATURES), LEAST_Z) if cutoff is None else cutoff
    work = Workspace(docs.sparkSession, "rules")
    counted = docs.select(F.col("doc_id").cast("long"), "lang", "source", "text").mapInArrow(_statistics, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COLUMNS))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    vector = _vector()
    stats = counted.select("doc_id", "lang", "source", *_COLUMNS[:5], failed.alias("base_failed"), F.array(*(vector[f] for f in FEATURES)).alias("x"))
    stats = work.table("stats", stats)
    good = stats.filter("not base_failed")
    both = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    both = both.withColumn("in_both", F.col("n") >= least_rows)
    by_lang = both.filter("not in_both").groupBy("lang").agg(F.sum("n").alias("n"))
    by_lang = by_lang.select(F.col("lang").alias("l"), (F.col("n") >= least_rows).alias("in_lang"))
    level = both.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    name = F.when(F.col("in_both"), F.to_json(F.struct(F.lit(2).alias("by"), "lang", "source"))).when(F.col("in_lang"), F.to_json(F.struct(F.lit(1).alias("by"), "lang"))).otherwise(F.lit("all"))
    level = work.table("groups", level.select(F.col("lang").alias("l"), F.col("source").alias("s"), name.alias("group")))
    level = F.broadcast(level) if level.count() <= MOST_GROUPS else level
    grouped = good.join(level, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")
    judged = covariance_distances(grouped.select("doc_id", *_COLUMNS[:5], "base_failed", "x", "group"), work)
    shown = ["doc_id", *_COLUMNS[:5], "base_failed"]
    judged = judged.select(*shown, F.when(F.col("rows") >= least_rows, F.col("distance2")).alias("distance2"))
    out = judged.unionByName(stats.filter("base_failed").select(*shown, F.lit(None).cast("double").alias("distance2")))
    return out.select(*shown, (~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff)).alias("kept"), "distance2")
