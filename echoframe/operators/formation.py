"""Echo simulation and image formation as joins with complex sums.

``simulate`` and ``backproject`` are the exact theta joins of pulses with
scatterers or points, dealt by (block of pulses, block of points): each is one
task-sized product in NumPy, and partial sums meet by pulse or point.
``form_image`` reads range profiles tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import C
from .steps import dealt


#: Bytes that a block of pulses or points takes in a task.
_BLOCK = 8 << 20


def _blocks(df: DataFrame, key: str, bytes_each: int, columns: list[str], rows: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Rows dealt by hash to blocks of about ``_BLOCK`` bytes: one row (block, rows) for each; and the number of blocks.

    ``rows`` is a table of as many rows that costs less to count.  Blocks are much work in few bytes, so their
    tasks are a number that is kept.
    """
    n = max(1, (df if rows is None else rows).count() * bytes_each // _BLOCK)
    placed = df.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("block"), *columns)
    tasks = min(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("rows")), n


def _paired(pulses: tuple[DataFrame, int], places: tuple[DataFrame, int], name: str) -> DataFrame:
    """Every block of pulses (mine) with every block of places (``name``); few blocks of places (512 KB each) go to all tasks."""
    mine, those = pulses[0].select(F.col("rows").alias("mine")), places[0].select(F.col("rows").alias(name))
    return mine.crossJoin(F.broadcast(those) if places[1] <= min(64, pulses[1]) else those)


def _phasors(dr: np.ndarray, fmin: float, df: float, k: int, sign: int) -> Iterator[tuple[int, np.ndarray]]:
    """exp(2 pi j sign 2 f dr / c) for the frequencies in turn: a running product, set anew every 64."""
    turn = lambda f: np.exp(2j * np.pi * ((x := sign * 2 * f / C * dr) - np.rint(x)))
    step = turn(df)
    for n in range(k):
        now = turn(fmin + n * df) if n % 64 == 0 else now * step
        yield n, now


def _range_difference(points: np.ndarray, antenna: np.ndarray) -> np.ndarray:
    """[antenna, point]: the range of each point less that of the origin."""
    return np.linalg.norm(points[None] - antenna[:, None], axis=-1) - np.linalg.norm(antenna, axis=-1)[:, None]


def _fields(rows: list[dict], *names: str) -> np.ndarray:
    return np.array([[r[n] for n in names] for r in rows], np.float64).reshape(len(rows), len(names))


def simulate(scatterers: DataFrame, pulses: DataFrame, fmin: float, df: float, k: int) -> DataFrame:
    """Phase history (p, k, re, im): the sum over scatterers (x, y, z, amp) of amp exp(-4 pi j f dR / c).

    Every pulse (p, ax, ay, az) meets every scatterer, which is what the sum is: blocks of pulses and
    blocks of scatterers are paired, each pair is one NumPy product, and partial sums meet by pulse.
    Scatterers at one place are one with the sum of their amplitudes.
    """

    def echoes(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for mine, scene in zip(table.column("mine").to_pylist(), table.column("scene").to_pylist(), strict=True):
                s = _fields(scene, "x", "y", "z", "amp")
                out = np.empty((k, len(mine)), np.complex128)
                dr = _range_difference(s[:, :3], _fields(mine, "ax", "ay", "az"))
                for n, phase in _phasors(dr, fmin, df, k, -1):
                    out[n] = phase @ s[:, 3]
                yield pa.RecordBatch.from_arrays([pa.array([r["p"] for r in mine], pa.int64()), pa.array(list(out.real.T)), pa.array(list(out.imag.T))], names=["p", "re", "im"])

    few = pulses.select(F.col("p").cast("long").alias("p"), "ax", "ay", "az")
    # a block holds at most 256 pulses, so that [pulse, scatterer] arrays stay below 256 x 16,384 numbers
    mine = _blocks(few, "p", _BLOCK // 256, ["p", "ax", "ay", "az"])
    places = scatterers.groupBy("x", "y", "z").agg(F.sum("amp").alias("amp"))
    scene = _blocks(places.select("x", "y", "z", "amp", F.hash("x", "y", "z").alias("h")), "h", _BLOCK // 16384, ["x", "y", "z", "amp"])
    sums = _paired(mine, scene, "scene").mapInArrow(echoes, "p long, re array<double>, im array<double>")
    each = sums.select("p", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
    return each.groupBy("p", "k").agg(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"))


def backproject(history: DataFrame, pulses: DataFrame, points: DataFrame, fmin: float, df: float) -> DataFrame:
    """Image values (id, re, im) of points (id, x, y, z): the sum over samples of S exp(+4 pi j f dR / c).

    Blocks of pulses meet blocks of points; partial images of a block are summed by point, whatever their number.
    """

    def images(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for mine, at in zip(table.column("mine").to_pylist(), table.column("at").to_pylist(), strict=True):
                s = np.array([r["re"] for r in mine]) + 1j * np.array([r["im"] for r in mine])
                total = np.zeros(len(at), np.complex128)
                dr = _range_difference(_fields(at, "x", "y", "z"), _fields(mine, "ax", "ay", "az"))
                for n, phase in _phasors(dr, fmin, df, s.shape[1], 1):
                    total += s[:, n] @ phase
                yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in at], pa.int64()), pa.array(total.real), pa.array(total.imag)], names=["id", "re", "im"])

    row = F.sort_array(F.collect_list(F.struct("k", "re", "im")))
    lines = history.groupBy("p").agg(row.alias("v")).select("p", F.col("v.re").alias("re"), F.col("v.im").alias("im")).join(pulses, "p")
    mine = _blocks(lines, "p", _BLOCK // 256, ["ax", "ay", "az", "re", "im"], pulses)
    at = _blocks(points.select(F.col("id").cast("long").alias("id"), "x", "y", "z"), "id", _BLOCK // 16384, ["id", "x", "y", "z"])
    return _paired(mine, at, "at").mapInArrow(images, "id long, re double, im double").groupBy("id").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


_TILE = pa.schema([("ti", pa.int64()), ("tj", pa.int64()), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])


def _tiles(plan: dict):
    """Partial tiles of the pulses of a task: profiles once for a run of pulses, then one tile after the other."""
    e1, e2, t = np.array(plan["e1"]), np.array(plan["e2"]), plan["tile"]

    def image(run: list[dict]) -> Iterator[pa.RecordBatch]:
        s = np.array([r["re"] for r in run]) + 1j * np.array([r["im"] for r in run])
        a = _fields(run, "ax", "ay", "az")
        k = s.shape[1]
        h, n = k // 2, 1 << int(np.ceil(np.log2(plan["upsample"] * k)))
        padded = np.zeros((len(run), n), np.complex128)
        padded[:, : k - h], padded[:, n - h :] = s[:, h:], s[:, :h]
        profile = np.fft.fftshift(np.fft.ifft(padded, axis=1), axes=1) * n
        for ti in range(-(-plan["nx"] // t)):
            for tj in range(-(-plan["ny"] // t)):
                i, j = np.meshgrid(np.arange(ti * t, (ti + 1) * t), np.arange(tj * t, (tj + 1) * t), indexing="ij")
                x = (((i - plan["nx"] / 2) * plan["spx"])[..., None] * e1 + ((j - plan["ny"] / 2) * plan["spy"])[..., None] * e2).reshape(-1, 3)
                total = np.zeros(t * t, np.complex128)
                for antenna, line in zip(a, profile, strict=True):
                    dr = _range_difference(x, antenna[None])[0]
                    at = np.mod(dr * (2 * plan["df"] * n / C) + n / 2, n)
                    low = np.floor(at).astype(np.int64)
                    f = at - low
                    cycles = 2 * (plan["fmin"] + h * plan["df"]) / C * dr
                    total += ((1 - f) * line[low % n] + f * line[(low + 1) % n]) * np.exp(2j * np.pi * (cycles - np.rint(cycles)))
                yield pa.RecordBatch.from_arrays([pa.array([ti]), pa.array([tj]), pa.array([total.real]), pa.array([total.imag])], schema=_TILE)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for table in tables:
            for r in table.to_pylist():
                held.append(r)
                if len(held) >= max(1, plan["run_bytes"] // (16 * 2 * plan["upsample"] * len(r["re"]))):
                    yield from image(held)
                    held = []
        if held:
            yield from image(held)

    return run


def _sum_tiles(table: pa.Table) -> pa.Table:
    """One tile from its partial sums, added one at a time."""
    total = [0.0, 0.0]
    for r in range(table.num_rows):
        for k, name in enumerate(("re", "im")):
            total[k] = total[k] + table.column(name)[r].values.to_numpy()
    return pa.Table.from_arrays([table.column("ti")[:1], table.column("tj")[:1], *(pa.array([v]) for v in total)], schema=_TILE)


def form_image(lines: DataFrame, *, fmin: float, df: float, nx: int, ny: int, spx: float, spy: float, e1=(1.0, 0.0, 0.0), e2=(0.0, 1.0, 0.0), tile: int = 64, upsample: int = 8, run_bytes: int = 128 << 20) -> DataFrame:
    """Pixels (i, j, re, im) from pulses (p, ax, ay, az, re array, im array).

    Range profiles are zero-padded inverse transforms read linearly.  A task makes the profiles of a run
    of pulses once (``run_bytes``) and gives one partial tile after the other, so it never holds an
    image; tiles meet as arrays, one exchange of as many rows as tiles times runs.
    """
    plan = {"fmin": fmin, "df": df, "nx": nx, "ny": ny, "spx": spx, "spy": spy, "e1": e1, "e2": e2, "tile": tile, "upsample": upsample, "run_bytes": run_bytes}
    schema = "ti long, tj long, re array<double>, im array<double>"
    tiles = dealt(lines, "p").select("ax", "ay", "az", "re", "im").mapInArrow(_tiles(plan), schema).groupBy("ti", "tj").applyInArrow(_sum_tiles, schema)
    pixels = tiles.select("ti", "tj", F.posexplode(F.arrays_zip("re", "im")).alias("n", "v"))
    i, j = F.col("ti") * tile + F.floor(F.col("n") / tile), F.col("tj") * tile + F.col("n") % tile
    return pixels.select(i.alias("i"), j.alias("j"), F.col("v.re").alias("re"), F.col("v.im").alias("im")).filter((F.col("i") < nx) & (F.col("j") < ny))
