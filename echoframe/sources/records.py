"""Fixed records and metadata trees: CEOS records, XML metadata, and georeferenced rasters."""

from __future__ import annotations

import json
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ceos_records(files: DataFrame) -> DataFrame:
    """(path, number, kind, at, length) of the records of CEOS files (path, content), as of Spark's binaryFile format.

    A record begins with its number, four type bytes and its length, big-endian.  A length below 12 or beyond
    the file is an error that names the file.
    """

    def walk(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = []
            for path, content in zip(table.column("path").to_pylist(), table.column("content").to_pylist(), strict=True):
                at = 0
                while at < len(content):
                    if at + 12 > len(content):
                        raise ValueError(f"{path}: the file ends within a record's head")
                    number, kind, length = struct.unpack(">i4si", content[at : at + 12])
                    if length < 12 or at + length > len(content):
                        raise ValueError(f"{path}: record {number} has the length {length}")
                    rows.append((path, number, kind, at, length))
                    at += length
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "number", "kind", "at", "length"])

    return files.select("path", "content").mapInArrow(walk, "path string, number long, kind binary, at long, length long")


def fixed_field(record: str, at: int, width: int, kind: str = "double"):
    """A text field of a binary record column, blanks removed; null where it is empty or no number."""
    text = F.trim(F.decode(F.substring(F.col(record), at + 1, width), "US-ASCII"))
    return text if kind == "string" else F.when(text != "", F.expr(f"try_cast(trim(decode(substring({record}, {at + 1}, {width}), 'US-ASCII')) as {kind})"))


def metadata_tree(xml: bytes, path: str = "metadata") -> dict:
    """An XML document as nested dictionaries; repeated elements are lists; attributes stand under their name with @.

    Documents that declare types or entities are refused.
    """
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError(f"{path}: the XML declares entities")
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as error:
        raise ValueError(f"{path}: the XML cannot be read: {error}") from None

    def value(e: ET.Element):
        out: dict = {f"@{k}": v for k, v in e.attrib.items()}
        for child in e:
            name = child.tag.rpartition("}")[2]
            if name in out:
                out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value(child)]
            else:
                out[name] = value(child)
        text = (e.text or "").strip()
        return out | ({"#": text} if text else {}) if out else text

    return {root.tag.rpartition("}")[2]: value(root), "namespace": root.tag[1:].partition("}")[0] if root.tag.startswith("{") else ""}


def metadata_rows(spark, xml: bytes, path: str = "metadata") -> DataFrame:
    """(name, value) of every leaf, names joined by dots and list places."""

    def leaves(name: str, v) -> Iterator[tuple[str, str]]:
        if isinstance(v, dict):
            for k, x in v.items():
                yield from leaves(f"{name}.{k}" if name else k, x)
        elif isinstance(v, list):
            for k, x in enumerate(v):
                yield from leaves(f"{name}[{k}]", x)
        else:
            yield name, v

    return spark.createDataFrame(list(leaves("", metadata_tree(xml, path))), "name string, value string")


def image_metadata(shape: tuple[int, int], spacing: tuple[float, float], resolution: tuple[float, float], band: tuple[float, float], center: tuple[float, float, float], antenna: tuple[float, float, float], collector: str = "", window: str = "UNIFORM") -> bytes:
    """A complex image's metadata as XML (SICD 1.3 names): image size, grid with impulse response widths and bandwidths,
    scene centre, radar band and antenna place."""
    point = lambda v: "".join(f"<{n}>{x!r}</{n}>" for n, x in zip("XYZ", map(float, v), strict=True))
    axis = lambda name, ss, wid: f"<{name}><SS>{ss!r}</SS><ImpRespWid>{wid!r}</ImpRespWid><ImpRespBW>{0.886 / wid!r}</ImpRespBW><WgtType><WindowName>{window}</WindowName></WgtType></{name}>"
    body = f"<CollectionInfo><CollectorName>{collector}</CollectorName></CollectionInfo><ImageData><PixelType>RE32F_IM32F</PixelType><NumRows>{shape[1]}</NumRows><NumCols>{shape[0]}</NumCols><FirstRow>0</FirstRow><FirstCol>0</FirstCol><SCPPixel><Row>{shape[1] // 2}</Row><Col>{shape[0] // 2}</Col></SCPPixel></ImageData>"
    body += f"<GeoData><EarthModel>WGS_84</EarthModel><SCP><ECF>{point(center)}</ECF></SCP></GeoData><Grid><ImagePlane>GROUND</ImagePlane><Type>PLANE</Type>{axis('Row', float(spacing[1]), float(resolution[1]))}{axis('Col', float(spacing[0]), float(resolution[0]))}</Grid>"
    body += f"<RadarCollection><TxFrequency><Min>{float(band[0])!r}</Min><Max>{float(band[1])!r}</Max></TxFrequency></RadarCollection><SCPCOA><ARPPos>{point(antenna)}</ARPPos></SCPCOA>"
    return f'<?xml version="1.0"?><SICD xmlns="urn:SICD:1.3.0">{body}</SICD>'.encode()


def write_geotiff(pixels: DataFrame, value: str, path: str, south_west: tuple[float, float], step: tuple[float, float], most_pixels: int = 400_000_000) -> None:
    """Dense pixels (i from the south, j from the west, value) as a float32 GeoTIFF in EPSG:4326, no data as NaN.

    One file is written by the driver row by row from the north, as rows arrive; ``most_pixels`` bounds it.
    """
    rows, columns = (v + 1 for v in pixels.selectExpr("max(i)", "max(j)").first())
    if rows * columns > most_pixels:
        raise ValueError(f"{path}: an image of more than {most_pixels} pixels")
    north = south_west[0] + rows * step[0]
    extra: list[tuple[int, int, bytes]] = [(33550, 12, struct.pack("<3d", step[1], step[0], 0.0)), (33922, 12, struct.pack("<6d", 0, 0, 0, south_west[1], north, 0)), (34735, 3, struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)), (42113, 2, b"nan\0")]
    short = {256: (4, columns), 257: (4, rows), 258: (3, 32), 259: (3, 1), 262: (3, 1), 273: (4, 0), 277: (3, 1), 278: (4, rows), 279: (4, rows * columns * 4), 339: (3, 3)}
    tags = sorted([*short, *(t for t, _, _ in extra)])
    place = 8 + 2 + 12 * len(tags) + 4
    blobs, at = b"", {}
    for tag, _, blob in extra:
        at[tag] = place + len(blobs)
        blobs += blob + b"\0" * (-len(blob) % 8)
    short[273] = (4, place + len(blobs))
    width = {2: 1, 3: 2, 12: 8}
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)))
        kinds = {t: (k, b) for t, k, b in extra}
        for tag in tags:
            if tag in short:
                f.write(struct.pack("<HHII", tag, short[tag][0], 1, short[tag][1]))
            else:
                kind, blob = kinds[tag]
                f.write(struct.pack("<HHI", tag, kind, len(blob) // width[kind]) + (blob if len(blob) == 4 else struct.pack("<I", at[tag])))
        f.write(struct.pack("<I", 0) + blobs)
        line = F.sort_array(F.collect_list(F.struct("j", F.col(value).cast("float").alias("v"))))
        for r in pixels.groupBy("i").agg(line.alias("line")).orderBy(F.col("i").desc()).toLocalIterator():
            out = np.full(columns, np.nan, "<f4")
            for x in r.line:
                out[x.j] = np.nan if x.v is None else x.v
            f.seek(short[273][1] + (rows - 1 - r.i) * columns * 4)
            f.write(out.tobytes())


def write_raster(pixels: DataFrame, path: str, **facts) -> None:
    """Pixels as Parquet with a JSON file of facts (axes, origin, reference system) beside the data: no driver in the way."""
    pixels.write.parquet(path)
    pixels.sparkSession.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}.json")
