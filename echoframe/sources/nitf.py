"""NITF 2.1 images of complex float pixels (32-bit real and imaginary parts), read by format ``nitf``, and a writer.

One row a line: segment, i, re, im.  Only uncompressed single-block segments
are read.  The writer splits an image in segments of whole rows within the
format's limits and stores the metadata XML as a data extension.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The limits of an image segment.
MOST_ROWS, MOST_BYTES = 99_999, 9_999_999_998
_SECURITY = "U" + " " * 166


def segments(rows: int, columns: int, pixel_bytes: int, most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS) -> list[tuple[int, int]]:
    """Row bounds of the segments of an image: as many whole rows as both limits allow."""
    step = min(most_rows, most_bytes // (columns * pixel_bytes))
    if step < 1:
        raise ValueError(f"one row of {columns} pixels exceeds an image segment")
    return [(a, min(rows, a + step)) for a in range(0, rows, step)]


def _image_header(number: int, first: int, rows: int, columns: int) -> bytes:
    level = f"{number + 1:03d}" + (f"{number:03d}" if number else "000") + (f"{first:05d}" if number else "00000") + "00000"
    text = "IM" + f"IMG{number + 1:03d}".ljust(10) + "20240101000000" + " " * 17 + " " * 80 + _SECURITY + "0" + " " * 42
    text += f"{rows:08d}{columns:08d}" + "R  " + "NODISPLY" + "SAR     " + "32" + "R" + " " + "0" + "NC" + "2"
    for part in "IQ":
        text += " " * 2 + part.ljust(6) + "N" + " " * 3 + "0"
    return (text + "0" + "P" + "0001" + "0001" + f"{columns if columns <= 8192 else 0:04d}{rows if rows <= 8192 else 0:04d}" + "32" + level + "1.0 " + "00000" + "00000").encode()


def write(lines: DataFrame, path: str, xml: bytes = b"<SICD/>", most_rows: int = MOST_ROWS) -> None:
    """Write lines (line, re, im) as one file; the driver writes rows in order as they arrive."""
    facts = lines.selectExpr("count(*)", "max(size(re))", "min(size(re))").first()
    rows, columns = facts[0], facts[1]
    if not rows or facts[1] != facts[2]:
        raise ValueError(f"{path}: lines of one length are needed")
    parts = segments(rows, columns, 8, most_rows=most_rows)
    headers = [_image_header(k, a if k == 0 else a - parts[k - 1][0], b - a, columns) for k, (a, b) in enumerate(parts)]
    extension = ("DE" + "XML_DATA_CONTENT".ljust(25) + "01" + _SECURITY + "0000").encode()
    images = "".join(f"{len(h):06d}{(b - a) * columns * 8:010d}" for h, (a, b) in zip(headers, parts, strict=True))
    tail = "000" + "000" + "000" + "001" + f"{len(extension):04d}{len(xml):09d}" + "000" + "00000" + "00000"
    front = "NITF02.10" + "09" + "BF01" + "ECHOFRAME".ljust(10) + "20240101000000" + " " * 80 + _SECURITY + "00000" + "00000" + "0" + "\0\0\0" + " " * 24 + " " * 18
    body = f"{len(parts):03d}" + images + tail
    length = len(front) + 12 + 6 + len(body)
    total = length + sum(map(len, headers)) + rows * columns * 8 + len(extension) + len(xml)
    with open(path, "wb") as f:
        f.write((front + f"{total:012d}{length:06d}" + body).encode("latin-1"))
        k = -1
        for n, r in enumerate(lines.orderBy("line").toLocalIterator()):
            if k < 0 or n >= parts[k][1]:
                k += 1
                f.write(headers[k])
            f.write(np.column_stack([r.re, r.im]).astype(">f4").tobytes())
        f.write(extension + xml)


@dataclass
class Segment:
    at: int
    rows: int
    columns: int
    first: int


def read_layout(path: str) -> tuple[list[Segment], bytes]:
    """Image segments and the XML of the first data extension, checked against the file."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(min(size, 1 << 20))

        def number(at: int, n: int, what: str) -> int:
            text = head[at : at + n]
            if len(text) < n or not text.isdigit():
                raise ValueError(f"{path}: {what} is not a number")
            return int(text)

        if head[:9] != b"NITF02.10":
            raise ValueError(f"{path}: not a NITF 2.1 file")
        total, length = number(342, 12, "the file length"), number(354, 6, "the header length")
        if total > size:
            raise ValueError(f"{path}: the file is cut short")
        n, at = number(360, 3, "the number of images"), 363
        sizes = []
        for _ in range(n):
            sizes.append((number(at, 6, "an image header length"), number(at + 6, 10, "an image length")))
            at += 16
        if head[at : at + 9] != b"000000000":
            raise ValueError(f"{path}: graphics and text segments cannot be read")
        at += 9
        extensions = []
        for _ in range(number(at, 3, "the number of extensions")):
            extensions.append((number(at + 3 + 13 * len(extensions), 4, "an extension header length"), number(at + 7 + 13 * len(extensions), 9, "an extension length")))
        place, out, first = length, [], 0
        for h, body in sizes:
            f.seek(place)
            sub = f.read(h)
            if sub[:2] != b"IM" or len(sub) < h or place + h + body > size:
                raise ValueError(f"{path}: an image segment is damaged")
            rows, columns = int(sub[333:341]), int(sub[341:349])
            if sub[349:352].strip() != b"R" or b"NC2" not in sub or rows * columns * 8 != body:
                raise ValueError(f"{path}: only uncompressed complex float images can be read")
            out.append(Segment(place + h, rows, columns, first))
            first += rows
            place += h + body
        xml = b""
        if extensions:
            f.seek(place + extensions[0][0])
            xml = f.read(extensions[0][1])
    return out, xml


@dataclass
class _Part(InputPartition):
    segment: int
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file:")
        self.segments, _ = read_layout(self.path)
        self.rows = int(options.get("rows", 1024))

    def partitions(self) -> list[InputPartition]:
        return [_Part(k, a, min(s.rows, a + self.rows)) for k, s in enumerate(self.segments) for a in range(0, s.rows, self.rows)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        s = self.segments[part.segment]
        with open(self.path, "rb") as f:
            f.seek(s.at + part.first * s.columns * 8)
            z = np.frombuffer(f.read((part.last - part.first) * s.columns * 8), ">f4").astype(np.float32).reshape(part.last - part.first, s.columns, 2)
        many = pa.list_(pa.float32())
        yield pa.RecordBatch.from_arrays([pa.array([part.segment] * len(z), pa.int32()), pa.array(range(s.first + part.first, s.first + part.last), pa.int64()), *(pa.array([row[:, k].copy() for row in z], many) for k in (0, 1))], names=["segment", "line", "re", "im"])


class NitfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nitf"

    def schema(self) -> str:
        return "segment int, line bigint, re array<float>, im array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
