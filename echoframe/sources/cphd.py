"""Compensated phase history files (frequency domain), read as one row a pulse and written from such rows.

A file is a text header of KEY := VALUE lines, an XML block, per-vector
parameters and the signal array.  Options: ``channel`` (number, identifier or
polarization), ``pulses`` ("first:last"), ``samples`` ("first:last"),
``metadata`` ("true": parameters only, the signal is not touched), ``trim``
("true": pulses without finite positions or signal go from both ends, and
positions between are read linearly), ``rows`` (pulses a partition).  Samples of
a file whose phase sign is +1 are conjugated.  The driver reads header and XML;
each partition reads its own range of pulses.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Sample formats and parameter formats of the file's specification.
SAMPLES = {"CI2": ">i1", "CI4": ">i2", "CF8": ">f4"}
_NUMBER = {"I1": ">i1", "I2": ">i2", "I4": ">i4", "I8": ">i8", "U1": ">u1", "U2": ">u2", "U4": ">u4", "U8": ">u8", "F4": ">f4", "F8": ">f8", "CI2": (">i1", 2), "CI4": (">i2", 2), "CI8": (">i4", 2), "CF8": ">c8", "CF16": ">c16"}
SCHEMA = "channel string, p bigint, tx array<double>, rcv array<double>, srp array<double>, tx_time double, sc0 double, scss double, re array<float>, im array<float>"


def read_header(path: str) -> dict[str, str]:
    """The KEY := VALUE lines up to the form feed."""
    with open(path, "rb") as f:
        head = f.read(65536)
    if not head.startswith(b"CPHD/"):
        raise ValueError(f"{path}: not a CPHD file")
    text, mark, _ = head.partition(b"\x0c\n")
    if not mark:
        raise ValueError(f"{path}: the header does not end")
    try:
        lines = text.decode("ascii").split("\n")
    except UnicodeDecodeError:
        raise ValueError(f"{path}: the header is not text") from None
    out = {"version": lines[0].partition("/")[2].strip()}
    for line in lines[1:]:
        key, sep, value = line.partition(" := ")
        if sep:
            out[key.strip()] = value.strip()
    return out


def _number(path: str, header: dict[str, str], key: str) -> int:
    try:
        value = int(header[key])
    except KeyError:
        raise ValueError(f"{path}: the header has no {key}") from None
    except ValueError:
        raise ValueError(f"{path}: {key} is not a number") from None
    if value < 0:
        raise ValueError(f"{path}: {key} is negative")
    return value


def parameter_type(pvp: ET.Element, path: str) -> np.dtype:
    """The record type that the XML states: Offset, Size (words of 8 bytes) and Format of each parameter."""
    names, formats, offsets = [], [], []
    for e in pvp.iter():
        offset, size, kind = (e.find(f"{{*}}{k}") for k in ("Offset", "Size", "Format"))
        if offset is None or size is None or kind is None:
            continue
        name = e.findtext("{*}Name") or e.tag.rpartition("}")[2]
        parts = [x for x in kind.text.strip().split(";") if x]
        if len(parts) > 1:
            types = [_NUMBER.get(x.partition("=")[2]) for x in parts]
            if None in types or len(set(map(str, types))) > 1:
                raise ValueError(f"{path}: {name} has the unknown format {kind.text}")
            one = (types[0], (len(parts),))
        elif parts and parts[0].startswith("S") and parts[0][1:].isdigit():
            one = f"S{parts[0][1:]}"
        elif parts and parts[0] in _NUMBER:
            one = _NUMBER[parts[0]]
        else:
            raise ValueError(f"{path}: {name} has the unknown format {kind.text}")
        if np.dtype(one).itemsize > int(size.text) * 8:
            raise ValueError(f"{path}: {name} does not fit its size")
        names.append(name)
        formats.append(one)
        offsets.append(int(offset.text) * 8)
    return names, formats, offsets


@dataclass
class Layout:
    """What a reader needs to know of one channel."""

    path: str
    channel: str
    pulses: int
    samples: int
    sample_type: str
    record: np.dtype
    record_at: int
    signal_at: int
    conjugate: bool = False


def _channel(root: ET.Element, channels: list[ET.Element], wanted: str, path: str) -> int:
    """A channel by number, identifier or polarization (transmit and receive, such as HV)."""
    names = [(c.findtext("{*}Identifier") or "").strip() for c in channels]
    if wanted in names:
        return names.index(wanted)
    if wanted.lstrip("-").isdigit():
        return int(wanted)
    for p in root.iterfind("{*}Channel/{*}Parameters"):
        polarization = "".join((p.findtext(f"{{*}}Polarization/{{*}}{k}") or "").strip() for k in ("TxPol", "RcvPol"))
        name = (p.findtext("{*}Identifier") or "").strip()
        if polarization and polarization == wanted.replace(":", "") and name in names:
            return names.index(name)
    raise ValueError(f"{path}: no channel {wanted}")


def support(path: str, name: str) -> np.ndarray:
    """A support array by its identifier, [rows, columns] in its element format."""
    header, root = read_header(path), _tree(path)
    for e in root.iterfind("{*}Data/{*}SupportArray"):
        if (e.findtext("{*}Identifier") or "").strip() == name:
            rows, columns, at, width = (int(e.findtext(f"{{*}}{k}") or "0") for k in ("NumRows", "NumCols", "ArrayByteOffset", "BytesPerElement"))
            kind = next(((d.findtext("{*}ElementFormat") or "").strip() for d in root.iterfind("{*}SupportArray/*") if (d.findtext("{*}Identifier") or "").strip() == name), "")
            parts = [x.partition("=")[2] or x for x in kind.split(";") if x]
            if not parts or any(x not in _NUMBER for x in parts):
                raise ValueError(f"{path}: support array {name} has the unknown format {kind!r}")
            record = np.dtype([(f"f{k}", _NUMBER[x]) for k, x in enumerate(parts)]) if len(parts) > 1 else np.dtype(_NUMBER[parts[0]])
            start = _number(path, header, "SUPPORT_BLOCK_BYTE_OFFSET")
            if record.itemsize != width or at + rows * columns * width > _number(path, header, "SUPPORT_BLOCK_SIZE"):
                raise ValueError(f"{path}: support array {name} does not fit its block")
            with open(path, "rb") as f:
                f.seek(start + at)
                return np.frombuffer(f.read(rows * columns * width), record).reshape(rows, columns)
    raise ValueError(f"{path}: no support array {name}")


def _tree(path: str) -> ET.Element:
    header = read_header(path)
    with open(path, "rb") as f:
        f.seek(_number(path, header, "XML_BLOCK_BYTE_OFFSET"))
        raw = f.read(_number(path, header, "XML_BLOCK_SIZE"))
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError(f"{path}: the XML declares entities")
    try:
        return ET.fromstring(raw)
    except ET.ParseError as error:
        raise ValueError(f"{path}: the XML cannot be read: {error}") from None


def layout(path: str, channel: int | str) -> Layout:
    """Header and XML of a file, checked against its size."""
    import os

    header = read_header(path)
    size = os.path.getsize(path)
    for block in ("XML", "PVP", "SIGNAL"):
        at, n = _number(path, header, f"{block}_BLOCK_BYTE_OFFSET"), _number(path, header, f"{block}_BLOCK_SIZE")
        if at + n > size:
            raise ValueError(f"{path}: the {block} block ends beyond the file")
    root = _tree(path)
    if (root.findtext("{*}Global/{*}DomainType") or "FX") != "FX":
        raise ValueError(f"{path}: only frequency-domain signals can be read")
    data = root.find("{*}Data")
    channels = [] if data is None else data.findall("{*}Channel")
    channel = _channel(root, channels, str(channel), path)
    if not 0 <= channel < len(channels):
        raise ValueError(f"{path}: no channel {channel}")
    c = channels[channel]
    get = lambda e, k: int(e.findtext(f"{{*}}{k}") or "0")
    kind = (data.findtext("{*}SignalArrayFormat") or "").strip()
    if kind not in SAMPLES:
        raise ValueError(f"{path}: the sample format {kind!r} is unknown")
    names, formats, offsets = parameter_type(root.find("{*}PVP"), path)
    width = get(data, "NumBytesPVP")
    try:
        record = np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": width})
    except ValueError as error:
        raise ValueError(f"{path}: the parameters do not fit their record: {error}") from None
    out = Layout(path, (c.findtext("{*}Identifier") or "").strip(), get(c, "NumVectors"), get(c, "NumSamples"), SAMPLES[kind], record, int(header["PVP_BLOCK_BYTE_OFFSET"]) + get(c, "PVPArrayByteOffset"), int(header["SIGNAL_BLOCK_BYTE_OFFSET"]) + get(c, "SignalArrayByteOffset"), (root.findtext("{*}Global/{*}SGN") or "-1").strip() in ("1", "+1"))
    if out.record_at + out.pulses * width > size or out.signal_at + out.pulses * out.samples * 2 * np.dtype(out.sample_type).itemsize > size:
        raise ValueError(f"{path}: the arrays end beyond the file")
    return out


@dataclass
class _Range(InputPartition):
    first: int
    last: int


def _bounds(text: str | None, n: int, path: str) -> tuple[int, int]:
    if not text:
        return 0, n
    a, sep, b = text.partition(":")
    lo, hi = int(a or 0), int(b or n) if sep else int(a) + 1
    if not 0 <= lo < hi <= n:
        raise ValueError(f"{path}: the range {text} is outside 0:{n}")
    return lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.layout = layout(options["path"].removeprefix("file:"), options.get("channel", "0"))
        self.pulses = _bounds(options.get("pulses"), self.layout.pulses, self.layout.path)
        self.samples = _bounds(options.get("samples"), self.layout.samples, self.layout.path)
        self.metadata = options.get("metadata", "false").lower() == "true"
        self.rows = int(options.get("rows", 1024))
        self.trim = options.get("trim", "false").lower() == "true"
        self.places: dict[str, np.ndarray] = {}
        if self.trim:
            lo, hi = self.pulses
            with open(self.layout.path, "rb") as f:
                f.seek(self.layout.record_at + lo * self.layout.record.itemsize)
                r = np.frombuffer(f.read((hi - lo) * self.layout.record.itemsize), self.layout.record)
            good = np.ones(hi - lo, bool)
            for name in ("TxPos", "RcvPos", "SRPPos"):
                if name in self.layout.record.names:
                    good &= np.isfinite(r[name].astype(np.float64)).all(1)
            signal = r["SIGNAL"] != 0 if "SIGNAL" in self.layout.record.names else np.ones(hi - lo, bool)
            some = np.flatnonzero(good & signal)
            if not len(some):
                raise ValueError(f"{self.layout.path}: no pulse has finite positions and a signal")
            at = np.arange(hi - lo)
            for name in ("TxPos", "RcvPos", "SRPPos"):
                if name in self.layout.record.names:
                    v = r[name].astype(np.float64)
                    self.places[name] = np.stack([np.interp(at, at[good], v[good, c]) for c in range(3)], 1)
            self.base, self.pulses = lo, (lo + int(some[0]), lo + int(some[-1]) + 1)

    def partitions(self) -> list[InputPartition]:
        lo, hi = self.pulses
        return [_Range(a, min(hi, a + self.rows)) for a in range(lo, hi, self.rows)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        x, (lo, hi) = self.layout, self.samples
        n = part.last - part.first
        with open(x.path, "rb") as f:
            f.seek(x.record_at + part.first * x.record.itemsize)
            r = np.frombuffer(f.read(n * x.record.itemsize), x.record)
            width = 2 * np.dtype(x.sample_type).itemsize
            vectors = {k: [None] * n for k in ("re", "im")}
            if not self.metadata:
                scale = r["AmpSF"].astype(np.float64) if "AmpSF" in x.record.names else np.ones(n)
                for k in range(n):
                    f.seek(x.signal_at + (part.first + k) * x.samples * width + lo * width)
                    z = np.frombuffer(f.read((hi - lo) * width), x.sample_type).astype(np.float64).reshape(-1, 2) * scale[k]
                    vectors["re"][k], vectors["im"][k] = z[:, 0].astype(np.float32), (-z[:, 1] if x.conjugate else z[:, 1]).astype(np.float32)
        if self.places:
            places = {name: v[part.first - self.base : part.last - self.base].tolist() for name, v in self.places.items()}
        else:
            places = {}
        point = lambda name: places[name] if name in places else [v.tolist() for v in r[name].astype(np.float64)] if name in x.record.names else [None] * n
        value = lambda name: r[name].astype(np.float64).tolist() if name in x.record.names else [None] * n
        three, one, many = pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float32())
        sc0 = value("SC0")
        step = value("SCSS")
        sc0 = [a if a is None or b is None else a + lo * b for a, b in zip(sc0, step, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.channel] * n), pa.array(range(part.first, part.last), pa.int64()), *(pa.array(point(k), three) for k in ("TxPos", "RcvPos", "SRPPos")), *(pa.array(v, one) for v in (value("TxTime"), sc0, step)), *(pa.array(vectors[k], many) for k in ("re", "im"))],
            names=["channel", "p", "tx", "rcv", "srp", "tx_time", "sc0", "scss", "re", "im"],
        )


class CphdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cphd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


_FIELDS = (("TxTime", 1, "F8"), ("TxPos", 3, "X=F8;Y=F8;Z=F8;"), ("RcvPos", 3, "X=F8;Y=F8;Z=F8;"), ("SRPPos", 3, "X=F8;Y=F8;Z=F8;"), ("SC0", 1, "F8"), ("SCSS", 1, "F8"))


def write(df: DataFrame, path: str, channel: str = "1") -> None:
    """Write pulses (p, tx, rcv, srp, tx_time, sc0, scss, re, im) as one file of one channel, CF8 samples.

    A single file is written by the driver, a pulse at a time as the rows arrive in order.
    """
    rows = df.orderBy("p").select("tx", "rcv", "srp", "tx_time", "sc0", "scss", "re", "im")
    facts = df.selectExpr("count(*)", "max(size(re))", "min(size(re))").first()
    n, k = facts[0], facts[1]
    if not n or facts[1] != facts[2]:
        raise ValueError(f"{path}: pulses of one length are needed")
    width = sum(size for _, size, _ in _FIELDS) * 8
    offset, pvp = 0, ""
    for name, size, kind in _FIELDS:
        pvp += f"<{name}><Offset>{offset}</Offset><Size>{size}</Size><Format>{kind}</Format></{name}>"
        offset += size
    xml = f'<?xml version="1.0"?><CPHD xmlns="http://api.nsgreg.nga.mil/schema/cphd/1.0.1"><Global><DomainType>FX</DomainType><SGN>-1</SGN></Global><Data><SignalArrayFormat>CF8</SignalArrayFormat><NumBytesPVP>{width}</NumBytesPVP><NumCPHDChannels>1</NumCPHDChannels><Channel><Identifier>{channel}</Identifier><NumVectors>{n}</NumVectors><NumSamples>{k}</NumSamples><SignalArrayByteOffset>0</SignalArrayByteOffset><PVPArrayByteOffset>0</PVPArrayByteOffset></Channel></Data><PVP>{pvp}</PVP></CPHD>'.encode()
    sizes = {"XML": len(xml), "PVP": n * width, "SIGNAL": n * k * 8}
    start, at = 2048, {}
    for block, size in sizes.items():
        at[block] = start
        start = -(-(start + size + 2) // 64) * 64
    head = "CPHD/1.0.1\n" + "".join(f"{b}_BLOCK_SIZE := {sizes[b]}\n{b}_BLOCK_BYTE_OFFSET := {at[b]}\n" for b in sizes) + "CLASSIFICATION := UNCLASSIFIED\nRELEASE_INFO := UNRESTRICTED\n\x0c\n"
    with open(path, "wb") as f:
        f.write(head.encode())
        f.seek(at["XML"])
        f.write(xml + b"\x0c\n")
        for p, r in enumerate(rows.toLocalIterator()):
            f.seek(at["PVP"] + p * width)
            f.write(np.array([r.tx_time, *r.tx, *r.rcv, *r.srp, r.sc0, r.scss], ">f8").tobytes())
            f.seek(at["SIGNAL"] + p * k * 8)
            f.write(np.column_stack([r.re, r.im]).astype(">f4").tobytes())
