"""Vectorised word hashing, and compact blobs of sorted 64-bit keys.

Keys travel between tasks as blobs: one blob for each (chunk of documents,
range of hash values).  A blob holds sorted distinct keys as byte planes of
their differences, so a 48-bit key takes about four bytes in place of a row.
Ranges are equal parts of the hash space, so no word, document or source can
make one of them hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15 | 1)
_SPAN = 1 << 20
#: Bytes that end a word: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Kinds of bytes: 0 ends a word, a change between other kinds starts the next one.
BY_SPACE = np.where(_SPACE, 0, 1).astype(np.int8)
#: Letters, digits and non-ASCII characters apart from runs of other signs.
BY_SIGNS = np.array([0 if _SPACE[b] else 1 if b >= 0x80 or chr(b).isalnum() or b == 0x5F else 2 for b in range(256)], np.int8)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = 1 << max(21, int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, m in (("p", int(_MULT)), ("q", pow(int(_MULT), -1, 1 << 64))):
                out = np.full(size, m, U)
                out[0] = 1
                _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chain(*parts: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of several hash columns."""
    out = np.zeros(1, U)
    for k, part in enumerate(parts):
        out = mix(out * U(0x9E3779B97F4A7C15) + part + U(k + 1))
    return out


def word_hashes(text: bytes, kinds: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of ``text`` (already lower case): runs of bytes of one of ``kinds``.

    The hash of a word is a polynomial of its bytes modulo 2^64, taken from
    prefix sums, then mixed.  Long texts are cut at white space so that memory
    stays bounded; only a single word longer than a span is taken whole.
    """
    hashes, starts, at = [], [], 0
    while at < len(text):
        end = at + _SPAN
        if end < len(text):
            a = np.frombuffer(text, np.uint8, offset=end)
            step = 4096
            while True:
                found = np.flatnonzero(_SPACE[a[:step]])
                if len(found) or step >= len(a):
                    break
                step *= 8
            end = end + int(found[0]) if len(found) else len(text)
        a = np.frombuffer(text, np.uint8, count=min(end, len(text)) - at, offset=at)
        kind = np.zeros(len(a) + 2, np.int8)
        np.take(kinds, a, out=kind[1:-1])
        turn = kind[1:] != kind[:-1]
        s, e = np.flatnonzero(turn & (kind[1:] > 0)), np.flatnonzero(turn & (kind[:-1] > 0))
        if len(s):
            p, q = _powers(len(a) + 1)
            with np.errstate(over="ignore"):
                sums = np.zeros(len(a) + 1, U)
                np.cumsum((a.astype(U) + U(1)) * p[: len(a)], out=sums[1:])
                hashes.append(mix((sums[e] - sums[s]) * q[s] + (e - s).astype(U)))
            starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def pack(x: np.ndarray) -> bytes:
    """A blob of unsigned integers: only as many byte planes as the largest needs."""
    if not len(x):
        return b""
    x = np.ascontiguousarray(x, U)
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes | None) -> np.ndarray:
    if not blob:
        return np.empty(0, U)
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(U).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)) if len(keys) else keys)


def unpack_sorted(blob: bytes | None) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=U)


def ranges(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """``parts + 1`` offsets that cut sorted keys of ``bits`` bits into equal ranges of the hash space."""
    edges = np.array([(b << bits) // parts for b in range(1, parts)], U) if parts > 1 else np.empty(0, U)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their counts."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def lower_utf8(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case (other letters stay); null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def batches(table, *names: str) -> Iterator[list]:
    yield from zip(*(table.column(n).to_pylist() for n in names), strict=True)
