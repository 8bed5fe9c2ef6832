"""Arrays and byte strings packed into one compressed value, for rows that travel between stages."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_KINDS = ("u1", "<u2", "<u4", "<u8", "<i4", "<i8", "<f8")


def pack(*parts: np.ndarray | bytes, level: int = 3) -> bytes:
    """Bytes of like weight stand side by side, so that the high ones, mostly zero, compress away."""
    out = []
    for part in parts:
        if isinstance(part, bytes):
            kind, data = 255, part
        else:
            kind, data = _KINDS.index(part.dtype.str.lstrip("|")), np.ascontiguousarray(np.ascontiguousarray(part).view(np.uint8).reshape(-1, part.itemsize).T).tobytes()
        out += [struct.pack("<BQ", kind, len(data)), data]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray | bytes]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        kind, size = struct.unpack_from("<BQ", data, at)
        at += 9
        part = data[at:at + size]
        if kind != 255:
            planes = np.frombuffer(part, np.uint8).reshape(int(_KINDS[kind][-1]), -1)
            part = np.ascontiguousarray(planes.T).view(_KINDS[kind]).ravel()
        out.append(part)
        at += size
    return out
