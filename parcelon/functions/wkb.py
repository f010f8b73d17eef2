"""Well-known binary of polygons, and the header that GeoPackage puts before it."""

from __future__ import annotations

import struct

Ring = list[tuple[float, float]]

POLYGON, MULTIPOLYGON = 3, 6
#: Bytes of the envelope by its kind in the header's flags.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def _polygon(data: bytes, at: int) -> tuple[list[Ring], int]:
    order = "<" if data[at] else ">"
    kind, rings = struct.unpack_from(f"{order}2I", data, at + 1)
    if kind != POLYGON:
        raise ValueError(f"geometry type {kind} is no polygon")
    at += 9
    found = []
    for _ in range(rings):
        (n,) = struct.unpack_from(f"{order}I", data, at)
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at + 4)
        found.append(list(zip(flat[::2], flat[1::2], strict=True)))
        at += 4 + 16 * n
    return found, at


def decode(data: bytes) -> list[list[Ring]]:
    """Polygons, each a list of rings, the exterior first. Anything but (multi)polygons fails."""
    order = "<" if data[0] else ">"
    kind, n = struct.unpack_from(f"{order}2I", data, 1)
    if kind == POLYGON:
        polygon, at = _polygon(data, 0)
        found = [polygon]
    elif kind == MULTIPOLYGON:
        found, at = [], 9
        for _ in range(n):
            polygon, at = _polygon(data, at)
            found.append(polygon)
    else:
        raise ValueError(f"geometry type {kind} is no polygon")
    if at != len(data):
        raise ValueError("bytes are left after the geometry")
    return found


def encode(polygons: list[list[Ring]]) -> bytes:
    """Little-endian; a polygon if there is exactly one, a multipolygon otherwise."""

    def one(rings: list[Ring]) -> bytes:
        parts = [struct.pack("<B2I", 1, POLYGON, len(rings))]
        for ring in rings:
            parts.append(struct.pack("<I", len(ring)))
            parts.append(struct.pack(f"<{2 * len(ring)}d", *(v for point in ring for v in point)))
        return b"".join(parts)

    if len(polygons) == 1:
        return one(polygons[0])
    return struct.pack("<B2I", 1, MULTIPOLYGON, len(polygons)) + b"".join(map(one, polygons))


def unpack(blob: bytes) -> tuple[int, bool, bytes]:
    """Spatial reference id, whether the geometry is flagged as empty, and the WKB."""
    if blob[:2] != b"GP" or blob[2] != 0:
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    (srs,) = struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)
    kind = flags >> 1 & 7
    if kind not in ENVELOPES:
        raise ValueError(f"envelope kind {kind} is unknown")
    return srs, bool(flags >> 4 & 1), blob[8 + ENVELOPES[kind] :]


def pack(srs: int, wkb: bytes) -> bytes:
    return struct.pack("<2sBBi", b"GP", 0, 1, srs) + wkb
