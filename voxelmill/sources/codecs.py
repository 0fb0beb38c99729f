"""Pixels of frame files: uncompressed, 8-bit differences with overflow tables, and CBF byte offsets."""

from __future__ import annotations

import re
import struct

HEADER_BYTES = 5120
# The two compressions' escapes, and what opens CBF's binary section.
SHORT, LONG, MIDDLE = 254, 255, 127
CBF_MAGIC = b"\x0c\x1a\x04\xd5"


def raw_int32(content: bytes):
    """Pixels that follow the header uncompressed."""
    import numpy as np

    return np.frombuffer(content, "<i4", offset=HEADER_BYTES)


def text_fields(content: bytes) -> dict[str, str]:
    """``NAME=value`` pairs of the text at a frame's start, by name."""
    return {k.decode(): v.decode() for k, v in re.findall(rb"\b([A-Z]+)=\s*([A-Za-z0-9]+)", content[:256])}


def encode_differences(pixels) -> tuple[bytes, int, int]:
    """Pixels (32-bit, in rows) as 8-bit differences with tables of 16 and 32 bits: the bytes and the tables' sizes.

    Differences are taken modulo 2^32, so that any two neighbours have one.
    """
    import numpy as np

    x = np.asarray(pixels, np.int32).ravel()
    d = np.diff(x, prepend=np.int32(0)).astype(np.int64)
    short = (d < -MIDDLE) | (d > SHORT - 1 - MIDDLE)
    long = (d < -(2**15)) | (d >= 2**15)
    code = np.where(long, LONG, np.where(short, SHORT, d + MIDDLE)).astype(np.uint8)
    tables = d[short & ~long].astype("<i2"), d[long].astype("<i4")
    return code.tobytes() + tables[0].tobytes() + tables[1].tobytes(), len(tables[0]), len(tables[1])


def decode_differences(body: bytes, size: int, n_short: int, n_long: int):
    """``size`` pixels from their differences; ValueError where the tables do not fit the bytes."""
    import numpy as np

    need = size + 2 * n_short + 4 * n_long
    if len(body) < need:
        raise ValueError(f"damaged frame: {len(body)} bytes of pixels, {need} expected")
    code = np.frombuffer(body, np.uint8, size)
    d = code.astype(np.int32) - MIDDLE
    for escape, n, kind, at in ((SHORT, n_short, "<i2", size), (LONG, n_long, "<i4", size + 2 * n_short)):
        where = np.flatnonzero(code == escape)
        if len(where) != n:
            raise ValueError(f"damaged frame: {len(where)} differences refer to a table of {n}")
        d[where] = np.frombuffer(body, kind, n, at)
    return np.cumsum(d, dtype=np.int32)


def frame_pixels(content: bytes):
    """Pixels of a frame by the compression that its header's text names; none named: uncompressed.

    ValueError for another compression, or a damaged payload.
    """
    fields = text_fields(content)
    kind = fields.get("COMPRESSION", "NO").upper()
    nx, ny = struct.unpack_from("<HH", content, 278)
    if kind == "TY1":
        return decode_differences(content[HEADER_BYTES:], nx * ny, int(fields.get("OI", 0)), int(fields.get("OL", 0)))
    if kind not in ("NO", "NONE"):
        raise ValueError(f"unknown compression {kind}")
    end = HEADER_BYTES + 4 * nx * ny
    if len(content) < end:
        raise ValueError(f"damaged frame: {len(content)} bytes, {end} expected")
    return raw_int32(content[:end])


def encode_offsets(pixels) -> bytes:
    """Pixels as CBF byte offsets: differences in 8 bits, or after escapes in 16, 32 or 64 bits."""
    import numpy as np

    d = np.diff(np.asarray(pixels, np.int64).ravel(), prepend=0)
    out = []
    for v in d.tolist():
        if -128 < v < 128:
            out.append(struct.pack("<b", v))
        elif -(2**15) < v < 2**15:
            out.append(struct.pack("<bh", -128, v))
        elif -(2**31) < v < 2**31:
            out.append(struct.pack("<bhi", -128, -(2**15), v))
        else:
            out.append(struct.pack("<bhiq", -128, -(2**15), -(2**31), v))
    return b"".join(out)


def decode_offsets(body: bytes, size: int):
    """``size`` pixels from CBF byte offsets: only escapes are walked, the rest is summed as arrays.  ValueError if bytes are missing."""
    import numpy as np

    raw = np.frombuffer(body, np.int8)
    starts, wide, end = np.ones(len(raw), bool), {}, 0
    for at in np.flatnonzero(raw == -128).tolist():
        if at < end:  # inside an escaped number
            continue
        v, end = None, at + 1
        for kind, bytes_, escape in (("<h", 2, -(2**15)), ("<i", 4, -(2**31)), ("<q", 8, None)):
            if end + bytes_ > len(body):
                v, end = None, len(body) + 1
                break
            v, end = struct.unpack_from(kind, body, end)[0], end + bytes_
            if v != escape:
                break
        if v is None:  # cut off: no number starts here or behind
            starts[at:] = False
            break
        wide[at] = v
        starts[at + 1 : end] = False
    d = raw.astype(np.int64)
    d[list(wide)] = list(wide.values())
    d = d[starts][:size]
    if len(d) < size:
        raise ValueError(f"damaged frame: {len(d)} pixels, {size} expected")
    return np.cumsum(d)


def cbf_shape(content: bytes) -> tuple[int, int, int]:
    """Pixels along a row, rows, and the place of the first byte of pixels, from a CBF file's text."""
    at = content.find(CBF_MAGIC)
    if at < 0:
        raise ValueError("no binary section in a CBF file")
    text = content[:at].decode("latin-1")
    if not re.search(r'conversions\s*=\s*"?x-CBF_BYTE_OFFSET', text, re.I):
        raise ValueError("a CBF file of another compression than byte offsets")
    found = [re.search(rf"X-Binary-Size-{n}-Dimension:\s*(\d+)", text, re.I) for n in ("Fastest", "Second")]
    if None in found:
        raise ValueError("a CBF file without its dimensions")
    return int(found[0][1]), int(found[1][1]), at + len(CBF_MAGIC)


def cbf_pixels(content: bytes):
    """A CBF frame's pixels as rows of 64-bit integers."""
    nx, ny, at = cbf_shape(content)
    return decode_offsets(content[at:], nx * ny).reshape(ny, nx)


def encode_cbf(pixels) -> bytes:
    """A CBF file of the pixels (two dimensions)."""
    import numpy as np

    x = np.asarray(pixels)
    body = encode_offsets(x)
    lines = [
        "###CBF: VERSION 1.5", "", "data_frame", "", "_array_data.data", ";", "--CIF-BINARY-FORMAT-SECTION--",
        'Content-Type: application/octet-stream;\r\n     conversions="x-CBF_BYTE_OFFSET"', "Content-Transfer-Encoding: BINARY", f"X-Binary-Size: {len(body)}",
        'X-Binary-Element-Type: "signed 32-bit integer"', f"X-Binary-Number-of-Elements: {x.size}", f"X-Binary-Size-Fastest-Dimension: {x.shape[1]}", f"X-Binary-Size-Second-Dimension: {x.shape[0]}", "", "",
    ]
    return "\r\n".join(lines).encode() + CBF_MAGIC + body + b"\r\n--CIF-BINARY-FORMAT-SECTION----\r\n;\r\n"
