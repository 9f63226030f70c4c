"""Byte codecs of chunked array formats, for readers. A chunk may have at most LIMIT bytes when decoded."""

from __future__ import annotations

import struct
import zlib

import numpy as np

LIMIT = 1 << 30


def packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes one bit longer one code early."""
    table: list[bytes] = []
    out: list[bytes] = []
    bits, have, width, last = 0, 0, 9, b""
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        while have >= width:
            code = bits >> have - width & (1 << width) - 1
            have -= width
            bits &= (1 << have) - 1
            if code == 257:
                return b"".join(out)
            if code == 256 or not table:
                table, width, last = list(fresh), 9, b""
                if code == 256:
                    continue
            entry = table[code] if code < len(table) else last + last[:1]
            out.append(entry)
            if last:
                table.append(last + entry[:1])
            last = entry
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return b"".join(out)


def lz4_block(data: bytes) -> bytes:
    """One raw LZ4 block."""
    out, i = bytearray(), 0
    while i < len(data):
        token = data[i]
        i += 1
        n = token >> 4
        if n == 15:
            while True:
                n += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        out += data[i : i + n]
        i += n
        if i >= len(data):
            break
        back = data[i] | data[i + 1] << 8
        i += 2
        n = token & 15
        if n == 15:
            while True:
                n += data[i]
                i += 1
                if data[i - 1] != 255:
                    break
        n += 4
        start = len(out) - back
        if back >= n:
            out += out[start : start + n]
        else:  # the match overlaps what it makes
            piece = bytes(out[start:])
            out += (piece * (n // back + 1))[:n]
    return bytes(out)


def unshuffle(data: bytes, size: int) -> bytes:
    """Bytes grouped by their place in an element, back in elements; a rest that fills none stays at the end."""
    n = len(data) // size
    body = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T
    return body.tobytes() + data[n * size :]


def unbitshuffle(data: bytes, size: int) -> bytes:
    """Bits grouped by their place in an element (the lowest of the first byte first), back in elements; a rest that fills none stays at the end."""
    n = len(data) // size
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(size * 8, n // 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * size :]


def undelta(data: bytes, dtype: str) -> bytes:
    """Running sums of stored differences."""
    a = np.frombuffer(data, dtype)
    return np.cumsum(a, dtype=a.dtype).astype(dtype).tobytes()


def blosc(data: bytes) -> bytes:
    """A Blosc 1 chunk: blocks of LZ4, zlib, Zstandard or plain bytes, shuffled by byte or bit or not."""
    _, _, flags, size = data[:4]
    total, block, _ = struct.unpack_from("<III", data, 4)
    if total > LIMIT:
        raise ValueError("a chunk is too large")
    if flags & 2:
        return data[16 : 16 + total]
    inner = {1: lz4_block, 3: zlib.decompress, 4: zstd}.get(flags >> 5)
    if inner is None:
        raise ValueError(f"Blosc codec {flags >> 5} isn't supported")
    blocks = -(-total // block)
    out = []
    for k, start in enumerate(struct.unpack_from(f"<{blocks}i", data, 16)):
        want = min(block, total - k * block)
        # A block is split by byte where an element has up to 16 bytes and 128 elements or more lie in it.
        parts = size if not flags & 16 and want == block and 1 < size <= 16 and block // size >= 128 else 1
        got = []
        for _ in range(parts):
            (n,) = struct.unpack_from("<i", data, start)
            piece = data[start + 4 : start + 4 + n]
            got.append(piece if n == want // parts else inner(piece))
            start += 4 + n
        plain = b"".join(got)
        if len(plain) != want:
            raise ValueError(f"a Blosc block has {len(plain)} bytes where {want} are due")
        if flags & 4 and size > 1 and want // size % 8 == 0:
            out.append(unbitshuffle(plain, size))
        else:
            out.append(unshuffle(plain, size) if flags & 1 and size > 1 else plain)
    return b"".join(out)


def zstd(data: bytes) -> bytes:
    import zstandard

    return _whole(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read(LIMIT + 1))


def _inflated(data: bytes, bits: int) -> bytes:
    return _whole(zlib.decompressobj(bits).decompress(data, LIMIT + 1))


def _whole(data: bytes) -> bytes:
    if len(data) > LIMIT:
        raise ValueError("a chunk is too large")
    return data


def predictor(data: bytes, kind: int, width: int, samples: int, dtype: str) -> bytes:
    """TIFF predictors of rows: 2 differences of samples, 3 differences of the bytes of floats."""
    if kind == 1:
        return data
    size = np.dtype(dtype).itemsize
    if kind == 2:
        a = np.frombuffer(data, dtype).reshape(-1, width, samples)
        return np.cumsum(a, axis=1, dtype=a.dtype).astype(dtype).tobytes()
    if kind == 3:
        rows = np.frombuffer(data, np.uint8).reshape(-1, width * samples * size)
        rows = np.cumsum(rows.reshape(len(rows), -1, samples), axis=1, dtype=np.uint8).reshape(len(rows), -1)
        planes = rows.reshape(len(rows), size, width * samples)  # most significant bytes first
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").astype(dtype).tobytes()
    raise ValueError(f"no predictor {kind}")


def decode(data: bytes, steps: list[tuple[str, dict]]) -> bytes:
    """A chunk through its decoding steps, in order: (name, settings)."""
    for name, setting in steps:
        if name in ("zlib", "deflate"):
            data = _inflated(data, 15)
        elif name == "gzip":
            data = _inflated(data, 31)
        elif name == "zstd":
            data = zstd(data)
        elif name == "lz4":
            data = lz4_block(data[4:])
        elif name == "blosc":
            data = blosc(data)
        elif name == "lzw":
            data = lzw(data)
        elif name == "packbits":
            data = packbits(data)
        elif name == "shuffle":
            data = unshuffle(data, setting.get("elementsize", 4))
        elif name == "delta":
            data = undelta(data, setting["dtype"])
        elif name in ("crc32c", "fletcher32", "crc32"):
            data = data[:-4]
        elif name not in ("bytes", "raw"):
            raise ValueError(f"codec {name!r} isn't supported")
        if len(data) > LIMIT:
            raise ValueError("a chunk is too large")
    return data
