"""Decoding of one TIFF strip or tile: its compression and the differences it may be stored as."""

from __future__ import annotations

import zlib

import numpy as np

# Compression codes, and the LZW codes that clear the table and end a block.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 8, 32946, 32773
CODECS = (NONE, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS)
CLEAR, END = 256, 257
# Stored as they are, or as differences of neighbours along a line.
PLAIN, DIFFERENCES = 1, 2


def unpack_bits(raw: bytes) -> bytes:
    """Runs: a count below 128 copies that many bytes and one, a count above repeats a byte, 128 does nothing."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        at += 1
        if n < 128:
            out += raw[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += raw[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def decode_lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; a code grows by a bit one entry before it has to."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    weights = {n: 1 << np.arange(n - 1, -1, -1) for n in range(9, 13)}
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, last, width, at = list(first), [], None, 9, 0
    while at + width <= len(bits):
        code = int(bits[at : at + width] @ weights[width])
        at += width
        if code == END:
            break
        if code == CLEAR:
            table, last, width = list(first), None, 9
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


def decode_block(raw: bytes, codec: int, predictor: int, dtype: str, height: int, width: int) -> np.ndarray:
    """Pixels of one strip or tile."""
    if codec in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif codec == PACK_BITS:
        raw = unpack_bits(raw)
    elif codec == LZW:
        raw = decode_lzw(raw)
    pixels = np.frombuffer(raw, dtype, height * width).reshape(height, width)
    if predictor == DIFFERENCES:
        pixels = np.cumsum(pixels, axis=1, dtype=pixels.dtype.newbyteorder("="))
    return pixels
