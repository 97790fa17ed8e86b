"""Small binary files for tests."""

import struct
import zlib

import numpy as np


def write_stl(path, corners, count=None):
    with open(path, "wb") as out:
        out.write(b"solid".ljust(80, b" ") + struct.pack("<I", len(corners) if count is None else count))
        for i, triangle in enumerate(np.asarray(corners, "<f4")):
            out.write(struct.pack("<3f", 9, 9, 9) + triangle.tobytes() + struct.pack("<H", i % 7))


def pack_bits(raw):
    """Literal stretches, and repeats where three bytes or more are alike."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = 1
        while at + n < len(raw) and n < 128 and raw[at + n] == raw[at]:
            n += 1
        if n >= 3:
            out += bytes([257 - n, raw[at]])
        else:
            n = min(2, len(raw) - at)
            out += bytes([n - 1]) + raw[at : at + n]
        at += n
    return bytes(out)


def pack_lzw(raw):
    codes, table, last = [256], {bytes([k]): k for k in range(256)}, b""
    size = 258
    bits = [f"{256:09b}"]

    def emit(code):
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        bits.append(f"{code:0{width}b}")

    for k in range(len(raw)):
        longer = last + raw[k : k + 1]
        if longer in table:
            last = longer
            continue
        emit(table[last])
        table[longer] = size
        size += 1
        last = raw[k : k + 1]
        if size == 4094:
            emit(256)
            table, size = {bytes([k]): k for k in range(256)}, 258
    if last:
        emit(table[last])
        size += 1
    emit(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


PACKERS = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32946: zlib.compress, 32773: pack_bits}


def write_tiff(path, array, order="<", rows_per_strip=2, compression=1, predictor=1, tile=None):
    """Multi-page file with several strips or tiles per page."""
    kind = {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
    data = bytearray(b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)
    link = 4
    tall, wide = tile or (rows_per_strip, array.shape[2])
    for plane in array:
        height, width = plane.shape
        if tile:
            plane = np.pad(plane, ((0, -height % tall), (0, -width % wide)), mode="edge")
        blocks = [plane[y : y + tall, x : x + wide] for y in range(0, plane.shape[0], tall) for x in range(0, plane.shape[1], wide)]
        if predictor == 2:
            blocks = [np.diff(b, axis=1, prepend=np.zeros((len(b), 1), b.dtype)) for b in blocks]
        packer = PACKERS.get(compression, bytes)
        strips = [packer(np.ascontiguousarray(b.astype(b.dtype.newbyteorder(order))).tobytes()) for b in blocks]
        offsets = []
        for strip in strips:
            offsets.append(len(data))
            data += strip
        named = (324, 325) if tile else (273, 279)
        lists = {named[0]: offsets, named[1]: [len(s) for s in strips]}
        where = {}
        for tag, values in lists.items():
            where[tag] = values[0] if len(values) == 1 else len(data)
            if len(values) > 1:
                data += struct.pack(f"{order}{len(values)}I", *values)
        fields = [
            (256, 3, 1, width),
            (257, 4, 1, height),
            (258, 3, 1, array.dtype.itemsize * 8),
            (259, 3, 1, compression),
            (277, 3, 1, 1),
            (317, 3, 1, predictor),
            (339, 3, 1, kind),
            *((tag, 4, len(strips), place) for tag, place in where.items()),
            *([(322, 3, 1, wide), (323, 3, 1, tall)] if tile else [(278, 4, 1, rows_per_strip)]),
        ]
        data += b"\0" * (len(data) % 2)
        struct.pack_into(order + "I", data, link, len(data))
        data += struct.pack(order + "H", len(fields))
        for tag, code, count, value in sorted(fields):
            inline = struct.pack(order + "HH", value, 0) if code == 3 else struct.pack(order + "I", value)
            data += struct.pack(order + "HHI", tag, code, count) + inline
        link = len(data)
        data += struct.pack(order + "I", 0)
    path.write_bytes(bytes(data))
