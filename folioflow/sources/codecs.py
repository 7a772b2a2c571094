"""Stream filters of page documents, and headers of pictures."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np


class FilterError(ValueError):
    """Data that a filter can't decode, or a filter that isn't known."""


def flate(data: bytes) -> bytes:
    """Inflated data; of broken data what comes before the break."""
    inflater = zlib.decompressobj()
    try:
        return inflater.decompress(data) + inflater.flush()
    except zlib.error:
        pass
    for bits in (15, -15):
        inflater, out = zlib.decompressobj(bits), bytearray()
        try:
            for i in range(len(data)):
                out += inflater.decompress(data[i : i + 1])
        except zlib.error:
            pass
        if out:
            return bytes(out)
    raise FilterError("not deflated")


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 starts anew and 257 ends."""
    out, table, width, held, have, last = bytearray(), [], 9, 0, 0, b""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table = start.copy()
    for byte in data:
        held, have = (held << 8) | byte, have + 8
        while have >= width:
            code = (held >> (have - width)) & ((1 << width) - 1)
            have -= width
            held &= (1 << have) - 1
            if code == 256:
                table, width, last = start.copy(), 9, b""
                continue
            if code == 257:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                return bytes(out)
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            width = min(12, max(9, (len(table) + early).bit_length()))
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">", 1)[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii_85(data: bytes) -> bytes:
    body = re.sub(rb"\s", b"", data.split(b"~>", 1)[0]).removeprefix(b"<~")
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _group(group)
                group = []
    if len(group) > 1:
        out += _group(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _group(digits: list[int]) -> bytes:
    value = 0
    for d in digits:
        value = value * 85 + d
    return struct.pack(">I", value & 0xFFFFFFFF)


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def unpredicted(data: bytes, params: dict) -> bytes:
    """Undo a TIFF (2) or PNG (10 and up) predictor."""
    kind = int(params.get("Predictor", 1) or 1)
    if kind < 2:
        return data
    colours, bits, columns = (int(params.get(k, d) or d) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    step, row = max(1, colours * bits // 8), (colours * bits * columns + 7) // 8
    out = bytearray()
    if kind == 2:
        if bits != 8:
            raise FilterError("TIFF predictor of other than 8 bits")
        for at in range(0, len(data), row):
            line = bytearray(data[at : at + row])
            for i in range(step, len(line)):
                line[i] = (line[i] + line[i - step]) & 255
            out += line
        return bytes(out)
    above, start = bytes(row), 0
    if data and data[0] == 2 and row > 0:
        # the first rows that are told by the row above, all at once
        table = np.frombuffer(data, np.uint8)[: len(data) // (row + 1) * (row + 1)].reshape(-1, row + 1)
        other = np.flatnonzero(table[:, 0] != 2)
        n = int(other[0]) if len(other) else len(table)
        out += np.add.accumulate(table[:n, 1:], axis=0, dtype=np.uint8).tobytes()
        start, above = n * (row + 1), bytes(out[-row:]) if n else above
    for at in range(start, len(data), row + 1):
        how, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(line)):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            if how == 1:
                add = a
            elif how == 2:
                add = b
            elif how == 3:
                add = (a + b) // 2
            elif how == 4:
                p = a + b - c
                add = min((a, b, c), key=lambda v, p=p: abs(p - v))
            else:
                add = 0
            line[i] = (line[i] + add) & 255
        out += line
        above = bytes(line) + bytes(row - len(line))
    return bytes(out)


#: Short names are those of inline pictures (fixed values).
NAMES = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}


def decode_chain(data: bytes, filters: list[str], params: list[dict], stop_before: str | None = None) -> bytes:
    """Apply filters in order, each with its parameters."""
    for i, name in enumerate(filters):
        name = NAMES.get(name, name)
        if name == stop_before:
            return data
        own = params[i] if i < len(params) and isinstance(params[i], dict) else {}
        if name == "FlateDecode":
            data = unpredicted(flate(data), own)
        elif name == "LZWDecode":
            data = unpredicted(lzw(data, int(own.get("EarlyChange", 1))), own)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data)
        elif name == "ASCII85Decode":
            data = ascii_85(data)
        elif name == "RunLengthDecode":
            data = run_length(data)
        elif name != "Crypt":
            raise FilterError(f"unknown filter {name}")
    return data


def jpeg_header(data: bytes) -> tuple[int, int, int] | None:
    """Width, height and components from the frame marker."""
    i = 2
    while data[:2] == b"\xff\xd8" and i + 9 < len(data):
        if data[i] != 0xFF:
            i += 1
            continue
        marker = data[i + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", data[i + 5 : i + 10])
            return width, height, parts
        i += 2 if marker == 0xFF or 0xD0 <= marker <= 0xD9 or marker == 1 else 2 + struct.unpack(">H", data[i + 2 : i + 4])[0]
    return None


def png_header(data: bytes) -> tuple[int, int, int, int] | None:
    """Width, height, bit depth and colour type."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        return None
    return struct.unpack(">IIBB", data[16:26])
