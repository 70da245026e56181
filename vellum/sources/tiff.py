"""Grey images out of TIFF files: strips without compression, PackBits, LZW, Deflate and CCITT group 4, one or eight bits a pixel.

Broken and unknown files raise ValueError; readers make that a row without an image.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Tags and values of the format (fixed values).
WIDTH, HEIGHT, BITS, PACKING, GROUND, ORDER, STRIPS, SAMPLES, ROWS, SIZES, PREDICTOR = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279, 317
PLAIN, GROUP_4, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 4, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I"}
#: Codes of runs in group 4 coding: 0 to 63 pixels, then 64 to 1728 in steps of 64, then 1792 to 2560 for both (fixed values).
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 "
    "0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 "
    "00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 "
    "01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 "
    "011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
)
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 "
    "00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 "
    "000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 "
    "000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 "
    "000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 "
    "000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 "
    "0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 "
    "0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
)
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
#: How a line differs from the one above: pass, horizontal, and the offset of a change (fixed values).
MODES = {"0001": "pass", "001": "across", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}


def run_codes(codes: str) -> dict[str, int]:
    own = codes.split()
    return {c: n if n < 64 else (n - 63) * 64 for n, c in enumerate(own)} | {c: 1792 + 64 * n for n, c in enumerate(LONG.split())}


RUNS = run_codes(WHITE), run_codes(BLACK)


class Bits:
    """Bits of a strip, first bit first."""

    def __init__(self, data: bytes):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def code(self, table: dict) -> object:
        """The next code of a table; ValueError if there is none."""
        for n in range(1, 14):
            if (found := table.get(self.bits[self.at : self.at + n])) is not None:
                self.at += n
                return found
        raise ValueError("no such code")

    def run(self, black: int) -> int:
        total = 0
        while True:
            n = self.code(RUNS[black])
            total += n
            if n < 64:
                return total


def group_4(data: bytes, width: int, height: int) -> np.ndarray:
    """Black pixels of a strip; lines that the strip lacks are white."""
    bits, out = Bits(data), np.zeros((height, width), bool)
    above: list[int] = []  # where the colour changes in the line above, from white
    for y in range(height):
        line: list[int] = []
        at, black, k = -1, 0, 0
        while at < width:
            # the first change above that lies right of here and turns to the other colour
            while k > 0 and above[k - 1] > at:
                k -= 1
            while k < len(above) and (above[k] <= at or k % 2 != black):
                k += 1
            b1 = above[k] if k < len(above) else width
            b2 = above[k + 1] if k + 1 < len(above) else width
            if not bits.bits[bits.at : bits.at + 24].strip("0"):
                return out
            if bits.bits.startswith("000000000001", bits.at):
                return out  # end of the strip
            mode = bits.code(MODES)
            if mode == "pass":
                at = b2
            elif mode == "across":
                first, second = bits.run(black), bits.run(1 - black)
                start = max(at, 0)
                line += [start + first, start + first + second]
                at = start + first + second
            else:
                at = b1 + mode
                line.append(at)
                black = 1 - black
        above = [min(x, width) for x in line]
        for a, b in zip(above[::2], [*above[1::2], width]):
            out[y, a:b] = True
    return out


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, first bit first; 256 starts anew, 257 ends."""
    bits, at, out = int.from_bytes(data, "big"), 0, bytearray()
    total, wide, table, last = len(data) * 8, 9, [], None
    while at + wide <= total:
        code = bits >> (total - at - wide) & (1 << wide) - 1
        at += wide
        if code == 257:
            break
        if code == 256:
            table, wide, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is not None:
            if code > len(table):
                raise ValueError("no such code")
            table.append(last + (table[code] if code < len(table) else last)[:1])
        elif code >= len(table):
            raise ValueError("no such code")
        last = table[code]
        out += last
        wide = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def tags_of(data: bytes) -> dict[int, list[int]]:
    """Whole-number tags of the first image."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in TYPES:
            size = struct.calcsize(TYPES[kind]) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            out[tag] = list(struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, place))
    return out


def decoded_tiff(data: bytes) -> np.ndarray:
    """Grey image of a TIFF file; several samples a pixel are averaged by brightness."""
    try:
        tags = tags_of(data)
        one = lambda tag, default: tags.get(tag, [default])[0]
        width, height, depth, packing = tags[WIDTH][0], tags[HEIGHT][0], one(BITS, 1), one(PACKING, PLAIN)
        samples, rows, dark_zero = one(SAMPLES, 1), min(one(ROWS, tags[HEIGHT][0]), tags[HEIGHT][0]), one(GROUND, 0) != 0
        if depth not in (1, 8) or one(ORDER, 1) != 1 or width < 1 or height < 1 or (depth == 1 and samples != 1):
            raise ValueError("unknown kind of image")
        parts = []
        for k, (at, size) in enumerate(zip(tags[STRIPS], tags.get(SIZES, [len(data)]))):
            strip, high = data[at : at + size], min(rows, height - k * rows)
            if packing == GROUP_4:
                parts.append(group_4(strip, width, high).astype(np.uint8))
                continue
            unpack = {PLAIN: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}.get(packing)
            if unpack is None:
                raise ValueError("unknown compression")
            wide = -(-width // 8) if depth == 1 else width * samples
            lines = np.frombuffer(unpack(strip), np.uint8, wide * high).reshape(high, wide)
            if depth == 1:
                parts.append(np.unpackbits(lines, axis=1)[:, :width])
                continue
            image = lines.reshape(high, width, samples)
            if one(PREDICTOR, 1) == 2:
                image = np.cumsum(image, axis=1, dtype=np.uint8)
            parts.append(image[..., 0] if samples < 3 else np.round(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8))
        whole = np.concatenate(parts)
        if whole.shape != (height, width):
            raise ValueError("strips are missing")
    except (KeyError, IndexError, struct.error, zlib.error) as e:
        raise ValueError(f"broken file: {e}") from e
    if depth == 1:
        whole = whole * np.uint8(255)
    return whole if dark_zero else 255 - whole
