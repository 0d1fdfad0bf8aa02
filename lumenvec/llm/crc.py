"""Cyclic redundancy checks over many byte strings at once, as table look-ups and XOR folds.

A CRC with zero start value is linear: the value of a message is the XOR of one table entry
per byte, chosen by the byte and its distance from the end. Messages are cut into blocks of
256 bytes, blocks are folded by that rule, and block values are chained by a shift table.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256


class Crc:
    """Parameters as usual: polynomial, width in bits, reflected order, start value, final XOR."""

    def __init__(self, poly: int, width: int, reflected: bool, init: int, xor_out: int):
        self.width, self.reflected, self.init, self.xor_out = width, reflected, init, xor_out
        mask, top = (1 << width) - 1, 1 << (width - 1)
        if reflected:
            back = int(f"{poly:0{width}b}"[::-1], 2)
        one = np.zeros(256, np.uint32)
        for b in range(256):
            c = b if reflected else b << (width - 8)
            for _ in range(8):
                c = (c >> 1) ^ (back if c & 1 else 0) if reflected else ((c << 1) ^ (poly if c & top else 0)) & mask
            one[b] = c
        self.one, self.mask = one, np.uint32(mask)
        self.at = np.zeros((BLOCK, 256), np.uint32)  # by distance from the block's end
        self.at[0] = one
        for d in range(1, BLOCK):
            self.at[d] = self._zero(self.at[d - 1])
        #: Where a register goes when BLOCK zero bytes follow, by each of its bytes.
        self.skip = np.zeros((width // 8, 256), np.uint32)
        for k in range(width // 8):
            c = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            for _ in range(BLOCK):
                c = self._zero(c)
            self.skip[k] = c

    def _zero(self, c: np.ndarray) -> np.ndarray:
        """The register after one more byte 0."""
        if self.reflected:
            return (c >> np.uint32(8)) ^ self.one[c & np.uint32(255)]
        return ((c << np.uint32(8)) & self.mask) ^ self.one[(c >> np.uint32(self.width - 8)) & np.uint32(255)]

    def _skip(self, c: np.ndarray) -> np.ndarray:
        out = self.skip[0][c & np.uint32(255)]
        for k in range(1, self.width // 8):
            out = out ^ self.skip[k][(c >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def many(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRC of data[start:start + length] for each pair."""
        n = len(starts)
        out = np.zeros(n, np.uint32)
        if not n:
            return out
        starts, lengths = starts.astype(np.int64), lengths.astype(np.int64)
        blocks = -(-lengths // BLOCK)
        head = blocks * BLOCK - lengths  # zero bytes put before: they leave a zero register as it is
        order = np.argsort(-blocks, kind="stable")
        for part in np.array_split(order, max(1, int(blocks.sum()) // 16384 + 1)):
            if not len(part) or not (most := int(blocks[part].max())):
                continue
            values = np.zeros(len(part), np.uint32)
            for b in range(most):
                live = np.flatnonzero(blocks[part] > b)
                rows = part[live]
                at = starts[rows, None] - head[rows, None] + b * BLOCK + np.arange(BLOCK)
                inside = at >= starts[rows, None] if b == 0 else None
                got = data[at if inside is None else np.where(inside, at, 0)]
                entry = self.at[np.arange(BLOCK - 1, -1, -1), got]
                if inside is not None:
                    entry = np.where(inside, entry, np.uint32(0))
                values[live] = self._skip(values[live]) ^ np.bitwise_xor.reduce(entry, axis=1)
            out[part] = values
        if self.init:
            out ^= self._zeros(np.full(n, self.init, np.uint32), lengths)
        return out ^ np.uint32(self.xor_out)

    def _zeros(self, c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Registers after so many bytes 0."""
        c, blocks, rest = c.copy(), lengths // BLOCK, lengths % BLOCK
        for b in range(int(blocks.max(initial=0))):
            live = blocks > b
            c[live] = self._skip(c[live])
        for b in range(int(rest.max(initial=0))):
            live = rest > b
            c[live] = self._zero(c[live])
        return c


# Fixed values of public formats: CRC-32C (Castagnoli), FLAC's frame CRC-16 and header CRC-8.
CRC32C = Crc(0x1EDC6F41, 32, True, 0xFFFFFFFF, 0xFFFFFFFF)
CRC16 = Crc(0x8005, 16, False, 0, 0)
CRC8 = Crc(0x07, 8, False, 0, 0)
MASK_DELTA = 0xA282EAD8


def masked(crc: np.ndarray) -> np.ndarray:
    """The record format's rotation and offset, so that checksums of checksums differ."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
