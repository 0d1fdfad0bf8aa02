"""FLAC media columns: 8-bit mono streams encoded and decoded a batch of documents at a time.

A batch's frames, at most LANES samples at once and whoever's they are, go in step: frame by frame in NumPy's
lanes, sample after sample in time, so the bit-serial Rice codes and linear predictors cost a few array
operations a sample step, and one very long text takes no more memory than many short ones besides its bytes.

Encoding: blocks of BLOCK samples; a subframe is constant, verbatim, a fixed predictor of order 0 to 4 or
a linear predictor of order LPC_ORDER, whichever has the least residual; residuals are Rice codes with
the best parameter. Every frame has a seek point. A frame's coefficients depend on its own samples alone (exact
integer autocorrelations, then one fixed order of floating-point steps), so equal payloads give equal streams,
whatever stands beside them in a batch.

Decoding: constant, verbatim, fixed and linear predictors of any order, both Rice methods, partitions,
escaped partitions, wasted bits, fixed and variable block sizes; CRC-8 of headers, CRC-16 of frames and
the stream's MD5 are verified (ValueError). Without a seek point for each frame, the frames of a stream
are decoded one after the other, streams side by side. Streams of one channel with 8 bits a sample.

A decoded stream is its samples and its blocks' places among them, so a block is a slice, and a range of samples
is found by its blocks' offsets (write_blocks, read_samples) or, in a stream, by its seek points (samples_at).

Defined cases: null and empty texts are a payload of 64 bytes 0; repeated rows give equal streams; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, buffers, ragged, staged, table, text_slices, tune
from .crc import CRC8, CRC16

BLOCK = 2048
LPC_ORDER, PRECISION = 4, 7
RATE = 8000
UNIT = 64
#: Samples that go in step.
LANES = 3 << 20


# ---- encoding


def _predictors(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, LPC_ORDER), shift, and whether they are usable, by Levinson's
    recursion on exact integer autocorrelations."""
    wide, p = x.astype(np.int64), LPC_ORDER
    r = np.stack([(wide[:, k:] * wide[:, : x.shape[1] - k]).sum(axis=1) for k in range(p + 1)], axis=1).astype(np.float64)
    n = len(x)
    a, err, good = np.zeros((n, p)), np.maximum(r[:, 0], 1.0), (r[:, 0] > 0) & (size > 4 * p)
    for i in range(p):
        k = r[:, i + 1].copy()
        for j in range(i):
            k -= a[:, j] * r[:, i - j]
        k /= err
        before = a.copy()
        a[:, i] = k
        for j in range(i):
            a[:, j] = before[:, j] - k * before[:, i - 1 - j]
        err = err * (1 - k * k)
        good &= err > 0
        err = np.where(err > 0, err, 1.0)
    most = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(most) + 1e-12).astype(np.int64), 0, 15)
    half = (1 << (PRECISION - 1)) - 1
    coef = np.clip(np.rint(a * (1 << shift)[:, None]), -half, half).astype(np.int64)
    return coef, shift, good & (coef != 0).any(axis=1)


def _residuals(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each frame: residual (zero before the predictor's order), order, whether linear, coefficients, shift."""
    at = np.arange(x.shape[1])
    inside = at < size[:, None]
    best, cost = x.copy(), np.abs(x).sum(axis=1)
    order, linear = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    diff = x
    for o in range(1, 5):
        diff = np.concatenate([np.zeros((len(x), 1), np.int32), diff[:, 1:] - diff[:, :-1]], axis=1)
        one = np.where(inside & (at >= o), diff, 0)
        c = np.abs(one).sum(axis=1) + 8 * o
        take = (c < cost) & (size > o)
        best[take], cost[take], order[take] = one[take], c[take], o
    coef, shift, good = _predictors(x, size)
    guess = np.zeros(x.shape, np.int64)
    for j in range(LPC_ORDER):
        guess[:, j + 1 :] += coef[:, j, None] * x[:, : x.shape[1] - j - 1]
    one = np.where(inside & (at >= LPC_ORDER), x - (guess >> shift[:, None]), 0).astype(np.int32)
    take = good & (np.abs(one).sum(axis=1) + 8 * LPC_ORDER + 8 < cost)
    best[take], order[take], linear[take] = one[take], LPC_ORDER, True
    return best, order, linear, coef, shift


def _pack(total: int, at: np.ndarray, value: np.ndarray, bits: np.ndarray, most: int) -> np.ndarray:
    """Bytes with each value's bits at a bit offset; no two overlap. most: bytes that a field can touch."""
    out = np.zeros(total, np.uint8)
    first, word = at >> 3, value.astype(np.uint64) << (64 - bits - (at & 7)).astype(np.uint64)
    for k in range(most):
        part = (word >> np.uint64(56 - 8 * k)) & np.uint64(255)
        some = part != 0
        out |= np.bincount(first[some] + k, weights=part[some].astype(np.float64), minlength=total)[:total].astype(np.uint8)
    return out


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: bytes (frames, 6) and how many."""
    out, length = np.zeros((len(n), 6), np.uint8), np.ones(len(n), np.int64)
    for k, limit in enumerate((1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26), 1):
        length[n >= limit] = k + 1
    for k in range(1, 7):
        m = length == k
        if k == 1:
            out[m, 0] = n[m]
        else:
            out[m, 0] = ((0xFF00 >> k) & 0xFF) | (n[m] >> (6 * (k - 1)))
            for j in range(1, k):
                out[m, j] = 0x80 | ((n[m] >> (6 * (k - 1 - j))) & 0x3F)
    return out, length


def encode_frames(data: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the samples data[start:start + size] (unsigned bytes, 128 is silence) and frame offsets."""
    n, width = len(start), int(size.max())
    at = np.arange(width)
    inside = at < size[:, None]
    x = np.where(inside, data[np.where(inside, start[:, None] + at, 0)].astype(np.int32) - 128, 0)
    res, order, linear, coef, shift = _residuals(x, size)
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)
    coded = inside & (at >= order[:, None])
    folded = np.where(res >= 0, 2 * res, -2 * res - 1) * coded
    count = size - order
    costs = np.stack([(folded >> k).sum(axis=1) + count * (k + 1) for k in range(11)], axis=1)
    k = costs.argmin(axis=1)
    extra = np.where(linear, 9 + LPC_ORDER * PRECISION, 0) + 8 * order + 10
    verbatim = ~constant & (costs.min(axis=1) + extra >= 8 * size)
    plain = ~constant & ~verbatim
    order[~plain], linear[~plain] = 0, False
    # header: sync, sizes, number, CRC-8
    num, num_len = _number(number)
    short = size != BLOCK
    head = np.zeros((n, 13), np.uint8)
    head[:, 0], head[:, 1], head[:, 2], head[:, 3] = 0xFF, 0xF8, np.where(short, 0x70, 0x80 | (BLOCK.bit_length() - 9) << 4), 0x02
    for j in range(6):
        m = num_len > j
        head[m, 4 + j] = num[m, j]
    rows = np.flatnonzero(short)
    head[rows, 4 + num_len[rows]], head[rows, 5 + num_len[rows]] = (size[rows] - 1) >> 8, (size[rows] - 1) & 255
    head_len = 4 + num_len + 2 * short
    head[np.arange(n), head_len] = CRC8.many(head.ravel(), np.arange(n) * 13, head_len)
    head_len = head_len + 1
    body = 8 + np.where(constant, 8, np.where(verbatim, 8 * size, extra + costs[np.arange(n), k]))
    frame = head_len + (body + 7) // 8 + 2
    offset = np.cumsum(frame) - frame
    total = int(frame.sum())
    bit = (offset + head_len) * 8
    fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(mask: np.ndarray, value: np.ndarray, bits: int) -> None:
        rows = np.flatnonzero(mask)
        fields.append((bit[rows].copy(), (np.asarray(value)[rows] & ((1 << bits) - 1)).astype(np.uint64), np.full(len(rows), bits)))
        bit[rows] += bits

    every = np.ones(n, bool)
    put(every, np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 0x20 | (LPC_ORDER - 1), 8 | order))) << 1, 8)
    put(constant, x[:, 0], 8)
    for j in range(4):
        put(plain & (order > j), x[:, min(j, width - 1)], 8)
    put(linear, np.full(n, PRECISION - 1), 4)
    put(linear, shift, 5)
    for j in range(LPC_ORDER):
        put(linear, coef[:, j], PRECISION)
    put(plain, np.zeros(n, np.int64), 6)
    put(plain, k, 4)
    out = np.zeros(total, np.uint8)
    out |= _pack(total, *(np.concatenate([f[i] for f in fields]) for i in range(3)), 3)
    # Rice codes: a run of zeros, then a one and k low bits
    take = coded & plain[:, None]
    kk = np.broadcast_to(k[:, None], x.shape)[take]
    u = folded[take]
    high = u >> kk
    length = high + 1 + kk
    per = take.sum(axis=1)
    ends = np.cumsum(length)
    first = np.cumsum(per) - per
    base = np.where(per > 0, np.concatenate([[0], ends])[np.minimum(first, len(ends))], 0)
    place = np.repeat(bit - base, per) + ends - length + high
    if len(u):
        out |= _pack(total, place, (1 << kk) | (u & ((1 << kk) - 1)), kk + 1, 3)
    rows = np.flatnonzero(verbatim)
    if len(rows):
        lengths = size[rows]
        out[ragged(offset[rows] + head_len[rows] + 1, lengths)] = data[ragged(start[rows], lengths)] ^ 0x80
    out[ragged(offset, head_len)] = head[(np.arange(13) < head_len[:, None])]
    crc = CRC16.many(out, offset, frame - 2)
    out[offset + frame - 2], out[offset + frame - 1] = crc >> 8, crc & 255
    return out, np.concatenate([offset, [total]])


def encode_streams(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream for each payload data[offsets[i]:offsets[i + 1]], unsigned 8-bit samples."""
    length = np.diff(offsets)
    blocks = -(-length // BLOCK)
    number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(offsets[:-1], blocks) + number * BLOCK
    size = np.minimum(BLOCK, np.repeat(offsets[1:], blocks) - start)
    parts, places, step = [], [np.zeros(1, np.int64)], LANES // BLOCK
    for k in range(0, len(start), step):
        frames, at = encode_frames(data, start[k : k + step], size[k : k + step], number[k : k + step])
        parts.append(frames.tobytes())
        places.append(at[1:] + places[-1][-1])
    raw, at, out = b"".join(parts), np.concatenate(places), []
    first = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    for i, (x, y) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        a, b = first[i], first[i + 1]
        sizes = np.diff(at[a : b + 1])
        md5 = hashlib.md5((data[x:y] ^ 0x80).tobytes()).digest()
        info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + ((RATE << 44) | (7 << 36) | (y - x)).to_bytes(8, "big") + md5
        points = np.zeros((b - a, 18), np.uint8)
        points[:, :8] = (number[a:b] * BLOCK).astype(">u8").view(np.uint8).reshape(-1, 8)
        points[:, 8:16] = (at[a:b] - at[a]).astype(">u8").view(np.uint8).reshape(-1, 8)
        points[:, 16:] = size[a:b].astype(">u2").view(np.uint8).reshape(-1, 2)
        seek = points.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + raw[at[a] : at[b]])
    return out


# ---- decoding


class _Bits:
    """A bit cursor for each lane over one array of bytes."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        n = len(data) + 8
        self.words = np.zeros(n, np.uint64)
        for k in range(8):
            self.words |= padded[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)

    def window(self, at: np.ndarray) -> np.ndarray:
        """The next bits, the first one on top; 57 are valid."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
        """bits (at most 32) of each lane as unsigned numbers; moves the cursors."""
        b = np.broadcast_to(np.asarray(bits, np.int64), at.shape)
        out = np.where(b > 0, self.window(at) >> (64 - np.maximum(b, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)
        at += b
        return out

    def signed(self, at: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
        b = np.broadcast_to(np.asarray(bits, np.int64), at.shape)
        v = self.read(at, b)
        return np.where((b > 0) & (v >> np.maximum(b - 1, 0) > 0), v - (1 << b), v)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one; moves the cursors past it."""
        zeros = np.zeros(len(at), np.int64)
        top = self.window(at) >> np.uint64(12)
        while not top.all():
            rest = top == 0
            zeros[rest] += 45
            if zeros.max() > 1 << 24:
                raise ValueError("a Rice code without an end")
            top[rest] = self.window(at[rest] + zeros[rest]) >> np.uint64(12)
        zeros += 52 - np.frexp(top.astype(np.float64))[1]
        at += zeros + 1
        return zeros


def decode_frames(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frames that begin at the given bytes: samples (frames, widest), sizes, first number, end bytes."""
    bits, n = _Bits(data), len(start)
    at = start.astype(np.int64) * 8
    sync, variable = bits.read(at, 15), bits.read(at, 1)
    code, rate, channels, depth = (bits.read(at, b) for b in (4, 4, 4, 3))
    bits.read(at, 1)
    if (sync != 0x7FFC).any():
        raise ValueError("no frame where one should begin")
    if (channels != 0).any() or ((depth != 1) & (depth != 0)).any():
        raise ValueError("only one channel of 8-bit samples is supported")
    lead = bits.read(at, 8)
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    number = np.where(more == 0, lead, lead & (0x3F >> more))
    for j in range(1, 7):
        m = more >= j
        if m.any():
            cursor = at[m]
            number[m] = (number[m] << 6) | (bits.read(cursor, 8) & 0x3F)
            at[m] = cursor
    size = np.select([code == 1, (code >= 2) & (code <= 5), code >= 8], [192, 576 << np.clip(code - 2, 0, 3), 256 << np.clip(code - 8, 0, 7)], 0)
    size = np.where(code == 6, bits.read(at, np.where(code == 6, 8, 0)) + 1, size)
    size = np.where(code == 7, bits.read(at, np.where(code == 7, 16, 0)) + 1, size)
    bits.read(at, np.select([rate == 12, (rate == 13) | (rate == 14)], [8, 16], 0))
    if (size == 0).any():
        raise ValueError("a frame with a reserved block size")
    head_end = at // 8
    if (bits.read(at, 8) != CRC8.many(data, start, head_end - start)).any():
        raise ValueError("a frame header fails its CRC-8")
    # subframe header
    bits.read(at, 1)
    kind, flag = bits.read(at, 6), bits.read(at, 1)
    wasted = np.zeros(n, np.int64)
    if flag.any():
        m = flag == 1
        cursor = at[m]
        wasted[m] = bits.unary(cursor) + 1
        at[m] = cursor
    deep = 8 - wasted
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not ((kind <= 1) | fixed | linear).all():
        raise ValueError("a subframe of a reserved type")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    width = int(size.max())
    x = np.zeros((n, width), np.int32)
    m = kind == 0
    if m.any():
        cursor = at[m]
        x[m] = bits.signed(cursor, deep[m])[:, None]
        at[m] = cursor
    m = np.flatnonzero(kind == 1)
    for i in range(int(size[m].max(initial=0))):
        live = m[size[m] > i]
        cursor = at[live]
        x[live, i] = bits.signed(cursor, deep[live])
        at[live] = cursor
    for i in range(int(order.max(initial=0))):
        live = np.flatnonzero(order > i)
        cursor = at[live]
        x[live, i] = bits.signed(cursor, deep[live])
        at[live] = cursor
    coef, shift = np.zeros((n, 32), np.int64), np.zeros(n, np.int64)
    m = np.flatnonzero(linear)
    if len(m):
        cursor = at[m]
        precision = bits.read(cursor, 4) + 1
        shift[m] = bits.signed(cursor, 5)
        for j in range(int(order[m].max())):
            live = order[m] > j
            coef[m, j] = bits.signed(cursor, np.where(live, precision, 0)) * live
        at[m] = cursor
    _residual(bits, at, np.flatnonzero(fixed | linear), size, order, x)
    _restore(x, size, order, fixed, np.flatnonzero(linear), coef, shift)
    x <<= wasted[:, None].astype(np.int32)
    end = (at + 7) // 8
    at = end * 8
    if (bits.read(at, 16) != CRC16.many(data, start, end - start)).any():
        raise ValueError("a frame fails its CRC-16")
    return x, size, np.where(variable == 1, number, number * -1 - 1), end + 2


def _residual(bits: _Bits, at: np.ndarray, lanes: np.ndarray, size: np.ndarray, order: np.ndarray, x: np.ndarray) -> None:
    """Rice-coded residuals of the given frames into x, all frames in step."""
    lanes = lanes[np.argsort(-size[lanes], kind="stable")]  # those still running are the first
    cursor, n = at[lanes], size[lanes]
    wide = bits.read(cursor, 2)
    if (wide > 1).any():
        raise ValueError("a reserved residual method")
    partition = n >> bits.read(cursor, 4)
    left, k, raw = np.maximum(partition - order[lanes], 0), np.zeros(len(lanes), np.int64), np.full(len(lanes), -1)
    fresh = np.ones(len(lanes), bool)
    first, alive = order[lanes], len(lanes)
    escaped = False
    out = np.zeros((int(n.max(initial=0)), len(lanes)), np.int32)
    latest = int(first.max(initial=0))
    for i in range(len(out)):
        while alive and n[alive - 1] <= i:
            alive -= 1
        sub = np.arange(alive) if i >= latest else np.flatnonzero(first[:alive] <= i)
        if not len(sub):
            continue
        whole = len(sub) == alive
        lane = slice(0, alive) if whole else sub
        new = sub[fresh[lane]]
        while len(new):
            c, four = cursor[new], np.where(wide[new] == 1, 5, 4)
            k[new] = bits.read(c, four)
            out_of = k[new] == (1 << four) - 1
            raw[new] = np.where(out_of, bits.read(c, np.where(out_of, 5, 0)), -1)
            escaped = escaped or bool(out_of.any())
            cursor[new], fresh[new] = c, False
            again = new[left[new] == 0]  # the first partition may hold warm-up samples alone
            left[again] = partition[again]
            new = again
        c, kk = cursor[lane].copy(), k[lane]
        if escaped:
            got, rest = np.zeros(len(sub), np.int64), raw[lane] < 0
            if rest.any():
                cr = c[rest]
                got[rest] = _rice(bits, cr, kk[rest])
                c[rest] = cr
            if not rest.all():
                ce = c[~rest]
                got[~rest] = bits.signed(ce, raw[lane][~rest])
                c[~rest] = ce
        else:
            got = _rice(bits, c, kk)
        out[i, lane] = got
        cursor[lane] = c
        left[lane] -= 1
        done = sub[left[lane] == 0]
        if len(done):
            left[done], fresh[done] = partition[done], True
    at[lanes] = cursor
    for j, lane in enumerate(lanes.tolist()):
        o, s = order[lane], size[lane]
        x[lane, o:s] = out[o:s, j]


def _rice(bits: _Bits, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    high = bits.unary(at)
    u = (high << k) | bits.read(at, k)
    return (u >> 1) ^ -(u & 1)


def _restore(x: np.ndarray, size: np.ndarray, order: np.ndarray, fixed: np.ndarray, linear: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> None:
    """Samples from warm-up samples and residuals, in place."""
    for o in range(1, 5):
        rows = np.flatnonzero(fixed & (order == o))
        if not len(rows):
            continue
        y = x[rows].astype(np.int64)
        warm = [y[:, :o]]
        for _ in range(o - 1):
            warm.append(np.diff(warm[-1], axis=1))
        for j in range(o, 0, -1):  # from differences of order j to those of order j - 1
            y[:, o:] = np.cumsum(y[:, o:], axis=1) + warm[j - 1][:, -1:]
        x[rows] = y
    if len(linear):
        y, c, s = x[linear].astype(np.int64).T.copy(), coef[linear].T, shift[linear]
        most = int(order[linear].max())
        for i in range(1, len(y)):
            live = (order[linear] <= i) & (size[linear] > i)
            guess = sum(c[j] * y[i - 1 - j] for j in range(min(most, i)))
            y[i] += np.where(live, np.where(s >= 0, guess >> np.maximum(s, 0), guess << np.maximum(-s, 0)), 0)
        x[linear] = y.T


def _open(stream: bytes) -> tuple[int, int, bytes, np.ndarray, int]:
    """First frame's byte, samples, MD5, seek points (sample, byte, size), largest frame (0: not said)."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, total, md5, points, most = 4, False, 0, b"", np.zeros((0, 3), np.int64), 0
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            most, total, md5 = int.from_bytes(block[7:10], "big"), int.from_bytes(block[10:18], "big") & ((1 << 36) - 1), block[18:34]
        elif kind == 3:
            raw = np.frombuffer(block, np.uint8).reshape(-1, 18)
            points = np.stack([np.ascontiguousarray(raw[:, :8]).view(">u8").ravel(), np.ascontiguousarray(raw[:, 8:16]).view(">u8").ravel(), np.ascontiguousarray(raw[:, 16:]).view(">u2").ravel()], axis=1).astype(np.int64)
            points = points[points[:, 0] >= 0]  # placeholders are all ones
        at += 4 + size
    return at, total, md5, points, most


def _pcm(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unsigned samples (frames, widest) of frames that lie within data[start:start + length], sizes, bytes taken."""
    x, size, _, end = decode_frames(data[ragged(start, length)], at := np.cumsum(length) - length)
    return (x.astype(np.int16) + 128).astype(np.uint8), size, end - at


def decode_streams(streams: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Unsigned 8-bit samples of each stream, and its blocks' first samples."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    heads = [_open(s) for s in streams]
    parts: list[dict[int, bytes]] = [{} for _ in streams]
    known, serial = [], []  # stream, byte, bytes, sample
    for i, (first, total, _, points, most) in enumerate(heads):
        at, to = int(base[i]) + first, int(base[i + 1])
        if len(points) and points[0, 0] == 0 and (np.cumsum(points[:, 2])[:-1] == points[1:, 0]).all() and points[:, 2].sum() == total:
            starts = at + points[:, 1]
            known += zip([i] * len(points), starts.tolist(), np.diff(np.append(starts, to)).tolist(), points[:, 0].tolist(), strict=True)
        elif total:
            serial.append((i, at, min(most or to - at, to - at), 0))
    step = max(1, LANES // BLOCK)
    for k in range(0, len(known), step):
        todo = known[k : k + step]
        pcm, size, _ = _pcm(data, *(np.array([t[c] for t in todo], np.int64) for c in (1, 2)))
        for row, (i, _, _, sample) in enumerate(todo):
            parts[i][sample] = pcm[row, : size[row]].tobytes()
    while serial:
        again = []
        for k in range(0, len(serial), step):
            todo = serial[k : k + step]
            pcm, size, taken = _pcm(data, *(np.array([t[c] for t in todo], np.int64) for c in (1, 2)))
            for row, (i, at, _, sample) in enumerate(todo):
                parts[i][sample] = pcm[row, : size[row]].tobytes()
                after, now = sample + int(size[row]), at + int(taken[row])
                if after < heads[i][1]:
                    again.append((i, now, min(heads[i][4] or 1 << 62, int(base[i + 1]) - now), after))
        serial = again
    out, firsts = [], []
    for (_, total, md5, *_), part in zip(heads, parts, strict=True):
        at = sorted(part)
        pcm = b"".join(part[k] for k in at)
        if len(pcm) != total:
            raise ValueError(f"{len(pcm)} samples, {total} said")
        if any(md5) and hashlib.md5((np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the samples fail the stream's MD5")
        out.append(pcm)
        firsts.append(np.array(at, np.int64))
    return out, firsts


def samples_at(stream: bytes, first: int, n: int) -> bytes:
    """n samples from the first one on, of a stream with a seek point for each frame: only their frames are decoded."""
    begin, total, _, points, _ = _open(stream)
    k, to = int(np.searchsorted(points[:, 0], first, side="right")) - 1, int(np.searchsorted(points[:, 0], min(first + n, total)))
    starts = np.append(begin + points[:, 1], len(stream))
    pcm, size, _ = _pcm(np.frombuffer(stream, np.uint8), starts[k:to], np.diff(starts)[k:to])
    whole = b"".join(pcm[i, : size[i]].tobytes() for i in range(to - k))
    return whole[first - int(points[k, 0]) :][:n]


# ---- columns


def encode_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, flac: each text's UTF-8 bytes, with bytes 0 up to a positive multiple of UNIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text", LANES):
                data, offsets = buffers(texts)
                n = np.diff(offsets)
                size = np.maximum(1, -(-n // UNIT)) * UNIT
                at = np.concatenate([[0], np.cumsum(size)])
                payload = np.zeros(int(at[-1]), np.uint8)
                payload[ragged(at[:-1], n)] = data
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(encode_streams(payload, at), pa.binary())], ["doc_id", "n_bytes", "flac"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, flac binary")


def _groups(streams: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of streams of about LANES samples, as their headers say."""
    at = 0
    size = [int.from_bytes(s[18:26], "big") & ((1 << 36) - 1) for s in streams]
    while at < len(streams):
        to, total = at + 1, size[at]
        while to < len(streams) and total + size[to] <= LANES:
            total += size[to]
            to += 1
        yield at, to
        at = to


def decode_column(media: DataFrame) -> DataFrame:
    """media with payload (the samples read back), blocks (first_sample, n_samples: where each lies in payload), and
    feature: mean, mean square, crossings of the middle and mean step, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(2).to_pylist()
            for a, b in _groups(streams):
                pcm, first = decode_streams(streams[a:b])
                told, sizes = [], [np.diff(np.append(f, len(p))) for f, p in zip(first, pcm, strict=True)]
                for p, f in zip(pcm, first, strict=True):
                    x = np.frombuffer(p, np.uint8).astype(np.int16) - 128
                    n, step, power = max(1, len(x)), np.abs(np.diff(x)), int(np.square(x, dtype=np.int32).sum(dtype=np.int64))
                    told.append(f"frames={len(f)};mean={int(x.sum(dtype=np.int64)) * 1000 // n};power={power * 1000 // n};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};step={int(step.sum(dtype=np.int64)) * 1000 // n}")
                places = pa.StructArray.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(sizes).astype(np.int32))], ["first_sample", "n_samples"])
                blocks = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]).astype(np.int32)), places)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(pcm, pa.binary()), blocks, pa.array(told)], ["doc_id", "n_bytes", "flac", "payload", "blocks", "feature"])

    return media.select("doc_id", "n_bytes", "flac").mapInArrow(run, "doc_id long, n_bytes long, flac binary, payload binary, blocks array<struct<first_sample:long,n_samples:int>>, feature string")


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """doc_id, block, first_sample, n_samples, pcm (unsigned 8-bit): a row for each block of decode_column's rows."""
    rows = decoded.select("doc_id", "payload", F.posexplode("blocks").alias("block", "b"))
    return rows.select("doc_id", "block", "b.first_sample", "b.n_samples", F.expr("substring(payload, cast(b.first_sample + 1 as int), b.n_samples)").alias("pcm"))


def write_blocks(decoded: DataFrame, path: str) -> DataFrame:
    """Write pcm_blocks, ordered by document and sample, and return the table that was written."""
    pcm_blocks(decoded).sortWithinPartitions("doc_id", "first_sample").write.parquet(path)
    return decoded.sparkSession.read.parquet(path)


def read_samples(blocks: DataFrame, first: int, n: int) -> DataFrame:
    """doc_id, first_sample, pcm: the blocks' parts of samples first to first + n - 1, found by their offsets."""
    low, high = F.greatest(F.col("first_sample"), F.lit(first)), F.least(F.col("first_sample") + F.col("n_samples"), F.lit(first + n))
    held = blocks.where((F.col("first_sample") < first + n) & (F.col("first_sample") + F.col("n_samples") > first))
    return held.select("doc_id", low.alias("first_sample"), F.substring("pcm", (low - F.col("first_sample") + 1).cast("int"), (high - low).cast("int")).alias("pcm"))


def op1_flac_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams are a written table that is read back; last_block_crc32 is of the last PCM block, by its offset."""
    tune(spark)
    media = staged(encode_column(table(spark, sf_dir, "documents")), "media", compression="zstd")
    read = decode_column(media)
    last = F.element_at("blocks", -1)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("flac").cast("long").alias("media_bytes"),
        F.sha2("flac", 256).alias("media_sha256"),
        "feature",
        F.size("blocks").alias("blocks"),
        last["first_sample"].alias("last_sample"),
        F.crc32(F.substring("payload", (last["first_sample"] + 1).cast("int"), last["n_samples"])).alias("last_block_crc32"),
    )
