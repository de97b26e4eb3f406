"""Media columns: FLAC streams of 8-bit mono samples, many streams at a time.

The decoder follows the public FLAC format (RFC 9639) for one channel of 8 bits: it reads constant, verbatim, fixed and
linear-predicted subframes with partitioned Rice residuals, checks the CRC-8 of every frame header, the CRC-16 of every
frame and the MD5 of the samples. The frames of a batch advance side by side, one sample at a time, so that each step
is a few numpy operations over all of them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks

#: Samples of a block; samples a second (of no account here, but the header has a place for it); largest predictor order.
BLOCK, RATE, ORDER = 1024, 8000, 4
#: Coefficients of the fixed predictors of orders 0 to 4, latest sample first (fixed values of the format).
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)
#: Precision and shift of the linear predictors' quantised coefficients.
PRECISION, SHIFT = 8, 5


def _crc_table(width: int, polynomial: int) -> np.ndarray:
    value = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        value = np.where(value >> (width - 1) & 1, value << 1 ^ polynomial, value << 1) & (1 << width) - 1
    return value


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005).astype(np.uint16)


def crc8(data: bytes) -> int:
    value = 0
    for b in data:
        value = int(_CRC8[value ^ b])
    return value


def crc16s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-16 of every span, all advanced together, longest first."""
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order].copy(), (ends - starts)[order]
    value = np.zeros(len(order), np.uint16)
    alive = len(order)
    counts = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), "right")
    for alive in counts.tolist():
        v = value[:alive]
        value[:alive] = (v << 8) ^ _CRC16[(v >> 8) ^ data[at[:alive]]]
        at[:alive] += 1
    out = np.empty_like(value)
    out[order] = value
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's variable-length form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1) & 0xFF) | n, *reversed(tail)])


def _header(number: int, size: int) -> bytes:
    raw = b"\xff\xf8" + (b"\xa4" if size == 1024 else b"\x74") + b"\x02" + _number(number)  # 1024 samples, or 16 bits of size; 8 kHz; mono, 8 bits
    if size != 1024:
        raw += struct.pack(">H", size - 1)
    return raw + bytes([crc8(raw)])


_HEADERS: dict[tuple[int, int], bytes] = {}


def _predictors(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every frame the residuals of its best predictor, its kind (0 to 4 fixed, 5 linear), coefficients and shift."""
    inside = np.arange(BLOCK)[None, :] < size[:, None]
    f = len(x)
    best = np.full(f, np.iinfo(np.int64).max)
    kind, coef, shift = np.zeros(f, np.int64), np.zeros((f, ORDER), np.int64), np.zeros(f, np.int64)
    out = np.zeros_like(x)

    def offer(k: int, c: np.ndarray, s: int, order: int) -> None:
        guess = np.zeros_like(x)
        c32 = c.astype(np.int32)
        for j in range(order):
            guess[:, j + 1 :] += c32[:, j : j + 1] * x[:, : BLOCK - j - 1]
        r = x - (guess >> s) if s else x - guess
        r[~inside] = 0
        cost = np.abs(r[:, order:]).sum(1) + 8 * order
        take = cost < best
        best[take], kind[take], coef[take], shift[take], out[take] = cost[take], k, c[take], s, r[take]

    for k in range(3):
        offer(k, np.broadcast_to(FIXED[k], (f, ORDER)), 0, k)
    y = (x * inside).astype(np.float32)
    y -= y.sum(1, keepdims=True) / size[:, None] * inside
    auto = np.stack([np.einsum("ij,ij->i", y[:, k:], y[:, : BLOCK - k]) for k in range(ORDER + 1)], 1).astype(np.float64)
    auto[:, 0] = auto[:, 0] * 1.001 + 1e-3
    lag = np.abs(np.arange(ORDER)[:, None] - np.arange(ORDER)[None, :])
    solved = np.linalg.solve(auto[:, lag], auto[:, 1:, None])[:, :, 0]
    most = (1 << PRECISION - 1) - 1
    q = np.clip(np.rint(solved * (1 << SHIFT)), -most - 1, most).astype(np.int64)
    offer(5, q, SHIFT, ORDER)
    return out, kind, coef, shift


def encode(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One stream per span of ``data``: bytes b as samples b - 128. Each span has 16 bytes at least."""
    sizes = np.diff(offsets)
    blocks = (sizes + BLOCK - 1) // BLOCK
    # a last block of under 16 samples isn't allowed to precede others, but may end a stream
    doc = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[doc] + number * BLOCK
    size = np.minimum(BLOCK, sizes[doc] - number * BLOCK)
    frames: list[bytes] = []
    for a in range(0, len(doc), 512):
        frames += _encode_frames(data, start[a : a + 512], size[a : a + 512], number[a : a + 512])
    out, at = [], 0
    for d, n in enumerate(blocks.tolist()):
        own = frames[at : at + n]
        at += n
        raw = data[offsets[d] : offsets[d + 1]]
        lengths = [len(x) for x in own]
        digest = hashlib.md5((raw ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(raw)).to_bytes(8, "big") + digest
        points = b"".join(struct.pack(">QQH", i * BLOCK, o, min(BLOCK, len(raw) - i * BLOCK)) for i, o in enumerate([0, *np.cumsum(lengths[:-1]).tolist()]))
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


def _encode_frames(data: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> list[bytes]:
    f = len(start)
    at = np.minimum(start.astype(np.int32)[:, None] + np.arange(BLOCK, dtype=np.int32)[None, :], len(data) - 1)
    inside = np.arange(BLOCK)[None, :] < size[:, None]
    x = np.where(inside, data[at].astype(np.int32) - 128, 0).astype(np.int32)
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(1)
    r, kind, coef, shift = _predictors(x, size)
    order = np.minimum(kind, ORDER)
    coded = inside & (np.arange(BLOCK)[None, :] >= order[:, None])
    z = np.where(r < 0, -2 * r - 1, 2 * r)
    n = size - order
    total = (z * coded).sum(1)
    parameter = np.clip(np.floor(np.log2(np.maximum(total / np.maximum(n, 1), 1))).astype(np.int64), 0, 14)
    bits = []
    for p in (0, 1):
        k = np.minimum(parameter + p, 14)
        bits.append(((z >> k.astype(np.int32)[:, None]) * coded).sum(1) + (1 + k) * n)
    parameter = np.where(bits[1] < bits[0], np.minimum(parameter + 1, 14), parameter)
    residual_bits = np.minimum(bits[0], bits[1])
    linear = kind == 5
    body = 8 * order + linear * (4 + 5 + PRECISION * ORDER) + 6 + 4 + residual_bits
    verbatim = ~constant & (body >= 8 * size)
    rice = ~constant & ~verbatim
    body = np.where(constant, 8, np.where(verbatim, 8 * size, body))
    heads = []
    for i, s in zip(number.tolist(), size.tolist(), strict=True):
        if (i, s) not in _HEADERS:
            if len(_HEADERS) > 50_000:
                _HEADERS.clear()
            _HEADERS[i, s] = _header(i, s)
        heads.append(_HEADERS[i, s])
    head_size = np.array([len(h) for h in heads])
    whole = head_size + (8 + body + 7) // 8 + 2
    begin = np.cumsum(whole) - whole
    room = np.zeros(int(whole.sum()) * 8, np.uint8)
    bit = (begin + head_size) * 8
    # the subframe's type: six bits after a zero
    code = np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 32 + ORDER - 1, 8 + order)))
    _put(room, bit + 1, code, 6)
    bit = bit + 8
    _put(room, bit[constant], x[constant, 0] & 255, 8)
    if verbatim.any():
        rows, columns = np.nonzero(inside & verbatim[:, None])
        _put(room, bit[rows] + 8 * columns, x[rows, columns] & 255, 8)
    if rice.any():
        for j in range(ORDER):
            own = rice & (order > j)
            _put(room, bit[own] + 8 * j, x[own, j] & 255, 8)
        bit = bit + 8 * order
        own = rice & linear
        _put(room, bit[own], np.full(own.sum(), PRECISION - 1), 4)
        _put(room, bit[own] + 4, shift[own], 5)
        for j in range(ORDER):
            _put(room, bit[own] + 9 + PRECISION * j, coef[own, j] & (1 << PRECISION) - 1, PRECISION)
        bit = bit + linear * (9 + PRECISION * ORDER)
        _put(room, bit[rice] + 6, parameter[rice], 4)  # Rice, one partition: six zeros
        bit = bit + 10
        mine = coded & rice[:, None]
        rows, columns = np.nonzero(mine)
        k, value = parameter[rows], z[mine].astype(np.int64)
        quotient = value >> k
        length = quotient + 1 + k
        ends = np.cumsum(length)
        first = np.zeros(f, np.int64)
        counts = np.bincount(rows, minlength=f)
        heads_at = np.cumsum(counts) - counts
        has = counts > 0
        first[has] = (ends - length)[heads_at[has]]
        place = bit[rows] + (ends - length) - first[rows] + quotient
        room[place] = 1
        least = int(k.min()) if len(k) else 0
        for b in range(int(k.max()) if len(k) else 0):
            if b < least:
                room[place + (k - b)] = value >> b & 1
            else:
                own = k > b
                room[place[own] + k[own] - b] = value[own] >> b & 1
    packed = np.packbits(room)
    for h, b in zip(heads, begin.tolist(), strict=True):
        packed[b : b + len(h)] = np.frombuffer(h, np.uint8)
    ends = begin + whole - 2
    sums = crc16s(packed, begin, ends)
    packed[ends], packed[ends + 1] = sums >> 8, sums & 255
    raw = packed.tobytes()
    return [raw[a:b] for a, b in zip(begin.tolist(), (begin + whole).tolist(), strict=True)]


def _put(room: np.ndarray, at: np.ndarray, value: np.ndarray, bits: int) -> None:
    for b in range(bits):
        room[at + bits - 1 - b] = value >> b & 1


class Stream:
    """The metadata of one stream: its number of samples, its MD5, seek points and where its frames begin."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, self.points = 4, []
        while True:
            last, kind, size = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
            body = raw[at + 4 : at + 4 + size]
            at += 4 + size
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, channels, bits, self.total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.block, self.md5 = int.from_bytes(body[2:4], "big"), body[18:34]
                if (channels, bits) != (1, 8):
                    raise ValueError("one channel of 8 bits is read")
            elif kind == 3:
                self.points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
            if last:
                break
        self.frames, self.raw = at, raw


def _frame_header(raw: bytes, at: int) -> tuple[int, int, int]:
    """(frame number, samples, bytes of the header); its CRC-8 must hold."""
    if raw[at] != 0xFF or raw[at + 1] != 0xF8:
        raise ValueError("no frame here")
    code, end = raw[at + 2] >> 4, at + 4
    lead = raw[end]
    more = 0
    while lead & 0x80 >> more:
        more += 1
    number = lead & 0x7F >> more
    for b in raw[end + 1 : end + max(more, 1)]:
        number = number << 6 | b & 0x3F
    end += max(more, 1)
    if code == 6:
        size, end = raw[end] + 1, end + 1
    elif code == 7:
        size, end = int.from_bytes(raw[end : end + 2], "big") + 1, end + 2
    else:
        size = 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8
    if crc8(raw[at:end]) != raw[end]:
        raise ValueError("the frame header's CRC-8 doesn't hold")
    return number, size, end + 1 - at


_SEEN: dict[bytes, tuple[int, int, int]] = {}


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """The PCM blocks (sample offset, samples as unsigned bytes) of every stream; raises where a checksum fails.

    Seek points at every frame make the frames known before they are read, as this module's streams have them.
    """
    spans: list[tuple[int, int, int, int, int]] = []  # stream, sample offset, samples, first byte, end
    base, heads = 0, []
    for s, raw in enumerate(streams):
        head = Stream(raw)
        heads.append(head)
        starts = [p[1] + head.frames for p in head.points] or _frame_starts(head)
        offset = 0
        for a, b in zip(starts, [*starts[1:], len(raw)], strict=True):
            key = raw[a : a + 16]
            if key not in _SEEN:
                if len(_SEEN) > 50_000:
                    _SEEN.clear()
                _SEEN[key] = _frame_header(raw, a)
            _, size, skip = _SEEN[key]
            spans.append((s, offset, size, base + a + skip, base + b))
            spans[-1] = (*spans[-1], base + a)
            offset += size
        base += len(raw)
    data = np.frombuffer(b"".join(streams), np.uint8)
    blocks: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    for a in range(0, len(spans), 1024):
        part = spans[a : a + 1024]
        s, offset, size, first, end, head_at = (np.array(c, np.int64) for c in zip(*part, strict=True))
        sums = crc16s(data, head_at, end - 2)
        if (sums != (data[end - 2].astype(np.uint16) << 8 | data[end - 1])).any():
            raise ValueError("a frame's CRC-16 doesn't hold")
        x = _decode_frames(data[head_at[0] : end[-1]], first - head_at[0], size)
        samples = (x + 128).astype(np.uint8)
        for i in range(len(part)):
            blocks[int(s[i])].append((int(offset[i]), samples[i, : size[i]].tobytes()))
    for head, own in zip(heads, blocks, strict=True):
        pcm = np.frombuffer(b"".join(b for _, b in own), np.uint8)
        if len(pcm) != head.total or hashlib.md5((pcm ^ 0x80).tobytes()).digest() != head.md5:
            raise ValueError("the samples' MD5 doesn't hold")
    return blocks


def _frame_starts(head: Stream) -> list[int]:
    """Where the frames of a stream without seek points begin: sync codes whose header, number and CRC-16 before hold."""
    raw, starts, at = head.raw, [], head.frames
    while (at := raw.find(b"\xff\xf8", at)) >= 0:
        try:
            number, _, _ = _frame_header(raw, at)
            fits = number == len(starts)
            if fits and starts:
                before = np.frombuffer(raw[starts[-1] : at], np.uint8)
                fits = int(crc16s(before, np.array([0]), np.array([len(before)]))[0]) == 0
        except (ValueError, IndexError):
            fits = False
        if fits:
            starts.append(at)
        at += 1
    return starts


def _decode_frames(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    f, width = len(first), int(size.max())
    bits = np.unpackbits(np.concatenate([data, np.zeros(8, np.uint8)]))
    word = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    window = word[:-7] << 24 | word[1:-6] << 16 | word[2:-5] << 8 | word[3:-4]  # 32 bits from each byte on

    def get(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Up to 24 bits from bit ``at`` on."""
        return window[at >> 3] >> (32 - (at & 7) - n) & ((1 << n) - 1)

    def signed(v: np.ndarray, n: int) -> np.ndarray:
        return v - ((v >> n - 1) << n)

    ones = np.flatnonzero(bits).astype(np.int32)
    rank = np.zeros(len(bits) + 1, np.int32)
    np.cumsum(bits, out=rank[1:], dtype=np.int32)
    kind, at = get(first * 8 + 1, 6), first * 8 + 8
    if (bits[first * 8] | bits[first * 8 + 7]).any():
        raise ValueError("wasted bits aren't read")
    x = np.zeros((f, width), np.int64)
    own = kind == 0
    x[own] = signed(get(at[own], 8), 8)[:, None]
    own = kind == 1
    if own.any():
        rows, columns = np.nonzero(own[:, None] & (np.arange(width)[None, :] < size[:, None]))
        x[rows, columns] = signed(get(at[rows] + 8 * columns, 8), 8)
    linear, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    rice = np.flatnonzero(linear | fixed)
    if not len(rice):
        return x
    rice = rice[np.argsort(-size[rice], kind="stable")]  # longest first: those still at work stand in front
    order = np.where(linear, kind - 31, kind - 8)[rice]
    n, at, line = size[rice], at[rice], linear[rice]
    deep = max(int(order.max()), 1)
    y = np.zeros((width, len(rice)), np.int64)
    for j in range(int(order.max())):
        live = order > j
        y[j, live] = signed(get(at[live] + 8 * j, 8), 8)
    at = at + 8 * order
    coef, shift = np.zeros((deep, len(rice)), np.int64), np.zeros(len(rice), np.int64)
    for j in range(min(deep, 4)):
        coef[j, ~line] = FIXED[order[~line], j]
    if line.any():
        precision = np.where(line, get(at, 4) + 1, 1)
        shift = np.where(line, signed(get(at + 4, 5), 5), 0)
        at = np.where(line, at + 9, at)
        for j in range(deep):
            live = np.flatnonzero(line & (order > j))
            v = get(at[live] + precision[live] * j, precision[live])
            coef[j, live] = v - (v >> precision[live] - 1 << precision[live])
        at = np.where(line, at + precision * order, at)
    method, parts = get(at, 2), get(at + 2, 4)
    if (method > 1).any():
        raise ValueError("an unknown residual coding")
    wide = 4 + method
    at = at + 6
    per = np.where(parts > 0, n >> parts, width + 1)
    k, raw_bits = np.zeros(len(rice), np.int64), np.zeros(len(rice), np.int64)
    left = per - 0
    simple = bool((parts == 0).all() and (method == 0).all())

    def parameters(rows: np.ndarray) -> None:
        k[rows] = get(at[rows], wide[rows])
        at[rows] += wide[rows]
        raw_bits[rows] = -1
        escaped = rows[k[rows] == (1 << wide[rows]) - 1]
        raw_bits[escaped] = get(at[escaped], 5)
        at[escaped] += 5

    parameters(np.arange(len(rice)))
    simple = simple and bool((raw_bits < 0).all())
    live_of = np.searchsorted(-n, -np.arange(width) - 1, "right")
    lowest = int(order.min())
    for t in range(width):
        m = int(live_of[t])
        if t < lowest:
            if not simple:
                left[:m] -= 1
            continue
        coding = order[:m] <= t
        every = bool(coding.all()) if t < deep else True
        if not simple:
            fresh = np.flatnonzero(coding & (left[:m] == 0))
            if len(fresh):
                parameters(fresh)
                left[fresh] = per[fresh]
            left[:m] -= 1
        a, kk = at[:m], k[:m]
        one = ones[np.minimum(rank[a], len(ones) - 1)].astype(np.int64)
        low_at = one + 1
        value = (one - a) << kk | get(low_at, kk)
        r = (value >> 1) ^ -(value & 1)
        move = low_at + kk
        if not simple and (raw_bits[:m] >= 0).any():
            rb = np.maximum(raw_bits[:m], 0)
            v = get(a, rb)
            plain = np.where(rb > 0, v - np.where(v >> np.maximum(rb - 1, 0) & 1, 1 << rb, 0), 0)
            r = np.where(raw_bits[:m] >= 0, plain, r)
            move = np.where(raw_bits[:m] >= 0, a + rb, move)
        guess = coef[0, :m] * y[t - 1, :m]
        for j in range(1, min(deep, t)):
            guess += coef[j, :m] * y[t - 1 - j, :m]
        r += guess >> shift[:m]
        if every:
            y[t, :m] = r
            at[:m] = move
        else:
            y[t, :m] = np.where(coding, r, y[t, :m])
            at[:m] = np.where(coding, move, a)
    x[rice] = y.T
    return x


def read_samples(raw: bytes, start: int, n: int) -> bytes:
    """Samples ``start`` to ``start + n`` of a stream, decoding only the frames that hold them."""
    head = Stream(raw)
    out = []
    for i, (offset, place, size) in enumerate(head.points):
        if offset + size > start and offset < start + n:
            a = head.frames + place
            b = head.frames + head.points[i + 1][1] if i + 1 < len(head.points) else len(raw)
            _, size, skip = _frame_header(raw, a)
            frame = np.frombuffer(raw[a:b], np.uint8)
            if int(crc16s(frame, np.array([0]), np.array([len(frame)]))[0]):
                raise ValueError("a frame's CRC-16 doesn't hold")
            block = (_decode_frames(frame, np.array([skip]), np.array([size]))[0] + 128).astype(np.uint8).tobytes()
            out.append(block[max(0, start - offset) : start + n - offset])
    return b"".join(out)


def padded(column: pa.Array, pad: int = 64) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts as payloads: (first row, end row, bytes, offsets, sizes without padding)."""
    for i, j, data, offsets in text_chunks(column, 1 << 19):
        sizes = np.diff(offsets)
        room = np.maximum(pad, (sizes + pad - 1) // pad * pad)
        ends = np.cumsum(room)
        out = np.zeros(int(ends[-1]), np.uint8)
        out[np.arange(len(data)) + np.repeat(ends - room - offsets[:-1], sizes)] = data
        yield i, j, out, np.concatenate([[0], ends]), sizes


def encode_media(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media): each text as UTF-8, padded by zero bytes to a positive multiple of 64, as FLAC.

    Null and empty texts are 64 zero bytes. Long texts are streams of as many frames as they need. Equal texts give
    equal streams; repeated rows stay; no rows give no rows. Other columns are not looked at.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets, sizes in padded(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(sizes), pa.array(encode(data, offsets), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media, blocks): PCM blocks (sample_offset, pcm), checked against every checksum."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("pcm", pa.binary())]))
        for batch in batches:
            for i, j, _, _ in text_chunks(batch.column(2), 1 << 20):
                part = batch.slice(i, j - i)
                blocks = decode(part.column(2).to_pylist())
                rows = pa.array([[{"sample_offset": o, "pcm": p} for o, p in own] for own in blocks], kind)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), part.column(2), rows], ["doc_id", "n_bytes", "media", "blocks"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(apply, "doc_id long, n_bytes long, media binary, blocks array<struct<sample_offset:long,pcm:binary>>")


def features(pcm: bytes) -> str:
    """Samples, their sum, energy, sign changes and peak, of samples from -128 to 127: integers, so they are exact."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};turns={turns};peak={int(np.abs(x).max()) if len(x) else 0}"
