"""A media column in FLAC: 8-bit mono streams of fixed 192-sample frames, and a decoder that verifies them.

The encoder gives each frame the cheapest of constant, verbatim, fixed predictors of order 0 to 2 and a quantised linear
predictor of order 4 (from the frame's own autocorrelation), with Rice-coded residuals. The decoder finds frames by sync code,
header checksum and running number, verifies the checksum of each, decodes Rice residuals (any partition order) and
any linear or fixed predictor, and returns PCM, which pcm_blocks() deals into blocks with their sample offsets.
Both work on all frames of a batch at once: a step handles the same sample of every frame, so a stream of any length costs
bounded memory and no Python loop over samples.

A media column's samples are ranks of bytes (companding), so that Rice codes of text are short; the mapping is one to one.

Defined results: a null text is an empty payload of one frame of blanks; equal payloads give equal streams, whatever else is
in the batch; repeated rows are coded one by one; an empty table gives no rows; other columns than those named are ignored.
A damaged stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import written

BLOCK = 192
RATE = 8000
SEEK_FRAMES = 64
_CHUNK = 4096  # frames coded at once
_LPC, _PRECISION = 4, 7
_HEAD = bytes([0xFF, 0xF8, 0x14, 0x02])  # sync, fixed blocking; 192 samples at 8 kHz; mono of 8 bits
#: Fixed predictors as linear ones, by order.
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _table(poly: int, width: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1), (out << 1) ^ poly, out << 1) & ((1 << width) - 1)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _rows(buf: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """width bytes from each start, as a column for each byte; zeros beyond the buffer."""
    padded = np.concatenate([buf, np.zeros(width, np.uint8)])
    return padded[start[None, :] + np.arange(width)[:, None]]


def crc8(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), np.uint32)
    for j, byte in enumerate(_rows(buf, start, int(size.max(initial=0)))):
        crc = np.where(j < size, _CRC8[crc ^ byte], crc)
    return crc


def crc16(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    crc, whole = np.zeros(len(start), np.uint32), int(size.min(initial=0))
    for j, byte in enumerate(_rows(buf, start, int(size.max(initial=0)))):
        now = ((crc << 8) & 0xFFFF) ^ _CRC16[(crc >> 8) ^ byte]
        crc = now if j < whole else np.where(j < size, now, crc)
    return crc


def _number_size(n: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 style coding of frame numbers."""
    return 1 + (np.asarray(n)[:, None] >= np.array([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31])).sum(1)


# --- encoding ----------------------------------------------------------------------------------------------


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Rice parameter and its bits, by frame."""
    n, total = u.shape[1], u.sum(1, dtype=np.int64)
    k0 = np.floor(np.log2(np.maximum(total // n, 1))).astype(np.int32)
    best_k, best = None, None
    for d in (0, 1):
        k = np.clip(k0 + d - (total < n), 0, 14)
        bits = n * (1 + k.astype(np.int64)) + (u >> k[:, None]).sum(1, dtype=np.int64)
        best_k, best = (k, bits) if best is None else (np.where(bits < best, k, best_k), np.minimum(bits, best))
    return best_k, best


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 31)


def _linear(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of each frame's order-4 predictor (Levinson-Durbin)."""
    r = np.stack([(s[:, j:] * s[:, : BLOCK - j]).sum(1, dtype=np.int64) for j in range(_LPC + 1)], 1).astype(np.float64)
    a, err = np.zeros((len(s), _LPC)), np.maximum(r[:, 0], 1.0)
    for i in range(_LPC):
        acc = r[:, i + 1].copy()
        for j in range(i):
            acc -= a[:, j] * r[:, i - j]
        k = acc / err
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, err = new, np.maximum(err * (1 - k * k), 1e-6)
    top = (1 << (_PRECISION - 1)) - 1
    most = np.maximum(np.abs(a).max(1), 1e-3)
    shift = np.clip(np.floor(np.log2(top / most)), 0, 15).astype(np.int32)
    coef = np.clip(np.round(a * (2.0 ** shift)[:, None]), -top - 1, top).astype(np.int32)
    return coef, shift


def _encode_chunk(s: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames, and the size of each."""
    n = len(s)
    e = {0: s, 1: np.diff(s, axis=1), 2: np.diff(s, n=2, axis=1)}
    coef, shift = _linear(s)
    pred = np.zeros((n, BLOCK - _LPC), np.int32)
    for j in range(_LPC):
        pred += coef[:, j : j + 1] * s[:, _LPC - 1 - j : BLOCK - 1 - j]
    e[3] = s[:, _LPC:] - (pred >> shift[:, None])
    order, head, u, ks, cost = [0, 1, 2, _LPC], [0, 0, 0, 9 + _LPC * _PRECISION], [], [], []
    for c in range(4):
        z = _zigzag(e[c])
        k, bits = _rice(z)
        u.append(z)
        ks.append(k)
        cost.append(18 + 8 * order[c] + head[c] + bits)
    cost += [np.full(n, 8 + 8 * BLOCK), np.where((s == s[:, :1]).all(1), 16, 1 << 40)]
    kind = np.argmin(np.stack(cost), 0)  # 0-2 fixed, 3 linear, 4 verbatim, 5 constant
    bits = np.take_along_axis(np.stack(cost), kind[None], 0)[0]
    n_head = 5 + _number_size(number)
    size = n_head + -(-bits // 8) + 2
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    out = np.zeros(int(size.sum()) * 8, np.uint8)
    base = (start + n_head) * 8

    def put(pos: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            out[pos + b] = (value >> (width - 1 - b)) & 1

    put(base, np.array([8, 9, 10, 32 + _LPC - 1, 1, 0])[kind] << 1, 8)
    for i in range(BLOCK):  # samples as they are: the first ones of a predictor, or all
        raw = np.flatnonzero(np.array([0, 1, 2, _LPC, BLOCK, 1])[kind] > i) if i < _LPC else raw_all
        if i == _LPC - 1:
            raw_all = np.flatnonzero(kind == 4)
        if i >= _LPC and not len(raw_all):
            break
        put(base[raw] + 8 + 8 * i, s[raw, i], 8)
    for c in range(4):
        x = np.flatnonzero(kind == c)
        if not len(x):
            continue
        at = base[x] + 8 + 8 * order[c]
        if c == 3:
            put(at, np.full(len(x), _PRECISION - 1), 4)
            put(at + 4, shift[x], 5)
            for j in range(_LPC):
                put(at + 9 + j * _PRECISION, coef[x, j], _PRECISION)
            at = at + head[c]
        k, z = ks[c][x], u[c][x]
        put(at, k, 10)  # method 0, one partition, its parameter
        q = z >> k[:, None]
        width = q + 1 + k[:, None]
        stop = (at + 10)[:, None] + np.cumsum(width, 1) - k[:, None] - 1
        out[stop.ravel()] = 1
        for b in range(int(k.max())):
            y = np.flatnonzero(k > b)
            out[(stop[y] + (k[y] - b)[:, None]).ravel()] = ((z[y] >> b) & 1).ravel()
    buf = np.packbits(out)
    for j, v in enumerate(_HEAD):
        buf[start + j] = v
    n_num = n_head - 5
    for w in np.unique(n_num):
        x = np.flatnonzero(n_num == w)
        if w == 1:
            buf[start[x] + 4] = number[x]
        else:
            for j in range(w):
                v = number[x] >> (6 * (w - 1 - j))
                buf[start[x] + 4 + j] = (((0xFF << (8 - w)) & 0xFF) | v) if j == 0 else (0x80 | (v & 0x3F))
    buf[start + n_head - 1] = crc8(buf, start, n_head - 1)
    crc = crc16(buf, start, size - 2)
    buf[start + size - 2], buf[start + size - 1] = crc >> 8, crc & 255
    return buf, size


# Bytes by how common they are in prose; those not named follow in their natural order.
COMMON = b" etaoinsrhldcumpfgwybvkxjqz.,"
_RANKED = list(dict.fromkeys([*COMMON, *range(256)]))
#: Byte b is stored as the sample of its rank: 0, -1, 1, -2, 2 and so on, so that common bytes have small samples and short codes.
_SAMPLE = {b: 128 + (r + 1) // 2 * (-1 if r % 2 else 1) for r, b in enumerate(_RANKED)}
_TO_SAMPLE = bytes(_SAMPLE[b] for b in range(256))
_TO_BYTE = bytes(_TO_SAMPLE.index(x) for x in range(256))


def companded(raw: bytes) -> bytes:
    """The bytes as encode() takes them for a media column."""
    return raw.translate(_TO_SAMPLE)


def expanded(pcm: np.ndarray) -> bytes:
    """The payload's bytes from a media column's samples."""
    return (pcm.view(np.uint8) ^ 0x80).tobytes().translate(_TO_BYTE)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of a positive multiple of 192 bytes; byte b is the sample b - 128."""
    if not payloads:
        return []
    frames = np.array([len(p) // BLOCK for p in payloads])
    s = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int32) - 128
    first = np.concatenate([[0], np.cumsum(frames)])
    number = np.arange(len(s)) - np.repeat(first[:-1], frames)
    parts = [_encode_chunk(s[i : i + _CHUNK], number[i : i + _CHUNK]) for i in range(0, len(s), _CHUNK)]
    data, size = b"".join(p[0].tobytes() for p in parts), np.concatenate([p[1] for p in parts])
    end = np.concatenate([[0], np.cumsum(size)])
    signed = (s.astype(np.int8)).tobytes()
    out = []
    for d, n in enumerate(frames):
        a, b = first[d], first[d + 1]
        md5 = hashlib.md5(signed[a * BLOCK : b * BLOCK]).digest()
        sizes = size[a:b]
        info = BLOCK.to_bytes(2) * 2 + int(sizes.min()).to_bytes(3) + int(sizes.max()).to_bytes(3)
        info += (RATE << 44 | 0 << 41 | 7 << 36 | int(n) * BLOCK).to_bytes(8) + md5
        seek = b"".join((int(i) * BLOCK).to_bytes(8) + int(end[a + i] - end[a]).to_bytes(8) + BLOCK.to_bytes(2) for i in range(0, n, SEEK_FRAMES))
        out.append(b"fLaC\x00" + len(info).to_bytes(3) + info + b"\x83" + len(seek).to_bytes(3) + seek + data[end[a] : end[b]])
    return out


# --- decoding ----------------------------------------------------------------------------------------------


def _stream(raw: bytes) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """Where frames start, samples, MD5 and seek points (sample, offset) of a stream."""
    if raw[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, total, md5, seek = 4, None, b"", []
    while True:
        head, n = raw[at], int.from_bytes(raw[at + 1 : at + 4])
        body = raw[at + 4 : at + 4 + n]
        if head & 127 == 0:
            word = int.from_bytes(body[10:18])
            if body[:2] != BLOCK.to_bytes(2) or body[2:4] != body[:2] or word >> 41 & 7 or word >> 36 & 31 != 7:
                raise ValueError("only 8-bit mono of 192-sample blocks is read")
            total, md5 = word & ((1 << 36) - 1), body[18:34]
        elif head & 127 == 3:
            seek = [(int.from_bytes(body[i : i + 8]), int.from_bytes(body[i + 8 : i + 16])) for i in range(0, n, 18)]
        at += 4 + n
        if head & 128:
            break
    if total is None:
        raise ValueError("no stream information")
    return at, total, md5, seek


def _headers(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number and header size wherever a frame header with a right checksum stands."""
    hit = np.flatnonzero(buf[: max(len(buf) - 5, 0)] == _HEAD[0])
    for j in (1, 2, 3):
        hit = hit[buf[hit + j] == _HEAD[j]]
    rows = _rows(buf, hit, 11).astype(np.int64)
    lead = rows[4]
    w = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 0, 2, 3, 4, 5, 6], 7)
    number = np.where(w == 1, lead, lead & ((1 << np.maximum(7 - w, 0)) - 1))
    for j in range(1, 7):
        number = np.where(j < w, number << 6 | (rows[4 + j] & 0x3F), number)
    size = 5 + w
    good = (w > 0) & (hit + size <= len(buf))
    good[good] = crc8(buf, hit[good], size[good] - 1) == buf[hit[good] + size[good] - 1]
    return hit[good], number[good], size[good]


def _decode_chunk(buf: np.ndarray, start: np.ndarray, size: np.ndarray, n_head: np.ndarray) -> np.ndarray:
    """Samples of the frames (a row each)."""
    if (crc16(buf, start, size) != 0).any():
        raise ValueError("a frame's checksum is wrong")
    lo, hi = int(start.min()), int((start + size).max())
    part = np.concatenate([buf[lo:hi], np.zeros(8, np.uint8)]).astype(np.uint32)
    wide = (part[:-3] << 24) | (part[1:-2] << 16) | (part[2:-1] << 8) | part[3:]  # 32 bits from each byte
    narrow = (wide >> np.uint32(8)).astype(np.int32)  # 24 bits
    bits = np.unpackbits(part.astype(np.uint8))
    one = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
    one = np.minimum.accumulate(one[::-1])[::-1]  # the next set bit at or after each

    def get(pos: np.ndarray, width) -> np.ndarray:
        """width bits (24 at most) at each position."""
        width = np.asarray(width, np.uint32)
        return ((wide[pos >> 3] >> (np.uint32(32) - (pos & 7).astype(np.uint32) - width)) & ((np.uint32(1) << width) - np.uint32(1))).astype(np.int32)

    signed = lambda v, w: v - ((v >> (w - 1)) << w)
    n, pos = len(start), (((start - lo) + n_head) * 8).astype(np.int32)
    kind = get(pos, 8)
    if ((kind & 0x81) != 0).any():
        raise ValueError("wasted bits aren't read")
    kind, pos = kind >> 1, pos + 8
    fixed, linear, flat, plain = (kind >= 8) & (kind <= 12), kind >= 32, kind == 0, kind == 1
    if not (fixed | linear | flat | plain).all():
        raise ValueError("a reserved kind of subframe")
    order = np.select([fixed, linear, plain], [kind - 8, kind - 31, BLOCK], 1)
    most = int(np.where(plain, 1, order).max())
    out = np.zeros((BLOCK, n), np.int32)
    for i in range(BLOCK if plain.any() else most):
        x = np.flatnonzero(order > i)
        out[i, x] = signed(get(pos[x], 8), 8)
        pos[x] += 8
    coef, shift = np.zeros((most, n), np.int32), np.zeros(n, np.int32)
    for o in range(1, 5):
        for j, c in enumerate(_FIXED[o][:most]):
            coef[j, fixed & (order == o)] = c
    x = np.flatnonzero(linear)
    if len(x):
        width = get(pos[x], 4) + 1
        shift[x] = get(pos[x] + 4, 5)
        pos[x] += 9
        for j in range(int(order[x].max())):
            y = order[x] > j
            coef[j, x[y]] = signed(get(pos[x[y]], width[y]), width[y])
            pos[x[y]] += width[y]
    rice = np.flatnonzero(fixed | linear)
    if len(rice):
        p, o = pos[rice], order[rice]
        method, parts = get(p, 2), get(p + 2, 4)
        if (method != 0).any():
            raise ValueError("only 4-bit Rice parameters are read")
        p, span = p + np.int32(6), BLOCK >> parts
        k, res, simple = np.zeros(len(rice), np.int32), out[:, rice], not parts.any()
        room, mask = 24 - k, k
        late = int(o.max(initial=0))
        for i in range(BLOCK):
            new = (i == o) if simple else ((i % span == 0) & (i > o)) | (i == o)
            if (i <= late or not simple) and new.any():
                y = np.flatnonzero(new)
                k[y] = get(p[y], 4)
                p[y] += 4
                if (k[y] == 15).any():
                    raise ValueError("escaped partitions aren't read")
                room, mask = 24 - k, (np.int32(1) << k) - np.int32(1)
            stop = one[p]
            u = (stop - p) << k
            stop += np.int32(1)
            u |= (narrow[stop >> 3] >> (room - (stop & 7))) & mask
            value, after = (u >> 1) ^ -(u & 1), stop + k
            if i < late:
                live = i >= o
                res[i] = np.where(live, value, res[i])
                p = np.where(live, after, p)
            else:
                res[i], p = value, after
        for w in np.unique(o[o > 0]):  # frames of one order at a time; those of order 0 are their residuals
            x = np.flatnonzero(o == w)
            c, sh, r = coef[:w, rice[x]], shift[rice[x]], res[:, x]
            for i in range(w, BLOCK):
                pred = c[0] * r[i - 1]
                for j in range(1, w):
                    pred += c[j] * r[i - 1 - j]
                r[i] += pred >> sh
            res[:, x] = r
        out[:, rice] = res
    out[1:, flat] = out[0, flat]
    return out.T


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples (int8) of each stream, with checksums of frames and stream verified."""
    if not streams:
        return []
    info = [_stream(x) for x in streams]
    frames = [np.frombuffer(x, np.uint8, offset=i[0]) for x, i in zip(streams, info, strict=True)]
    edge = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
    buf = np.concatenate(frames)
    start, number, n_head = _headers(buf)
    cut = np.searchsorted(start, edge)
    pick = []
    for d, (_, total, _, _) in enumerate(info):
        mine = np.arange(cut[d], cut[d + 1])
        if not np.array_equal(number[mine], np.arange(total // BLOCK)):  # a header's likeness inside a frame
            want, chain = 0, []
            for i in mine:
                if number[i] == want:
                    chain.append(i)
                    want += 1
            mine = np.array(chain, np.int64)
        if len(mine) * BLOCK != total or start[mine[0]] != edge[d]:
            raise ValueError("frames are missing")
        pick.append(mine)
    n_frames = np.array([len(x) for x in pick])
    at = np.concatenate(pick)
    begin = start[at]
    end = np.append(begin[1:], edge[-1])
    pcm = [_decode_chunk(buf, begin[i : i + _CHUNK], (end - begin)[i : i + _CHUNK], n_head[at[i : i + _CHUNK]]) for i in range(0, len(at), _CHUNK)]
    whole = np.concatenate(pcm)
    if whole.min(initial=0) < -128 or whole.max(initial=0) > 127:
        raise ValueError("a sample is out of range")
    whole, first = whole.astype(np.int8), np.concatenate([[0], np.cumsum(n_frames)])
    out = [np.ascontiguousarray(whole[first[d] : first[d + 1]]).ravel() for d in range(len(streams))]
    for x, (_, _, md5, _) in zip(out, info, strict=True):
        if hashlib.md5(x.tobytes()).digest() != md5:
            raise ValueError("the stream's MD5 is wrong")
    return out


def feature(pcm: np.ndarray) -> str:
    """Frames, extremes, mean magnitude in thousandths, sign changes and mean step in thousandths."""
    x = pcm.astype(np.int64)
    steps = int(np.abs(np.diff(x)).sum())
    return f"frames={len(x) // BLOCK};min={x.min()};max={x.max()};level={int(np.abs(x).sum()) * 1000 // len(x)};turns={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};step={steps * 1000 // len(x)}"


# --- DataFrames --------------------------------------------------------------------------------------------


def _groups(sizes: list[int], limit: int = 1_500_000) -> Iterator[slice]:
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if len(sizes) > at:
        yield slice(at, len(sizes))


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the texts as a media column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = [len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts]
            for g in _groups(sizes):
                part = [companded(payload(t.as_py())) for t in texts[g]]
                yield pa.RecordBatch.from_arrays([ids[g], pa.array(sizes[g], pa.int64()), pa.array(encode(part), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media column, written to the shared folder and read from there."""
    return written(encoded(df, id_col, text_col), "media")


def read_back(media: DataFrame) -> DataFrame:
    """What the stored streams decode to: digests of payload and media, and the feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(m.as_buffer()) for m in batch.column(2)]
            for g in _groups(sizes):
                part = batch.slice(g.start, g.stop - g.start)
                raw = part.column(2).to_pylist()
                rows = []
                for doc, n, m, pcm in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw, decode(raw), strict=True):
                    whole, tail, size = hashlib.sha256(), b"", 0
                    for _, block in blocks(pcm):
                        back = expanded(block)
                        whole.update(back)
                        tail, size = (tail + back)[-16:], size + len(back)
                    rows.append((doc, n, size, whole.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), feature(pcm)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def blocks(pcm: np.ndarray, frames: int = SEEK_FRAMES) -> Iterator[tuple[int, np.ndarray]]:
    """(sample offset, samples) of stretches of `frames` frames."""
    for at in range(0, len(pcm), frames * BLOCK):
        yield at, pcm[at : at + frames * BLOCK]


def pcm_blocks(media: DataFrame, frames: int = SEEK_FRAMES) -> DataFrame:
    """(doc_id, block, sample_offset, n_samples, pcm): decoded blocks of `frames` frames that can be sought by sample; expanded() gives their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, parts = zip(*blocks(decode([m])[0], frames), strict=True)
                cols = [pa.array([doc] * len(at), pa.int64()), pa.array(range(len(at)), pa.int64()), pa.array(at, pa.int64()), pa.array([len(x) for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "block", "sample_offset", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, sample_offset long, n_samples long, pcm binary")


def seek(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """(first sample, samples) of the stretch between seek points that holds `sample`, decoding nothing else."""
    at, total, _, points = _stream(stream)
    i = max(j for j, (s, _) in enumerate(points) if s <= sample)
    last = points[i + 1] if i + 1 < len(points) else (total, len(stream) - at)
    buf = np.frombuffer(stream, np.uint8)[at + points[i][1] : at + last[1]]
    start, number, n_head = _headers(buf)
    good = number == points[i][0] // BLOCK + np.arange(len(number))
    start, n_head = start[good], n_head[good]
    return points[i][0], _decode_chunk(buf, start, np.append(start[1:], len(buf)) - start, n_head).astype(np.int8).ravel()
