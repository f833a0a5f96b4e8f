"""Progressive JPEG: scans are accumulated into coefficient arrays, which numpy turns into full-resolution RGB.

decode() reads Huffman-coded progressive files of 8-bit samples: interleaved DC scans, spectral selection, successive
approximation with refinement, end-of-band runs, restart intervals, any integral subsampling. Where a stretch of a scan repeats one
symbol it is decoded as a matrix, and so are end-of-band runs of refinement scans; both give what going bit by bit gives.

encode_bytes() stores bytes losslessly as AC coefficients: byte b is the coefficient of magnitude category 8 whose appended bits
are b, that is b from 128, else b - 255. The quantisation steps are 1 and the DC coefficients 0.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches

#: Payloads are padded to a positive multiple of so many bytes with bytes 255.
PAYLOAD_UNIT = 576
#: AC coefficients of a block, and blocks of a 4:2:0 unit (four of Y, one each of Cb and Cr).
PER_BLOCK, PER_UNIT = 63, 6


@functools.cache
def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block, row by row, of each coefficient in scan order."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


class Huffman:
    """A table of the file: look[next 16 bits] is length << 8 | symbol, 0 where no code fits."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.look, self.codes, code, at = [0] * 65536, {}, 0, 0
        for size in range(1, 17):
            for _ in range(lengths[size - 1]):
                lo = code << (16 - size)
                hi = lo + (1 << (16 - size))
                self.look[lo:hi] = [size << 8 | symbols[at]] * (hi - lo)
                self.codes[symbols[at]] = (code, size)
                code, at = code + 1, at + 1
            code <<= 1


@functools.lru_cache(maxsize=64)
def _huffman(raw: bytes) -> Huffman:
    return Huffman(raw[:16], raw[16:])


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks that the component's own scans have
    high: int = 0
    coef: np.ndarray = field(default=None, repr=False)  # rows of blocks, blocks, 64 in scan order; padded to whole units


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""


class Bits:
    """Bits of one entropy-coded segment without its stuffing; ones follow its end."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.size = raw, 0, 8 * len(raw)
        self._bits: np.ndarray | None = None

    def peek16(self) -> int:
        byte, off = divmod(self.at, 8)
        three = self.raw[byte : byte + 3] + b"\xff\xff\xff"
        return (three[0] << 16 | three[1] << 8 | three[2]) >> (8 - off) & 0xFFFF

    def symbol(self, table: Huffman) -> int:
        hit = table.look[self.peek16()]
        if not hit or self.at > self.size:
            raise ValueError("no Huffman code fits")
        self.at += hit >> 8
        return hit & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek16() >> (16 - n)
        self.at += n
        return v

    def array(self, n: int) -> np.ndarray:
        """The next n bits."""
        byte, off = divmod(self.at, 8)
        got = np.unpackbits(np.frombuffer(self.raw, np.uint8, max(0, min(len(self.raw), (self.at + n + 7) // 8) - byte), min(byte, len(self.raw))))[off : off + n]
        if len(got) < n:
            raise ValueError("a scan ends early")
        self.at += n
        return got


def _extend(v: int, s: int) -> int:
    return v if s and v >> (s - 1) else v - (1 << s) + 1


def _dc_scan(bits: Bits, blocks: list[tuple[np.ndarray, int, int, Huffman]], first: bool, low: int, preds: list[int]) -> None:
    """blocks: per data unit its component's blocks (flat), index, place in preds, table."""
    i, n = 0, len(blocks)
    if not first:
        got = bits.array(n).tolist()
        for (coef, at, _, _), bit in zip(blocks, got, strict=True):
            coef[at, 0] |= bit << low
        return
    while i < n:
        coef, at, c, table = blocks[i]
        s = bits.symbol(table)
        preds[c] += _extend(bits.take(s), s) if s else 0
        coef[at, 0] = preds[c] << low
        i += 1


def _uniform(bits: Bits, table: Huffman, most: int) -> tuple[int, np.ndarray | None]:
    """How many of the next symbols are the same one of run 0 and size s, and the bits appended to each: decoded at once."""
    hit = table.look[bits.peek16()]
    length, symbol = hit >> 8, hit & 255
    period = length + (symbol & 15)
    most = min(most, (bits.size - bits.at) // period if period else 0)
    if symbol >> 4 or not symbol or most < 16:
        return 0, None
    code, s = table.codes[symbol][0], symbol & 15
    if period == 8 and bits.at % 8 == 0:
        raw = np.frombuffer(bits.raw, np.uint8, most, bits.at // 8)
        same, value = (raw >> s) == code, raw & ((1 << s) - 1)
    else:
        at = bits.at
        grid = bits.array(most * period).reshape(most, period)
        bits.at = at
        same = (grid[:, :length] == [code >> (length - 1 - i) & 1 for i in range(length)]).all(axis=1)
        value = grid[:, length:] @ (1 << np.arange(s - 1, -1, -1))
    n = most if same.all() else int(same.argmin())
    bits.at += n * period
    return n, _signed(value[:n].astype(np.int32), s)


def _signed(v: np.ndarray, s: int) -> np.ndarray:
    return np.where(v >> (s - 1), v, v - ((1 << s) - 1))


def _ac_first(bits: Bits, coef: np.ndarray, table: Huffman, lo: int, hi: int, low: int) -> None:
    """coef: the segment's blocks, in order."""
    i, run, band, tried = 0, 0, hi - lo + 1, -1
    while i < len(coef):
        if run:
            step = min(run, len(coef) - i)
            i, run = i + step, run - step
            continue
        k = lo
        while k <= hi:
            if k == lo and tried != i:
                tried = i
                n, values = _uniform(bits, table, (len(coef) - i) * band)
                whole, part = divmod(n, band)
                if n:
                    coef[i : i + whole, lo : hi + 1] = values[: whole * band].reshape(whole, band) << low
                    if part:
                        coef[i + whole, lo : lo + part] = values[whole * band :] << low
                    i, k = i + whole, lo + part
                    if not part:
                        break
                    continue
            symbol = bits.symbol(table)
            r, s = symbol >> 4, symbol & 15
            if s:
                k += r
                coef[i, k] = _extend(bits.take(s), s) << low if s else 0
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r)
                break
        else:
            i += 1
            continue
        if not run and k == lo and tried != i:
            continue  # a stretch ended with its block


def _ac_refine(bits: Bits, coef: np.ndarray, table: Huffman, lo: int, hi: int, low: int) -> None:
    bit, i = 1 << low, 0

    def correct(part: np.ndarray) -> None:
        """One bit for each coefficient that isn't 0 yet, in order."""
        mask = part != 0
        n = int(mask.sum())
        if n:
            got = bits.array(n).astype(part.dtype) * bit
            old = part[mask]
            part[mask] = np.where(got != 0, old + np.sign(old) * got * ((np.abs(old) & bit) == 0), old)

    while i < len(coef):
        k = lo
        while k <= hi:
            symbol = bits.symbol(table)
            r, s = symbol >> 4, symbol & 15
            if not s and r < 15:
                run = (1 << r) + bits.take(r)
                correct(coef[i, k : hi + 1])
                last = min(len(coef), i + run)
                correct(coef[i + 1 : last, lo : hi + 1])
                i = last
                break
            value = (bit if bits.take(1) else -bit) if s else 0
            while k <= hi:
                c = int(coef[i, k])
                if c:
                    if bits.take(1) and not abs(c) & bit:
                        coef[i, k] = c + (bit if c > 0 else -bit)
                elif r:
                    r -= 1
                else:
                    break
                k += 1
            if s and k <= hi:
                coef[i, k] = value
            k += 1
        else:
            i += 1


def _segments(raw: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from there on, without stuffing, and where the next marker is."""
    out, begin = [], at
    while True:
        at = raw.find(b"\xff", at)
        if at < 0 or at + 1 >= len(raw):
            raise ValueError("a scan has no end")
        if raw[at + 1] == 0:
            at += 2
        elif 0xD0 <= raw[at + 1] <= 0xD7:
            out.append(raw[begin:at].replace(b"\xff\x00", b"\xff"))
            begin = at = at + 2
        elif raw[at + 1] == 0xFF:
            at += 1
        else:
            return [*out, raw[begin:at].replace(b"\xff\x00", b"\xff")], at


def coefficients(raw: bytes) -> Image:
    """Parses a progressive file and accumulates all its scans."""
    at, image, tables, restart = 2, None, {}, 0
    quant: dict[int, np.ndarray] = {}
    comment = b""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while raw[at + 1] != 0xD9:
        kind, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            comment = body
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = _huffman(body[1:n])
                body = body[n:]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xC2:
            height, width, n = struct.unpack(">HHB", body[1:6])
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            h, v = max(c.h for c in parts), max(c.v for c in parts)
            across, down = -(-width // (8 * h)), -(-height // (8 * v))
            for c in parts:
                c.wide, c.high = -(-(-(-width * c.h // h)) // 8), -(-(-(-height * c.v // v)) // 8)
                c.coef = np.zeros((down * c.v, across * c.h, 64), np.int32)
            image = Image(width, height, parts, quant, comment)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only progressive Huffman files are read")
        elif kind == 0xDA:
            n = body[0]
            chosen = [next(c for c in image.components if c.ident == body[1 + 2 * i]) for i in range(n)]
            which = [body[2 + 2 * i] for i in range(n)]
            lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
            segments, at = _segments(raw, at)
            _scan(segments, chosen, which, tables, lo, hi, approx >> 4, approx & 15, restart)
    image.comment = comment
    return image


def _scan(segments: list[bytes], chosen: list[Component], which: list[int], tables: dict[int, Huffman], lo: int, hi: int, high: int, low: int, restart: int) -> None:
    if len(chosen) == 1:
        c = chosen[0]
        padded_grid = c.coef.shape[:2] != (c.high, c.wide)
        own = c.coef[: c.high, : c.wide].reshape(-1, 64)  # a copy where the grid is padded
        step = restart or len(own)
        for i, raw in enumerate(segments):
            part, bits = own[i * step : (i + 1) * step], Bits(raw)
            if lo == 0:
                _dc_scan(bits, [(part, j, 0, tables.get(which[0] >> 4)) for j in range(len(part))], not high, low, [0])
            elif high:
                _ac_refine(bits, part, tables[16 | which[0] & 15], lo, hi, low)
            else:
                _ac_first(bits, part, tables[16 | which[0] & 15], lo, hi, low)
        if padded_grid:
            c.coef[: c.high, : c.wide] = own.reshape(c.high, c.wide, 64)
        return
    down, across = chosen[0].coef.shape[0] // chosen[0].v, chosen[0].coef.shape[1] // chosen[0].h
    step = restart or down * across
    flat = [c.coef.reshape(-1, 64) for c in chosen]
    for i, raw in enumerate(segments):
        units = np.arange(i * step, min((i + 1) * step, down * across))
        places = []
        for c, blocks in enumerate(chosen):
            y, x = units // across * blocks.v, units % across * blocks.h
            for dy in range(blocks.v):
                for dx in range(blocks.h):
                    places.append((c, ((y + dy) * blocks.coef.shape[1] + x + dx).tolist()))
        bits = Bits(raw)
        # a first scan of one-bit codes for category 0 leaves all at 0
        zero = all((t := tables.get(w >> 4)) and t.codes.get(0) == (0, 1) for w in which)
        if not high and zero and len(raw) * 8 >= len(units) * len(places) and not any(bits.array(len(units) * len(places))):
            continue
        bits.at = 0
        blocks = [(flat[c], at[u], c, tables.get(which[c] >> 4)) for u in range(len(units)) for c, at in places]
        _dc_scan(bits, blocks, not high, low, [0] * len(chosen))


@functools.cache
def _basis() -> np.ndarray:
    """The inverse transform's 8 x 8 matrix in units of 2**-12, whole numbers: products and sums of them are exact in doubles."""
    return np.array([[round(4096 * 0.5 * (math.sqrt(0.5) if u == 0 else 1.0) * math.cos((2 * x + 1) * u * math.pi / 16)) for x in range(8)] for u in range(8)], float)


def planes(image: Image) -> list[np.ndarray]:
    """Samples of each component, at its own resolution."""
    out = []
    for c in image.components:
        rows, cols, _ = c.coef.shape
        step = image.quant[c.quant]
        block = np.empty((rows * cols, 64))
        block[:, zigzag()] = c.coef.reshape(-1, 64) * step if (step != 1).any() else c.coef.reshape(-1, 64)
        half = block.reshape(-1, 8) @ _basis()  # by column frequency; rows stay frequencies
        half = half.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _basis()
        pixel = np.floor(half.reshape(rows, cols, 8, 8) * 2.0**-24 + 128.5)
        np.clip(pixel, 0, 255, out=pixel)
        out.append(pixel.astype(np.uint8).transpose(0, 3, 1, 2).reshape(8 * rows, 8 * cols))
    return out


def rgb(image: Image) -> np.ndarray:
    """Height x width x 3 bytes: chroma is brought to full resolution by repeating samples, grey gives three equal channels."""
    got, h, v = planes(image), max(c.h for c in image.components), max(c.v for c in image.components)
    full = [np.repeat(np.repeat(p, v // c.v, axis=0), h // c.h, axis=1) if (c.h, c.v) != (h, v) else p for p, c in zip(got, image.components, strict=True)]
    full = [p[: image.height, : image.width] for p in full]
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2)
    # whole-number arithmetic in units of 2**-16; what depends on chroma alone comes from tables
    shift = np.arange(256) - 128
    table = lambda f: ((shift * round(f * 65536) + 32768) >> 16).astype(np.int16)
    y, out = full[0].astype(np.int16), np.empty((image.height, image.width, 3), np.uint8)
    for i, part in enumerate((table(1.402)[full[2]], table(-0.344136)[full[1]] + table(-0.714136)[full[2]], table(1.772)[full[1]])):
        out[:, :, i] = np.clip(y + part, 0, 255)
    return out


def decode(raw: bytes) -> np.ndarray:
    return rgb(coefficients(raw))


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _header(width: int, height: int, size: int) -> bytes:
    first = bytes([1, *[0] * 15]) + bytes([7])  # one code of one bit: run 0, size 7
    runs = bytes([0, 0, 0, 15, *[0] * 12]) + bytes(n << 4 for n in range(15))  # end-of-band runs, 4 bits each
    zero = bytes([1, *[0] * 15]) + bytes([0])
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"\xff\xd8" + _marker(0xFE, struct.pack(">Q", size)) + _marker(0xDB, bytes([0]) + bytes([1] * 64)) + _marker(0xC2, frame) + _marker(0xC4, b"\x00" + zero + b"\x10" + first + b"\x11" + runs)


def _start(parts: list[tuple[int, int]], lo: int, hi: int, high: int, low: int) -> bytes:
    return _marker(0xDA, bytes([len(parts), *[x for p in parts for x in p], lo, hi, high << 4 | low]))


def encode_bytes(payload: bytes) -> bytes:
    """A 4:2:0 progressive file that holds the payload: a DC scan, first AC scans without the lowest bit, then the lowest bits."""
    units = max(1, -(-len(payload) // (PER_BLOCK * PER_UNIT)))
    down = max(1, math.isqrt(units) // 2)
    across = -(-units // down)
    n = down * across
    body = np.full(n * PER_UNIT * PER_BLOCK, 255, np.uint8)
    body[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = body.reshape(-1, PER_BLOCK)
    parts = [blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :]]
    bits = -(-PER_UNIT * n // 8)
    dc = bytearray(bits)
    dc[-1] = (1 << (8 * bits - PER_UNIT * n)) - 1
    out = [_header(16 * across, 16 * down, len(payload)), _start([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 0), bytes(dc)]
    for i, lo, hi in ((0, 1, 5), (1, 1, 63), (2, 1, 63), (0, 6, 63)):
        out += [_start([(i + 1, 0)], lo, hi, 0, 1), (parts[i][:, lo - 1 : hi] >> 1).tobytes()]
    for i, part in enumerate(parts):
        lowest, scan = np.where(part >= 128, part & 1, ~part & 1).astype(np.uint8), []
        for a in range(0, len(part), 32767):
            some = lowest[a : a + 32767]
            r = len(some).bit_length() - 1
            head = format(r, "04b") + (format(len(some) - (1 << r), f"0{r}b") if r else "")
            scan += [np.frombuffer(head.encode(), np.uint8) - 48, some.ravel()]
        flat = np.concatenate(scan)
        flat = np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])
        out += [_start([(i + 1, 1)], 1, 63, 1, 0), np.packbits(flat).tobytes().replace(b"\xff", b"\xff\x00")]
    return b"".join(out) + b"\xff\xd9"


def stored_bytes(image: Image) -> bytes:
    """What encode_bytes() has stored."""
    values = np.concatenate([c.coef.reshape(-1, 64)[:, 1:].ravel() for c in image.components])
    return np.where(values < 0, values + 255, values).astype(np.uint8)[: struct.unpack(">Q", image.comment)[0]].tobytes()


def padded(text: str) -> tuple[int, bytes]:
    """UTF-8 length of a text and its padded bytes."""
    raw = text.encode()
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT - len(raw))


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes and media (a progressive JPEG file) per row of docs: the whole text's bytes, padded, stored losslessly.

    A null text counts as empty and becomes one unit of padding. Equal texts give equal files. Other columns are ignored; no shuffle.
    """
    small_batches(docs.sparkSession, 200)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [padded(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([len(p) for _, p in got], pa.int64()), pa.array([encode_bytes(p) for _, p in got], pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_bytes long, payload_bytes long, media binary")


def feature(tensor: np.ndarray) -> str:
    """Size, channel sums and CRC-32 of an RGB tensor."""
    sums = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
    return f"{tensor.shape[1]}x{tensor.shape[0]} sum={','.join(map(str, sums))} crc={zlib.crc32(np.ascontiguousarray(tensor)):08x}"


def from_media(media: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), media_col: str = "media", tensors: bool = False) -> DataFrame:
    """Reads media files: the columns keep, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of each row.

    tensors: also height, width and tensor, the full-resolution RGB bytes row by row. A row whose media is null, or isn't
    a progressive JPEG, has nulls in the columns read from it; a file that encode_bytes() hasn't made has no payload.
    """
    src = media.select(*keep, F.col(media_col).alias("_media"))
    more = [("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())] + [("height", pa.int32()), ("width", pa.int32()), ("tensor", pa.binary())] * tensors
    names = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}

    def read(raw: bytes | None) -> list:
        if raw is None:
            return [None] * len(more)
        out = [None, None, len(raw), hashlib.sha256(raw).hexdigest()]
        try:
            image = coefficients(raw)
            tensor = rgb(image)
        except (ValueError, IndexError, KeyError, StopIteration, struct.error, AttributeError):
            return out + [None] * (len(more) - 4)
        if len(image.comment) == 8:
            payload = stored_bytes(image)
            out[:2] = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
        return [*out, feature(tensor)] + ([tensor.shape[0], tensor.shape[1], tensor.tobytes()] if tensors else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read(m) for m in b.column("_media").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array([g[i] for g in got], t) for i, (_, t) in enumerate(more)]], [*keep, *[n for n, _ in more]])

    schema = ", ".join([f"{n} {t}" for n, t in src.dtypes if n != "_media"] + [f"{n} {names[t]}" for n, t in more])
    return src.mapInArrow(run, schema)


def store_media(docs: DataFrame, **options) -> DataFrame:
    """to_media() as a table in the shared folder, read back from there."""
    return save(to_media(docs, **options), "media", compression="zstd")


def store_tensors(media: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), media_col: str = "media") -> DataFrame:
    """from_media() with its full-resolution RGB tensors as a table in the shared folder, read back from there.

    A tensor has 768 bytes for 378 bytes of payload, so the table is about twice the texts.
    """
    return save(from_media(media, keep=keep, media_col=media_col, tensors=True), "media-tensors", compression="zstd")
