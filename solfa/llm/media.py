"""Media columns: payloads kept losslessly in progressive JPEG files, read back as RGB tensors.

Store: a payload byte is one quantised coefficient, the unit that a JPEG file keeps exactly. Every 64 bytes are a
block in zigzag order, blocks fill the planes of a 4:2:0 image one after another (spaces fill what is left over).
DC holds byte - 128; AC holds magnitude 128 + (byte & 127), negative from byte 128 on, so that no coefficient is 0.
Scans: DC without its low bit, AC without theirs in the spectral bands 1-5 and 6-63, then the low bits of DC and of
AC by successive approximation. Tables are chosen so that a code word and its extra bits have 8 bits together.

Read: scans are accumulated into coefficient arrays (any Huffman tables, one or more components a DC scan, end-of-band
runs and zero runs; scans of constant word width without runs are read as a whole, others word by word), which are
inverse-transformed in strips of whole MCU rows, chroma is upsampled, and RGB tensors of full resolution come out.

Defined results: a null or empty text is a payload of 192 spaces; equal texts have equal files and features;
other columns are ignored. Restart intervals aren't written and are refused on reading.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, key_schema, parts, text_bytes

UNIT, BLANK = 192, 32
#: MCU rows are transformed in strips of about so many MCUs, which bounds the floats held at once.
STRIP = 2048
MAX_RUN = 0x7FFF
#: (factor across, factor down) of Y, Cb, Cr.
FACTORS = ((2, 2), (1, 1), (1, 1))
#: Huffman tables by (class, id): code lengths of the symbols, shortest first. Class 0 is DC, 1 is AC.
DC_TABLE = [(8 - size, size) for size in range(7, -1, -1)]
AC_TABLE = [(1, 7)]
REFINE_TABLE = [(4, run << 4) for run in range(15)]


@cache
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@cache
def cosines() -> np.ndarray:
    u, x = np.mgrid[:8, :8]
    return (np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, table: list[tuple[int, int]]) -> bytes:
    counts = [sum(length == n for length, _ in table) for n in range(1, 17)]
    return bytes([kind << 4 | number, *counts, *(symbol for _, symbol in table)])


@cache
def _head() -> bytes:
    tables = _table(0, 0, DC_TABLE) + _table(1, 0, AC_TABLE) + _table(1, 1, REFINE_TABLE)
    return b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, tables)


def _scan(component: int, tables: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, tables, first, last, high << 4 | low])) + data.replace(b"\xff", b"\xff\0")


def _padded(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last filled up with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _refined(low: np.ndarray) -> bytes:
    """The scan of the AC coefficients' low bits: no coefficient is new, so blocks are end-of-band runs."""
    out = []
    for at in range(0, len(low), MAX_RUN):
        part = low[at : at + MAX_RUN]
        n = len(part)
        size = n.bit_length() - 1
        word = size << size | (n - (1 << size))  # the table's code of each run size is the size itself, in 4 bits
        out += [np.array([int(x) for x in format(word, f"0{4 + size}b")], np.uint8), part.reshape(-1)]
    return _padded(np.concatenate(out))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG file of payload, whose length is a positive multiple of 192."""
    mcus = -(-len(payload) // 384)
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    if across > 4095:
        raise ValueError("a payload over 6 GB doesn't fit one JPEG image")
    units = np.frombuffer(payload.ljust(384 * across * down, bytes([BLANK])), np.uint8).reshape(-1, 64)
    dc = units[:, 0].astype(np.int32) - 128
    half = (128 + (units[:, 1:] & 127)) >> 1
    words = np.where(units[:, 1:] < 128, half, 127 - half).astype(np.uint8)
    low = units[:, 1:] & 1
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes(x for i, (h, v) in enumerate(FACTORS) for x in (i + 1, h << 4 | v, 0))
    out, later, at = [_head(), _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xC2, frame)], [], 0
    for i, (h, v) in enumerate(FACTORS):
        to = at + h * v * across * down
        own = dc[at:to]
        jump = np.diff(own >> 1, prepend=0)
        size = _SIZES[np.abs(jump)]
        extra = np.where(jump < 0, jump + (1 << size) - 1, jump)
        prefix = (0xFF << (size + 1)) & 0xFF  # ones, then the zero that ends the code, over size extra bits
        out.append(_scan(i + 1, 0x00, 0, 0, 0, 1, (prefix | extra).astype(np.uint8).tobytes()))
        out.append(_scan(i + 1, 0x00, 1, 5, 0, 1, words[at:to, :5].tobytes()))
        out.append(_scan(i + 1, 0x00, 6, 63, 0, 1, words[at:to, 5:].tobytes()))
        later.append(_scan(i + 1, 0x00, 0, 0, 1, 0, _padded((own & 1).astype(np.uint8))))
        later.append(_scan(i + 1, 0x01, 1, 63, 1, 0, _refined(low[at:to])))
        at = to
    return b"".join([*out, *later, b"\xff\xd9"])


_SIZES = np.array([int(n).bit_length() for n in range(2048)])


class _Codes:
    """A Huffman table: symbols by code, and the width of word and extra bits if all have the same and no runs."""

    def __init__(self, lengths: bytes, symbols: bytes) -> None:
        self.codes, code, k = {}, 0, 0
        for n in range(1, 17):
            for _ in range(lengths[n - 1]):
                self.codes[n, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        widths = {n + s for (n, _), s in self.codes.items()}
        plain = all(s <= 15 for s in self.codes.values())
        self.width = widths.pop() if plain and len(widths) == 1 else 0
        if self.width:  # the value of every word
            self.values = np.zeros(1 << self.width, np.int32)
            for (n, code), size in self.codes.items():
                extra = np.arange(1 << size)
                self.values[(code << size) + extra] = _extended(extra, size)


def _extended(extra, size):
    return np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra) if size else extra * 0


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        out = 0
        for bit in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | bit
        self.at += n
        return out

    def many(self, n: int) -> np.ndarray:
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, codes: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")


def _words(data: bytes, width: int, n: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(data, np.uint8, n)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return bits @ (1 << np.arange(width - 1, -1, -1))


def _first_ac(coefs: np.ndarray, codes: _Codes, data: bytes, first: int, last: int, low: int) -> None:
    n = last - first + 1
    if codes.width and 0 not in codes.codes.values():
        coefs[:, first : last + 1] = codes.values[_words(data, codes.width, len(coefs) * n)].reshape(-1, n) * (1 << low)
        return
    bits, run = _Bits(data), 0
    for block in coefs:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            skip, size = divmod(bits.symbol(codes.codes), 16)
            if size:
                k += skip
                block[k] = int(_extended(np.int64(bits.take(size)), size)) * (1 << low)
                k += 1
            elif skip == 15:
                k += 16
            else:
                run = (1 << skip) + bits.take(skip) - 1
                break


def _corrected(part: np.ndarray, mask: np.ndarray, bits: np.ndarray, low: int) -> None:
    old = part[mask]
    part[mask] = old + np.sign(old) * (bits.astype(np.int32) << low)


def _refine_ac(coefs: np.ndarray, codes: _Codes, data: bytes, first: int, last: int, low: int) -> None:
    bits, b = _Bits(data), 0
    while b < len(coefs):
        block, k = coefs[b], first
        while k <= last:
            skip, size = divmod(bits.symbol(codes.codes), 16)
            if not size and skip < 15:
                run = (1 << skip) + bits.take(skip)
                if k > first:
                    rest = block[k : last + 1]
                    _corrected(rest, rest != 0, bits.many(int((rest != 0).sum())), low)
                    b, run = b + 1, run - 1
                rest = coefs[b : b + run, first : last + 1]
                _corrected(rest, rest != 0, bits.many(int((rest != 0).sum())), low)
                b += run - 1
                break
            value = (1 if bits.take(1) else -1) * (1 << low) if size else 0
            while k <= last:  # pass so many zeros, correcting what isn't zero on the way
                if block[k]:
                    if bits.take(1):
                        block[k] += np.sign(block[k]) * (1 << low)
                elif skip == 0:
                    if value:
                        block[k] = value
                    k += 1
                    break
                else:
                    skip -= 1
                k += 1
        b += 1


def coefficients(media: bytes) -> tuple[list[np.ndarray], list[tuple[int, int]], int, int, int | None]:
    """Of a progressive JPEG: each component's blocks in zigzag order, their factors, width, height, payload length."""
    at, tables, planes, factors, length, quant = 2, {}, [], [], None, {}
    width = height = 0
    while media[at + 1] != 0xD9:
        marker, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _table_of(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("quantisation tables have 8 bits here")
                quant[body[0] & 15], body = np.frombuffer(body, np.uint8, 64, 1).astype(np.int32), body[65:]
        elif marker == 0xFE and size == 10:
            length = struct.unpack(">Q", body)[0]
        elif marker == 0xDD and struct.unpack(">H", body)[0]:
            raise ValueError("restart intervals are not supported")
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            ids = {body[6 + 3 * i]: i for i in range(n)}
            factors = [divmod(body[7 + 3 * i], 16) for i in range(n)]
            use = [body[8 + 3 * i] for i in range(n)]
            wide, tall = max(h for h, _ in factors), max(v for _, v in factors)
            if width % (8 * wide) or height % (8 * tall):
                raise ValueError("the image must have whole MCUs")
            across, down = width // (8 * wide), height // (8 * tall)
            planes = [np.zeros((h * v * across * down, 64), np.int32) for h, v in factors]
        elif marker == 0xDA:
            end = at
            while True:  # the next marker that isn't a stuffed byte
                end = media.index(b"\xff", end)
                if media[end + 1]:
                    break
                end += 2
            data, at = media[at:end].replace(b"\xff\0", b"\xff"), end
            n = body[0]
            own = [(ids[body[1 + 2 * i]], *divmod(body[2 + 2 * i], 16)) for i in range(n)]
            first, last, (high, low) = body[1 + 2 * n], body[2 + 2 * n], divmod(body[3 + 2 * n], 16)
            if first == 0:
                _dc(planes, factors, own, tables, data, high, low, across)
            elif high:
                _refine_ac(planes[own[0][0]], tables[0x10 | own[0][2]], data, first, last, low)
            else:
                _first_ac(planes[own[0][0]], tables[0x10 | own[0][2]], data, first, last, low)
    return [p * quant[q] if (quant[q] != 1).any() else p for p, q in zip(planes, use)], factors, width, height, length


@cache
def _table_of(lengths: bytes, symbols: bytes) -> _Codes:
    return _Codes(lengths, symbols)


def _dc(planes: list, factors: list, own: list, tables: dict, data: bytes, high: int, low: int, across: int) -> None:
    """A DC scan: of one component in raster order, or of several by MCU."""
    if len(own) == 1:
        order = [(c, np.arange(len(planes[c])), t) for c, t, _ in own]
    else:
        order = []
        for c, t, _ in own:
            h, v = factors[c]
            grid = np.arange(len(planes[c])).reshape(-1, v, across, h).transpose(0, 2, 1, 3)
            order.append((c, grid.reshape(-1, h * v), t))
    if high or (len(own) == 1 and tables[order[0][2]].width):
        if high:
            count = sum(x[1].size for x in order)
            got = np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(np.int32)
        else:
            table = tables[order[0][2]]
            got = np.cumsum(table.values[_words(data, table.width, order[0][1].size)])
        got = got.reshape(len(order[0][1]), -1)
        at = 0
        for c, places, _ in order:
            n = places.size // len(places)
            planes[c][places.reshape(-1), 0] += got[:, at : at + n].reshape(-1).astype(np.int32) << low
            at += n
        return
    bits, last = _Bits(data), dict.fromkeys((c for c, _, _ in order), 0)
    for row in range(len(order[0][1])):
        for c, places, t in order:
            for place in np.atleast_1d(places[row]):
                size = bits.symbol(tables[t].codes)
                last[c] += int(_extended(np.int64(bits.take(size)), size))
                planes[c][place, 0] = last[c] << low


def payload_of(planes: list[np.ndarray], length: int) -> bytes:
    """The payload bytes that encode() put into coefficients."""
    blocks = np.concatenate(planes)
    out = np.empty(blocks.shape, np.uint8)
    out[:, 0] = blocks[:, 0] + 128
    ac = blocks[:, 1:]
    out[:, 1:] = (np.abs(ac) & 127) | ((ac < 0) << 7)
    return out.tobytes()[:length]


def rgb_strips(planes: list[np.ndarray], factors: list[tuple[int, int]], width: int, height: int) -> Iterator[np.ndarray]:
    """The RGB tensor (rows, columns, 3) in strips of whole MCU rows."""
    wide, tall = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = width // (8 * wide), height // (8 * tall)
    rows, turn, back = max(1, STRIP // across), cosines(), np.argsort(zigzag())
    for at in range(0, down, rows):
        n = min(rows, down - at)
        full = []
        for plane, (h, v) in zip(planes, factors):
            row = h * v * across
            part = plane[at * row : (at + n) * row, back].astype(np.float32).reshape(-1, 8, 8)
            pixels = turn.T @ part @ turn
            image = pixels.reshape(n * v, across * h, 8, 8).transpose(0, 2, 1, 3).reshape(n * v * 8, across * h * 8)
            if (h, v) != (wide, tall):
                image = image.repeat(tall // v, 0).repeat(wide // h, 1)
            full.append(image)
        y, cb, cr = full
        y = y + 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
        yield np.rint(np.clip(rgb, 0, 255)).astype(np.uint8)


def tensor(media: bytes) -> np.ndarray:
    """The whole RGB tensor of a file."""
    planes, factors, width, height, _ = coefficients(media)
    return np.concatenate(list(rgb_strips(planes, factors, width, height)))


def feature(planes: list[np.ndarray], factors: list, width: int, height: int) -> str:
    """Shape, mean of each channel and checksum of the RGB tensor."""
    total, check = np.zeros(3, np.int64), 0
    for strip in rgb_strips(planes, factors, width, height):
        total += strip.sum((0, 1), dtype=np.int64)
        check = zlib.crc32(strip, check)
    means = ",".join(f"{x / (width * height):.3f}" for x in total)
    return f"{height}x{width}x3;{means};{check:08x}"


def padded_payload(raw: bytes) -> bytes:
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), bytes([BLANK]))


def store(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and media, the file of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, len(keys)):
                media = [encode(padded_payload(x)) for x in text_bytes(part.column(len(keys)))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(media, pa.binary())], [*keys, "media"])

    return df.select(*keys, text).mapInArrow(run, key_schema(df, keys) + ", media binary")


def read(df: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, and of each file in the column media: payload, tensor (bytes, row-major), height, width and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, len(keys), 1 << 20):
                rows = []
                for media in part.column(len(keys)).to_pylist():
                    planes, factors, width, height, length = coefficients(media)
                    pixels = b"".join(x.tobytes() for x in rgb_strips(planes, factors, width, height))
                    rows.append((payload_of(planes, length), pixels, height, width, feature(planes, factors, width, height)))
                kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], [*keys, "payload", "tensor", "height", "width", "feature"])

    return df.select(*keys, "media").mapInArrow(run, key_schema(df, keys) + ", payload binary, tensor binary, height int, width int, feature string")


def digests(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, and digests of each text's payload, file and tensor: the files are a column of their own, read back from it."""
    named = df.select(*keys, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text)
    files = store(named, text, (*keys, "n_bytes"))
    files = files.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    back = read(files, (*keys, "n_bytes", "media_bytes", "media_sha256"))
    return back.select(
        *keys, "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's payload, file and RGB tensor."""
    return digests(documents(spark, sf_dir))
