"""Operator 6: baseline JPEG media: lossless storage of bytes, and a decoder of DC-only luminance thumbnails.

Encoding stores a payload without loss as the DC coefficients of a grey baseline JPEG: with a DC
quantiser of 8, the mean of each 8 x 8 block is one byte of the payload. Images are 24 blocks wide, with a
restart marker after each row of blocks; a payload longer than the format's greatest height takes
several images, one after the other. Huffman tables are in the file.

Decoding parses the markers, takes the scan apart at its restart markers, and Huffman-decodes all
restart segments at once in numpy: step k decodes the k-th symbol of every segment. Only the luminance
DC coefficients are reconstructed; AC coefficients and chroma are read past. Any baseline JPEG (8 bits,
Huffman, one interleaved scan) is accepted.

Null texts are empty. Equal texts (ties) give equal values; very long ones take several images, all of which count.
Repeated rows are all kept, an empty table gives an empty result, and columns other than those asked for are not
read. A medium that is no such image is a row with an error, not a failure.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clauseloom.llm.common import column, map_slices, texts_of

UNIT = 576
COLUMNS = 24
#: Rows of blocks in one image; JPEG heights have 16 bits.
MOST_ROWS = 8160

#: Rows of blocks that are encoded in one step.
ROWS_AT_ONCE = 4096

# How many codes of each length the standard's typical luminance DC table has, and its symbols.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)
#: The only AC symbol that the encoder writes is "end of block".
AC_LENGTHS, AC_SYMBOLS = (1, *[0] * 15), (0,)


def padded(data: bytes) -> bytes:
    """data, filled up with bytes 255 to a positive multiple of UNIT."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def codes(lengths, symbols) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, its length): canonical, as the standard assigns them."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


@functools.cache
def difference_bits() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255: the bits of its block (code, magnitude, end of block), and how many."""
    dc, (end, end_size) = codes(DC_LENGTHS, DC_SYMBOLS), codes(AC_LENGTHS, AC_SYMBOLS)[0]
    bits, sizes = np.zeros((511, 24), dtype=np.uint8), np.zeros(511, dtype=np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, size = dc[n]
        text = f"{code:0{size}b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + f"{end:0{end_size}b}"
        bits[d + 255, : len(text)] = [int(x) for x in text]
        sizes[d + 255] = len(text)
    return bits, sizes


def segment(marker: int, body: bytes) -> bytes:
    return bytes((255, marker)) + (len(body) + 2).to_bytes(2, "big") + body


@functools.cache
def header(rows: int) -> bytes:
    quantiser = segment(0xDB, bytes((0, 8, *[1] * 63)))
    frame = segment(0xC0, b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * COLUMNS).to_bytes(2, "big") + b"\x01\x01\x11\x00")
    tables = segment(0xC4, bytes((0x00, *DC_LENGTHS, *DC_SYMBOLS))) + segment(0xC4, bytes((0x10, *AC_LENGTHS, *AC_SYMBOLS)))
    return b"\xff\xd8" + quantiser + frame + tables + segment(0xDD, COLUMNS.to_bytes(2, "big")) + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def scans(payload: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each row of COLUMNS blocks, without restart markers, stuffed and filled up with ones."""
    rows = payload.reshape(-1, COLUMNS)
    return [line for start in range(0, len(rows), ROWS_AT_ONCE) for line in some_scans(rows[start : start + ROWS_AT_ONCE])]


def some_scans(rows: np.ndarray) -> list[bytes]:
    bits, sizes = difference_bits()
    values = rows.astype(np.int64) - 128
    steps = np.diff(values, axis=1, prepend=0) + 255
    size = sizes[steps]
    total = size.sum(axis=1)
    width = int(-(-total.max() // 8) * 8)
    # The bits of every block go to their place in the row's line of bits.
    live = np.arange(bits.shape[1])[None, None, :] < size[:, :, None]
    line = np.repeat(np.arange(len(values)), total)
    first = np.concatenate(([0], np.cumsum(total)[:-1]))
    place = np.arange(int(total.sum())) - np.repeat(first, total)
    rows = np.ones((len(values), width), dtype=np.uint8)
    rows[line, place] = bits[steps][live]
    packed = np.packbits(rows, axis=1)
    lengths = -(-total // 8)
    out = []
    for row, n in zip(packed, lengths.tolist(), strict=True):
        raw = row[:n].tobytes()
        out.append(raw.replace(b"\xff", b"\xff\x00") if b"\xff" in raw else raw)
    return out


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """One medium (one or more JPEG images) for each payload, whose length is a multiple of UNIT."""
    coded = scans(np.frombuffer(b"".join(payloads), dtype=np.uint8))
    out, at = [], 0
    for p in payloads:
        rows, parts = len(p) // COLUMNS, []
        for start in range(0, rows, MOST_ROWS):
            n = min(MOST_ROWS, rows - start)
            mine = coded[at + start : at + start + n]
            body = [x for k, s in enumerate(mine) for x in (s, bytes((255, 0xD0 + k % 8)))]
            parts.append(header(n) + b"".join(body[:-1]) + b"\xff\xd9")
        out.append(b"".join(parts))
        at += rows
    return out


@dataclass
class Image:
    """A parsed image: what the headers say, and the bytes of each restart segment."""

    width: int
    height: int
    #: For each component: horizontal and vertical sampling, DC quantiser, DC table, AC table.
    components: list[list[int]]
    tables: dict[int, bytes]
    restart: int
    segments: list[bytes]


@functools.lru_cache(4096)
def parse_header(head: bytes) -> tuple:
    """What the segments before the entropy-coded data say."""
    at, dc_quant, tables, restart, frame, order = 2, {}, {}, 0, None, None
    if head[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at < len(head):
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                dc_quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            frame = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])])
            if body[0] != 8:
                raise ValueError("only 8-bit samples")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            order = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
    width, height, parts = frame
    return width, height, [[h, v, dc_quant[q], *order[c]] for c, h, v, q in parts], tables, restart


def parse(data: bytes, start: int = 0) -> tuple[Image, int]:
    """The image at start, and where it ends."""
    at = start + 2
    while data[at + 1] != 0xDA:
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    head = parse_header(data[start:at])
    end = data.find(b"\xff\xd9", at)
    if end < 0:
        raise ValueError("no end of image")
    body = data[at:end]
    raw = np.frombuffer(body, dtype=np.uint8)
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)).tolist()
    cuts = [*zip([0, *(m + 2 for m in marks)], [*marks, len(body)], strict=True)]
    return Image(*head, [body[a:b].replace(b"\xff\x00", b"\xff") if b"\xff" in body[a:b] else body[a:b] for a, b in cuts]), end + 2


def images(data: bytes) -> list[Image]:
    out, at = [], 0
    while at < len(data):
        image, at = parse(data, at)
        out.append(image)
    return out


@functools.lru_cache(64)
def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits to come: the symbol that they begin with, and its code's length (0: none)."""
    symbol, size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for s, (code, n) in codes(table[:16], table[16:]).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        size[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, size


def decode_scans(batch: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance thumbnail of each image (they share components, tables and restart interval)."""
    first = batch[0]
    tables = {k: lookup(t) for k, t in first.tables.items()}
    h_most, v_most = max(c[0] for c in first.components), max(c[1] for c in first.components)
    single = len(first.components) == 1
    if single:
        h_most = v_most = 1
    wide = [-(-i.width // (8 * h_most)) for i in batch]
    units = [w * -(-i.height // (8 * v_most)) for w, i in zip(wide, batch, strict=True)]
    parts = [s for i in batch for s in i.segments]
    left = np.array([min(i.restart or u, u - k * (i.restart or u)) for i, u in zip(batch, units, strict=True) for k in range(len(i.segments))])
    lengths = np.array([len(s) for s in parts])
    stream = np.frombuffer(b"".join([s + b"\xff\xff\xff\xff" for s in parts]) + b"\xff" * 8, dtype=np.uint8)
    wider = (stream[:-3].astype(np.uint32) << 24) | (stream[1:-2].astype(np.uint32) << 16) | (stream[2:-1].astype(np.uint32) << 8) | stream[3:]
    at = 8 * np.concatenate(([0], np.cumsum(lengths + 4)[:-1]))
    limit = at + 8 * lengths + 24

    def peek(where: np.ndarray) -> np.ndarray:
        """The 16 bits from each place."""
        return ((wider[where >> 3] >> (16 - (where & 7)).astype(np.uint32)) & 0xFFFF).astype(np.int64)

    luma = first.components[0]
    blocks = 1 if single else luma[0] * luma[1]
    found = np.zeros((len(parts), int(left.max()), blocks), dtype=np.int64)
    before = np.zeros((len(first.components), len(parts)), dtype=np.int64)
    for unit in range(int(left.max())):
        live = np.flatnonzero(left > unit)
        for c, (h, v, quant, dc, ac) in enumerate(first.components):
            for b in range(1 if single else h * v):
                symbol, size = tables[dc]
                bits = peek(at[live])
                n, used = symbol[bits], size[bits]
                if not used.all():
                    raise ValueError("no such code")
                at[live] += used
                raw = peek(at[live]) >> (16 - n)
                at[live] += n
                before[c, live] += np.where(raw < (1 << n) >> 1, raw - (1 << n) + 1, raw)
                if c == 0:
                    found[live, unit, b] = before[0, live] * quant
                symbol, size = tables[16 | ac]
                rest, k = live, np.ones(len(live), dtype=np.int64)
                while len(rest):
                    bits = peek(at[rest])
                    s, used = symbol[bits], size[bits]
                    if not used.all() or (at[rest] > limit[rest]).any():
                        raise ValueError("no such code")
                    at[rest] += used + (s & 15)
                    k += np.where(s == 0, 64, (s >> 4) + 1)
                    on = k < 64
                    rest, k = rest[on], k[on]
    sample = np.clip(np.floor_divide(found + 4, 8) + 128, 0, 255).astype(np.uint8)
    out, row = [], 0
    for image, w, u in zip(batch, wide, units, strict=True):
        per = image.restart or u
        mine = sample[row : row + len(image.segments)]
        row += len(image.segments)
        line = np.concatenate([m[: min(per, u - k * per)] for k, m in enumerate(mine)]) if per < mine.shape[1] or u % per else mine[:, :per].reshape(u, blocks)
        h, v = (1, 1) if single else luma[:2]
        whole = line.reshape(u // w, w, v, h).transpose(0, 2, 1, 3).reshape(u // w * v, w * h)
        y, x = -(-image.height * v // (8 * v_most)), -(-image.width * h // (8 * h_most))
        out.append(whole[:y, :x])
    return out


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each medium its images' width, height and thumbnail. Images with equal headers are decoded together."""
    parsed = [images(m) for m in media]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, own in enumerate(parsed):
        for k, image in enumerate(own):
            groups.setdefault((str(image.components), tuple(sorted(image.tables.items())), image.restart), []).append((i, k))
    out: list[list] = [[None] * len(own) for own in parsed]
    for where in groups.values():
        for (i, k), t in zip(where, decode_scans([parsed[i][k] for i, k in where]), strict=True):
            out[i][k] = (parsed[i][k].width, parsed[i][k].height, t)
    return out


def read_each(media: list[bytes]) -> tuple[list[list], list[str | None]]:
    """thumbnails, and what is wrong with each medium (null: nothing). One that can't be read has no images."""
    try:
        return thumbnails(media), [None] * len(media)
    except Exception:  # noqa: BLE001  so it is one of them: each on its own
        found: list[list] = []
        errors: list[str | None] = []
        for m in media:
            try:
                found += thumbnails([m])
                errors.append(None)
            except Exception as e:  # noqa: BLE001  a broken medium is a value
                found.append([])
                errors.append(f"{type(e).__name__}: {e}")
        return found, errors


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are lighter than its mean."""
    y, x = (np.linspace(0, n, 9).astype(int) for n in thumb.shape)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), dtype=np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    cell = total[y[1:]][:, x[1:]] - total[y[:-1]][:, x[1:]] - total[y[1:]][:, x[:-1]] + total[y[:-1]][:, x[:-1]]
    area = np.maximum(np.diff(y)[:, None] * np.diff(x)[None, :], 1)
    return int.from_bytes(np.packbits(cell / area > total[-1, -1] / max(1, thumb.size)).tobytes(), "big")


def store_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's id, n_bytes and media (binary): its text's UTF-8 bytes, padded, as JPEG images."""
    kind = dict(df.dtypes)[id_column]

    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [t.encode() for t in texts_of(batch, text_column)]
            return pa.RecordBatch.from_arrays([column(batch, id_column), pa.array([len(r) for r in raw], pa.int64()), pa.array(encode_many([padded(r) for r in raw]), pa.binary())], names=[id_column, "n_bytes", "media"])

        return work

    return map_slices(df.select(id_column, text_column), kernel, f"`{id_column}` {kind}, n_bytes bigint, media binary", text_column)


def read_media(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media_column: str = "media") -> DataFrame:
    """The kept columns, media, and of all images together: n_images, width, height (of the first), thumbnail (bytes), thumb_hash (hex), sizes (each image's width x height) and error.

    A null or empty medium has no image, and null width, height and hash; so has one that can't be read, with the error.
    """
    kinds = dict(df.dtypes)

    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, errors = read_each([m or b"" for m in column(batch, media_column).to_pylist()])
            columns = [
                pa.array([len(f) for f in found], pa.int32()),
                pa.array([f[0][0] if f else None for f in found], pa.int32()),
                pa.array([f[0][1] if f else None for f in found], pa.int32()),
                pa.array([b"".join(t.tobytes() for *_, t in f) for f in found], pa.binary()),
                pa.array(["".join(f"{average_hash(t):016x}" for *_, t in f) if f else None for f in found], pa.string()),
                pa.array(["+".join(f"{w}x{h}" for w, h, _ in f) if f else None for f in found], pa.string()),
                pa.array(errors, pa.string()),
            ]
            return pa.RecordBatch.from_arrays([*(column(batch, k) for k in (*keep, media_column)), *columns], names=[*keep, media_column, "n_images", "width", "height", "thumbnail", "thumb_hash", "sizes", "error"])

        return work

    head = ", ".join(f"`{k}` {kinds[k]}" for k in (*keep, media_column))
    return map_slices(df.select(*keep, media_column), kernel, f"{head}, n_images int, width int, height int, thumbnail binary, thumb_hash string, sizes string, error string", media_column)
