"""Media columns: baseline JPEG, written and read with numpy.

Writing keeps a payload without loss.  Its unit is the DC coefficient of a
grey 8x8 block, quantised by 8: one byte a block, the block's mean.  A payload
is a multiple of 576 bytes, 24 by 24 blocks; an image is 24 blocks wide, wider
by powers of two where it would be higher than the format allows, and a payload
beyond one image is a row of images.  A restart marker follows every block row.

Reading takes any baseline JPEG of 8 bits with one or three components in one
scan: it parses the markers, takes the scan apart at the restart markers and
Huffman-decodes all restart intervals of all images of like make in step, a
block at a time.  AC coefficients are decoded and dropped.  The DC coefficients
of the first component are the luminance thumbnail, a pixel a block.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbweave.llm.common import binary_array, ddl, id_and_text, in_batches
from orbweave.llm.text_kernels import groups, ragged

UNIT, SIDE = 576, 24
MAX_BLOCKS = 65535 // 8
#: Code lengths 1 to 16 and symbols of the two Huffman tables.
DC_COUNTS, DC_SYMBOLS = (0, 0, 5, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (5, 6, 7, 4, 3, 0, 2, 1, 8)
AC_COUNTS, AC_SYMBOLS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0,)


def huffman_codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Code and length by symbol: lengths ascend, codes count up."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return out


@cache
def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length by the next 16 bits; length 0: no code."""
    symbol, size = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s, (code, length) in huffman_codes(counts, symbols).items():
        at = code << 16 - length
        symbol[at : at + (1 << 16 - length)], size[at : at + (1 << 16 - length)] = s, length
    return symbol, size


@cache
def _block_bits() -> tuple[np.ndarray, np.ndarray]:
    """Bits of a whole block by its DC difference + 255; then by 1-bits to fill."""
    dc, end = huffman_codes(DC_COUNTS, DC_SYMBOLS), huffman_codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, sizes = np.zeros((511 + 8, 16), np.uint8), np.zeros(511 + 8, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = dc[category]
        value = code << category | (d if d >= 0 else d + (1 << category) - 1)
        value, length = value << end[1] | end[0], length + category + end[1]
        bits[d + 255, :length] = [value >> length - 1 - i & 1 for i in range(length)]
        sizes[d + 255] = length
    for k in range(8):
        bits[511 + k, :k], sizes[511 + k] = 1, k
    return bits, sizes


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@cache
def _header(width: int, height: int) -> bytes:
    """Everything before the scan; sizes in blocks."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([8]) + bytes([1]) * 63),
        _segment(0xC0, bytes([8]) + (8 * height).to_bytes(2, "big") + (8 * width).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
        _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
        _segment(0xDD, width.to_bytes(2, "big")),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def images_of(blocks: int) -> list[tuple[int, int]]:
    """Width and height in blocks of the images that hold so many blocks."""
    out, widest = [], SIDE << 8
    while blocks:
        width = SIDE
        while width < widest and blocks > width * MAX_BLOCKS:
            width *= 2
        rows = min(blocks // width, MAX_BLOCKS) or 1
        if blocks < width:  # what is left of a wide image
            width, rows = SIDE, blocks // SIDE
        out.append((width, rows))
        blocks -= width * rows
    return out


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def encode_images(payloads: list[bytes]) -> list[bytes]:
    """The stored form of payloads, each a positive multiple of 576 bytes."""
    shapes = [images_of(len(p)) for p in payloads]
    flat = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64)
    rows = np.concatenate([np.full(h, w) for s in shapes for w, h in s])
    ends = np.cumsum(rows)
    difference = np.empty_like(flat)
    difference[1:] = flat[1:] - flat[:-1]
    difference[ends - rows] = flat[ends - rows] - 128
    table, sizes = _block_bits()
    # a row is its blocks and the fill to a whole byte
    n_bits = np.add.reduceat(sizes[difference + 255], ends - rows)
    code = np.insert(difference + 255, ends, 511 + (-n_bits & 7))
    data = np.packbits(table[code][np.arange(16) < sizes[code][:, None]])
    n_bytes = (n_bits + 7) >> 3
    stuffed = data == 0xFF
    width = np.ones(len(data), np.int64) + stuffed
    begins = np.cumsum(n_bytes) - n_bytes
    n_out = np.add.reduceat(width, begins) + 2  # with the marker behind
    number = np.concatenate([np.arange(h) & 7 for s in shapes for _, h in s])
    out = np.zeros(n_out.sum(), np.uint8)
    row_ends = np.cumsum(n_out)
    out[ragged(row_ends - n_out, n_out - 2)[np.cumsum(width) - width]] = data
    out[row_ends - 2], out[row_ends - 1] = 0xFF, 0xD0 + number
    stored, row, raw = [], 0, out.tobytes()
    for shape in shapes:
        parts = []
        for w, h in shape:
            a, b = int(row_ends[row] - n_out[row]), int(row_ends[row + h - 1])
            parts += [_header(w, h), raw[a : b - 2], b"\xff\xd9"]
            row += h
        stored.append(b"".join(parts))
    return stored


class Image:
    """What the markers of one image say, and its scan's bytes."""

    def __init__(self) -> None:
        self.width = self.height = self.restart = 0
        self.components: list[tuple[int, int, int, int]] = []
        self.quantiser: dict[int, int] = {}
        self.tables: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self.scan: list[tuple[int, int, int]] = []
        self.data = b""

    def key(self) -> tuple:
        return tuple((h, v, self.tables[d], self.tables[0x10 | a]) for (_, h, v, _), (_, d, a) in zip(self.components, self.scan, strict=True))


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """One image and where it ends; ValueError for anything not baseline or cut short."""
    try:
        return _parse(data, at)
    except (IndexError, KeyError) as e:
        raise ValueError("a segment is too short") from e


def _parse(data: bytes, at: int) -> tuple[Image, int]:
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of an image")
    image, at = Image(), at + 2
    while True:
        if data[at : at + 1] != b"\xff" or at + 4 > len(data):
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                if wide > 1 or len(body) < 1 + 64 * (1 + wide):
                    raise ValueError("not a quantiser")
                image.quantiser[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                symbols = tuple(body[17 : 17 + sum(counts)])
                fits = len(counts) == 16 and len(symbols) == sum(counts) and sum(c << 15 - k for k, c in enumerate(counts)) <= 1 << 16
                if not fits or body[0] >> 4 == 0 and max(symbols, default=0) > 11:
                    raise ValueError("not a Huffman table")
                image.tables[body[0]] = counts, symbols
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8 or body[5] not in (1, 3):
                raise ValueError("not 8 bits with one or three components")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC0 < marker < 0xD0 and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            image.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            image.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            if len(image.scan) != len(image.components) or not image.width or not image.height:
                raise ValueError("not one scan of all components")
            break
    end = data.find(b"\xff\xd9", at)
    if end < 0:
        raise ValueError("no end of the image")
    image.data = data[at:end]
    image.key()  # a table that is named but missing raises
    if image.components[0][3] not in image.quantiser or not all(0 < h < 5 and 0 < v < 5 for _, h, v, _ in image.components):
        raise ValueError("no quantiser, or sampling factors out of range")
    if image.width * image.height // 64 > 4 * max(len(image.data), 1) * max(h * v for _, h, v, _ in image.components):
        raise ValueError("too little data for the size")
    return image, end + 2


def _intervals(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without stuffing and markers; where intervals begin; how many each scan has."""
    data = np.frombuffer(b"".join(s + b"\xff\xd0" for s in scans), np.uint8)
    full = np.flatnonzero(data[:-1] == 0xFF)
    after = data[full + 1]
    markers = full[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(len(data), bool)
    drop[full[after == 0] + 1] = True
    drop[markers] = drop[markers + 1] = True
    kept = np.r_[0, np.cumsum(~drop)]
    begins = np.r_[0, kept[markers]][:-1]
    ends = np.cumsum([len(s) + 2 for s in scans])
    return data[~drop], begins, np.diff(np.searchsorted(markers, np.r_[0, ends]))


def _decode_like(images: list[Image]) -> list[np.ndarray]:
    """DC values of the first component of images with equal tables."""
    first, scan = images[0].components, images[0].scan
    one = len(first) == 1
    shapes = [(1, 1)] if one else [(h, v) for _, h, v, _ in first]
    high, wide = max(v for _, v in shapes), max(h for h, _ in shapes)
    grid = [(-(-x.width // (8 * wide)), -(-x.height // (8 * high))) for x in images]
    data, begins, n_intervals = _intervals([x.data for x in images])
    units = [x.restart or w * h for x, (w, h) in zip(images, grid, strict=True)]
    need = np.array([-(-w * h // u) for (w, h), u in zip(grid, units, strict=True)])
    if (need != n_intervals).any():
        raise ValueError("restart markers do not fit the size")
    todo = np.concatenate([np.minimum(u, w * h - u * np.arange(k)) for u, (w, h), k in zip(units, grid, need, strict=True)])
    order = np.argsort(-todo, kind="stable")
    # the 64 bits at every byte: enough for a DC value and an AC code after it
    filled_up = np.r_[data, np.full(8, 0xFF, np.uint8)]
    word = np.lib.stride_tricks.as_strided(filled_up, (len(data) + 1, 8), (1, 1)).copy().view(">u8").astype(np.uint64).ravel()
    bit, limit = (begins * 8)[order], 8 * len(data)
    todo = todo[order]
    out_begin = np.r_[0, np.cumsum(todo)]
    per_unit = [h * v for h, v in shapes]
    out = np.zeros(out_begin[-1] * per_unit[0], np.int64)
    previous = [np.zeros(len(bit), np.int64) for _ in shapes]
    tables = [(_lookup(*images[0].tables[d]), _lookup(*images[0].tables[0x10 | a])) for _, d, a in scan]

    def peek(at: np.ndarray) -> np.ndarray:
        """The next 57 bits or more, from the top."""
        return word[np.minimum(at >> 3, len(word) - 1)] << (at & 7).astype(np.uint64)

    top = np.uint64(48)
    for unit in range(int(todo[0]) if len(todo) else 0):
        live = int(np.searchsorted(-todo, -unit, side="left"))
        bit = bit[:live]
        for c, ((dc_symbol, dc_size), (ac_symbol, ac_size)) in enumerate(tables):
            value = previous[c] = previous[c][:live]
            for k in range(per_unit[c]):
                bits = peek(bit)
                head = bits >> top
                size, n = dc_symbol[head].astype(np.int64), dc_size[head]
                extra = ((bits << n.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) >> 32 - size
                value += np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
                taken = size + n
                bit = bit + taken
                bad = not n.all()
                if c == 0:
                    out[(out_begin[:live] + unit) * per_unit[0] + k] = value
                head = (bits << taken.astype(np.uint64)) >> top
                symbol, n = ac_symbol[head], ac_size[head]
                open_, at_coefficient = np.arange(live), np.ones(live, np.int64)
                while not bad:
                    bad = not n.all()
                    bit[open_] += n + (symbol & 15)
                    if not symbol.any():
                        break
                    at_coefficient[open_] = np.where(symbol == 0, 64, at_coefficient[open_] + (symbol >> 4) + 1)
                    open_ = open_[at_coefficient[open_] < 64]
                    head = peek(bit[open_]) >> top
                    symbol, n = ac_symbol[head], ac_size[head]
                if bad or (bit > limit + 16).any():
                    raise ValueError("the scan is damaged")
    # back to the images' order, then from units to a picture
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    flat = out.reshape(-1, per_unit[0])[ragged(out_begin[:-1][at], todo[at])]
    pictures, begin = [], 0
    h, v = shapes[0]
    for w, rows in grid:
        part = flat[begin : begin + w * rows].reshape(rows, w, v, h)
        pictures.append(part.transpose(0, 2, 1, 3).reshape(rows * v, w * h))
        begin += w * rows
    return pictures


def decode_images(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stored value its images: width, height, luminance thumbnail.

    The thumbnail is one byte a block, the block's mean.  Damaged media raise
    ValueError.
    """
    images: list[Image] = []
    owner: list[int] = []
    for i, data in enumerate(media):
        at = 0
        while at < len(data) or not at:
            image, at = parse(data, at)
            images.append(image)
            owner.append(i)
    like: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        like.setdefault(image.key(), []).append(k)
    out: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in media]
    pictures: list[np.ndarray] = [np.empty(0)] * len(images)
    for members in like.values():
        for k, picture in zip(members, _decode_like([images[k] for k in members]), strict=True):
            step = images[k].quantiser[images[k].components[0][3]]
            mean = (picture * step + 4 >> 3) + 128
            pictures[k] = np.clip(mean[: -(-images[k].height // 8), : -(-images[k].width // 8)], 0, 255).astype(np.uint8)
    for k, i in enumerate(owner):
        out[i].append((images[k].width, images[k].height, pictures[k]))
    return out


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 by 9 cells is darker than the next."""
    rows = np.linspace(0, thumbnail.shape[0], 9).astype(int)
    columns = np.linspace(0, thumbnail.shape[1], 10).astype(int)
    if min(thumbnail.shape) < 9:
        thumbnail = thumbnail.repeat(9, 0).repeat(9, 1)
        return thumbnail_hash(thumbnail)
    box = np.add.reduceat(np.add.reduceat(thumbnail, rows[:-1], 0, dtype=np.int64), columns[:-1], 1)
    mean = box / np.outer(np.diff(rows), np.diff(columns))
    return np.packbits(mean[:, :-1] < mean[:, 1:]).tobytes().hex()


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("n_images", pa.int64()), ("thumbnail_hash", pa.string()), ("feature", pa.string()), ("payload", pa.binary()), ("media", pa.binary()), ("error", pa.string())])


def encode_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, media): every whole text, UTF-8, as JPEG.

    A null text counts as empty: one image of fill.  Equal texts have equal
    media.  Rows with equal or null ids are answered each; other columns are
    ignored.
    """

    def run(ids: pa.Array, texts: pa.Array) -> list:
        data = [(t or "").encode() for t in texts.to_pylist()]
        media: list[bytes] = []
        for a, b in groups(data):
            media += encode_images([padded(x) for x in data[a:b]])
        return [ids, np.fromiter(map(len, data), np.int64, len(data)), media]

    return id_and_text(docs, id_column, text_column).mapInArrow(in_batches(["doc_id", "text"], MEDIA, run), ddl(MEDIA))


def _each(values: list[bytes | None]) -> tuple[list[list | None], list[str | None]]:
    """Images, or what is wrong, of each value; a damaged one does not spoil the others."""
    if None not in values:
        try:
            return decode_images(values), [None] * len(values)
        except ValueError as e:
            if len(values) == 1:
                return [None], [str(e)]
    elif len(values) == 1:
        return [None], ["no medium"]
    each = [_each([v]) for v in values]
    return [x[0][0] for x in each], [x[1][0] for x in each]


def decode_media(media: DataFrame) -> DataFrame:
    """The rows with what the stored bytes hold: sizes in pixels, number of
    images, the first thumbnail's hash, as feature the sizes and hashes of all
    images, and all thumbnails' bytes as payload.

    A null or damaged medium has nulls there and says in ``error`` what is wrong;
    the others are read.  An empty table stays empty.
    """

    def run(ids: pa.Array, n_bytes: pa.Array, stored: pa.Array) -> list:
        values = stored.to_pylist()
        found: list[list | None] = []
        errors: list[str | None] = []
        sizes = [v or b"" for v in values]
        for a, b in groups(sizes):
            some, wrong = _each(values[a:b])
            found += some
            errors += wrong
        hashes = [x and [thumbnail_hash(t) for _, _, t in x] for x in found]
        feature = [x and ",".join(f"{w}x{h}:{s}" for (w, h, _), s in zip(x, y, strict=True)) for x, y in zip(found, hashes, strict=True)]
        columns = [[x and f(x) for x in found] for f in (lambda x: x[0][0], lambda x: x[0][1], len)]
        return [ids, n_bytes, *columns, [x and x[0] for x in hashes], feature, [x and b"".join(t.tobytes() for _, _, t in x) for x in found], stored, errors]

    return media.mapInArrow(in_batches(["doc_id", "n_bytes", "media"], FEATURES, run), ddl(FEATURES))
