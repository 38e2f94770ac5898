"""Media columns: a TIFF writer and reader in Python and numpy, run inside Spark tasks.

The reader walks the chain of image directories in either byte order, decodes strips or tiles (stored, PackBits, LZW or
deflate), undoes horizontal differencing and yields one page per directory. ``read_pages`` emits one row per page.

Defined results: null media gives one row with page null and error "null"; broken bytes give the pages before the
fault and then a row with the error: tags, dimensions, block counts and places are checked against the file before memory is
taken, and a block that holds less than its share is an error, never black pixels. 1- and 4-bit samples, separate planes, 64-bit
files and the floating-point predictor end as errors. A chain that returns to a directory ends with an error. Empty tables give
empty results. Rows are independent, so repeated rows repeat. Extra columns of the input pass through
``read_pages``; new columns get leading underscores where a name is taken.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import free_name, mapped

# Fixed values of the TIFF 6.0 format: tags, compressions, field sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 3: "H", 4: "I", 16: "Q"}

ROW_BYTES = 192
PAGE_ROWS = 512
STRIP_ROWS = 64


def pack_bits(row: bytes) -> bytes:
    out, a = bytearray(), np.frombuffer(row, np.uint8)
    if not len(a):
        return b""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    lengths = np.diff(np.r_[starts, len(a)])

    def literal(lo: int, hi: int) -> None:
        for i in range(lo, hi, 128):
            part = row[i:min(i + 128, hi)]
            out.append(len(part) - 1)
            out.extend(part)

    done = 0
    for s, n in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist()):
        literal(done, s)
        while n > 0:
            k = min(n, 128)
            out.extend((257 - k, row[s]) if k > 1 else (0, row[s]))
            s, n = s + k, n - k
        done = s
    literal(done, len(row))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1:i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1:i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a width grows one code early, and the table restarts when it is full."""
    table = {bytes((i,)): i for i in range(256)}
    words, width, size, word = [(256, 9)], 9, 258, b""
    for k in range(len(data)):
        longer = word + data[k:k + 1]
        if longer in table:
            word = longer
            continue
        words.append((table[word], width))
        table[longer] = size
        size += 1
        word = data[k:k + 1]
        if size == 4095:
            words.append((256, width))
            table = {bytes((i,)): i for i in range(256)}
            width, size = 9, 258
        elif size >= 1 << width:
            width += 1
    if word:
        words.append((table[word], width))
        if size + 1 >= 1 << width and width < 12:
            width += 1
    words.append((257, width))
    out, bits, n = bytearray(), 0, 0
    for code, w in words:
        bits, n = (bits << w) | code, n + w
        while n >= 8:
            n -= 8
            out.append(bits >> n)
            bits &= (1 << n) - 1
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, out, last, have = first[:], 9, [], b"", 0
    bits = n = 0
    for byte in data:
        bits, n = (bits << 8) | byte, n + 8
        if n < width:
            continue
        n -= width
        code = bits >> n
        bits &= (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = first[:], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError(f"LZW code {code} with {len(table)} entries")
        out.append(entry)
        have += len(entry)
        if have >= size:
            break
        if last:
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = entry
    return b"".join(out)[:size]


def _compress(raw: bytes, how: int) -> bytes:
    if how == DEFLATE:
        return zlib.compress(raw, 5)
    if how == LZW:
        return lzw_encode(raw)
    if how == PACKBITS:
        return pack_bits(raw)
    return raw


def _expand(raw: bytes, how: int, size: int) -> bytes:
    """At most size bytes of a block: a stream that would unpack to more is cut there, so it can't fill the worker."""
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(raw, size)
    if how == LZW:
        return lzw_decode(raw, size)
    if how == PACKBITS:
        return unpack_bits(raw, size)
    if how == NONE:
        return raw[:size]
    raise ValueError(f"compression {how} is not supported")


#: Most bytes that one byte of a block can stand for, by compression: what a page claims is checked against its file.
MOST_OUT = {NONE: 1, PACKBITS: 128, DEFLATE: 1100, OLD_DEFLATE: 1100, LZW: 4096}


def write_tiff(pages: list[np.ndarray], *, compression: int = DEFLATE, predictor: bool = True, tile: int | None = None, strip_rows: int = STRIP_ROWS, order: str = "<") -> bytes:
    """8-bit grey pages (rows x columns) as one file; tile: edge of square tiles, else strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        h, w = page.shape
        if tile:
            full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), np.uint8)
            full[:h, :w] = page
            blocks = [full[y:y + tile, x:x + tile] for y in range(0, full.shape[0], tile) for x in range(0, full.shape[1], tile)]
        else:
            blocks = [page[y:y + strip_rows] for y in range(0, h, strip_rows)]
        at, sizes = [], []
        for b in blocks:
            if predictor:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            data = _compress(b.tobytes(), compression)
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [2 if predictor else 1])]
        tags += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, at), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(body) > 4:
                where = len(out)
                out += body + b"\0" * (len(body) & 1)
                body = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        out[link:link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: np.ndarray


def _directory(media: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    """Tags of the image directory at a place, and the place of the next."""
    if at + 2 > len(media):
        raise ValueError("a directory lies beyond the file")
    count = struct.unpack_from(order + "H", media, at)[0]
    if at + 6 + 12 * count > len(media):
        raise ValueError("a directory is cut off")
    tags: dict[int, list[int]] = {}
    for place in range(at + 2, at + 2 + 12 * count, 12):
        tag, kind, n = struct.unpack_from(order + "HHI", media, place)
        if kind not in FIELD:
            continue
        size = n * struct.calcsize(order + FIELD[kind])
        begin = place + 8 if size <= 4 else struct.unpack_from(order + "I", media, place + 8)[0]
        if begin + size > len(media):
            raise ValueError(f"tag {tag} lies beyond the file")
        tags[tag] = list(struct.unpack_from(f"{order}{n}{FIELD[kind]}", media, begin))
    return tags, struct.unpack_from(order + "I", media, at + 2 + 12 * count)[0]


def _page(media: bytes, order: str, tags: dict[int, list[int]], number: int) -> Page:
    def one(tag: int, default: int) -> int:
        if tag in tags and not tags[tag]:
            raise ValueError(f"tag {tag} has no value")
        return tags.get(tag, [default])[0]

    w, h, samples, how, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    bits = one(BITS, 1)
    if bits not in (8, 16) or set(tags[BITS]) != {bits} or one(PLANAR, 1) != 1:
        raise ValueError("only 8 or 16 bits and chunky samples are supported")
    if how not in MOST_OUT or predictor not in (1, 2):
        raise ValueError(f"compression {how} with predictor {predictor} is not supported")
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    if min(w, h, samples, bw, bh) < 1:
        raise ValueError("a dimension is 0")
    across, down = -(-w // bw), -(-h // bh)
    places, sizes = (tags.get(x, []) for x in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
    if not len(places) == len(sizes) == across * down:
        raise ValueError(f"{len(places)} places and {len(sizes)} sizes for {across * down} blocks")
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    line = bw * samples * kind.itemsize
    if w * h * samples * kind.itemsize > MOST_OUT[how] * sum(sizes) or sum(sizes) > len(media) or line * bh > max(MOST_OUT[how] * max(sizes), 1):
        raise ValueError("the page is larger than its blocks can hold")
    pixels = np.zeros((h, w, samples), kind.newbyteorder("="))
    for k, (place, size) in enumerate(zip(places, sizes)):
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        if place + size > len(media):
            raise ValueError(f"block {k} lies beyond the file")
        raw = _expand(media[place:place + size], how, rows * line)
        if len(raw) != rows * line:
            raise ValueError(f"block {k} has {len(raw)} bytes of {rows * line}")
        block = np.frombuffer(raw, kind).reshape(rows, bw, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=pixels.dtype)
        pixels[y:y + rows, x:x + bw] = block[:h - y, :w - x]
    return Page(number, w, h, samples, bits, how, pixels)


def tiff_pages(media: bytes) -> Iterator[Page]:
    """Pages of a file, one image directory after the other. ValueError (or zlib.error) on what can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or len(media) < 8 or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", media, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        tags, next_at = _directory(media, order, at)
        yield _page(media, order, tags, len(seen))
        seen.add(at)
        at = next_at


def read_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: the columns of df without the media, then page, width, height, samples, bits, compression, pixels, error."""
    keep = [c for c in df.columns if c != media]
    new = {k: free_name(df, k) for k in ("page", "width", "height", "samples", "bits", "compression", "pixels", "error")}
    kinds = [T.BinaryType() if k == "pixels" else T.StringType() if k == "error" else T.IntegerType() for k in new]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(v, t) for v, t in zip(new.values(), kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in schema.fields[len(keep):]]
        for batch in batches:
            for i in range(len(batch)):
                blob, rows = batch.column(media)[i].as_py(), []
                try:
                    if blob is None:
                        raise ValueError("null")
                    for p in tiff_pages(blob):
                        rows.append((p.number, p.width, p.height, p.samples, p.bits, p.compression, p.pixels.tobytes(), None))
                except (ValueError, zlib.error) as e:
                    rows.append((None,) * 7 + (str(e),))
                head = [batch.column(c).take(pa.array([i] * len(rows))) for c in keep]
                yield pa.RecordBatch.from_arrays(head + [pa.array(v, t) for v, t in zip(zip(*rows), types)], names=schema.names)

    return df.mapInArrow(run, schema)


def text_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * ((-len(raw)) % ROW_BYTES or (0 if raw else ROW_BYTES))


def store_payload(payload: bytes) -> bytes:
    """Payload rows as grey pages. The checksum picks the coding, so that a corpus uses each: of 16, one LZW, one PackBits, two tiled, the rest in deflated strips."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    pages = [rows[i:i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    kind = zlib.crc32(payload) % 16
    if kind == 0:
        return write_tiff(pages, compression=LZW)
    if kind == 1:
        return write_tiff(pages, compression=PACKBITS, predictor=False)
    return write_tiff(pages, tile=64 if kind < 4 else None)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column that holds each whole text."""

    def run(texts: list) -> list:
        made = [text_payload(t) for t in texts]
        return [[n for n, _ in made], [store_payload(p) for _, p in made]]

    return mapped(docs, "text", ["doc_id"], [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], run)


def media_digests(stored: DataFrame) -> DataFrame:
    """Checks and features of each media value, folded over its pages as they are read back."""

    def run(blobs: list) -> list:
        rows = []
        for blob in blobs:
            sha, n, total, tail, pages, dark = hashlib.sha256(), 0, 0, b"", 0, 0
            for p in tiff_pages(blob):
                raw = p.pixels.tobytes()
                sha.update(raw)
                n, total, pages = n + len(raw), total + int(p.pixels.sum(dtype=np.int64)), pages + 1
                dark += int((p.pixels <= 32).sum())
                tail = (tail + raw)[-16:]
            rows.append((n, sha.hexdigest(), zlib.crc32(tail), len(blob), hashlib.sha256(blob).hexdigest(), f"pages={pages};mean={total // n};dark={1000 * dark // n}"))
        return list(zip(*rows)) if rows else [[]] * 6

    fields = [T.StructField(k, T.LongType() if k in ("payload_bytes", "tail_crc32", "media_bytes") else T.StringType()) for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")]
    return mapped(stored, "media", ["doc_id", "n_bytes"], fields, run)
