"""TIFF columns: write payloads as TIFF, walk directories, decode pages.

The reader follows the chain of image directories of a file, in either byte
order, and emits one row per page: strips or tiles, uncompressed or packed by
PackBits, LZW or deflate, of 1, 8, 16 or 32 bits a sample, with horizontal or floating
point differencing undone. The writer makes such files from byte payloads, several
pages for long ones; a hash of the payload deals out codec, strips or tiles, predictor
and byte order, so that every codec meets texts of every length.

Defined results of :func:`stored`: a null text is stored as an empty one; payloads
are padded with zero bytes to a positive multiple of 64; equal texts give equal
files; repeated rows give repeated rows; further columns are ignored; an empty
table gives an empty one. :func:`pages` gives no row for a null file; a file that
can't be read (not TIFF, a directory loop, data cut short, an unknown compression)
gives one row with ``error`` and without pages, and the job goes on.
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
from pyspark.sql import functions as F

from .common import text_chunks

# Fixed values of the format: tags, compression and predictor codes, field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, SAMPLE_FORMAT = 284, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE_OLD, DEFLATE, PACKBITS = 1, 5, 32946, 8, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", DEFLATE_OLD: "deflate", PACKBITS: "packbits"}
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}

#: The writer's parameters: samples a row, rows of a strip, bytes of a page, tile edge.
ROW = 64
STRIP_ROWS = 256
PAGE_BYTES = 1 << 18
TILE = 64


# ---- codecs -----------------------------------------------------------------


def packbits(data: bytes) -> bytes:
    """Runs of three and more as pairs, all else as literals of up to 128."""
    out = bytearray()

    def literals(part: bytes) -> None:
        for s in range(0, len(part), 128):
            piece = part[s : s + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    samples = np.frombuffer(data, dtype=np.uint8)
    heads = np.flatnonzero(np.concatenate([[True], samples[1:] != samples[:-1]])) if len(data) else np.zeros(0, int)
    sizes = np.diff(np.append(heads, len(data)))
    runs = sizes >= 3
    done = 0
    for head, size in zip(heads[runs].tolist(), sizes[runs].tolist()):
        literals(data[done:head])
        done = head + size
        while size >= 2:  # a single sample left over joins the next literals
            n = min(size, 128)
            out += bytes((257 - n, data[head]))
            size -= n
        done -= size
    literals(data[done:])
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


_SINGLE = [bytes([i]) for i in range(256)]
CLEAR, END, FIRST, FULL = 256, 257, 258, 4094


def lzw(data: bytes) -> bytes:
    """Codes most significant bit first, widths of 9 to 12 growing a code early."""
    table = {s: i for i, s in enumerate(_SINGLE)}
    nxt, width, held, bits, out, word = FIRST, 9, CLEAR, 9, bytearray(), b""
    for s in map(_SINGLE.__getitem__, data):
        longer = word + s
        if longer in table:
            word = longer
            continue
        held, bits = held << width | table[word], bits + width
        table[longer] = nxt
        nxt += 1
        word = s
        if nxt > FULL:
            held, bits = held << width | CLEAR, bits + width
            table = {s: i for i, s in enumerate(_SINGLE)}
            nxt, width = FIRST, 9
        elif nxt > (1 << width) - 1:
            width += 1
        if bits >= 4096:
            over = bits % 8
            out += (held >> over).to_bytes(bits // 8, "big")
            held, bits = held & ((1 << over) - 1), over
    if word:
        held, bits = held << width | table[word], bits + width
        nxt += 1
        if nxt > (1 << width) - 1 and width < 12:
            width += 1
    held, bits = held << width | END, bits + width
    over = -bits % 8
    return bytes(out) + (held << over).to_bytes((bits + over) // 8, "big")


def unlzw(data: bytes, size: int) -> bytes:
    out, made = [], 0
    table: list[bytes] = []
    width, held, bits, last = 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table = [*_SINGLE, b"", b""]
            width, last = 9, None
            continue
        if code > len(table) or last is None and code >= len(table):
            raise ValueError(f"LZW code {code} is not in the table")
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        made += len(word)
        last = word
        # the writer grows its width a code before the table needs it
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        if made >= size:
            break
    return b"".join(out)


def decoded(data: bytes, compression: int, size: int) -> bytes:
    """The first ``size`` bytes of a strip or tile."""
    if compression == NONE:
        got = data
    elif compression == PACKBITS:
        got = unpackbits(data, size)
    elif compression == LZW:
        got = unlzw(data, size)
    elif compression in (DEFLATE, DEFLATE_OLD):
        got = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(got) < size:
        raise ValueError(f"data cut short: {len(got)} of {size} bytes")
    return got[:size]


def encoded(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 6)}[compression](data)


def difference(block: np.ndarray) -> np.ndarray:
    """Horizontal differencing of rows x columns x samples."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def undifference(block: np.ndarray) -> np.ndarray:
    return np.cumsum(block, axis=1, dtype=block.dtype)


def undifference_floats(raw: bytes, rows: int, columns: int, depth: int, size: int) -> np.ndarray:
    """Floating point differencing: a row's bytes by significance, each less the one ``depth`` before."""
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1, depth)
    planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, columns * depth)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, depth)


# ---- writing ----------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    compression: int = DEFLATE
    predictor: int = 1
    tiled: bool = False
    order: str = "<"


#: What the writer deals payloads out to; PackBits packs runs, which differencing would break.
LAYOUTS = [
    Layout(compression, predictor, tiled, order)
    for compression, predictors in ((PACKBITS, (1,)), (LZW, (1, 2)), (DEFLATE, (1, 2)))
    for predictor in predictors
    for tiled in (False, True)
    for order in "<>"
]


def layout_for(payload: bytes) -> Layout:
    """The writer's layout by the payload's hash, so that equal texts have equal files."""
    return LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]


def _blocks(image: np.ndarray, layout: Layout) -> list[np.ndarray]:
    height, width = image.shape
    if not layout.tiled:
        return [image[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
    found = []
    for y in range(0, height, TILE):
        for x in range(0, width, TILE):
            tile = np.zeros((TILE, TILE), dtype=np.uint8)
            part = image[y : y + TILE, x : x + TILE]
            tile[: part.shape[0], : part.shape[1]] = part
            found.append(tile)
    return found


def write(images: list[np.ndarray], layout: Layout) -> bytes:
    """A file with a page for each 8-bit grey image."""
    order = layout.order
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        at, counts = [], []
        for block in _blocks(image, layout):
            if layout.predictor == 2:
                block = difference(block)
            data = encoded(block.tobytes(), layout.compression)
            at.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = {
            WIDTH: (4, [image.shape[1]]),
            HEIGHT: (4, [image.shape[0]]),
            BITS: (3, [8]),
            COMPRESSION: (3, [layout.compression]),
            PHOTOMETRIC: (3, [1]),
            SAMPLES: (3, [1]),
        }
        if layout.tiled:
            fields |= {TILE_WIDTH: (4, [TILE]), TILE_HEIGHT: (4, [TILE]), TILE_OFFSETS: (4, at), TILE_COUNTS: (4, counts)}
        else:
            fields |= {STRIP_OFFSETS: (4, at), ROWS_PER_STRIP: (4, [STRIP_ROWS]), STRIP_COUNTS: (4, counts)}
        if layout.predictor != 1:
            fields[PREDICTOR] = (3, [layout.predictor])
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            raw = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW))


def file_of(payload: bytes, layout: Layout | None = None) -> bytes:
    """A payload, a positive multiple of the row, as a TIFF file."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    step = PAGE_BYTES // ROW
    return write([rows[s : s + step] for s in range(0, len(rows), step)], layout or layout_for(payload))


# ---- reading ----------------------------------------------------------------


#: Sample types by bits.
KINDS = {1: "u1", 8: "u1", 16: "u2", 32: "u4"}


@dataclass
class Page:
    index: int
    compression: int
    predictor: int
    tiled: bool
    samples: np.ndarray  # rows x columns x samples of a pixel


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The fields of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields: dict[int, tuple] = {"order": order}
        for k in range(n):
            here = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, here)
            code = FIELD.get(kind)
            if code is None:
                continue
            size = struct.calcsize(f"{order}{count}{code}")
            where = here + 8 if size <= 4 else struct.unpack_from(order + "I", data, here + 8)[0]
            fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        yield fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read(data: bytes) -> Iterator[Page]:
    """The pages of a file."""
    for index, d in enumerate(directories(data)):
        one = lambda tag, default=None: d[tag][0] if tag in d else default  # noqa: E731, B023
        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        floats = one(SAMPLE_FORMAT, 1) == 3
        if bits not in KINDS or predictor not in ((1,) if bits == 1 else (1, 3) if floats else (1, 2)) or floats and bits != 32:
            raise ValueError(f"{bits} bits with predictor {predictor} are not supported")
        kind = np.dtype(d["order"] + ("f4" if floats else KINDS[bits]))
        planes = samples if one(PLANAR, 1) == 2 else 1
        depth = samples // planes
        tiled = TILE_OFFSETS in d
        block_w = one(TILE_WIDTH) if tiled else width
        block_h = one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height), height)
        across, down = -(-width // block_w), -(-height // block_h)
        offsets = d[TILE_OFFSETS if tiled else STRIP_OFFSETS]
        counts = d[TILE_COUNTS if tiled else STRIP_COUNTS]
        image = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
        for k, (at, n) in enumerate(zip(offsets, counts)):
            plane, k = divmod(k, across * down)
            y, x = k // across * block_h, k % across * block_w
            rows = block_h if tiled else min(block_h, height - y)
            raw = decoded(data[at : at + n], compression, rows * -(-block_w * depth * bits // 8))
            if bits == 1:
                packed = np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1)
                block = np.unpackbits(packed, axis=1, count=block_w * depth).reshape(rows, block_w, depth)
            elif predictor == 3:
                block = undifference_floats(raw, rows, block_w, depth, kind.itemsize).astype(image.dtype)
            else:
                block = np.frombuffer(raw, dtype=kind).astype(image.dtype).reshape(rows, block_w, depth)
            if predictor == 2:
                block = undifference(block)
            target = image[y : y + rows, x : x + block_w, plane * depth : (plane + 1) * depth]
            target[...] = block[: target.shape[0], : target.shape[1]]
        yield Page(index, compression, predictor, tiled, image)


def feature(payload: np.ndarray, first: Page, count: int) -> str:
    """A few figures of the decoded samples, as text."""
    bins = np.bincount(payload >> 5, minlength=8)
    layout = f"{NAMES[first.compression]}/{'tiles' if first.tiled else 'strips'}/p{first.predictor}"
    return f"{layout};pages={count};mean={payload.mean():.4f};bins={'-'.join(map(str, bins))}"


def stored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's padded bytes as a TIFF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            sizes, files = [], []
            for t in b.column(1).to_pylist():
                n, payload = padded(t)
                sizes.append(n)
                files.append(file_of(payload))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


PAGE_SCHEMA = (
    "page_index int, n_pages int, width int, height int, samples_per_pixel int, compression string, predictor int, "
    "tiled boolean, page_bytes long, page_sha256 string, file_bytes long, file_sha256 string, "
    "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string"
)


def pages(media: DataFrame, media_column: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes"), pixels: bool = False) -> DataFrame:
    """One row per page of every file in ``media_column``, beside the ``keep`` columns.

    The columns from ``file_bytes`` on describe the whole file and repeat on its
    pages. ``pixels`` adds the decoded samples.
    """
    n_kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, n_kept, 1 << 21):
            owner, rows = [], []
            for i, data in enumerate(b.column(n_kept).to_pylist()):
                if data is None:
                    continue
                try:
                    found = list(read(data))
                except (ValueError, TypeError, IndexError, ZeroDivisionError, KeyError, struct.error, zlib.error) as e:
                    owner.append(i)
                    rows.append((*[None] * 10, len(data), hashlib.sha256(data).hexdigest(), *[None] * 4, f"{type(e).__name__}: {e}", *[None] * pixels))
                    continue
                if not found:
                    continue
                flat = [p.samples.reshape(-1).view(np.uint8) for p in found]
                whole = np.concatenate(flat) if len(flat) != 1 else flat[0]
                raw = whole.tobytes()
                of_file = (
                    len(data), hashlib.sha256(data).hexdigest(), len(raw), hashlib.sha256(raw).hexdigest(),
                    zlib.crc32(raw[-64:]), feature(whole, found[0], len(found)), None,
                )
                for p, f in zip(found, flat):
                    h, w, s = p.samples.shape
                    page = f.tobytes()
                    owner.append(i)
                    rows.append(
                        (p.index, len(found), w, h, s, NAMES[p.compression], p.predictor, p.tiled, len(page),
                         hashlib.sha256(page).hexdigest(), *of_file, *([page] if pixels else []))
                    )
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [b.column(k).take(pa.array(owner, pa.int64())) for k in range(n_kept)]
                + [pa.array(list(c), t) for c, t in zip(columns, kinds)],
                names=[*keep, *names],
            )

    schema = PAGE_SCHEMA + (", pixels binary" if pixels else "")
    names, declared = zip(*(x.split() for x in schema.split(", ")))
    arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [arrow[k] for k in declared]
    kept = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return media.select(*(F.col(c) for c in keep), F.col(media_column)).mapInArrow(run, f"{kept}, {schema}")


def round_trip(docs: DataFrame) -> DataFrame:
    """A row per document: what its stored form gives back."""
    first = pages(stored(docs)).where(F.col("page_index") == 0)
    return first.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.col("file_bytes").alias("media_bytes"), F.col("file_sha256").alias("media_sha256"), "feature", "n_pages",
    )
