"""TIFF media columns: image directories, strips and tiles, PackBits, LZW and deflate, predictors; one row per page.

The reader takes either byte order, samples of 1, 8, 16 and 32 bits (those of 1 bit come out as a byte each),
interleaved or separate planes. The writer makes what the reader's tests and the media query need. Neither knows JPEG or
fax compression.

Defined results of the reader: a null file has no pages; a file without a TIFF head, or a page that can't be decoded,
gives one page row with an error and no samples, and the pages behind it are read all the same; so does a page of more
than MAX_PIXELS samples, which read_blocks reads; directories that point back end the walk; very long texts become many
pages; repeated rows stay; an empty table gives no rows; all other columns of the table are
kept, whatever they are called, but for one with the result's name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.shared import place, plain, restored, table

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST = 256, 257, 258
#: Codes of one LZW table; some writers clear it a few codes late.
TABLE_END = 1 << 13
#: Samples of a page that come in one cell of a row; read_blocks gives those of larger pages by strips or tiles.
MAX_PIXELS = 1 << 28
#: Bytes of a strip or tile, without a bound.
UNBOUND = (1 << 31) - 1
#: Bytes of media that one Arrow batch of results holds, about.
BATCH_BYTES = 16 << 20

TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "samples": 277, "rows_per_strip": 278, "strip_counts": 279,
    "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325,
}
NAMES = {v: k for k, v in TAGS.items()}
FORMATS = {1: "B", 3: "H", 4: "I"}
NUMBERS = {1: "u1", 3: "u2", 4: "u4"}

PAGE = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("compression", T.IntegerType()),
        T.StructField("predictor", T.IntegerType()),
        T.StructField("tiled", T.BooleanType()),
        T.StructField("samples", T.BinaryType()),
        T.StructField("look", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


#: A strip or tile: where it lies on its page, and its samples, row by row.
BLOCK = T.StructType([T.StructField(n, T.IntegerType()) for n in ("page", "plane", "y", "x", "height", "width")] + [T.StructField("samples", T.BinaryType()), T.StructField("error", T.StringType())])


# --------------------------------------------------------------------- codecs


def packbits_encode(data: bytes) -> bytes:
    """Runs of 3 bytes or more as such, all else as literals of up to 128 bytes."""
    out, at = [], 0

    def literal(part: bytes) -> None:
        for k in range(0, len(part), 128):
            out.append(bytes([len(part[k : k + 128]) - 1]) + part[k : k + 128])

    for m in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(data[at : m.start()])
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        at = m.end()
    literal(data[at:])
    return b"".join(out)


def packbits_decode(data: bytes, most: int = UNBOUND) -> bytes:
    """The bytes that data stands for, no more than `most` and what the last run adds."""
    out, at, n, size = [], 0, len(data), 0
    while at < n and size < most:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += 2 + head
            size += head + 1
        else:
            if head > 128:
                out.append(data[at + 1 : at + 2] * (257 - head))
                size += 257 - head
            at += 2 if head > 128 else 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, widths that grow one code early for the reader."""
    codes, widths = [CLEAR], [9]
    known: dict[int, int] = {}
    free, width, prefix = FIRST, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = known.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        widths.append(width)
        known[key] = free
        free += 1
        prefix = byte
        if free == 4094:
            codes.append(CLEAR)
            widths.append(width)
            known.clear()
            free, width = FIRST, 9
        elif free >> width:
            width += 1
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        free += 1
        if free == 4094:
            codes.append(CLEAR)
            widths.append(width)
            width = 9
        elif free >> width:
            width += 1
    codes.append(END)
    widths.append(width)
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16)[None, :] >= 16 - np.array(widths)[:, None]]).tobytes()


def lzw_decode(data: bytes, most: int = UNBOUND) -> bytes:
    """The bytes that data stands for, no more than `most` and what one table of codes adds."""
    singles = [bytes([k]) for k in range(256)] + [b"", b""]
    known, free, out, counted, size = singles.copy(), FIRST, [], 0, 0
    push, learn = out.append, known.append
    held, have, width, last, grow = 0, 0, 9, b"", 511
    for byte in data:
        held = held << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code == CLEAR:
            size += sum(map(len, out[counted:]))
            if size >= most:
                break
            known, free, width, last, grow, counted = singles.copy(), FIRST, 9, b"", 511, len(out)
            learn = known.append
            continue
        if code == END:
            break
        if not last:
            last = known[code]
            push(last)
            continue
        if code < free:
            now = known[code]
            learn(last + now[:1])
        elif code == free:
            now = last + last[:1]
            learn(now)
        else:
            raise ValueError("LZW code ahead of its table")
        push(now)
        last = now
        free += 1
        if free == grow and width < 12:
            width += 1
            grow = grow * 2 + 1
        elif free > TABLE_END:
            raise ValueError("LZW codes without a clear")
    return b"".join(out)


def inflate(data: bytes, most: int = UNBOUND) -> bytes:
    """The first `most` bytes that data stands for; an error if it ends before its own end and these."""
    stream = zlib.decompressobj()
    out = stream.decompress(data, most)
    if not stream.eof and len(out) < most:
        raise ValueError("a deflate stream is cut off")
    return out


def stored(data: bytes, most: int = UNBOUND) -> bytes:
    return data[:most]


ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress, PACKBITS: packbits_encode}
DECODERS = {NONE: stored, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}


# --------------------------------------------------------------------- writer


def write_page(pixels: np.ndarray, compression: int, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 32, order: str = "<") -> tuple[list[tuple[str, int, list[int]]], list[bytes]]:
    """Entries (name, type, values) and the encoded strips or tiles of pixels (height, width, channels)."""
    height, width, channels = pixels.shape
    if tile:
        tw, th = tile
        across, down = -(-width // tw), -(-height // th)
        full = np.zeros((down * th, across * tw, channels), pixels.dtype)
        full[:height, :width] = pixels
        blocks = [full[y * th : y * th + th, x * tw : x * tw + tw] for y in range(down) for x in range(across)]
    else:
        blocks = [pixels[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
    parts = []
    for block in blocks:
        if predictor == 2:
            block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
        parts.append(ENCODERS[compression](np.ascontiguousarray(block, block.dtype.newbyteorder(order)).tobytes()))
    entries = [
        ("width", 4, [width]), ("height", 4, [height]), ("bits", 3, [8 * pixels.dtype.itemsize] * channels), ("compression", 3, [compression]), ("photometric", 3, [2 if channels >= 3 else 1]),
        ("samples", 3, [channels]), ("planar", 3, [1]), ("predictor", 3, [predictor]),
    ]
    counts = [len(p) for p in parts]
    if tile:
        entries += [("tile_width", 4, [tile[0]]), ("tile_height", 4, [tile[1]]), ("tile_offsets", 4, [0] * len(parts)), ("tile_counts", 4, counts)]
    else:
        entries += [("strip_offsets", 4, [0] * len(parts)), ("rows_per_strip", 4, [rows_per_strip]), ("strip_counts", 4, counts)]
    return sorted(entries, key=lambda e: TAGS[e[0]]), parts


def write_tiff(pages: list[tuple[list[tuple[str, int, list[int]]], list[bytes]]], order: str = "<") -> bytes:
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for entries, parts in pages:
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part
        out += b"\0" * (len(out) % 2)
        directory = struct.pack(order + "H", len(entries))
        at = len(out)  # values that don't fit an entry stand before the directory
        for name, kind, values in entries:
            values = offsets if name.endswith("_offsets") else values
            packed = struct.pack(order + FORMATS[kind] * len(values), *values)
            if len(packed) > 4:
                out += packed + b"\0" * (len(packed) % 2)
                packed, at = struct.pack(order + "I", at), len(out)
            directory += struct.pack(order + "HHI", TAGS[name], kind, len(values)) + packed.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(order + "I", len(out))
        link = len(out) + len(directory)
        out += directory + b"\0\0\0\0"
    return bytes(out)


# --------------------------------------------------------------------- reader


def directories(data: bytes) -> Iterator[tuple[str, dict[str, list[int]]]]:
    """Byte order and entries of each image directory in turn. An entry whose values can't be read leaves a `fault`."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        entries: dict[str, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if tag in NAMES and kind in FORMATS:
                where, size = at + 10 + 12 * k, count * struct.calcsize(FORMATS[kind])
                if size > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)  # within the directory
                if where + size > len(data):
                    entries["fault"] = [f"{NAMES[tag]} goes beyond the file"]
                    continue
                entries[NAMES[tag]] = np.frombuffer(data, order + NUMBERS[kind], count, where).tolist()
        yield order, entries
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


class Layout:
    """Size, samples and strips or tiles of the page of a directory."""

    def __init__(self, order: str, e: dict[str, list[int]]) -> None:
        if "fault" in e:
            raise ValueError(e["fault"][0])
        self.width, self.height, self.channels = e["width"][0], e["height"][0], e.get("samples", [1])[0]
        depths, self.predictor, self.compression = set(e.get("bits", [1])), e.get("predictor", [1])[0], e.get("compression", [NONE])[0]
        self.bits = min(depths, default=0)
        if len(depths) != 1 or self.bits not in SAMPLES or self.predictor not in ((1, 2) if self.bits > 1 else (1,)) or self.compression not in DECODERS:
            raise ValueError(f"bits {sorted(depths)}, predictor {self.predictor} or compression {self.compression} isn't known")
        self.tiled, self.separate = "tile_offsets" in e, e.get("planar", [1])[0] == 2
        self.bw, self.bh = (e["tile_width"][0], e["tile_height"][0]) if self.tiled else (self.width, min(e.get("rows_per_strip", [self.height])[0], self.height))
        self.deep = 1 if self.separate else self.channels
        if not min(self.width, self.height, self.channels, self.bw, self.bh) or self.bw * self.bh * self.deep > MAX_PIXELS:
            raise ValueError(f"{self.width} x {self.height} pixels of {self.channels} samples in blocks of {self.bw} x {self.bh}")
        self.across, self.down = -(-self.width // self.bw), -(-self.height // self.bh)
        self.offsets, self.counts = (e["tile_offsets"], e["tile_counts"]) if self.tiled else (e["strip_offsets"], e["strip_counts"])
        if len(self.offsets) != len(self.counts) or len(self.offsets) != self.across * self.down * (self.channels if self.separate else 1):
            raise ValueError(f"{len(self.offsets)} offsets and {len(self.counts)} sizes of strips or tiles")
        self.kind = np.dtype(SAMPLES[self.bits]).newbyteorder(order)

    def blocks(self, data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Plane, row, column and pixels of each strip or tile, cut to the page. A block's bytes are decoded no further
        than its size goes."""
        for k, (at, n) in enumerate(zip(self.offsets, self.counts)):
            plane, where = divmod(k, self.across * self.down)
            y, x = where // self.across * self.bh, where % self.across * self.bw
            rows = self.bh if self.tiled else min(self.bh, self.height - y)
            line = -(-self.bw * self.deep // 8) if self.bits == 1 else self.bw * self.deep * self.kind.itemsize
            raw = DECODERS[self.compression](data[at : at + n], rows * line)
            if self.bits == 1:  # each row begins with a byte of its own
                block = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : self.bw * self.deep].reshape(rows, self.bw, self.deep)
            else:
                block = np.frombuffer(raw, self.kind, rows * self.bw * self.deep).reshape(rows, self.bw, self.deep).astype(self.kind.newbyteorder("="))
            if self.predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype)
            yield plane, y, x, block[: self.height - y, : self.width - x]


def page_pixels(data: bytes, page: Layout) -> np.ndarray:
    """Pixels (height, width, channels) of one page."""
    if page.width * page.height * page.channels > MAX_PIXELS:
        raise ValueError(f"{page.width} x {page.height} pixels of {page.channels} samples are too many for one cell")
    pixels = np.zeros((page.height, page.width, page.channels), page.kind.newbyteorder("="))
    for plane, y, x, part in page.blocks(data):
        pixels[y : y + part.shape[0], x : x + part.shape[1], plane if page.separate else slice(None)] = part[:, :, 0] if page.separate else part
    return pixels


#: Kinds of samples by their bits.
SAMPLES = {1: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.uint32}


def look_of(pixels: np.ndarray) -> str:
    """Which of 8 x 8 cells are brighter than the mean of all cells, as 16 hex digits, and the mean of each channel."""
    height, width, channels = pixels.shape
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in (height, width))
    lo, hi, left, right = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=height), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1).clip(max=width)
    # sums of bands of rows by column and channel: whole numbers, and small beside the page
    bands = np.stack([pixels[a:b].sum(axis=0, dtype=np.int64) for a, b in zip(lo, hi)])
    across = np.pad(bands.sum(axis=2), ((0, 0), (1, 0))).cumsum(1)
    cells = (across[:, right] - across[:, left]) / np.maximum(np.outer(hi - lo, right - left) * channels, 1)
    total = bands.sum(axis=(0, 1)) if height >= 8 else pixels.sum(axis=(0, 1), dtype=np.int64)
    return np.packbits(cells > cells.mean()).tobytes().hex() + "".join(f":{m:.2f}" for m in total / (height * width))


def read_tiff(data: bytes | None) -> list[dict]:
    """The pages of a file, as rows of PAGE."""
    if data is None:
        return []
    pages: list[dict] = []
    try:
        for order, e in directories(data):
            page = {f.name: None for f in PAGE} | {"page": len(pages), "tiled": "tile_offsets" in e}
            pages.append(page)
            try:
                own = Layout(order, e)
                page |= {"width": own.width, "height": own.height, "channels": own.channels, "bits": own.bits, "compression": own.compression, "predictor": own.predictor}
                pixels = page_pixels(data, own)
                page |= {"samples": pixels.tobytes(), "look": look_of(pixels) if pixels.size else ""}
            except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as why:
                page["error"] = f"unreadable page: {why}"
    except (ValueError, struct.error) as why:
        pages.append({f.name: None for f in PAGE} | {"page": len(pages), "error": f"unreadable file: {why}"})
    return pages


def read_blocks_of(data: bytes | None) -> Iterator[dict]:
    """The strips or tiles of a file, as rows of BLOCK, one by one: pages of any size."""
    if data is None:
        return
    page = -1
    try:
        for page, (order, e) in enumerate(directories(data)):
            try:
                for plane, y, x, part in Layout(order, e).blocks(data):
                    yield {"page": page, "plane": plane, "y": y, "x": x, "height": part.shape[0], "width": part.shape[1], "samples": part.tobytes(), "error": None}
            except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as why:
                yield {f.name: None for f in BLOCK} | {"page": page, "error": f"unreadable page: {why}"}
    except (ValueError, struct.error) as why:
        yield {f.name: None for f in BLOCK} | {"page": page + 1, "error": f"unreadable file: {why}"}


# ------------------------------------------------------------------ operators


def _map_column(df: DataFrame, in_col: str, out: T.StructField, each) -> DataFrame:  # noqa: ANN001
    """df with a column of each(value of in_col), worked out in small Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_type

    own = plain(df)
    schema = T.StructType([*own.schema.fields, T.StructField("_out", out.dataType)])
    kind, at = to_arrow_type(out.dataType), df.columns.index(in_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, start, weight = [], 0, 0
            values = batch.column(at)
            for k in range(batch.num_rows):
                value = values[k].as_py()
                done.append(each(value))
                weight += len(value or b"")
                if weight >= BATCH_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, kind)], [*batch.schema.names, "_out"])
                    done, start, weight = [], k + 1, 0

    return restored(own.mapInArrow(run, schema), df, **{out.name: F.col("_out")})


def with_pages(df: DataFrame, media_col: str, out_col: str = "pages") -> DataFrame:
    """df with an array of the pages of the TIFF file in media_col."""
    return _map_column(df, media_col, T.StructField(out_col, T.ArrayType(PAGE)), read_tiff)


def read_pages(df: DataFrame, media_col: str, out_col: str = "page") -> DataFrame:
    """One row per page of each file: the columns of df, but for media_col, and a struct of the page."""
    own, kept = plain(df), [c for c in df.columns if c not in (media_col, out_col)]
    pages = with_pages(own, place(df, media_col), "_pages")
    return pages.select(*[place(df, c) for c in kept], F.explode("_pages")).toDF(*kept, out_col)


def read_blocks(df: DataFrame, media_col: str, out_col: str = "block") -> DataFrame:
    """One row per strip or tile of each file: the columns of df, but for media_col, and a struct of the block. Nothing
    larger than a block is held, so that pages over MAX_PIXELS can be read as well."""
    from pyspark.sql.pandas.types import to_arrow_type

    own, kept = plain(df), [c for c in df.columns if c not in (media_col, out_col)]
    names, media, kind = [place(df, c) for c in kept], place(df, media_col), to_arrow_type(BLOCK)
    schema = T.StructType([*(own.schema[n] for n in names), T.StructField("_out", BLOCK)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in enumerate(batch.column(media)):
                for block in read_blocks_of(value.as_py()):
                    row = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*(row.column(n) for n in names), pa.array([block], kind)], [*names, "_out"])

    return own.mapInArrow(run, schema).toDF(*kept, out_col)


# ---------------------------------------------------------------------- query

#: Geometry of a text as an image: 64 pixels of 3 samples a row, so many rows a page.
ACROSS, CHANNELS, PAGE_ROWS = 64, 3, 256
ROW = ACROSS * CHANNELS
LAYOUTS = [(PACKBITS, 1, None), (LZW, 1, None), (DEFLATE, 2, None), (PACKBITS, 1, (32, 32)), (LZW, 2, (64, 64)), (DEFLATE, 1, (32, 32))]


def text_to_tiff(text: str | None) -> bytes:
    """A text's UTF-8 bytes, filled up with spaces to whole rows, as pages; the payload's checksum picks the layout."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw.ljust(max(1, -(-len(raw) // ROW)) * ROW)
    compression, predictor, tile = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ACROSS, CHANNELS)
    return write_tiff([write_page(pixels[k : k + PAGE_ROWS], compression, predictor, tile) for k in range(0, len(pixels), PAGE_ROWS)])


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = _map_column(docs, "text", T.StructField("media", T.BinaryType()), text_to_tiff)
    sized = stored.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    faulty = F.raise_error(F.concat(F.lit("a page can't be read back: "), F.get(F.filter("pages", lambda p: p["samples"].isNull()), F.lit(0))["error"]))
    joined = F.array_join(F.transform("pages", lambda p: p["samples"].cast("string")), "")
    read = with_pages(sized, "media").withColumn("payload", F.when(F.exists("pages", lambda p: p["samples"].isNull()), faulty).otherwise(joined).cast("binary"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("pages", lambda p: p["look"]), "/").alias("feature"),
        F.size("pages").alias("n_pages"),
    )
