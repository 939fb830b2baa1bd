"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

``text_media`` stores texts' bytes losslessly as GIFs in a binary column, and ``read_media`` reads any GIF 87a/89a of such a
column back: global and local palettes, interlacing, graphic control extensions, partial frames, transparency and the four
disposal methods. Frames are composed on the canvas as a viewer would show them, one at a time, and become an array column
with times, places and colour histograms; the samples themselves come back as ``payload``.

``encode`` makes one frame for every ``FRAME_ROWS`` rows of samples. Samples are palette indices. Frames of ASCII samples take
palettes of 128 colours and 7-bit codes, others 256; the global palette is the first frame's, and a frame of the other
kind brings its own. Frames are disposed of by each method in turn (left, cleared, undone), and from the second on blanks are
transparent: what is shown depends on these rules, the samples do not.

Defined results: an empty payload cannot be stored (callers pad it); null media give null payload, frames and error;
truncated or foreign bytes raise ``ValueError`` in ``decode``, and ``read_media`` turns that into ``error`` beside null
payload and frames. Equal bytes give equal results; repeated rows stay; other columns pass through, those named like the
added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples in a stored row, and rows in a stored frame.
ROW, FRAME_ROWS = 192, 32
#: Hundredths of a second that a stored frame is shown; the sample that is transparent in all frames but the first.
DELAY, BLANK = 4, 32
_FULL = 4096


def palette(bits: int) -> np.ndarray:
    """2**bits colours: red and green in eight steps; blue in four, or two of 7-bit palettes."""
    i, blues = np.arange(1 << bits), 1 << bits - 6
    return np.stack([i // (8 * blues) * 255 // 7, i // blues % 8 * 255 // 7, i % blues * 255 // (blues - 1)], axis=1).astype(np.uint8)


_PALETTES = {bits: palette(bits).tobytes() for bits in (7, 8)}


def _widths(first: int, least: int, n: int) -> np.ndarray:
    """Bits of the n codes that follow a clear code, where the table starts at ``first``: one entry for each code but the first."""
    used = first + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(used)).astype(np.int64) + 1, least, 12)


@cache
def _sizes(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and where they start."""
    widths = _widths((1 << bits) + 2, bits + 1, _FULL)
    return widths, np.concatenate([[0], np.cumsum(widths)])


def lzw_codes(data: bytes, bits: int = 8) -> list[list[int]]:
    """Runs of LZW codes of samples below 2**bits; the table starts anew with each run, when it is full and not before."""
    first = (1 << bits) + 2
    runs, codes, table, free = [], [], {}, first
    emit, known = codes.append, table.get
    prefix = data[0]
    for sample in data[1:]:
        key = prefix << 8 | sample
        longer = known(key)
        if longer is not None:
            prefix = longer
            continue
        emit(prefix)
        table[key] = free
        free += 1
        prefix = sample
        if free == _FULL:
            runs.append(codes)
            codes, table, free = [], {}, first
            emit, known = codes.append, table.get
    emit(prefix)
    runs.append(codes)
    return runs


def pack_codes(runs: list[list[int]], bits: int = 8) -> bytes:
    """The bit stream, least significant bit first: a clear code before each run, the end code after the last."""
    clear = 1 << bits
    values, widths = [np.array([clear])], [np.array([bits + 1])]
    for k, codes in enumerate(runs):
        tail = clear + 1 if k == len(runs) - 1 else clear
        values.append(np.array([*codes, tail]))
        widths.append(_sizes(bits)[0][: len(codes) + 1])
    value, width = np.concatenate(values), np.concatenate(widths)
    end = np.cumsum(width)
    at = end - width
    size = int(end[-1] + 7) // 8
    shifted, byte = value << (at & 7), at >> 3
    total = np.zeros(size + 3)
    for k in range(3):
        total += np.bincount(byte + k, shifted >> 8 * k & 255, size + 3)
    return total[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int, limit: int) -> bytes:
    """Samples of an LZW code stream with ``bits``-bit samples, at most ``limit``; any clear codes, deferred ones too."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, size = 8 * len(stream), 0, 0
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    widths, starts = _sizes(bits)
    out: list[bytes] = []
    table, previous, place, open_ = list(singles), b"", 0, True
    while size < limit and open_:
        # codes of one run are read together, up to its clear or end code; beyond a full table all have 12 bits
        if place < _FULL:
            room = widths[place:]
            offset = at + starts[place:-1] - starts[place]
        else:
            room, offset = np.full(_FULL, 12), at + 12 * np.arange(_FULL)
        fits = int(np.searchsorted(offset + room, total, "right"))
        offset, room = offset[:fits], room[:fits]
        byte = offset >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offset & 7)) & ((1 << room) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else fits
        for code in codes[:n].tolist():
            if not previous:
                if code >= clear:
                    raise ValueError("LZW run starts with no sample")
                entry = singles[code]
            elif code < len(table):
                entry = table[code]
                if len(table) < _FULL:
                    table.append(previous + entry[:1])
            elif code == len(table) < _FULL:
                entry = previous + previous[:1]
                table.append(entry)
            else:
                raise ValueError("LZW code beyond its table")
            out.append(entry)
            size += len(entry)
            previous = entry
        if len(stops):
            open_ = codes[n] == clear
            at = int(offset[n] + room[n])
            table, previous, place = list(singles), b"", 0
        else:
            open_ = fits > 0 and fits == (len(widths) - place if place < _FULL else _FULL)
            at = int(offset[-1] + room[-1]) if fits else at
            place += fits
    return b"".join(out)[:limit]


def _blocks(data: bytes) -> bytes:
    """``data`` in sub-blocks of at most 255 bytes, with the terminator."""
    whole = len(data) // 255
    head = np.full((whole, 256), 255, np.uint8)
    head[:, 1:] = np.frombuffer(data, np.uint8, 255 * whole).reshape(whole, 255)
    tail = data[255 * whole :]
    return head.tobytes() + (bytes([len(tail)]) + tail if tail else b"") + b"\0"


def encode(samples: bytes, width: int = ROW, frame_rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames' index streams, one after the other, are ``samples`` (rows of ``width``)."""
    rows, rest = divmod(len(samples), width)
    if rest or not rows:
        raise ValueError("samples are not whole rows")
    u16 = lambda n: n.to_bytes(2, "little")
    parts: list[bytes] = []
    common = 0
    for nr, top in enumerate(range(0, rows, frame_rows)):
        n = min(frame_rows, rows - top)
        own = samples[top * width : (top + n) * width]
        bits = 7 if own.isascii() else 8
        if not nr:
            common = bits
            parts += [b"GIF89a", u16(width), u16(n), bytes([0xF0 | bits - 1, 0, 0]), _PALETTES[bits]]
        parts += [b"\x21\xf9\x04", bytes([nr % 3 + 1 << 2 | (nr > 0)]), u16(delay), bytes([BLANK if nr else 0, 0])]
        local = _PALETTES[bits] if bits != common else b""
        parts += [b"\x2c\0\0\0\0", u16(width), u16(n), bytes([0x80 | bits - 1 if local else 0]), local, bytes([bits])]
        parts.append(_blocks(pack_codes(lzw_codes(own, bits), bits)))
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    """One image of a GIF, and the canvas as it is shown for ``delay`` hundredths of a second: 0xAARRGGBB, alpha 0 or 255.

    The canvas is the decoder's own and holds only until the next frame is asked for.
    """

    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    local: bool
    indices: bytes
    canvas: np.ndarray

    def rgb(self) -> np.ndarray:
        return np.stack([self.canvas >> 16 & 255, self.canvas >> 8 & 255, self.canvas & 255], axis=-1).astype(np.uint8)

    def opaque(self) -> np.ndarray:
        return self.canvas >> 24 != 0


def _packed(colours: np.ndarray) -> np.ndarray:
    """A palette as 256 values 0xFFRRGGBB."""
    out = np.full(256, 0xFF000000, np.uint32)
    c = colours.astype(np.uint32)
    out[: len(c)] |= c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]
    return out


def decode(data: bytes) -> list[Frame]:
    """All frames, each with a canvas of its own."""
    return [replace(f, canvas=f.canvas.copy()) for f in frames_of(data)]


def frames_of(data: bytes) -> Iterator[Frame]:
    """Frames, composed one by one. Rows of an interlaced frame are put in order; missing samples at a stream's end are index 0."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    at, common = 13, None
    if data[10] & 0x80:
        n = 3 << (data[10] & 7) + 1
        common, at = _packed(np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)), at + n
    canvas = np.zeros((height, width), np.uint32)
    delay, disposal, transparent = 0, 0, None

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            if at >= len(data):
                raise ValueError("GIF ends within a block")
            n = data[at]
            if not n:
                return b"".join(parts), at + 1
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n

    while True:
        if at >= len(data):
            raise ValueError("GIF without trailer")
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            body, end = sub_blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
            at = end
            continue
        if kind != 0x2C or at + 10 > len(data):
            raise ValueError("unknown GIF block")
        left, top, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
        flags, at = data[at + 9], at + 10
        table = common
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            table, at = _packed(np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)), at + n
        if table is None or at >= len(data):
            raise ValueError("GIF frame without palette")
        bits = data[at]
        if not 2 <= bits <= 8:
            raise ValueError("GIF samples of no known size")
        stream, at = sub_blocks(at + 1)
        found = lzw_decode(stream, bits, w * h)
        grid = np.frombuffer(found.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            rows = np.empty_like(grid)
            rows[order] = grid
            grid = rows
        before = canvas.copy() if disposal == 3 else None
        seen = grid[: max(0, height - top), : max(0, width - left)]
        area = np.s_[top : top + seen.shape[0], left : left + seen.shape[1]]
        if transparent is None:
            canvas[area] = table[seen]
        else:
            canvas[area] = np.where(seen != transparent, table[seen], canvas[area])
        yield Frame(left, top, w, h, delay, disposal, transparent, bool(flags & 0x80), grid.tobytes(), canvas)
        if disposal == 2:
            canvas[area] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by red, green and blue in four steps each: 64 counts."""
    steps = canvas >> 18 & 0x30 | canvas >> 12 & 0xC | canvas >> 6 & 3
    return np.bincount((steps | canvas >> 25 & 64).ravel(), minlength=128)[64:]


def luma(canvas: np.ndarray) -> float | None:
    """Mean brightness of the opaque pixels."""
    on = canvas[canvas >> 24 != 0]
    return float((0.299 * (on >> 16 & 255) + 0.587 * (on >> 8 & 255) + 0.114 * (on & 255)).mean()) if len(on) else None


#: What ``read_media`` adds.
FRAME = "frame int, `left` int, top int, width int, height int, delay_cs int, start_cs long, disposal int, transparent int, local_palette boolean, histogram array<long>, luma double"
READ = f"payload binary, frames array<struct<{FRAME.replace(' ', ':').replace(',:', ',')}>>, duration_cs long, histogram array<long>, error string"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
_FRAME = pa.struct([(n.strip("`"), _KINDS[k]) for n, k in (c.split(" ") for c in FRAME.split(", "))])
_READ = [("payload", pa.binary()), ("frames", pa.list_(_FRAME)), ("duration_cs", pa.int64()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())]


def _read(data: bytes | None) -> dict:
    if data is None:
        return {}
    payload, frames, start, total = [], [], 0, np.zeros(64, np.int64)
    try:
        for n, f in enumerate(frames_of(data)):
            counts = histogram(f.canvas)
            total += counts
            payload.append(f.indices)
            place = {"left": f.left, "top": f.top, "width": f.width, "height": f.height}
            shown = {"delay_cs": f.delay, "start_cs": start, "disposal": f.disposal, "transparent": f.transparent, "local_palette": f.local}
            frames.append({"frame": n, **place, **shown, "histogram": counts.tolist(), "luma": luma(f.canvas)})
            start += f.delay
    except ValueError as e:
        return {"error": str(e)}
    return {"payload": b"".join(payload), "frames": frames, "duration_cs": start, "histogram": total.tolist()}


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds to every row what the GIF in ``column`` holds: samples, timed frames, duration, the frames' histograms summed up, or the error."""
    names = [n for n, _ in _READ]
    kept = media.drop(*(n for n in names if n != column))
    place = kept.columns.index(column)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 256):
                own = part.slice(k, 256)
                found = [_read(x) for x in own.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([x.get(n) for x in found], kind) for n, kind in _READ)], [*own.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(batches, f"{schema}, {READ}")


def media_frames(media: DataFrame, key: str, column: str) -> DataFrame:
    """One row per frame of the GIF bytes in ``column``, with the row's ``key``; one with ``error`` alone for bytes that cannot be read."""
    read = read_media(media.select(media[key].cast("long").alias("key"), media[column].cast("binary").alias("media")))
    return read.select("key", "error", F.explode_outer("frames").alias("f")).filter("f is not null or error is not null").select("key", "f.*", "error")


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and its UTF-8 bytes with blanks up to whole rows, one at least."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (-len(raw) % ROW if raw else ROW)


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text's padded UTF-8 bytes as a GIF."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 256):
                got = [padded(t) for t in part.column(1).slice(k, 256).to_pylist()]
                sizes, media = pa.array([x[0] for x in got], pa.int64()), pa.array([encode(x[1]) for x in got], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(k, 256), sizes, media], ["doc_id", "n_bytes", "media"])

    return docs.select(docs.doc_id.cast("long"), docs.text.cast("string")).mapInArrow(batches, "doc_id long, n_bytes long, media binary")


def feature(frames: Column, duration: Column, counts: Column) -> Column:
    """Number of frames, their time, and for each of the 64 colour bins its share of all shown pixels in sixteenths (0 to f)."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    share = F.transform(counts, lambda x: F.lower(F.hex(F.floor(x * 15 / F.greatest(total, F.lit(1)) + 0.5).cast("long"))))
    return F.concat(F.size(frames).cast("string"), F.lit("f"), duration.cast("string"), F.lit("cs-"), F.array_join(share, ""))


def media_digests(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and digests of what the stored GIFs of (doc_id, n_bytes, media) hold."""
    tail = F.expr("substr(payload, -16)")
    return read_media(media.select("doc_id", "n_bytes", "media")).select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature(F.col("frames"), F.col("duration_cs"), F.col("histogram")).alias("feature"),
    )
