"""Matroska media columns: write and parse EBML, clusters, lacing and cues.

``mux`` stores a payload losslessly as the frames of one audio track of 8-bit samples, and
``parse`` turns any such file into a packet table: track, timestamp, flags, byte range. The
parser follows sizes, skips elements that it does not know, and reads all four lacing kinds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import staged

# Element ids, fixed values of the public format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3
#: The elements that end a segment, and a cluster, of unknown size.
TOP_LEVEL = frozenset((EBML, SEGMENT))
ENDS = {SEGMENT: TOP_LEVEL, CLUSTER: TOP_LEVEL | {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}}

UNIT = 192
SAMPLE_RATE = 48_000
FRAME = 4 * UNIT
LACED = 8
CLUSTER_BLOCKS = 32


class Packet(NamedTuple):
    track: int
    timestamp: int
    cluster: int
    lacing: int
    offset: int
    size: int


class Media(NamedTuple):
    packets: list[Packet]
    duration: float
    codec: str
    sample_rate: float
    clusters: int
    cues: list[tuple[int, int]]
    last_block: int  # timestamp


def size_vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, as short as it can be or ``width`` bytes long."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """The integer at ``at`` and the place after it; a size of all ones is -1 (unknown)."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"bad variable-length integer at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def floating(ident: int, value: float) -> bytes:
    return element(ident, struct.pack(">d", value))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames of one block with the lacing header of that kind."""
    if kind == NO_LACING:
        return frames[0]
    sizes = [len(x) for x in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH_LACING:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += size_vint(sizes[0]) if len(sizes) > 1 else b""
        for before, now in zip(sizes, sizes[1:-1]):
            step = now - before
            width = next(n for n in range(1, 9) if abs(step) < (1 << 7 * n - 1) - 1)
            head += size_vint(step + (1 << 7 * width - 1) - 1, width)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Offset and size of each frame of a block whose lacing header starts at ``at``."""
    if kind == NO_LACING:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED_LACING:
        if (end - at) % count:
            raise ValueError("fixed lacing does not divide its block")
        sizes = [(end - at) // count] * count
    elif kind == XIPH_LACING:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
        sizes.append(end - at - sum(sizes))
    else:
        if count > 1:
            n, at = read_vint(data, at)
            sizes.append(n)
        for _ in range(count - 2):
            start = at
            raw, at = read_vint(data, at)
            width = at - start
            raw = (1 << 7 * width) - 1 if raw < 0 else raw
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
        sizes.append(end - at - sum(sizes))
    out = []
    for n in sizes:
        if n < 0 or at + n > end:
            raise ValueError("a laced frame runs past its block")
        out.append((at, n))
        at += n
    return out


def mux(payload: bytes) -> bytes:
    """One-track Matroska file whose frames, joined, are ``payload`` (a multiple of 192 bytes)."""
    head = element(
        EBML,
        unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8)
        + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2),
    )
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + floating(DURATION, len(payload) * 1000 / SAMPLE_RATE) + element(MUXING_APP, b"ledgerlake") + element(WRITING_APP, b"ledgerlake"))
    audio = element(AUDIO, floating(SAMPLING, SAMPLE_RATE) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, where = [info, tracks], [], len(info) + len(tracks)
    block_bytes = FRAME * LACED
    for start in range(0, len(payload), block_bytes * CLUSTER_BLOCKS):
        base = start * 1000 // SAMPLE_RATE
        blocks = [unsigned(CLUSTER_TIMESTAMP, base)]
        for number, at in enumerate(range(start, min(len(payload), start + block_bytes * CLUSTER_BLOCKS), block_bytes)):
            chunk = payload[at : at + block_bytes]
            frames = [chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)]
            even = len(chunk) % FRAME == 0
            kind = NO_LACING if len(frames) == 1 else (FIXED_LACING, XIPH_LACING, EBML_LACING)[number % 3] if even else (XIPH_LACING, EBML_LACING)[number % 2]
            blocks.append(element(SIMPLE_BLOCK, size_vint(1) + struct.pack(">hB", at * 1000 // SAMPLE_RATE - base, 0x80 | kind << 1) + lace(frames, kind)))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, where))))
        cluster = element(CLUSTER, b"".join(blocks))
        parts.append(cluster)
        where += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def unknown_end(data: bytes, ident: int, at: int, end: int) -> int:
    """Where an element of unknown size ends: a segment or cluster before the next element of its level, others with their parent."""
    while ident in ENDS and at < end:
        child, body = read_vint(data, at, keep_marker=True)
        if child in ENDS[ident]:
            return at
        size, body = read_vint(data, body)
        at = unknown_end(data, child, body, end) if size < 0 else body + size
        if at > end:
            raise ValueError(f"element {child:#x} runs past its parent")
    return end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, body start and body end of each element of a range."""
    while at < end:
        ident, at = read_vint(data, at, keep_marker=True)
        size, at = read_vint(data, at)
        stop = unknown_end(data, ident, at, end) if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element {ident:#x} runs past its parent")
        yield ident, at, stop
        at = stop


def parse(data: bytes) -> Media:
    """Packets, cues and track facts of a file; raises ValueError where it is not well formed.

    Later frames of a laced block are timed by the duration of their block, else by the default
    duration of their track, else, in PCM, by the samples before them; where a file tells none
    of these they have the time of their block.
    """
    packets: list[Packet] = []
    cues: list[tuple[int, int]] = []
    duration, codec, rate, clusters, scale, last = 0.0, "", 0.0, 0, 1_000_000, 0
    steps: dict[int, tuple[float, float]] = {}  # of each track: nanoseconds a frame, nanoseconds a byte
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0

    def block(a: int, b: int, base: int, lasts: int | None = None) -> None:
        nonlocal last
        track, a = read_vint(data, a)
        shift, flags = struct.unpack_from(">hB", data, a)
        kind = flags >> 1 & 3
        frames = unlace(data, a + 3, b, kind)
        frame_ns, byte_ns = (lasts * scale / len(frames), 0.0) if lasts is not None else steps.get(track, (0.0, 0.0))
        last, before = base + shift, 0
        for i, (x, n) in enumerate(frames):
            packets.append(Packet(track, last + int((i * frame_ns or before * byte_ns) / scale + 1e-6), clusters - 1, kind, x, n))
            before += n

    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for ident, a, b in top:
        if ident != SEGMENT:
            continue
        segment = a
        for ident, a, b in elements(data, a, b):
            if ident == INFO:
                for ident, c, d in elements(data, a, b):
                    if ident == DURATION:
                        duration = real(c, d)
                    elif ident == TIMESTAMP_SCALE:
                        scale = number(c, d)
            elif ident == TRACKS:
                for _, c, d in elements(data, a, b):
                    track, frame_ns, name, audio = 0, 0, "", {}
                    for ident, e, f in elements(data, c, d):
                        if ident == CODEC_ID:
                            codec = name = data[e:f].decode()
                        elif ident == TRACK_NUMBER:
                            track = number(e, f)
                        elif ident == DEFAULT_DURATION:
                            frame_ns = number(e, f)
                        elif ident == AUDIO:
                            audio = {i: (x, y) for i, x, y in elements(data, e, f)}
                            rate = real(*audio[SAMPLING]) if SAMPLING in audio else rate
                    width = number(*audio[BIT_DEPTH]) * (number(*audio[CHANNELS]) if CHANNELS in audio else 1) if BIT_DEPTH in audio else 0
                    hertz = real(*audio[SAMPLING]) if SAMPLING in audio else 8000.0  # the format's default
                    steps[track] = (frame_ns, 8e9 / (width * hertz) if name.startswith("A_PCM/") and width * hertz > 0 else 0.0)
            elif ident == CLUSTER:
                clusters, base = clusters + 1, 0
                for ident, c, d in elements(data, a, b):
                    if ident == CLUSTER_TIMESTAMP:
                        base = number(c, d)
                    elif ident == SIMPLE_BLOCK:
                        block(c, d, base)
                    elif ident == BLOCK_GROUP:
                        group = list(elements(data, c, d))
                        lasts = next((number(e, f) for ident, e, f in group if ident == BLOCK_DURATION), None)
                        for ident, e, f in group:
                            if ident == BLOCK:
                                block(e, f, base, lasts)
            elif ident == CUES:
                for _, c, d in elements(data, a, b):
                    point = dict((i, (x, y)) for i, x, y in elements(data, c, d))
                    spot = dict((i, (x, y)) for i, x, y in elements(data, *point[CUE_TRACK_POSITIONS]))
                    cues.append((number(*point[CUE_TIME]), segment + number(*spot[CUE_CLUSTER_POSITION])))
    return Media(packets, duration * scale / 1e6, codec, rate, clusters, cues, last)


def padded(text: bytes | None) -> bytes:
    raw = text or b""
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _map(docs: DataFrame, id_col: str, text_col: str, make, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()) for row in make(key, raw)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema)

    return staged(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(run, ddl), "media")


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: each whole text, padded, as a Matroska file. Null text: an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
    return _map(docs, id_col, text_col, lambda key, raw: [(key, mux(padded(raw)))], schema, "doc_id bigint, media binary")


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of every file: its track, timestamp, cluster, lacing and byte range.

    A null file has no packets; one that is not well formed has a single row with ``error``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("packet", pa.int64()), ("track", pa.int64()), ("timestamp", pa.int64()), ("cluster", pa.int64()), ("lacing", pa.int64()), ("byte_offset", pa.int64()), ("byte_size", pa.int64()), ("error", pa.string())])

    def make(key, raw):
        if raw is None:
            return []
        try:
            return [(key, i, *p, None) for i, p in enumerate(parse(raw).packets)]
        except (ValueError, IndexError, KeyError, struct.error) as e:
            return [(key, *[None] * 7, str(e) or type(e).__name__)]

    return _map(files, id_col, media_col, make, schema, ", ".join(f"{f.name} {'string' if f.name == 'error' else 'bigint'}" for f in schema))


def features(media: bytes) -> tuple[bytes, str]:
    """The payload that a file's packets hold, and a line about the file."""
    found = parse(media)
    payload = b"".join(media[p.offset : p.offset + p.size] for p in found.packets)
    kinds = [0] * 4
    for p in found.packets:
        kinds[p.lacing] += 1
    sought = all(media[at : at + 4] == CLUSTER.to_bytes(4, "big") for _, at in found.cues)
    line = f"codec={found.codec};rate={found.sample_rate:.0f};clusters={found.clusters};cues={len(found.cues)};seekable={int(sought)};packets={len(found.packets)};lacing={'/'.join(map(str, kinds))};last_ms={found.last_block}"
    return payload, line


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every whole text as a file, reads the file back and returns digests of both.

    Null text counts as empty. Equal texts give equal values. Null ids and repeated rows come
    out as they are; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def make(key, raw):
        media = mux(padded(raw))
        payload, line = features(media)
        return [(key, len(raw or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), line)]

    return _map(docs, id_col, text_col, make, schema, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
