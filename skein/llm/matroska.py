"""Matroska as a media column: a muxer for 8-bit samples, and a parser that turns files into packet tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, slices

# Fixed values of the format: element ids.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Lacing, in bits 1 and 2 of a block's flags.
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
TOP_LEVEL = {SEGMENT, INFO, TRACKS, CLUSTER, CUES}

#: A packet has so many samples; at 48 kHz it lasts 12 ms, in the default scale of 1 ms a tick.
PACKET, RATE, PACKET_MS = 576, 48_000, 12
#: Packets in a block, blocks in a cluster.
LACED, BLOCKS = 8, 32


def vint(value: int, width: int = 0) -> bytes:
    """A length as a variable-length integer; of all ones, which mean an unknown length, none is made."""
    while not width or value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(packets: list[bytes], lacing: int) -> bytes:
    """What follows a block's flags."""
    if lacing == NO_LACING:
        return packets[0]
    head, sizes = bytes([len(packets) - 1]), [len(x) for x in packets]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and sizes[1:]:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(packets)


def block(packets: list[bytes], track: int, ticks: int, lacing: int) -> bytes:
    return vint(track) + ticks.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1]) + lace(packets, lacing)


def mux(payload: bytes) -> bytes:
    """One track of 8-bit samples. Lacing goes around all four kinds, so that each kind is stored and read."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    header = element(EBML, element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(RATE, ">f8").tobytes()) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    track = b"".join([unsigned(TRACK_NUMBER, 1), unsigned(TRACK_UID, 1), unsigned(TRACK_TYPE, 2), unsigned(FLAG_LACING, 1), unsigned(DEFAULT_DURATION, PACKET_MS * 10**6), element(CODEC_ID, b"A_PCM/INT/LIT"), audio])
    body = [element(INFO, unsigned(TIMESTAMP_SCALE, 10**6) + element(MUXING_APP, b"skein") + element(WRITING_APP, b"skein")), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues, k, number = sum(map(len, body)), [], 0, 0
    while k < len(packets):
        begun, blocks = k * PACKET_MS, []
        while k < len(packets) and len(blocks) < BLOCKS:
            lacing = number % 4
            laced = packets[k : k + (1 if lacing == NO_LACING else LACED)]
            blocks.append(element(SIMPLE_BLOCK, block(laced, 1, k * PACKET_MS - begun, lacing)))
            k, number = k + len(laced), number + 1
        cluster = element(CLUSTER, unsigned(TIMESTAMP, begun) + b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, begun) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return header + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


@dataclass
class Movie:
    """What a file holds. packets: (track, timestamp in ticks, offset, size, cluster, lacing); cues: (time, track, offset of the cluster)."""

    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


class Damaged(ValueError):
    """The bytes are no Matroska file."""


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """(value, width, next place); an unknown length is -1."""
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"a variable-length integer is cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, width, at + width


def children(data: bytes, at: int, end: int, parent: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place of the element, start and end of its content). One of unknown length goes on to the next that can't be inside it."""
    while at < end:
        kind, _, start = read_vint(data, at, end, keep_marker=True)
        size, _, start = read_vint(data, start, end)
        if size < 0:
            stop = end
            if kind == CLUSTER:
                stop = next((place for inner, place, _, _ in children(data, start, end, kind) if inner in TOP_LEVEL), end)
        else:
            stop = start + size
        if stop > end:
            raise Damaged(f"element {kind:x} at {at} goes beyond its parent {parent:x}")
        yield kind, at, start, stop
        at = stop


def laces(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of each packet of a block whose flags end at `at`."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise Damaged(f"no packet count at {at}")
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == FIXED:
        if (end - at) % count:
            raise Damaged(f"{end - at} bytes don't make {count} equal packets")
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if lacing == XIPH:
                size = 0
                while at < end and data[at] == 255:
                    size, at = size + 255, at + 1
                if at >= end:
                    raise Damaged("a lace is cut off")
                size, at = size + data[at], at + 1
            else:
                value, width, at = read_vint(data, at, end)
                size = value if not k else sizes[-1] + value - (1 << 7 * width - 1) + 1
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise Damaged("laces are larger than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Movie:
    """Reads any nesting of known and unknown elements, unknown lengths, blocks in groups or alone, and all kinds of lacing."""
    movie = Movie()
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    seen = False
    for kind, _, start, stop in children(data, 0, len(data), 0):
        if not seen and kind != EBML:
            raise Damaged("no EBML header")
        seen = True
        if kind != SEGMENT:
            continue
        for part, place, a, b in children(data, start, stop, kind):
            if part == INFO:
                movie.scale = next((number(x, y) for k, _, x, y in children(data, a, b, part) if k == TIMESTAMP_SCALE), movie.scale)
            elif part == TRACKS:
                for k, _, x, y in children(data, a, b, part):
                    if k == TRACK_ENTRY:
                        inner = {c: (u, v) for c, _, u, v in children(data, x, y, k)}
                        if TRACK_NUMBER in inner:
                            codec = data[slice(*inner[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in inner else ""
                            movie.tracks[number(*inner[TRACK_NUMBER])] = {"codec": codec, "ns": number(*inner[DEFAULT_DURATION]) if DEFAULT_DURATION in inner else 0}
            elif part == CLUSTER:
                begun, index = 0, len(movie.clusters)
                for k, _, x, y in children(data, a, b, part):
                    if k == TIMESTAMP:
                        begun = number(x, y)
                    elif k == SIMPLE_BLOCK:
                        _packets(data, x, y, begun, index, movie)
                    elif k == BLOCK_GROUP:
                        for c, _, u, v in children(data, x, y, k):
                            if c == BLOCK:
                                _packets(data, u, v, begun, index, movie)
                movie.clusters.append((place, begun))
            elif part == CUES:
                for k, at, x, y in children(data, a, b, part):
                    if k == CUE_POINT:
                        movie.cues += _cues(data, at, x, y, start)
    if not seen:
        raise Damaged("no EBML header")
    return movie


def _cues(data: bytes, place: int, at: int, end: int, segment: int) -> list[tuple[int, int, int]]:
    """(time, track, place of the cluster) for every track position of a cue point; checksums and padding are passed over."""
    inner = [(c, u, v) for c, _, u, v in children(data, at, end, CUE_POINT)]
    times = [int.from_bytes(data[u:v], "big") for c, u, v in inner if c == CUE_TIME]
    spots = [{c: int.from_bytes(data[x:y], "big") for c, _, x, y in children(data, u, v, kind)} for kind, u, v in inner if kind == CUE_TRACK_POSITIONS]
    if not times or not spots or any(CUE_TRACK not in x or CUE_CLUSTER_POSITION not in x for x in spots):
        raise Damaged(f"a cue point at {place} lacks its time, track or position")
    return [(times[0], x[CUE_TRACK], segment + x[CUE_CLUSTER_POSITION]) for x in spots]


def _packets(data: bytes, at: int, end: int, begun: int, cluster: int, movie: Movie) -> None:
    track, _, at = read_vint(data, at, end)
    if at + 3 > end:
        raise Damaged("a block is cut off")
    ticks, lacing = begun + int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2] >> 1 & 3
    step = movie.tracks.get(track, {}).get("ns", 0) // movie.scale
    movie.packets += [(track, ticks + k * step, offset, size, cluster, lacing) for k, (offset, size) in enumerate(laces(data, at + 3, end, lacing))]


PACKETS = "packet long, track long, timestamp_ms double, offset long, size long, cluster long, lacing long, cued boolean"


def packets(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """The packet table of a column of files: `key`, `error`, then a row's PACKETS columns.

    A null file gives no row. One that is damaged gives a row with its `error` and nulls. Cued packets are in clusters to
    which a cue points. Rows are built file by file, so memory is bounded by the largest file.
    """
    kind = media.schema[key].dataType.simpleString()
    names = [key, "error", *[x.split()[0] for x in PACKETS.split(", ")]]
    types = [None, pa.string(), *[pa.int64()] * 2, pa.float64(), *[pa.int64()] * 4, pa.bool_()]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            for k, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    movie = parse(data)
                    cued = {x[2] for x in movie.cues}
                    rows = [(None, n, track, ticks * movie.scale / 1e6, offset, size, cluster, lacing, movie.clusters[cluster][0] in cued) for n, (track, ticks, offset, size, cluster, lacing) in enumerate(movie.packets)]
                except Damaged as e:
                    rows = [(str(e), *[None] * 8)]
                ids = pa.array([batch.column(0)[k].as_py()] * len(rows), batch.schema.field(0).type)
                values = zip(*rows, strict=True) if rows else [[] for _ in types[1:]]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(v), t) for v, t in zip(values, types[1:], strict=True)]], names=names)

    return media.select(key, column).mapInArrow(work, f"`{key}` {kind}, error string, {PACKETS}")


def pad(data: bytes, unit: int = PACKET) -> bytes:
    """`data` and bytes 255 up to a positive multiple of `unit`."""
    return data + b"\xff" * (-len(data) % unit if data else unit)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every text: its padded UTF-8 bytes as samples. A null text counts as empty."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def feature(movie: Movie, samples: bytes) -> str:
    """Packets, clusters, cues, milliseconds, a histogram of 16 levels and the mean step between samples in thousandths."""
    values = np.frombuffer(samples, np.uint8)
    steps = int(np.abs(np.diff(values.astype(np.int16))).sum()) * 1000 // max(1, len(values) - 1)
    levels = ",".join(map(str, np.bincount(values >> 4, minlength=16).tolist()))
    last = max((x[1] for x in movie.packets), default=0)
    return f"packets={len(movie.packets)};clusters={len(movie.clusters)};cues={len(movie.cues)};ms={last};levels={levels};step={steps}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """Reads the samples of each stored file back by the byte ranges of its packet table, in the order of their timestamps."""
    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in FEATURES.split(", ")]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for doc, n, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                movie = parse(data)
                samples = b"".join([data[offset : offset + size] for _, _, offset, size, _, _ in sorted(movie.packets, key=lambda x: (x[1], x[2]))])
                rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(movie, samples)))
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(work, FEATURES)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every text as a Matroska file in a scratch table, reads the stored bytes back, and describes them.

    A null text counts as empty, null ids stay null, repeated rows are files of their own with equal values; other columns
    are ignored, whatever their names. An empty table gives none. A worker holds one slice of texts, or one long text, at a time.
    """
    return features(scratch(store(docs), "media"))
