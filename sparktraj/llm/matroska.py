"""Media columns: Matroska files as packet tables.

``demux`` parses EBML elements of variable length, tracks, clusters, blocks with any lacing, and cues; ``packet_table`` makes of
a column of files one row per packet with timestamp, track and byte range.  ``mux`` stores 8-bit samples losslessly as a PCM
track: clusters of blocks that hold up to eight frames each, laced, and a cue for each cluster.

Defined results: a null or empty file, or one that isn't EBML, has no packets; a file that breaks off gives the packets before
that place and ``whole`` false; an empty table gives an empty result; only the named columns are read; repeated rows are handled
one by one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktraj.llm.common import arrow_map, docs_of, id_type, read, slices

# Element ids of the Matroska specification.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

_NESTED = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Where an element of unknown size ends: before one of these.
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML}
LACINGS = ("none", "xiph", "fixed", "ebml")

RATE = 8000
FRAME = 512
FRAMES = 8
CLUSTER_BYTES = 32 * FRAMES * FRAME


@dataclass
class Parsed:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (cluster, block, frame, track, timestamp in ns, keyframe, lacing, start, length)
    packets: list[tuple] = field(default_factory=list)
    #: (time in ns, track, place of the cluster in the file)
    cues: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    whole: bool = True


def vint(data: bytes, at: int, marked: bool) -> tuple[int | None, int]:
    """A variable-length integer and the place after it; ``marked`` keeps the length marker, as in ids.  None: all ones, an unknown size."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise IndexError
    value = int.from_bytes(data[at : at + n], "big")
    if not marked:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            return None, at + n
    return value, at + n


def _laced(data: bytes, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """Place of the first frame's bytes and the frames' sizes."""
    if kind == 0:
        return at, [end - at]
    count, at = data[at] + 1, at + 1
    if kind == 2:
        return at, [(end - at) // count] * count
    sizes: list[int] = []
    for k in range(count - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            value, at = vint(data, at, False)
            size = value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise IndexError
    return at, sizes


def demux(data: bytes) -> Parsed:
    out = Parsed()
    open_: list[tuple[int, int | None]] = []  # (id, end) of the elements around
    at, segment, time, block, first, duration = 0, 0, 0, 0, 0, {}
    track: dict = {}
    cue: dict = {}
    try:
        if not data or vint(data, 0, True)[0] != EBML:
            return out
        while at < len(data):
            while open_ and open_[-1][1] is not None and at >= open_[-1][1]:
                open_.pop()
            begun = at
            kind, at = vint(data, at, True)
            size, at = vint(data, at, False)
            while open_ and open_[-1][1] is None and kind in _TOP and (open_[-1][0] == kind or open_[-1][0] != SEGMENT):
                open_.pop()
            end = None if size is None else at + size
            if kind in _NESTED:
                open_.append((kind, end))
                if kind == SEGMENT:
                    segment = at
                elif kind == CLUSTER:
                    out.clusters.append(begun)
                    block = 0
                elif kind == TRACK_ENTRY:
                    track = {}
                continue
            if end is None or end > len(data):
                raise IndexError
            number = int.from_bytes(data[at:end], "big") if size <= 8 else 0
            if kind == TIMESTAMP_SCALE:
                out.scale = number
            elif kind == TRACK_NUMBER:
                out.tracks[number] = track
            elif kind == TRACK_TYPE:
                track["type"] = number
            elif kind == CODEC_ID:
                track["codec"] = data[at:end].decode("ascii", "replace")
            elif kind == DEFAULT_DURATION:
                track["frame_ns"] = number
            elif kind == SAMPLING_FREQUENCY:
                track["rate"] = struct.unpack(">d" if size == 8 else ">f", data[at:end])[0]
            elif kind == CHANNELS:
                track["channels"] = number
            elif kind == BIT_DEPTH:
                track["bits"] = number
            elif kind == TIMESTAMP:
                time = number
            elif kind in (SIMPLE_BLOCK, BLOCK):
                of, p = vint(data, at, False)
                (shift,), flags = struct.unpack_from(">h", data, p), data[p + 2]
                lacing = flags >> 1 & 3
                p, sizes = _laced(data, p + 3, end, lacing)
                first = len(out.packets)
                stamp, each = (time + shift) * out.scale, out.tracks.get(of, {}).get("frame_ns", 0)
                for k, n in enumerate(sizes):
                    out.packets.append((len(out.clusters) - 1, block, k, of, stamp + k * each, kind == BLOCK or bool(flags & 128), LACINGS[lacing], p, n))
                    p += n
                block += 1
            elif kind == REFERENCE_BLOCK:  # its block isn't a keyframe
                out.packets[first:] = [(*x[:5], False, *x[6:]) for x in out.packets[first:]]
            elif kind == CUE_TIME:
                cue = {"time": number}
            elif kind == CUE_TRACK:
                cue["track"] = number
            elif kind == CUE_CLUSTER_POSITION:
                out.cues.append((cue.get("time", 0) * out.scale, cue.get("track", 0), segment + number))
            at = end
        out.whole = all(e is None or e <= len(data) for _, e in open_)
    except (IndexError, struct.error):
        out.whole = False
    return out


def _size(n: int) -> bytes:
    width = max(1, -(-(n + 1).bit_length() // 7))
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes | int | str | float) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, -(-body.bit_length() // 8)), "big")
    elif isinstance(body, str):
        body = body.encode()
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + _size(len(body)) + body


def _block(payload: bytes, shift: int) -> bytes:
    """A block of frames of ``FRAME`` bytes, the last one maybe shorter: fixed lacing if all are alike, else EBML lacing."""
    count, rest = divmod(len(payload), FRAME)
    frames = count + bool(rest)
    head = b"\x81" + struct.pack(">h", shift)
    if frames == 1:
        return _element(SIMPLE_BLOCK, head + b"\x80" + payload)
    if not rest:
        return _element(SIMPLE_BLOCK, head + b"\x84" + bytes([frames - 1]) + payload)
    same = _size(FRAME) + (0x80 | 63).to_bytes(1, "big") * (frames - 2)  # a difference of 0 is 63 in one byte
    return _element(SIMPLE_BLOCK, head + b"\x86" + bytes([frames - 1]) + same + payload)


def mux(payload: bytes) -> bytes:
    """A Matroska file with ``payload``, whose length is a multiple of 8, as 8-bit samples of one channel at 8000 a second."""
    header = _element(EBML, _element(DOC_TYPE, "matroska"))
    info = _element(INFO, _element(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, "sparktraj") + _element(WRITING_APP, "sparktraj"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, float(RATE)) + _element(CHANNELS, 1) + _element(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, _element(TRACK_NUMBER, 1) + _element(TRACK_UID, 1) + _element(TRACK_TYPE, 2) + _element(CODEC_ID, "A_PCM/INT/LIT") + _element(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + audio))
    body, cues = [info, tracks], []
    place = len(info) + len(tracks)
    for at in range(0, len(payload), CLUSTER_BYTES):
        part, time = payload[at : at + CLUSTER_BYTES], at * 1000 // RATE
        blocks = [_block(part[k : k + FRAMES * FRAME], k * 1000 // RATE) for k in range(0, len(part), FRAMES * FRAME)]
        body.append(_element(CLUSTER, _element(TIMESTAMP, time) + b"".join(blocks)))
        cues.append(_element(CUE_POINT, _element(CUE_TIME, time) + _element(CUE_TRACK_POSITIONS, _element(CUE_TRACK, 1) + _element(CUE_CLUSTER_POSITION, place))))
        place += len(body[-1])
    return header + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


def packet_table(files: DataFrame, id_col: str = "doc_id", content_col: str = "media") -> DataFrame:
    """One row per packet of each file: doc_id, cluster, block, frame, track, timestamp_ns, keyframe, lacing, start, length, cued, whole.

    ``cued``: the packet is the first one of a cluster that a cue of its track points to.
    """
    names = ["doc_id", "cluster", "block", "frame", "track", "timestamp_ns", "keyframe", "lacing", "start", "length", "cued", "whole"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                got = demux(b.column("media")[k].as_py() or b"")
                cued = {(track, at) for _, track, at in got.cues}
                for n in range(0, len(got.packets), 10_000):
                    part = got.packets[n : n + 10_000]
                    cols = [pa.array(x, t) for x, t in zip(zip(*part), kinds)]
                    first = [x[1] == x[2] == 0 and (x[3], got.clusters[x[0]]) in cued for x in part]
                    yield pa.record_batch([b.column("doc_id").take(pa.array([k] * len(part))), *cols, pa.array(first), pa.array([got.whole] * len(part))], names=names)

    schema = f"doc_id {id_type(files, id_col)}, cluster int, block int, frame int, track long, timestamp_ns long, keyframe boolean, lacing string, start long, length long, cued boolean, whole boolean"
    return arrow_map(files.select(F.col(id_col).alias("doc_id"), F.col(content_col).alias("media")), run, schema)


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or 64 * (not raw))


def feature(got: Parsed, samples: np.ndarray) -> str:
    """Counts of clusters, blocks, packets and cues, the length in ms, and mean, deviation and sign changes of the samples about 128."""
    x = samples.astype(np.int64) - 128
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    blocks = len({p[:2] for p in got.packets})
    return f"clusters={len(got.clusters)};blocks={blocks};packets={len(got.packets)};cues={len(got.cues)};ms={len(x) * 1000 // RATE};mean={x.mean():.6f};std={x.std():.6f};turns={turns}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text as a Matroska file and reads it back through its packets; with ``keep_media`` also the file itself."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text in b.column("text"):
                raw = text.as_buffer().to_pybytes()
                media = mux(padded(raw))
                got = demux(media)
                payload = b"".join([media[p[7] : p[7] + p[8]] for p in got.packets])
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(got, np.frombuffer(payload, np.uint8)), media)[: 7 + keep_media])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], names=names)

    schema = f"doc_id {id_type(docs, id_col)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(docs_of(docs, id_col, text_col), run, schema + ", media binary" * keep_media)


def op3_matroska(spark, sf_dir):
    return media_columns(read(spark, sf_dir, "documents"))


QUERIES = {"op3_matroska": op3_matroska}
ORACLES = {}
