"""Media columns in Matroska: writing byte payloads as packets, and parsing files into packet tables.

A file is a tree of EBML elements: an id and a size, both of variable length, then the data. Clusters hold a
timestamp and blocks; a block holds one packet or a lace of several; cues point at clusters. The parser walks all of
them, unknown sizes included, and gives every packet's track, timestamp and byte range.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B
SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, TIMESTAMP, SCALE = 0xA3, 0xA0, 0xA1, 0xE7, 0x2AD7B1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_NUMBER, TRACK_TYPE, CODEC, RATE, CHANNELS, DEPTH = 0xD7, 0x83, 0x86, 0xB5, 0x9F, 0x6264
#: Elements of a segment: a cluster of unknown size ends where the next one of these begins.
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

#: 8-bit mono samples: a packet of 512 at 64 kHz lasts 8 ms; 64 packets a lace, 64 laces a cluster.
SAMPLES, LACE, BLOCKS, RATE_HZ = 512, 64, 64, 64000
PACKET_MS = SAMPLES * 1000 // RATE_HZ
SPAN = 1 << 16


class Packet(NamedTuple):
    track: int
    timestamp: int
    start: int
    length: int
    lace: int
    keyframe: bool


# ---- writing


def size(n: int, width: int = 0) -> bytes:
    """A size of variable length; width 0: the shortest."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def number(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def element(kind: int, data: bytes) -> bytes:
    return number(kind) + size(len(data)) + data


def lace_header(lengths: list[int]) -> tuple[int, bytes]:
    """The lacing flag and the sizes before a block's packets: fixed for equal packets, else differences (EBML)."""
    if len(lengths) == 1:
        return NO_LACE, b""
    if len(set(lengths)) == 1:
        return FIXED, bytes([len(lengths) - 1])
    out = [bytes([len(lengths) - 1]), size(lengths[0])]
    for before, now in zip(lengths[:-2], lengths[1:-1]):
        change = now - before
        width = next(w for w in range(1, 9) if abs(change) < (1 << 7 * w - 1))
        out.append(size(change + (1 << 7 * width - 1) - 1, width))
    return EBML_LACE, b"".join(out)


def write(payload: bytes) -> bytes:
    """A Matroska file with one track of 8-bit samples that holds the payload."""
    info = element(INFO, element(SCALE, number(1_000_000)) + element(0x4D80, b"calspar") + element(0x5741, b"calspar"))
    audio = element(RATE, np.array([RATE_HZ], ">f8").tobytes()) + element(CHANNELS, b"\1") + element(DEPTH, b"\x08")
    track = element(TRACK_NUMBER, b"\1") + element(0x73C5, b"\1") + element(TRACK_TYPE, b"\2") + element(0x9C, b"\1") + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    head = info + element(TRACKS, element(TRACK, track))
    parts, at, cues, time = [head], len(head), [], 0
    step = SAMPLES * LACE * BLOCKS
    for begin in range(0, len(payload), step):
        blocks, offset = [], 0
        for a in range(begin, min(begin + step, len(payload)), SAMPLES * LACE):
            data = payload[a : min(a + SAMPLES * LACE, begin + step)]
            whole, rest = divmod(len(data), SAMPLES)
            flag, lace = lace_header([SAMPLES] * whole + [rest] * bool(rest))
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + offset.to_bytes(2, "big", signed=True) + bytes([0x80 | flag << 1]) + lace + data))
            offset += LACE * PACKET_MS
        cluster = element(CLUSTER, element(TIMESTAMP, number(time)) + b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, number(time)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\1") + element(CUE_CLUSTER, number(at)))))
        parts.append(cluster)
        at += len(cluster)
        time += offset
    if cues:
        parts.append(element(CUES, b"".join(cues)))
    header = element(EBML, element(0x4286, b"\1") + element(0x42F7, b"\1") + element(0x42F2, b"\4") + element(0x42F3, b"\x08") + element(0x4282, b"matroska") + element(0x4287, b"\4") + element(0x4285, b"\2"))
    return header + element(SEGMENT, b"".join(parts))


# ---- parsing


def read_id(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    width = 9 - first.bit_length()
    if width > 4:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int, int]:
    """The number, where it ends and its width; None if all its bits are 1 (an unknown size)."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no size at byte {at}")
    n = int.from_bytes(data[at : at + width], "big") ^ (1 << 7 * width)
    return (None if n == (1 << 7 * width) - 1 else n), at + width, width


def children(data: bytes, at: int, end: int, stop: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, where the element begins, where its data begins, where it ends) of each element in a range; ends early before an id in stop."""
    while at < end:
        kind, after = read_id(data, at)
        if kind in stop:
            return
        n, begin, _ = read_size(data, after)
        if n is None:
            if kind not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {kind:#x} can't have an unknown size")
            close = end if kind == SEGMENT else max([x[3] for x in children(data, begin, end, TOP)], default=begin)
        else:
            close = begin + n
        if close > end:
            raise ValueError(f"element at byte {at} ends after its parent")
        yield kind, at, begin, close
        at = close


def laced(data: bytes, at: int, end: int, flag: int) -> list[tuple[int, int]]:
    """(start, length) of a block's packets."""
    if flag == NO_LACE:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    if flag == FIXED:
        each, over = divmod(end - at, count)
        if over:
            raise ValueError("a fixed lace has a rest")
        lengths = [each] * count
    else:
        lengths = []
        for k in range(count - 1):
            if flag == XIPH:
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            else:
                n, at, width = read_size(data, at)
                if n is None:
                    raise ValueError("a lace has an unknown size")
                if k:
                    n += lengths[-1] - ((1 << 7 * width - 1) - 1)
            lengths.append(n)
        lengths.append(end - at - sum(lengths))
    if min(lengths) < 0:
        raise ValueError("a lace is longer than its block")
    out = []
    for n in lengths:
        out.append((at, n))
        at += n
    return out


def block(data: bytes, at: int, end: int, cluster_time: int, simple: bool) -> Iterator[Packet]:
    track, at, _ = read_size(data, at)
    offset, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    for k, (start, n) in enumerate(laced(data, at + 3, end, flags >> 1 & 3)):
        yield Packet(track, cluster_time + offset, start, n, k, simple and bool(flags & 0x80))


def parse(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]], int]:
    """Packets in order, cues as (time, track, byte of the cluster) and the number of clusters."""
    packets, cues, clusters = [], [], 0
    for kind, _, begin, end in children(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        for inner, _, a, b in children(data, begin, end):
            if inner == CLUSTER:
                clusters += 1
                time = 0
                for k, _, x, y in children(data, a, b):
                    if k == TIMESTAMP:
                        time = int.from_bytes(data[x:y], "big")
                    elif k == SIMPLE_BLOCK:
                        packets += block(data, x, y, time, True)
                    elif k == BLOCK_GROUP:
                        for g, _, p, q in children(data, x, y):
                            if g == BLOCK:
                                packets += block(data, p, q, time, False)
            elif inner == CUES:
                for k, _, x, y in children(data, a, b):
                    if k == CUE_POINT:
                        when, places = 0, []
                        for c, _, p, q in children(data, x, y):
                            if c == CUE_TIME:
                                when = int.from_bytes(data[p:q], "big")
                            elif c == CUE_POSITIONS:
                                own = {e: int.from_bytes(data[r:s], "big") for e, _, r, s in children(data, p, q)}
                                places.append((own.get(CUE_TRACK, 0), begin + own.get(CUE_CLUSTER, 0)))
                        cues += [(when, *p) for p in places]
    return packets, cues, clusters


# ---- operators


def as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a Matroska file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def work(doc_id, text):
        padded = text + bytes(-len(text) % 64 if text else 64)
        yield doc_id, len(text), write(padded)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(common.by_rows(work, schema), "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of each file: id, nth, track, timestamp, byte_start, byte_length, lace, keyframe. A null or empty file has no packets; a broken one raises."""
    schema = pa.schema([("id", pa.int64()), ("nth", pa.int64()), ("track", pa.int32()), ("timestamp", pa.int64()), ("byte_start", pa.int64()), ("byte_length", pa.int64()), ("lace", pa.int32()), ("keyframe", pa.bool_())])

    def work(key, data):
        for k, p in enumerate(parse(data)[0] if data else ()):
            yield key, k, p.track, p.timestamp, p.start, p.length, p.lace, p.keyframe

    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(common.by_rows(work, schema), "id long, nth long, track int, timestamp long, byte_start long, byte_length long, lace int, keyframe boolean")


def features(data: bytes) -> tuple[bytes, str]:
    """The payload as the file's packets give it back, and its features as text."""
    packets, cues, clusters = parse(data)
    view = memoryview(data)
    payload = b"".join([view[p.start : p.start + p.length] for p in packets])
    n, squares, crossings = len(payload), 0, 0
    samples = np.frombuffer(payload, np.uint8)
    for a in range(0, n, SPAN):  # spans, so that working memory doesn't follow the payload
        span = samples[a : a + SPAN].astype(np.int32) - 128
        squares += int(span @ span)
        crossings += int(np.count_nonzero((span[1:] < 0) != (span[:-1] < 0)))
    total = int(samples.sum(dtype=np.int64))
    last = packets[-1].timestamp if packets else 0
    return payload, f"packets={len(packets)};clusters={clusters};cues={len(cues)};last_block_ms={last};sum={total};mean={total // max(n, 1)};energy={squares // max(n, 1)};crossings={crossings}"


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text counts as empty (64 zero bytes); null ids and repeated rows stay; further columns are ignored.
    Equal texts have equal values: nothing but the text enters the file.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def work(doc_id, n, media):
        payload, feature = features(media)
        yield doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    return as_media(docs, id_col, text_col).mapInArrow(
        common.by_rows(work, schema),
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
