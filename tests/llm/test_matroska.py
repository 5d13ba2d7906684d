"""Matroska: exact round trips, all lacings and unknown sizes."""

import hashlib
import zlib

import pytest
from calspar.llm import matroska as m


@pytest.mark.parametrize("n", [64, 448, 512, 576, 512 * 64, 512 * 64 + 64, 512 * 64 * 64, 512 * 64 * 64 * 2 + 640])
def test_round_trip(n):
    payload = bytes(range(256)) * (n // 256 + 1)
    payload = payload[:n]
    data = m.write(payload)
    packets, cues, clusters = m.parse(data)
    assert b"".join(data[p.start : p.start + p.length] for p in packets) == payload
    assert len(packets) == -(-n // 512) and clusters == -(-n // (512 * 64 * 64)) == len(cues)
    assert all(data[at : at + 4] == m.number(m.CLUSTER) for _, _, at in cues)


def a_block(flag: int, sizes: bytes, data: bytes) -> bytes:
    return b"\x81\x00\x05" + bytes([flag << 1]) + sizes + data


def test_lacings_groups_and_unknown_sizes():
    one, two, three = b"a" * 300, b"b" * 7, b"c" * 40
    xiph = a_block(m.XIPH, bytes([2, 255, 45, 7]), one + two + three)
    flag, sizes = m.lace_header([300, 7, 40])
    assert flag == m.EBML_LACE
    ebml = a_block(flag, sizes, one + two + three)
    single = a_block(m.NO_LACE, b"", two)
    cluster = m.number(m.CLUSTER) + b"\x01" + b"\xff" * 7 + m.element(m.TIMESTAMP, m.number(1000)) + m.element(m.SIMPLE_BLOCK, xiph) + m.element(m.BLOCK_GROUP, m.element(0x9B, b"\x01") + m.element(m.BLOCK, ebml))
    later = m.element(m.CLUSTER, m.element(m.TIMESTAMP, m.number(2000)) + m.element(0xEC, b"void") + m.element(m.SIMPLE_BLOCK, single))
    data = m.element(m.EBML, b"") + m.number(m.SEGMENT) + b"\xff" + cluster + later
    packets, _, clusters = m.parse(data)
    assert clusters == 2
    assert [data[p.start : p.start + p.length] for p in packets] == [one, two, three, one, two, three, two]
    assert [p.timestamp for p in packets] == [1005] * 6 + [2005] and [p.lace for p in packets] == [0, 1, 2, 0, 1, 2, 0]


def test_broken_files_raise():
    data = m.write(b"x" * 64)
    with pytest.raises((ValueError, IndexError)):
        m.parse(data[:-10])
    with pytest.raises(ValueError):
        m.parse(b"\x00" * 10)


def test_operator_on_odd_rows(spark):
    texts = [None, "", "é" * 40, "x" * 5000, "x" * 5000]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in m.media_digest(docs).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        data = m.write(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert got[0][1:] == got[1][1:] and got[3][1:] == got[4][1:]
    assert m.media_digest(docs.limit(0)).count() == 0
    packets = m.packet_table(m.as_media(docs))
    assert packets.filter("id = 3").count() == 10 and packets.filter("id = 3").agg({"byte_length": "sum"}).first()[0] == 5056
