import hashlib
import random
import zlib

import pytest

from skein.llm import matroska as m


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 300_000])
def test_round_trip(n):
    payload = m.pad(random.Random(n).randbytes(n))
    movie = m.parse(m.mux(payload))
    data = m.mux(payload)
    assert len(payload) % 576 == 0 and payload
    assert b"".join(data[o : o + s] for _, _, o, s, _, _ in movie.packets) == payload
    assert [t for _, t, *_ in movie.packets] == [12 * k for k in range(len(movie.packets))]
    assert [c[2] for c in movie.cues] == [place for place, _ in movie.clusters] and [c[0] for c in movie.cues] == [t for _, t in movie.clusters]
    assert movie.tracks[1]["codec"] == "A_PCM/INT/LIT"


@pytest.mark.parametrize("lacing", [m.XIPH, m.EBML_LACING])
def test_laces_of_any_sizes(lacing):
    draw = random.Random(1)
    for _ in range(50):
        packets = [draw.randbytes(draw.choice([0, 1, 5, 254, 255, 256, 510, 9000])) for _ in range(draw.randint(1, 20))]
        body = m.lace(packets, lacing)
        assert [body[o : o + s] for o, s in m.laces(body, 0, len(body), lacing)] == packets


def test_unknown_lengths_groups_and_strangers():
    unknown = b"\x01" + b"\xff" * 7
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block([b"xyz", b"abc"], 2, 5, m.FIXED)) + m.unsigned(0x9B, 7))
    cluster = lambda t, x: m.CLUSTER.to_bytes(4, "big") + unknown + m.unsigned(m.TIMESTAMP, t) + m.element(0xEC, b"\0" * 9) + x
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + unknown + m.element(m.INFO, m.unsigned(m.TIMESTAMP_SCALE, 500_000)) + cluster(100, group) + cluster(200, m.element(m.SIMPLE_BLOCK, m.block([b"q"], 3, -4, 0)))
    movie = m.parse(data)
    assert [(track, t, data[o : o + s], c) for track, t, o, s, c, _ in movie.packets] == [(2, 105, b"xyz", 0), (2, 105, b"abc", 0), (3, 196, b"q", 1)]
    assert movie.scale == 500_000


def test_cues_with_checksums_padding_and_several_tracks():
    crc, void = m.element(0xBF, b"\1\2\3\4"), m.element(0xEC, b"\0" * 11)
    position = lambda track, at, *more: m.element(m.CUE_TRACK_POSITIONS, b"".join([crc, m.unsigned(m.CUE_TRACK, track), m.unsigned(m.CUE_CLUSTER_POSITION, at), *more]))
    point = lambda time, *spots: m.element(m.CUE_POINT, b"".join([crc, m.unsigned(m.CUE_TIME, time), void, *spots]))
    cluster = m.element(m.CLUSTER, crc + m.unsigned(m.TIMESTAMP, 0) + void + m.element(m.SIMPLE_BLOCK, m.block([b"ab"], 1, 0, 0)))
    body = lambda cues: m.element(m.EBML, b"") + m.element(m.SEGMENT, void + cluster + m.element(m.CUES, cues) + void)
    movie = m.parse(body(crc + point(0, position(1, 13), position(2, 20, m.unsigned(0xF0, 5))) + void + point(7, position(1, 30))))
    at = movie.clusters[0][0] - 13
    assert movie.cues == [(0, 1, at + 13), (0, 2, at + 20), (7, 1, at + 30)] and len(movie.packets) == 1
    for broken in (m.element(m.CUE_POINT, m.unsigned(m.CUE_TIME, 1)), m.element(m.CUE_POINT, position(1, 2)), m.element(m.CUE_POINT, m.unsigned(m.CUE_TIME, 1) + m.element(m.CUE_TRACK_POSITIONS, m.unsigned(m.CUE_TRACK, 1)))):
        with pytest.raises(m.Damaged):
            m.parse(body(broken))


def test_any_bytes_are_read_or_reported():
    draw = random.Random(12)
    whole = bytearray(m.mux(draw.randbytes(4 * 576)))
    for _ in range(400):
        broken = bytearray(whole)
        for _ in range(draw.choice([1, 2, 8])):
            broken[draw.randrange(len(broken) if draw.random() < 0.5 else 160)] = draw.randrange(256)
        try:
            m.parse(bytes(broken))
        except m.Damaged:
            pass


def plain_feature(payload):
    """Of a file that mux() makes, by loops."""
    packets = [payload[k : k + 576] for k in range(0, len(payload), 576)]
    clusters, left, number = 0, len(packets), 0
    while left > 0:
        clusters += 1
        for _ in range(32):
            if left > 0:
                left -= min(left, 1 if number % 4 == 0 else 8)
                number += 1
    levels = [sum(x // 16 == k for x in payload) for k in range(16)]
    steps = sum(abs(a - b) for a, b in zip(payload[1:], payload, strict=False)) * 1000 // max(1, len(payload) - 1)
    return f"packets={len(packets)};clusters={clusters};cues={clusters};ms={12 * (len(packets) - 1)};levels={','.join(map(str, levels))};step={steps}"


def test_damage_is_reported(spark):
    whole = m.mux(b"a" * 5760)
    for broken in (b"", b"no", whole[:-3], whole[4:], b"\0" * 40):
        with pytest.raises(m.Damaged):
            m.parse(broken)
    media = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(b"junk")), (3, None)], "doc_id long, media binary")
    found = m.packets(media).collect()
    assert {r.doc_id for r in found} == {1, 2}
    assert [r.error for r in found if r.doc_id == 2] != [None] and sum(r.doc_id == 1 for r in found) == 10
    assert all(r.cued for r in found if r.doc_id == 1)


def test_query_rows(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 90_000), (1, "abc"), (None, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS media", "text AS n_bytes")
    found = m.media_features(docs).collect()
    assert len(found) == len(rows)
    by_sha = {}
    texts = {1: "abc", 2: "", 3: "", 4: "é" * 90_000, None: "abc"}
    for r in found:
        payload = m.pad(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(m.mux(payload)), hashlib.sha256(m.mux(payload)).hexdigest())
        assert r.feature == plain_feature(payload)
        assert by_sha.setdefault(r.payload_sha256, r[5:]) == r[5:]
    assert m.media_features(docs.limit(0)).count() == 0
