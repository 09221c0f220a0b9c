import hashlib
import random
import zlib

from tessera.llm.mpeg_audio import crc16, crc16_bits, header, inspect, load, probe, store, store_texts, text_digests


def test_round_trip_of_any_bytes():
    rng = random.Random(1)
    for n in (0, 1, 64, 72, 73, 936, 937, 938, 5000, 100_000):
        for payload in (bytes(n), b"\xff\xfa\xe4\xc0" * (n // 4), rng.randbytes(n)):
            back, stream = load(store(payload))
            assert back == payload
            assert stream.crc_bad == 0 and stream.skipped == 0
            assert stream.table["frames"] == len(stream.offsets) and stream.samples == 1152 * len(stream.offsets)
            assert stream.table["bytes"] == 192 + sum(stream.lengths)


def test_payload_like_a_trailing_tag():
    title = b"TAG" + b"title".ljust(125, b"\0")
    for n in (64, 128, 192, 256, 896, 960, 1024, 1088, 1920):
        for at in range(n - 2):
            payload = (b"x" * at + b"TAG").ljust(n, b"x")
            media = store(payload)
            back, stream = load(media)
            assert back == payload and stream.skipped == 0 and "TIT2" not in stream.tags, (n, at)
            tagged = load(media + title)
            assert tagged[0] == payload and tagged[1].skipped == 0 and tagged[1].tags["TIT2"] == "title", (n, at)


def test_damage_is_seen_and_skipped():
    media = bytearray(store(bytes(range(256)) * 20))
    clean = probe(bytes(media))
    third = clean.offsets[2]
    media[third + 8] ^= 1
    assert (probe(bytes(media)).crc_bad, probe(bytes(media)).crc_good) == (1, clean.crc_good - 1)
    cut = bytes(media[:third]) + b"\xff\xfa junk" * 3 + bytes(media[third:])
    again = probe(cut + b"TAG" + b"title".ljust(125, b"\0"))
    assert again.skipped == 21 and len(again.offsets) == len(clean.offsets) and again.tags["TIT2"] == "title"
    assert again.seek(3 * 1152) == clean.offsets[3] + 21 and clean.seek(0) == clean.offsets[0] and clean.seek(10**9) is None
    assert probe(b"").offsets == [] and probe(b"no audio here").skipped == 13


def test_columns(spark):
    rows = [(1, "a" * 3000, "m"), (2, None, "m"), (3, "", "m"), (3, "", "m"), (4, "é" * 40000, "m"), (None, "x", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    direct = text_digests(docs)
    got = direct.collect()
    for (i, text, _), r in zip(rows, got, strict=True):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    stored = inspect(store_texts(docs))
    assert [r.media_sha256 for r in stored.collect()] == [r.media_sha256 for r in got]
    assert text_digests(docs.limit(0)).collect() == []


def test_a_tag_at_every_offset_and_random_payloads():
    rng = random.Random(2)
    for n in range(64, 2049, 64):
        for at in range(0, n - 2, 1 if n <= 512 else 7):
            payload = bytes(at) + b"TAG" + bytes(n - at - 3)
            assert load(store(payload))[0] == payload, (n, at)
    for _ in range(5000):
        payload = bytearray(rng.randbytes(64 * rng.randrange(1, 33)))
        if rng.random() < 0.7:
            at = rng.randrange(len(payload) - 2)
            payload[at : at + 3] = b"TAG"
        assert load(store(bytes(payload)))[0] == bytes(payload)


def frames(start, length, count, covered, rng):
    """Frames of one header whose checksum covers ``covered`` bits behind it, and the last one's checksum broken."""
    out = b""
    for k in range(count):
        body = bytes(32) + rng.randbytes(length - 6 - 32)
        crc = crc16_bits(start[2:4] + body, 16 + covered) ^ (k == count - 1)
        out += start + crc.to_bytes(2, "big") + body
    return out


def test_checksums_of_layers_one_and_two():
    rng = random.Random(4)
    assert crc16_bits(b"abcdef", 48) == crc16(b"abcdef")
    # Layer II, 48 kHz, 192 kbit/s: stereo allocates 27 subbands; joint stereo shares those from the fourth on.
    high = 11 * 4 + 12 * 3 + 4 * 2
    for four, covered in ((b"\xff\xfc\xa4\x00", 2 * high), (b"\xff\xfc\xa4\x40", 2 * 16 + high - 16), (b"\xff\xfc\xa4\xc0", high), (b"\xff\xfe\x84\x00", 256), (b"\xff\xfe\x84\xc0", 128), (b"\xff\xfe\x84\x50", 4 * 40)):
        stream = probe(frames(four, header(four).length, 5, covered, rng))
        assert (len(stream.offsets), stream.crc_good, stream.crc_bad) == (5, 4, 1), four


def test_free_format_and_seeking_by_table():
    four = b"\xff\xfb\x00\xc4"
    stream = probe((four + bytes(96)) * 20)
    assert len(stream.offsets) == 20 and set(stream.lengths[:-1]) == {100} and stream.skipped == 0
    media = store(bytes(range(256)) * 2000)
    clean = probe(media)
    for sample in range(0, clean.samples, 1000):
        assert abs(clean.seek_by_table(sample) - clean.seek(sample)) < len(media) / 50
