import hashlib
import io
import zlib

import numpy as np
import pytest
from skein.llm import media


def test_netpbm_and_bmp_round_trips():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (5, 3), (7, 64)):
        grey, colour = rng.integers(0, 256, (h, w), np.uint8), rng.integers(0, 256, (h, w, 3), np.uint8)
        for image, forms in ((grey, (media.to_pgm, media.to_bmp)), (colour, (media.to_ppm, media.to_bmp))):
            for form in forms:
                assert np.array_equal(media.decode(form(image)), image)


def test_plain_and_bitmap_forms():
    assert media.decode(b"P2\n# note\n2 2\n255\n0 1\n2 3\n").tolist() == [[0, 1], [2, 3]]
    assert media.decode(b"P3 1 1 255 9 8 7").tolist() == [[[9, 8, 7]]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    assert media.decode(b"P5\n1 2\n65535\n" + b"\x01\x00\x00\x02").tolist() == [[256], [2]]
    with pytest.raises(ValueError):
        media.decode(b"P9\n1 1\n")


def test_bottom_up_and_top_down_bmp():
    image = np.arange(6, dtype=np.uint8).reshape(3, 2)
    data = bytearray(media.to_bmp(image))
    data[22:26] = (-3 & 0xFFFFFFFF).to_bytes(4, "little")
    assert np.array_equal(media.decode(bytes(data)), image[::-1])


@pytest.mark.parametrize("shape", [(1, 64), (8, 9), (13, 64), (5000, 64)])
def test_area_resize_is_the_mean_of_areas(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, np.uint8)
    h, w = 4, 3
    got = media.area_resize(image, h, w)
    # Brute force: repeat each sample so that target areas are whole.
    if shape[0] * shape[1] < 2000:
        big = np.repeat(np.repeat(image.astype(float), h, 0), w, 1)
        want = big.reshape(h, shape[0], w, shape[1]).mean(axis=(1, 3))
        assert np.allclose(got, want)
    assert np.isclose(got.mean(), image.mean())


def test_query_digests(make_docs, odd_docs):
    rows = {(r.doc_id, r.n_bytes): r for r in media.media_features(odd_docs).collect()}
    for text, key in (("", 1), ("", 2), ("é\x00ü 🙂", 5), ("long words here. " * 40_000, 7)):
        raw = text.encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = rows[key, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.to_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[6, 4].feature == media.difference_hash(np.frombuffer(b"word".ljust(64, b"\0"), np.uint8).reshape(1, 64))
    assert media.media_features(make_docs([])).count() == 0


def test_tiles_are_npy_files(make_docs):
    row = media.read_back(media.store(make_docs([(1, "abc" * 99)]), fmt="bmp")).first()
    assert np.load(io.BytesIO(row.tile)).shape == (16, 16)


def naive_means(image, height, width):
    """Means of target areas, by adding each sample's overlap."""
    h, w = len(image), len(image[0])
    out = []
    for i in range(height):
        row = []
        for j in range(width):
            total = area = 0.0
            for y in range(int(i * h / height), min(h, int((i + 1) * h / height) + 1)):
                for x in range(int(j * w / width), min(w, int((j + 1) * w / width) + 1)):
                    part = max(0.0, min(y + 1, (i + 1) * h / height) - max(y, i * h / height)) * max(0.0, min(x + 1, (j + 1) * w / width) - max(x, j * w / width))
                    total, area = total + part * image[y][x], area + part
            row.append(total / area)
        out.append(row)
    return out


def test_features_and_tiles_by_hand(make_docs):
    """The difference hash and all tiles of texts, by plain loops."""
    texts = ["", "word", "The quick brown fox. " * 30, "x y z " * 2000]
    for r in media.read_back(media.store(make_docs(list(enumerate(texts))))).collect():
        raw = texts[r.row_key].encode()
        raw = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        image = [list(raw[i : i + 64]) for i in range(0, len(raw), 64)]
        small = [[round(x, 6) for x in row] for row in naive_means(image, 8, 9)]
        bits = "".join("1" if row[k + 1] > row[k] else "0" for row in small for k in range(8))
        assert r.feature == f"{int(bits, 2):016x}"
        want = naive_means(image, max(1, round(len(image) / 4)), 16)
        tiles = [np.load(io.BytesIO(x)) for x in r.tiles]
        assert [len(t) for t in tiles] == [len(want[i : i + 16]) for i in range(0, len(want), 16)]
        assert np.abs(np.concatenate(tiles).astype(float) - np.array(want)).max() <= 0.5 + 1e-6


def test_tiles_of_the_query(make_docs):
    rows = {r.doc_id: r for r in media.media_features(make_docs([(1, "a" * 64 * 200), (2, "a" * 64 * 200), (3, None)])).collect()}
    assert rows[1].n_tiles == 4 and rows[1].tiles_sha256 == rows[2].tiles_sha256 and rows[3].n_tiles == 1
