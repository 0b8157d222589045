import hashlib
import random
import zlib

import numpy as np
import pytest

from stemline.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 4096, 4097, 30_000])
def test_files_return_their_payload(n):
    p = random.Random(n).randbytes(n)
    f = media.write_avi(p)
    stored, size, clips = media.read_avi(f)
    assert stored == media.padded(p) and size == n and len(stored) % 64 == 0 and len(stored) >= 64
    assert clips[0]["first_frame"] == 0 and sum(c["n_frames"] for c in clips) == len(media.Avi(f).frames)


def test_packed_and_sequential_decoding_agree():
    frame = media.Avi(media.write_avi(bytes(range(256)) * 16)).frames[0]
    values, quant, width, height = media.decode_frame(frame)
    scan = frame[frame.index(b"\xff\xda") + 10 : -2]
    assert (media._sequential(scan, width * height // 64, {(1, 0): 8}, {(1, 0): 8}, 1) == values).all() and (quant == 1).all()


def test_a_sequential_scan_with_runs_and_ends_of_block():
    # DC category 2 (codes 0: size 0, 10: size 2), AC: 0 is end of block, 10 is run 1 size 1, 11... none
    bits = "10" + "11" + "10" + "1" + "0" + "0" + "0"
    raw = int(bits.ljust(16, "1"), 2).to_bytes(2)
    out = media._sequential(raw, 2, {(1, 0): 0, (2, 2): 2}, {(1, 0): 0, (2, 2): 0x11}, 0)
    assert out[0, :4].tolist() == [3, 0, 1, 0] and out[1, 0] == 3 and not out[1, 1:].any()


def test_pixels_are_the_inverse_transform():
    rng = np.random.default_rng(1)
    c = rng.integers(-60, 60, (3, 64))
    got = media.pixels(c, np.ones(64, int))
    for b in range(3):
        grid = np.zeros((8, 8))
        for z, k in enumerate(media.ZIGZAG):
            grid[k // 8, k % 8] = c[b, z]
        a = lambda u: np.sqrt(0.125) if u == 0 else 0.5
        want = [[sum(a(u) * a(v) * grid[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)]
        assert np.abs(got[b].reshape(8, 8).astype(float) - np.clip(np.rint(want) + 128, 0, 255)).max() <= 1


def test_shots_begin_where_histograms_jump():
    h = np.zeros((12, 16))
    h[:5, 2] = h[5:9, 9] = h[9:, 3] = 1
    assert media.cuts(h) == [0, 5, 9]
    assert media.cuts(h[:1]) == [0]


def test_query_columns(spark, odd, none):
    stored = media.store(odd, carry=["doc_id", "text"]).select("row.doc_id", "row.text", "media")
    rows = media.digest(stored, carry=["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        p = media.padded((r["row"]["text"] or "").encode())
        assert r["n_bytes"] == len((r["row"]["text"] or "").encode()) and r["payload_bytes"] == len(p)
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
        f = media.write_avi((r["row"]["text"] or "").encode())
        assert r["media_bytes"] == len(f) and r["media_sha256"] == hashlib.sha256(f).hexdigest()
    assert media.clips(stored, carry=["doc_id"]).count() >= odd.count()
    assert media.store(none).count() == 0
