"""Media columns: AVI files of motion-JPEG, made from payloads and read back.

Storing is lossless: a payload byte is one quantized DCT coefficient of an 8 x 8 block. Byte b
stands for the value whose 8 extra bits are b (128..255, or b - 255 below 128), so every
coefficient has run 0 and size 8, both Huffman tables hold that one symbol with the 1-bit code 0,
and a restart marker after each block keeps DC values apart. Such a scan has 72 bytes a block, which
numpy packs and unpacks for all blocks at once; frames with any other tables go through a sequential
baseline decoder. A file has the RIFF header, an INFO chunk with the payload's sizes, the frames
(`00dc`) and an index (`idx1`).

Reading parses the RIFF index, decodes every intra frame, restores the payload, turns coefficients
to pixels (inverse DCT) and compares luminance histograms of neighbouring frames. A cut is where the
difference exceeds the mean and ALPHA deviations of the differences before it in the shot; cuts
bound the clips.

A row depends on its text alone. A null or empty text is a payload of 64 zero bytes. Columns of the
input travel in a struct, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT, BLOCKS_WIDE, BLOCKS_HIGH, FPS = 64, 8, 8, 25
BINS, ALPHA, LEAST = 16, 2.0, 0.1


def padded(payload: bytes | None) -> bytes:
    """The payload with zero bytes up to a positive multiple of UNIT."""
    payload = payload or b""
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


# -- JPEG ------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: list[int], symbols: bytes) -> bytes:
    return _segment(0xC4, bytes([kind, *lengths]) + symbols)


_ONE_CODE = [1, *[0] * 15]
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, *[1] * 64]))
_TAIL = _table(0x00, _ONE_CODE, b"\x08") + _table(0x10, _ONE_CODE, b"\x08") + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _start_of_frame(width: int, height: int) -> bytes:
    return _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))


def _scans(payload: bytes) -> list[bytes]:
    """The entropy-coded bytes of each block of the payload, stuffed."""
    bits = np.unpackbits(np.frombuffer(payload, np.uint8)).reshape(-1, 8)
    coded = np.packbits(np.concatenate([np.zeros((len(bits), 1), np.uint8), bits], axis=1)).tobytes()
    size = UNIT * 9 // 8
    return [coded[k : k + size].replace(b"\xff", b"\xff\x00") for k in range(0, len(coded), size)]


def _join(scans: list[bytes]) -> bytes:
    out = [scans[0]]
    for k, s in enumerate(scans[1:]):
        out += [bytes([0xFF, 0xD0 + k % 8]), s]
    return b"".join(out)


ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    code, at, out = 0, 0, {}
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode_frame(data: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of a grey baseline frame: coefficients (blocks x 64, zigzag order), the quantization table
    (zigzag order), width and height."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, tables, quant, every, width, height, used = 2, {}, {}, 0, 0, 0, 0
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("only grey frames are read")
            used = body[8]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            dc, ac = tables[body[2] >> 4], tables[0x10 | body[2] & 15]
            break
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline frames are read")
    end = data.rindex(b"\xff\xd9")
    blocks = -(-width // 8) * -(-height // 8)
    one = (bytes(_ONE_CODE), b"\x08")
    if dc == ac == one and every == 1:
        return _fixed(data[at:end], blocks), quant[used], width, height
    return _sequential(data[at:end], blocks, _codes(*dc), _codes(*ac), every), quant[used], width, height


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _payload_bytes(scan: bytes, blocks: int) -> np.ndarray:
    """The extra bits of each coefficient of a scan in which all codes are one zero bit."""
    raw = _RESTART.sub(b"", scan).replace(b"\xff\x00", b"\xff")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(blocks * UNIT, 9)
    if bits[:, 0].any():
        raise ValueError("a code that the tables don't have")
    return np.packbits(bits[:, 1:]).reshape(blocks, UNIT)


def _fixed(scan: bytes, blocks: int) -> np.ndarray:
    b = _payload_bytes(scan, blocks).astype(np.int32)
    return np.where(b < 128, b - 255, b)


def _sequential(scan: bytes, blocks: int, dc: dict, ac: dict, every: int) -> np.ndarray:
    out = np.zeros((blocks, 64), np.int32)
    parts = _RESTART.split(scan) if every else [scan]
    for k, part in enumerate(parts):
        raw = part.replace(b"\xff\x00", b"\xff")
        bits, n, at, last = int.from_bytes(raw), len(raw) * 8, 0, 0

        def take(count: int) -> int:
            nonlocal at
            at += count
            return bits >> (n - at) & ((1 << count) - 1)  # noqa: B023

        def symbol(codes: dict) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in codes:
                    return codes[length, code]
            raise ValueError("a code that the tables don't have")

        def value(size: int) -> int:
            v = take(size)
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for b in range(k * every, min(blocks, (k + 1) * every) if every else blocks):
            last += value(symbol(dc))
            out[b, 0], at_coef = last, 1
            while at_coef < 64:
                run, size = divmod(symbol(ac), 16)
                if not size and run != 15:
                    break
                at_coef += run
                if size:
                    out[b, at_coef] = value(size)
                at_coef += 1
    return out


_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


#: Natural place of each zigzag coefficient, and its contribution to the 64 pixels.
_BASIS = np.stack([np.outer(_COS[z // 8], _COS[z % 8]).ravel() for z in ZIGZAG]).astype(np.float32)


def pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Blocks x 64 pixels, 0 to 255: dequantized, inverse DCT, level shift."""
    grey = (coefficients * quant).astype(np.float32) @ _BASIS
    return np.clip(np.rint(grey) + 128, 0, 255).astype(np.uint8)


# -- RIFF ------------------------------------------------------------------------------------------


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes | None) -> bytes:
    """An AVI file that holds the padded payload."""
    n_bytes, payload = len(payload or b""), padded(payload)
    n_blocks = len(payload) // UNIT
    wide = min(n_blocks, BLOCKS_WIDE)
    high = min(-(-n_blocks // wide), BLOCKS_HIGH)
    per = wide * high
    scans = _scans(payload + bytes(-n_blocks % per * UNIT))
    head, frames, index, at = _HEAD + _start_of_frame(wide * 8, high * 8) + _TAIL, [], [], 4
    for k in range(0, len(scans), per):
        body = _chunk(b"00dc", head + _join(scans[k : k + per]) + b"\xff\xd9")
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, struct.unpack_from("<I", body, 4)[0]))
        frames.append(body)
        at += len(body)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, 0, wide * 8, high * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), 0, 0, 0, 0, 0, wide * 8, high * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide * 8, high * 8, 1, 8, b"MJPG", wide * high * 64, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d units=%d\0" % (n_bytes, n_blocks)))
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"movi" + b"".join(frames)) + _chunk(b"idx1", b"".join(index)))


class Avi:
    """What the RIFF chunks of a file say: fps, the sizes of the payload if it holds one, frames by the index."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        self.fps, self.n_bytes, self.units, self.frames, movi, index = float(FPS), None, None, [], 0, b""
        stack = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
        while stack:
            at, end = stack.pop()
            while at + 8 <= min(end, len(data)):
                tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
                body = at + 8
                if tag == b"LIST":
                    if data[body : body + 4] == b"movi":
                        movi = body
                    else:
                        stack.append((body + 4, body + size))
                elif tag == b"avih":
                    self.fps = 1e6 / max(1, struct.unpack_from("<I", data, body)[0])
                elif tag == b"ICMT" and (m := re.match(rb"payload=(\d+) units=(\d+)", data[body : body + size])):
                    self.n_bytes, self.units = int(m[1]), int(m[2])
                elif tag == b"idx1":
                    index = data[body : body + size]
                at = body + size + size % 2
        for tag, _, offset, size in struct.iter_unpack("<4sIII", index):
            if tag[2:] in (b"dc", b"db"):
                self.frames.append(data[movi + offset + 8 : movi + offset + 8 + size])


def cuts(histograms: np.ndarray) -> list[int]:
    """The frames that begin a shot, 0 first. Rows of histograms sum to 1. A frame begins a shot if its difference from the
    one before exceeds LEAST and the mean and ALPHA deviations of the differences since the shot began."""
    out, diffs = [0], np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    n = total = square = 0.0
    for k, d in enumerate(diffs.tolist(), 1):
        if n:
            mean = total / n
            limit = mean + ALPHA * max(0.0, square / n - mean * mean) ** 0.5
        else:
            limit = LEAST
        if d > max(limit, LEAST) and n:
            out.append(k)
            n = total = square = 0.0
        else:
            n, total, square = n + 1, total + d, square + d * d
    return out


def read_avi(data: bytes) -> tuple[bytes | None, int | None, list[dict]]:
    """The padded payload that a file holds (None if it isn't one of ours), its size without padding, and its clips."""
    avi = Avi(data)
    stored, histograms, own = [], [], avi.units is not None
    for frame in avi.frames:
        coefficients, quant, _, _ = decode_frame(frame)
        if own:
            stored.append(np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).tobytes())
        grey = pixels(coefficients, quant)
        histograms.append(np.bincount(grey.ravel() // (256 // BINS), minlength=BINS) / grey.size)
    starts, clips = (cuts(np.array(histograms)) if histograms else []), []
    for k, a in enumerate(starts):
        b = starts[k + 1] if k + 1 < len(starts) else len(histograms)
        mean = np.mean(histograms[a:b], axis=0) @ np.arange(BINS)
        clips.append({"clip": k, "first_frame": a, "n_frames": b - a, "start_ms": round(a * 1000 / avi.fps), "end_ms": round(b * 1000 / avi.fps), "level": round(float(mean), 3)})
    payload = b"".join(stored)[: avi.units * UNIT] if own else None
    return payload, avi.n_bytes, clips


# -- DataFrames ------------------------------------------------------------------------------------

_CLIP = pa.struct([("clip", pa.int32()), ("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("level", pa.float64())])
_CLIPS = "array<struct<clip:int,first_frame:long,n_frames:long,start_ms:long,end_ms:long,level:double>>"


def store(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` with the columns of carry (None: all) and `media`, the AVI file with the row's text."""
    return common.map_texts(df, text_col, df.columns if carry is None else carry, lambda: lambda texts: ([write_avi(t) for t in texts],), [("media", "binary", pa.binary())])


def read(df: DataFrame, media_col: str = "media", carry: list[str] | None = None) -> DataFrame:
    """`row` with the columns of carry, `payload` (padded), `payload_size`, and `clips` of each file of media_col.
    A null file has null payload and no clips."""

    def start():
        return lambda files: zip(*[(None, None, []) if f is None else read_avi(f) for f in files], strict=True)

    return common.map_texts(df, media_col, df.columns if carry is None else carry, start, [("payload", "binary", pa.binary()), ("payload_size", "long", pa.int64()), ("clips", _CLIPS, pa.list_(_CLIP))])


def digest(df: DataFrame, media_col: str = "media", carry: list[str] | None = None) -> DataFrame:
    """As read(), with digests of what was read instead of the payload."""

    def one(f: bytes | None) -> tuple:
        if f is None:
            return (None,) * 7
        payload, size, clips = read_avi(f)
        feature = f"shots={len(clips)};" + ",".join(f"{c['start_ms']}-{c['end_ms']}:{c['level']:.3f}" for c in clips)
        return size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(f), hashlib.sha256(f).hexdigest(), feature

    out = [("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]
    return common.map_texts(df, media_col, df.columns if carry is None else carry, lambda: lambda files: zip(*map(one, files), strict=True), out)


def clips(df: DataFrame, media_col: str = "media", carry: list[str] | None = None) -> DataFrame:
    """A row for each clip: `row`, clip, first_frame, n_frames, start_ms, end_ms, level."""
    return read(df, media_col, carry).select("row", F.explode("clips").alias("c")).select("row", "c.*")


def op2_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store(common.documents(spark, sf_dir), carry=["doc_id"]).select("row.doc_id", "media")
    found = digest(stored, carry=["doc_id"])
    return found.select("row.doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
