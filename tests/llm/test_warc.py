import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from stemline.llm import common, warc


def member(key, payload, kind="response"):
    return warc._member(warc._record(kind, key, "http://x/é", hashlib.sha256(payload).hexdigest(), len(payload), 1, payload if kind == "response" else None))


@pytest.mark.parametrize("step", [1, 37, 1000, 1 << 20])
def test_every_record_is_read_once_for_any_ranges(step):
    rng = random.Random(step)
    payloads = [b"", b"\r\n\r\n", warc.MAGIC * 50, rng.randbytes(3000), b"x" * 70_000, member(9, b"nested")[:40] * 3]
    data = b"".join(member(k, p) for k, p in enumerate(payloads))
    found = [r for a in range(0, len(data), step) for r in warc.records(warc.Source(io.BytesIO(data), len(data)), a, a + step, True)]
    assert [(r["warc-record-id"], r["payload"]) for r in found] == [(f"<urn:row:{k}>", p) for k, p in enumerate(payloads)]
    assert all(r["warc-payload-digest"] == f"sha256:{r['digest']}" for r in found)


def test_stray_magic_and_cut_files_yield_no_record():
    data = warc.MAGIC + b"nothing" + member(1, b"a" * 300)
    assert len(list(warc.records(warc.Source(io.BytesIO(data), len(data)), 0, len(data), True))) == 1
    cut = data[:-20]
    assert not list(warc.records(warc.Source(io.BytesIO(cut), len(cut)), 0, len(cut), True))


def test_round_trip_with_copies_nulls_and_small_ranges(spark):
    long = "z" * 300_000
    rows = [(1, "a" * 100), (2, "a" * 100), (3, "a" * 99), (4, "a" * 99), (5, None), (6, ""), (7, long), (8, long), (None, "b" * 200), (9, "b" * 200), (9, "b" * 200), (10, "é" * 50), (None, None)]
    df = spark.createDataFrame([(k, "http://x/\n", t, 0) for k, t in rows], "page_id long, url string, html string, payload long").repartition(3)
    manifest = warc.write(df, common.shared_dir(spark) + "/w")
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    for size in (50, warc.RANGE):
        got = sorted((r["record_id"] or "", r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or "") for r in warc.read(manifest, range_bytes=size).collect())
        want = []
        for k, t in rows:
            p = (t or "").encode()
            same = [i for i, x in rows if len(p) >= 100 and (x or "").encode() == p and i is not None]
            revisit = bool(same) and min(same) != k
            want.append((str(k or ""), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", str(min(same)) if revisit else ""))
        assert got == sorted(want)
    payloads = {r["record_id"]: r["payload"] for r in warc.read(manifest).where("record_type = 'response'").collect()}
    assert bytes(payloads["7"]) == long.encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(df, common.shared_dir(spark) + "/w")).count() == 0
