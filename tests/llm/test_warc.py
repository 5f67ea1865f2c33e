import base64
import hashlib

import numpy as np
import pytest

from graphtables.llm import warc
from tests.llm.samples import bag

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, path string")


def plain(rows, min_bytes=0):
    payloads = {}
    for i, _, h in rows:
        payloads.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in payloads[h or ""] if x is not None]
        first = min(ids) if ids else None
        revisit = len(payloads[h or ""]) > 1 and i != first and len(b) >= min_bytes
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return bag(out)


ROWS = [(5, "http://a/", "<p>hello</p>"), (3, "http://b/", "<p>hello</p>"), (9, None, "<p>hello</p>"), (9, "u", "<p>hello</p>"),
        (1, "http://x/\r\nEvil: 1", FAKE * 3), (2, "y", "before " + FAKE + "after\r\n\r\n" + FAKE), (4, "z", None), (6, "z", ""),
        (None, "n", "<p>hello</p>"), (None, "n", "alone"), (7, "é", "漢字 😀 \r\n\r\n" * 20), (8, "long", "word " * 200_000),
        (10, "q", "WARC/1.1\r\n"), (3, "http://b/", "<p>hello</p>")]


@pytest.mark.parametrize("min_bytes,per_file", [(0, 2000), (5, 3)])
def test_round_trip(spark, scratch, min_bytes, per_file):
    warc.write_warc(pages(spark, ROWS), f"{scratch}/w", min_bytes=min_bytes, records_per_file=per_file)
    got = warc.read_warc(spark, f"{scratch}/w").collect()
    assert bag((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain(ROWS, min_bytes)


def test_shuffled_references(spark, scratch, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    warc.write_warc(pages(spark, ROWS), f"{scratch}/w")
    got = warc.read_warc(spark, f"{scratch}/w").collect()
    assert bag((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain(ROWS)


def test_magic_in_payloads_is_a_candidate_but_no_record(spark, scratch):
    warc.write_warc(pages(spark, ROWS[4:6]), f"{scratch}/w")
    import glob
    data = b"".join(warc.inflate(open(f, "rb").read()) for f in sorted(glob.glob(f"{scratch}/w/part-*")))
    assert len(list(warc.candidates(data))) > 2
    assert warc.read_warc(spark, f"{scratch}/w").count() == 2


def test_broken_chain_raises(spark, scratch):
    import gzip
    import os
    os.makedirs(f"{scratch}/w")
    with gzip.open(f"{scratch}/w/part-0.txt.gz", "wb") as f:
        f.write(FAKE.encode() + b"trailing bytes")
    with pytest.raises(ValueError, match="do not end"):
        warc.read_warc(spark, f"{scratch}/w")


def test_archives_of_any_name_and_of_a_member_a_record(spark, scratch):
    """20,000 gzip members in x.warc.gz, and a plain archive."""
    import gzip
    import os
    import time

    records = [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {len(str(k))}\r\n\r\n{k}\r\n\r\n".encode()
               for k in range(20_000)]
    os.makedirs(f"{scratch}/w")
    members = b"".join(gzip.compress(r, 1) for r in records)
    with open(f"{scratch}/w/x.warc.gz", "wb") as f:
        f.write(members)
    with open(f"{scratch}/w/y.warc", "wb") as f:
        f.write(FAKE.encode() * 3)
    with open(f"{scratch}/w/_note", "w") as f:
        f.write("no archive")
    began = time.perf_counter()
    assert warc.inflate(members) == b"".join(records)
    assert time.perf_counter() - began < 5
    got = warc.read_warc(spark, f"{scratch}/w").collect()
    assert len(got) == 20_003
    assert {r.page: r.payload_bytes for r in got if r.page is not None} == {k: len(str(k)) for k in range(20_000)}
    with pytest.raises(ValueError, match="cut off"):
        warc.inflate(members[:-5])


def test_jump_on_random_chains():
    rng = np.random.default_rng(3)
    for _ in range(200):
        at = np.unique(np.concatenate(([0], rng.integers(0, 300, rng.integers(0, 40)))))
        then = at + rng.integers(1, 30, len(at))
        expected, here = np.zeros(len(at), bool), 0
        while here in at:
            k = int(np.searchsorted(at, here))
            expected[k], here = True, int(then[k])
        assert (warc.jump(at, then) == expected).all()


def test_empty_table(spark, scratch):
    warc.write_warc(pages(spark, []), f"{scratch}/w")
    assert warc.read_warc(spark, f"{scratch}/w").collect() == []
