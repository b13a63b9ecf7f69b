import gzip
import hashlib
import random

import pytest

from quillspark.llm import warc
from quillspark.scratch import new_path


def rows():
    long = "<p>ü " * 50
    return [(5, "http://a/ b\n", long), (2, None, long), (9, "u", long), (7, "u", "short"), (8, "u", "short"), (1, "u", None), (None, "u", long), (3, "u", "x" * 99), (4, "u", "x" * 99), (6, "u", "y" * 300_000), (11, "u", "WARC/1.1\r\nfake\r\n\r\n" + "z" * 200)]


def expected():
    seen = {}
    for k, _, h in rows():
        b = (h or "").encode()
        if len(b) >= 100 and k is not None:
            seen[b] = min(seen.get(b, k), k)
    out = []
    for k, _, h in rows():
        b = (h or "").encode()
        first = seen.get(b, k)
        out.append((k, len(b), hashlib.sha256(b).hexdigest(), "response" if first == k else "revisit", None if first == k else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, compress):
    path = new_path(spark, "warc-test")
    df = spark.createDataFrame(rows(), "page_id bigint, url string, html string").selectExpr("*", "'e' AS digest", "1 AS id")
    warc.write_warc(df, path, compress=compress, file_bytes=2000)
    got = warc.read_warc(spark, path).collect()
    assert {r.kind for r in got} == {"record"}
    number = lambda x: x if x is None else int(x)
    assert sorted([(number(r.row_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got], key=str) == expected()
    assert len({r.path for r in got}) >= 3
    full = {number(r.row_id): bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(full[k] == (h or "").encode() for k, _, h in rows() if k in full)


def archive(compress, n=30):
    rng = random.Random(1)
    parts = []
    for i in range(n):
        body = "".join(rng.choice("abc <>") for _ in range(rng.randint(0, 3000))).encode()
        r = warc.build_record(i, "u", body, hashlib.sha256(body).hexdigest(), None, False, "1970-01-01T00:00:00Z")
        parts.append(gzip.compress(r + warc.CLOSING, mtime=0) if compress else r + warc.CLOSING)
    return parts


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = archive(compress)
    edges = [0]
    for p in parts:
        edges.append(edges[-1] + len(p))
    for seed in range(40):
        rng = random.Random(seed)
        hurt = sorted(rng.sample(range(30), 4))
        data = bytearray(b"".join(parts))
        for i in hurt:
            at = rng.randrange(edges[i] + (10 if compress else 0), edges[i + 1] - 4)
            data[at] ^= 1 << rng.randrange(8)
        got = list(warc.salvage(bytes(data)))
        ids = [f["row_id"] for kind, *_, f in got if kind == "record"]
        assert {str(i) for i in range(30) if i not in hurt} <= set(ids)
        covered = sorted({(a, b) for _, a, b, *_ in got})
        assert covered[0][0] == 0 and covered[-1][1] == len(data)
        assert all(x[1] == y[0] for x, y in zip(covered, covered[1:]))


def test_cut_and_junk():
    parts = archive(True)
    data = b"junk" + parts[0] + parts[1][:20] + parts[2] + parts[3][:-5]
    got = list(warc.salvage(data))
    # Record 3 is whole though its member lost its end, which is logged.
    assert [g[0] for g in got] == ["gap", "record", "gap", "record", "record", "gap"]
    assert [g[5]["row_id"] for g in got if g[0] == "record"] == ["0", "2", "3"] and got[-1][4] == "gzip member is cut off"
    assert list(warc.salvage(b"")) == []
    assert [g[:3] for g in warc.salvage(b"nothing here")] == [("gap", 0, 12)]


def test_empty(spark):
    path = new_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_members_of_several_records():
    plain = archive(False)
    whole = b"".join(plain)
    ids = lambda data: [int(f["row_id"]) for kind, *_, f in warc.salvage(data) if kind == "record"]
    assert ids(gzip.compress(whole)) == list(range(30))
    hurt = bytearray(whole)
    hurt[len(b"".join(plain[:7])) + len(plain[7]) // 2] ^= 1
    assert ids(gzip.compress(bytes(hurt))) == [i for i in range(30) if i != 7]
    gaps = [g for g in warc.salvage(gzip.compress(bytes(hurt))) if g[0] == "gap"]
    assert [g[3] for g in gaps] == [len(b"".join(plain[:7]))]
    packed = gzip.compress(whole, 0)  # stored: the cut falls inside record 20
    cut = packed[: len(packed) - len(b"".join(plain[20:])) + 300]
    assert ids(cut) == list(range(20)) and ids(b"x" + cut + archive(True)[5]) == [*range(20), 5]
    broken = bytearray(packed)
    broken[-6] ^= 255  # the member's check sum
    assert ids(bytes(broken)) == list(range(30))


def test_digests_and_headers():
    def one(*extra, body=b"hello"):
        lines = ["WARC/1.0", "WARC-Type: resource", f"{warc.ROW_ID}: 4", f"Content-Length: {len(body)}", *extra]
        return "\r\n".join(lines).encode() + warc.CLOSING + body + warc.CLOSING

    kinds = lambda data: [(g[0], g[4]) for g in warc.salvage(data)]
    sha1 = "VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N"
    for right in (f"sha1:{sha1}", f"SHA-1:{sha1.lower()}", "sha1:" + hashlib.sha1(b"hello").hexdigest(), "md5:" + hashlib.md5(b"hello").hexdigest(), "odd:whatever"):
        assert kinds(one(f"WARC-Block-Digest: {right}")) == [("record", None)]
        assert kinds(one(f"WARC-Payload-Digest: {right}")) == [("record", None)]
    assert kinds(one(f"WARC-Block-Digest: sha1:{sha1[::-1]}")) == [("gap", "block digest differs")]
    assert kinds(one(f"WARC-Payload-Digest: sha1:{sha1[::-1]}")) == [("gap", "payload digest differs")]
    assert kinds(one("WARC-Target-URI: http://a/", " folded", "\tagain")) == [("record", None)]
    long = one("X: " + "y" * (3 << 20))
    assert kinds(long) == [("record", None)]
    assert kinds(b"WARC/1.0\r\nno end" * 20_000 + long)[-1] == ("record", None)


def test_long_urls_and_text_ids(spark):
    path = new_path(spark, "warc-test")
    data = [("a/ü b", "http://x/" + "q" * (1 << 20), "p" * 200), ("b", None, "p" * 200), ("c>", "u", "")]
    warc.write_warc(spark.createDataFrame(data, "page_id string, url string, html string"), path)
    got = sorted((r.row_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect())
    assert got == [("a/ü b", 200, "response", None), ("b", 200, "revisit", "a/ü b"), ("c>", 0, "response", None)]
