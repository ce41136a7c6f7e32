"""WARC writing, reading and salvage."""

import gzip
import hashlib

from pyspark.sql import functions as F

from quarry.llm import warc


def rec(k: int, body: bytes, kind: str = "response", to: int | None = None) -> bytes:
    return warc.record(k, f"http://a/{k}\nx", kind, hashlib.sha256(body).hexdigest(), b"" if kind == "revisit" else body, len(body), to)


def test_round_trip_and_padding():
    bodies = [b"", b"x" * 200_000, b"WARC/1.1\r\n inside", bytes(range(256)) * 9]
    data = b"\x00".join(warc.member(rec(k, b)) for k, b in enumerate(bodies)) + b"\x00"
    found = list(warc.salvage(data))
    assert [f.payload for f in found] == bodies
    assert all(gzip.decompress(data[f.offset : f.offset + f.length]) for f in found)


def test_salvage_logs_gaps_and_recovers_later_records():
    parts = [warc.member(rec(k, b"body %d " % k * 50)) for k in range(6)]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 255
    cut = parts[4][: len(parts[4]) // 2]
    data = b"".join([parts[0], parts[1], bytes(bad), parts[3], cut, b"junk", parts[5]])
    found = list(warc.salvage(data))
    assert [f.record_id for f in found if f.kind != "gap"] == [f"<urn:page:{k}>" for k in (0, 1, 3, 5)]
    gaps = [(f.offset, f.length) for f in found if f.kind == "gap"]
    at = len(parts[0]) + len(parts[1])
    assert gaps == [(at, len(bad)), (at + len(bad) + len(parts[3]), len(cut) + 4)]
    assert sum(f.length for f in found) == len(data)


def test_plain_archives_resume_at_a_version_line():
    parts = [rec(k, b"body") for k in range(4)]
    data = parts[0] + parts[1].replace(b"body", b"b0dy") + parts[2][:-30] + parts[3]
    found = list(warc.salvage(data))
    assert [f.record_id for f in found if f.kind != "gap"] == ["<urn:page:0>", "<urn:page:3>"]
    assert sum(f.length for f in found) == len(data)
    assert list(warc.salvage(b"")) == []


def test_revisits(spark):
    long, short = "ä" * 60, "short"
    rows = [(3, "u", long), (1, None, long), (2, "v", long), (4, "w", short), (5, "w", short), (6, "w", None), (None, "n", long), (1, None, long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archived(df)
    assert got.where("kind = 'gap'").count() == 0
    got = got.select(warc.page_number(got.record_id).alias("i"), "payload_bytes", "kind", warc.page_number(got.refers_to).alias("r"), "digest").collect()
    key = sorted(((g.i if g.i is not None else 99, g.payload_bytes, g.kind, g.r) for g in got), key=str)
    assert key == sorted(
        [(3, 120, "revisit", 1), (1, 120, "response", None), (1, 120, "response", None), (2, 120, "revisit", 1), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (99, 120, "revisit", 1)],
        key=str,
    )
    assert {g.digest for g in got if g.payload_bytes == 120} == {hashlib.sha256(long.encode()).hexdigest()}
    assert warc.archived(df.limit(0)).count() == 0


def test_urls_of_more_than_64_kib(spark):
    for n in (30_000, 500_000):
        one = warc.record(1, "http://a/" + "é" * (n // 2) + "x" * (n % 2), "response", hashlib.sha256(b"b").hexdigest(), b"b", 1, None)
        for data in (warc.member(one), one):
            assert [(f.record_id, f.payload) for f in warc.salvage(data)] == [("<urn:page:1>", b"b")]
    body = "y" * 200
    df = spark.createDataFrame([(k, "http://a/" + "中" * 30_000, body) for k in (1, 2)], "page_id long, url string, html string")
    got = warc.archived(df).select("kind", "record_id", "refers_to", F.length("url").alias("n")).orderBy("record_id").collect()
    assert [tuple(r) for r in got] == [("response", "<urn:page:1>", None, 270_009), ("revisit", "<urn:page:2>", "<urn:page:1>", 270_009)]


def test_a_header_without_an_end_is_a_gap():
    data = rec(0, b"body") + b"WARC/1.1\r\nWARC-Type: response\r\n" + b"x" * 200_000
    assert [f.kind for f in warc.salvage(data)] == ["response", "gap"]


def test_header_ends_across_steps():
    for n in range(warc.CHUNK - 8, warc.CHUNK + 8):
        assert warc._header_end(memoryview(b"x" * n + b"\r\n\r\n" + b"y" * 9), 0) == n


def test_members_of_many_records():
    recs = [rec(k, b"body %d " % k * 4000) for k in range(5)]
    one = warc.member(b"".join(recs))
    found = list(warc.salvage(one + warc.member(rec(9, b"last"))))
    assert [f.record_id for f in found] == [f"<urn:page:{k}>" for k in (0, 1, 2, 3, 4, 9)]
    assert [f.inner for f in found] == [*[sum(map(len, recs[:k])) for k in range(5)], 0] and found[-1].offset == len(one)
    # A record that fails inside a sound member is a gap of that place and length.
    bad = recs[2].replace(b"body 2 body", b"b0dy 2 body", 1)
    found = list(warc.salvage(warc.member(b"".join([*recs[:2], bad, *recs[3:], b"tail"]))))
    gaps = [(f.inner, f.length, f.reason) for f in found if f.kind == "gap"]
    assert gaps == [(len(recs[0] + recs[1]), len(bad), "block digest differs"), (sum(map(len, recs)), 4, "no version line")]
    assert [f.record_id for f in found if f.kind != "gap"] == [f"<urn:page:{k}>" for k in (0, 1, 3, 4)]


def test_records_before_the_damage_of_a_member():
    import random

    noise = [random.Random(k).randbytes(150_000) for k in range(4)]
    one = warc.member(b"".join(rec(k, n) for k, n in enumerate(noise)))
    found = list(warc.salvage(one[: len(one) * 5 // 8] + warc.member(rec(9, b"last"))))
    assert [f.record_id for f in found if f.kind != "gap"] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:9>"]
    assert [f.offset for f in found if f.kind == "gap"] == [0]
    # Without digests nothing vouches for the bytes of a member that does not end.
    plain = lambda k, n: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(n), n)
    one = warc.member(b"".join(plain(k, n) for k, n in enumerate(noise)))
    assert [f.kind for f in warc.salvage(one)] == ["resource"] * 4
    assert [f.kind for f in warc.salvage(one[:-9])] == ["gap"]


def test_digests_and_folded_lines():
    import base64

    body = b"HTTP/1.1 200 OK\r\nstatus line without colon\r\nX: 1\r\n\r\npage"
    sha1 = hashlib.sha1(b"page").digest()

    def made(digest: str) -> bytes:
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n  b\r\nContent-Type: application/http\r\nWARC-Payload-Digest: {digest}\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    for value in (base64.b32encode(sha1).decode(), sha1.hex()):
        (f,) = warc.salvage(made(f"sha1:{value}"))
        assert (f.kind, f.payload, f.url) == ("response", b"page", "http://a/ b")
    assert [f.kind for f in warc.salvage(made("sha1:" + "A" * 32))] == ["gap"]
    assert [f.kind for f in warc.salvage(made("unknown:xyz"))] == ["response"]


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(k, "u", hashlib.sha512(str(k).encode()).hexdigest() * 40) for k in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "salt", "gz", "file", "value", "head")})
    warc.write(df.repartition(2), str(tmp_path / "w"))
    sizes = [p.stat().st_size for p in (tmp_path / "w").rglob("*.txt")]
    assert len(sizes) > 4 and max(sizes) <= 20_000
    assert warc.read(spark, str(tmp_path / "w")).where("kind = 'response'").count() == 300
