"""Round trip, revisit records and salvage of damaged archives."""

import gzip
import hashlib

import pytest

from mirrorfold.llm import warc
from mirrorfold.session import scratch

PAGES = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"),
         (None, "n", "only"), (-9, "m", "WARC/1.1\r\n\r\n" * 3), (10, "z", "x" * 200_000)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'e' as payload_key")


def test_round_trip(spark):
    found = warc.archive_pages(pages(spark), scratch(spark, "w") + "/a").collect()
    expect = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        response = max((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        expect.append((page, len(data), warc.sha1_base32(data), "response" if page == response else "revisit",
                       None if page == response else response))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expect))
    assert warc.sha1_base32(b"x") != hashlib.sha1(b"x").hexdigest()


def test_files_are_gzip_and_payloads_come_back(spark, tmp_path):
    folder = scratch(spark, "w") + "/a"
    warc.write_archives(pages(spark), folder)
    files = spark.read.format("binaryFile").load(folder).select("content").collect()
    text = b"".join(gzip.decompress(r[0]) for r in files if r[0])
    assert text.count(b"WARC-Type: response") == 6 and text.count(b"WARC-Type: revisit") == 2
    rows = warc.read_archives(spark, folder).filter("payload is not null").collect()
    assert sorted(bytes(r["payload"]) for r in rows) == sorted(
        h.encode() for h in ("", "<p>é</p>", "<p>é</p>", "only", PAGES[6][2], PAGES[7][2]))


def made(n, pack):
    out = []
    for i in range(n):
        payload = f"page {i} ".encode() * 50
        out.append(pack(warc.record(i, "http://x", payload, i, False, warc.sha1_base32(payload), len(payload))))
    return out


def test_salvage():
    for pack, kinds in ((lambda x: gzip.compress(x, mtime=0), ("cut", "flip", "junk", "tail")), (bytes, ("cut", "flip", "length", "junk", "tail"))):
        parts = made(6, pack)
        for kind in kinds:
            own = list(parts)
            if kind == "cut":
                own[2] = own[2][:len(own[2]) // 2]
            elif kind == "flip":
                own[2] = own[2][:-12] + bytes([own[2][-12] ^ 255]) + own[2][-11:]
            elif kind == "length":
                own[2] = own[2].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
            elif kind == "junk":
                own[2] = b"no record \x1f\x8b\x08 here\r\nWARC/1.1 nor here\r\n"
            else:
                own[5] = own[5][:-3]
            data = b"".join(own)
            found = list(warc.salvage(data))
            lost = 5 if kind == "tail" else 2
            good = [r["fields"]["warc-record-id"] for r, *_ in found if r]
            assert good == [f"<urn:page:{i}>" for i in range(6) if i != lost], (kind, pack)
            gaps = [(s, e) for r, s, e, why in found if r is None and why]
            assert gaps == [(sum(map(len, own[:lost])), sum(map(len, own[:lost + 1])))]
            edges = sorted((s, e) for _, s, e, _ in found)
            assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    mixed = b"\0".join(x + b"" for x in made(2, gzip.compress)) + b"\0" + made(1, bytes)[0]
    assert sum(r is not None for r, *_ in warc.salvage(mixed)) == 3
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"nothing")] == [None]


def test_gaps_are_returned(spark, tmp_path):
    (tmp_path / "one.warc.gz").write_bytes(b"".join(made(2, gzip.compress)) + b"broken" + made(1, gzip.compress)[0])
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r["gap"] is None for r in rows] == [True, True, False, True] and rows[2]["end"] - rows[2]["start"] == 6


def test_empty(spark):
    assert warc.archive_pages(pages(spark).limit(0), scratch(spark, "w") + "/a").count() == 0


def test_long_headers(spark):
    rows = [(1, "data:text/plain," + "x" * 70_000, "long"), (2, "http://a/" + "é" * 12_000, "bytes"), (3, "u", "long"), (4, None, "z")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = scratch(spark, "w") + "/a"
    found = warc.archive_pages(df, folder).collect()
    assert {r["page_id"]: r["payload_bytes"] for r in found} == {1: 4, 2: 5, 3: 4, 4: 1}
    uris = {r["page_id"]: r["target_uri"] for r in warc.read_archives(spark, folder).collect()}
    assert uris[1] == rows[0][1] and uris[2] == "http://a/" + "%C3%A9" * 12_000
    plain = warc.record(1, rows[0][1], b"p", 1, False, warc.sha1_base32(b"p"), 1)
    assert [r["payload"] for r, *_ in warc.salvage(plain + b"WARC/1.1\r\nno name" + plain) if r] == [b"p", b"p"]


def test_new_archive_with_a_gap_fails(spark, monkeypatch):
    right = warc.record
    monkeypatch.setattr(warc, "write_archives", lambda pages, folder: spark.createDataFrame(
        [(right(1, "u", b"p", 1, False, warc.sha1_base32(b"p"), 1)[:-9].decode(),)], "value string").write.text(folder))
    with pytest.raises(Exception, match="cut off|record"):
        warc.archive_pages(pages(spark), scratch(spark, "w") + "/a").collect()
