import gzip
import hashlib
from collections import Counter

import pytest
import rows  # noqa: F401
from pyspark.sql import functions as F

from colloquy.llm import url_filter, warc

PAGES = "page_id long, url string, html string, size string, host string"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>the same page</p>" * 100
    body = "<html><script>var x = 1;</script><p>shoe store news book</p></html>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    data = [(k, f"http://shoestore{k % 3}.example.{'com' if k % 2 else 'net'}/{'en' if k % 3 else 'de'}/{k}?a#b", body * (k % 4 + 1) + str(k)) for k in range(40)]
    data += [(50 + k, "https://x.example.org/es/1", long) for k in range(5)] + [(60, None, None), (61, "no address", ""), (62, "://", "short"), (63, "http://A.B.Com?x", "short")]
    data += [(None, "http://e.com/en/", long), (54, "https://x.example.org/es/1", long), (70, "http://evil.com/\r\nWARC-Type: x", "ünï" * 400), (None, None, None)]
    return spark.createDataFrame([(*x, "clash", "clash") for x in data], PAGES).repartition(3)


def test_round_trip(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "a"), file_records=7)
    found = warc.read_archives(spark, str(tmp_path / "a"))
    assert found.where("reason is not null").count() == 0
    got = Counter((warc_page(x.record_id), x.payload_bytes, x.payload_digest, x.record_type, warc_page(x.refers_to), bytes(x.payload or b"") if x.payload is not None else None) for x in found.collect())
    all_rows = [(x.page_id, (x.html or "").encode()) for x in pages.collect()]
    expected = Counter()
    for i, p in all_rows:
        same = [j for j, q in all_rows if q == p and j is not None]
        revisit = len(p) >= 1000 and i is not None and i != max(same)
        expected[(i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None, None if revisit else p)] += 1
    assert got == expected


def warc_page(name):
    return int(name.split(":")[-1][:-1]) if name and name[-2].isdigit() else None


def record(k: int, payload: bytes = b"payload") -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nWARC-Block-Digest: sha1:{hashlib.sha1(payload).hexdigest()}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def read(data: bytes):
    found = list(warc.salvage(data))
    # records and gaps tile the file
    assert [x.begin for x in found] == [0, *[x.end for x in found]][: len(found)] and (not found or found[-1].end == len(data))
    return [x.headers["warc-record-id"][12:-1] if x.reason is None else x.reason for x in found]


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_salvage(pack):
    parts = [pack(record(k, b"some payload " * 20 + bytes([k]))) for k in range(5)]
    assert read(b"".join(parts)) == ["0", "1", "2", "3", "4"]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0x55
    assert read(b"".join([*parts[:2], bytes(broken), *parts[3:]]))[:2] == ["0", "1"]
    found = read(b"".join([*parts[:2], bytes(broken), *parts[3:]]))
    assert len(found) == 5 and found[3:] == ["3", "4"] and not found[2].isdigit()
    # cut off at the end, noise at the start and between, nothing at all
    assert read(b"".join(parts)[:-9])[:4] == ["0", "1", "2", "3"] and len(read(b"".join(parts)[:-9])) == 5
    assert read(b"noise\n" + parts[0] + b"\x1f\x8b\x08 junk WARC/1.0 x" + parts[1])[1::2] == ["0", "1"]
    assert read(b"") == [] and len(read(b"\x00" * 50)) == 1


def test_failed_checks():
    good = record(1)
    for bad in (good.replace(b"Content-Length: 7", b"Content-Length: 70000"), good.replace(b"payload", b"pAyload"), good.replace(b"WARC-Type", b"X"), good.replace(b"Content-Length: 7", b"Content-Length 7")):
        assert read(bad + record(2))[1:] == ["2"]


def test_damaged_files_are_logged(spark, tmp_path):
    (tmp_path / "one.warc").write_bytes(record(1) + record(2).replace(b"payload", b"PAYLOAD") + record(3))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(record(4)) + gzip.compress(record(5))[:-3] + gzip.compress(record(6)))
    (tmp_path / "none.warc").write_bytes(b"")
    found = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(x.record_id[12:-1] for x in found if x.reason is None) == ["1", "3", "4", "6"]
    assert sorted(x.reason for x in found if x.reason) == ["block digest differs", "member is damaged"]
    assert all(x.end > x.begin and x.payload is None for x in found if x.reason)


def test_no_pages(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_rules(spark):
    cases = {
        "http://a.com/en/1": ("a.com", "/en/1", "com/en/"), "https://X.EXAMPLE.COM/en/7?q": ("x.example.com", "/en/7", "example.com/en/7"),
        "http://com/en/": ("com", "/en/", "com/en/"), "http://telecom/en/": ("telecom", "/en/", None), "http://a.net/de/8": ("a.net", "/de/8", "net/de/"),
        "http://b.example.net/de/80#x": ("b.example.net", "/de/80", "example.net/de/8"), "http://a.com/EN/": ("a.com", "/EN/", None), "http://a.org#/es/": ("a.org", "", None),
        "http://a.org?b=http://c.com/en/": ("a.org", "", None), "x://y.org/es/\n://z": ("y.org", "/es/\n://z", "org/es/"), "nothing": ("", "", None), "": ("", "", None), "://": ("", "", None),
    }
    urls = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    for x in urls.select("url", host.alias("h"), path.alias("p"), url_filter.match_rules(host, path)["rule"].alias("r")).collect():
        assert (x.h, x.p, x.r) == cases[x.url], x.url


def test_url_verdicts(pages):
    found = url_filter.judge_urls(pages).collect()
    assert len(found) == pages.count()
    for x in found:
        assert x.verdict in ("allow", "block")
        if x.rule:
            assert x.verdict == {d + p: v for v, d, p in url_filter.RULES}[x.rule]
        if x.host == "":
            assert x.verdict == "allow" and x.tokens == []
    shoes = next(x for x in found if x.host.startswith("shoestore"))
    assert {"shoe", "store"} <= set(shoes.tokens)


def test_segmentation_is_the_most_probable():
    counts = {"shoe": 5, "store": 5, "shoes": 4, "tore": 3, "s": 1}
    assert url_filter.split_run("shoestore", counts, 100) == ["shoe", "store"]
    assert url_filter.split_run("zz", {}, 1) == ["z", "z"] and url_filter.split_run("", counts, 100) == []
