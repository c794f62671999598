"""Gzip members that hold several records, sound and damaged."""

import base64
import gzip
import random
import time
from hashlib import sha1

from colloquy.llm import warc


def record(k: int) -> bytes:
    payload = random.Random(k).randbytes(5000)
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nWARC-Block-Digest: sha1:{sha1(payload).hexdigest()}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def read(data: bytes):
    return [x.headers["warc-record-id"][12:-1] if x.reason is None else x.reason for x in warc.salvage(data)]


def test_every_record_of_a_member():
    whole = gzip.compress(b"".join(record(k) for k in range(5)))
    assert read(whole) == ["0", "1", "2", "3", "4"]
    assert {(x.begin, x.end) for x in warc.salvage(whole)} == {(0, len(whole))}
    assert read(whole + gzip.compress(record(7) + record(8)) + record(9)) == ["0", "1", "2", "3", "4", "7", "8", "9"]


def test_failures_inside_a_member_are_gaps():
    bad = record(1).replace(b"Content-Length: 5000", b"Content-Length: 4999")
    assert read(gzip.compress(record(0) + bad + record(2))) == ["0", "no blank lines at the end", "2"]
    assert read(gzip.compress(record(0) + b"noise")) == ["0", "no version line"]


def test_damaged_members_give_what_stands_before_the_damage():
    whole = gzip.compress(b"".join(record(k) for k in range(40)))
    cut = read(whole[:-60_000] + gzip.compress(record(50)))
    n = len(cut) - 2
    assert 20 < n < 40 and cut == [*map(str, range(n)), "member is damaged", "50"]
    broken = bytearray(whole)
    broken[150_000] ^= 0x55
    found = read(bytes(broken) + record(50))
    assert found[:25] == [str(k) for k in range(25)] and found[-2:] == ["member is damaged", "50"]


def test_bad_headers_are_gaps():
    long = record(1).replace(b"Content-Length: 5000", b"Content-Length: " + b"9" * 5000)
    word = record(2).replace(b"Content-Length: 5000", "Content-Length: ٥٠٠٠".encode())
    none = record(3).replace(b"Content-Length: 5000", b"Content-Length: many")
    assert read(record(0) + long + record(5) + word + record(6) + none + record(7)) == ["0", "block is cut off", "5", "header missing", "6", "header missing", "7"]
    feed = record(4).replace(b"WARC-Type: resource\r\n", b"WARC-Type: resource\nX: y\r\n")
    bare = record(8).replace(b"resource\r\n", b"resource\r\nno mark\r\n")
    assert read(record(0) + feed + record(1) + bare + record(2)) == ["0", "line feed in a header", "1", "header without colon", "2"]
    wide = record(9).replace(b"WARC-Type", b"X: " + b"x" * 70_000 + b"\r\nWARC-Type")
    assert read(wide + record(1)) == ["headers do not end", "1"]
    # the last of several equal headers holds; a version line may end in a line feed
    twice = record(3).replace(b"Content-Length", b"Content-Length: 7\r\nContent-Length").replace(b"WARC/1.0\r\n", b"WARC/1.0\n")
    assert read(twice + record(1)) == ["3", "1"]


def test_digests_and_lengths_of_revisits():
    hexes = sha1(b"x").hexdigest()
    cases = {
        f"sha1:{hexes}": hexes, f"SHA1:{hexes.upper()}": hexes, "sha1:" + base64.b32encode(sha1(b"x").digest()).decode(): hexes,
        "md5:9dd4e461268c8034f5c8564e155c67a6": None, "sha256:" + "0" * 64: None, "sha1:" + "1" * 32: None, "sha1:": None, "none": None,
    }
    for size, expected in (("12", 12), ("-1", None), ("many", None), ("", None)):
        for digest, found in cases.items():
            head = f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Payload-Digest: {digest}\r\nX-Payload-Length: {size}\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
            row = warc._row("f", next(warc.salvage(head.encode())))
            assert (row[7], row[8], row[9], row[10]) == (expected, found, None, None)


def test_noise_is_read_in_linear_time():
    noise = [
        b"WARC/1.1\r\n" * 1_000_000, b"WARC/1.1\n" * 200_000, b"a: WARC/1.1\r\n" * 200_000, b"\x1f\x8b\x08\x08name" * 200_000,
        (b"WARC/1.1\r\n" * 6000 + b"\r\n") * 50, (b"a: WARC/1.1\r\n" * 4000 + b"Content-Length: 9\r\n\r\n") * 50, (b"WARC/1.1\na: " * 4000 + b"\r\n\r\n") * 50,
    ]
    for k, x in enumerate(noise):
        begin = time.monotonic()
        found = read(record(0) + x + b"\n\n" + record(1))
        assert found[0] == "0" and found[-1] == "1" and len(found) == 3, (k, found[:9])
        assert time.monotonic() - begin < 20, k
