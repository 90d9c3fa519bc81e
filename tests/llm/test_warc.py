import base64
import gzip
import hashlib

from hushframe.llm import warc

PAGES = [(1, "http://a/x y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None), (4, "http://c\r\nX: y", "zwei ü\r\n\r\nWARC/1.1\r\n"), (5, "http://d", "<p>one</p>"), (5, "http://d", "<p>one</p>"), (None, "http://e", "<p>one</p>"), (None, None, "alone"), (6, "http://f", ""), (7, "http://g", "x" * 300_000)]


def want(min_bytes=0):
    out = []
    for p, _, html in PAGES:
        data = (html or "").encode()
        same = [q for q, _, h in PAGES if (h or "") == (html or "") and q is not None]
        revisit = bool(same) and p != max(same) and len(data) >= min_bytes
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, kind string, sha int")
    for min_bytes in (0, 5):
        got = warc.read(warc.write(pages, min_bytes, file_bytes=2000))
        assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == want(min_bytes)
        assert got.filter("gap is not null").count() == 0
        payloads = {(r["page_id"], bytes(r["payload"]).decode()) for r in got.filter("payload is not null").collect()}
        assert payloads <= {(p, h or "") for p, _, h in PAGES}
    assert warc.read(warc.write(pages.filter("false"))).count() == 0


def test_archives_found_by_path(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(warc.record(i, "http://a", b"x%d" % i, "response", None) for i in range(4)))
    assert sorted(r["page_id"] for r in warc.read_archives(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]


def records(n=6):
    return [warc.record(i, f"http://x/{i}", b"payload %d " % i * 20, "response", None) for i in range(n)]


def test_damage_costs_only_what_it_hits():
    for packed in (True, False):
        parts = [gzip.compress(r, mtime=0) if packed else r for r in records()]
        for hit in range(6):
            broken = bytearray(parts[hit])
            broken[len(broken) // 2] ^= 0xFF
            data = b"".join([*parts[:hit], bytes(broken), *parts[hit + 1 :]])
            found = list(warc.salvage(data))
            assert [warc._page(h["warc-record-id"]) for _, _, gap, h, _ in found if gap is None] == [i for i in range(6) if i != hit]
            gaps = [(a, n) for a, n, gap, _, _ in found if gap is not None]
            start = sum(map(len, parts[:hit]))
            assert gaps == [(start, len(parts[hit]))]
            assert sum(n for a, n in {(a, n) for a, n, *_ in found}) == len(data)


def test_truncated_and_foreign_bytes():
    parts = [gzip.compress(r, mtime=0) for r in records(3)]
    data = b"garbage" + parts[0] + b"\x1f\x8b\x08 not gzip" + parts[1] + parts[2][:-9]
    found = list(warc.salvage(data))
    assert [warc._page(h["warc-record-id"]) for _, _, gap, h, _ in found if gap is None] == [0, 1]
    assert [n for _, n, gap, _, _ in found if gap is not None] == [7, len(b"\x1f\x8b\x08 not gzip"), len(parts[2]) - 9]
    assert list(warc.salvage(b"")) == [] and [x[2] for x in warc.salvage(b"\x00" * 10)] == ["no version line"]


def test_plain_record_with_another_length():
    good, bad = records(2)
    bad = bad.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found = list(warc.salvage(good + bad + good))
    assert [gap is None for _, _, gap, _, _ in found] == [True, False, True]


def kept(data):
    found = list(warc.salvage(data))
    return [warc._page(h["warc-record-id"]) for _, _, gap, h, _ in found if gap is None], [(a, n) for a, n, gap, _, _ in found if gap is not None]


def test_one_bad_record_of_a_member_costs_only_itself():
    for hit in range(6):
        parts = records()
        parts[hit] = parts[hit].replace(b"payload", b"pAyload", 1)
        member = gzip.compress(b"".join(parts), mtime=0)
        assert kept(b"x" + member) == ([i for i in range(6) if i != hit], [(0, 1), (1, len(member))])


def test_a_member_cut_short_keeps_what_is_there():
    blocks = [warc.record(i, "http://x", hashlib.sha512(b"%d" % i).hexdigest().encode() * 9, "response", None) for i in range(200)]
    for level in (0, 6):
        member = gzip.compress(b"".join(blocks), level, mtime=0)
        ids, gaps = kept(b"x" + member[: len(member) // 2])
        assert 60 < len(ids) < 140 and ids == list(range(len(ids))) and gaps == [(0, 1), (1, len(member) // 2)]


def test_many_false_starts_are_searched_once():
    """Damage full of what looks like members and version lines takes time in proportion to its length."""
    import time

    took = []
    for n in (20_000, 80_000):
        data = b"\x1f\x8b\x08 no member " * n + gzip.compress(records(1)[0], mtime=0)
        began = time.perf_counter()
        assert [warc._page(h["warc-record-id"]) for _, _, gap, h, _ in warc.salvage(data) if gap is None] == [0]
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_very_long_payload(spark):
    pages = spark.createDataFrame([(1, None, "lange Seite ü " * 1_000_000)], "page_id long, url string, html string")
    row = warc.read(warc.write(pages)).first()
    assert row["payload_bytes"] == 15_000_000 and bytes(row["payload"]).decode() == "lange Seite ü " * 1_000_000
