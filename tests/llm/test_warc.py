import base64
import gzip
import hashlib
from collections import defaultdict

from skein.llm import warc


def expected(rows, least=0):
    same = defaultdict(list)
    for page, _, html in rows:
        same[(html or "").encode()].append(page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        top = max((p for p in same[raw] if p is not None), default=None)
        revisit = page != top and len(raw) >= least
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ODD = [(9001, None, ""), (9002, "http://a.b/x y", "dup"), (9003, "http://a.b/x y", "dup"), (9003, "http://a.b/x y", "dup"), (None, "http://q/", "dup"), (9005, "u\nv", None), (9006, "http://é.de/ü", "ü\r\n\r\nx")]


def test_written_pages_are_read_back(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 30_000)
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(spark.createDataFrame(ODD, "page_id long, url string, html string")).repartition(3)
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted(map(tuple, warc.archive(pages).collect()), key=str) == expected(rows)
    assert sorted(map(tuple, warc.archive(pages, least_bytes=3 + 1).collect()), key=str) == expected(rows, 4)
    assert warc.archive(pages.limit(0)).count() == 0


def test_keys_sort_by_reversed_host():
    assert warc.surt("https://Me@WWW.Example.com:8080/a b?q=1#f") == "com,example,www:8080)/a%20b?q=1"
    assert warc.surt(None) == ")" and warc.surt("x") == "x)"


def test_records_are_plain_warc():
    data = gzip.decompress(gzip.compress(warc.record(5, "http://a/", b"<p>", None, False)))
    fields, block = warc.parse(data)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"<p>\r\n\r\n")
    assert fields["WARC-Target-URI"] == "http://a/" and block.endswith(b"\r\n\r\n<p>")
    fields, block = warc.parse(warc.record(4, "http://a/", b"<p>", 5, True))
    assert fields["WARC-Type"] == "revisit" and fields["WARC-Refers-To"] == "<urn:page:5>" and block.endswith(b"\r\n\r\n")


def test_directory_search_over_blocks(tmp_path):
    sink = warc.Sink(str(tmp_path), "cdx.gz")
    keys = sorted(f"k{i % 9} s {i:020d}" for i in range(30)) + ["z s 1"] * 12
    blocks = []
    for at in range(0, len(keys), 5):
        part = keys[at : at + 5]
        data = gzip.compress("\n".join(f"{k}\tf\t{at + i}\t1" for i, k in enumerate(part)).encode())
        file, place = sink.write(data)
        blocks.append((part[0], part[-1], file, place, len(data)))
    sink.close()
    found = warc.Directory(blocks, str(tmp_path))
    for i, k in enumerate(keys[:30]):
        assert list(found.find(k)) == [("f", i, 1)]
    assert [x[1] for x in found.find("z s 1")] == list(range(30, 42)) and not list(found.find("nothing"))


def test_pages_without_ids_keep_their_payload(spark):
    rows = [(None, "http://a/1", "same"), (None, "http://a/2", "same"), (None, "http://a/3", "other"), (4, "http://a/4", "other")]
    got = {r.url[-1]: (r.revisit, r.response_id) for r in warc.mark_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["1"] == got["2"] == (False, None) and got["3"] == (True, 4) and not got["4"][0]
