import base64
import gzip
import hashlib
import os

from heddle.llm import warc

ROWS = [(3, "http://a/é?q=1%20&x=\r\ny", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (5, "http://c", ""), (5, "http://c", ""), (None, "http://d", "z"), (None, None, "z"), (None, "n", ""), (9, "http://e", "x" * 300_000), (1, "http://b/", "<p>é</p>")]


def brute(rows):
    out = []
    for page, url, html in rows:
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(ids, default=None)
        again = first is not None and page != first
        raw = (html or "").encode()
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None, url))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string")
    got = warc.archive(pages, str(tmp_path / "w"))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")) for r in got.collect()), key=str) == brute(ROWS)
    assert warc.archive(pages.limit(0)).count() == 0


def test_selected_records_and_plain_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 500) for i in range(300)], "page_id long, url string, html string").repartition(3)
    index = warc.write_warc(warc.with_types(pages), str(tmp_path / "w"))
    some = warc.read_warc(index.filter("page_id % 7 = 0")).collect()
    assert {r.page_id: r.payload for r in some} == {i: f"<p>{i}</p>" * 500 for i in range(0, 300, 7)}
    for name in os.listdir(tmp_path / "w"):
        if name.endswith(".warc.gz"):
            assert gzip.open(tmp_path / "w" / name).read().startswith(b"WARC/1.1\r\n")


def test_ranges_are_joined():
    assert warc.ranges([("a", 0, 10), ("a", 10, 5), ("a", 1 << 20, 5), ("b", 0, 1)]) == [("a", 0, 15, [(0, 10), (10, 5)]), ("a", 1 << 20, (1 << 20) + 5, [(1 << 20, 5)]), ("b", 0, 1, [(0, 1)])]
