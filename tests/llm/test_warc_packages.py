import io
import zipfile

import pytest

from tracewright.llm import warc_packages as w
from tracewright.llm.common import shared_dir


def zipped(members, method=zipfile.ZIP_STORED, front=b"", comment=b""):
    out = io.BytesIO(front)
    out.seek(len(front))
    with zipfile.ZipFile(out, "a" if front else "w", method) as z:
        for k, v in members.items():
            z.writestr(k, v)
        z.comment = comment
    return w.ZipRanges(io.BytesIO(out.getvalue()), len(out.getvalue()))


@pytest.mark.parametrize("front,comment", [(b"", b""), (b"junk" * 9, b""), (b"", b"PK\x05\x06 in a comment of more than 22 bytes")])
def test_directory_and_ranges(front, comment):
    z = zipped({"a.txt": b"0123456789", "dir/b.txt": b"", "é.txt": b"xyz"}, front=front, comment=comment)
    assert list(z.members) == ["a.txt", "dir/b.txt", "é.txt"]
    assert z.range(z.members["a.txt"], 3, 4) == b"3456" and z.whole(z.members["é.txt"]) == b"xyz"
    with pytest.raises(ValueError):
        z.range(z.members["a.txt"], 8, 4)


def test_zip64_records(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    z = zipped({f"m{i}": bytes([65 + i]) * 20 for i in range(5)})
    assert [z.range(m, 2, 3) for m in z.members.values()] == [bytes([65 + i]) * 3 for i in range(5)]


def test_deflated_index_but_not_archive():
    z = zipped({"x": b"abc" * 50}, zipfile.ZIP_DEFLATED)
    assert z.whole(z.members["x"]) == b"abc" * 50
    with pytest.raises(ValueError):
        z.range(z.members["x"], 0, 3)
    with pytest.raises(ValueError):
        w.ZipRanges(io.BytesIO(b"no zip"), 6)


def test_record_round_trip():
    fields, http, payload = w.parse_record(w.build_record(7, "http://x/\r\nEvil: 1", b"a\r\n\r\nb", None, False))
    assert payload == b"a\r\n\r\nb" and fields["warc-target-uri"] == "http://x/%0D%0AEvil:%201" and b"Content-Length: 6" in http


def expected(rows, least=0):
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[h or ""] = max(best.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        b, first = (h or "").encode(), best.get(h or "")
        again = first is not None and p != first and len(b) >= least
        out.append((p, len(b), w.digest32(b), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ODD = [(1, "http://a", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 1000), (5, "u", "é" * 1000), (None, "u", "x"), (None, None, None), (6, "u\n", "y\r\n\r\nz")] + [(100 + i, "u", "same") for i in range(60)]


@pytest.mark.parametrize("least,size", [(0, 1 << 25), (3, 50)])
def test_packages_against_brute_force(spark, least, size):
    pages = spark.createDataFrame([(*r, "extra") for r in ODD], "page_id long, url string, html string, payload string")
    folder = shared_dir(spark, "test")
    got = w.read_packages(w.write_packages(pages, folder, least_bytes=least, package_bytes=size), folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ODD, least)
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h in ODD}
    empty = shared_dir(spark, "test")
    assert w.read_packages(w.write_packages(pages.limit(0), empty), empty).count() == 0


def test_op5_on_pages(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, w.op5_warc_packages(spark, sf_dir).collect()), key=str) == expected(rows)
