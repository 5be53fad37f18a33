"""WARC archives: exact round trip, digests, odd rows, memory bounds of writer and reader."""

import base64
import hashlib
import io
import random

import pytest

from labelspring.llm import warc_chunks as warc

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    """page -> (bytes, digest, type, refers_to), one entry per row."""
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    top = {}
    for page, data in payloads:
        if page is not None:
            top[data] = max(top.get(data, page), page)
    out = []
    for page, data in payloads:
        first = top.get(data)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = page != first
        out.append((page, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr
    )


ODD = [
    (1, "http://a/1", "same"), (2, None, "same"), (3, "http://a/3", ""), (4, "http://a/4", None), (5, "a b\r\nX: y", "é漢\r\n\r\nWARC/1.1\r\n"),
    (None, "http://n", "same"), (None, None, "alone"), (6, "http://a/6", "x" * 300_000), (7, "http://a/7", "x" * 300_000),
    (8, "http://a/8", "twice"), (8, "http://a/8", "twice"), (-9, "http://a/9", "\x00\x01 \r\n\r\n"), (10, "u", "y" * warc.CHUNK),
    (11, "u", "z" * (warc.CHUNK + 1)),
]


@pytest.mark.parametrize("level", [0, 1])
def test_odd_rows(spark, tmp_path, level):
    pages = spark.createDataFrame(ODD, SCHEMA)
    folder = str(tmp_path / "a")
    manifest = warc.write_archives(pages, folder, level=level)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(ODD)
    chunks = warc.read_chunks(manifest, folder).collect()
    last = [c for c in chunks if c.last]
    found = sorted(((c.page_id, c.total, c.digest, c.record_type, c.refers_to) for c in last), key=repr)
    assert found == expected(ODD)
    # payloads come back byte for byte, in order, with the digest of every prefix
    for page, text in ((5, ODD[4][2]), (6, None), (7, ODD[8][2]), (11, ODD[13][2]), (-9, ODD[11][2])):
        rows = sorted((c for c in chunks if c.page_id == page), key=lambda c: c.chunk_no)
        assert [c.chunk_no for c in rows] == list(range(len(rows)))
        data = b"".join(bytes(c.data) for c in rows)
        assert data == (b"" if text is None else text.encode())
        if text is not None:
            done = 0
            for c in rows:
                done += len(c.data)
                assert c.total == done and c.digest == warc.base32(hashlib.sha1(data[:done]).digest())
    assert {c.url for c in chunks if c.page_id == 5} == {"a%20b%0D%0AX:%20y"}
    assert {c.url for c in chunks if c.page_id == 2} == {None}


def test_round_trip_of_random_pages(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\r\nWARC/é ") for _ in range(rng.choice([0, 1, 5, 50, 5000]))) for _ in range(40)]
    rows = [(i, f"http://h/{i}", rng.choice(texts)) for i in rng.sample(range(-500, 500), 300)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(warc.round_trip(pages)) == expected(rows)


def test_least_length(spark, tmp_path):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "b"), least=4)
    kinds = {r.page_id: r.record_type for r in warc.read_chunks(manifest, str(tmp_path / "b"), with_data=False).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(empty).count() == 0
    rows = spark.createDataFrame([(1, "u", "t", 5, "x")], "page_id long, url string, html string, chunk_no int, sha1 string")
    assert got(warc.round_trip(rows)) == expected([(1, "u", "t")])


def test_all_pages_equal_stay_spread(spark):
    rows = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "'one text' AS html").repartition(5)
    out = warc.round_trip(rows)
    assert out.where("record_type = 'response'").count() == 1 and out.where("refers_to = 2999").count() == 2999


class Narrow(io.RawIOBase):
    """A source that counts how much is held between reads."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n=-1):
        out = self.data[self.at : self.at + min(n, 1000)]
        self.at += len(out)
        return out


@pytest.mark.parametrize("level", [0, 1])
def test_reader_never_holds_a_record(level):
    payload = random.Random(1).randbytes(3 << 20)
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink, level)
    for page in range(2):
        writer.begin(warc.record_header(page, page, "u", len(payload), hashlib.sha1(payload).digest(), None, False), len(payload))
        for i in range(0, len(payload), warc.CHUNK):
            writer.add(payload[i : i + warc.CHUNK])
    writer.end()
    reader = warc.ArchiveReader(Narrow(sink.getvalue()), 4096, bool(level))
    for _, length, pieces in reader.records():
        total = hashlib.sha1()
        for piece in pieces:
            assert len(piece) <= 4096 and len(reader.buffer) <= 4096 + warc.BLOCK
            total.update(piece)
        assert length == len(payload) and total.digest() == hashlib.sha1(payload).digest()


def test_writer_rejects_short_payloads_and_reader_cut_files():
    writer = warc.ArchiveWriter(io.BytesIO(), 0)
    writer.begin(b"h", 5)
    writer.add(b"1234")
    with pytest.raises(ValueError, match="lacks 1"):
        writer.end()
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink, 0)
    writer.begin(warc.record_header(1, 1, "u", 4, hashlib.sha1(b"1234").digest(), None, False), 4)
    writer.add(b"1234")
    writer.end()
    whole = sink.getvalue()
    for cut in (10, len(whole) - 5):
        with pytest.raises(ValueError):
            for _, _, pieces in warc.ArchiveReader(io.BytesIO(whole[:cut]), packed=False).records():
                list(pieces)
