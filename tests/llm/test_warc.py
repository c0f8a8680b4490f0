import gzip
import hashlib
import io

import pytest

from helpers import MID, SMALL, duck_rows, spark_rows
from tarmac.llm import queries
from tarmac.llm.warc import read_archives, read_records, record_bytes, warc_round_trip, write_archives


@pytest.mark.parametrize("sf", [SMALL, MID])
def test_query_equals_sql(spark, sf):
    assert spark_rows(queries.op5_warc(spark, sf)) == duck_rows(queries.SQL["op5_warc"], sf)


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, path string")


def test_edge_cases(spark):
    long = "é" * 600
    rows = [(1, "http://a/", long), (2, None, long), (9, "http://a/\r\nX: y %41", long), (9, "u", long), (None, "n", long),
            (3, "s", "short"), (4, "s", "short"), (5, "e", ""), (6, "e", None), (7, "x\r\n\r\ny", "\r\n\r\nWARC/1.1\r\n")]
    df = _pages(spark, [r + ("d", "p") for r in rows])
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_round_trip(df).collect()}
    assert got == {(1, 1200, "revisit", 9), (2, 1200, "revisit", 9), (9, 1200, "response", None), (None, 1200, "revisit", 9),
                   (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 0, "response", None),
                   (7, 14, "response", None)}
    back = read_archives(write_archives(df), with_payload=True).collect()
    assert len(back) == len(rows)
    assert {(r.page_id, r.url) for r in back} == {(i, u) for i, u, _ in rows}
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in back if r.record_type == "response")
    assert warc_round_trip(_pages(spark, [])).collect() == []


class Drip(io.BytesIO):
    """A stream that gives few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(7, n) if n > 0 else n)


def test_reader_takes_any_pieces_and_finds_damage():
    data = record_bytes(1, "http://a/", b"x" * 50, None) + record_bytes(2, None, b"", 1)
    got = list(read_records(Drip(data)))
    assert [(r.fields["WARC-Type"], r.payload, r.verified) for r in got] == [("response", b"x" * 50, True), ("revisit", b"", True)]
    assert gzip.decompress(data).count(b"WARC/1.1") == 2
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(data[:-9])))
    raw = gzip.decompress(record_bytes(1, None, b"abc", None)).replace(b"abc", b"abd")
    assert [r.verified for r in read_records(io.BytesIO(gzip.compress(raw)))] == [False]
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(gzip.compress(raw.replace(b"Content-Length: ", b"Content-Length: 9")))))
