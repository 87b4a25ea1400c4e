import base64
import hashlib

import pytest

from graphloom.llm import warc
from graphloom.llm.cluster import scratch

SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark):
    rows = [(i, f"http://a/é {i}", ["", None, "<p>same</p>", f"own é {i}" * 50][i % 4]) for i in range(60)] + [(58, "again", "<p>same</p>"), (None, None, "<p>same</p>"), (-5, "", "\r\n\r\nx")]
    files = warc.write_archives(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", refers_to int"), scratch(spark, "warc"))
    got = warc.read_archives(files).collect()
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -(10**9)), -(10**9) if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and i < top[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    texts = {i: h or "" for i, _, h in rows}
    assert all(r.html is None if r.record_type == "revisit" else r.html == texts[r.page_id] for r in got if r.page_id is not None)
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA), scratch(spark, "warc"))).count() == 0


def test_damage_is_found():
    data = warc.archive([warc.record(i, "u", f"payload {i} ".encode() * 40, None) for i in range(30)])
    assert [r["page_id"] for r in warc.read_archive(data)] == list(range(30))
    for bad in (data[1:], data[:-3], data[:200] + bytes([data[200] ^ 255]) + data[201:]):
        with pytest.raises(Exception):  # noqa: B017
            list(warc.read_archive(bad))
    assert warc.page_of(warc.record_id(-7)) == -7
