"""WARC writing, parsing and transaction assembly; the defined cases."""

import base64
import gzip
import hashlib

from quantgrid.core import scratch
from quantgrid.llm import queries, warc


def plain(rows, least=0):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out, first = [], {}
    for page, html in rows:
        data = html.encode()
        again = len(data) >= least and first.setdefault(data, page) != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response",
                    first[data] if again else None))
    return sorted(map(repr, out))


def test_edge_rows(spark):
    rows = [(5, "http://a/\r\nX: y", "<p>"), (3, "http://b", "<p>"), (9, None, "<p>"), (1, "", None), (2, "u", ""), (4, "é", "ünï中\r\n\r\nWARC/1.1\r\n\r\n"),
            (6, "u", "x" * 3_000_000), (5, "http://a/\r\nX: y", "<p>"), (None, "n", "only here"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as digest", "3 as part")
    got = warc.archive_round_trip(df)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain([(p, h or "") for p, _, h in rows])
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_hot_payload(spark):
    df = spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, 'same', concat('own', id)) as html")
    got = sorted(repr(tuple(r)) for r in warc.archive_round_trip(df).collect())
    assert got == plain([(i, "same" if i % 3 == 0 else f"own{i}") for i in range(3000)])


def test_repeated_rows_equal_the_sql(spark):
    """Unequal numbers of repeats, of first pages and of revisits, with one and with several urls."""
    import duckdb
    rows = [(1, "u", "a")] * 3 + [(2, "u", "a")] * 2 + [(2, "v", "a"), (3, "u", "b"), (4, "u", ""), (5, "u", None), (5, "u", None)] + [(6, "u", "c")] * 40
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    cur = con.execute(queries.WARC_SQL)
    names = [d[0] for d in cur.description]
    got = warc.archive_round_trip(df).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))


def test_small_payloads_may_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    firsts = {r.page_id: r.first_id for r in warc.plan_transactions(df, min_bytes=5).collect()}
    assert firsts == {1: None, 2: None, 3: None, 4: 3}


def record(kind, ident, links=(), body=b"", mime=b"application/warc-fields", more=b""):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + ident, *[b"WARC-Concurrent-To: " + x for x in links]]
    return b"\r\n".join(head) + (b"\r\n" + more if more else b"") + b"\r\nContent-Type: " + mime + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_links_in_either_direction_and_over_hops(spark, monkeypatch):
    monkeypatch.setattr(warc, "MEMBERS_PER_ROW", 10)
    http = b"application/http; msgtype=response"
    parts = [record(b"warcinfo", b"<i>", body=b"software: x\r\n"),
             record(b"response", b"<a>", [b"<ra>"], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", http), record(b"request", b"<ra>", body=b"GET"),
             record(b"metadata", b"<ma>", [b"<ra>"], b"k: 1"), record(b"metadata", b"<mm>", [b"<ma>"], b"k: 2"),
             record(b"response", b"<b>", body=b"HTTP/1.1 200 OK\r\n\r\n", mime=http, more=b"X-Folded: one\r\n two"),
             record(b"metadata", b"<o>", [b"<nowhere>"]), record(b"request", b"<lost>")]
    parts += [record(b"metadata", b"<b%d>" % i, [b"<b>"]) for i in range(40)]
    path = scratch(spark, "warc-test")
    lines = [bytearray(b"".join(gzip.compress(p) for p in parts))]
    local = path.removeprefix("file:")
    import os
    os.makedirs(local)
    with open(local + "/part-0.warc.gz", "wb") as f:
        f.write(bytes(lines[0]))
    records = warc.read_warc(spark, path)
    assert records.count() == len(parts)
    got = {}
    for r in warc.assemble_captures(records).collect():
        got.setdefault(r.capture_id, []).append(r)
    a = got["<a>"][0]
    assert a.record_type == "response" and bytes(a.response.payload) == b"body" and a.payload_bytes == 4 and a.response.http_head.endswith("A: b")
    assert [m.record_id for m in a.requests] == ["<ra>"] and sorted(m.record_id for m in a.metadata) == ["<ma>", "<mm>"]
    assert len(got["<b>"]) == 4 and sorted(m.record_id for r in got["<b>"] for m in r.metadata) == sorted(f"<b{i}>" for i in range(40))
    assert got["<nowhere>"][0].record_type is None and got["<lost>"][0].requests[0].record_id == "<lost>"


def test_links_over_requests_and_several_captures(spark):
    """(record, type, names): what each record belongs to."""
    rows = [("a", "response", []), ("b", "response", []), ("c", "revisit", ["rc"]),
            ("ra", "request", ["a", "ma"]), ("ma", "metadata", []),            # named by the request only
            ("rb", "request", ["b"]), ("mb", "metadata", ["rb", "a"]),         # one link direct, one over a record
            ("rc", "request", []), ("mc", "metadata", ["rc"]), ("nc", "metadata", ["mc", "rb"]),
            ("x", "metadata", ["y"]), ("y", "metadata", ["x"]), ("z", "metadata", ["nowhere"]),  # a ring without response
            ("d1", "metadata", ["d2"]), ("d2", "metadata", ["d3"]), ("d3", "metadata", ["ra"]), ("e", "metadata", [])]
    rows += [("d2", "metadata", ["d3"]), ("f", "request", ["b", "e"])]
    df = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to array<string>")
    got = {}
    for r in warc.resolve_captures(df).collect():
        got.setdefault(r.record_id, set()).add(r.capture_id)
    assert got == {"ra": {"a"}, "ma": {"a"}, "rb": {"b"}, "mb": {"a", "b"}, "rc": {"c"}, "mc": {"c"}, "nc": {"b", "c"}, "d1": {"a"}, "d2": {"a"},
                   "d3": {"a"}, "e": {"b"}, "f": {"b"}, "x": {"y"}, "y": {"x"}, "z": {"nowhere"}}


def test_base32(spark):
    data = [b"", b"abc", bytes(range(256))]
    df = spark.createDataFrame([(d,) for d in data], "d binary")
    got = [r[0] for r in df.select(warc.base32_sha1(df.d)).collect()]
    assert got == [base64.b32encode(hashlib.sha1(d).digest()).decode() for d in data]
