"""Secret spans against a plain scan, linking rules and defined cases."""

import hashlib
import random
import re

from quantgrid.llm import queries, secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ORDER = [*secrets.BASE, *secrets.WEAK]


def plain(text, scope=200):
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = [("identifier", m.start(), m.end()) for m in re.finditer(secrets.IDENTIFIER, text)]
    weak += [("credential", m.start(), m.end()) for m in re.finditer(secrets.CREDENTIAL, text)
             if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    weak += [("endpoint", m.start(), m.end()) for m in re.finditer(secrets.ENDPOINT, text)]
    linked = []
    for kind, a, b in weak:
        near = [(k, s, e) for k, s, e in base + weak if (s >= b or e <= a) and s <= b + scope and e >= a - scope]
        ids, keys = (any(secrets.ROLE[k] == r for k, _, _ in near) for r in ("id", "secret"))
        need = {"identifier": keys, "credential": ids, "endpoint": ids and keys}[kind]
        if need and not any(s < b and e > a for _, s, e in base):
            linked.append((kind, a, b))
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER.index(s[0]))))
    n = [sum(k == x for k, _, _ in base) for x in secrets.BASE]
    return (*n, hashlib.sha256(show(base).encode()).hexdigest(), show(base + linked), len(linked))


def texts():
    rng = random.Random(4)
    pieces = ["password = ", "Token:", 'api_key="', "secret=token:abcdefg ", "passwd: abc", "AKIA" + "A1B2" * 4, "AKIASHORT", "0123456789abcdef" * 2,
              "abc", " ", "\n", "é中🙂", "client_id: web-7 ", "Username='bob_smith' ", "Ab3" * 12, "ab3" * 12, "https://db.example.com:5432/x ", "x" * 150, "ſecret=abcdefgh ", "="]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(300)]


def test_spans_equal_plain_scan(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as hex", "2 as start", "3 as linked")
    got = {r[0]: tuple(r)[1:] for r in secrets.scan(df).collect()}
    want = {i: plain(t) for i, t in rows}
    assert got == want
    assert sum(w[-1] > 0 for w in want.values()) > 30


def test_query_equals_plain_scan(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_linked) for r in queries.op8(spark, sf).collect()}
    assert got == {r.doc_id: plain(r.text) for r in rows} and any(g[0] for g in got.values())


def test_edge_rows(spark):
    key = "token = 0123456789abcdef01234567"
    rows = [(1, key), (1, key), (1, "other"), (None, key), (2, None), (3, ""), (4, "a" * 300_000 + " " + key), (5, "z" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in secrets.scan(df).collect())))
    assert got == sorted(repr((d, *plain(t))) for d, t in rows)
    assert secrets.scan(df.limit(0)).count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(i, t, "en", None, len(t)) for i, t in enumerate(texts())] + [(900, None, "en", "s", 7), (900, None, "en", "s", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = secrets.redact(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = out.collect()
    assert len(got) == len(rows)
    clean = {r.doc_id: r for r in got}
    for i, t, *_ in rows[:-2]:
        spans = sorted((int(a), int(b)) for a, b in (s.split(":")[1:] for s in plain(t)[4].split(",") if s))
        out_text, at = "", 0
        for a, b in spans:
            if a >= at:
                out_text += t[at:a] + secrets.MASK
            at = max(at, b)
        out_text += t[at:]
        assert clean[i].text == out_text and clean[i].n_chars == len(out_text)
    assert clean[900].text is None and clean[900].n_chars == 7
