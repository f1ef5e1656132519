"""Secret scans: base patterns, and multipart credentials linked by an interval join.  DataFrame functions only.

Base spans (always reported): ``assign`` (a secret's name, a sign, a value of 6 or more), ``access`` (AKIA and capitals
or digits, 20 or more in all), ``hex`` (24 or more).  Weak parts say nothing alone: ``identifier`` (client_id,
username, ... with a value), ``credential`` (32 or more letters and digits of three classes) and ``endpoint`` (a URL).
A weak part is reported when complementary parts stand within ``SCOPE`` characters of it in the same text and do not
overlap it: an identifier needs a secret (assign, hex or credential), a credential an identifier (access or
identifier), an endpoint both.  A weak part that overlaps a base span is that span and is not reported again.

The join is on (document, bucket of SCOPE characters): parts of a kind do not overlap, so a bucket holds a bounded
number and no long text becomes a quadratic group.  Only texts that hold a weak part take part in it.

Positions come from splitting the text at the matches; all counts are code points.

Defined cases: a null text is empty; texts without spans give an empty list; repeated rows are reported each; null ids
are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrid.core import store

# Fixed by the scan's contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"

IDENTIFIER = r"""(?i:access_?key_?id|client_?id|user_?name|user_?id|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
CREDENTIAL = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}"
ENDPOINT = r"""https?://[^\s"'<>()\[\]]+"""

BASE = ("assign", "access", "hex")
WEAK = ("identifier", "credential", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "credential": "secret", "access": "id", "identifier": "id", "endpoint": "place"}
SCOPE = 200
MASK = "[SECRET]"
NONE = "array<struct<start:int,end:int>>"


def match_spans(text: Column, pattern: str, group: int = 0, least: int = 0, also: tuple[str, ...] = ()) -> Column:
    """[start, end) of the leftmost non-overlapping matches; kept where the group has ``least`` characters and ``also`` match it."""
    p = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, p, F.lit(group)).alias("part"))
    parts = F.filter(parts, lambda x: x["hit"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        good = F.length(x["part"]) >= least
        for other in also:
            good = good & x["part"].rlike(other)
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("spans"))
    return F.aggregate(parts, zero, step, lambda acc: acc["spans"])


def span_columns(text: Column) -> dict[str, Column]:
    """Spans of every kind; cheap tests keep the full scan from texts that cannot match."""
    empty = F.array().cast(NONE)
    sign = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    test = {
        "assign": (sign & text.rlike(ASSIGN), match_spans(text, ASSIGN, 2, 6)),
        "access": (F.contains(text, F.lit("AKIA")), match_spans(text, ACCESS)),
        "hex": (text.rlike(HEX), match_spans(text, HEX)),
        "identifier": (sign & text.rlike(IDENTIFIER), match_spans(text, IDENTIFIER)),
        "credential": (text.rlike(CREDENTIAL), match_spans(text, CREDENTIAL, also=("[a-z]", "[A-Z]", "[0-9]"))),
        "endpoint": (F.contains(text, F.lit("://")) & text.rlike(ENDPOINT), match_spans(text, ENDPOINT)),
    }
    return {kind: F.coalesce(F.when(may, spans), empty) for kind, (may, spans) in test.items()}


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and one span array per kind."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), *[c.alias(k) for k, c in span_columns(text).items()])


def has_weak() -> Column:
    return sum((F.size(k) for k in WEAK), F.lit(0)) > 0


def link_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_key, linked: the weak spans whose complementary parts co-occur."""
    def tag(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(ROLE[kind]).alias("role"),
                                                    F.lit(kind in BASE).alias("strong"), s["start"].alias("start"), s["end"].alias("end")))

    tagged = F.flatten(F.array(*[tag(k) for k in (*BASE, *WEAK)]))
    key = ["doc_id", "text_key"]
    parts = found.where(has_weak()).select(*key, F.inline(tagged)).distinct()
    bucket = lambda x: F.floor(x / scope)
    weak = (parts.where(~F.col("strong")).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.col("kind").alias("weak_kind"),
                                                 F.col("start").alias("weak_start"), F.col("end").alias("weak_end"))
            .withColumn("cell", F.explode(F.sequence(bucket(F.col("weak_start") - scope), bucket(F.col("weak_end") + scope)))))
    other = parts.where("role in ('id', 'secret')").withColumn("cell", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    near = F.expr(f"doc_id <=> _d and text_key = _t and start <= weak_end + {scope} and end >= weak_start - {scope}")
    pairs = weak.join(other.withColumnRenamed("cell", "_c"), near & (F.col("cell") == F.col("_c")))
    apart = (F.col("end") <= F.col("weak_start")) | (F.col("start") >= F.col("weak_end"))
    hit = pairs.groupBy("_d", "_t", "weak_kind", "weak_start", "weak_end").agg(
        F.max(apart & (F.col("role") == "id")).alias("with_id"), F.max(apart & (F.col("role") == "secret")).alias("with_secret"),
        F.max(~apart & F.col("strong")).alias("covered"))
    need = F.when(F.col("weak_kind") == "identifier", F.col("with_secret")).when(F.col("weak_kind") == "credential", F.col("with_id"))
    need = need.otherwise(F.col("with_id") & F.col("with_secret"))
    return (hit.where(need & ~F.col("covered")).groupBy("_d", "_t")
            .agg(F.collect_list(F.struct(F.col("weak_kind").alias("kind"), F.col("weak_start").alias("start"), F.col("weak_end").alias("end"))).alias("linked")))


def in_order(arrays: dict[str, Column], linked: Column | None = None) -> Column:
    """All spans as (start, nth, kind, end), by start and then kind as listed."""
    kinds = F.lit([*BASE, *WEAK])

    def numbered(nth: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    each = [numbered(i, k, c) for i, (k, c) in enumerate(arrays.items())]
    if linked is not None:
        none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
        each.append(F.transform(F.coalesce(linked, none), lambda s: F.struct(
            s["start"].alias("start"), (F.array_position(kinds, s["kind"]) - 1).cast("int").alias("nth"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_sort(F.flatten(F.array(*each)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every text.  The texts are scanned once."""
    found = store(found_spans(docs))
    both = found.join(link_parts(found, scope), F.expr("doc_id <=> _d and text_key = _t"), "left")
    base = {k: F.col(k) for k in BASE}
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return both.select("doc_id", *counts, F.sha2(listed(in_order(base)), 256).alias("base_sha256"),
                       listed(in_order(base, F.col("linked"))).alias("spans"),
                       F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by MASK."""
    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with secrets masked in ``text`` and ``n_chars`` counted anew; rows and other columns stay.

    Texts without weak parts are masked where they are scanned; only those with weak parts meet the links.
    """
    text = F.coalesce("text", F.lit(""))
    columns = docs.columns
    wide = docs.select(F.struct(*columns).alias("row"), "doc_id", "text", F.xxhash64(text).alias("text_key"),
                       *[c.alias(k) for k, c in span_columns(text).items()])
    links = store(link_parts(store(found_spans(docs).where(has_weak())), scope))
    base = {k: F.col(k) for k in BASE}
    plain = wide.where(~has_weak()).withColumn("all", in_order(base))
    joined = wide.where(has_weak()).join(links, F.expr("doc_id <=> _d and text_key = _t"), "left").withColumn("all", in_order(base, F.col("linked")))
    rows = plain.select("row", "text", "all").unionByName(joined.select("row", "text", "all"))
    rows = rows.withColumn("clean", F.when(F.size("all") > 0, masked(F.col("text"), F.col("all"))).otherwise(F.col("text")))
    out = []
    for c in columns:
        col = F.col("row")[c]
        if c == "text":
            col = F.col("clean")
        elif c == "n_chars":
            col = F.when(F.size("all") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(col)
        out.append(col.alias(c))
    return rows.select(*out)
