"""URL rules: filter properties, precedence and defined cases."""

from quantgrid.llm import url_filter

RULES = [("com/", "allow"), ("b.com/x", "block"), ("b.com/x", "allow"), ("a.b.com/", "allow"), ("net/es/", "block"), (None, "block"), ("com/", "allow")]


def test_precedence_and_edges(spark):
    rules = spark.createDataFrame(RULES, "rule string, verdict string").selectExpr("*", "1 as path", "2 as host")
    urls = ["http://b.com/xyz", "http://a.b.com/xyz", "HTTP://A.B.COM/x?q#f", "ftp://z.net/es/1", "ftp://znet/es/1", "http://com", "http://com/",
            "nothing", "", None, "http://xb.com/x", "http://.com/", "a://b://c.com/", "http://B.com?x=/x", "http://" + "a." * 50_000 + "com/" + "y" * 50_000,
            "http://b.com/xyz"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://b.com/x")], "page_id long, url string")
    df = df.selectExpr("*", "3 as host", "4 as rule", "5 as verdict", "6 as possible")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    assert got[0] == ("b.com", "/xyz", "b.com/x", "block") and got[15] == got[0] and got[None] == ("b.com", "/x", "b.com/x", "block")
    assert got[1] == ("a.b.com", "/xyz", "a.b.com/", "allow") and got[2] == ("a.b.com", "/x", "a.b.com/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == ("com", "", None, "allow") and got[6][2:] == ("com/", "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10][2] == "com/" and got[11] == (".com", "/", "com/", "allow") and got[12] == ("b:", "//c.com/", None, "allow")
    assert got[13] == ("b.com", "", None, "allow") and got[14][2] == "com/"
    twice = df.where("page_id < 8").unionAll(df.where("page_id < 8"))
    assert url_filter.judge_urls(twice, rules).count() == 16
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    none = url_filter.judge_urls(df, rules.limit(0), default="block").collect()
    assert len(none) == len(urls) + 1 and {(r.rule, r.verdict) for r in none} == {(None, "block")}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(5000).selectExpr("concat('h', id, '.com/') as key")
    blocks = 5000 * 16 // 512
    bits = url_filter.build_filter(listed, "key", blocks).first()["bits"]
    assert len(bits) == blocks * 8
    from pyspark.sql import functions as F
    probe = spark.range(20_000).selectExpr("id", "concat('h', id, '.com/') as key")
    words = F.slice(F.lit(bits), url_filter._block(F.col("key"), blocks) + 1, 8)
    passed = probe.withColumn("w", words).where(url_filter.maybe_listed(F.col("key"), F.col("w"))).agg(
        F.count_if(F.col("id") < 5000), F.count_if(F.col("id") >= 5000)).first()
    assert passed[0] == 5000 and passed[1] < 300
