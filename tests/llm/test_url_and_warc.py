from __future__ import annotations

import random

from pyspark.sql import functions as F

from vectrail.llm import url_filter as U
from vectrail.llm import warc_index as W

PAGES = "page_id bigint, url string, html string"


def test_urls(spark):
    rows = [
        (1, "https://free-porn.example.com/a", ""), (2, "https://sussex.example.com/adulthood", ""), (3, "http://x.com/casino/poker?bonus=1", ""),
        (4, "http://x.com/casino%20bonus", ""), (5, None, ""), (6, "", ""), (7, "http://x.com/PORN", ""), (7, "http://x.com/PORN", ""), (None, "http://x.com/live-sex", ""), (8, "http://a.com/" + "ok/" * 50_000, ""),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumnRenamed("html", "rejected")
    got = {r.page_id: r for r in U.filter_urls(df).collect()}
    assert {i for i, r in got.items() if r.rejected} == {1, 3, 7, None} and got[3].soft_hits == 3 and got[4].soft_hits == 2 and U.filter_urls(df).count() == 10
    assert U.filter_urls(df.filter("false")).count() == 0 and not U.filter_urls(df, rules=U.UrlRules(strict={}, soft={})).filter("rejected").count()


def test_urls_beyond_ascii(spark):
    rows = [(1, "http://x.com/порно/1", ""), (2, "http://xn--" + "порно".encode("punycode").decode() + ".example/", ""), (3, "http://x.com/%D0%BF%D0%BE%D1%80%D0%BD%D0%BE", ""), (4, "http://x.com/спорное", ""), (5, "http://x.com/成人视频", "")]
    got = {r.page_id: r.rejected for r in U.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True}


def brute(rows):
    def key(u):
        low = u.split("#")[0].lower().split("://", 1)[-1]
        host, slash, rest = low.partition("/")
        host = host.removeprefix("www.")
        return ",".join(host.split(".")[::-1]) + ")" + (slash + rest).rstrip("/")

    return sorted(((key(u or ""), t, i) for i, u, t in rows), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] is not None, x[2] or 0))


def test_merge_is_a_global_sort(spark):
    rng = random.Random(1)
    rows = [(i, f"https://www.h{rng.randint(0, 5)}.example.com/p{rng.randint(0, 9)}/", rng.randint(0, 20)) for i in range(300)] + [(7, "http://h1.example.com/p1", None)] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, ts bigint").withColumn("html", F.lit("x")).repartition(5)
    got = W.merge_index(W.capture_lines(df, F.col("ts")), range_bytes=6000).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 303)) and [(r.url_key, r.capture_ts, r.page_id) for r in got] == brute(rows)
    no, last = 0, None
    for r in got:
        no = no + 1 if r.url_key == last else 1
        assert r.capture_no == no and r.changed == (no == 1)
        last = r.url_key


def test_a_key_spans_ranges_and_a_range_many_reads(spark):
    rng = random.Random(5)
    rows = sorted((rng.choice(["http://a.com/", "http://b.com/x", "http://b.com/x"]), rng.randint(0, 400), i, rng.choice("uv")) for i in range(3000)) + [("http://b.com/x", 401, 1, "u")] * 400
    df = spark.createDataFrame([(i, u, t, h) for u, t, i, h in rows], "page_id bigint, url string, ts bigint, html string").repartition(6)
    for range_bytes in (8_000, 1 << 30):  # forty ranges, or one that is read in many pieces
        made = W.merge_index(W.capture_lines(df, F.col("ts")), range_bytes=range_bytes, ahead=7)
        got = made.orderBy("position").collect()
        if range_bytes == 8_000:
            assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert [(r.url_key, r.capture_ts, r.page_id) for r in got] == brute([(i, u, t) for u, t, i, _ in rows]) and [r.position for r in got] == list(range(1, 3401))
        no, key, digest = 0, None, None
        for r in got:
            no = no + 1 if r.url_key == key else 1
            assert r.capture_no == no and r.changed == (no == 1 or r.digest != digest)
            key, digest = r.url_key, r.digest


def test_warc_edges(spark):
    rows = [(1, None, None), (None, "http://a.com/" + "x" * 100_000, "h"), (2, "", "h"), (2, "", "h")]
    df = spark.createDataFrame(rows, PAGES).withColumn("position", F.lit(9))
    got = W.merge_index(W.capture_lines(df, F.lit(None)), range_bytes=100)
    assert got.count() == 4 and got.filter("url_key = ''").count() == 1
    assert W.merge_index(W.capture_lines(df.filter("false"), F.lit(1))).count() == 0


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((rng.randint(0, 9),) for _ in range(rng.randint(0, 8))) for _ in range(k)]
        assert list(W.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
