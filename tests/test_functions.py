import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import dedup, export, quality, retrieval
from tidemark.plans import pages
from tidemark.sources import feeds, html
from tidemark.streaming import events

from .conftest import SF


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("url, want", [
    ("HTTPS://Shop.Test/List?size=9&color=red#top", "https://shop.test/List?color=red&size=9"),  # lower-cased host, sorted query, no fragment
    ("http://shop.test:80/list?gclid=q7&size=9", "http://shop.test/list?size=9"),  # default port and click id go
    ("http://shop.test:8080/list", "http://shop.test:8080/list"),
    ("http://shop.test", "http://shop.test/"),
    ("mailto:shop@shop.test", None), ("shop", None), (None, None),
])
def test_normalize(spark, url, want):
    assert one(spark, U.normalize(F.col("u")), u=url) == want


@pytest.mark.parametrize("url, want", [
    ("http://e.com/x?page=4", "http://e.com/x?page=5"), ("http://e.com/x?start=20", "http://e.com/x?start=40"), ("http://e.com/x?start=0", None), ("http://e.com/page/3/", "http://e.com/page/4/"), ("http://e.com/x", None),
])
def test_next_page(spark, url, want):
    assert one(spark, U.next_page(F.col("u")), u=url) == want


def test_redirects(spark):
    assert one(spark, U.unwrap_redirect(F.col("u")), u="https://d.example/l/?uddg=https%3A%2F%2Fa.com%2Fb") == "https://a.com/b"
    assert one(spark, U.unwrap_redirect(F.col("u")), u="https://b.example/ck/a?u=a1aHR0cHM6Ly9hLmNvbS9i") == "https://a.com/b"
    assert one(spark, U.unwrap_redirect(F.col("u")), u="https://a.com/x?url=ftp://y") == "https://a.com/x?url=ftp://y"


@pytest.mark.parametrize("text, want", [("EUR 80.417,90", 80417.9), ("80,417.90 USD", 80417.9), ("0,75", 0.75), ("62,000", 62000.0), ("- 3", -3.0), ("-41", -41.0), ("free", None)])
def test_parse_number(spark, text, want):
    assert one(spark, T.parse_number(F.col("t")), t=text) == want


def test_dates(spark):
    assert one(spark, T.sitemap_time(F.col("t")), t="2024-01-02T03:04:05+05:00") == 1704164645
    assert one(spark, T.sitemap_time(F.col("t")), t="2024-01-02") == 1704153600
    assert one(spark, T.sitemap_time(F.col("t")), t="soon") is None
    assert one(spark, T.iso_duration(F.col("t")), t="PT1H2M3S") == 3723.0
    assert one(spark, T.clock(F.col("t")), t=3723) == "1:02:03"
    assert one(spark, T.cache_ttl(F.col("t"), F.lit(False), 3600), t="max-age=60") == 60
    assert one(spark, T.cache_ttl(F.col("t"), F.lit(False), 3600), t="no-store") is None


def test_fixed_hashes(spark):
    assert one(spark, H.fnv64("t"), t="") == 0xCBF29CE484222325 - (1 << 64)
    assert one(spark, H.fnv64("t"), t="a") == 0xAF63DC4C8601EC8C - (1 << 64)
    assert list(H.simhash_many(["", "A b, c", "a B c"])) == [0, H.simhash_many(["a b c"])[0], H.simhash_many(["a b c"])[0]]


def test_near_pairs_equal_brute_force(spark):
    import random

    random.seed(5)
    base = [random.getrandbits(63) for _ in range(20)]
    hs = [b ^ sum(1 << random.randrange(63) for _ in range(random.randint(0, 4))) for b in base for _ in range(4)] + [0, 0]
    df = spark.createDataFrame(list(enumerate(hs)), "id bigint, simhash bigint")
    got = {frozenset(r[:2]) for r in dedup.near_pairs(df).collect()}
    want = {frozenset((i, j)) for i, a in enumerate(hs) for j, b in enumerate(hs) if i < j and a and b and (a ^ b).bit_count() <= 3}
    assert got <= want
    # copies of one hash meet through their first, so classes agree though pairs are fewer
    def classes(pairs):
        up = list(range(len(hs)))
        def find(x):
            while up[x] != x:
                x = up[x]
            return x
        for p in pairs:
            a, b = sorted(p)
            up[find(b)] = find(a)
        return [find(i) for i in range(len(hs))]
    assert len(set(classes(got))) == len(set(classes(want)))
    with pytest.raises(ValueError):
        dedup.near_pairs(df, bits=4)


def test_leaders_are_not_transitive(spark):
    df = spark.createDataFrame([(0, 0b1), (1, 0b1111), (2, 0b1111111)], "id bigint, simhash bigint")
    pairs = dedup.near_pairs(df)
    got = {r.id: r.duplicate_of for r in dedup.leaders(df, pairs).collect()}
    assert got == {0: None, 1: 0, 2: None}


def test_leaders_of_copies_equal_brute_force(spark):
    import random

    random.seed(6)
    base = [random.getrandbits(63) for _ in range(3)]
    hs = [b ^ sum(1 << random.randrange(8) for _ in range(random.randint(0, 3))) for b in base for _ in range(30)]
    random.shuffle(hs)
    for hashes in ([0b1111, 0b111, 0b111, 0b111, 0, 0], hs):
        df = spark.createDataFrame(list(enumerate(hashes, 1)), "id bigint, simhash bigint")
        want: dict = {}
        for i, h in enumerate(hashes, 1):
            want[i] = next((j for j in want if want[j] is None and h and hashes[j - 1] and (h ^ hashes[j - 1]).bit_count() <= 3), None)
        rows = dedup.leaders(df, dedup.near_pairs(df)).collect()
        assert len(rows) == len(hashes) and {r.id: r.duplicate_of for r in rows} == want


@pytest.mark.parametrize("name, plan", [("st_tumbling_stream", events.tumbling), ("st_sliding_stream", events.sliding), ("st_session_stream", events.sessions)])
def test_streams_equal_batch(spark, name, plan):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    want, got = plan(batch), pages.QUERIES[name](spark, SF)
    assert got.columns == want.columns and want.count() > 0
    key = [c for c in want.columns if c != "total"]
    rows, same = ({tuple(r[c] for c in key): r for r in df.collect()} for df in (got, want))
    assert len(rows) == got.count() and set(rows) == set(same)
    if "total" in got.columns:
        assert all(abs(r.total - same[k].total) < 1e-3 for k, r in rows.items())


def test_streams_keep_the_last_complete_result(spark, tmp_path):
    one = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(3):
        one.filter(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    rows = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    got = events.drain(events.sliding(rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")), "complete")
    want = events.sliding(one.withColumn("at", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_integrity(spark):
    long = " ".join(f"word{'abcdefghij'[i % 10]} and thing{i}" for i in range(60))
    rows = [(1, long), (2, "short"), (3, long + " ..."), (4, "spam now " * 120), (5, None)]
    out = quality.assess(spark.createDataFrame(rows, "id int, text string"))
    got = {r.id: (r.verdict, set(r.reasons)) for r in out.collect()}
    assert got[1] == ("full", set()) and got[2][0] == "thin" and "thin_text" in got[2][1] and got[3][0] == "partial" and "repetitive" in got[4][1] and got[5][0] == "thin"


def test_html_parts():
    p = html.page_parts(
        "<html lang=en><head><title> A  b </title><meta property='og:title' content='Og'><script>var t='</p>';</script></head><body><nav><a href='/n'>Nav</a></nav>"
        "<h1>Head</h1><p>One <b>two</b><p>Three<div style='display:none'>secret</div><a href='x#f' rel=nofollow>go</a><a href='javascript:x'>no</a>"
        "<table><tr><th>k<th>v<tr><td>1<td>2</table>", "http://e.com/d/",
    )
    assert p["title"] == "A b" and "secret" not in p["text"] and "Nav" not in p["main_text"] and p["paragraphs"] == 2
    assert [x["url"] for x in p["links"]] == ["http://e.com/n", "http://e.com/d/x"] and p["links"][1]["nofollow"]
    assert p["tables"] == [{"caption": None, "header": ["k", "v"], "rows": [["1", "2"]]}] and "# Head" in p["markdown"] and "**two**" in p["markdown"]
    assert html.page_parts(None, None)["text"] == ""
    html.page_parts("<a><p>" * 5000, "http://e.com")


def test_captions(spark):
    body = "WEBVTT\n\n00:01.000 --> 00:02.500\n<c>Hello</c> there\n\n01:00:00,000 --> 01:00:01,000\nEnd\n"
    got = feeds.caption_cues(spark.createDataFrame([(1, body)], "k int, b string"), "k", "b").orderBy("start").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(1.0, 2.5, "Hello there"), (3600.0, 3601.0, "End")]


def test_csv_guard(spark):
    assert [one(spark, export.guarded(F.col("t")), t=x) for x in ("=1+1", "-5", "-x", "ok")] == ["'=1+1", "-5", "'-x", "ok"]


def test_fusion_ignores_order(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "b", 1)]
    got = {r.k: round(r.score, 9) for r in retrieval.fuse(spark.createDataFrame(rows, "q int, k string, r int"), "q", "k", "r").collect()}
    assert got == {"a": round(1 / 61, 9), "b": round(1 / 61 + 1 / 62, 9)}
