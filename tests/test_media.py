"""Moments, DASH timelines, storyboards and the state machines' odd inputs against plain loops."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tidemark.operators import moments
from tidemark.sources import dash


def folded(t):
    return "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))


def plain_hits(passages, query):
    every = [w for w in re.findall(r"[^\W_]+", folded(query)) if len(w) >= 2]
    want = sorted({w for w in every if w not in moments.EMPTY_WORDS}) or sorted(set(every))
    out = []
    for at, text in passages:
        have = [(m.start(), m[0]) for m in re.finditer(r"[^\W_]+", folded(text))]
        same = lambda h, w: h == w or (len(h) >= 4 <= len(w) and (h.startswith(w) or w.startswith(h)))
        found = [next(p for p, h in have if same(h, w)) for w in want if any(same(h, w) for _, h in have)]
        if want and found and len(found) / len(want) >= 0.5:
            low, high = max(0, min(found) - 60), min(min(found) + 140, len(text))
            out.append((at, round(len(found) / len(want), 6), ("…" if low else "") + " ".join(text[low:high].split()) + ("…" if high < len(text) else "")))
    return out


def test_moments_equal_a_scan(spark):
    rng = random.Random(4)
    words = "Result results resulting table comfortable the of señal señales río rio cat cats lantern lant a be".split()
    passages = [(v, k, " ".join(rng.choice(words) + rng.choice(["", ",", "  ", "\n"]) for _ in range(rng.randint(0, 90)))) for v in range(6) for k in range(12)] + [(9, 0, "alone"), (9, 1, "")]
    queries = [(0, "the result"), (1, "the of"), (2, "Señal table lantern zzz"), (3, "río cat"), (4, "a"), (5, ""), (9, "alone"), (77, "result")]
    got = moments.moments(spark.createDataFrame(passages, "v int, k int, t string"), spark.createDataFrame(queries, "v int, q string"), "v", "k", "t", "q").collect()
    want = [(v, *hit) for v, q in queries for hit in plain_hits([(k, t) for w, k, t in passages if w == v], q)]
    assert sorted((r.v, r.k, round(r.score, 6), r.snippet) for r in got) == sorted(want) and len(want) > 20


def test_timelines(spark):
    rng = random.Random(2)
    rows, want = [], []
    for k in range(12):
        at, entries, place, scale = 0, [], 0, rng.choice([1, 10, 90000])
        for _ in range(rng.randint(1, 6)):
            d, r = rng.randint(1, 50), rng.choice([None, 0, 1, 4, -1])
            if rng.random() < 0.3:
                at += rng.randint(0, 100)
                t = f't="{at}" '
            else:
                t = ""
            entries.append(f'<S {t}d="{d}"' + (f' r="{r}"' if r is not None else "") + "/>")
            for _ in range(max(0, r or 0) + 1):
                want.append((k, place, f"{place + 3}/{at}", round(at / scale, 6), round(d / scale, 6)))
                place, at = place + 1, at + d
        audio = '<AdaptationSet mimeType="audio/mp4"><SegmentTemplate media="no"><SegmentTimeline><S d="1"/></SegmentTimeline></SegmentTemplate></AdaptationSet>'
        rows.append((k, f'<MPD><Period>{audio}<AdaptationSet mimeType="video/mp4"><SegmentTemplate timescale="{scale}" startNumber="3" media="$Number$/$Time$"><SegmentTimeline>{"".join(entries)}</SegmentTimeline></SegmentTemplate></AdaptationSet></Period></MPD>'))
    rows += [(90, "<html/>"), (91, ""), (92, None), (93, "not xml <")]
    got = dash.segments(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()
    assert sorted((r.id, r.place, r.uri, round(r.start, 6), round(r.seconds, 6)) for r in got) == sorted(want)


def test_storyboards(spark):
    specs = [
        (1, "https://a.test/$L/$N?v=1|10#10#4#2#2#1000#M$M#sig", None), (2, "https://a.test/$N|1#1#9#3#3#0#p$M#", 90.0), (3, "https://a.test/$N|1#1#9#3#3#0#p#", None), (4, "https://a.test/x", 5.0),
        (5, "t|1#1#0#3#3#5#p#", 5.0), (6, "t|1#1#4#3", 5.0), (7, None, 5.0), (8, "t|1#1#5#1#1#200#s$M#|2#2#3#2#1#400#b$M#z", 5.0),
    ]
    got = {}
    for r in dash.storyboard(spark.createDataFrame(specs, "id int, spec string, seconds double"), "id", "spec", "seconds").orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.place, round(r.t, 6), r.sheet, r.x, round(r.y, 6), r.w, r.h))
    assert set(got) == {1, 2, 8}
    assert got[1] == [(k, float(k), "https://a.test/0/M0?v=1&sigh=sig", k % 2 / 2, k // 2 / 2, 0.5, 0.5) for k in range(4)]
    assert [g[:3] for g in got[2]] == [(k, 10.0 * k, "https://a.test/p0") for k in range(9)] and got[8][2][:4] == (2, 0.8, "t?sigh=z", 0.0) and len(got[8]) == 3


def test_flat_rows_of_pages(spark):
    from tidemark.operators import export

    kind = "id int, url string, items array<string>, tables array<struct<header:array<string>,rows:array<array<string>>>>"
    rows = [
        (1, "https://e.test/a", ['{"name": "x", "n": 1}', '{"url": "own", "z": [1]}', "{}"], [(["h", " ", "h"], [["1", "2", "3", "4"]]), ([], [["a"], []])]), (2, None, None, None), (3, None, ['{"q": null}'], []),
    ]
    flat = export.flat_rows(spark.createDataFrame(rows, kind), "id", "url", "items", "tables").cache()
    got = {(r.id, r.place): r.record for r in flat.collect()}
    assert got == {
        (1, 0): '{"url":"https://e.test/a","name": "x", "n": 1}', (1, 1): '{"url": "own", "z": [1]}', (1, 2): '{"url":"https://e.test/a"}', (1, 3): '{"url":"https://e.test/a","table":"1","col2":"2","h":"3","col4":"4"}',
        (1, 4): '{"url":"https://e.test/a","table":"2","col1":"a"}', (1, 5): '{"url":"https://e.test/a","table":"2"}', (3, 0): '{"url":null,"q": null}',
    }
    lines = [r.line for r in export.csv_lines(flat, ["id", "place"], "record").orderBy(F.col("id").asc_nulls_first(), "place").collect()]
    assert lines[0] == "url,name,n,z,table,col2,h,col4,col1,q" and lines[1] == "https://e.test/a,x,1,,,,,,," and lines[2] == "own,,,[1],,,,,," and {x.count(",") for x in lines} == {9}
    none = spark.createDataFrame([], "k int, r string")
    assert export.csv_lines(none, ["k"], "r").collect() == []
    odd = spark.createDataFrame([(1, "{\"it's\": 1, \"a.b\": \"x\\ny\", \"q\\\"q\": 2}"), (2, "broken"), (3, None), (4, "[1]")], "k int, r string")
    assert [r.line for r in export.csv_lines(odd, ["k"], "r").orderBy(F.col("k").asc_nulls_first()).collect()] == ['it\'s,a.b,"q""q"', '1,"x\ny",2', ",,", ",,", ",,"]
