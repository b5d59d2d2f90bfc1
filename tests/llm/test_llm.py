"""Training-data operators against brute force on small tables, with nulls, ties, repeats and clashing columns."""

import array
import hashlib
import io
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bagminhash as bag
from tidemark.llm import decontaminate as cgk
from tidemark.llm import imatch, quote_link, secret_scan, site_quality, source_mix, sstable, token_shards, toxicity, url_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, t string, th int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1) for i, t, s in rows], DOCS)


def DOCS_OF(spark, cache={}):  # noqa: B006, N802
    if not cache:
        cache["rows"] = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return cache["rows"]


ODD = [(1, "alpha beta gamma delta epsilon zeta", "a"), (None, "alpha beta", None), (2, None, "a"), (3, "", "b"), (1, "alpha beta gamma delta epsilon zeta", "a"), (4, "word " * 40_000, "a"), (-5, "ñandú  \n tab\t😀 end ", "b")]


# 1 ----------------------------------------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_shards.default_vocabulary())


def test_encoder_is_the_library():
    tok, enc, rng = tokenizer(), sstable.encoder(token_shards.default_vocabulary()), random.Random(1)
    alphabet = " \n\t\r\x0b\x1c\x85\xa0  ab1²½é's,.<|endoftext|>"
    for _ in range(3000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16)))
        assert enc(x) == array.array("I", tok.encode(x, add_special_tokens=False).ids).tobytes(), repr(x)
    special = "a <|endoftext|> b"
    assert enc(special) == array.array("I", tok.encode(special, add_special_tokens=False).ids).tobytes()


def test_sstable_round_trip_and_lookup():
    keys = sorted([None, *range(-50, 2000, 7), 40, 40], key=lambda k: (k is not None, k or 0))
    sink = io.BytesIO()
    w = sstable.Writer(sink, 256)
    for i, k in enumerate(keys):
        w.add(sstable.key_of(k), array.array("I", range(i % 9)).tobytes())
    w.close()
    r = sstable.Reader(sink, sink.tell())
    got = [(sstable.id_of(k), len(v) // 4) for b in range(len(r.blocks)) for k, v in r.block(b)]
    assert got == [(k, i % 9) for i, k in enumerate(keys)] and len(r.blocks) > 5
    assert all(len(r.get(k)) == keys.count(k) for k in keys)
    assert len(r.get(40)) == 2 and len(r.get(None)) == 1 and r.get(43) == [] and r.get(10**9) == []
    with pytest.raises(ValueError):
        w.add(sstable.key_of(None), b"")


@pytest.mark.parametrize("rows", [ODD, []])
def test_token_table(spark, rows):
    tok = tokenizer()
    got = token_shards.token_table(table(spark, rows)).orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_token_lookup(spark):
    docs = table(spark, [*ODD, (5, "a <|endoftext|> b", "a")])
    manifest = token_shards.write_shards(docs, token_shards.scratch(spark, "t"), token_shards.default_vocabulary(), block_bytes=16)
    ids = spark.createDataFrame([(1,), (None,), (5,), (77,), (-5,)], "doc_id bigint")
    got = token_shards.lookup(manifest, ids).collect()
    want = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_shards.read_shards(manifest).collect() if r.doc_id in (1, None, 5, -5)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) == 5


# 2 ----------------------------------------------------------------------------------------------------------


def test_imatch_order_and_edits(spark):
    rows = ODD
    got = sorted(imatch.fingerprints(table(spark, rows)).collect(), key=lambda r: (r.id is not None, r.id or 0))
    texts = [t or "" for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    for r, a, b in zip(got, texts, texts[1:] + texts[:1], strict=True):
        n = len(a)
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256((a[: n - n // 2] + b[: n // 2]).encode()).hexdigest()
    same = [r.own for r in got if r.id == 1]
    assert same[0] == same[1]
    assert imatch.fingerprints(table(spark, [])).count() == 0
    one = imatch.fingerprints(table(spark, ODD[:1])).first()
    assert one.edited_sha256 == hashlib.sha256((ODD[0][1][:18] + ODD[0][1][:17]).encode()).hexdigest() and one.next == one.own


def test_imatch_prints_equal_brute_force(spark):
    """Band, thinned lexicons and the order of terms, recomputed term by term; only the hash itself is Spark's."""
    docs = spark.createDataFrame(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    hashes = {w: None for t in text.values() for w in re.findall(r"[^\W_]+", t.lower())}
    for r in spark.createDataFrame([(w,) for w in hashes], "w string").select("w", F.xxhash64("w").alias("h"), imatch.kept_by(F.xxhash64("w")).alias("k")).collect():
        hashes[r.w] = (r.h, r.k)
    sets = {i: {hashes[w] for w in re.findall(r"[^\W_]+", t.lower())} for i, t in text.items()}
    df = {}
    for s in sets.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    n = len(text)
    band = {x for x, k in df.items() if max(2, n * math.exp(-6.9)) <= k <= n * math.exp(-1.6)}
    lists = []
    for i, s in sets.items():
        own = sorted(s & band)
        lists.append((i, [h for h, _ in own] or [h for h, _ in sorted(s)], [[h for h, k in own if k >> j & 1] for j in range(imatch.N_SUBSETS)]))
    want = spark.createDataFrame(lists, "id bigint, w array<bigint>, s array<array<bigint>>")
    want = {r.id: (r.w, r.s) for r in want.select("id", F.xxhash64("w").alias("w"), F.transform("s", lambda x: F.when(F.size(x) > 0, F.xxhash64(x))).alias("s")).collect()}
    got = imatch.fingerprints(docs).collect()
    for r in got:
        if sets[r.id]:
            assert (r.own.whole, r.own.subsets) == want[r.id]
    widths = [sum(k >> j & 1 for _, k in hashes.values()) / len(hashes) for j in range(imatch.N_SUBSETS)]
    assert all(abs(x - w / 256) < 4 * math.sqrt(w / 256 / len(hashes)) for x, w in zip(widths, imatch.WIDTHS, strict=True))
    by = {r.id: r for r in got}
    ids = sorted(by)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        assert by[a].next == by[b].own


def test_imatch_likeness(spark):
    out = imatch.op2_imatch(spark, SF).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert sum(r.near_edited for r in out) > 5 * sum(r.near_next for r in out)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {}
    for r in out:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


# 3 ----------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(300)]

    def text(bad):
        s = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randint(1, 12))]
        if bad:
            s.insert(rng.randrange(len(s) + 1), " ".join([*rng.choices(plain, k=4), rng.choice(["vile", "grosslich", "grosser", "grosso"])]))
        return ". ".join(s) + "."

    rows = [(i, text(i % 5 == 0), "a") for i in range(600)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    weights, bias = toxicity.train(docs, labels, learn=lambda k: k % 3 != 1)
    got = {r.id: r for r in toxicity.score_documents(docs, weights, bias).collect() if r.id % 3 == 1}
    assert np.mean([(r.score >= 0.7) == (i % 5 == 0) for i, r in got.items()]) > 0.97
    for i, r in got.items():
        if i % 5 == 0 and r.score >= 0.7:
            assert re.search("vile|gross", rows[i][1][r["at"] : r.upto])


def test_toxicity_is_not_length(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    sentence = lambda: " ".join(rng.choices(plain, k=8))
    texts = [". ".join([sentence() for _ in range(rng.randint(1, 12))] + ["so vile"] * (i % 5 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    weights, bias = toxicity.train(table(spark, [(i, t, "a") for i, t in enumerate(texts)]), labels)
    score = toxicity.scorer(weights, bias)
    clean = "calm words here. " * 50_000
    assert score(clean) == (0.0, 0.0, None, None)
    assert score(". ".join(sentence() for _ in range(50_000)))[0] < 0.7
    assert score(clean + "so vile")[0] >= 0.7 and score(clean + "so vile")[2] == len(clean) - 1
    assert np.mean([(score(t)[0] >= 0.7) == (i % 5 == 0) for i, t in enumerate(texts)]) > 0.99


def test_toxicity_counts_and_scores_equal_brute_force(spark):
    rng = random.Random(15)
    rows = [(i, ". ".join(" ".join(rng.choices(["calm", "blue", "vile", "grim", "sea"], k=3)) for _ in range(rng.randint(1, 4))), "a") for i in range(300)]
    toxic = {i: int("vile" in t) for i, t, _ in rows}
    docs, labels = table(spark, rows), spark.createDataFrame(list(toxic.items()), "doc_id bigint, toxic int")
    sample = toxicity.sample_bags(docs, labels, "doc_id", "text", "toxic", lambda k: F.lit(True), 4000)
    df, pos, base = {}, {}, np.mean(list(toxic.values()))
    for i, t, _ in rows:
        for x in {x for w in re.findall(r"\w+", t) for x in toxicity.word_features(w)}:
            df[x], pos[x] = df.get(x, 0) + 1, pos.get(x, 0) + toxic[i]

    def gain(x):
        q = pos[x] / df[x]
        return df[x] * ((q * math.log(q / base) if q else 0) + ((1 - q) * math.log((1 - q) / (1 - base)) if q < 1 else 0))

    bar = math.log(max(2, sum(n > 2 for n in df.values()))) - 1
    assert toxicity.telling(sample) == sorted(x for x in df if pos[x] / df[x] > base and gain(x) > bar)
    weights, bias = toxicity.train(docs, labels)
    for r in toxicity.score_documents(docs, weights, bias).collect():
        quiet = 1.0
        for s in rows[r.id][1].split("."):
            hits = {x for w in re.findall(r"\w+", s) for x in toxicity.word_features(w) if x in weights}
            quiet *= 1 - (1 / (1 + math.exp(-bias - sum(weights[x] for x in hits))) if hits else 0)
        assert abs(r.score - (1 - quiet)) < 1e-9


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    weights, bias = toxicity.train(table(spark, ODD), labels)
    got = toxicity.score_documents(table(spark, ODD), weights, bias).collect()
    assert len(got) == len(ODD) and all(r.score < 1e-6 for r in got)
    assert toxicity.drop_toxic(table(spark, ODD), weights, bias).count() == len(ODD)


# 4 ----------------------------------------------------------------------------------------------------------

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 8, 2),
    ("access", re.compile("AKIA[A-Z0-9]+"), 16, 0), ("hex", re.compile("[0-9a-f]+"), 32, 0),
]


def test_secret_scan_base_equals_brute_force(spark):
    rng = random.Random(3)
    bits = ["password=", "Secret: ", "token", "api_key = '", "abcdef12", "AKIA", "Z9" * 7, "0123456789abcdef" * 2, " ", "\n", "é😀", "x.", "=", ":", "tokén"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14))), "a") for i in range(300)] + [(None, None, None), (1000, "secret: token: abcdefgh12", "a")]
    for r in secret_scan.secret_spans(table(spark, rows)).collect():
        text = next((t for i, t, _ in rows if i == r.id), "") or ""
        want = sorted((m.start(), k, m.end()) for k, (_, p, n, g) in enumerate(PATTERNS) for m in p.finditer(text) if len(m[g]) >= n)
        assert [(x.start, x.rank, x.end) for x in r.base] == want, text


def test_secret_spans_are_linear_and_whole(spark):
    rng = random.Random(21)
    many = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(20_000))
    mess = "".join(rng.choice(["é ", "x", "0123456789abcdef" * 2 + " ", "AKIA" + "Q7" * 8 + "\n", "token=abcdefgh9 "]) for _ in range(3000))
    rows = [(1, many, "a"), (2, mess, "a"), (2, mess, "a"), (3, "", "a")]
    began = time.perf_counter()
    got = secret_scan.secret_spans(table(spark, rows)).collect()
    assert time.perf_counter() - began < 60
    for r in got:
        text = {1: many, 2: mess, 3: ""}[r.id]
        want = sorted((m.start(), k, m.end()) for k, (_, p, n, g) in enumerate(PATTERNS) for m in p.finditer(text) if len(m[g]) >= n)
        assert [(x.start, x.rank, x.end) for x in r.base] == want
    assert len(got) == 4 and secret_scan.secret_spans(table(spark, [])).count() == 0


def test_secret_digest_columns(spark):
    for r in secret_scan.op4_secret_scan(spark, SF).collect():
        text = next(d.text for d in DOCS_OF(spark) if d.doc_id == r.doc_id) or ""
        spans = sorted((m.start(), k, m.end()) for k, (_, p, n, g) in enumerate(PATTERNS) for m in p.finditer(text) if len(m[g]) >= n)
        base = [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [x for x in every if not x.startswith("entropy")] == base and len(every) - len(base) == r.n_entropy
        starts = [int(x.split(":")[1]) for x in every]
        assert starts == sorted(starts) and [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]


def entropy(window):
    n = len(window)
    return -sum(window.count(c) / n * math.log2(window.count(c) / n) for c in set(window))


def test_peak_entropy_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices(secret_scan.ALPHABET[: rng.randint(2, 66)], k=rng.randint(20, 60))) for _ in range(40)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", secret_scan.peak_entropy(F.col("w")).alias("h")).collect()
    for r in got:
        assert abs(r.h - max(entropy(r.w[i : i + 20]) for i in range(len(r.w) - 19))) < 1e-9


def test_secret_scan_adds_and_suppresses(spark):
    rows = [(1, "see q8ZkP2vX7mN4rT9wB3yL6dF1hJ5 here", "a"), (2, "go to some/long/path/with/many/parts/here", "a"), (3, "id 00000000000000000000000000000000000", "a"), (4, "Donaudampfschiffahrtsgesellschaft", "a")]
    got = {r.id: len(r.added) for r in secret_scan.secret_spans(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0}


def test_secret_scan_adds_secrets_of_every_class(spark):
    rng = random.Random(11)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = [digits, digits + "ABCDEF", lower, upper, lower + upper, lower + upper + digits, secret_scan.ALPHABET]
    rows = [(k * 1000 + i, f"see {''.join(rng.choices(kind, k=30))} here", "a") for k, kind in enumerate(kinds) for i in range(200)]
    words = ["Unabhaengigkeitserklaerungen", "internationalisationprocesses", "getElementsByClassNameAndIndex", "CONSTITUTIONALREPRESENTATIVES", "01234567890123456789"]
    rows += [(-k, f"see {w} here", "a") for k, w in enumerate(words, 1)]
    found = {r.id: len(r.added) for r in secret_scan.secret_spans(table(spark, rows)).collect()}
    share = [np.mean([found[k * 1000 + i] for i in range(200)]) for k in range(len(kinds))]
    assert min(share) >= 0.9, share
    assert not any(found[-k] for k in range(1, len(words) + 1))


# 5 ----------------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.org/es/1?x", "http://example.org/en/12", "https://example.org", "x.com/fr/", None, "http://b.com/de/#f", "ftp://notexample.org/es/", "http://h/p?://z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "url string, bad boolean")
    got = {r.id: r for r in url_rules.judge_urls(pages, none).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1].rule == "example.org/en/1" and got[2].rule is None and got[2].path == "" and got[3].host == "" and got[4].verdict == "allow"
    assert got[5].rule == "com/de/" and got[6].rule == "org/" and got[7].host == "h"


def test_mined_rules(spark):
    rows = [(f"http://s{i % 7}.bad.net/en/{i}?ref=x", i % 10 != 0) for i in range(200)] + [(f"http://s{i % 7}.good.net/en/{i}", i % 10 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_rules.mine_rules(df).collect()
    assert rules and not any(set(a.tokens) < set(b.tokens) and a.confidence >= b.confidence for a in rules for b in rules)
    pages = spark.createDataFrame([(1, "http://new.bad.net/en/5?ref=x"), (2, "http://new.good.net/en/5")], "page_id bigint, url string")
    assert {r.id: r.verdict for r in url_rules.judge_urls(pages, df, rules=[("allow", "zzz", "/")]).collect()} == {1: "block", 2: "allow"}


def test_mined_rules_equal_counted_itemsets(spark):
    from itertools import combinations

    rng = random.Random(25)
    rows = []
    for _ in range(400):
        site, page = rng.choice(["a.net", "b.net", "b.org"]), rng.choice(["x", "y", "z"])
        rows.append((f"http://{site}/{page}?k=1", rng.random() < (0.9 if (site, page) in {("b.net", "x"), ("a.net", "y")} else 0.2)))
    tokens = {u: [f"h:{x}" for x in u.split("/")[2].split(".")] + [f"p:{u.split('/')[3][0]}", "q:k"] for u, _ in rows}
    n, base = len(rows), sum(b for _, b in rows) / len(rows)
    counts = {}
    for u, b in rows:
        for k in range(1, 5):
            for c in combinations(sorted(tokens[u]), k):
                t = counts.setdefault(c, [0, 0])
                t[0], t[1] = t[0] + 1, t[1] + b
    keep = {}
    for c, (m, bad) in counts.items():
        conf = bad / m
        if bad / n >= 0.002 and conf >= 0.5 and conf / base >= 1.2 and conf - 2 * math.sqrt(conf * (1 - conf) / m) - 1 / m > base:
            keep[c] = conf
    want = {c for c in keep if not any(set(d) < set(c) and keep[d] >= keep[c] - 1e-12 for d in keep)}
    got = {tuple(r.tokens) for r in url_rules.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert got == want and got


def test_urls_repeat_and_empty(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (2, None), (3, "")], "page_id bigint, url string")
    assert url_rules.judge_urls(pages, none).count() == 4 and url_rules.judge_urls(pages.limit(0), none).count() == 0


# 6 ----------------------------------------------------------------------------------------------------------


def shrunk(counts, parents):
    n = np.array([c[0] for c in counts], float)
    g, m = np.array([c[1] for c in counts], float), np.array(parents, float)
    spread = (n * ((g / n - m) ** 2 - m * (1 - m) / n)).sum() / n.sum()
    k = max((n * m * (1 - m)).sum() / n.sum() / max(spread, 1e-4) - 1, 1.0)
    return (g + k * m) / (n + k)


def test_site_posteriors_equal_brute_force(spark):
    rng = random.Random(26)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"])) for i in range(300)]
    y = {i: int(rng.random() < {"a": 0.9, "b": 0.5}.get(h, 0.2) + (0.1 if p == "x" else 0)) for i, h, p in rows}
    docs = spark.createDataFrame([(i, f"text of {i}", h, p) for i, h, p in rows], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame(list(y.items()), "doc_id bigint, quality int")
    rate = np.mean(list(y.values()))
    hosts, paths = sorted({h for _, h, _ in rows}, key=str), sorted({(h, p) for _, h, p in rows}, key=str)
    count = lambda f: (sum(map(f, rows)), sum(y[r[0]] for r in rows if f(r)))
    of_host = dict(zip(hosts, shrunk([count(lambda r, h=h: r[1] == h) for h in hosts], [rate] * len(hosts)), strict=True))
    of_path = dict(zip(paths, shrunk([count(lambda r, k=k: r[1:] == k) for k in paths], [of_host[h] for h, _ in paths]), strict=True))
    logit = lambda p: math.log(p / (1 - p))
    where = {i: (h, p) for i, h, p in rows}
    for r in site_quality.site_scores(docs, labels).collect():
        h, p = where[r.id]
        assert abs(r.host_rate - of_host[h]) < 1e-9 and abs(r.path_rate - of_path[h, p]) < 1e-9
        own = min(max(r.own, 1e-6), 1 - 1e-6)
        assert abs(r.score - 1 / (1 + math.exp(-(logit(own) + logit(r.path_rate) - logit(rate))))) < 1e-9


def test_sites_of_pages(spark):
    docs = table(spark, [(7, "x", "src"), (8, "y", "src"), (None, None, None), (9, "word " * 30_000, "src")])
    pages = spark.createDataFrame([("http://b.org/en/7",), ("http://a.org/de/7.html",), ("no url",), (None,)], "url string")
    got = {r.doc_id: (r.host, r.path) for r in site_quality.with_sites(docs, pages).collect()}
    assert got == {7: ("a.org", "de"), 8: ("src", "en"), None: (None, "en"), 9: ("src", "en")}
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert site_quality.site_scores(docs.limit(0), labels).count() == 0


def test_site_rates_shrink(spark):
    docs = spark.createDataFrame([(i, "a fine text of words", "p", f"h{i % 2}" if i < 400 else "new", 0) for i in range(401)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or i % 5 == 0)) for i in range(400)], "doc_id bigint, quality int")
    got = {r.id: r for r in site_quality.site_scores(docs, labels).collect()}
    mean = np.mean([int(i % 2 == 0 or i % 5 == 0) for i in range(400)])
    assert got[0].host_rate > 0.9 and 0.15 < got[1].host_rate < 0.4 and abs(got[400].path_rate - mean) < 1e-9
    assert len(site_quality.site_scores(table(spark, ODD), labels.limit(0)).collect()) == len(ODD)


def test_site_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in site_quality.op6_site_quality(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.keep == labels[r.doc_id] for r in got]) > 0.95


# 7 ----------------------------------------------------------------------------------------------------------


def targets(sizes, weights):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    rest = total
    while open_:
        unit = rest / sum(w[s] for s in open_)
        over = [s for s in open_ if unit * w[s] > 3 * sizes[s]]
        if not over:
            return out | {s: unit * w[s] for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            rest -= out[s]
            open_.discard(s)
    return out


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(500)] + [(9000, "one two three", "tiny"), (9001, None, "a"), (3, "x y", "a"), (3, "x y", "a")]
    got = source_mix.taken_words(table(spark, rows), [1, 2, 3]).collect()
    again = source_mix.taken_words(table(spark, rows), [1, 2, 3]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want, by, of = targets(size, [1, 2, 3]), dict.fromkeys(size, 0), {i: s for i, _, s in rows}
    for r in got:
        assert r.taken <= 3 * r.size and r.target == pytest.approx(want[of[r.id]])
        by[of[r.id]] += r.taken
    for s, taken in by.items():  # quotas are whole blocks, and one block of a source is short
        assert abs(taken - want[s]) <= 1.5 * max(1, min(64, size[s] // 1024))
    assert source_mix.taken_words(table(spark, []), [1, 2, 3]).count() == 0


def test_hypergeometric_moments(spark):
    x = spark.range(20_000).select(source_mix.hypergeometric(F.lit(300), F.lit(1000), F.lit(400), F.lit(1), F.col("id")).alias("x")).toPandas().x
    assert abs(x.mean() - 120) < 0.4 and abs(x.std() - math.sqrt(400 * 0.3 * 0.7 * 600 / 999)) < 0.2


def test_shards_hold_equal_exact_quotas(spark):
    rows = [(i, "w " * 50, f"s{i % 3}") for i in range(300)]
    _, draws = source_mix.plan_mix(table(spark, rows), [1, 2, 3], shards=8)
    n = draws.filter("words > 0").groupBy("shard").agg(F.count_distinct("source", "order_key").alias("n")).collect()
    assert len(n) == 8 and max(r.n for r in n) - min(r.n for r in n) <= 1


def test_mix_is_drawn_by_the_leaves_of_the_tree(spark):
    rng = random.Random(27)
    rows = [(i, "w " * rng.randint(1, 90), f"s{i % 3}") for i in range(300)] + [(1000, "w " * 30_000, "s0"), (1001, None, "s1"), (None, "w w", None)]
    docs = table(spark, rows)
    placed, draws = source_mix.plan_mix(docs, [1, 2, 3], shards=8)
    per = source_mix.source_targets(placed.select("source", "size"), [1, 2, 3], 64)
    ends = {r["rank"]: r.ends for r in source_mix.shard_intervals(per, 8, 7).collect()}
    rank = {r.source: (r["rank"], r.quota) for r in per.collect()}
    leaf = {(s, k): ends[a][k] - (ends[a][k - 1] if k else 0) for s, (a, _) in rank.items() for k in range(8)}
    assert all(ends[a][-1] == q for a, q in rank.values())
    blocks = draws.groupBy("source", "shard").agg(F.count_distinct("order_key").alias("n")).collect()
    assert {(r.source, r.shard): r.n for r in blocks} == {k: n for k, n in leaf.items() if n}
    mix = source_mix.mixed_blocks(draws).collect()
    by_shard = {}
    for r in mix:
        by_shard.setdefault(r.shard, []).append((r.pos, r.order_key, r.source, r.words))
    for v in by_shard.values():
        v.sort()
        assert [p for p, *_ in v] == list(range(len(v))) and [k for _, k, *_ in v] == sorted(k for _, k, *_ in v)
        assert len({s for *_, s, _ in v[: len(v) // 2]}) > 1  # sources stand mixed
    words = {}
    for r in mix:
        words[r.source, r.shard] = words.get((r.source, r.shard), 0) + r.words
    got = source_mix.taken_words(docs, [1, 2, 3], shards=8).collect()
    of, sums = {i: s for i, _, s in rows}, {}
    for r in got:
        shares = [tuple(map(int, x.split(":"))) for x in r.shard_words.split(",") if x]
        assert sum(n for _, n in shares) == r.taken <= 3 * r.size
        for k, n in shares:
            sums[of[r.id], k] = sums.get((of[r.id], k), 0) + n
    assert sums == words


def test_mixed_documents_stand_in_shard_order(spark):
    rows = [(i, "w " * (30 + i % 40), f"s{i % 3}") for i in range(400)]
    docs = table(spark, rows)
    placed, draws = source_mix.plan_mix(docs, [1, 2, 3], shards=8)
    key = {(r.source, r.offset): r.id for r in placed.collect()}
    want = {}
    for r in draws.filter("first").collect():
        want.setdefault(r.shard, []).append((r.order_key, key[r.source, r.offset]))
    got = source_mix.mixed_documents(docs, [1, 2, 3], shards=8).select(F.spark_partition_id().alias("p"), "doc_id").collect()
    runs = [[i for _, i in sorted(v)] for v in want.values()]
    seen = {}
    for r in got:
        seen.setdefault(r.p, []).append(r.doc_id)
    flat = [",".join(map(str, v)) for v in seen.values()]
    assert sum(map(len, seen.values())) == sum(map(len, runs)) and all(any(",".join(map(str, r)) in f for f in flat) for r in runs)


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 97, 1000):
        got = spark.range(n).select(source_mix.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mixed_documents_keep_columns(spark):
    docs = table(spark, ODD)
    out = source_mix.mixed_documents(docs, [1, 2, 3])
    assert out.columns == docs.columns and out.filter("doc_id = 3").count() == 1


# 8 ----------------------------------------------------------------------------------------------------------


def test_cgk_recall_and_bound():
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 50)))) for i in range(60)]
    index = cgk.Index(items)
    for share, least in ((0.0, 1.0), (0.1, 0.97), (0.2, 0.9)):
        texts = []
        for _, t in items:
            w = t.split()
            for _ in range(int(share * len(w))):
                p, op = rng.randrange(len(w)), rng.choice("ids")
                w[p : p + (op != "i")] = [] if op == "d" else [rng.choice(vocab)]
            texts.append(" ".join(rng.choices(vocab, k=20) + w + rng.choices(vocab, k=20)))
        found = index.scan(texts)
        assert np.mean([i in d for (i, _), d in zip(items, found, strict=True)]) >= least


def fit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_cgk_verification_is_exact():
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=10))) for i in range(10)]
    texts = [" ".join(rng.choices(vocab, k=60)) for _ in range(40)]
    for t, d in zip(texts, cgk.Index(items).scan(texts), strict=True):
        for i, e in d.items():
            assert fit_distance(items[i][1].split(), t.split()) <= e <= 2


def test_leaks_edges(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "zzz yyy xxx")], "item_id bigint, text string")
    got = cgk.find_leaks(table(spark, ODD), bench).collect()
    assert len(got) == len(ODD) and [r["items"] for r in got if r.id == 1] == [[1], [1]] and sum(bool(r["items"]) for r in got) == 2
    assert cgk.drop_leaks(table(spark, ODD), bench).count() == len(ODD) - 2
    assert cgk.find_leaks(table(spark, ODD), bench.limit(0)).filter("size(items) > 0").count() == 0


def test_leaks_of_one_and_two_words(spark):
    bench = spark.createDataFrame([(1, "Tab"), (2, "gamma delta"), (3, "alpha delta"), (4, "alpha beta gamma delta epsilon zeta"), (5, "tab")], "item_id bigint, text string")
    got = {(r.id, tuple(r["items"]), tuple(r["edits"])) for r in cgk.find_leaks(table(spark, ODD), bench).collect()}
    assert got == {(1, (2, 4), (0, 0)), (-5, (1, 5), (0, 0)), (None, (), ()), (2, (), ()), (3, (), ()), (4, (), ())}
    assert sorted(r.doc_id or 0 for r in cgk.drop_leaks(table(spark, ODD), bench).collect()) == [0, 2, 3, 4]


def test_leaks_in_blocks_of_the_benchmark(spark):
    rng = random.Random(28)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=12))) for i in range(30)] + [(None, None)]
    texts = [" ".join(rng.choices(vocab, k=9)) + " " + items[i % 40][1] if i % 40 < 30 else " ".join(rng.choices(vocab, k=50)) for i in range(80)]
    docs, bench = table(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(None, None, None), (500, "v1 " * 40_000, "a")]), spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(cgk.find_leaks(docs, bench, max_items=7)) == rows(cgk.find_leaks(docs, bench))
    assert rows(cgk.drop_leaks(docs, bench, max_bytes=300)) == rows(cgk.drop_leaks(docs, bench))
    assert len(cgk.blocks_of(bench, "item_id", "text", 7, 10**9)) == 6


def test_leaks_equal_all_windows(spark):
    """Every passage within the bound of some stretch, by alignment with every text."""
    rng = random.Random(29)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(6, 15)))) for i in range(25)]
    texts = []
    for k in range(100):
        w = items[k % 25][1].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(rng.choices(vocab, k=15) + w + rng.choices(vocab, k=15)))
    found = cgk.Index(items).scan(texts)
    want = [{i for i, p in items if fit_distance(p.split(), t.split()) <= int(0.2 * len(p.split()))} for t in texts]
    assert all(set(f) <= w for f, w in zip(found, want, strict=True))
    assert sum(len(f) for f in found) >= 0.95 * sum(len(w) for w in want) > 50


# 9 ----------------------------------------------------------------------------------------------------------


def test_signatures_estimate_weighted_jaccard():
    a, b = (np.array([1, 2], np.uint64), np.array([50, 1])), (np.array([1, 3], np.uint64), np.array([37, 9]))
    agree = []
    for seed in range(200):
        moved = []
        for k, c in (a, b):
            h = bag.mix(k + np.uint64(seed * 7919))
            o = np.argsort(h)
            moved.append((h[o], c[o]))
        s = bag.registers(moved)
        agree.append((s[0] == s[1]).mean())
    assert abs(np.mean(agree) - bag.overlap(a, b)) < 0.02


def test_joining_equals_brute_force():
    rng = random.Random(9)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(60)]
    texts = []
    for _ in range(60):
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        texts.append(" ".join(w))
    bags = bag.shingle_bags(texts, bag._Words())

    def classes(pairs):
        up = list(range(len(texts)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for i, j in pairs:
            up[find(i)] = find(j)
        return {frozenset(k for k in range(len(texts)) if find(k) == r) for r in map(find, range(len(texts)))}

    got = bag.joining(bags, np.arange(len(texts)), np.zeros(len(texts)), 0.8)
    want = [(i, j) for i in range(len(texts)) for j in range(i) if bag.overlap(bags[i], bags[j]) >= 0.8]
    assert classes(got) == classes(want) and len(got) < len(texts)


def test_duplicate_classes(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(800)]
    base = rng.choices(words, k=400)
    edited = base[:]
    edited[200] = "changed"
    rows = [(10, " ".join(base), "a"), (4, " ".join(edited), "a"), (7, " ".join(base), "a"), (20, " ".join(rng.choices(words, k=400)), "b"), (30, "", "a"), (31, None, "a"), (40, "two words", "a"), (41, "Two, words!", "b"), (None, "lonely", "c")]
    got = {r.id: r.class_id for r in bag.duplicate_classes(table(spark, rows)).collect()}
    assert got == {10: 4, 4: 4, 7: 4, 20: 20, 30: 30, 31: 30, 40: 40, 41: 40, None: None}
    left = [r.doc_id for r in bag.drop_copies(table(spark, rows + rows[:2])).collect()]
    assert sorted(left, key=lambda x: (x is not None, x or 0)) == [None, 4, 20, 30, 40]
    assert bag.duplicate_classes(table(spark, [])).count() == 0


def test_classes_equal_brute_force(spark):
    """Groups of near copies from two to many, against all pairs of exact overlaps."""
    rng = random.Random(30)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (2, 3, 5, 40):
        for _ in range(6 if size < 40 else 1):
            base = rng.choices(words, k=rng.randint(40, 150))
            for _ in range(size):
                w = base[:]
                for _ in range(rng.randint(0, len(w) // 30)):
                    w[rng.randrange(len(w))] = rng.choice(words)
                texts.append(" ".join(w))
    texts += [" ".join(rng.choices(words, k=60)) for _ in range(60)] + [" ".join(["same line again"] * k) for k in (5, 6, 7, 50_000)] + texts[:3]
    bags = bag.shingle_bags(texts, bag._Words())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or bag.overlap(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = {r.id: r.class_id for r in bag.duplicate_classes(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_band_recall_at_the_threshold():
    rng = random.Random(31)
    words, hit, n = [f"w{i}" for i in range(5000)], 0, 0
    while n < 300:
        base = rng.choices(words, k=120)
        other = base[:]
        for p in rng.sample(range(120), 3):
            other[p] = "new"
        bags = bag.shingle_bags([" ".join(base), " ".join(other)], bag._Words())
        if 0.78 <= bag.overlap(*bags) <= 0.84:
            keys = bag.band_keys(bag.registers(bags))
            hit, n = hit + bool((keys[0] == keys[1]).any()), n + 1
    assert hit / n >= 0.98


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(bag, "BLOCK", 7)
    monkeypatch.setattr("tidemark.llm.common.HOT_ROWS", 5)
    test_classes_equal_brute_force(spark)


def test_components_of_chains_stars_and_hot_vertices(spark):
    from tidemark.llm.bagminhash import components

    edges = [(i, i + 1) for i in range(30)] + [(500, 1000 + i) for i in range(1500)] + [(40, 41), (42, 41), (43, 44)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {i: 500 for i in [500, *range(1000, 2500)]} | {40: 40, 41: 40, 42: 40, 43: 43, 44: 43}
    assert got == want


def test_unlike_texts_share_no_class(spark, monkeypatch):
    rng = random.Random(12)
    one, two, three, four = (" ".join(rng.choices([f"w{i}" for i in range(800)], k=100)) for _ in range(4))
    docs = table(spark, [(None, one, "a"), (None, two, "a"), (None, one, "b"), (5, three, "a"), (5, four, "a"), (5, three, "a")])
    left = sorted((r.doc_id or 0, r.text) for r in bag.drop_copies(docs).collect())
    assert left == sorted([(0, one), (0, two), (5, three), (5, four)])
    monkeypatch.setattr(bag, "duplicate_classes", lambda _, f=bag.duplicate_classes: f(docs))
    got = [(r.doc_id, r.class_id, r.class_key) for r in bag.op9_bagminhash(spark, SF).collect()]
    key = {t: hashlib.md5(t.encode()).hexdigest() for t in (one, two, three, four)}
    assert sorted(got, key=str) == sorted([(None, None, key[one])] * 2 + [(None, None, key[two])] + [(5, 5, key[three])] * 2 + [(5, 5, key[four])], key=str)


# 10 ---------------------------------------------------------------------------------------------------------


def test_quotes_link_and_thread(spark):
    rows = [
        (1, 0, "user", "Hello there. This is first.\nSecond line here."), (1, 1, "a", "> Hello there. This is\n> first.\nI agree with this."),
        (1, 2, "user", "On Monday X wrote:\n>> Hello there.\n> I agree with this.\nok then"), (1, 3, "a", "Fresh text"), (1, 3, "a", "Fresh text"), (None, None, None, None), (2, 1, "a", "> Hello there.\nnot my talk"),
    ]
    m = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("conv", F.lit(1))
    got = {(r.conv, r.turn): r for r in quote_link.link_quotes(m).collect()}
    assert [(got[1, t].parent_turn, got[1, t].root_turn, got[1, t].depth) for t in range(4)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0)]
    assert got[1, 2].text == "ok then" and got[1, 3].n_rows == 2 and got[2, 1].n_linked == 0 and got[2, 1].n_quoted == 1 and len(got) == 6
    assert quote_link.link_quotes(m.limit(0)).count() == 0


def test_conversations_in_reply_order(spark):
    rows = [(1, t, "u", f"Turn {t} says word{t}." if t < 4 else f"> Turn {t - 4} says word{t - 4}.\nReply {t}.") for t in range(8)] + [(None, None, None, None), (2, 0, "u", "long " * 40_000), (2, 0, "u", "long " * 40_000)]
    linked = quote_link.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {(r.conv, r.part): [m.text for m in r.messages] for r in quote_link.conversations(linked, 3).collect()}
    order = [x for t in range(4) for x in (f"Turn {t} says word{t}.", f"Reply {t + 4}.")]
    assert got == {(1, 0): order[:3], (1, 1): order[3:6], (1, 2): order[6:], (None, 0): [""], (2, 0): [("long " * 40_000).strip()]}


# Pipeline ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [[*ODD, (None, "alpha beta", None), (6, "alpha beta gamma delta epsilon zeta", "c")], []])
def test_pipeline_stages_on_odd_rows(spark, rows):
    import corpus_pipeline

    docs = table(spark, rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        if rows and name == "near_duplicates":
            left = sorted((r.doc_id or 0, (r.text or "")[:12]) for r in docs.collect())
            assert left == [(-5, "ñandú  \n tab"), (0, "alpha beta"), (1, "alpha beta g"), (2, ""), (4, "word word wo")]
    assert bool(docs.count()) == bool(rows)


def test_second_run_leaves_the_first_result(spark):
    import corpus_pipeline

    first = corpus_pipeline.run(spark, SF)
    second = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, counts = docs.count(), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert n >= counts[0] >= counts[1] > counts[2] and counts[3] == counts[4]
    assert counts[4] == corpus_pipeline.run(spark, SF).count()


def test_mix_rows_do_not_grow_with_the_shards(spark, monkeypatch):
    """Written tables and draws are as wide at 256 shards as at 8, and each block falls into the leaf that holds it."""
    rows = [(i, "w " * (30 + i % 40), f"s{i % 3}") for i in range(300)]
    written, plain = {}, source_mix.materialize

    def watched(df, name):
        if name == "mix-docs":
            written.setdefault(name, []).append(df.columns)
        return plain(df, name)

    monkeypatch.setattr(source_mix, "materialize", watched)
    drawn = {}
    for shards in (8, 256):
        _, draws = source_mix.plan_mix(table(spark, rows), [1, 2, 3], shards=shards)
        drawn[shards] = draws.collect()
        per = source_mix.source_targets(table(spark, rows).select("source", F.regexp_count("t", F.lit("w")).cast("long").alias("size")), [1, 2, 3], 64)
        assert not any("array" in kind for _, kind in draws.dtypes) and per is not None
    assert written["mix-docs"][0] == written["mix-docs"][1]
    what = [sorted((r.order_key, r.source, r.offset, r.epoch, r.words) for r in drawn[k]) for k in (8, 256)]
    assert what[0] == what[1] and {r.shard for r in drawn[256]} <= set(range(256)) and len({r.shard for r in drawn[256]}) > 200


def test_toxic_sample_has_one_row_an_id(spark):
    """An id that repeats with other texts, or labelled twice, gives one row: what is learnt from is bounded by rows."""
    rows = [(1, f"text number {k} of the first", "a") for k in range(50)] + [(1, None, "a"), (2, None, "a"), (2, None, "b"), (3, "three", "a"), (None, "none", "a")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.sample_bags(table(spark, rows), labels, "doc_id", "text", "toxic", lambda k: F.lit(True), 10).collect()
    assert sorted((r.k, r.y) for r in got) == [(1, 1), (2, 0), (3, 0)]


def test_large_sites_join_as_small_ones(spark, monkeypatch):
    """Beyond the broadcast bound the joins deal a host's rows to several tasks: same scores."""
    monkeypatch.setattr("tidemark.llm.common.HOT_ROWS", 20)
    rng = random.Random(5)
    rows = [(k if k % 50 else None, " ".join(rng.choice(["good", "words", "!!", "###"]) for _ in range(rng.randint(0, 30))), rng.choice(["big", "big", "big", "s1", "s2", None])) for k in range(400)]
    docs, labels = table(spark, rows), spark.createDataFrame([(k, k % 3 % 2) for k in range(0, 400, 2)], "doc_id bigint, quality int")
    sites = spark.createDataFrame([(k, "big" if k % 4 else "h2", "p") for k in range(1, 300, 3)], "id bigint, host string, path string")

    def scores():
        out = site_quality.site_scores(docs, labels, sites=sites).collect()
        return sorted((str(r.id), round(r.own, 9), round(r.host_rate, 9), round(r.path_rate, 9), round(r.score, 9)) for r in out)

    small = scores()
    monkeypatch.setattr(site_quality, "BROADCAST_SITES", 0)
    assert scores() == small and len(small) == 400
