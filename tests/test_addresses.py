"""Visitors' addresses: labels, spellings, masks in text and in JSON, against plain and recursive versions."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import addresses as A


def one(spark, c, text):
    return spark.createDataFrame([(text,)], "t string").select(c(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text", ["8.8.4.4", "08.8.4.4", "256.1.1.1", "1.2.3", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "::1", "::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", ":1:2", "abcde::", "12:30:45", "x"],
)
def test_keys_are_addresses(spark, text):
    try:
        ip = ipaddress.ip_address(text)
        want = str(ip) if ip.version == 4 else ip.exploded
    except ValueError:
        want = None
    assert one(spark, A.address_key, text) == want


@pytest.mark.parametrize("text", ["8.8.4.4", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.9.9", "169.254.1.1", "100.64.0.1", "100.128.0.1", "127.0.0.1", "0.1.2.3", "224.0.0.1", "255.255.255.255", "2600::1", "::1", "::", "fc00::1", "fd12::", "fe80::1", "febf::1", "fec0::1", "ff02::1"])
def test_public(spark, text):
    inner = {"10.", "172.16", "192.168", "169.254", "100.64", "127.", "0.", "224.", "255.255.255.255", "::1", "::", "fc", "fd", "fe80", "febf", "ff02"}
    assert one(spark, lambda t: A.is_public(A.address_key(t)), text) == (not any(text == x or (text.startswith(x) and x not in ("::", "::1")) for x in inner))


def test_labels_count_for_the_address_behind(spark):
    texts = {
        "Blocked. Your IP: 203.0.113.77. Server 198.18.0.9.": ["203.0.113.77"], "your ip 203.0.113.5, 203.0.113.6": ["203.0.113.5"], "Your IP " + "x" * 60 + " 203.0.113.7": [], "YOUR IP is 10.0.0.8": [],
        "Ihre IP: 2600:1f00::7 und 203.0.113.9": ["2600:1f00:0000:0000:0000:0000:0000:0007"], '{"origin": "203.0.113.4"}': ["203.0.113.4"], "client ip 203.0.113.2 your ip 203.0.113.2 visitor ip: 203.0.113.3": ["203.0.113.2", "203.0.113.3"],
        "your ip at 12:30:45 203.0.113.1": ["203.0.113.1"], "": [], "version 1.2.3.4.5 your ip 1.2.3.4.5": [],
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "k int, t string")
    got = {r.k: r.a for r in df.select("k", A.labelled(F.col("t")).alias("a")).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values()) and not got[99]


def test_masks(spark):
    own = F.array(F.lit("203.0.113.7"), F.lit("2600:0000:0000:0000:0000:0000:0000:0001"))
    text = "at 203.0.113.7, 203.0.113.70, 2600::1 and 2600:0:0::1; 1203.0.113.7. 203.0.113.7."
    assert one(spark, lambda t: A.masked(t, own), text) == "at [own IP], 203.0.113.70, [own IP] and [own IP]; 1203.0.113.7. [own IP]."


def test_long_texts(spark):
    own = F.array(F.lit("203.0.113.7"))
    text = "abcdef 12:3 no address here. " * 20_000 + "203.0.113.7" + " feed " * 50_000
    assert one(spark, lambda t: A.masked(t, own), text) == text.replace("203.0.113.7", "[own IP]")


def test_masked_json_equals_recursion(spark):
    rng = random.Random(5)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.4:
            return rng.choice(["203.0.113.7", "at 203.0.113.7, ok", 'a "quote", [x]: {203.0.113.7}\\', "8.8.8.8", 5, None, True, "", "url"])
        if kind < 0.7:
            return [made(depth - 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(["a", "url", "pageURL", "curl", "b:c", 'q"url', "203.0.113.7", "text"]) + rng.choice(["", "2", ""]): made(depth - 1) for _ in range(rng.randint(0, 5))}

    def walk(v, urls):
        if isinstance(v, str):
            return v.replace("203.0.113.7", "[own IP]")
        if isinstance(v, list):
            return [walk(x, urls) for x in v]
        if isinstance(v, dict):
            return {k: x if not urls and k.lower().endswith("url") else walk(x, urls) for k, x in v.items()}
        return v

    values = [*[made(5) for _ in range(150)], '\\"' * 30_000 + " 203.0.113.7 " + "\\\\" * 3, {"x\\": ["203.0.113.7\\", "y"]}]
    rows = spark.createDataFrame([(k, json.dumps(v, indent=rng.choice([None, 1])), ["203.0.113.7"]) for k, v in enumerate(values)], "k int, j string, own array<string>")
    for urls in (False, True):
        got = {r.k: r.j for r in A.masked_json(rows, "k", "j", "own", urls).collect()}
        for k, v in enumerate(values):
            assert json.loads(got[k]) == walk(v, urls)
