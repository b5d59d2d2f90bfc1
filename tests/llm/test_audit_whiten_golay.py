"""Whitening, the filter audit and Golay near-duplicates against brute force."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tidemark.llm import filter_audit as fa
from tidemark.llm import simhash_golay as sg
from tidemark.llm import whitening as wh

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, t string, low int, fp int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1, 2) for i, t, s in rows], DOCS)


LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(60_000))
ODD = [
    (1, "alpha beta gamma delta epsilon", "a"), (None, "alpha beta gamma delta epsilon", None), (2, None, "a"), (3, "", ""), (1, "alpha beta gamma delta epsilon", "a"),
    (4, LONG, "b"), (9, LONG, "b"), (-5, "ñandú \n tab\t😀 END $", "b"), (None, "only null", None), (None, "only null", "b"), (7, "ALPHA beta gamma delta epsilon", "a"),
    (8, "one\x85two three\x1cfour", None), (11, "same " * 300, "a"),
]


# whitening --------------------------------------------------------------------------------------------------


def whiten_brute(vectors):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = (fit * n - sums).astype(float) / n
    _, s, vt = np.linalg.svd(y, full_matrices=False)
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, sums, strict=True)) for r in x]
    w = ((np.array(x, dtype=object) * n - sums).astype(float) / n) @ vt.T / (s / np.sqrt(n))
    return n, dev, w, s**2 / (s**2).sum()


@pytest.mark.parametrize("spread", [1.0, 1e-5])
def test_whitening(spark, spread):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) * np.geomspace(3, 1, 20) * 1e5
    base[:, 19] = base[:, 18] + spread * base[:, 19] + rng.integers(0, 3, 300)  # a dimension that nearly repeats another
    base[:, 5] = 7.25  # and one that never changes
    rows = [(k, v.tolist(), 1, "z") for k, v in enumerate(base)] + [(k, base[k].tolist(), 1, "z") for k in range(40)] + [(None, base[3].tolist(), 1, "z")]
    bad = [(900, None, 1, "z"), (901, [None] * 20, 1, "z"), (902, [float("nan")] * 20, 1, "z"), (903, [float("inf")] * 20, 1, "z"), (904, [1.0] * 19, 1, "z"), (905, [], 1, "z")]
    got = wh.whitened(spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, x int, id string")).collect()
    n, dev, w, share = whiten_brute([r[1] for r in rows])
    assert len(got) == len(rows) * 16 and {r.n for r in got} == {n} == {300}
    assert {r.identity_error for r in got}.pop() < 1e-6 and {r.id for r in got} == {r[0] for r in rows}
    by = {}
    for r in got:
        by.setdefault((r.id, r.component), []).append(r)
    for c in range(1, 17):
        mine = np.array([by[k, c][0].whitened for k in range(300)])
        sign = np.sign(mine @ w[:300, c - 1])
        assert np.abs(sign * mine - w[:300, c - 1]).max() < 1e-6
        assert abs(by[0, c][0].explained / share[c - 1] - 1) < 1e-6
    assert all(by[k, 1][0].deviation == (dev[k] if dev[k] < 1 << 63 else None) for k in range(300))


def test_whitening_small_components(spark):
    """A spread of 1e9 between components: the covariance alone would lose the last."""
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    x = (rng.normal(size=(2000, 6)) * np.geomspace(1e12, 3e3, 6)) @ q
    got = wh.whitened(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id int, embedding array<double>")).collect()
    _, _, w, share = whiten_brute(x.tolist())
    assert {r.component for r in got} == set(range(1, 7)) and got[0].identity_error < 1e-4
    for c in range(1, 7):
        mine = np.array([r.whitened for r in sorted(got, key=lambda r: r.id) if r.component == c])
        assert np.abs(np.abs(mine) - np.abs(w[:, c - 1])).max() < 1e-3
    assert all(abs(r.explained / share[r.component - 1] - 1) < 1e-4 for r in got)


def test_whitening_edges(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert wh.whitened(spark.createDataFrame(rows, kind)).collect() == []
    got = wh.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0]), (3, [9.0, 9.0, 9.0])], kind)).collect()
    assert sorted((r.id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in got) == [(1, 1, 2, 128**2, 1, 1), (2, 1, 2, 128**2, 1, 1), (2, 1, 2, 128**2, 1, 1)]
    huge = wh.whitened(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id bigint, embedding array<double>")).collect()
    assert len(huge) == 3 and [r.deviation for r in huge if r.id != 3] == [None, None]


# filter audit -----------------------------------------------------------------------------------------------


def audit_brute(rows, labels):
    out, key = {}, lambda i: (i is None, i or 0)
    low = {}
    for i, t, _ in rows:
        low[t or ""] = min(low.get(t or "", i), i, key=key)
    marks = {}
    for i, q, x in labels:
        if i is not None:
            a = marks.get(i, (0, 0))
            marks[i] = (max(a[0], int(q == 1)), max(a[1], int(x == 1)))
    judged = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": key(i) > key(low[t]),
        }
        judged.append((s or "", f, *marks.get(i, (0, 0))))
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        removed_of = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, c in enumerate(order):
                gone, rest = [j for j in left if j[1][c]], [j for j in left if not j[1][c]]
                fails = [j for j in own if j[1][c]]
                removed_of[c] += len(gone)
                out[part, order, k + 1] = (len(rest), len(gone), len(fails) - len(gone), sum(sum(j[1].values()) == 1 for j in fails), sum(j[2] for j in gone), sum(j[3] for j in gone))
                left = rest
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, c in enumerate(order):
                out[part, order, k + 1] += (removed_of[c],)
    return out


def audited(spark, rows, labels, table=table):
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, toxic int, source string")
    got = fa.audit(fa.failure_counts(table(spark, rows), marks)).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


LABELS = [(1, 1, 0), (1, None, 1), (None, 1, 1), (2, 0, 1), (4, 1, None), (9, 1, 1), (11, 0, 0), (77, 1, 1)]


def test_audit_odd_rows(spark):
    assert audited(spark, ODD, LABELS) == audit_brute(ODD, LABELS)
    assert audited(spark, [], LABELS) == {}
    assert audited(spark, ODD[:1], []) == audit_brute(ODD[:1], [])


def test_audit_shared_beginnings(spark, monkeypatch):
    """Texts that share long beginnings, copies in many tasks, and stretches of a few texts."""
    monkeypatch.setattr(fa, "HELD", 4000)
    rng = random.Random(2)
    head = "the same long beginning of many texts " * 90
    texts = [head[: rng.choice([5, 40, 700, 3000])] + rng.choice("abc") * rng.randint(0, 3) for _ in range(400)]
    rows = [(k % 370, t, f"s{k % 3}") for k, t in enumerate(texts)]
    rows += [(1000 + k, head, "hot") for k in range(300)]
    rng.shuffle(rows)
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 1300, 3)]
    assert audited(spark, rows, labels, lambda s, r: table(s, r).repartition(13)) == audit_brute(rows, labels)


def test_trie_holds_least_ids():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() for _ in range(3000)]
    trie, want = fa.Trie(), {}
    for k, t in enumerate(texts):
        i = rng.choice([None, rng.randint(0, 99)])
        trie.insert(t, i, 1, t)
        w = want.setdefault(t, [None, 0])
        w[0], w[1] = fa.least(w[0], i), w[1] + 1
    assert {d: [low, n] for low, n, d in trie.terminals()} == want

    def compressed(node, root=True):
        assert root or (node.label and (node.end or len(node.next) > 1))
        assert all(k == below.label[0] and compressed(below, False) for k, below in node.next.items())
        return True

    assert compressed(trie.root)


def test_audit_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    df = fa.op12_filter_audit(spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({fa.SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) % 600 == 0


# Golay near-duplicates --------------------------------------------------------------------------------------


def print_brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_brute(prints):
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= 4:
            up[find(a)] = find(b)
    return [find(p) for p in prints]


def named_brute(ids, roots):
    low = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in roots]


@pytest.mark.parametrize("rows", [ODD, []])
def test_golay_odd_rows(spark, rows):
    got = sg.near_classes(table(spark, rows)).collect()
    prints = [print_brute(t) for _, t, _ in rows]
    want = [(i, p, c) for (i, _, _), p, c in zip(rows, prints, named_brute([r[0] for r in rows], classes_brute(prints)), strict=True)]
    assert sorted(map(str, ((r.id, r.fp % (1 << 64), r.component_id) for r in got))) == sorted(map(str, want))


def test_golay_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sg.op13_simhash_golay(spark, SF).collect()}
    prints = [print_brute(r.text) for r in docs]
    names = named_brute([r.doc_id for r in docs], classes_brute(prints))
    assert got == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(docs, prints, names, strict=True)} and len(set(names)) < len(docs)


def test_code_is_perfect():
    errors = sg.error_patterns()
    assert errors.shape == (2048, 6) and sorted((errors >= 0).sum(axis=1).tolist()) == [1] * 277 + [6] * 1771
    code, rng = sg.Golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    for w, found in zip(words.tolist(), code.indices(words).tolist(), strict=True):
        near = {c for c in range(1 << 12) if ((c << 11 | sg.remainder(c << 11)) ^ w).bit_count() <= 4} if w % 40 == 0 else None
        assert near is None or near == {x for x in found if x >= 0}


def test_linked_prints_share_a_bucket():
    rng = random.Random(8)
    a = np.array([rng.getrandbits(64) for _ in range(4000)], np.uint64)
    b = np.array([int(x) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for x in a], np.uint64)
    found = []
    for x in (a, b):
        keys, rows = sg.bucket_keys(x, sg.Golay())
        own = [set() for _ in x]
        for k, r in zip(keys.tolist(), rows.tolist(), strict=True):
            own[r].add(k)
        found.append(own)
    assert all(x & y for x, y in zip(*found, strict=True))


@pytest.mark.parametrize("block", [40, 4096])
def test_dense_prints(spark, monkeypatch, block):
    """Thousands of prints about a few centres, in blocks and whole, against all pairs."""
    monkeypatch.setattr(sg, "BLOCK", block)
    monkeypatch.setattr(sg, "ONE_IN", 1)
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << k for k in rng.sample(range(64), rng.choice([1, 1, 2, 3, 5, 6, 7]))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in sg.links(df).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert 0 < (a ^ b).bit_count() <= 4
        up[find(a)] = find(b)
    mine, want = [find(p) for p in prints], classes_brute(prints)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))
