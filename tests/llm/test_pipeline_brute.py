"""Every stage of the pipeline over planted documents, each against a plain version on its own input."""

import array
import math
import random
import re
import zlib
from collections import Counter


import corpus_pipeline
from tests.llm.test_llm import fit_distance, targets, tokenizer
from tidemark.llm import bagminhash as bag
from tidemark.llm import toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def planted():
    rng = random.Random(77)
    vocab = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("ra", "st", "mi", "lo", "ven", "tik")]
    prose = lambda n: ". ".join(" ".join(rng.choices(vocab, k=rng.randint(6, 12))) for _ in range(n))
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(9, 16)))) for k in range(12)]
    rows, toxic = [], {}
    for k in range(150):
        text = prose(rng.randint(5, 12))
        if k % 3 == 0:
            text += ". you vile grimling rotter"
        toxic[k] = int(k % 3 == 0)
        rows.append((k, text))
    for k in range(150, 190):  # copies, whole and with a word or two changed
        w = rows[3 * (k % 29) + 1][1].split(" ")
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, " ".join(w)))
    for k in range(190, 215):  # passages, whole and with a word changed
        w = items[k % 12][1].split()
        if k % 2:
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, prose(3) + ". " + " ".join(w) + ". " + prose(3)))
    rows += [(300, prose(2000)), (301, ""), (302, "same here " * 400)]
    docs = [(i, t, "en", f"s{i % 4}" if i % 11 else None, len(t)) for i, t in rows]
    return docs, list(toxic.items()), items


def toxic_loop(docs, weights, bias):
    def score(text):
        quiet = 1.0
        for s in toxicity.SENTENCE.findall(text.lower()):
            hits = {x for w in set(toxicity.WORD.findall(s)) for x in toxicity.word_features(w) if x in weights}
            quiet *= 1 - (1 / (1 + math.exp(-bias - sum(weights[x] for x in hits))) if hits else 0)
        return 1 - quiet

    return [d for d in docs if score(d.text or "") < 0.7]


def copies_loop(docs):
    docs = sorted(docs, key=lambda d: d.doc_id)
    bags, kept = bag.shingle_bags([d.text or "" for d in docs], bag._Words()), []
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i].text == docs[j].text or bag.overlap(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    kept = [d for i, d in enumerate(docs) if find(i) == i]
    return kept


def leaks_loop(docs, items):
    words = [(i, re.findall(r"\w+", t.lower())) for i, t in items]
    return [d for d in docs if not any(fit_distance(p, re.findall(r"\w+", (d.text or "").lower())) <= int(0.2 * len(p)) for _, p in words)]


def test_stages_equal_plain_versions(spark, tmp_path):
    docs, toxic, items = planted()
    sf = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1 - t, t) for i, t in toxic], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    results = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        out = stage(spark, now, sf)
        got = out.collect()
        results.append(got)
        if k == 0:
            weights, bias = toxicity.train(now, spark.read.parquet(f"{sf}/labels.parquet"), learn=lambda c: ~toxicity.held_out(c))
            want = toxic_loop(before, weights, bias)
            assert {r.doc_id for r in before} - {r.doc_id for r in got} == {i for i, t in toxic if t}  # all toxic ones go, no others
        elif k == 1:
            want = copies_loop(before)
            assert len(before) - len(want) >= 25
        elif k == 2:
            want = leaks_loop(before, items)
            assert len(before) - len(want) >= 20
        elif k == 3:
            rows, size, took = Counter(map(tuple, got)), Counter(), Counter()
            assert set(rows) <= set(map(tuple, before)) and max(rows.values()) <= 3
            for r in before:
                size[r.source] += len((r.text or "").split())
                took[r.source] += rows[tuple(r)] * len((r.text or "").split())
            for s, t in targets(dict(size), corpus_pipeline.WEIGHTS).items():
                largest = max(len((r.text or "").split()) for r in before if r.source == s)
                assert abs(took[s] - t) <= max(3 * largest, 0.25 * t)
        else:
            tok, start, want = tokenizer(), 0, []
            for r in sorted(before, key=lambda r: (r.doc_id, r.text)):
                ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
                want.append((r.doc_id, start, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
                start += len(ids)
            assert sorted(tuple(r)[:4] for r in got) == sorted(want)
        if k < 3:
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        now = spark.createDataFrame(got, out.schema)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in whole) == Counter(r.doc_id for r in results[-1]) and len(whole) == len(results[3])


def test_oracle_is_stated():
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
