"""Pages of bounded tokens: a plain reading, rejoining, resuming, long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import take


def made(seed, n=40):
    rng = random.Random(seed)
    words = "salt river stone lamp paper window 漢字 garden".split()
    out = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.15:
            out.append("#" * rng.randint(1, 4) + f" Heading {k}")
        elif kind < 0.25:
            out.append("```py\n" + "\n".join(f"line_{j} = {j}" for j in range(rng.randint(1, 30))) + "\n```")
        elif kind < 0.35:
            out.append("| a | b |\n| --- | --- |\n" + "\n".join(f"| {j} | {rng.choice(words)} |" for j in range(rng.randint(1, 25))))
        elif kind < 0.42:
            out.append("x" * rng.randint(1, 900))
        else:
            out.append(" ".join(rng.choice(words) + rng.choice(["", "", "."]) for _ in range(rng.randint(1, 120))))
    return out


def plain_page(blocks, at, off, budget, prefix):
    """Block by block, as the rule reads."""
    out, used, got = prefix, take.tokens(prefix), 0
    while at < len(blocks):
        rest, fence = blocks[at][off:], take.fence_of(blocks[at])
        head = blocks[at].split("\n")[0].strip() if off and fence else ""
        cost = take.tokens(rest) + (take.tokens(head) if head else 0)
        sep = "\n\n" if out else ""
        if used + cost <= budget:
            out, used, got, at, off = out + sep + (head + "\n" if head else "") + rest, used + cost, got + 1, at + 1, 0
            continue
        room = budget - used
        if room > 0 and (not got or (room >= 16 and 4 * room >= budget)):
            quarters, limit = max(0, 4 * room - (len(fence) + len(head) + 2 if fence else 0) - 6), 0
            for c in rest:
                quarters -= 5 if ord(c) > 0x2E80 else 1
                if quarters < 0:
                    break
                limit += 1
            limit = max(limit, int(not got))
            cut = len(rest)
            if len(rest) > limit:
                ends = [rest[:limit].rfind(m) + len(m) for m in (". ", "\n", " ") if m in rest[:limit]]
                cut = ends[0] if ends else limit
            if got and (fence or blocks[at].lstrip().startswith("|")):
                cut = rest[:limit].rfind("\n") + 1
            elif got and cut == limit and limit < len(rest):
                cut = 0
            if cut:
                out += sep + (head + "\n" if head else "") + rest[:cut].rstrip() + ("\n" + fence if fence and cut < len(rest) else "")
                got, off = got + 1, off + cut
        break
    return out, at, off, got


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("budget", [20, 64, 300])
def test_pages_are_the_plain_ones(seed, budget):
    blocks = made(seed)
    text = take.Text(blocks, [take.tokens(b) for b in blocks], ["A > B" if k % 3 else "" for k in range(len(blocks))])
    at = off = 0
    for overlap in (0, 2):
        seen = []
        for b, o, page, nb, no, got in text.pages(0, 0, budget, overlap):
            before = "" if o else text.preamble(b, budget, overlap)
            want = plain_page(blocks, b, o, budget, before)
            if not want[3] and before:
                want = plain_page(blocks, b, o, budget, "")
            assert (page, got) == (want[0], want[3]) and got
            at, off = (want[1] + 1, 0) if want[1] < len(blocks) and want[2] >= len(blocks[want[1]]) else want[1:3]
            assert (nb, no) == (at, off) and take.tokens(page) <= budget + 24 + 8 * (budget < 60)
            seen.append((b, o, nb, no))
        assert seen[0][:2] == (0, 0) and seen[-1][2] == len(blocks) and all(x[2:] == y[:2] for x, y in zip(seen, seen[1:], strict=False))
        # a cursor in the middle gives the same pages from there
        b, o = seen[len(seen) // 2][:2]
        assert [p[:2] for p in text.pages(b, o, budget, overlap)] == [x[:2] for x in seen[len(seen) // 2 :]]


def test_text_is_handed_out_whole():
    blocks = [b for b in made(3, 60) if not b.startswith(("```", "|"))]
    text = take.Text(blocks, [take.tokens(b) for b in blocks], [""] * len(blocks))
    got = "".join("".join(p[2].split()) for p in text.pages(0, 0, 50, 0))
    assert got.replace("*(continuing)*", "") == "".join("".join(b.split()) for b in blocks)


def test_take_over_tables(spark):
    docs = spark.createDataFrame([(k, "\n\n".join(made(k))) for k in range(5)] + [(7, None), (8, ""), (9, "one")], "id int, text string")
    blocks = take.text_blocks(docs, "id", "text").cache()
    rows = take.take(blocks, "id", 80).orderBy("id", "page").collect()
    assert {r.id for r in rows} == {0, 1, 2, 3, 4, 9} and all(r.next_block is None for r in rows if r.id == 9)
    same = {r.id: r[1] for r in docs.filter("text is not null").select("id", F.md5("text")).collect()}
    middle = [(r.id, r.block, r.offset, same[r.id]) for r in rows if r.page == 2]
    old = [(0, 3, 0, "gone")]
    cursors = spark.createDataFrame([m for m in middle if m[0] != 0] + old, "id int, block int, offset int, digest string")
    again = take.take(blocks, "id", 80, cursors=cursors, most=1).collect()
    by = {(r.id, r.block, r.offset): r.content for r in rows}
    assert {r.id: r.stale for r in again} == {0: True, **{m[0]: False for m in middle if m[0] != 0}}
    assert all(r.content == by[r.id, r.block, r.offset] for r in again) and next(r for r in again if r.id == 0).block == 0
    heads = [r for r in rows if r.id < 5 and r.page and not r.offset]
    assert all(r.content.startswith("*(continuing") for r in heads if r.blocks) and any(" under " in r.content for r in heads)


def test_tokens_as_the_column_has_them(spark):
    texts = ["", "a", "漢字漢字漢", "mixed 漢 text", "x" * 41]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.token_estimate(F.col("t"))).collect()
    assert [r[0] for r in got] == [take.tokens(t) for t in texts]


def test_many_blocks_in_proportion():
    took = {}
    for n in (20_000, 40_000):
        blocks = ["some words of a line that ends here."] * n
        began = time.time()
        text = take.Text(blocks, [take.tokens(b) for b in blocks], [""] * n)
        assert sum(p[5] for p in text.pages(0, 0, 200, 1)) >= n
        took[n] = time.time() - began
    assert took[40_000] < 3 * took[20_000] + 0.2
