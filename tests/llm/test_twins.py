"""Queries of the training-data operators that SQL can express, on the given tables and on planted ones."""

import os
import random

import duckdb
import pytest

from tests.test_oracles import table
from tidemark.llm import quote_link, registry

SF = "/root/testdata/sf0.001"


def twin(folder, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}')")
    q = con.execute(sql)
    return table([c[0] for c in q.description], q.fetchall())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == twin(SF, registry.SQL[name])


def quoting(rng, n_conv, n_turns):
    """Conversations that quote: at two levels, from several messages, with announcements, ties, repeats and nulls."""
    words = "ferry harbour noon crate goat rope tide lamp chart bell storm anchor".split()

    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randint(2, 6))).capitalize() + rng.choice([".", "!", "?"])

    rows = []
    for c in range(n_conv):
        said = []
        for t in range(n_turns):
            lines = []
            if said and rng.random() < 0.8:
                if rng.random() < 0.5:
                    lines.append("On Monday someone wrote:")
                for _ in range(rng.randint(1, 3)):
                    mark = rng.choice(["> ", ">", ">> ", "> > ", " > "])
                    lines.append(mark + rng.choice([rng.choice(said), rng.choice(said).upper(), sentence(), ""]))
            own = [sentence() for _ in range(rng.randint(0, 3))]
            lines += own
            said += own or [sentence()]
            turn = None if rng.random() < 0.05 else t
            row = (None if c == 0 else c, turn, rng.choice(["a", "b", None]), None if rng.random() < 0.03 else "\n".join(lines))
            rows += [row] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("name", ["op10_quote_link", "conversations_of_op10"])
def test_planted_quotes(spark, tmp_path, name):
    rows = quoting(random.Random(12), 25, 14)
    # a chain of replies, each to the one before, and a tie: two messages quoted alike
    rows += [(900, k, "a", (f"> Remark number {k - 1} of many.\n" if k else "") + f"Remark number {k} of many.") for k in range(1100)]
    rows += [(901, 0, "a", "Red rope."), (901, 1, "b", "Old bell."), (901, 2, "a", "> Red rope.\n> Old bell.\nBoth."), (901, 2, "b", "> Old bell.\nOne.")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    got = [tuple(r) for r in df.collect()]
    assert table(df.columns, got) == twin(str(tmp_path), registry.SQL[name])
    if name == "op10_quote_link":
        per = [r.asDict() for r in quote_link.op10_quote_link(spark, str(tmp_path)).collect()]
        assert sum(r["n_linked"] > 0 for r in per) > 1200 and max(r["depth"] for r in per) == 1099 and any(r["n_quoted"] > r["n_linked"] for r in per)
        assert [r["parent_turn"] for r in per if r["conv_id"] == 901 and r["turn"] == 2] == [1, 1]  # the later turn wins a tie
