import random

import duckdb
import pytest

from ledgerlens.llm import chat
from ledgerlens.llm.chat import in_reply_order, link_quotations

SCHEMA = "conv_id long, turn long, role string, text string"


def test_nested_quotes_link_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow do I sort a list?"),
        (1, 1, "assistant", "Use sorted().\n\nIt returns a new list."),
        (1, 2, "user", "Another topic"),
        (1, 3, "user", "On Monday, bob wrote:\n> Use  sorted().\n>> How do I sort a LIST?\n\nBut in place?"),
        (1, 4, "assistant", "> Another topic\nYes\n> nothing known\n"),
        (2, 5, "user", "> Another topic\nother conversation"),
    ]
    out = {(r["conv_id"], r["turn"]): r for r in in_reply_order(link_quotations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert [out[1, t]["parent_turn"] for t in range(5)] == [None, 0, 1, 1, 2]
    assert [out[1, t]["depth"] for t in range(5)] == [0, 1, 2, 2, 3]
    assert out[1, 3]["content"] == "But in place?" and out[1, 3]["n_quoted"] == 2 == out[1, 3]["n_linked"]
    assert (out[1, 4]["content"], out[1, 4]["n_quoted"], out[1, 4]["n_linked"]) == ("Yes", 2, 1)
    assert out[2, 5]["parent_turn"] is None and out[2, 5]["n_linked"] == 0 and out[2, 5]["root_turn"] == 5
    assert out[1, 4]["chat"] == "<|assistant|>\nYes\n<|end|>\n"


def test_long_chain_doubles_to_its_root(spark):
    rows = [(9, t, "user", f"> line {t - 1}\nline {t}" if t else "line 0") for t in range(70)]
    out = link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["root_turn"] for r in out} == {0} and all(r["depth"] == r["turn"] for r in out)


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (1, 0, "user", "same turn"), (None, 3, "user", "x"), (2, None, "user", "> y"),
        (3, 0, "user", ""), (3, 1, "user", "z " * 60_000),
    ]
    df = spark.createDataFrame([(*r, "e") for r in rows], SCHEMA + ", parent string")
    out = link_quotations(df).collect()
    assert len(out) == len(rows)
    assert sorted(r["role"] for r in out) == ["unknown", "user", "user", "user", "user", "user"]
    assert {(r["conv_id"], r["turn"]): r["parent_turn"] for r in out if r["turn"]} == {(None, 3): None, (3, 1): 0}
    assert link_quotations(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_threads(rows):
    """{(conv, turn): (content, n_quoted, n_linked, parent)} line by line, for distinct turns."""
    def squeeze(t):
        return " ".join(t.lower().split(" ")).strip(" ")

    def parse(text):
        lines, passages, run = [], [], None
        for line in text.split("\n"):
            level, rest = 0, line
            probe = rest[1:] if rest[:1] == " " else rest
            while probe[:1] == ">":
                level, rest = level + 1, probe[1:]
                rest = rest[1:] if rest[:1] == " " else rest
                probe = rest
            lines.append((level, rest))
            if not rest.strip(" "):
                run = None
            elif run is not None and run[0] == level:
                run[1].append(rest)
            else:
                run = (level, [rest])
                passages.append(run)
        return lines, passages

    def units(passage):
        return {u for u in (squeeze(x) for x in [" ".join(passage), *passage]) if u}

    out, own, turns = {}, {}, {}
    for conv, turn, _, text in sorted(rows, key=lambda r: r[:2]):
        lines, passages = parse(text)
        links, votes = 0, {}
        for level, passage in passages:
            if level:
                hits = [(u, own[conv, u]) for u in units(passage) if own.get((conv, u), turn) < turn]
                links += bool(hits)
                for u, original in hits:
                    votes[-level, original] = votes.get((-level, original), 0) + len(u)
        best = max(((key[0], n, key[1]) for key, n in votes.items()), default=None)
        parent = best[2] if best else turns.get(conv)
        content = "\n".join(x for level, x in lines if level == 0).strip(" \t\n\x0b\x0c\r")
        out[conv, turn] = (content, sum(level > 0 for level, _ in passages), links, parent)
        turns[conv] = turn
        for level, passage in passages:
            if not level:
                for u in units(passage):
                    own.setdefault((conv, u), turn)
    return out


def planted_threads(seed):
    rng = random.Random(seed)
    words = ["sort", "list", "why", "index\x1epart", "\x1f3\x1f", "hash", "join", "spill"]
    rows = []
    for conv in range(6):
        said, turn = [], 0
        for _ in range(25):
            lines = []
            for _ in range(rng.randrange(3)):
                if said:
                    quoted, level = rng.choice(said), rng.randrange(1, 4)
                    mark = rng.choice(["> ", ">"]) * level
                    lines += [mark + x for x in quoted] + [""] * rng.randrange(2)
            fresh = [" ".join(rng.choice(words) for _ in range(4)) for _ in range(rng.randrange(1, 3))]
            lines += fresh + rng.choice([[], ["> nobody said this " + str(rng.random())]])
            rows.append((conv, turn, "user", "\n".join(lines)))
            said.append([x.upper() if rng.random() < 0.3 else x for x in fresh])
            turn += rng.choice([1, 1, 1, 2, 5, 3000])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_nested_quotes_and_gaps(spark, seed):
    """Levels, separators in texts and gaps in the turns, against the plain version and the SQL."""
    rows = planted_threads(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = link_quotations(df)
    want = plain_threads(rows)
    found = {(r["conv_id"], r["turn"]): (r["content"], r["n_quoted"], r["n_linked"], r["parent_turn"]) for r in got.collect()}
    assert found == want
    assert sum(x[2] for x in want.values()) > 50 and sum(x[1] > x[2] for x in want.values()) > 5
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    sql = con.sql(chat.ORACLE)
    assert sorted(map(tuple, got.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_turn_gaps_follow_the_last_earlier_turn(spark):
    rows = [(1, t, "user", f"m{t}") for t in (0, 1, 3, 7, 5000, 100_000)]
    out = {r["turn"]: r["parent_turn"] for r in link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {0: None, 1: 0, 3: 1, 7: 3, 5000: 7, 100_000: 5000}
