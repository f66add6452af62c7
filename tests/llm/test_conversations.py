"""Quotations against a plain version."""

import random

import pytest

from twinsieve.llm import quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, body string"
LINES = ["How do I build it at all?", "Use make for that, it is simple.", "It fails with an error here.",
         "You are most welcome, friend.", "yes", "Which error do you see?", "Thanks a lot for help."]


def generated(seed):
    """Conversations whose messages quote earlier ones, one or two levels deep, and what each replies to."""
    rng, rows, truth = random.Random(seed), [], {}
    for conv in range(12):
        bodies: list[str] = []
        for turn in range(7):
            body = f"{rng.choice(LINES)}\nand number {conv} {turn} comes here"
            parent = rng.randrange(turn) if turn and rng.random() < 0.8 else None
            text = body
            if parent is not None:
                quoted = bodies[parent]
                older = truth[conv, parent]
                lines = [f"> {x.upper()}  " for x in quoted.split("\n")]
                if older is not None and rng.random() < 0.5:
                    lines = [f"> > {x}" for x in bodies[older].split("\n")] + lines
                head = "On Monday, Ann wrote:\n" if rng.random() < 0.5 else ""
                text = f"{head}{chr(10).join(lines)}\n\n{body}"
            bodies.append(body)
            truth[conv, turn] = parent
            rows.append((conv, turn, "user", text, "clash"))
    return rows, truth


@pytest.mark.parametrize("seed", [1, 2])
def test_replies(spark, ws, seed):
    rows, truth = generated(seed)
    got = quotes.reply_order(ws, spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["conv_id"], r["thread"], r["turn"]) for r in got] == sorted((r["conv_id"], r["thread"], r["turn"]) for r in got)
    for r in got:
        key, chain = (r["conv_id"], r["turn"]), []
        assert r["reply_to"] == truth[key]
        while truth[key] is not None:
            key = key[0], truth[key]
            chain.append(key[1])
        assert (r["thread"], r["depth"]) == (key[1], len(chain))
        assert ">" not in r["body"] and "wrote" not in r["body"] and f"number {r['conv_id']} {r['turn']}" in r["body"]


def test_levels():
    blocks = quotes.split_levels("a\n> b\n>> c\n> > d\n>e\n  > f\ng")
    assert blocks == [(0, ["a"]), (1, ["b"]), (2, ["c", "d"]), (1, ["e", "f"]), (0, ["g"])]


def test_edges(spark, ws):
    rows = [(1, 0, "u", None, ""), (1, 1, "u", "", ""), (None, 0, "u", "> a b c", ""), (1, None, "u", "> a b c", ""),
            (2, 0, "u", "the same words here", ""), (2, 1, "u", "the same words here", ""),
            (2, 2, "u", "> The same words here!\nfirst", ""), (2, 2, "v", "> nothing of the kind\nsecond", ""),
            (3, 0, "u", "> quotes what comes later\nx", ""), (3, 1, "u", "quotes what comes later", ""),
            (4, 0, "u", ">" * 50_000, ""), (4, 1, "u", "word " * 50_000, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = quotes.reply_order(ws, frame).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"], r["role"]): r for r in got}
    assert by[2, 2, "u"]["reply_to"] == by[2, 2, "v"]["reply_to"] == 0 and by[2, 2, "v"]["body"] == "second"
    assert by[3, 0, "u"]["reply_to"] is None and by[1, 0, "u"]["body"] == "" and by[None, 0, "u"]["n_passages"] == 1
    assert quotes.reply_order(ws, frame.limit(0)).count() == 0


def test_a_long_chain(spark, ws):
    rows = [(0, t, "u", (f"> remark number {t - 1} of the chain\n" if t else "") + f"remark number {t} of the chain", "")
            for t in range(70)]
    got = quotes.reply_order(ws, spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["thread"], r["depth"]) for r in got] == [(0, t) for t in range(70)]
