"""Conversations in reply order, without the quotations that tell who replies to whom.

1. Lines with leading ``>`` signs are quoted, one level per sign. Consecutive lines of a level are a passage; the rest,
   without lines that announce a quotation, is the message's body.
2. Bodies and passages are cut in units (the whole, its paragraphs, its lines), which are hashed after normalisation:
   small letters, single spaces, no edge punctuation.
3. The original of a unit is the first message of the conversation whose own body has it, so each unit has one row to
   join, however often it is repeated. A passage is linked through its longest unit that has an earlier original.
4. A message replies to the original of its longest linked passage of the lowest level. Threads and depths follow by
   pointer doubling, a written table per round. Conversations are ordered by thread and turn, a reply after what it
   replies to.

Null texts count as empty: no body, no passages. Messages without a conversation or turn are threads of their own and
come first. Messages that repeat a turn share its reply; each row stays. A hot conversation or unit is only split work:
its keys have one row on the joined side, and adaptive execution splits the other. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import string

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.rows import struct_udf
from twinsieve.plans.workspace import Workspace

#: Units of fewer words are only compared as a whole passage or body.
MIN_UNIT_WORDS = 3

MARKS = re.compile(r"[ \t]*(?:>[ \t]?)+")
ANNOUNCES = re.compile(r"(?:on\b.{0,200}|.{0,100}\b)(?:wrote|writes|said|says)\s*:\s*", re.IGNORECASE)
EDGES = string.punctuation + string.whitespace

UNIT = "array<struct<unit: bigint, words: int>>"
PARSED = (f"body string, max_level int, own {UNIT}, "
          f"passages array<struct<level: int, passage: int, units: {UNIT}>>")


def split_levels(text: str) -> list[tuple[int, list[str]]]:
    """Consecutive lines by quote level, marks removed."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        marks = MARKS.match(line)
        level, rest = (marks.group().count(">"), line[marks.end():]) if marks else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
    return out


def normalised(text: str) -> str:
    return " ".join(text.lower().split()).strip(EDGES)


def hashed(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 0)).view(np.int64))


def units(lines: list[str]) -> list[dict]:
    """Hashes of the whole, the paragraphs and the lines of a text, each once, and their numbers of words."""
    whole = "\n".join(lines)
    parts = [whole, *re.split(r"\n[ \t\r]*\n", whole), *lines]
    found: dict[int, int] = {}
    for i, part in enumerate(parts):
        plain = normalised(part)
        words = plain.count(" ") + 1
        if plain and (i == 0 or words >= MIN_UNIT_WORDS):
            found.setdefault(hashed(plain), words)
    return [{"unit": k, "words": v} for k, v in found.items()]


def without_announcement(lines: list[str]) -> list[str]:
    """Lines before a quotation, without the one that announces it and blank ones around that."""
    kept = list(lines)
    while kept and not kept[-1].strip():
        kept.pop()
    if kept and ANNOUNCES.fullmatch(kept[-1].strip()):
        kept.pop()
        return kept
    return list(lines)


def parsed(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {"body": [], "max_level": [], "own": [], "passages": []}
    for text in texts:
        blocks = split_levels(text or "")
        own: list[str] = []
        passages = []
        for i, (level, lines) in enumerate(blocks):
            if level:
                passages.append({"level": level, "passage": len(passages), "units": units(lines)})
            else:
                own += without_announcement(lines) if i + 1 < len(blocks) else lines
        body = "\n".join(own).strip()
        out["body"].append(body)
        out["max_level"].append(max(level for level, _ in blocks))
        out["own"].append(units(body.split("\n")))
        out["passages"].append(passages)
    return out


def parse(text: Column | str) -> Column:
    """Struct of a message's ``body``, highest quote level, own units, and quoted passages."""
    return struct_udf(parsed, PARSED)(text)


def quotation_links(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``passage``, ``level``, ``words`` and the ``original`` turn of each linked passage.

    ``messages`` has conv_id, turn, own and passages.
    """
    known = messages.where("conv_id is not null and turn is not null")
    originals = (known.select("conv_id", "turn", F.explode("own").alias("u")).groupBy("conv_id", "u.unit")
                 .agg(F.min("turn").alias("original")))
    quoted = (known.select("conv_id", "turn", F.explode("passages").alias("p"))
              .select("conv_id", "turn", "p.passage", "p.level", F.explode("p.units").alias("u"))
              .select("conv_id", "turn", "passage", "level", "u.unit", "u.words"))
    found = quoted.join(originals, ["conv_id", "unit"]).where("original < turn")
    best = F.max(F.struct("words", "original")).alias("best")
    return (found.groupBy("conv_id", "turn", "passage", "level").agg(best)
            .select("conv_id", "turn", "passage", "level", "best.words", "best.original"))


def threads(ws: Workspace, replies: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``thread`` (the turn a chain of replies began with) and ``depth`` of every reply.

    ``replies`` has one row (conv_id, turn, reply_to) per replying turn, with reply_to < turn.
    """
    now = ws.save(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"),
                                 F.lit(1).cast("bigint").alias("depth")), "chains")
    while True:
        above = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"),
                           F.col("depth").alias("more"))
        joined = now.join(above, ["conv_id", "thread"], "left")
        after = ws.save(joined.select("conv_id", "turn", F.coalesce("higher", "thread").alias("thread"),
                                      (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                                      F.col("higher").isNotNull().alias("moved")), "chains")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def reply_order(ws: Workspace, conversations: DataFrame) -> DataFrame:
    """Messages of ``conversations`` (conv_id, turn, role, text) in reply order, quotations taken out of the ``body``."""
    messages = ws.save(conversations.select("conv_id", "turn", "role", parse("text").alias("p"))
                       .select("conv_id", "turn", "role", "p.*"), "messages")
    links = ws.save(quotation_links(messages), "quotations")
    first = F.max(F.struct((-F.col("level")).alias("level"), "words", "original"))
    replies = ws.save(links.groupBy("conv_id", "turn").agg(first.alias("best"), F.count("passage").alias("n"))
                      .select("conv_id", "turn", F.col("best.original").alias("reply_to"),
                              F.col("n").alias("n_linked")), "replies")
    placed = replies.join(threads(ws, replies), ["conv_id", "turn"], "left")
    rows = messages.join(placed, ["conv_id", "turn"], "left")
    return rows.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "role", "reply_to",
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.size("passages").cast("bigint").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "body").orderBy("conv_id", "thread", "turn")
