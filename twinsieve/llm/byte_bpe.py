"""Byte-level byte pair encoding by Spark's own functions: ranked merges folded over the bytes of words.

The vocabulary is a file of ranks: tokens are byte strings, and a token's rank is its id. A text is cut into words by
the vocabulary's pattern, and each word is encoded by itself:

1. A word's bytes become an array of tokens, or a string with one character for each token: the one whose code
   point is the rank plus ``FIRST``. One step of the fold looks up what every two neighbours merge to, takes the lowest
   rank, and replaces that pair, from the left, wherever it stands. It ends when no two neighbours merge. Replacing all
   places at once gives what one at a time gives, since a pair that arises from a merge has a higher rank than the merge.
2. The ranks are a literal table in the plan, from pairs of tokens to the token they merge to. Spark finds a map's key by
   looking at one key after the other, so the map is an array, in which each pair has a slot of its own
   (``MergeTable``): few integers are computed for a pair, however many there are.
   Words of up to ``LONG`` bytes are folded as arrays of ranks, one place at a time, and a merge looks up the two pairs it
   makes; longer parts as said, as strings.
3. The distinct words of the corpus are counted. The most frequent ones, as many as ``HEAD`` slots take, are encoded once
   and become a table that a subquery hands to the tasks (``Head``). All other words, each of them rare, are folded where
   they stand: to bring their ids back by a join would shuffle the whole corpus. Which words are in the head decides the
   cost only.
4. A word longer than ``LONG`` bytes is first cut between bytes that stand side by side in no token.

Ids decode to their tokens' bytes, concatenated. Strings of bytes have a character for each byte (Latin-1).

Null and empty texts have no ids. Repeated rows and ids are encoded row by row. Texts and words of any length are
encoded whole. ``encoded`` takes other columns along; of those that clash with its own, its own win. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import json
import random
import re
from collections.abc import Callable
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.plans.workspace import Workspace

#: Slots for distinct words that are encoded once for all rows.
HEAD = 1 << 20
#: Bytes of the longest word of the head, and of the longest word that is folded without certain cuts.
LONG = 64
#: Code point of the character of the token with rank 0.
FIRST = 0x10000
#: Bits of a rank where two are held in one number, and a rank that no merge has.
BITS = 20
LOW, NONE = (1 << BITS) - 1, 1 << 2 * BITS
#: A character that is neither a byte nor a token: where to cut, and the end of a word that is done.
MARK = "\uFDD0"
#: White space as Unicode has it; Java's own class knows less.
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"


def let(value: Column, kind: str, body: Callable[[Column], Column]) -> Column:
    """``body``, of the type ``kind``, of a value that is computed once.

    A fold over one value: unlike ``transform``, it copies nothing.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))


class Head:
    """Ids of frequent words, in a table with slots by the words' hash: one row with a struct, ``KIND``. A word has a slot in each of two halves, and
    of the words of a slot the most frequent one takes it. Words with neither slot are not in the head, and not encoded here.
    """

    KIND = "struct<words:array<string>,ids:array<array<int>>>"

    def __init__(self, ws: Workspace, words: DataFrame, limit: int, encode_word: Callable[[Column], Column]):
        """``words`` has ``word`` and ``n``; the table has ``limit`` slots at most."""
        words, seen = ws.save_counted(words, "words")
        self.size, self.table = 1 << max(0, (min(limit, 2 * seen["n"]) // 2).bit_length() - 1), None
        if min(limit, seen["n"]) < 2:
            return
        taken, rest = [], words.select("word", "n")
        for half in range(2):
            by_slot = Window.partitionBy("slot").orderBy(F.desc("n"), "word")
            ranked = rest.withColumn("slot", self.slots(F.col("word"))[half]).withColumn("place", F.row_number().over(by_slot))
            ranked = ws.save(ranked, "head-half")
            taken.append(ranked.where("place = 1").select("slot", "word"))
            rest = ranked.where("place > 1").select("word", "n")
        # A counted word is short, but to encode it is work: spread it evenly.
        spread = taken[0].unionByName(taken[1]).repartition(4 * ws.parallelism)
        encoded = spread.withColumn("ids", encode_word(F.col("word")))
        slots = ws.spark.range(2 * self.size).select(F.col("id").cast("int").alias("slot"))
        rows = F.array_sort(F.collect_list(F.struct("slot", "word", "ids"))).alias("rows")
        self.table = ws.save(slots.join(encoded, "slot", "left").agg(rows).select(
            F.struct(F.col("rows.word").alias("words"), F.col("rows.ids").alias("ids")).alias("head")), "head")

    def slots(self, word: Column) -> list[Column]:
        code, mask = F.xxhash64(word), F.lit(self.size - 1)
        return [code.bitwiseAND(mask).cast("int"), F.shiftright(code, 32).bitwiseAND(mask).cast("int") + self.size]

    def beside(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the table as a column. It comes from a subquery, which Spark does not take within a fold: it puts it
        there itself, if the column is used once only, and then copies nothing."""
        empty = F.lit(None).cast(self.KIND)
        return rows.withColumn(name, empty if self.table is None else self.table.scalar())

    def as_literal(self) -> Column:
        """The table as a literal, which stands in the plan and in every text that Spark keeps of it: for small heads."""
        found = [] if self.table is None else self.table.select(F.to_json("head")).collect()
        return F.from_json(F.lit(found[0][0]), self.KIND) if found else F.lit(None).cast(self.KIND)

    def within(self, table: Column, kind: str, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """``body`` of the lookup in ``table``, which gives null for words that are not there."""
        def found(words: Column, ids: Column, word: Column) -> Column:
            one, two = self.slots(word)
            return F.when(F.get(words, one) == word, F.get(ids, one)).when(F.get(words, two) == word, F.get(ids, two))

        return let(table, kind, lambda t: let(t["words"], kind, lambda words: let(
            t["ids"], kind, lambda ids: body(lambda word: found(words, ids, word)))))


class MergeTable:
    """The token that two tokens' ranks merge to, as two literal arrays.

    A pair (a, b) belongs to one of many small groups, and its slot is a linear form of the ranks, shifted by its group,
    modulo the size of the table. Shifts are chosen, for large groups first, so that no two pairs have the same slot. A
    slot holds both ranks' key and the merged rank. Factors are small: all but the key is computed as int. The rank after
    the last one, ``end``, merges with nothing.
    """

    def __init__(self, pairs: dict[tuple[int, int], int], end: int):
        bits = max(4, (2 * len(pairs)).bit_length())
        size, self.mask, self.groups, self.end = 1 << bits, (1 << bits) - 1, (1 << bits - 2) - 1, end
        rng, fits = random.Random(11), False
        while not fits:
            self.factors = [rng.randrange(1, 1 << 30 - BITS, 2) for _ in range(2)]
            fits, shifts, slots = self.placed(pairs, rng, size)
        self.shifts, self.slots = literal(shifts, "array<int>"), literal(slots, "array<bigint>")

    def placed(self, pairs: dict[tuple[int, int], int], rng: random.Random, size: int) -> tuple[bool, list[int], list[int]]:
        """Whether all pairs have a slot of their own, the groups' shifts and the table."""
        p, q = self.factors
        groups: dict[int, list[tuple[int, int]]] = {}
        for (a, b), rank in pairs.items():
            groups.setdefault(a + b * p & self.groups, []).append((a * q + b, a << 2 * BITS | b << BITS | rank))
        shifts, slots = [0] * (self.groups + 1), [-1] * size
        for group, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len({at & self.mask for at, _ in members}) < len(members) or len(members) > 24:
                return False, [], []
            while any(slots[at + shifts[group] & self.mask] >= 0 for at, _ in members):
                shifts[group] = rng.randrange(size)
            for at, entry in members:
                slots[at + shifts[group] & self.mask] = entry
        return True, shifts, slots

    def within(self, kind: str, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
        """``body`` of the lookup, which gives null for pairs that do not merge. The literals are in the plan once."""
        p, q = self.factors

        def found(shifts: Column, slots: Column, a: Column, b: Column) -> Column:
            shift = F.get(shifts, (a + b * p).bitwiseAND(self.groups))
            return let(F.get(slots, (a * q + b + shift).bitwiseAND(self.mask)), "int", lambda entry: F.when(
                F.shiftright(entry, BITS) == F.shiftleft(a.cast("bigint"), BITS).bitwiseOR(b),
                entry.bitwiseAND(LOW).cast("int")))

        return let(self.shifts, kind, lambda shifts: let(
            self.slots, kind, lambda slots: body(lambda a, b: found(shifts, slots, a, b))))


def literal(value, kind: str) -> Column:
    """A nested literal; Catalyst folds the parsing away."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


@lru_cache(maxsize=4)
def rank_file(path: str) -> dict[str, int]:
    """Tokens of a file of ranks, as strings of bytes."""
    with open(path, "rb") as file:
        return {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in map(bytes.split, file)}


def java_patterns(spark: SparkSession, pattern: str) -> tuple[str, str, str]:
    """The pattern with Unicode's white space; the same with the letters and numbers that this Java does not know yet;
    and a pattern that finds one of those, in texts that need the second form."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    newer = {}
    for kind in "LN":
        members = "".join(regex.findall(rf"\p{{{kind}}}+", everything))
        newer[kind] = spark.sql(rf"select regexp_replace(:all, '\\p{{{kind}}}+', '') as x", {"all": members}).head()["x"]

    def spelled(more: dict[str, str]) -> str:
        known = {r"\s": SPACE} | {rf"\p{{{kind}}}": rf"\p{{{kind}}}" + ranges(chars) for kind, chars in more.items() if chars}
        parts = re.split(r"(\[[^\]]*\])", pattern.replace(r"\S", r"[^\s]"))
        for name, members in known.items():
            parts = [p.replace(name, members if p.startswith("[") else f"[{members}]") for p in parts]
        return "".join(parts)

    both = newer["L"] + newer["N"]
    some = rf"[\x{{{ord(min(both)):x}}}-\x{{{ord(max(both)):x}}}&&[{ranges(both)}]]" if both else "(?!)"
    return spelled({}), spelled(newer), some


def ranges(characters: str) -> str:
    """Members of a character class."""
    codes = sorted(map(ord, characters))
    first = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    last = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(first, last))


class ByteBpe:
    """Column functions that encode words by a file of ranks and decode ids.

    Encoded words and texts are strings of tokens' characters; ``ids_of`` makes them ids.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        tokens = rank_file(path)
        self.pattern, self.full_pattern, self.newer = java_patterns(spark, pattern)
        self.merges = MergeTable({(tokens[token[:i]], tokens[token[i:]]): rank
                                  for token, rank in tokens.items() for i in range(1, len(token))
                                  if token[:i] in tokens and token[i:] in tokens}, 1 + max(tokens.values()))
        #: By rank, its character; by byte, its rank.
        self.characters = literal([chr(FIRST + rank) for rank in range(1 + max(tokens.values()))], "array<string>")
        self.byte_ranks = literal([tokens[chr(b)] for b in range(256)], "array<int>")
        self.bytes = "".join(map(chr, range(256)))
        self.first = "".join(chr(FIRST + tokens[b]) for b in self.bytes)
        named = [""] * (1 + max(tokens.values()))
        after: list[set[str]] = [set() for _ in range(256)]
        for token, rank in tokens.items():
            named[rank] = token
            for a, b in zip(token, token[1:]):
                after[ord(a)].add(b)
        self.tokens = literal(named, "array<string>")
        #: By byte, all bytes that follow it in some token.
        self.inner = literal(["".join(sorted(a)) for a in after], "array<string>")

    def words(self, text: Column | str) -> Column:
        text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
        found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (self.pattern, self.full_pattern)]
        return F.when(text.rlike(self.newer), found[1]).otherwise(found[0])

    def fold(self, data: Column, merge: Callable[[Column, Column], Column]) -> Column:
        """The tokens of a string of bytes after all merges, as characters."""
        return let(self.characters, "string", lambda of: F.array_join(F.transform(
            self.fold_ids(data, merge), lambda t: F.get(of, t)), ""))

    def fold_ids(self, data: Column, merge: Callable[[Column, Column], Column]) -> Column:
        """The ids of a string of bytes after all merges."""
        return F.when(F.length(data) <= LONG, self.fold_short(data, merge)).otherwise(
            F.transform(F.split(self.fold_long(data, merge), ""), lambda t: F.ascii(t) - FIRST))

    def fold_short(self, data: Column, merge: Callable[[Column, Column], Column]) -> Column:
        """One place at a time. A place holds the rank it merges to with the next one, and in its lower bits its token.

        A merge changes two places only, so few pairs are looked up. The least rank comes with its place as the least of
        their combinations; ``array_position`` ends by an exception, which takes longer than the merge.
        """
        kind = "array<bigint>"

        def place(a: Column, b: Column) -> Column:
            return F.coalesce(F.shiftleft(merge(a, b).cast("bigint"), BITS), F.lit(NONE)).bitwiseOR(a)

        def token(places: Column, at: Column) -> Column:
            return F.get(places, at).bitwiseAND(LOW).cast("int")

        def joined(places: Column, rank: Column, at: Column) -> Column:
            return F.concat(F.slice(places, F.lit(1), at - 1),
                            F.array(place(token(places, at - 1), rank), place(rank, token(places, at + 2))),
                            F.slice(places, at + 3, F.size(places)))

        def step(places: Column, _: Column) -> Column:
            least = F.array_min(F.transform(places, lambda x, at: x.bitwiseAND(~LOW).bitwiseOR(at)))
            return let(least, kind, lambda x: F.when(x >= NONE, places).otherwise(let(
                x.bitwiseAND(LOW).cast("int"), kind, lambda at: joined(places, F.shiftright(x, BITS).cast("int"), at))))

        end = F.array(F.lit(self.merges.end))
        tokens = let(self.byte_ranks, "array<int>", lambda ranks: F.concat(end, F.transform(
            F.split(data, ""), lambda byte: F.get(ranks, F.ascii(byte))), end))
        start = let(tokens, kind, lambda t: F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), place))
        places = F.aggregate(F.sequence(F.lit(1), F.length(data)), start, step)
        return let(places, "array<int>", lambda x: F.transform(
            F.slice(x, F.lit(2), F.size(x) - 2), lambda x: x.bitwiseAND(LOW).cast("int")))

    def fold_long(self, data: Column, merge: Callable[[Column, Column], Column]) -> Column:
        """All places of a pair at a time, on a string of tokens."""
        def merged(a: Column, b: Column) -> Column:
            return let(self.characters, "string", lambda of: F.get(of, merge(F.ascii(a) - FIRST, F.ascii(b) - FIRST)))

        def joined(tokens: Column, neighbours: Column) -> Column:
            found = F.transform(neighbours, lambda pair: merged(pair, F.substring(pair, 2, 1)))
            least = F.array_min(found)
            pair = neighbours[F.array_position(found, least).cast("int") - 1]
            return F.when(least.isNull(), F.concat(tokens, F.lit(MARK))).otherwise(F.replace(tokens, pair, least))

        def step(tokens: Column, _: Column) -> Column:
            each = F.split(tokens, "")
            neighbours = F.zip_with(each, F.slice(each, F.lit(2), F.size(each)), lambda a, b: F.concat(a, b))
            more = F.aggregate(F.array(neighbours), tokens, joined)
            return F.when((F.length(tokens) == 1) | F.endswith(tokens, F.lit(MARK)), tokens).otherwise(more)

        start = F.translate(data, self.bytes, self.first)
        return F.aggregate(F.sequence(F.lit(1), F.length(data)), start, step, lambda t: F.replace(t, F.lit(MARK), F.lit("")))

    def cut(self, data: Column) -> Column:
        """Parts of a string of bytes between bytes that stand side by side in no token."""
        each = F.split(data, "")
        both = let(self.inner, "array<string>", lambda inner: F.zip_with(
            each, F.slice(each, F.lit(2), F.size(each)),
            lambda a, b: F.when(F.instr(inner[F.ascii(a)], b) == 0, F.concat(a, F.lit(MARK))).otherwise(a)))
        return F.split(F.array_join(both, ""), MARK)

    def _encode_word(self, word: Column, merge: Callable[[Column, Column], Column]) -> Column:
        def ids(data: Column) -> Column:
            return F.when(F.length(data) <= LONG, self.fold_short(data, merge)).otherwise(
                F.flatten(F.transform(self.cut(data), lambda part: self.fold_ids(part, merge))))

        return let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "array<int>", ids)

    def encode_word(self, word: Column) -> Column:
        """The ids of a word."""
        return self.merges.within("array<int>", lambda merge: self._encode_word(word, merge))

    def encode(self, text: Column | str, head: Head, table: Column | None = None) -> Column:
        """The ids of a text, word by word; words of ``head`` are looked up, in its ``table`` or else in a literal."""
        kind, table = "array<int>", head.as_literal() if table is None else table
        return self.merges.within(kind, lambda merge: head.within(table, kind, lambda known: F.flatten(F.transform(
            self.words(text), lambda word: F.coalesce(known(word), self._encode_word(word, merge))))))

    @staticmethod
    def ids_of(tokens: Column) -> Column:
        """The ids of an encoded text: they are its tokens."""
        return tokens

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for: their tokens, concatenated."""
        pieces = let(self.tokens, "array<string>", lambda tokens: F.transform(ids, lambda i: tokens[i]))
        return F.encode(F.array_join(pieces, ""), "ISO-8859-1")

    def head(self, ws: Workspace, texts: DataFrame, limit: int = HEAD) -> Head:
        """Ids of the most frequent distinct words of ``text``, at most ``limit``, each encoded once."""
        counted = (texts.select(F.explode(self.words("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
                   .where((F.col("n") > 1) & (F.octet_length("word") <= LONG)))
        return Head(ws, counted, limit, self.encode_word)


def encoded(ws: Workspace, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (binary), what they decode to."""
    bpe = ByteBpe(ws.spark, path, pattern)
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "decoded")]
    head, name = bpe.head(ws, docs.select("text")), "_" * (1 + max(map(len, docs.columns)))
    tokens = head.beside(docs, name).select(*others, bpe.ids_of(bpe.encode("text", head, F.col(name))).alias("ids"))
    return tokens.withColumn("decoded", bpe.decode(F.col("ids")))
