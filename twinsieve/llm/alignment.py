"""Alignment of two tokenizers' tokens by the bytes they cover, and how often their ids are linked.

The texts of a part of a batch lie behind one another, so that a token has a range of bytes of its own. With pandas'
``merge_asof``, keyed by document, the start of each token finds the token of the other side that covers it; the union
of both directions are all overlapping pairs. Pairs that end together are links, and their ends cut the tokens of both
sides into groups that cover the same bytes.

1. Texts are encoded and aligned by task. A document's row keeps its numbers, the digest of its groups and its distinct
   linked id pairs with their frequencies; the table is written.
2. The frequencies are summed per id pair over the corpus, map-side first, and the highest sum per id of B is taken.
3. Counts of the most frequent pairs, as many as ``HEAD`` allows, go to all tasks as sorted arrays and are summed where
   the rows stand. The other pairs, each of them rare, are joined to their counts and summed per row. Which pairs are in
   the head decides the cost only.

Texts that are null or empty, or whose tokens do not spell the text out (byte by byte, after the space), have no tokens:
zeros and no groups. Repeated rows and ids are rows of their own, and their links count as often. Texts are encoded
whole; one that is longer than a part is a part of its own. Only the id and the text are read, so other columns do not
matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from twinsieve.llm.bpe import byte_symbols
from twinsieve.llm.rows import parts_by_bytes
from twinsieve.plans.workspace import Workspace

#: Bytes of texts that are aligned at once.
PART_BYTES = 1 << 19
#: Id pairs whose counts every task has, at most, and levels of a count per doubling by which they are chosen.
HEAD, LEVELS = 500_000, 8

ALIGNED = ("row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "pairs array<bigint>, times array<bigint>")
SUMMED = "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"


class ByteLevel:
    """Side A: a byte-level tokenizer file, over a space and the text.

    Where a merge's rank is the token's id and words are cut by the usual pattern, as in the known files, tiktoken gives
    the same ids in a third of the time; other files are left to their own library.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = {symbol: i for i, symbol in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if set(token) <= set(byte)}
        special = {t["content"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max(spec["model"]["vocab"].values()))
        for token, i in ranks.items():
            self.bytes[i] = token
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][m] for m in merges]
        cut = spec["pre_tokenizer"] or {}
        plain = (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
                 and not spec["normalizer"] and ids == sorted(ids) and len(merges) + 256 == len(ranks.keys() - {
                     s.encode() for s in special}))
        self.fast = self.tokenizer = None
        if plain:
            words = {t: i for t, i in ranks.items() if t not in {s.encode() for s in special}}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=words, special_tokens={})
            return
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[str]) -> list[list[int]]:
        spaced = [" " + t for t in texts]
        if self.fast:
            return [self.fast.encode_ordinary(t) for t in spaced]
        return [e.ids for e in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]


class Pieces:
    """Side B: a piece model, which puts the space before the text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
                      for i in range(self.model.get_piece_size()) for piece in [self.model.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, read once per worker."""
    return ByteLevel(path_a, public_tokenizers.PATTERN), Pieces(path_b)


def tokens_of(side, ids: list[list[int]]) -> pd.DataFrame:
    """Tokens of consecutive texts: ``doc``, ``id`` and the range of bytes, from ``start`` to ``end``."""
    flat = np.concatenate([np.asarray(i, np.int64) for i in ids]) if ids else np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, side.bytes), np.int64, len(side.bytes))[flat]
    end = np.cumsum(sizes)
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), list(map(len, ids))), "id": flat, "start": end - sizes,
                         "end": end})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs of tokens (``a``, ``b``: places in the tables) that have bytes in common."""
    at = {side: t[["doc", "start"]].assign(**{side: np.arange(len(t)), f"from_{side}": t["start"]})
          for side, t in (("a", a), ("b", b))}
    found = [pd.merge_asof(at[x], at[y], on="start", by="doc") for x, y in (("a", "b"), ("b", "a"))]
    # Where two tokens start together, the first direction has the pair already.
    found[1] = found[1][found[1]["from_a"] != found[1]["from_b"]]
    return pd.concat([f[["a", "b"]] for f in found], ignore_index=True).astype("int64")


class Aligner:
    """Aligns texts of both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = sides(path_a, path_b)
        n = max(len(self.a.bytes), len(self.b.bytes))
        #: Ids as text with what may follow them: the next of the side, the other side, the next group.
        self.written = np.array([[f"{i}{c}" for i in range(n)] for c in ",|;"], object)

    def spelled(self, texts: list) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the tokens are not the text's bytes."""
        some = [i for i, t in enumerate(texts) if t]
        ids: tuple[list, list] = [[] for _ in texts], [[] for _ in texts]
        encoded = [side.encode([texts[i] for i in some]) for side in (self.a, self.b)]
        for i, x, y in zip(some, *encoded):
            want = b" " + texts[i].encode("utf-8", "surrogatepass")
            if all(b"".join(map(side.bytes.__getitem__, t)) == want for side, t in ((self.a, x), (self.b, y))):
                ids[0][i], ids[1][i] = x, y
        return ids

    def align(self, texts: list) -> dict[str, list]:
        """Columns of ``ALIGNED`` of some texts, without row and id."""
        a, b = (tokens_of(side, ids) for side, ids in zip((self.a, self.b), self.spelled(texts)))
        n_a, n_b = (np.bincount(t["doc"], minlength=len(texts)) for t in (a, b))
        both = overlaps(a, b)
        ends = a["end"].to_numpy()[both["a"]]
        links = both[ends == b["end"].to_numpy()[both["b"]]]
        links = links.sort_values("a", kind="stable")
        cuts, doc = a["end"].to_numpy()[links["a"]], a["doc"].to_numpy()[links["a"]]
        n_links = np.bincount(doc, minlength=len(texts))
        code = a["id"].to_numpy()[links["a"]] * len(self.b.bytes) + b["id"].to_numpy()[links["b"]]
        groups = self._groups(a, b, cuts, np.cumsum(n_a + n_b))
        out: dict[str, list] = {"n_a": n_a, "n_b": n_b, "n_groups": n_links, "n_links": n_links, "groups_sha256": groups,
                                "pairs": [], "times": []}
        for part in np.split(code, np.cumsum(n_links)[:-1]) if len(texts) else []:
            pairs, times = np.unique(part, return_counts=True)
            out["pairs"].append(pairs)
            out["times"].append(times)
        return out

    def _groups(self, a: pd.DataFrame, b: pd.DataFrame, cuts: np.ndarray, stops: np.ndarray) -> list[str]:
        """Digests of the groups, one per text; ``stops`` are the places where texts end in the tokens of both sides."""
        group = np.concatenate([np.searchsorted(cuts, t["end"].to_numpy()) for t in (a, b)])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        group, side, ids = group[order], side[order], np.concatenate([a["id"], b["id"]])[order].astype(np.int64)
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)[:len(ids)]
        shown = self.written[np.where(last, 1 + side, 0), ids]
        return [hashlib.sha256("".join(shown[i:j])[:-1].encode()).hexdigest() if j > i else ""
                for i, j in zip([0, *stops[:-1]], stops)]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The table ``ALIGNED``: per document its numbers, the digest of its groups and its linked id pairs.

    A pair's code is A's id times the size of B's vocabulary plus B's id.
    """
    arrow = to_arrow_schema(StructType.fromDDL(ALIGNED))

    def batches(incoming):
        aligner = Aligner(path_a, path_b)
        for batch in incoming:
            texts = batch.column(2).to_pylist()
            for start, stop in parts_by_bytes([len(t or "") for t in texts], PART_BYTES):
                found = aligner.align(texts[start:stop])
                rows = batch.slice(start, stop - start)
                columns = [pa.array(found[f.name], f.type) for f in list(arrow)[2:]]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], schema=arrow)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       "text").mapInArrow(batches, ALIGNED)


def pair_counts(ws: Workspace, table: DataFrame, size_b: int) -> DataFrame:
    """``pair``, ``n`` (its links in all documents) and ``best`` (no other pair of its id of B has more)."""
    uses = table.select(F.explode(F.arrays_zip("pairs", "times")).alias("u")).select("u.pairs", "u.times")
    counts = ws.save(uses.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pair_counts")
    id_b = (F.col("pair") % size_b).alias("id_b")
    # One row per id of B's vocabulary.
    most = F.broadcast(counts.groupBy(id_b).agg(F.max("n").alias("most")))
    return counts.withColumn("id_b", id_b).join(most, "id_b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(known: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of ``known`` with the highest counts, at most ``limit``, ascending by pair: pair, n, best."""
    leveled = known.withColumn("level", F.floor(F.log2("n") * LEVELS).cast("int"))
    least, total = None, 0
    for row in sorted(leveled.groupBy("level").count().collect(), reverse=True):
        total += row["count"]
        if total > limit:
            break
        least = row["level"]
    chosen = leveled.where(F.lit(False) if least is None else F.col("level") >= least)
    head = chosen.select("pair", "n", "best").toArrow().sort_by("pair")
    return (head["pair"].to_numpy(), head["n"].to_numpy(), head["best"].to_numpy().astype(bool))


def _sums(table: DataFrame, head: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Per row, the sums over pairs of the head, and the other pairs."""
    arrow = to_arrow_schema(StructType.fromDDL(SUMMED))
    shared = table.sparkSession.sparkContext.broadcast(head)

    def batches(incoming):
        pair, n, best = shared.value
        for batch in incoming:
            lists = [batch.column(i) for i in (1, 2)]
            rows = len(lists[0])
            pairs, times = (np.asarray(c.flatten(), np.int64) for c in lists)
            owner = np.repeat(np.arange(rows), np.asarray(lists[0].value_lengths().fill_null(0), np.int64))
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            known = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            sums, bests = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(sums, owner[known], times[known] * n[at[known]])
            np.add.at(bests, owner[known], times[known] * best[at[known]])
            offsets = np.append(0, np.cumsum(np.bincount(owner[~known], minlength=rows))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[~known])) for x in (pairs, times)]
            columns = [batch.column(0), pa.array(bests), pa.array(sums), *rest]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return table.select("row", "pairs", "times").mapInArrow(batches, SUMMED)


def linked(ws: Workspace, docs: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``."""
    table = ws.save(aligned(docs, path_a, path_b), "aligned")
    known = pair_counts(ws, table, len(sides(path_a, path_b)[1].bytes))
    summed = ws.save(_sums(table, frequent(known, head)), "summed")
    uses = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("u")).select(
        "row", F.col("u.pairs").alias("pair"), F.col("u.times").alias("times"))
    rare = (uses.join(known, "pair").groupBy("row")
            .agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("rare_best"),
                 F.sum(F.col("times") * F.col("n")).alias("rare_sum")))
    numbers = table.drop("pairs", "times").join(summed.drop("pairs", "times"), "row").join(rare, "row", "left")
    nought = F.lit(0).cast("bigint")
    return numbers.select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                          (F.col("n_best") + F.coalesce("rare_best", nought)).alias("n_best"),
                          (F.col("count_sum") + F.coalesce("rare_sum", nought)).alias("count_sum"), "groups_sha256")
