"""Numbers of tokens of texts, counted once per distinct pre-token.

A text's tokens are the sum over its pre-tokens. A pre-token here is a run without white space: the tokenizer drops
white space and never joins across it, so counts of runs add up to the count of the text. Ids are never kept.

1. Tasks tally pre-tokens of bounded length in tables of bounded size. The ``HEAD`` most frequent ones are counted, each
   once, and go to all tasks; their number and bytes are bounded, and which they are decides the cost only.
2. Each text's pre-token frequencies are taken. Those of the head are summed at once; the others, mostly rare words,
   stay as a list with the text's row, in a table that is written to a shared folder.
3. The distinct pre-tokens of these lists are counted, each once in the whole corpus, joined to the frequencies, and
   summed per row.

So what is shuffled are rare pre-tokens only; a very common one is in the head and no key of a join.

Null texts count as empty and have zero tokens and bytes. Repeated rows and ids each get a row. Only the id and the
text are read, so other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from twinsieve.llm.bpe import loaded
from twinsieve.plans.workspace import Workspace

#: Pre-tokens whose counts every task has.
HEAD = 200_000
#: Entries of a task's tally; it falls back to the more frequent half when full.
TALLY_ENTRIES = 600_000
#: Bytes of the longest pre-token of a tally and so of the head; longer ones are joined, however frequent.
TALLY_BYTES = 64

FREQUENCIES = ("row bigint, doc_id bigint, n_bytes bigint, head_tokens bigint, "
               "tokens array<binary>, freqs array<int>")


def runs_of(raw: bytes) -> list[bytes]:
    """Pre-tokens. ASCII letters become small as the tokenizer makes them, unless special tokens could come about."""
    return raw.split() if b"<|" in raw else raw.lower().split()


def tallied(docs: DataFrame, entries: int = TALLY_ENTRIES) -> DataFrame:
    """Pre-tokens and how often tasks have seen them; rare ones may be missing."""

    def batches(incoming):
        tally: Counter = Counter()
        for batch in incoming:
            for text in batch.column(0):
                tally.update([r for r in runs_of((text.as_py() or "").encode("utf-8", "surrogatepass"))
                              if len(r) <= TALLY_BYTES])
                if len(tally) > entries:
                    tally = Counter(dict(tally.most_common(entries // 2)))
        some = tally.most_common(entries // 2)
        for at in range(0, len(some), 50_000):
            tokens, counts = zip(*some[at:at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(counts, pa.int64())],
                                             names=["token", "n"])

    per_task = docs.select("text").mapInArrow(batches, "token binary, n bigint").where("n > 1")
    return per_task.groupBy("token").agg(F.sum("n").alias("n"))


def counter(path: str):
    """A column function: the number of tokens of a pre-token."""

    @F.arrow_udf("int")
    def count(tokens: pa.Array) -> pa.Array:
        return pa.array(loaded(path).counts(tokens.to_pylist()), pa.int32())

    return count


def frequencies(docs: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """Per row: the tokens of head pre-tokens, and the other pre-tokens with their frequencies."""
    arrow = to_arrow_schema(StructType.fromDDL(FREQUENCIES))
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def batches(incoming):
        get = shared.value.get
        for batch in incoming:
            sizes, sums, tokens, freqs = [], [], [], []
            for text in batch.column(2):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                total, rest, times = 0, [], []
                for token, n in Counter(runs_of(raw)).items():
                    known = get(token)
                    if known is None:
                        rest.append(token)
                        times.append(n)
                    else:
                        total += known * n
                sizes.append(len(raw))
                sums.append(total)
                tokens.append(rest)
                freqs.append(times)
            columns = [batch.column(0), batch.column(1), *(pa.array(c, f.type) for c, f in
                                                           zip((sizes, sums, tokens, freqs), list(arrow)[2:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select("row", "doc_id", "text").mapInArrow(batches, FREQUENCIES)


def token_counts(ws: Workspace, docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                 head: int = HEAD) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("bigint").alias("doc_id"),
                       F.col(text_column).alias("text"))
    common = tallied(rows).orderBy(F.desc("n"), "token").limit(head).select("token")
    known = {bytes(r["token"]): r["n"] for r in common.withColumn("n", counter(path)("token")).collect()}
    table = ws.save(frequencies(rows, known), "frequencies")
    uses = table.select("row", F.explode(F.arrays_zip("tokens", "freqs")).alias("u")).select(
        "row", F.col("u.tokens").alias("token"), F.col("u.freqs").alias("freq"))
    counted = uses.select("token").distinct().withColumn("n", counter(path)("token"))
    sums = (uses.join(counted, "token").groupBy("row").agg(F.sum(F.col("freq") * F.col("n")).alias("rare_tokens")))
    return table.select("row", "doc_id", "n_bytes", "head_tokens").join(sums, "row", "left").select(
        "doc_id", "n_bytes", (F.col("head_tokens") + F.coalesce("rare_tokens", F.lit(0))).alias("n_tokens"))
