"""Byte-level encoding by Spark's functions against the library of rank files."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from twinsieve.llm import byte_bpe
from twinsieve.llm.queries import BYTE_RANKS, op11_byte_bpe

ODD = [None, "", " ", "a", "\n\n  a\t\tb", "don't we'LL I'm", "x<|endoftext|>y", "É ñ ß İ Σς ﬁ", "a\x85b　c\x1cd",
       "字漢字かなカナ가나" * 20, "😀👍🏽 ok", "1234567 ½³", "ab" * 3000, " " * 5000 + "x", "x" * 20_000, "᲋ㄳᲉa", "\0\x01",
       "a\uFDD0b \uFDD0the\uFDD1 \uFDD1\uFDD0", "the\uFDD1x\uFDD0cat the\uFDD1x\uFDD0cat"]


@pytest.fixture(scope="module")
def library():
    with open(BYTE_RANKS, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own(spark):
    return byte_bpe.ByteBpe(spark, BYTE_RANKS, public_tokenizers.PATTERN)


def random_texts(n):
    rng = random.Random(21)
    letters = "abcABC 'sStT’12³½ÀéΣσςİı́中文字日本ｱ가😀👍\t\n\x0b.!?#$%_-"
    out = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(8))
            for _ in range(n)]
    return out + ["".join(rng.choices("etaoinshrdlu", k=400)) for _ in range(5)]


@pytest.mark.parametrize("limit", [0, 50, byte_bpe.HEAD])
def test_equals_the_library(spark, ws, library, own, limit):
    texts = ODD + random_texts(400)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(8)
    head = own.head(ws, docs, limit)
    tokens = docs.select("text", own.encode("text", head).alias("t")).select("text", own.ids_of(F.col("t")).alias("ids"))
    got = tokens.select("text", "ids", own.decode(F.col("ids")).alias("decoded")).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row["ids"] == library.encode_ordinary(row["text"] or ""), ascii(row["text"])
        assert bytes(row["decoded"]) == (row["text"] or "").encode()


def test_every_token_comes_out_of_the_merges(spark, own):
    """What allows all places of a merge to be joined at once."""
    tokens = byte_bpe.rank_file(BYTE_RANKS)
    words = spark.createDataFrame([(t, r) for t, r in tokens.items()], "data string, rank int").repartition(8)
    found = words.select("rank", own.merges.within("string", lambda m: own.fold(F.col("data"), m)).alias("t"))
    assert found.where(F.col("t") != F.col("t").substr(1, 1)).count() == 0
    assert found.where(F.ascii("t") - byte_bpe.FIRST != F.col("rank")).count() == 0


def test_long_words_are_cut_where_no_token_lies(spark, own):
    rng, tokens = random.Random(3), byte_bpe.rank_file(BYTE_RANKS)
    pairs = {t[i:i + 2] for t in tokens for i in range(len(t) - 1)}
    data = ["".join(rng.choices("qzjxkvwé\x00ab", k=200)) for _ in range(20)]
    rows = spark.createDataFrame([(d,) for d in data], "data string").select("data", own.cut(F.col("data")).alias("parts"))
    for row in rows.collect():
        assert "".join(row["parts"]) == row["data"]
        starts, at = set(), 0
        for part in row["parts"]:
            starts.add(at)
            at += len(part)
        assert starts - {0} == {i for i in range(1, 200) if row["data"][i - 1:i + 1] not in pairs}


def test_other_columns_stay(spark, ws):
    docs = spark.createDataFrame([(None, None, "x", 1), (1, "the the", "x", 2), (1, "the the", "x", 2)],
                                 "doc_id bigint, text string, decoded string, `a.b` int")
    got = byte_bpe.encoded(ws, docs, BYTE_RANKS, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "text", "a.b", "ids", "decoded"]
    assert sorted(bytes(r["decoded"]) for r in got.collect()) == [b"", b"the the", b"the the"]


def test_query(spark, tmp_path, library):
    for name, texts in (("some", ODD * 2 + ["the cat sat on the mat"] * 30), ("none", [])):
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = []
        for i, text in enumerate(texts):
            ids = library.encode_ordinary(text or "")
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
        assert sorted(map(tuple, op11_byte_bpe(spark, f"{tmp_path}/{name}").collect())) == want


def test_frequent_words_have_slots_and_the_table_is_not_copied(spark, ws, library, own):
    """Of the words of a slot the most frequent one is in the head, which stands in no row and in no text of the plan."""
    words = [(" " + chr(97 + i // 20) + chr(97 + i % 20) + "qx", 2 + i) for i in range(300)]
    docs = spark.createDataFrame([(1, w * n) for w, n in words], "doc_id bigint, text string")
    head = own.head(ws, docs, 64)
    table = head.table.head()["head"]
    counts = dict(words)
    first = [[w for w, half in own_slots(spark, head, counts) if half == i] for i in range(head.size)]
    for i, rivals in enumerate(first):
        assert table["words"][i] == (max(rivals, key=counts.get) if rivals else None)
    assert len(table["words"]) == 2 * head.size <= 64
    assert all(ids == (library.encode_ordinary(w) if w else None) for w, ids in zip(table["words"], table["ids"]))
    tokens = head.beside(docs, "table").select(own.encode("text", head, F.col("table")).alias("ids"))
    plan = tokens._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Project") == 1
    assert "qx" not in plan.toString()
    assert sorted(r["ids"] for r in tokens.collect()) == sorted(library.encode_ordinary(w * n) for w, n in words)


def own_slots(spark, head, words):
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    return [tuple(r) for r in rows.select("word", head.slots(F.col("word"))[0]).collect()]


def test_short_words_are_merged_from_the_left(spark, own, library):
    """Equal ranks in one word: the first place is merged first, as places are compared after ranks."""
    words = [c * n for c in "aelo0.= " for n in range(1, byte_bpe.LONG + 1)] + ["ananananas", "abababab", "lalalala", "ñññññ"]
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", own.encode_word(F.col("word")).alias("ids"))
    for row in rows.collect():
        assert row["ids"] == library._core_bpe.encode_single_piece(row["word"].encode()), row["word"]
