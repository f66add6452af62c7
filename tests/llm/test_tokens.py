"""Encoding, decoding and counting against the tokenizers library and plain merges."""

import hashlib
import random
import struct

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from twinsieve.llm import bpe, token_counts
from twinsieve.llm.queries import WORD_BPE

ODD = [None, "", " ", "a", "The the THE", "don't we'LL", "x<|endoftext|>y", "<|ENDOFTEXT|>", "É é ñ ß İ Σς ﬁ",
       "a b　c\x1cd\x85e", "字漢字 かな 가나", "😀👍🏽 ok", "1234567 ½³", "ab" * 3000, "word " * 2000, "᲋ㄳᲉa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


@pytest.fixture(scope="module")
def own():
    return bpe.loaded(WORD_BPE)


def ids(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_encodes_and_decodes_as_the_library(library, own):
    rng = random.Random(5)
    letters = "abcABC 'sStT’12³½ÀéΣσςİı́中文字日本ｱ가😀👍\t\n\x0b.!?#$%_-"
    texts = [t or "" for t in ODD] + ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(8))
              for _ in range(500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert ids(got) == want, ascii(text)
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_cuts_are_certain(own):
    """Merging a piece whole gives what its fragments give."""
    rng, cut = random.Random(6), 0
    for _ in range(3000):
        piece = "".join(rng.choices("abqxzñéß字뷁vkj", k=rng.randint(1, 12)))
        symbols = [own.symbols[b] for b in piece.encode()]
        symbols[-1] += own.end
        fragments = own.cut(symbols)
        cut += len(fragments) > 1
        assert [t for f in fragments for t in bpe.merged(f, own.ranks)] == bpe.merged(symbols, own.ranks)
    assert cut > 500


def test_long_pieces_merge_alike(own):
    symbols = [own.symbols[b] for b in ("thering" * 60).encode()]
    for n in (1, 2, 3, 50, 250):
        assert bpe.merged_long(symbols[:n], own.ranks) == bpe.merged(symbols[:n], own.ranks)


def test_tables_start_anew_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    memo = bpe.Memo(lambda x: x * 2)
    assert [memo[str(i)] for i in range(10)] == [str(i) * 2 for i in range(10)] and len(memo) <= 3


def test_columns(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "the", "x"), (0, "again", "x"), (0, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = docs.select("doc_id", "text", bpe.round_trip("text", WORD_BPE).alias("r")).select("doc_id", "text", "r.*").collect()
    assert len(got) == len(rows)
    for row in got:
        want = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    kept = bpe.encoded(docs, WORD_BPE)
    assert kept.count() == len(rows)
    assert kept.select("decoded", bpe.decoded("ids", WORD_BPE)["text"].alias("d")).where("decoded <> d").count() == 0


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_counts(spark, ws, library, head):
    texts = ODD * 2 + ["the cat sat on the mat"] * 5
    docs = spark.createDataFrame([(i % 20, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, row string")
    got = token_counts.token_counts(ws, docs, WORD_BPE, head=head).collect()
    want = [(i % 20, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
            for i, t in enumerate(texts)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_counts_of_nothing(spark, ws):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.token_counts(ws, docs, WORD_BPE).collect() == []


def test_parts_are_encoded_as_single_texts(own, library, monkeypatch):
    rng = random.Random(7)
    letters = "abcthe 'sT’12½Àéß中文字가😀\t.!?#-"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(400)] + ["ab" * 900, "x" * 300 + " y"] + ODD
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids(x) for x in own.encode_all(texts)] == want
    assert [ids(x) for x in own.encode_all(texts)] == want
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    assert [ids(x) for x in bpe.WordBpe(WORD_BPE).encode_all(texts)] == want


def test_frequent_results_outlive_a_full_table(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 4)
    asked = []
    memo = bpe.Memo(lambda x: asked.append(x) or x)
    for i in range(30):
        memo["often"], memo[str(i)]
    assert asked.count("often") == 1 and len(memo) <= 4 and len(memo.old) <= 4


def test_long_pre_tokens_stay_out_of_the_head(spark):
    blob = "é" * 5000
    docs = spark.createDataFrame([(f"{blob} short",)] * 6, "text string").coalesce(1)
    got = token_counts.tallied(docs).collect()
    assert [(bytes(r["token"]), r["n"]) for r in got] == [(b"short", 6)]


def test_counts_of_long_pre_tokens(spark, ws, library):
    texts = ["é" * 5000 + " " + "ab1" * 3000] * 4 + ["x" * 10_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(ws, docs, WORD_BPE).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_a_task_of_the_pipeline_leaves_no_tables_in_its_worker(own):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["the cat sat", "the cat, 17!"]})
    got = pa.Table.from_batches(bpe.encoded_batches(WORD_BPE, iter([batch]))).to_pylist()
    assert [r["ids"] for r in got] == own.encode_all(["the cat sat", "the cat, 17!"])
    own.forget()
    list(bpe.encoded_batches(WORD_BPE, iter([batch])))
    assert not own.runs and not own.runs.old and not own.pieces and not own.pieces.old
