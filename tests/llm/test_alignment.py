"""Alignment of tokens against a plain version, from the libraries' ids."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from twinsieve.llm import alignment
from twinsieve.llm.bpe import byte_symbols
from twinsieve.llm.queries import BYTE_BPE, PIECE_BPE, op13_alignment

ODD = [None, "", " ", "a", "  two  spaces ", "x<|endoftext|>y <s> </s>", "É ñ ß Σς ﬁ", "字漢字かな가나", "😀👍🏽 ok", "▁ a", "a\x00b\x85c",
       "1234567 ½³", "ab" * 3000, "word " * 3000, "\n\n\ta"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def texts():
    rng = random.Random(4)
    letters = "abc ABC tthe 'sStT’12³½ÀéΣ中文字日本가😀👍\t\n.!?▁"
    return ODD + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(300)] + ["the cat sat"] * 4


def plain_tokens(libraries, text):
    a, b = libraries
    if not text:
        return [], []
    byte = {c: i for i, c in enumerate(byte_symbols())}
    tokens = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    pieces = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
              for i in b.encode(text)]
    same = all(b"".join(p for _, p in side) == (" " + text).encode() for side in (tokens, pieces))
    return (tokens, pieces) if same else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def plain(libraries, rows):
    sides = [tuple(map(spans, plain_tokens(libraries, t))) for _, t in rows]
    links = [[(x, y) for x, _, e in a for y, _, f in b if e == f] if len(a) < 1000 else
             [(x, y) for x, _, e in a for y in [{f: y for y, _, f in b}.get(e)] if y is not None] for a, b in sides]
    counts = Counter(pair for some in links for pair in some)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for (i, _), (a, b), some in zip(rows, sides, links):
        ends = sorted({e for *_, e in a} & {f for *_, f in b})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x) for x, _, e in s if low < e <= end) for s in (a, b)))
            low = end
        out.append((i, len(a), len(b), len(ends), len(some), sum(counts[p] == most[p[1]] for p in some),
                    sum(counts[p] for p in some), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("head", [0, 40, alignment.HEAD])
def test_equals_the_plain_version(spark, ws, libraries, head):
    rows = [(i, t) for i, t in enumerate(t for t in texts() if len(t or "") < 400)] + [(None, "the cat"), (3, "the cat"), (3, "the cat")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, pairs int, row int").repartition(3)
    got = alignment.linked(ws, docs, BYTE_BPE, PIECE_BPE, head)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(libraries, rows)


def test_overlaps_are_all_pairs_with_common_bytes(libraries):
    aligner = alignment.Aligner(BYTE_BPE, PIECE_BPE)
    some = [t for t in texts() if len(t or "") < 400]
    a, b = (alignment.tokens_of(side, ids) for side, ids in zip((aligner.a, aligner.b), aligner.spelled(some)))
    got = alignment.overlaps(a, b)
    want = {(i, j) for i, x in a.iterrows() for j, y in b[(b["start"] < x["end"]) & (b["end"] > x["start"])].iterrows()}
    assert len(got) == len(want) and set(map(tuple, got.to_numpy().tolist())) == want


def test_both_encoders_of_side_a_agree(libraries):
    fast = alignment.sides(BYTE_BPE, PIECE_BPE)[0]
    assert fast.fast is not None
    some = [t for t in texts() if t]
    assert [list(x) for x in fast.encode(some)] == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in some]


def test_query(spark, tmp_path, libraries):
    for name, rows in (("some", list(enumerate(texts()))), ("none", [])):
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = op13_alignment(spark, f"{tmp_path}/{name}")
        assert sorted(map(tuple, got.collect()), key=repr) == plain(libraries, rows)
