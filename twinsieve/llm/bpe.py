"""Byte pair encoding with word ends: forced boundaries, encoding and decoding.

A text is cut in three steps, none of which a merge can cross:

1. runs without white space (the pre-tokenizer never keeps white space inside a piece),
2. the pre-tokenizer's pieces of a run,
3. fragments of a piece: two neighbouring symbols that stand next to each other in no token of the vocabulary
   can never come to lie in one token, so the cut between them is certain.

Fragments are encoded independently and the ids concatenated. Runs and pieces recur, so each task keeps what it has
encoded in tables of bounded size. What a part of the texts has that is not there yet is merged at once: one array holds
all its fragments, and a step makes one merge in each of them.

Null texts count as empty; empty texts have no ids. Repeated rows and ids are encoded row by row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from twinsieve.llm.rows import struct_udf

#: Entries of each of the two halves of a worker's tables of encoded runs and pieces.
CACHE_ENTRIES = 300_000
#: Runs longer than this are encoded but not kept.
CACHED_BYTES = 64
#: Symbols of the longest fragment that is merged without a heap.
SHORT = 256
#: Bits of an id in a pair of ids, and a rank that none has.
BITS, NEVER = 20, 1 << 62
#: Rows whose ids and decoded texts a worker holds at once.
PART_ROWS = 500


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """A table of results in two generations: when the young one is full it becomes the old one.

    What is asked for again moves back to the young one, so frequent results are never lost.
    """

    def __init__(self, function):
        super().__init__()
        self.function = function
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(key) > CACHED_BYTES:
            return
        if len(self) >= CACHE_ENTRIES:
            self.old = self.copy()
            self.clear()
        self[key] = value


def is_newer(text: str) -> bool:
    """Whether a text has code points that this Python's tables of characters lack."""
    return not text.isascii() and "Cn" in map(unicodedata.category, text)


class WordBpe:
    """Encoder and decoder of a tokenizer file whose model is BPE with a word-end suffix."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max(*self.vocab.values(), *self.special.values()))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.special_starts = {s.encode()[:2] for s in self.special}
        self.special_runs = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        #: White space of the tokenizer file's pattern language, which is not quite that of this one.
        self.piece = regex.compile(split.replace(r"\s", r"\x09-\x0D\x20\x85\xA0  -     　"))
        self.inner = self._inner_pairs()
        #: The same of ids: of a byte within a piece and at its end, whether two bytes stand side by side in a token
        #: (the second within or at the end), and pairs in ascending order with their ranks and what they merge to.
        self.bytes = np.array([[self.vocab[c + end] for c in self.symbols] for end in ("", self.end)])
        self.side_by_side = np.array([[[(a, b + end) in self.inner for b in self.symbols] for a in self.symbols]
                                      for end in ("", self.end)])
        pairs = np.array([(self.vocab[a] << BITS | self.vocab[b], rank, self.vocab[a + b])
                          for (a, b), rank in self.ranks.items()])
        self.pairs, self.pair_ranks, self.pair_ids = pairs[np.argsort(pairs[:, 0])].T.copy()
        self.runs = Memo(self.encode_run)
        self.pieces = Memo(lambda piece: self.encode_pieces([piece])[0])

    def forget(self) -> None:
        """Empty the tables of encoded runs and pieces, and give back what Arrow holds unused."""
        for table in (self.runs, self.pieces):
            table.clear()
            table.old = {}
        pa.default_memory_pool().release_unused()

    def split_symbols(self, token: str) -> list[str]:
        """The bytes' symbols of a token; the last one carries the word end, if any."""
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _inner_pairs(self) -> set[tuple[str, str]]:
        pairs = set()
        for token in self.vocab:
            symbols = self.split_symbols(token)
            pairs.update(zip(symbols, symbols[1:]))
        return pairs

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        composed = unicodedata.normalize("NFC", text)
        # Character by character: a sigma at a word's end is no exception.
        return composed.lower() if "Σ" not in composed else "".join(map(str.lower, composed))

    def encode_run(self, run: bytes) -> bytes:
        """Ids of a run without white space, given in UTF-8, as in ``encode``."""
        text = run.decode("utf-8", "surrogatepass")
        out, at = [], 0
        for m in self.special_runs.finditer(text):
            out += self._encode_plain(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return packed(out + self._encode_plain(text[at:]))

    def _encode_plain(self, text: str) -> list[int]:
        if is_newer(text):
            return [i for piece in self.library_pieces(text) for i in self._encode_symbols(list(piece))]
        return [i for piece in self.piece.findall(self.normalise(text)) for i in self._encode_piece(piece)]

    def learn(self, runs: set[bytes]) -> dict[bytes, bytes]:
        """Encode the runs that the table lacks, all their fragments side by side; those too long for it are returned."""
        young, old = self.runs, self.runs.old
        new = {run: None for run in runs if run not in young and run not in old}
        pieces: dict[bytes, bytes] = {}
        for run in new:
            if run.isalpha():
                new[run] = [run.lower()]
            elif not any(s in run for s in self.special_starts):
                text = run.decode("utf-8", "surrogatepass")
                if not is_newer(text):
                    new[run] = [p.encode("utf-8", "surrogatepass") for p in self.piece.findall(self.normalise(text))]
            for piece in new[run] or ():
                if piece not in pieces and (known := self.pieces.get(piece) or self.pieces.old.get(piece)):
                    pieces[piece] = known
        rest = list({p for some in new.values() for p in some or () if p not in pieces})
        for piece, ids in zip(rest, self.encode_pieces(rest)):
            pieces[piece] = ids
            self.pieces.keep(piece, ids)
        long = {}
        for run, some in new.items():
            ids = self.encode_run(run) if some is None else b"".join(map(pieces.__getitem__, some))
            if len(run) > CACHED_BYTES:
                long[run] = ids
            else:
                self.runs.keep(run, ids)
        return long

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces: one merge of each unfinished fragment at a time, the leftmost of its lowest rank."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        at_end = np.zeros(len(data), np.int64)
        at_end[ends - 1] = 1
        ids = self.bytes[at_end, data]
        cut = np.append(True, (at_end[:-1] == 1) | ~self.side_by_side[at_end[1:], data[:-1], data[1:]])
        fragment = np.cumsum(cut) - 1
        #: By fragment, the piece it is of.
        owner = np.searchsorted(ends, np.flatnonzero(cut), "right")
        done_ids, done_fragments = [], []
        for f in np.flatnonzero(np.bincount(fragment) > SHORT).tolist():
            mine = fragment == f
            parts = [self.vocab[t] for t in merged_long([self.tokens[i] for i in ids[mine].tolist()], self.ranks)]
            done_ids.append(np.array(parts))
            done_fragments.append(np.full(len(parts), f))
            ids, fragment = ids[~mine], fragment[~mine]
        while len(ids):
            pair = ids[:-1] << BITS | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            rank = np.where((self.pairs[at] == pair) & (fragment[:-1] == fragment[1:]), self.pair_ranks[at], NEVER)
            start = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1]))
            least = np.repeat(np.minimum.reduceat(np.append(rank, NEVER), start), np.diff(np.append(start, len(ids))))
            over = least == NEVER
            done_ids.append(ids[over])
            done_fragments.append(fragment[over])
            best = np.flatnonzero((rank == least[:-1]) & ~over[:-1])
            best = best[np.append(True, fragment[best[1:]] != fragment[best[:-1]])[:len(best)]]
            ids[best] = self.pair_ids[at[best]]
            over[best + 1] = True
            ids, fragment = ids[~over], fragment[~over]
        all_fragments = np.concatenate(done_fragments)
        order = np.argsort(all_fragments, kind="stable")
        flat = np.concatenate(done_ids)[order].astype("<u4").tobytes()
        sizes = np.bincount(owner[all_fragments], minlength=len(pieces))
        stops = (4 * np.cumsum(sizes)).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]

    def library_pieces(self, text: str) -> list[str]:
        """Pieces, in byte symbols, of a text with code points newer than this Python's tables of characters."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(text)
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _encode_piece(self, piece: str) -> list[int]:
        return np.frombuffer(self.encode_pieces([piece.encode("utf-8", "surrogatepass")])[0], "<u4").tolist()

    def _encode_symbols(self, symbols: list[str]) -> list[int]:
        symbols[-1] += self.end
        fragments = self.cut(symbols)
        if len(fragments) == 1:
            return self._encode_fragment(fragments[0])
        return [i for fragment in fragments for i in self._encode_fragment(fragment)]

    def cut(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Fragments between the forced boundaries of a piece."""
        at = [i for i, pair in enumerate(zip(symbols, symbols[1:]), 1) if pair not in self.inner]
        if not at:
            return [tuple(symbols)]
        return [tuple(symbols[a:b]) for a, b in zip([0, *at], [*at, len(symbols)])]

    def _encode_fragment(self, symbols: tuple[str, ...]) -> list[int]:
        return [self.vocab[s] for s in merged(symbols, self.ranks)]

    def runs_of(self, text: str | None) -> list[bytes]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        # Small letters from the start make for fewer runs; special tokens are told by their own letters.
        return (raw if any(s in raw for s in self.special_starts) else raw.lower()).split()

    def encode_all(self, texts: list) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        split = [self.runs_of(t) for t in texts]
        long = self.learn(set().union(*split))
        if not long:
            return [b"".join(map(self.runs.__getitem__, runs)) for runs in split]
        return [b"".join([self.runs[r] if len(r) <= CACHED_BYTES else long[r] for r in runs]) for runs in split]

    def counts(self, runs: list[bytes]) -> list[int]:
        """Numbers of tokens of runs."""
        long = self.learn(set(runs))
        return [len(self.runs[r] if len(r) <= CACHED_BYTES else long[r]) // 4 for r in runs]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The tokens of ids, special ones included, with a space between: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def merged(symbols, ranks: dict) -> list[str]:
    """Symbols after all merges, the lowest rank first and, of equal ones, the leftmost."""
    if len(symbols) > SHORT:
        return merged_long(symbols, ranks)
    parts, get, never = list(symbols), ranks.get, len(ranks)
    found = [get(pair, never) for pair in zip(parts, parts[1:])]
    while found and (best := min(found)) != never:
        i = found.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i:
            found[i - 1] = get((parts[i - 1], parts[i]), never)
        if i < len(found):
            found[i] = get((parts[i], parts[i + 1]), never)
    return parts


def merged_long(symbols, ranks: dict) -> list[str]:
    """As ``merged``, in n log n steps: a heap of pairs over a linked list."""
    parts: list = list(symbols)
    after = [*range(1, len(parts)), -1]
    before = [-1, *range(len(parts) - 1)]
    heap = [(rank, i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if (rank := ranks.get(pair)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j < 0 or (parts[i], parts[j]) != pair:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (rank := ranks.get((parts[a], parts[b]))) is not None:
                heapq.heappush(heap, (rank, a, (parts[a], parts[b])))
    return [p for p in parts if p is not None]


@lru_cache(maxsize=4)
def loaded(path: str) -> WordBpe:
    """The tokenizer of a file, read once per worker."""
    return WordBpe(path)


def encoded_batches(path: str, incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ids of texts, their numbers and what they decode to, of batches of (doc_id, text), for one task."""
    bpe = loaded(path)
    try:
        for batch in incoming:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                ids = bpe.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(map(bpe.decode, ids), pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])
    finally:
        # The worker lives on and serves other steps.
        bpe.forget()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens`` and ``decoded``, what they decode to.

    Results are several times as large as the texts, so they leave a worker in parts of ``PART_ROWS`` rows. A task's tables go
    at its end.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        partial(encoded_batches, path), "doc_id bigint, ids binary, n_tokens bigint, decoded string")


def decoded(ids: Column | str, path: str) -> Column:
    """Struct with the decoded ``text`` of ids (null: empty)."""
    return struct_udf(lambda rows: {"text": [loaded(path).decode(x or b"") for x in rows]}, "text string")(ids)


def round_trip(text: Column | str, path: str) -> Column:
    """Struct with ``n_tokens`` and the SHA-256 of a text's ids and of what they decode to, without carrying either."""

    def batch(texts):
        bpe, out = loaded(path), {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for at in range(0, len(texts), PART_ROWS):
            for ids in bpe.encode_all(texts[at:at + PART_ROWS]):
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        return out

    return struct_udf(batch, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")(text)
