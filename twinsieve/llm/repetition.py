"""Quality rules on words, and repetition found by suffix arrays.

Texts are taken as sequences of words. For many texts at once, suffixes are sorted by prefix doubling (only suffixes that
still tie take part in a round, and suffixes of different texts never tie), and the longest common prefixes of neighbours
follow from the rounds' ranks. The longest prefix a suffix shares with a neighbour is the length of its deepest
longest-common-prefix interval, that is, of the longest repeated substring that starts there; the union of these spans
is what all maximal repeats cover. A text fails if repeats of ``MIN_REPEAT`` words or more cover too much of it, or if
one is too long.

Null and empty texts have no words, all counts are zero, and they fail for having too few words. Repeated rows get equal
results. Whole texts are sorted, however long; a batch of texts is closed at ``BATCH_WORDS`` words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsieve.llm.rows import struct_udf

#: Words of a window that counts as repeated.
WINDOW = 5
#: Words of a repeat that counts towards the covered part of a text.
MIN_REPEAT = 10
#: Share of a text's words that repeats may cover, and words of the longest repeat.
MAX_COVERED, MAX_LONGEST = 0.2, 100
#: Fewer words than this, or a larger share (in percent) of words in repeated windows, fail by the base rules.
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: Words of texts that are sorted together.
BATCH_WORDS = 1 << 20

SPACES, SYMBOLS = b"\x09\x0a\x0b\x0c\x0d\x20", b"#*$%&|<>"
COUNTS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "n_covered bigint, longest_repeat bigint")


def suffix_order(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of ``keys`` in order, and the ranks of each round: equal ranks in round k share 2 ** k keys.

    ``ends`` has, for each place, where its text ends; keys of different texts differ.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], np.diff(keys[order]) != 0])[:n]
    ranks = np.empty(n, np.int64)
    ranks[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rounds, length = [ranks], 1
    while True:
        # Places in order whose rank is shared with the one before or after.
        tied = np.flatnonzero(~first | ~np.concatenate([first[1:], [True]])[:n])
        if not len(tied):
            return order, rounds
        places = order[tied]
        after = places + length
        inside = after < ends[places]
        second = np.where(inside, ranks[np.where(inside, after, 0)] + 1, 0)
        pair = ranks[places] * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        places, pair = places[by], pair[by]
        order[tied] = places
        new = np.concatenate([[True], np.diff(pair) != 0])
        first[tied] = new
        ranks = ranks.copy()
        ranks[places] = np.maximum.accumulate(np.where(new, tied, 0))
        rounds.append(ranks)
        length *= 2


def longest_repeats(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place, the number of keys of the longest substring that starts there and occurs elsewhere in its text."""
    n = len(keys)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    order, rounds = suffix_order(keys, ends)
    left, right = order[:-1], order[1:]
    near = np.flatnonzero(rounds[0][left] == rounds[0][right])
    left, right = left[near], right[near]
    shared = np.zeros(len(left), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        a, b = left + shared, right + shared
        inside = (a < ends[left]) & (b < ends[right])
        same = inside & (rounds[k][np.where(inside, a, 0)] == rounds[k][np.where(inside, b, 0)])
        shared += same * (1 << k)
    np.maximum.at(out, left, shared)
    np.maximum.at(out, right, shared)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places some span covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:n]) > 0


def repetition(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text of words: words in repeated windows, words that repeats cover, and words of the longest repeat."""
    codes: dict[bytes, int] = {}
    parts = []
    for words in texts:
        new = [w for w in dict.fromkeys(words) if w not in codes]
        codes.update(zip(new, range(len(codes), len(codes) + len(new))))
        parts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
    sizes = np.array([len(p) for p in parts], np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    owner, n = np.repeat(np.arange(len(texts)), sizes), int(cuts[-1])
    keys = owner * max(1, len(codes)) + np.concatenate([*parts, np.zeros(0, np.int64)])
    longest = longest_repeats(keys, cuts[1:][owner])
    again = np.flatnonzero(longest >= WINDOW)
    long = np.flatnonzero(longest >= MIN_REPEAT)
    in_window = covered(again, np.full(len(again), WINDOW), n)
    in_repeat = covered(long, longest[long], n)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, owner, longest)
    return (np.bincount(owner[in_window], minlength=len(texts)), np.bincount(owner[in_repeat], minlength=len(texts)), most)


def counts(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {name: [] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                  "n_covered", "longest_repeat")}
    waiting: list[list[bytes]] = []

    def flush():
        for name, values in zip(("n_repeat_words", "n_covered", "longest_repeat"), repetition(waiting)):
            out[name] += values.tolist()
        waiting.clear()

    total = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text or "") - len(raw) + len(raw.translate(None, SPACES)))
        out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        waiting.append(words)
        total += len(words)
        if total >= BATCH_WORDS:
            flush()
            total = 0
    flush()
    return out


def rules(text: Column | str) -> Column:
    """Struct of the counts of a whole text."""
    return struct_udf(counts, COUNTS)(text)


def base_failed() -> Column:
    n, again = F.col("n_words"), F.col("n_repeat_words")
    return (n < MIN_WORDS) | (100 * again > MAX_REPEATED_PERCENT * n)


def kept(max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> Column:
    """Neither a base rule nor the repeats reject the text."""
    return ~base_failed() & (F.col("n_covered") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
