"""Secrets in texts: known forms, and strings of high entropy.

Known forms are assignments of passwords and the like, access keys and long hexadecimal strings. Beyond them, candidate
strings (runs of the characters secrets are made of) are cut into the longest runs of each character class, and such a
run of ``LEAST`` characters or more gets the Shannon entropy of every window of its class. A run shorter than the window
is one window, with a threshold that is the same share of the most bits its length can have; digits alone need a whole
window, as shorter ones are numbers of many kinds. A run that a narrower class has whole is that class's alone. A window slides by one character and its entropy follows from the one before: only the counts of the character that
leaves and of the one that enters change. Windows at or above the class's threshold are united to spans. Candidates and
runs on the allow list (UUIDs, dates, and names, whatever their length) are suppressed first. A name is made of letters,
with up to four digits behind a part, that look like words: of the case of words, and with letters as frequent as in words.

Counts are summed as whole numbers, so a window's entropy does not depend on where the sliding began.

Null and empty texts have no spans. Repeated rows get equal spans. Whole texts are read and every window of a candidate
counts, however long it is. Columns beside the text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinsieve.llm.rows import struct_udf

KINDS = ("assign", "access", "hex", "entropy")
BASE = 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_WORD = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")


@dataclass(frozen=True)
class CharacterClass:
    """A set of characters, the width of a window of them and the bits per character from which it is a secret."""

    name: str
    runs: tuple[re.Pattern, ...]
    window: int
    bits: float
    #: Shorter runs of the class are no secrets.
    least: int = 0

    def threshold(self, width: int) -> float:
        """Bits per character for a window of ``width``: scaled by the most bits it can have."""
        return self.bits * (math.log2(width) / math.log2(self.window))


#: Characters of a candidate, and of a run in it.
LEAST = 16


def runs_of(*characters: str) -> tuple[re.Pattern, ...]:
    return tuple(re.compile(f"[{c}]{{{LEAST},}}+") for c in characters)


#: From the narrowest class to the widest.
CLASSES = (
    CharacterClass("digits", runs_of("0-9"), 24, 2.8, least=24),
    CharacterClass("hexadecimal", runs_of("0-9a-f", "0-9A-F"), 20, 3.0),
    CharacterClass("alphanumeric", runs_of("A-Za-z0-9"), 20, 3.7),
    CharacterClass("base64", runs_of("A-Za-z0-9+/_=-"), 24, 4.0),
)

#: Candidates that are no secrets, each of which must match the whole string: UUIDs, dates, times and versions.
ALLOWED = tuple(re.compile(p) for p in (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[_=/+-]*(?:[0-9]{1,15}[_=/+-]+)*[0-9]{0,15}",
))

#: Words and paths of words, if their letters look like words.
NAME = re.compile(r"[/_+=-]*(?:[A-Za-z]+[0-9]{0,4}[/_+=-]+)*[A-Za-z]*[0-9]{0,4}")
LETTERS = re.compile(r"[A-Za-z]+")
CASE_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: How often each letter, a to z, is found among 1000 letters of English.
PER_MILLE = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: Bits by which a letter speaks for a word rather than for chance.
LETTER_BITS = {c: math.log2(n * 26 / 1000) for c, n in zip("abcdefghijklmnopqrstuvwxyz", PER_MILLE)}
#: Letters a part in the case of words has on average, and the bits, by length, that letters of words may lack.
PART_LETTERS = 3


def like_words(letters: str) -> bool:
    """Whether letters without anything between them look like words."""
    parts = CASE_PARTS.findall(letters)
    bits = sum(map(LETTER_BITS.__getitem__, letters.lower()))
    return len(parts) * PART_LETTERS <= len(letters) and bits >= -0.1 * len(letters)


def is_name(text: str) -> bool:
    """Whether a candidate is a name: its letters as a whole, and every long part, look like words."""
    if not NAME.fullmatch(text):
        return False
    parts = LETTERS.findall(text)
    whole = "".join(parts)
    return not whole or (sum(len(CASE_PARTS.findall(p)) for p in parts) * PART_LETTERS <= len(whole)
                         and sum(map(LETTER_BITS.__getitem__, whole.lower())) >= -0.1 * len(whole)
                         and all(like_words(p) for p in parts if len(p) >= LEAST))

SPANS = ("n_assign bigint, n_access bigint, n_hex bigint, "
         "spans array<struct<start: int, kind: int, end: int>>")


@lru_cache(maxsize=1 << 16)
def weight(count: int) -> int:
    """count * log2(count), as a whole number of 2 ** -40."""
    return round(count * math.log2(count) * (1 << 40)) if count else 0


def window_entropies(text: str, window: int):
    """Entropy in bits per character of each window of ``text``, by counts that change with the two end characters."""
    counts: dict[str, int] = {}
    total = 0
    for c in text[:window]:
        n = counts.get(c, 0)
        total += weight(n + 1) - weight(n)
        counts[c] = n + 1
    whole = math.log2(window)
    yield whole - total / (1 << 40) / window
    for old, new in zip(text, text[window:]):
        if old != new:
            n, m = counts[old], counts.get(new, 0)
            total += weight(n - 1) - weight(n) + weight(m + 1) - weight(m)
            counts[old], counts[new] = n - 1, m + 1
        yield whole - total / (1 << 40) / window


def run_spans(run: str, kind: CharacterClass, start: int) -> list[list[int]]:
    """Spans of windows at or above the threshold in a run that begins at ``start``."""
    width, out = min(kind.window, len(run)), []
    least = kind.threshold(width) if len(run) >= kind.least else math.inf
    for i, bits in enumerate(window_entropies(run, width), start):
        if bits >= least:
            if out and out[-1][1] >= i:
                out[-1][1] = i + width
            else:
                out.append([i, i + width])
    return out


def is_allowed(text: str, patterns=ALLOWED) -> bool:
    return is_name(text) or any(p.fullmatch(text) for p in patterns)


def entropy_spans(text: str, allowed=ALLOWED, classes=CLASSES) -> list[tuple[int, int]]:
    """Spans of windows of high entropy within the candidates of a text."""
    found: list[list[int]] = []
    for m in CANDIDATE.finditer(text):
        if is_allowed(m.group(), allowed):
            continue
        narrower: list[re.Pattern] = []
        for kind in classes:
            for sub in (x for p in kind.runs for x in p.finditer(m.group())):
                if not any(p.fullmatch(sub.group()) for p in narrower) and not is_allowed(sub.group(), allowed):
                    found += run_spans(sub.group(), kind, m.start() + sub.start())
            narrower += kind.runs
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, in order."""
    out = []
    if ASSIGN_WORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scanned(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "spans": []}
    for text in texts:
        known = known_spans(text or "")
        for k in range(BASE):
            out[f"n_{KINDS[k]}"].append(sum(s[1] == k for s in known))
        every = sorted(known + [(a, BASE, b) for a, b in entropy_spans(text or "")])
        out["spans"].append([{"start": a, "kind": k, "end": b} for a, k, b in every])
    return out


def find_secrets(text: Column | str) -> Column:
    """Struct of the numbers of known forms and all ``spans`` (start, kind, end) of a whole text."""
    return struct_udf(scanned, SPANS)(text)


def written(spans: Column | str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
