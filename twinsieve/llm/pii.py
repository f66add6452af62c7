"""Personal data in texts: patterns of known kinds, and identifiers that their context gives away.

1. Every whole text is scanned for emails, addresses, card and phone numbers. These are the seed entities. Words with
   digits that could be identifiers of another kind are candidates.
2. An entity or candidate has up to three lexical patterns: the two words before it (a mark stands for words that the
   start of the text cuts off), the word before it, and the two words after it. Words end at ':' and '=' too, so a label
   joined to its value is the word before it. Patterns and instances make up a graph.
3. Rounds: a pattern with enough trusted instances is induced, and the whole corpus is read to count what else it comes
   before. A pattern's confidence is the share of trusted instances among the words it comes before, without candidates
   that are not trusted yet: those tell nothing, ordinary words tell against it. An instance is trusted as far as the patterns of one sort that it occurs with make it likely. Trusted
   instances induce further patterns, until none are new and no confidence grows by ``EPSILON`` any more.
4. Candidates behind patterns of high confidence are spans of the kind ``id``, beside those of the known kinds.

Patterns and instances are hashes; their graph is aggregated per task before it is shuffled, so a pair of words before
a third of all entities is one row per task. Induced patterns go to the tasks in blocks of ``BLOCK_PATTERNS``.

Null and empty texts have no spans. Repeated rows get the same spans and support a pattern no more than one: instances
count once per pattern. Only the id and the text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.rows import content_key, struct_udf
from twinsieve.plans.workspace import Workspace

KINDS = ("email", "ip", "card", "phone", "id")
BASE = 4
#: Distinct trusted instances a pattern needs.
MIN_SUPPORT = 5
#: Confidence from which a pattern discovers identifiers.
CONFIDENT = 0.5
#: Induced patterns that one pass over the corpus counts; more take further passes.
BLOCK_PATTERNS = 1_000_000
#: Rounds end when no confidence grows by as much.
EPSILON = 1e-3

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D:=]*[:=]+|[^\x20\x09-\x0D:=]+")
FROM_DIGIT = re.compile(r"[0-9][^\x20\x09-\x0D:=]*")
CUT = frozenset(" \t\n\x0b\x0c\r:=")
EDGE = ".,;:!?\"'()[]{}<>"
CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/#-]{4,38}[A-Za-z0-9]")

SCAN = ("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "spans array<struct<start: int, kind: int, end: int>>, "
        "seen array<struct<pattern: bigint, value: bigint, start: int, end: int, seed: boolean>>")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = start < at and DOMAIN.match(text, at + 1)
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known kinds, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = re.sub(r"[\x20-]", "", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def signed_hash(data: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(data, 7)).view(np.int64))


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


#: Sorts of patterns, and the number that stands for a word before the start of a text.
TWO_BEFORE, ONE_BEFORE, TWO_AFTER = range(3)
START = 0


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words in lower case, each by itself."""
    lower = plain("\n".join(words)).split(b"\n")
    return np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in lower), np.uint64, len(lower)) if words else np.zeros(0, np.uint64)


def patterns_of(first: np.ndarray, second: np.ndarray, sort: np.ndarray | int) -> np.ndarray:
    """Patterns of two words' hashes, as signed 64-bit integers whose last two bits are the sort."""
    x = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return (x & ~np.uint64(3) | np.asarray(sort, np.uint64)).view(np.int64)


def every_pattern(words: np.ndarray) -> np.ndarray:
    """The patterns of each word of a text, given the words' hashes."""
    padded = np.concatenate([np.full(2, START, np.uint64), words])
    return np.concatenate([patterns_of(padded[:-2], padded[1:-1], TWO_BEFORE),
                           patterns_of(np.zeros_like(words[:-1]), words[:-1], ONE_BEFORE),
                           patterns_of(words[1:-1], words[2:], TWO_AFTER)])


def place_patterns(words: list[re.Match], starts: list[int], ends: list[int], a: int, b: int):
    """(first, second, sort) of the words around a place from ``a`` to ``b``; no word is the mark of the start."""
    i, j = bisect_right(ends, a), bisect_left(starts, b)
    before = [None, None, *(w.group() for w in words[max(0, i - 2):i])][-2:]
    yield *before, TWO_BEFORE
    if i:
        yield None, before[1], ONE_BEFORE
    if j + 1 < len(words):
        yield words[j].group(), words[j + 1].group(), TWO_AFTER


def candidates(text: str, taken: list[tuple[int, int, int]]):
    """Places of words that look like identifiers and touch no known span."""
    starts = [t[0] for t in taken]
    reach = np.maximum.accumulate([t[2] for t in taken]).tolist() if taken else []
    at = 0
    while m := FROM_DIGIT.search(text, at):
        start, end = m.span()
        while start > at and text[start - 1] not in CUT:
            start -= 1
        at = end
        word = text[start:end]
        start += len(word) - len(word.lstrip(EDGE))
        word = word.strip(EDGE)
        if not CANDIDATE.fullmatch(word) or len(DIGIT.findall(word)) < 4:
            continue
        end = start + len(word)
        i = bisect_right(starts, end - 1)
        if not i or reach[i - 1] <= start:
            yield start, end


def scanned(texts: list) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "spans", "seen")}
    for text in texts:
        text = text or ""
        base = base_spans(text)
        for k in range(BASE):
            out[f"n_{KINDS[k]}"].append(sum(s[1] == k for s in base))
        out["spans"].append([{"start": a, "kind": k, "end": b} for a, k, b in base])
        places = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in candidates(text, base)]
        seen = []
        if places:
            words = list(WORD.finditer(text))
            starts, ends = [w.start() for w in words], [w.end() for w in words]
            around = [(x, *place) for place in places for x in place_patterns(words, starts, ends, *place[:2])]
            named = list({w for x, *_ in around for w in x[:2] if w is not None})
            number = dict(zip(named, word_hashes(named).tolist())) | {None: START}
            patterns = patterns_of(*(np.array([number[x[k]] for x, *_ in around], np.uint64) for k in (0, 1)),
                                   np.array([x[2] for x, *_ in around], np.uint64))
            for pattern, (_, a, b, seed) in zip(patterns.tolist(), around):
                value = signed_hash(re.sub(rb"[^0-9a-z@]", b"", plain(text[a:b])))
                seen.append({"pattern": pattern, "value": value, "start": a, "end": b, "seed": seed})
        out["seen"].append(seen)
    return out


def pattern_uses(docs: DataFrame, patterns: np.ndarray) -> DataFrame:
    """How many words of all texts have each of ``patterns`` (ascending): ``pattern``, ``uses``."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def batches(incoming):
        known = shared.value
        counts = np.zeros(len(known), np.int64)
        for batch in incoming:
            for text in batch.column(0):
                words = word_hashes(WORD.findall(text.as_py() or ""))
                if len(words):
                    found = every_pattern(words)
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    np.add.at(counts, at[known[at] == found], 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(known[used]), pa.array(counts[used])], names=["pattern", "uses"])

    per_task = docs.select("text").mapInArrow(batches, "pattern bigint, uses bigint")
    return per_task.groupBy("pattern").agg(F.sum("uses").alias("uses"))


def _uses_of(ws: Workspace, docs: DataFrame, induced: DataFrame, block: int) -> DataFrame | None:
    """Uses of new patterns, a block of them at a time."""
    out, least = None, None
    while True:
        rest = induced if least is None else induced.where(F.col("pattern") > least)
        part = [r["pattern"] for r in rest.select("pattern").orderBy("pattern").limit(block).collect()]
        if not part:
            return out
        counted = rest.where(F.col("pattern") <= part[-1]).select("pattern").join(
            pattern_uses(docs, np.array(part, np.int64)), "pattern", "left")
        uses = ws.save(counted.select("pattern", F.coalesce("uses", F.lit(0)).alias("uses")), "uses")
        out = uses if out is None else out.unionByName(uses)
        least = part[-1]


def confident_patterns(ws: Workspace, docs: DataFrame, seen: DataFrame,
                       min_support: int = MIN_SUPPORT, confident: float = CONFIDENT,
                       block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """``pattern`` and ``confidence`` of patterns that discover identifiers, bootstrapped from the seeds.

    ``seen`` has a row (pattern, value, seed) per occurrence of an entity or candidate in ``docs``.
    """
    graph = ws.save(seen.groupBy("pattern", "value").agg(F.count("seed").alias("n"),
                                                         F.max(F.col("seed").cast("double")).alias("trust")), "graph")
    trusted, known, scored = graph, None, None
    while True:
        induced = (trusted.where(F.col("trust") >= confident).groupBy("pattern").agg(F.count("value").alias("support"))
                   .where(F.col("support") >= min_support))
        new = induced if known is None else induced.join(known.select("pattern"), "pattern", "left_anti")
        uses = _uses_of(ws, docs, ws.save(new, "induced"), block_patterns)
        if uses is not None:
            known = uses if known is None else known.unionByName(uses)
        if known is None:
            break
        sums = trusted.groupBy("pattern").agg(F.sum(F.col("n") * F.col("trust")).alias("good"),
                                              F.sum("n").alias("entities"))
        share = F.col("good") / F.greatest(F.col("uses") - F.col("entities") + F.col("good"), F.col("good"), F.lit(1))
        now = sums.join(known, "pattern").select("pattern", share.alias("confidence"))
        if scored is not None:
            now = now.join(scored.select("pattern", F.col("confidence").alias("was")), "pattern", "left")
        scored = ws.save(now, "scored")
        # Confidence only grows, so a round that hardly changes any is the last one.
        change = scored.agg(F.max(F.col("confidence") - F.coalesce("was", F.lit(0.0)))).first()[0] if "was" in now.columns else 1
        if uses is None and (change or 0) < EPSILON:
            break
        # Noisy-or over the patterns of one sort of an instance, as those of several sorts tell the same; seeds keep full trust.
        doubt = F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce("confidence", F.lit(0.0))))
        values = (graph.join(scored, "pattern", "left").groupBy("value", F.col("pattern").bitwiseAND(3).alias("sort"))
                  .agg(F.max("trust").alias("seed"), (1 - F.exp(F.sum(doubt))).alias("likely"))
                  .groupBy("value").agg(F.max(F.greatest("seed", "likely")).alias("trust")))
        trusted = ws.save(graph.drop("trust").join(values, "value"), "trusted")
    if scored is None:
        return seen.sparkSession.createDataFrame([], "pattern bigint, confidence double")
    return scored.where(F.col("confidence") >= confident).select("pattern", "confidence")


def _scan(ws: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with their known spans, and a row per occurrence of an entity or candidate."""
    found = ws.save(docs.select("doc_id", content_key("text").alias("text_key"), struct_udf(scanned, SCAN)("text").alias("s"))
                    .select("doc_id", "text_key", "s.*"), "scanned")
    return found, found.select("doc_id", "text_key", F.explode("seen").alias("o")).select("doc_id", "text_key", "o.*")


def find_personal_data(ws: Workspace, docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``text_key``, counts of the known kinds, and ``spans`` (start, kind, end) of every row of ``docs``."""
    found, seen = _scan(ws, docs)
    patterns = ws.save(confident_patterns(ws, docs, seen.select("pattern", "value", "seed"), **options), "patterns")
    return _with_spans(found, seen, patterns)


def _with_spans(found: DataFrame, seen: DataFrame, patterns: DataFrame) -> DataFrame:
    """The scanned rows with the known spans and those that patterns discover."""
    more = (seen.where("not seed").join(patterns.select("pattern"), "pattern")
            .groupBy("doc_id", "text_key")
            .agg(F.collect_set(F.struct("start", F.lit(BASE).alias("kind"), "end")).alias("more")))
    more = more.select(F.col("doc_id").alias("more_id"), F.col("text_key").alias("more_key"), "more")
    joined = found.drop("seen").join(more, F.col("doc_id").eqNullSafe(F.col("more_id"))
                                     & F.col("text_key").eqNullSafe(F.col("more_key")), "left")
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(
        "array<struct<start: int, kind: int, end: int>>"))))
    return joined.select("doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", every.alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each run of overlapping (start, kind, end) replaced by the name of the first one's kind in brackets."""
    if text is None or not spans:
        return text
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def masked(text: Column | str, spans: Column | str) -> Column:
    """The text with ``spans`` masked."""

    def apply(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([mask(t, [(s["start"], s["kind"], s["end"]) for s in some or []])
                         for t, some in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    return F.arrow_udf(apply, "string")(text, spans)


def masked_by(text: Column | str, patterns: list[int]) -> Column:
    """The text with all known kinds masked, and candidates behind ``patterns``."""
    known = frozenset(patterns)

    def batch(texts):
        out = []
        for text in texts:
            got = scanned([text])
            spans = [(s["start"], s["kind"], s["end"]) for s in got["spans"][0]]
            spans += [(o["start"], BASE, o["end"]) for o in got["seen"][0] if not o["seed"] and o["pattern"] in known]
            out.append(mask(text, sorted(spans)))
        return {"text": out}

    return struct_udf(batch, "text string")(text)["text"]


def without_personal_data(ws: Workspace, docs: DataFrame, block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and any other columns) with personal data masked and ``n_chars`` counted anew.

    Texts are scanned again with the patterns at hand and so need no shuffle; more than ``block_patterns`` of them do not
    go to all tasks, and spans are joined to the texts instead.
    """
    plain_docs = docs.select("doc_id", "text")
    found, seen = _scan(ws, plain_docs)
    patterns = ws.save(confident_patterns(ws, plain_docs, seen.select("pattern", "value", "seed")), "patterns")
    some = [r["pattern"] for r in patterns.select("pattern").limit(block_patterns + 1).collect()]
    if len(some) <= block_patterns:
        rows = docs.select(*[masked_by("text", some).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
        return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    spans = (_with_spans(found, seen, patterns).where(F.size("spans") > 0)
             .groupBy("doc_id", "text_key").agg(F.first("spans").alias("_spans"))
             .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("_spans").alias("_found")))
    joined = docs.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s._id"))
                                  & content_key(F.col("d.text")).eqNullSafe(F.col("s._key")), "left")
    text = masked(F.col("d.text"), F.col("s._found"))
    rows = joined.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
    return rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
