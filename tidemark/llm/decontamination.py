"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items reads each document word by word and
knows, at every word, the longest run ending there that occurs in some item.
Runs of ``window`` words (or a whole item that is shorter) mark the words of the
document as hit; spans and documents over the limits are then removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, reserved, table, tidy, worker_table

WINDOW = 10
#: Most UTF-8 bytes of test items in one automaton; more items go to more automata, one after another.
MAX_BLOCK_BYTES = 1_000_000
#: Words are made of these bytes of lower-cased UTF-8: digits, a-z and all beyond ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z alone, as asked for."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences.

    ``reach[v]`` is the state of the last ``window`` words of state v's strings
    (-1 if these are shorter); ``inside[u]`` are the items with that window, and
    ``whole[v]`` the nearest state at or above v in which short items end.
    """

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    after: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int = WINDOW) -> SuffixAutomaton:
        a = cls(window)
        sequences = []
        for item, text in items:
            ids = [a.vocabulary.setdefault(w, len(a.vocabulary)) for w in words_of(text)]
            if ids:
                sequences.append((item, ids))
                last = 0
                for w in ids:
                    last = a._extend(last, w)
        a._finish(sequences)
        return a

    def _new(self, length: int, after: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.after.append(after)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that p reaches by w, for strings of length[p] + 1 words at most."""
        q = self.after[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.after[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.after[p].get(w) == q:
            self.after[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.after[last]:  # an earlier item has this string
            return self._split(last, w)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.after[p]:
            self.after[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def _finish(self, sequences: list[tuple[str, list[int]]]) -> None:
        n = len(self.length)
        self.reach, self.whole = [-1] * n, [-1] * n
        self.inside: dict[int, set[str]] = {}
        self.ends: dict[int, list[tuple[int, str]]] = {}
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        for v in by_length:
            if self.length[v] >= self.window:
                self.reach[v] = v if self.length[self.link[v]] < self.window else self.reach[self.link[v]]
        for item, ids in sequences:
            for _, v, run in self.read(ids, 0):
                if run >= self.window:
                    self.inside.setdefault(self.reach[v], set()).add(item)
            if len(ids) < self.window:
                self.ends.setdefault(v, []).append((len(ids), item))
        for v in by_length:
            self.whole[v] = v if v in self.ends else self.whole[self.link[v]]
        self.shortest = min([self.window, *(k for ends in self.ends.values() for k, _ in ends)])

    def read(self, ids: list[int], start: int) -> Iterator[tuple[int, int, int]]:
        """For each word: its place, the state, and the length of the longest run of an item that ends with it."""
        after, link, length = self.after, self.link, self.length
        v = run = 0
        for i, w in enumerate(ids, start):
            while v and w not in after[v]:
                v = link[v]
                run = length[v]
            v = after[v].get(w, 0)
            run = run + 1 if v else 0
            yield i, v, run

    def matches(self, ids: list[int], start: int) -> tuple[list[tuple[int, int]], set[str], int]:
        """Spans (first, end) of hit words, the items with occurring windows, and the longest run."""
        spans, items, longest = [], set(), 0
        for i, v, run in self.read(ids, start):
            longest = max(longest, run)
            if run >= self.window:
                spans.append((i - run + 1, i + 1))
                items |= self.inside[self.reach[v]]
            s = self.whole[v] if v else -1
            while s > 0:
                for k, item in self.ends.get(s, ()):
                    if k <= run:
                        spans.append((i - k + 1, i + 1))
                        items.add(item)
                s = self.whole[self.link[s]]
        return spans, items, longest


def joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_all(automaton: SuffixAutomaton, texts: list[str | None]) -> list[tuple[int, list, set[str], int]]:
    """(words, spans, items, longest run) of each text.

    Only runs of known words, as long as the shortest window at least, are read
    by the automaton: nothing else can hold a window.
    """
    word_lists = [words_of(x) for x in texts]
    sizes = np.array([len(w) for w in word_lists], dtype=np.int64)
    known = automaton.vocabulary.get
    flat = np.fromiter((known(w, -1) for ws in word_lists for w in (*ws, None)), np.int64, int(sizes.sum()) + len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    edge = np.diff(np.concatenate([[0], (flat >= 0).astype(np.int8), [0]]))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    enough = end - first >= max(1, automaton.shortest)
    out: list = [(int(n), [], set(), 0) for n in sizes]
    for a, b in zip(first[enough].tolist(), end[enough].tolist()):
        d = int(np.searchsorted(begins, a, "right")) - 1
        spans, items, longest = automaton.matches(flat[a:b].tolist(), a - int(begins[d]))
        n, had, known_items, before = out[d]
        out[d] = (n, had + spans, known_items | items, max(before, longest))
    return [(n, joined(spans), items, longest) for n, spans, items, longest in out]


def item_blocks(benchmark: DataFrame, item: str, text: str, max_bytes: int) -> Iterator[tuple[list[tuple[str, str | None]], bool]]:
    """The test items, in blocks of about ``max_bytes``, so that no broadcast or automaton outgrows a worker; whether a block is the last."""
    total = benchmark.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n = max(1, -(-total // max_bytes))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("words"))
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k)
        yield sorted(((r[0] if r[0] is not None else "", r[1]) for r in block.collect()), key=lambda r: (r[0], r[1] or "")), k == n - 1


def match_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """``docs`` and a column ``_match``: words, spans (flat pairs of word places), items, longest.

    A map over the documents: nothing is shuffled.  The items are broadcast in
    blocks of bounded size; each block is one more map over the same rows.

    A null or empty text has no words and no match; an empty benchmark or table
    gives no matches or rows; repeated rows are each matched; a null item_id
    counts as the empty string.  Other columns pass through unchanged; ``_match``
    must not be among them.
    """
    reserved(docs, "_match")
    return _matched(docs, benchmark, window, text, item, item_text, max_block_bytes)


def _matched(docs, benchmark, window, text, item, item_text, max_block_bytes, cut_from: int | None = None) -> DataFrame:
    """With ``cut_from``, the match has one more field: rest, the text without the spans of that many words or more (null if it has none)."""
    out, before = bounded_batches(docs), F.lit(None).cast(MATCH)
    for block, last in item_blocks(benchmark, item, item_text, max_block_bytes):
        kind = T.StructType([*MATCH.fields, T.StructField("rest", T.StringType())]) if last and cut_from is not None else MATCH
        read = _reader(matcher(docs, block, window), kind.names, cut_from if kind != MATCH else None)
        # only texts and earlier matches go to Python; counted as non-deterministic, it is never run twice
        out = out.withColumn("_match", F.pandas_udf(read, kind).asNondeterministic()(F.col(text), before))
        before = F.col("_match")
    return out


def _reader(found, names: list[str], cut_from: int | None):
    def read(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        values = texts.tolist()
        rows = found(values, before)
        if cut_from is not None:
            long = [[(a, b) for a, b in zip(r[1][::2], r[1][1::2]) if b - a >= cut_from] for r in rows]
            rows = [(*r, without(x, spans) if spans else None) for x, r, spans in zip(values, rows, long)]
        tidy()
        return pd.DataFrame(rows, columns=names)

    return read


MATCH = T.StructType(
    [
        T.StructField("words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
    ]
)


def matcher(docs: DataFrame, block: list[tuple[str, str | None]], window: int):
    """A function on texts and the matches of earlier blocks (a frame whose spans are null for none): their MATCH as tuples."""
    key = hashlib.sha256(repr(block).encode("utf-8", "surrogatepass")).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(texts: list[str | None], before: pd.DataFrame) -> list[tuple]:
        automaton = worker_table(f"suffix automaton {key} {window}", lambda: SuffixAutomaton.of(sent.value, window))
        out = []
        for (n, spans, items, longest), old, known, run_before in zip(find_all(automaton, texts), before["spans"], before["items"], before["longest"]):
            if old is not None:
                spans = joined([*map(tuple, np.asarray(old).reshape(-1, 2).tolist()), *map(tuple, spans)])
                items, longest = items | set(known), max(longest, int(run_before))
            out.append((n, [x for s in spans for x in s], sorted(items), longest))
        return out

    return run


def hit_words(match: str = "_match"):
    """How many words the spans of a match cover."""
    places = F.col(f"{match}.spans")
    return F.aggregate(
        F.transform(places, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, b: a + b
    )


def remove_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    max_coverage: float = 0.5,
    min_span: int = 1,
    text: str = "text",
    window: int = WINDOW,
    item: str = "item_id",
    item_text: str = "text",
    max_block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the hit spans of ``min_span`` words or more, and without documents of which such spans cover more than ``max_coverage``.

    The rest of a text stays as it is, character by character; a column n_chars
    follows the new text.  Options and special cases as in match_benchmark.
    """
    reserved(docs, "_match")
    found = _matched(docs, benchmark, window, text, item, item_text, max_block_bytes, min_span)
    ends = F.col("_match.spans")
    lengths = F.transform(ends, lambda x, i: F.when(i % 2 == 1, x - F.get(ends, i - 1)).otherwise(0))
    n_cut = F.aggregate(F.filter(lengths, lambda n: n >= min_span), F.lit(0).cast("long"), lambda a, b: a + b)
    out = found.where(F.col("_match.rest").isNull() | (n_cut <= max_coverage * F.col("_match.words")))
    out = out.withColumn(text, F.coalesce("_match.rest", text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words first..end-1 of each span and what is between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(raw.lower())]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def op1_suffix_automaton(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_benchmark(docs, table(spark, sf_dir, "benchmark"))
    n_hit = hit_words()
    return found.select(
        "doc_id",
        F.col("_match.words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_match.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: Plain SQL for the same contract: windows as joined strings, looked up at every place of every document.
OP1_SQL = """
WITH dw AS (
  SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents) d
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0) x
), sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, sizes WHERE len(w) >= k) x
), hits AS (SELECT r, p, grams.k, item FROM grams JOIN win ON grams.g = win.g AND grams.k = win.k),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) x GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) x GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
