"""Ranked lexical search with inverted treaps.

The documents are dealt into segments of bounded size.  In a segment every term
has a treap of its postings: in the order of documents by its symmetric order, a
heap by impact, so the root of any stretch of documents is the highest impact in
it.  A query walks the treaps of its terms together, over stretches of documents:
the impacts at the roots, weighted and summed, bound what any document of the
stretch can score; a stretch whose bound cannot enter the best k is pruned with
all that is below it, others are split at a root, and short ones are scored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bounded_batches, durable, table, tidied

#: Postings after which a segment is closed (12 bytes each while it is gathered).
SEGMENT_POSTINGS = 1_000_000
#: Bytes of query text that are searched for at once; more queries are searched in more blocks.
MAX_BLOCK_BYTES = 1_000_000
#: Documents of a stretch that is scored and not split, and stretches that a step takes, best first.
SHORT, STEP = 64, 64

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_INDEX = "segment long, term string, docs array<int>, times array<int>, ids array<long>, lengths array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    """Letters, digits and all beyond ASCII; bytes.lower() changes A-Z alone, as asked for."""
    return _TERM.findall(text.lower()) if text else []


class _Codes(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = code = len(self)
        return code


class Segment:
    """Gathers documents; ``rows`` gives the lists of each term, documents numbered in the order of their ids (null last)."""

    def __init__(self):
        self.codes, self.code, self.times = _Codes(), array("i"), array("i")
        self.ids: list[int | None] = []
        self.distinct, self.lengths = array("i"), array("i")

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        counts = Counter(terms_of(text))
        if counts:
            self.ids.append(doc_id)
            self.distinct.append(len(counts))
            self.lengths.append(counts.total())
            self.code.extend(map(self.codes.__getitem__, counts))
            self.times.extend(counts.values())

    def rows(self, number: int, size: int = 2_000) -> Iterator[pa.RecordBatch]:
        names = ["segment", "term", "docs", "times", "ids", "lengths"]
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        lengths = np.array(self.lengths, np.int32)[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([""]), pa.nulls(1, ints), pa.nulls(1, ints), pa.array([[self.ids[i] for i in order]], longs), pa.array([lengths], ints)], names
        )
        doc = np.repeat(place, self.distinct)
        code = np.array(self.code, np.int32)
        by_term = np.lexsort((doc, code))
        doc, times = doc[by_term], np.array(self.times, np.int32)[by_term]
        ends = np.cumsum(np.bincount(code, minlength=len(self.codes)))
        terms = list(self.codes)
        for a in range(0, len(terms), size):
            some = terms[a : a + size]
            edges = np.concatenate([[ends[a - 1] if a else 0], ends[a : a + size]])
            cut = slice(int(edges[0]), int(edges[-1]))
            offsets = pa.array((edges - edges[0]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[cut])) for x in (doc, times)]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), pa.array([t.decode("utf-8", "replace") for t in some], pa.string()), *lists, pa.nulls(n, longs), pa.nulls(n, ints)], names
            )


@dataclass(frozen=True)
class Index:
    """The segments' rows, a row with term '' for a segment's own documents; how many documents have terms, and how many terms they have."""

    rows: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", postings: int = SEGMENT_POSTINGS) -> Index:
    """The index of all rows of ``docs``, written; a map, nothing is shuffled.

    Keys are whole numbers or null.  Documents without a term (null and empty
    texts among them) are no part of it; repeated rows are documents each.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        segment = Segment()
        for batch in batches:
            for doc_id, words in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                segment.add(doc_id, words)
                if len(segment.code) >= postings:
                    yield from segment.rows(number)
                    number, segment = number + 1, Segment()
        if segment.ids:
            yield from segment.rows(number)

    narrow = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    rows = durable(bounded_batches(narrow).mapInArrow(tidied(run), _INDEX))
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    n, all_terms = rows.where("term = ''").agg(F.sum(F.size("ids").cast("long")), F.sum(total)).first()
    return Index(rows, n or 0, all_terms or 0)


def treap_links(ends: Iterable[int], key: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The treaps of stretches of ``key`` that end at ``ends``: each place's left and right child, and the roots; len(key) stands for none.

    Built along the right spine, in linear time.
    """
    none = len(key)
    left, right, roots = [none] * (none + 1), [none] * (none + 1), []
    begin = 0
    for end in ends:
        spine: list[int] = []
        for i in range(begin, end):
            k, below = key[i], none
            while spine and key[spine[-1]] < k:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        roots.append(spine[0] if spine else none)
        begin = end
    return left, right, roots


class Treaps:
    """The treaps of some terms in one segment, as flat arrays; the last place stands for none."""

    def __init__(self, ids: list[int | None], lengths: np.ndarray, terms: list[str], docs: list[np.ndarray], times: list[np.ndarray], documents: int, total: int):
        self.ids, self.documents = ids, len(ids)
        sizes = np.array([len(x) for x in docs], np.int64)
        doc, tf = np.concatenate(docs).astype(np.int64), np.concatenate(times).astype(np.int64)
        m = 10 + (90 * lengths.astype(np.int64) * documents) // total
        impact = (1_000_000_000 * tf) // (1_000 * tf + 8 * m[doc])
        # equal impacts are ordered by a hash, so that thousands of copies make no chain
        tie = (doc * 0x9E3779B1 >> 7) & 0xFFFFF
        left, right, roots = treap_links(np.cumsum(sizes).tolist(), (impact << 20 | tie).tolist())
        self.none = len(doc)
        self.doc, self.impact = np.append(doc, -1), np.append(impact, 0)
        self.left, self.right = np.array(left), np.array(right)
        self.root = dict(zip(terms, roots))
        self.number = {t: i for i, t in enumerate(terms)}
        # sorted: terms one after another, each by document
        self.place = np.repeat(np.arange(len(terms)), sizes) * (self.documents + 1) + doc

    def below(self, node: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The roots of what the nodes hold of documents before ``end``."""
        while (off := (node != self.none) & (self.doc[node] >= end)).any():
            node = np.where(off, self.left[node], node)
        return node

    def from_(self, node: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The roots of what the nodes hold of documents from ``begin`` on."""
        while (off := (node != self.none) & (self.doc[node] < begin)).any():
            node = np.where(off, self.right[node], node)
        return node

    def search(self, terms: list[str], weights: np.ndarray, best: Best) -> int:
        """Brings the documents of the segment into ``best``; returns how many were scored."""
        known = [i for i, t in enumerate(terms) if t in self.root]
        if not known:
            return 0
        number = np.array([self.number[terms[i]] for i in known])
        w = weights[known]
        begin, end = np.zeros(1, np.int64), np.full(1, self.documents, np.int64)
        node = np.array([[self.root[terms[i]] for i in known]])
        bound = (self.impact[node] * w).sum(axis=1)
        scored = 0
        while True:
            alive = (bound > 0) & (bound >= best.least)
            begin, end, node, bound = begin[alive], end[alive], node[alive], bound[alive]
            if not len(begin):
                return scored
            if len(begin) > STEP:
                order = np.argpartition(-bound, STEP)
                now, later = order[:STEP], order[STEP:]
            else:
                now, later = np.arange(len(begin)), np.empty(0, np.int64)
            short = end[now] - begin[now] <= SHORT
            if short.any():
                scored += self._score(begin[now[short]], end[now[short]], number, w, best)
            split = now[~short]
            b, e, n = begin[split], end[split], node[split]
            # at the document of the root that adds most, but not near an end of the stretch
            top = self.doc[n[np.arange(len(split)), np.argmax(self.impact[n] * w, axis=1)]]
            margin = np.maximum(1, (e - b) // 4)
            at = np.clip(top, b + margin, e - margin)
            one, two = self.below(n, at[:, None]), self.from_(n, at[:, None])
            begin, end = np.concatenate([begin[later], b, at]), np.concatenate([end[later], at, e])
            node = np.concatenate([node[later], one, two])
            bound = np.concatenate([bound[later], (self.impact[one] * w).sum(axis=1), (self.impact[two] * w).sum(axis=1)])

    def _score(self, begin: np.ndarray, end: np.ndarray, number: np.ndarray, w: np.ndarray, best: Best) -> int:
        base = number * (self.documents + 1)
        first = np.searchsorted(self.place, base + begin[:, None])
        count = np.searchsorted(self.place, base + end[:, None]) - first
        flat = count.ravel()
        at = np.repeat(first.ravel() - np.cumsum(flat) + flat, flat) + np.arange(flat.sum())
        stretch = np.repeat(np.repeat(np.arange(len(begin)), len(w)), flat)
        slot = stretch * SHORT + self.doc[at] - begin[stretch]
        scores = np.zeros(len(begin) * SHORT, np.int64)
        np.add.at(scores, slot, self.impact[at] * np.repeat(np.tile(w, len(begin)), flat))
        good = np.flatnonzero((scores > 0) & (scores >= best.least))
        best.add(scores[good], [self.ids[i] for i in (begin[good // SHORT] + good % SHORT).tolist()])
        return int((end - begin).sum())


class Best:
    """The k best (score, id) so far; equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.found: list[tuple[int, bool, int, int | None]] = []

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        self.found = sorted([*self.found, *((-s, i is None, i or 0, i) for s, i in zip(scores.tolist(), ids))])[: self.k]
        if len(self.found) == self.k:
            self.least = -self.found[-1][0]


def query_blocks(queries: DataFrame, key: str, text: str, max_bytes: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Each distinct query's key and terms, in blocks of about ``max_bytes`` of text, so that what is broadcast is bounded."""
    rows = queries.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).distinct()
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, min(n, -(-size // max_bytes)))
    for k in range(blocks):
        some = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == k)
        found = [(r["key"], sorted({t.decode("utf-8", "replace") for t in terms_of(r["text"])})) for r in some.collect()]
        if found := [(q, terms) for q, terms in found if terms]:
            yield found


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", max_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The ``k`` documents of the highest scores above 0 for each query: key, rank, doc_id, score; equal scores by ascending doc_id, null last.

    A term's weight and a document's m are those of the whole index.  Queries are
    broadcast in blocks; of the index only the lists of a block's terms are
    shuffled, segment by segment, and a task sends back at most k documents a
    query.  A query without terms has no rows, queries that repeat key and text
    are one, an empty index gives no rows.
    """
    spark = queries.sparkSession
    kind = queries.schema[key].dataType.simpleString()
    out = spark.createDataFrame([], f"{key} {kind}, rank int, doc_id long, score long")
    for block in query_blocks(queries, key, text, max_bytes):
        found = _search_block(index, block, k)
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"query int, {key} {kind}")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.join(F.broadcast(names), "query").select(key, "rank", "doc_id", "score")
        out = out.unionByName(ranked)
    return out


def _search_block(index: Index, block: list[tuple[object, list[str]]], k: int) -> DataFrame:
    spark = index.rows.sparkSession
    documents, total = index.documents, index.terms
    wanted = spark.createDataFrame([(t,) for t in sorted({"", *(t for _, terms in block for t in terms)})], "term string")
    rows = index.rows.join(F.broadcast(wanted), "term")
    holding = {r[0]: r[1] for r in rows.where("term <> ''").groupBy("term").agg(F.sum(F.size("docs").cast("long"))).collect()}
    asked = []
    for i, (_, terms) in enumerate(block):
        some = [t for t in terms if t in holding]
        asked.append((i, some, np.array([weight(documents, holding[t]) for t in some], np.int64)))
    sent = spark.sparkContext.broadcast(asked)

    def run(batches: Iterable[pa.RecordBatch]):
        best = [Best(k) for _ in sent.value]
        for ids, lengths, terms, docs, times in segments(batches):
            treaps = Treaps(ids, lengths, terms, docs, times, documents, total)
            for i, some, weights in sent.value:
                treaps.search(some, weights, best[i])
        found = [(i, d, -s) for i, b in enumerate(best) for s, _, _, d in b.found]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    dealt = rows.repartition("segment").sortWithinPartitions("segment", "term")
    return bounded_batches(dealt.select("segment", "term", "docs", "times", "ids", "lengths")).mapInArrow(tidied(run), "query int, doc_id long, score long")


def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Segment by segment, from rows in the order of segment and term: ids, lengths, terms, docs, times; one is held at a time."""
    now, ids, lengths, terms, docs, times = None, [], np.empty(0, np.int32), [], [], []
    for batch in batches:
        column = {c: batch.column(c) for c in batch.schema.names}
        values = {c: (column[c].values.to_numpy(zero_copy_only=False), column[c].offsets.to_numpy()) for c in ("docs", "times")}
        for i, (number, term) in enumerate(zip(column["segment"].to_pylist(), column["term"].to_pylist())):
            if number != now:
                if terms:
                    yield ids, lengths, terms, docs, times
                now, terms, docs, times = number, [], [], []
            if term == "":
                ids, lengths = column["ids"][i].as_py(), np.array(column["lengths"][i].as_py(), np.int32)
            else:
                terms.append(term)
                for c, into in (("docs", docs), ("times", times)):
                    flat, edges = values[c]
                    into.append(flat[edges[i] : edges[i + 1]].copy())
    if terms:
        yield ids, lengths, terms, docs, times


def op11_inverted_treaps(spark, sf_dir):
    index = build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), has AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
stats AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM has),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) x GROUP BY ALL),
items AS (
  SELECT DISTINCT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS term
  FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM tf, stats WHERE term IN (SELECT term FROM items) GROUP BY term
), scores AS (
  SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS score
  FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN has USING (r), stats GROUP BY item_id, r
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scores JOIN has USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""
