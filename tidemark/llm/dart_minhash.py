"""Near-duplicate classes by DartMinHash signatures.

A document is a weighted set: its five-word shingles, each with the number of
times it occurs.  An element of weight w owns the region [0, w) of its own
strip; darts are thrown into all strips by hashing, in order of rank, each
aimed at one coordinate of the signature.  The first dart to land inside the
document's regions is the coordinate's value, and two documents agree on it
with the probability of their weighted Jaccard similarity.  Only as many ranks
are looked at as fill the signature, so its cost hardly grows with its length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, durable_with, free_name, read_columns, table, tidied, tidy, worker_table

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair misses all bands once in 9,000 times, at 0.85 once in 1,400,000.
BANDS, ROWS = 30, 6
#: Rounds of comparing a bucket with one hub, before what is open is compared in blocks of so many nodes and characters.
STAR_ROUNDS, BLOCK_NODES, BLOCK_CHARS = 1, 1024, 6_000_000
#: Rows that may be broadcast.
BROADCAST_ROWS = 200_000
#: Words whose codes a worker keeps.
TOKENS = 200_000
#: Strips of documents (8 bytes each) that a task of comparisons keeps.
HELD_STRIPS = 2_000_000

_WORD = re.compile(r"\w+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Chances that a strip's unit slab holds at most 0, 1, ... darts: Poisson with mean one.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


class _Codes(dict):
    """64-bit codes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= TOKENS:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash) of every shingle of lower-cased words; fewer words than ``size`` are one shingle."""
    lists = [_WORD.findall(x.lower()) if x else [] for x in texts]
    lists = [x if not x or len(x) >= size else x + [""] * (size - len(x)) for x in lists]
    sizes = np.array([len(x) for x in lists], np.int64)
    place = np.repeat(np.arange(len(texts)), sizes)
    codes = np.fromiter(map(worker_table("codes of words", _Codes).__getitem__, chain.from_iterable(lists)), np.uint64, int(sizes.sum()))
    n = max(0, len(codes) - size + 1)
    whole = place[:n] == place[size - 1 :] if n else np.empty(0, bool)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + codes[i : i + n]
    return place[:n][whole], _mix(out[whole])


def weighted(place: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (place, element) in order, and how often each occurs; 256 places at most, which share a key with 56 bits of the element."""
    key = np.sort((place.astype(np.uint64) << np.uint64(56)) | (element >> np.uint64(8)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key, times = key[at], np.diff(np.append(at, len(key)))
    return (key >> np.uint64(56)).astype(np.int64), key & np.uint64((1 << 56) - 1), times.astype(float)


def signatures(place: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures (texts x k) and whether a text has one.  Weights may be any positive numbers."""
    out, has = np.zeros((texts, k), np.uint64), np.bincount(place, minlength=texts) > 0
    total = np.bincount(place, weight, texts)
    # strips of unit height: a region of weight w is whole strips and a part of one
    strips = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(place)), strips)
    layer = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
    place, inside = place[of], np.minimum(1.0, weight[of] - layer)
    strip = _mix(element[of] + layer.astype(np.uint64) * _GOLDEN)
    darts, todo = k * (math.log(k) + 2), has
    while todo.any():
        limit = np.where(todo, darts / np.maximum(total, 1e-300), 0.0)
        some = np.flatnonzero(todo[place])
        found, first = _throw(place[some], strip[some], inside[some], limit, k)
        full = todo & np.isfinite(first).all(axis=1)
        out[full] = found[full]
        todo, darts = todo & ~full, darts * 2
    return out, has


def _throw(place, strip, inside, limit, k):
    """Darts of rank below a text's limit: the earliest one of each coordinate, and its rank."""
    slabs = np.ceil(limit[place]).astype(np.int64)
    of = np.repeat(np.arange(len(place)), slabs)
    slab = np.arange(len(of)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    cell = _mix(strip[of] ^ _mix(slab.astype(np.uint64) + np.uint64(1)))
    number = np.searchsorted(_POISSON, _unit(cell), "right")
    hit = np.repeat(np.arange(len(of)), number)
    nth = np.arange(len(hit)) - np.repeat(np.cumsum(number) - number, number)
    dart = _mix(cell[hit] + (nth.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
    at = of[hit]
    rank = slab[hit] + _unit(_mix(dart ^ np.uint64(0xA0761D6478BD642F)))
    text = place[at]
    lands = rank < limit[text]
    if (inside < 1).any():
        lands &= _unit(_mix(dart ^ np.uint64(0xE7037ED1A0B428DB))) < inside[at]
    dart, rank, text = dart[lands], rank[lands], text[lands]
    key = text * k + (dart % np.uint64(k)).astype(np.int64)
    first = np.full(len(limit) * k, np.inf)
    np.minimum.at(first, key, rank)
    best = rank == first[key]
    found = np.zeros(len(limit) * k, np.uint64)
    found[key[best]] = dart[best]
    return found.reshape(-1, k), first.reshape(-1, k)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, different from band to band."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, parts.shape[:2]).copy()
    for r in range(rows):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of strips (see strips_of)."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def strips_of(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """A text's shingles, the n-th occurrence of each as another element; sets of these have the weighted Jaccard similarity."""
    _, element, weight = weighted(*shingles([text], size))
    times = weight.astype(np.int64)
    layer = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return np.sort(_mix(np.repeat(element, times) + layer.astype(np.uint64) * _GOLDEN))


def sign(docs: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """id, digest (of the text; null counts as empty), size (its length) and bands (empty for a text without words)."""

    def read(texts: list[str]):
        keys = []
        for at in range(0, len(texts), 128):
            some = texts[at : at + 128]
            signature, has = signatures(*weighted(*shingles(some, size)), len(some), bands * rows)
            keys += [x.tolist() if h else [] for x, h in zip(band_keys(signature, bands, rows), has)]
        return (keys,)

    known = F.coalesce(F.col(text), F.lit(""))
    rows_in = docs.select(F.col(key).alias("id"), F.md5(known.cast("binary")).alias("digest"), F.char_length(known).cast("long").alias("size"), known.alias("text"))
    return read_columns(rows_in, "text", {"bands": "array<long>"}, read, ["id", "digest", "size"])


def files_for(df: DataFrame) -> int:
    """Files of tables of links, which are narrow and few beside the documents."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def texts_of(wanted: DataFrame, n: int, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, text for the nodes in ``wanted``, of which there are ``n`` rows; one row for each, as rows that repeat id and text hold the same."""
    few = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    named = nodes.join(few(wanted.select("node").distinct()), "node").select("node", F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    named = durable_with(named, files_for(nodes))[0]
    found = texts.join(few(named), F.expr("id <=> _id AND digest = _digest"))
    return durable(found.dropDuplicates(["node"]).select("node", "text"))


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: float, size: int = SHINGLE) -> DataFrame:
    """Those of the (distinct) pairs a, b whose texts are similar enough, by exact comparison.

    Texts are taken once for each node that is in a pair; a hub's many pairs may
    be split over tasks, each of which reads the hub's text again.
    """
    pairs, seen = durable_with(pairs, files_for(pairs), n=F.count("*"))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    found = texts_of(wanted, 2 * seen["n"], nodes, texts)
    left = found.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = found.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterable[pd.DataFrame]):
        known: dict[int, np.ndarray] = {}
        held = 0

        def strips(node, text):
            nonlocal held
            if node not in known:
                if held > HELD_STRIPS:
                    known.clear()
                    held = 0
                known[node] = strips_of(text, size)
                held += len(known[node])
            return known[node]

        for batch in batches:
            ok = [similarity(strips(a, x), strips(b, y)) >= least for a, x, b, y in zip(batch["a"], batch["text_a"], batch["b"], batch["text_b"])]
            yield batch.loc[ok, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(tidied(run), "a long, b long")


def shared_strips(a: list[np.ndarray], b: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many strips each of ``a`` shares with each of ``b``: products of 0-1 matrices, ``width`` strips at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    known, count = np.unique(np.concatenate([np.unique(np.concatenate(a)), np.unique(np.concatenate(b))]), return_counts=True)
    common = known[count == 2]

    def places(sets):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(common, flat)
        ok = (at < len(common)) & (common[np.minimum(at, max(0, len(common) - 1))] == flat) if len(common) else np.zeros(len(flat), bool)
        return row[ok], at[ok]

    (ra, ca), (rb, cb) = places(a), places(b)
    for k in range(0, len(common), width):
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            some = (c >= k) & (c < k + width)
            m[r[some], c[some] - k] = 1
        out += x @ y.T
    return out


def linked_in_blocks(met: DataFrame, n: int, nodes: DataFrame, texts: DataFrame, least: float, size: int = SHINGLE) -> DataFrame:
    """Links (a, b) that join all labels which similar nodes of a bucket have.

    Every node whose label is not the hub's meets every other of its bucket, by
    exact similarity, inside blocks: a bucket of more than BLOCK_NODES nodes, or
    BLOCK_CHARS of text, is cut up, and a task compares one block with another.
    So no pair becomes a row, a node is sent once for each block of its bucket,
    and a task sends back no more links than it has nodes.
    """
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_NODES, F.col("chars") / BLOCK_CHARS)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rest = F.col("label") != F.col("hub.label")
    every = F.sequence(F.lit(0), blocks - 1)
    one = lambda i, j, asks: F.struct(i.alias("i"), j.alias("j"), F.lit(asks).alias("asks"))
    roles = F.concat(F.when(rest, F.transform(every, lambda k: one(own, k, True))).otherwise(F.array()), F.transform(every, lambda k: one(k, own, False)))
    rows = met.select("bucket", "node", "label", F.explode(roles).alias("r")).select("bucket", "node", "label", "r.*")
    rows = rows.join(texts_of(met, n, nodes, texts), "node")

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        asks, asked = batch[batch["asks"]], batch[~batch["asks"]]
        if not len(asks) or not len(asked):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        known = {x: strips_of(t, size) for x, t in zip(batch["node"], batch["text"])}
        a, b = [known[x] for x in asks["node"]], [known[x] for x in asked["node"]]
        both = shared_strips(a, b)
        sizes = np.array([len(x) for x in b], np.float32)
        label, node = asked["label"].to_numpy(), asked["node"].to_numpy()
        up: dict[int, int] = {}

        def top(x):
            while x in up:
                x = up[x]
            return x

        out = []
        for k, (x, lab) in enumerate(zip(asks["node"], asks["label"])):
            # counts are whole numbers below 2 ** 24, so the products are exact; the ratio is taken again in doubles
            maybe = np.flatnonzero(both[k] >= (len(a[k]) + sizes - both[k]) * np.float32(least * (1 - 1e-5)))
            for i in maybe.tolist():
                p, q = top(lab), top(label[i])
                if p != q and similarity(a[k], b[i]) >= least:
                    up[p] = q
                    out.append((x, node[i]))
        del known, a, b, both
        tidy()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its connected component, for the nodes of ``edges`` (a, b).

    Alternates large and small stars until nothing changes; each step is written,
    and joins a node's edges to its least neighbour, so stars with many leaves
    are split like any skewed join.
    """
    files = files_for(edges)
    measures = {"n": F.count("*"), "mix": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, state = durable_with(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), files, **measures)
    before = None
    while state != before:
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = durable_with(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), files)[0]
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now, state = durable_with(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), files, **measures)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def links(nodes: DataFrame, texts: DataFrame, least: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all similar candidate pairs.

    Candidates are nodes that share a bucket.  A star round compares each node
    of a bucket with its hub, the node that shares most with others; the hub then
    leaves the bucket, and buckets whose nodes are all known to be connected are
    done.  What is left is compared in blocks.  So no candidate pair that could
    join two components goes without a comparison, and a group of copies of a
    text costs a star, not all its pairs.
    """
    files = files_for(nodes)
    entries = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    open_ = durable_with(entries.join(sizes, "bucket"), files)[0]
    reach = open_.groupBy("node").agg(F.sum("n").alias("reach"))
    open_ = open_.join(reach, "node").select("bucket", "node", "size", "reach", F.col("node").alias("label"))
    rest = F.col("label") != F.col("hub.label")
    found: list[DataFrame] = []
    for step in range(STAR_ROUNDS + 1):
        hub = F.max(F.struct("reach", "node", "label")).alias("hub")
        hubs = open_.groupBy("bucket").agg(hub, F.count("*").alias("n"), F.sum("size").alias("chars"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("lo", "hi")
        met, seen = durable_with(open_.join(hubs, "bucket"), files, n=F.count("*"))
        if not seen["n"]:
            break
        if step == STAR_ROUNDS:
            found.append(durable_with(linked_in_blocks(met, seen["n"], nodes, texts, least, size).distinct(), files)[0])
            break
        pairs = met.where(rest).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
        found.append(durable_with(verified(pairs.distinct(), nodes, texts, least, size), files)[0])
        # a node goes by the label of the hub that reaches most, and that hub by its own hub's
        to_hub = found[-1].join(met.select(F.col("hub.node").alias("b"), F.col("hub.reach").alias("r")).distinct(), "b").groupBy(F.col("a").alias("node")).agg(F.max(F.struct("r", "b")).alias("h")).select("node", F.col("h.b").alias("up"))
        to_hub = durable_with(to_hub, files)[0]
        over = to_hub.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = to_hub.join(over, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        open_ = met.where("node <> hub.node").select("bucket", "node", "size", "reach", "label").join(up, "node", "left").select("bucket", "node", "size", "reach", F.coalesce("up", "label").alias("label"))
    if not found:
        return nodes.sparkSession.createDataFrame([], "a long, b long")
    return reduce(DataFrame.union, found)


def near_duplicate_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE
) -> DataFrame:
    """One row for each row of ``docs``: key, digest, class_id and class_size.

    Equal texts are one node; nodes are joined if their weighted Jaccard
    similarity is ``least`` or more, and classes are the connected components.
    class_id is the least key in the class, class_size counts its rows.

    A null text counts as empty; texts without words are only equal to
    themselves; a text of fewer than ``size`` words is one shingle.  Keys never
    pass through floats, so large ones beside null ones stay exact; null keys
    are never the least; a class without a key has a null class_id.  Repeated
    rows have a row each.  An empty table gives no rows; other columns are not
    carried.
    """
    signed = durable(sign(docs, key, text, bands, rows, size))
    nodes = signed.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    texts = docs.select(F.col(key).alias("id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"), F.col(text).alias("text"))
    labels = components(links(nodes, texts, least, size))
    labelled = durable(nodes.drop("bands").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    classes = labelled.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    members = labelled.select("digest", "label").join(classes, "label").select("digest", "class_id", "class_size")
    return signed.select(F.col("id").alias(key), "digest").join(members, "digest").select(key, "digest", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, that with the least key, columns as they are.

    Rows that repeat key and text are one document and stay or go together.
    """
    found = near_duplicate_classes(docs, key, text, **options)
    a, b = free_name(docs, "_id"), free_name(docs, "_digest")
    gone = found.where(~F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias(a), F.col("digest").alias(b)).distinct()
    gone, seen = durable_with(gone, files_for(docs), n=F.count("*"))
    same = docs[key].eqNullSafe(F.col(a)) & (F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")) == F.col(b))
    return docs.join(F.broadcast(gone) if seen["n"] <= BROADCAST_ROWS else gone, same, "left_anti")


def op8_dart_minhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicate_classes(docs).select("doc_id", "class_id", "class_size")
