"""Quality selection by importance resampling.

Two generative models of hashed word n-grams, one of the target text and one of
the raw text, give each document the log ratio of its probabilities; Gumbel
top-k over these log weights then draws documents without replacement, in
proportion to their weights.  A second ratio, of labelled toxic text to the
target, is decided by a document's few strongest n-grams and keeps toxic
documents out of the draw.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, durable, free_name, reserved, table, tidied, tidy, worker_table

#: Hash buckets of the n-gram models: a broadcast of three arrays of 0.5 MB at any corpus size.
BUCKETS = 1 << 16
#: Weight of the raw model, in counts of each bucket, as the prior of the target model.
PRIOR = 10.0
#: Labelled documents for the target model, at most: the bound on the sample that it is fitted on.
MAX_LABELLED = 200_000
#: The share of target documents that the number of documents drawn may leave out.
LOSS = 0.002
#: Toxic documents that an n-gram of the toxic ratio stands in at least, and n-grams at most, the most frequent: the bound on what is collected and broadcast.
TOXIC_SUPPORT, TOXIC_GRAMS = 3, 1 << 17
#: The prior of the toxic ratio, in documents; the strongest n-grams that make a document's score; the share of clean documents it may take.
TOXIC_PRIOR, STRONGEST, TOXIC_LOSS = 1.0, 3, 0.001
#: Bits of a key that one pass of the search for the k-th key counts by.
RADIX_BITS = 16
#: Tokens whose codes a worker keeps.
CODES = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Codes(dict):
    """64-bit codes of tokens.  Case is folded, but an all-capital word is another token."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CODES:
            self.clear()
        folded = token if token.isupper() and len(token) > 1 else token.lower()
        self[token] = code = xxhash.xxh64_intdigest(folded.encode("utf-8", "surrogatepass"))
        return code


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, 64-bit code) of every unigram and bigram of words and punctuation runs in ``texts``."""
    lists = [_TOKEN.findall(x) if x else [] for x in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    place = np.repeat(np.arange(len(texts)), sizes)
    codes = np.fromiter(map(worker_table("codes of tokens", _Codes).__getitem__, chain.from_iterable(lists)), np.uint64, int(sizes.sum()))
    inside = place[:-1] == place[1:]
    two = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:])[inside]
    return (
        np.concatenate([place, place[:-1][inside]]),
        np.concatenate([_mixed(codes), _mixed(two ^ np.uint64(0x5851F42D4C957F2D))]),
    )


def bucket_of(codes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return (codes % np.uint64(buckets)).astype(np.int64)


def features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` with each code's bucket in its place."""
    place, codes = grams(texts)
    return place, bucket_of(codes, buckets)


def _pieces(values: list, step: int = 256):
    return (slice(k, k + step) for k in range(0, len(values), step))


def count_features(docs: DataFrame, text: str, fold: Column, folds: int, buckets: int = BUCKETS) -> np.ndarray:
    """Feature counts by (fold, bucket) over all rows; fold 0 is the rest.

    A task adds its rows up and sends one number for each bucket that it met, so
    what is shuffled is bounded by tasks * buckets and what is collected by
    folds * buckets.
    """

    def run(batches: Iterable[pd.DataFrame]):
        total = np.zeros((folds, buckets), np.int64)
        for batch in batches:
            texts, of = batch["text"].tolist(), batch["fold"].to_numpy()
            for some in _pieces(texts):
                place, found = features(texts[some], buckets)
                total += np.bincount(of[some][place] * buckets + found, minlength=total.size).reshape(total.shape)
        for k in range(folds):
            some = np.flatnonzero(total[k])
            yield pd.DataFrame({"fold": k, "bucket": some, "n": total[k][some]})

    rows = docs.select(F.col(text).alias("text"), fold.cast("int").alias("fold"))
    got = bounded_batches(rows).mapInPandas(tidied(run), "fold int, bucket int, n long").groupBy("fold", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((folds, buckets), np.int64)
    out[got["fold"], got["bucket"]] = got["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw).

    The target model is the raw one, reweighted where counts speak: a bucket's
    ratio is (count + prior) / (expected + prior), so what the labelled sample
    is too small to have met counts neither for nor against a document.
    """
    q = (raw + 1e-9) / (raw + 1e-9).sum()
    ratio = (target + prior) / (q * target.sum() + prior)
    return np.log(ratio) - np.log((q * ratio).sum())


@dataclass(frozen=True)
class Toxic:
    """Sorted codes of n-grams, and their log ratios of toxic to target text.

    Row 0 is the mean of rows 1 and 2, which have that fold left out: so all
    rows are on the scale that the held-out threshold is taken on.
    """

    grams: np.ndarray
    ratios: np.ndarray


@dataclass(frozen=True)
class Model:
    """Log ratios with both folds of the labelled target documents, and with each fold left out; the toxic ratio, if any is labelled."""

    ratios: np.ndarray
    without: tuple[np.ndarray, np.ndarray]
    toxic: Toxic | None = None


def labelled_folds(labels: DataFrame, key: str, most: int = MAX_LABELLED) -> DataFrame:
    """key, q, t and _fold (1 or 2) of the labelled documents; ``most`` at most, by hash order."""
    one = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    order = F.xxhash64(key)
    bounded = one.orderBy(order, key).limit(most)
    return bounded.withColumn("_fold", (F.pmod(order, F.lit(2)) + 1).cast("int"))


def target_folds(labels: DataFrame, key: str, most: int = MAX_LABELLED) -> DataFrame:
    """key and _fold (1 or 2) of the target documents: good and not toxic."""
    return labelled_folds(labels, key, most).where("q = 1 AND coalesce(t, 0) = 0").select(key, "_fold")


def with_folds(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    folds = target_folds(labels, key)  # MAX_LABELLED rows at most, so it may be broadcast
    return docs.join(F.broadcast(folds), key, "left").withColumn("_fold", F.coalesce("_fold", F.lit(0)))


def sketch(sorted_codes: np.ndarray) -> np.ndarray:
    """Whether any code begins with certain 20 bits: what most other codes are told apart by."""
    out = np.zeros(1 << 20, bool)
    out[sorted_codes >> np.uint64(44)] = True
    return out


def found_in(sorted_codes: np.ndarray, codes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of those of ``codes`` that are in the table, and the places there."""
    maybe = np.flatnonzero(heads[codes >> np.uint64(44)])
    some = codes[maybe]
    at = np.minimum(np.searchsorted(sorted_codes, some), len(sorted_codes) - 1)
    found = sorted_codes[at] == some
    return maybe[found], at[found]


def fit_toxic(docs: DataFrame, labels: DataFrame, key: str, text: str) -> Toxic | None:
    """The toxic ratio, by the number of documents that hold an n-gram; None if nothing is labelled toxic or as target.

    N-grams keep their whole codes, since a bucket that they share with others
    would hide the few toxic words.  First the n-grams of the toxic documents
    are counted, then those of the target documents that are among them.
    """
    folds = labelled_folds(labels, key)
    toxic, target = folds.where("t = 1").select(key, "_fold"), target_folds(labels, key)

    def labelled(rows: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(rows), key).select(F.col(text).alias("text"), F.col("_fold").alias("fold"))

    def per_document(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            texts, of = batch["text"].tolist(), batch["fold"].to_numpy()
            for some in _pieces(texts):
                place, codes = grams(texts[some])
                pairs = pd.DataFrame({"fold": of[some][place], "place": place, "code": codes.view(np.int64)}).drop_duplicates()
                yield pairs.groupby(["fold", "code"]).size().reset_index(name="n")[["fold", "code", "n"]]

    by_fold = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (1, 2)]
    counted = labelled(toxic).mapInPandas(tidied(per_document), "fold int, code long, n long").groupBy("code").agg(*by_fold)
    often = counted.where(F.col("n1") + F.col("n2") >= TOXIC_SUPPORT)
    top = often.orderBy((F.col("n1") + F.col("n2")).desc(), "code").limit(TOXIC_GRAMS).toPandas()
    if top.empty:
        return None
    codes = top["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    codes, t = codes[order], top[["n1", "n2"]].to_numpy(np.float64)[order].T
    sent = docs.sparkSession.sparkContext.broadcast(codes)

    def among(batches: Iterable[pd.DataFrame]):
        total, heads = np.zeros((2, len(sent.value)), np.int64), sketch(sent.value)
        for batch in batches:
            texts, of = batch["text"].tolist(), batch["fold"].to_numpy() - 1
            for some in _pieces(texts):
                place, found = grams(texts[some])
                known, at = found_in(sent.value, found, heads)
                pairs = np.unique(place[known] * len(sent.value) + at)
                np.add.at(total, (of[some][pairs // len(sent.value)], pairs % len(sent.value)), 1)
        for k in (0, 1):
            some = np.flatnonzero(total[k])
            yield pd.DataFrame({"fold": k, "at": some, "n": total[k][some]})

    got = labelled(target).mapInPandas(tidied(among), "fold int, at int, n long").groupBy("fold", "at").agg(F.sum("n").alias("n")).toPandas()
    g = np.zeros((2, len(codes)))
    g[got["fold"], got["at"]] = got["n"]
    sizes = {(r["toxic"], r["fold"]): r["count"] for r in labelled_sizes(docs, key, toxic, target)}
    nt, ng = ([sizes.get((x, k), 0) for k in (1, 2)] for x in (True, False))
    if not min(ng):
        return None
    without = [np.log((t[k] + TOXIC_PRIOR) / (g[k] * nt[k] / ng[k] + TOXIC_PRIOR)) for k in (1, 0)]
    ratios = np.stack([(without[0] + without[1]) / 2, *without])
    strong = ratios.max(axis=0) > 0
    return Toxic(codes[strong], ratios[:, strong]) if strong.any() else None


def labelled_sizes(docs: DataFrame, key: str, toxic: DataFrame, target: DataFrame) -> list:
    """toxic, fold, count: how many rows of ``docs`` are labelled either way."""
    both = toxic.withColumn("toxic", F.lit(True)).unionByName(target.withColumn("toxic", F.lit(False)))
    return docs.select(key).join(F.broadcast(both), key).groupBy("toxic", F.col("_fold").alias("fold")).count().collect()


def toxic_scores(place: np.ndarray, codes: np.ndarray, n: int, toxic: Toxic | None, of: np.ndarray, heads: np.ndarray | None) -> np.ndarray:
    """``heads`` is the sketch of the table.  For each of ``n`` texts the sum of its STRONGEST highest positive ratios, each n-gram once."""
    if toxic is None:
        return np.zeros(n)
    known, at = found_in(toxic.grams, codes, heads)
    place = place[known]
    values = toxic.ratios[of[place], at]
    place, at, values = place[values > 0], at[values > 0], values[values > 0]
    _, first = np.unique(place * len(toxic.grams) + at, return_index=True)
    order = first[np.lexsort((-values[first], place[first]))]
    place, values = place[order], values[order]
    top = np.arange(len(place)) - np.searchsorted(place, place) < STRONGEST
    return np.bincount(place[top], values[top], n)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> Model:
    """The raw model is counted over all rows of ``docs``, the target and toxic models over the labelled rows."""
    rest, one, two = count_features(with_folds(docs.select(key, text), labels, key), text, F.col("_fold"), 3, buckets)
    raw = rest + one + two
    toxic = fit_toxic(docs.select(key, text), labels, key, text)
    return Model(log_ratios(one + two, raw), (log_ratios(two, raw), log_ratios(one, raw)), toxic)


def log_weights(docs: DataFrame, model: Model, text: str = "text", name: str = "log_weight", fold: str | None = None) -> DataFrame:
    """``docs`` with the log importance weight of every whole text, and its toxic score as _toxic; a text without features has no weight (null).

    With ``fold``, rows whose fold is 1 or 2 are also weighed by the models
    without that fold, in the same pass: _held and _held_toxic, null in other rows.
    """
    new = [name, "_toxic", "_held", "_held_toxic"] if fold else [name, "_toxic"]
    reserved(docs, *new)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(place: np.ndarray, codes: np.ndarray, n: int, of: np.ndarray, tables: np.ndarray, heads: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        sums = np.bincount(place, tables[of[place], bucket_of(codes, tables.shape[1])], n)
        return np.where(np.bincount(place, minlength=n) > 0, sums, np.nan), toxic_scores(place, codes, n, sent.value.toxic, of, heads)

    def weigh(texts: pd.Series, folds: pd.Series) -> pd.DataFrame:
        tables = np.stack([sent.value.ratios, *sent.value.without])
        heads = sketch(sent.value.toxic.grams) if sent.value.toxic else None
        values, folds_of = texts.tolist(), folds.to_numpy()
        out = [np.zeros((4, 0))]
        for some in _pieces(values):
            place, codes = grams(values[some])
            of, n = folds_of[some], len(values[some])
            rows = np.full((4, n), np.nan)
            rows[:2] = score(place, codes, n, np.zeros(n, np.int64), tables, heads)
            if (held := of > 0).any():
                among = held[place]
                rows[2:, held] = np.stack(score(place[among], codes[among], n, of, tables, heads))[:, held]
            out.append(rows)
        tidy()
        return pd.DataFrame(np.concatenate(out, axis=1)[: len(new)].T, columns=new)

    # only the texts go to Python; as it counts as non-deterministic, no rule of the optimiser makes it run twice
    udf = F.pandas_udf(weigh, T.StructType([T.StructField(c, T.DoubleType()) for c in new])).asNondeterministic()
    found = free_name(docs, "_scores")
    out = bounded_batches(docs).withColumn(found, udf(F.col(text), F.col(fold).cast("long") if fold else F.lit(0).cast("long")))
    return out.withColumns({c: F.nanvl(F.col(f"{found}.{c}"), F.lit(None)) for c in new}).drop(found)


def gumbel(seed: int, *keys: Column) -> Column:
    """Standard Gumbel noise that depends on the seed and the keys alone, so a retried task draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(u))


def ranks(key: Column, tie: Column) -> tuple[Column, Column]:
    """Two integers in the order of ``key``, to 2 ** -20, and of a hash of ``tie`` below that."""
    step = F.floor(F.greatest(F.least(key, F.lit(2.0**40)), F.lit(-(2.0**40))) * F.lit(2.0**20))
    return step.cast("long"), F.xxhash64(tie)


def kth(scored: DataFrame, first: str, second: str, k: int) -> tuple[int, int] | None:
    """The k-th highest pair (first, second); None if there are no more than k rows.

    No global sort: rows are counted by the leading bits, RADIX_BITS at a time,
    and the next pass looks into one bucket alone; each brings 2 ** RADIX_BITS
    counts to the driver at most.  ``scored`` should be a written table.
    """
    left, found = k, []
    for rank in (first, second):
        for shift in range(64 - RADIX_BITS, -1, -RADIX_BITS):
            digit = F.shiftright(F.col(rank), shift)
            counts = sorted(((r[0], r[1]) for r in scored.groupBy(digit.alias("d")).count().collect()), reverse=True)
            if not found and shift == 64 - RADIX_BITS and sum(n for _, n in counts) <= k:
                return None
            for value, n in counts:
                if n >= left:
                    break
                left -= n
            scored = scored.where(digit == value)
        found.append(value)
        if n == left:
            break
    return (found[0], found[1] if len(found) > 1 else -(2**63))


@dataclass(frozen=True)
class Draw:
    """What decides whether a row is drawn, without another look at the others."""

    model: Model
    threshold: float | None
    k: int
    bound: tuple[int, int] | None
    seed: int
    most_toxic: float | None = None


def draw(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", loss: float = LOSS, seed: int = 7, carry: list[str] | None = None) -> tuple[DataFrame, Draw]:
    """``docs`` (or its columns ``carry``) with _weight and _kept, written, and what decides.

    Fits the models, weighs all rows, and finds the k-th key of Gumbel top-k.
    k is the number of rows that weigh as much as all but ``loss`` of the
    labelled target documents, each weighed by a model that has not seen it.
    Rows with a toxic score above that of all but TOXIC_LOSS of these documents
    are not drawn from.

    Null and empty texts, and texts of white space, are never drawn.  Without
    target labels all other rows are.  Rows with the same key and text are drawn
    together; an empty table gives no rows; other columns pass through, but none
    may be called _weight, _toxic, _kept, _first, _second, _fold, _held or _held_toxic.
    """
    reserved(docs, "_weight", "_toxic", "_kept", "_first", "_second", "_fold", "_held", "_held_toxic")
    carry = docs.columns if carry is None else carry
    model = fit(docs, labels, key, text)
    weighed = _keyed(log_weights(with_folds(docs, labels, key), model, text, "_weight", "_fold"), key, seed)
    scored = durable(weighed.select(*carry, "_weight", "_toxic", "_first", "_second", "_held", "_held_toxic"))
    held, most_toxic = scored.agg(F.percentile("_held", F.lit(loss)), F.percentile("_held_toxic", F.lit(1 - TOXIC_LOSS))).first()
    scored = scored.drop("_held", "_held_toxic")
    if held is None:  # nothing is labelled as target: nothing can be told apart
        drawn = Draw(model, None, 0, None, seed)
    else:
        clean = scored.where(F.col("_toxic") <= most_toxic).select("_weight", "_first", "_second")
        k = clean.where(F.col("_weight") >= held).count()
        drawn = Draw(model, held, k, kth(clean.where("_weight IS NOT NULL"), "_first", "_second", k), seed, most_toxic)
    return _marked(scored, drawn), drawn


def _keyed(weighed: DataFrame, key: str, seed: int) -> DataFrame:
    first, second = ranks(F.col("_weight") + gumbel(seed, F.col(key)), F.col(key))
    return weighed.withColumns({"_first": first, "_second": second})


def _marked(scored: DataFrame, drawn: Draw) -> DataFrame:
    if drawn.bound is None:
        kept = F.lit(True) if drawn.threshold is None or drawn.k else F.lit(False)
    else:
        a, b = drawn.bound
        kept = (F.col("_first") > a) | ((F.col("_first") == a) & (F.col("_second") >= b))
    if drawn.most_toxic is not None:
        kept = kept & (F.col("_toxic") <= drawn.most_toxic)
    return scored.withColumn("_kept", F.col("_weight").isNotNull() & F.coalesce(kept, F.lit(False))).drop("_first", "_second", "_toxic")


def apply_draw(docs: DataFrame, drawn: Draw, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with _weight and _kept by a draw made before, perhaps from other rows; a map.  Special cases as in ``draw``."""
    reserved(docs, "_kept", "_first", "_second")
    return _marked(_keyed(log_weights(docs, drawn.model, text, "_weight"), key, drawn.seed), drawn)


def select_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that Gumbel top-k draws, with their columns as they are."""
    return draw(docs, labels, key, text, **options)[0].where("_kept").select(*docs.columns)


def op2_importance_resampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked, drawn = draw(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])
    return marked.select(
        "doc_id",
        F.round("_weight", 6).alias("log_weight"),
        F.lit(drawn.k).cast("long").alias("k"),
        F.col("_kept").alias("kept"),
    )
