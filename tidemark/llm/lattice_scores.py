"""Language-model scoring by the likelihood of subword lattices.

A word's lattice has an arc for each piece of an existing vocabulary that spells
a part of it, for the bytes of each of its characters, and, if the training text
has the word, for the word as a whole.  Arcs are weighted by unigram scores: the
pieces start from the vocabulary's own scores and learn from the words of the
training documents, the words from their counts.  A forward recursion in log space
sums over all segmentations, so a document's score is its marginal probability,
not that of one segmentation.  Whole words have a weight in each language of the
training documents besides that in all of them; a document's own language is not
looked at, but summed over too.

Words are counted with a distributed table, whose frequent part every worker has;
documents send on only their rare words, to be joined with the rest of the table.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, durable, read_columns, table, tidied, worker_table

#: Frequent words that every worker has, with their scores, about 10 MB.
FREQUENT = 50_000
#: Words of a task's running counts, before they are sent on.
RUNNING = 300_000
#: Additive smoothing of the base model.
SMOOTHING = 0.1
#: Rounds of expectation and maximisation, and how many pieces the vocabulary's own scores count for.
ROUNDS, PRIOR = 2, 1_000.0
#: Languages of their own, the largest; what a language leaves to all of them together.
LANGUAGES, SHARED = 8, 0.1
#: Remainders of crc32(key) that are divided by FOLDS: 0 is held out.
FOLDS = 10

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Stands for the blank before a word in the vocabulary.
START = "▁"
#: Words up to these widths, with the blank, are read many at a time; longer ones one by one.
WIDTHS, CHUNK = (6, 10, 16, 32, 64), 8_192


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.lower() changes A-Z alone, as asked for."""
    return _WORD.findall(text.lower()) if text else []


class Pieces:
    """Log probabilities of pieces and bytes, and what they say of words."""

    def __init__(self, scores: Mapping[str, float]):
        self.scores = dict(scores)
        self.bytes = [scores[f"<0x{b:02X}>"] for b in range(256)]
        # a text may hold the name of a byte, which is no piece there
        self.spelled = {p: s for p, s in scores.items() if not _BYTE.fullmatch(p)}
        self.longest = max(map(len, self.spelled), default=1)
        self._compile()

    def _compile(self) -> None:
        """The pieces as a trie: edges sorted by (node, character), and the piece that ends in a node, if any."""
        self.names = list(self.spelled)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, piece in enumerate(self.names):
            node = 0
            for ch in map(ord, piece):
                if (to := children[node].get(ch)) is None:
                    to = children[node][ch] = len(children)
                    children.append({})
                    ends.append(-1)
                node = to
            ends[node] = k
        edges = [(n << 21 | ch, to) for n, out in enumerate(children) for ch, to in out.items()]
        keys, targets = (np.array(x, np.int64) for x in zip(*edges))
        order = np.argsort(keys)
        self.edges, self.targets = keys[order], targets[order]
        self.ends, self.piece_scores = np.array(ends), np.array([self.spelled[p] for p in self.names])

    def arcs(self, word: bytes) -> tuple[int, list[tuple[int, int, str | None, float]]]:
        """How many characters the marked word has, and the arcs (from, to, piece or None for a character's bytes, score), in order of ``from``.

        What is no UTF-8 is read a byte at a time.  A mark inside the word is only bytes.
        """
        text = START + word.decode("utf-8", "surrogateescape")
        n, out = len(text), []
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = text[i:j]
                if (s := self.spelled.get(piece)) is not None and (i == 0) == (piece[0] == START):
                    out.append((i, j, piece, s))
            spelled = text[i].encode("utf-8", "surrogateescape")
            out.append((i, i + 1, None, sum(self.bytes[b] for b in spelled)))
        return n, out

    def forward(self, n: int, arcs: list[tuple[int, int, str | None, float]]) -> list[float]:
        """Log of the summed probability of all segmentations up to each place."""
        reached: list[list[float]] = [[] for _ in range(n + 1)]
        alpha = [0.0] * (n + 1)
        at = 0
        for i, j, _, s in arcs:
            while at < i:
                at += 1
                alpha[at] = log_sum(reached[at])
            reached[j].append(alpha[i] + s)
        alpha[n] = log_sum(reached[n])
        return alpha

    def log_probability(self, word: bytes) -> float:
        n, arcs = self.arcs(word)
        return self.forward(n, arcs)[n]

    def together(self, words: list[bytes]) -> Iterator[tuple[list[int], Lattices]]:
        """The lattices of all words that are not too long, many at a time, and the places of the words."""
        by_width: dict[int, list[int]] = defaultdict(list)
        for k, word in enumerate(words):
            # no more characters than bytes
            at = bisect_left(WIDTHS, 1 + len(word))
            if at < len(WIDTHS):
                by_width[WIDTHS[at]].append(k)
        for width, places in by_width.items():
            for a in range(0, len(places), CHUNK):
                some = places[a : a + CHUNK]
                yield some, Lattices(self, [words[k] for k in some], width)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        out = np.full(len(words), np.nan)
        for places, lattices in self.together(words):
            out[places] = lattices.total
        for k in np.flatnonzero(np.isnan(out)):
            out[k] = self.log_probability(words[k])
        return out

    def expected_in(self, words: list[bytes], into: dict[str, float]) -> None:
        """Adds how often each piece is expected in all the words."""
        known = np.zeros(len(words), bool)
        for places, lattices in self.together(words):
            known[places] = True
            lattices.expected(into)
        for k in np.flatnonzero(~known):
            self.expected(words[k], into)

    def expected(self, word: bytes, into: dict[str, float], times: float = 1.0) -> None:
        """Adds how often each piece is expected in the word: forward and backward recursion."""
        n, arcs = self.arcs(word)
        alpha = self.forward(n, arcs)
        beta, leaving = [0.0] * (n + 1), [[] for _ in range(n + 1)]
        at = n
        for i, j, piece, s in reversed(arcs):
            while at > i:
                if at < n:
                    beta[at] = log_sum(leaving[at])
                at -= 1
            leaving[i].append(s + beta[j])
        text = START + word.decode("utf-8", "surrogateescape")
        for i, j, piece, s in arcs:
            p = times * math.exp(alpha[i] + s + beta[j] - alpha[n])
            if piece is not None:
                into[piece] += p
            else:
                for b in text[i].encode("utf-8", "surrogateescape"):
                    into[f"<0x{b:02X}>"] += p


class Lattices:
    """The lattices of many words: ``forward``'s recursion as operations on a row for each word."""

    def __init__(self, pieces: Pieces, words: list[bytes], width: int):
        self.pieces, pad = pieces, "\U0010ffff"
        texts = [START + w.decode("utf-8", "surrogateescape") for w in words]
        self.sizes = np.array([len(t) for t in texts])
        raw = "".join(t.ljust(width, pad) for t in texts).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, np.uint32).astype(np.int64).reshape(len(words), width)
        self.characters, self.of = np.unique(codes, return_inverse=True)
        self.of = self.of.reshape(codes.shape)
        by_bytes = np.array([sum(pieces.bytes[b] for b in chr(c).encode("utf-8", "surrogateescape")) for c in self.characters.tolist()])[self.of]
        # a mark inside the word is only bytes
        codes = np.where((codes == ord(START)) & (np.arange(width) > 0), ord(pad), codes)
        self.alpha = np.full((len(words), width + 1), -np.inf)
        self.alpha[:, 0] = 0
        #: (from, to, rows, pieces or None for bytes, scores), in order of from
        self.steps: list[tuple] = []
        for i in range(int(self.sizes.max(initial=0))):
            rows = np.flatnonzero(self.sizes > i)
            self._step(i, i + 1, rows, None, by_bytes[rows, i])
            node = np.zeros(len(rows), np.int64)
            for j in range(i, min(width, i + pieces.longest)):
                key = node << 21 | codes[rows, j]
                at = np.minimum(np.searchsorted(pieces.edges, key), len(pieces.edges) - 1)
                ok = pieces.edges[at] == key
                rows, node = rows[ok], pieces.targets[at[ok]]
                if not len(rows):
                    break
                piece = pieces.ends[node]
                some = piece >= 0
                self._step(i, j + 1, rows[some], piece[some], pieces.piece_scores[piece[some]])
        self.total = self.alpha[np.arange(len(words)), self.sizes]

    def _step(self, i: int, j: int, rows: np.ndarray, piece: np.ndarray | None, scores: np.ndarray) -> None:
        if len(rows):
            self.steps.append((i, j, rows, piece, scores))
            self.alpha[rows, j] = np.logaddexp(self.alpha[rows, j], self.alpha[rows, i] + scores)

    def expected(self, into: dict[str, float]) -> None:
        beta = np.full_like(self.alpha, -np.inf)
        beta[np.arange(len(self.sizes)), self.sizes] = 0
        by_piece, by_character = np.zeros(len(self.pieces.names)), np.zeros(len(self.characters))
        for i, j, rows, piece, scores in reversed(self.steps):
            rest = scores + beta[rows, j]
            beta[rows, i] = np.logaddexp(beta[rows, i], rest)
            p = np.exp(self.alpha[rows, i] + rest - self.total[rows])
            if piece is None:
                by_character += np.bincount(self.of[rows, i], p, len(by_character))
            else:
                by_piece += np.bincount(piece, p, len(by_piece))
        for k in np.flatnonzero(by_piece).tolist():
            into[self.pieces.names[k]] += float(by_piece[k])
        for c, p in zip(self.characters.tolist(), by_character.tolist()):
            if p:
                for b in chr(c).encode("utf-8", "surrogateescape"):
                    into[f"<0x{b:02X}>"] += p


def log_sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def vocabulary(path: str) -> dict[str, float]:
    """Log probabilities of the pieces of a sentencepiece model, from its own scores.

    A vocabulary of merges scores a piece by minus its rank; by Zipf's law a rank
    stands for a probability in inverse proportion.  Scores of a unigram
    vocabulary are log probabilities already.  Control pieces are left out, and
    pieces with a blank after their start, which no word has.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or START in piece[1:]:
            continue
        found[piece] = model.get_score(i)
    ranks = min(found.values()) < -50
    found = {p: (-math.log(2 - s) if ranks else s) for p, s in found.items()}
    least = min(found.values())
    found = {f"<0x{b:02X}>": least for b in range(256)} | {p: least if _BYTE.fullmatch(p) else s for p, s in found.items()}
    return normal({p: math.exp(s) for p, s in found.items()})


def normal(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {p: math.log(w / total) for p, w in weights.items()}


def word_counts(docs: DataFrame, languages: int, running: int = RUNNING) -> DataFrame:
    """word (bytes) for every word of ``docs`` (held_out, language, text), c, its occurrences in documents that are not held out, and by, those in each language."""

    def run(batches: Iterable[pa.RecordBatch]):
        counts: dict[int, Counter[bytes]] = defaultdict(Counter)

        def sent():
            rows = [(w, at, n) for at, found in counts.items() for w, n in found.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int64()))], ["word", "language", "n"])

        for batch in batches:
            for held_out, at, text in zip(*(batch.column(c).to_pylist() for c in ("held_out", "language", "text"))):
                if held_out:
                    counts[-1].update(set(words_of(text)))
                else:
                    counts[at].update(words_of(text))
            if sum(map(len, counts.values())) > running:
                yield sent()
        if any(counts.values()):
            yield sent()

    rows = bounded_batches(docs).mapInArrow(tidied(run), "word binary, language int, n long")
    where = lambda i: F.sum(F.when(F.col("language") == i, F.col("n")).otherwise(0)).alias(f"c{i}")
    summed = rows.groupBy("word").agg(F.sum(F.when(F.col("language") >= 0, F.col("n")).otherwise(0)).alias("c"), *map(where, range(languages)))
    return summed.select("word", "c", F.array(*(f"c{i}" for i in range(languages))).cast("array<long>").alias("by"))


def learn_pieces(counts: DataFrame, start: dict[str, float], rounds: int = ROUNDS, prior: float = PRIOR) -> dict[str, float]:
    """Log probabilities of pieces after some rounds over all distinct training words.

    Each word counts once, since pieces stand for words that are rare or new; the
    start counts for ``prior`` pieces.  What goes to the driver has a row for each
    piece of the vocabulary at most.
    """
    spark, scores = counts.sparkSession, start
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(scores)

        def run(batches: Iterable[pa.RecordBatch], sent=sent):
            pieces, into, words = Pieces(sent.value), defaultdict(float), []
            for batch in batches:
                words += batch.column("word").to_pylist()
                if len(words) >= CHUNK:
                    pieces.expected_in(words, into)
                    words = []
            pieces.expected_in(words, into)
            if into:
                yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.float64())], ["piece", "n"])

        some = bounded_batches(counts.where("c > 0").select("word")).mapInArrow(tidied(run), "piece string, n double")
        expected = {r[0]: r[1] for r in some.groupBy("piece").agg(F.sum("n")).collect()}
        scores = normal({p: prior * math.exp(s) + expected.get(p, 0.0) for p, s in start.items()})
        sent.unpersist()
    return scores


class Model:
    """What a word's count and the lattice of its pieces say.

    The arc of a whole word weighs its count less a discount; what the discounts
    give up is shared out by the pieces.  Summed over all words and the end of a
    document this is 1.
    """

    def __init__(self, tokens: int, distinct: int, discount: float):
        self.tokens, self.distinct, self.discount = tokens, distinct, discount
        self.under = tokens + SMOOTHING * (distinct + 1)

    def base(self, c: int) -> float:
        """log10 by additive smoothing."""
        return math.log10((c + SMOOTHING) / self.under)

    def lattice(self, c: int, spelled: float | None) -> float:
        """Log of the summed paths; ``spelled`` is the log probability by pieces, None for the end of a document, which has none.

        Without training tokens an end and a word are as likely.
        """
        if not self.tokens:
            return math.log(0.5) + (spelled or 0.0)
        arcs = [math.log((c - self.discount) / self.tokens)] if c else []
        if spelled is not None:
            arcs.append(math.log(self.discount * self.distinct / self.tokens) + spelled)
        return log_sum(arcs) if arcs else math.log(0.5 / (self.tokens + 1))

    def lattices(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """``lattice`` of many words."""
        if not self.tokens:
            return math.log(0.5) + spelled
        whole = np.where(c > 0, np.log(np.maximum(c - self.discount, 1e-300) / self.tokens), -np.inf)
        return np.logaddexp(whole, math.log(self.discount * self.distinct / self.tokens) + spelled)


class Models:
    """The model of all training documents, and one of each language, which leaves a part to the former."""

    def __init__(self, whole: Model, languages: list[Model]):
        self.whole, self.languages = whole, languages

    def scores(self, c: int, by: list[int], spelled: float | None) -> list[float]:
        """log10 probability of a word in each language."""
        shared = math.log(SHARED) + self.whole.lattice(c, spelled)
        own = (math.log(1 - SHARED) + m.lattice(n, spelled) for m, n in zip(self.languages, by))
        return [log_sum([shared, x]) / math.log(10) for x in own]

    def scores_of(self, c: np.ndarray, by: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """``scores`` of many words, a row for each."""
        shared = math.log(SHARED) + self.whole.lattices(c, spelled)
        own = [math.log(1 - SHARED) + m.lattices(by[:, i], spelled) for i, m in enumerate(self.languages)]
        return np.stack([np.logaddexp(shared, x) for x in own], axis=1) / math.log(10)


def discount_of(once: int, twice: int) -> float:
    """Absolute discount from how many words occur once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


def fitted(counts: DataFrame, ends: list[int]) -> Models:
    """``ends`` are the training documents of each language."""

    def stats(c):
        return F.struct(F.coalesce(F.sum(c), F.lit(0)).alias("n"), F.count_if(c > 0).alias("v"), F.count_if(c == 1).alias("once"), F.count_if(c == 2).alias("twice"))

    found = counts.agg(stats(F.col("c")), *(stats(F.get("by", F.lit(i))) for i in range(len(ends)))).first()
    whole, *own = (Model(s["n"] + e, s["v"] + (e > 0), discount_of(s["once"], s["twice"])) for s, e in zip(found, [sum(ends), *ends]))
    return Models(whole, own)


def score_documents(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", lang: str | None = "lang", frequent: int = FREQUENT, running: int = RUNNING
) -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; logarithms are to the base 10.

    A null text counts as empty and has its end as the only token; a null key
    counts as '' where it is hashed, a null language as one of its own.  Repeated
    rows are each counted and scored; an empty table gives no rows; other columns
    are not read.  Without training documents every count is 0.  Texts are read
    whole, words of any length.

    ``path`` is a sentencepiece model, of which pieces and scores are taken.  The
    table of words is as large as the corpus makes it and stays distributed; every
    worker has its ``frequent`` most frequent words, and the scores of pieces.
    ``lang`` (None for none) tells training documents apart; beyond LANGUAGES the
    smaller ones are one.
    """
    spark = docs.sparkSession
    held_out = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0
    spoken = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang else F.lit("")
    narrow = docs.select(F.col(key).alias("id"), held_out.alias("held_out"), spoken.alias("lang"), F.col(text).cast("binary").alias("text"))
    sizes = narrow.where(~F.col("held_out")).groupBy("lang").agg(F.count("*").alias("n"))
    large = [(r["lang"], r["n"]) for r in sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES - 1).collect()]
    rest = (sizes.agg(F.sum("n")).first()[0] or 0) - sum(n for _, n in large)
    ends = [n for _, n in large] + [rest] * (rest > 0 or not large)
    language = F.coalesce(*(F.when(F.col("lang") == name, i) for i, (name, _) in enumerate(large)), F.lit(len(ends) - 1))
    counts = durable(word_counts(narrow.select("held_out", language.alias("language"), "text"), len(ends), running))
    models = fitted(counts, ends)
    pieces = learn_pieces(counts, vocabulary(path))
    known = durable(scored_words(counts, models, pieces))
    first = most_frequent(known, frequent).collect()
    place = {bytes(r["word"]): i for i, r in enumerate(first)}
    sent = spark.sparkContext.broadcast((place, np.array([(r["c"] > 0, r["base"], *r["scores"]) for r in first], float).reshape(len(first), 2 + len(ends))))
    whole = models.whole
    at_end = np.array([sum(ends) > 0, whole.base(sum(ends)), *models.scores(sum(ends), ends, None)])
    cache = uuid.uuid4().hex

    def read(texts: list[bytes | None]):
        place, values = worker_table(f"scores of words {cache}", lambda: sent.value)
        columns: tuple[list, ...] = ([], [], [], [], [], [])
        for text in texts:
            tokens = words_of(text)
            times = Counter(tokens)
            rare = [w for w in times if w not in place]
            rare_times = [times.pop(w) for w in rare]
            sums = at_end + np.fromiter(times.values(), float, len(times)) @ values[[place[w] for w in times]]
            for column, value in zip(columns, (len(tokens) + 1, round(sums[0]), sums[1], sums[2:].tolist(), rare, rare_times)):
                column.append(value)
        return columns

    fields = {"n_tokens": "long", "n_known": "long", "base_score": "double", "scores": "array<double>", "rare": "array<binary>", "times": "array<long>"}
    parts = read_columns(narrow, "text", fields, read, ["id", "held_out"])
    parts = durable(parts.withColumn("row", F.monotonically_increasing_id()))
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("k"))
    k = F.col("k")
    more = rare.join(known, "word").groupBy("row")
    more = more.agg(F.sum(F.when(F.col("c") > 0, k).otherwise(0)).alias("more_known"), F.sum(k * F.col("base")).alias("more_base"), *(F.sum(k * F.get("scores", F.lit(i))).alias(f"more{i}") for i in range(len(ends))))
    out = parts.drop("rare", "times").join(more, "row", "left")
    added = lambda c, extra: c + F.coalesce(F.col(extra), F.lit(0))
    prior = [math.log10((n + 1) / (sum(ends) + len(ends))) for n in ends]
    paths = F.array(*(added(F.get("scores", F.lit(i)), f"more{i}") + p for i, p in enumerate(prior)))
    top = F.array_max("paths")
    spread = F.aggregate("paths", F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x - top))
    return out.withColumn("paths", paths).select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        added(F.col("n_known"), "more_known").alias("n_known"),
        F.lit(whole.tokens).cast("long").alias("train_tokens"),
        added(F.col("base_score"), "more_base").alias("base_score"),
        (top + F.log10(spread)).alias("score"),
    )


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, ``most`` at most and all of equal counts or none.

    Counts are put into steps of a hundredth of their size, and a step's words are
    all taken or none, so that only a short table of steps and then the words
    themselves go to the driver, not every task's own highest.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    sizes = sorted(((r[0], r[1]) for r in words.where("c > 0").groupBy(step).count().collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > most:
            break
        least = at
    return words.where(F.lit(False) if least is None else (F.col("c") > 0) & (step >= least))


def scored_words(counts: DataFrame, models: Models, scores: Mapping[str, float]) -> DataFrame:
    """word, c, and its scores by the base model and by the lattice in each language, worked out once for each word."""
    sent = counts.sparkSession.sparkContext.broadcast((models, scores))

    def run(batches: Iterable[pa.RecordBatch]):
        models, pieces = sent.value[0], Pieces(sent.value[1])
        for batch in batches:
            c = batch.column("c").to_numpy()
            by = batch.column("by").flatten().to_numpy().reshape(len(c), -1)
            base = pa.array(np.log10((c + SMOOTHING) / models.whole.under))
            spelled = pieces.log_probabilities(batch.column("word").to_pylist())
            found = pa.FixedSizeListArray.from_arrays(pa.array(models.scores_of(c, by, spelled).ravel()), by.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), base, found], ["word", "c", "base", "scores"])

    return bounded_batches(counts).mapInArrow(tidied(run), "word binary, c long, base double, scores array<double>")


def op13_subword_lattice(spark, sf_dir):
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), public_tokenizers.path("piece_bpe_32k.model"))
