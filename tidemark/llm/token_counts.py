"""Exact token counts by a two-tier lookup of pre-token lengths.

Tier one is a compact table of the corpus's frequent pre-tokens and their token
counts, broadcast to all workers; tier two is each worker's cache of the others,
filled by encoding a pre-token when it is first met.  Pre-tokens are never
shuffled: the table comes from a sample of bounded size, whose lists of heavy
hitters go straight to the driver.  All texts are counted whole and exactly,
whatever the table holds; it changes the speed alone.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_automaton import byte_symbols
from tidemark.llm.common import bounded_batches, reserved, table, tidied, tidy, utf8_length, worker_table

#: Pre-tokens in the broadcast table, about 5 MB.
TABLE_SIZE = 50_000
#: The table is made from a random sample of about so many bytes of text, counted by so many tasks, each of which gives up its most frequent pre-tokens.
SAMPLE_BYTES, SAMPLE_TASKS, HEADS_PER_TASK = 32_000_000, 16, 10_000
#: Entries of a task's running counts, and of a worker's cache, before they are pruned or emptied.
RUNNING, CACHED = 200_000, 300_000

#: The split pattern of byte-level BPE, with [^\W\d_] and \d for its classes of letters and digits.
#: It gives the same pieces only for characters that _SPECIAL does not find.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SPECIAL = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")


class PreTokens:
    """Splits a text as the tokenizer does before its merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.symbols = dict(enumerate(byte_symbols()))
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many added tokens the text spells out."""
        if self.added is None or not self.added.search(text):
            return self._pieces(text), 0
        parts = self.added.split(text)
        return [p for x in parts for p in self._pieces(x)], len(parts) - 1

    def _pieces(self, text: str) -> list[str]:
        if not _SPECIAL.search(text):
            return _FAST.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def lengths(self, pieces: list[str]) -> list[int]:
        """The model alone, without the work that the library does around it for a whole text."""
        merge = self.tokenizer.model.tokenize
        return [len(merge(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.symbols))) for p in pieces]


class Lengths:
    """Both tiers in a worker: the broadcast table, and what it has encoded besides; emptied to the former when full."""

    def __init__(self, frequent: Mapping[str, int], pieces: PreTokens):
        self.frequent, self.pieces, self.known = frequent, pieces, dict(frequent)

    def counts(self, lists: list[list[str]]) -> list[int]:
        missing = list(set().union(*lists).difference(self.known))
        if len(self.known) + len(missing) > len(self.frequent) + CACHED:
            self.known = dict(self.frequent)
            missing = list(set().union(*lists).difference(self.known))
        self.known.update(zip(missing, self.pieces.lengths(missing)))
        length = self.known.__getitem__
        return [sum(map(length, x)) for x in lists]


def heads(counts: Counter, most: int) -> Counter:
    return Counter(dict(counts.most_common(most)))


def frequent_pretokens(docs: DataFrame, path: str, text: str = "text", most: int = TABLE_SIZE, sample_bytes: int = SAMPLE_BYTES) -> Counter:
    """The heavy hitters among the pre-tokens of a sample of about ``sample_bytes``, and how often each occurs there.

    What the sample lacks costs a worker one encoding, never a wrong count.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    some = docs.select(text)
    if total > sample_bytes:
        some = some.sample(sample_bytes / total, seed=7)

    def count(batches: Iterable[pd.DataFrame]):
        pieces, counts = worker_table(f"pre-tokens {path}", lambda: PreTokens(path)), Counter()
        for batch in batches:
            for x in batch[text]:
                if x:
                    counts.update(pieces.split(x)[0])
                    if len(counts) > RUNNING:
                        counts = heads(counts, RUNNING // 4)
        top = counts.most_common(HEADS_PER_TASK)
        if top:
            yield pd.DataFrame({"piece": [p for p, _ in top], "n": [n for _, n in top]})

    out = Counter()
    for r in bounded_batches(some).coalesce(SAMPLE_TASKS).mapInPandas(tidied(count), "piece string, n long").collect():
        out[r["piece"]] += r["n"]
    return heads(out, most)


def length_table(docs: DataFrame, path: str, text: str = "text", most: int = TABLE_SIZE) -> dict[str, int]:
    """The broadcast tier: at most ``most`` pre-tokens with their token counts."""
    pieces = PreTokens(path)
    found = list(frequent_pretokens(docs, path, text, most))
    return dict(zip(found, pieces.lengths(found)))


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens", frequent: Mapping[str, int] | None = None
) -> DataFrame:
    """``docs`` with the token count of every whole text in a new column.

    ``frequent`` may be a table made before, for a corpus like this one; it
    changes the speed alone.  Null and empty texts have 0 tokens; special strings
    inside a text count as the library counts them; repeated rows are each
    counted; an empty table gives no rows.  Other columns pass through; ``name``
    must not be one of them.
    """
    reserved(docs, name)
    sent = docs.sparkSession.sparkContext.broadcast(length_table(docs, path, text) if frequent is None else dict(frequent))
    key = uuid.uuid4().hex

    def count(texts: pd.Series) -> pd.Series:
        lengths = worker_table(f"lengths {path} {key}", lambda: Lengths(sent.value, PreTokens(path)))
        pieces, n, values = lengths.pieces, [], texts.tolist()
        for k in range(0, len(values), 256):
            split = [pieces.split(x) if x else ([], 0) for x in values[k : k + 256]]
            n += [a + b for a, (_, b) in zip(lengths.counts([found for found, _ in split]), split)]
        tidy()
        return pd.Series(n, dtype="int64")

    return bounded_batches(docs).withColumn(name, F.pandas_udf(count, "long").asNondeterministic()(F.col(text)))


def op3_two_tier_counts(spark, sf_dir, limit=512):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_bytes", utf8_length("text"))
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
