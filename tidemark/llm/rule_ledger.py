"""Quality rules with a bitmask ledger.

Every rule is evaluated once for each text; the ledger keeps the measurements
and one bit for each rule that fails.  A policy is a versioned mask of rules
that reject, so changing policy re-reads the narrow ledger, never the texts, and
what each rule adds to a policy comes from bitwise aggregation.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, read_columns, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER, _LOWER, _BEYOND = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}"), re.compile(r"[^\x00-\x7F]+")
_LINE_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` holds of the measurements; ``bit`` never changes once given."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * word_chars"),
    Rule(3, "duplicate_lines", "n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "capitals", "100 * n_upper > 60 * n_letters"),
    Rule(5, "shouting", "100 * n_shouts > 30 * n_words"),
    Rule(6, "word_length", "word_chars > 30 * n_words OR word_chars < 2 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Iterable[Rule] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in self.rules)


BASE_RULES = ("too_few_words", "repeated_trigrams")
POLICIES = (
    Policy("base", BASE_RULES),
    Policy("v1", (*BASE_RULES, "symbols", "duplicate_lines")),
    Policy("v2", tuple(r.name for r in RULES)),
)


def cases(text: str) -> tuple[int, int]:
    """How many characters are of the classes Lu and Ll; ASCII is counted by deleting it from the bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    upper, lower = (len(raw) - len(raw.translate(None, x.encode())) for x in (string.ascii_uppercase, string.ascii_lowercase))
    beyond = "".join(_BEYOND.findall(text)) if len(raw) > len(text) else ""
    return upper + len(_UPPER.findall(beyond)), lower + len(_LOWER.findall(beyond))


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; a null text has none of anything."""
    if not text:
        return (0,) * len(MEASURES)
    words = _WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        upto = 0  # words before this place are counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    seen: set[str] = set()
    n_lines = n_dup = 0
    for line in text.split("\n"):
        if _LINE_HAS_WORD.search(line):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    n_upper, n_lower = cases(text)
    return (
        len(words),
        sum(map(len, words)),
        len(_SYMBOL.findall(text)),
        n_dup,
        repeated,
        n_lines,
        n_upper,
        n_upper + n_lower,
        sum(w[-1] == "!" for w in words),
    )


def failure_bits(rules: Iterable[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """key, the MEASURES and fail_bits of every row; a map, nothing is shuffled.

    Null and empty texts measure 0 and fail too_few_words; repeated rows have an
    entry each; an empty table gives no rows; other columns are not carried.  A
    null key stays null and the others as they are, whatever their size.
    """
    if key in (*MEASURES, "fail_bits"):
        raise ValueError(f"{key} is the name of a measure, not of a key")
    read = lambda texts: tuple(zip(*map(measure, texts))) if texts else ((),) * len(MEASURES)
    return read_columns(docs, text, dict.fromkeys(MEASURES, "long"), read, [key]).withColumn("fail_bits", failure_bits(rules))


def apply_policies(entries: DataFrame, policies: Iterable[Policy] = POLICIES, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The ledger with a boolean kept_<version> for each policy."""
    names = {p.version: free_name(entries, f"kept_{p.version}") for p in policies}
    return entries.withColumns({names[p.version]: F.col("fail_bits").bitwiseAND(F.lit(p.mask(rules))) == 0 for p in policies})


def ablations(entries: DataFrame, policies: Iterable[Policy] = POLICIES, rules: Iterable[Rule] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents that fail it, that fail it alone (and would return without it), and that the policy rejects.

    The ledger is first counted by fail_bits, at most 2 ** rules rows, and all
    policies work on these counts.
    """
    spark = entries.sparkSession
    counts = entries.groupBy("fail_bits").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    rows = [(p.version, r.name, p.mask(rules), 1 << r.bit) for p in policies for r in rules if r.name in p.rules]
    grid = spark.createDataFrame(rows, "policy string, rule string, mask long, bit long")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        counts.join(F.broadcast(grid), failed != 0)
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("n_rejected"),
            F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(failed == F.col("bit"), F.col("words")).otherwise(0)).alias("words_only_this"),
        )
    )


def op7_rule_ledger(spark, sf_dir, policy="v2"):
    entries = apply_policies(ledger(table(spark, sf_dir, "documents")))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~F.col("kept_base")).alias("base_failed"),
        F.col(f"kept_{policy}").alias("kept"),
        "fail_bits",
    )


OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), lines AS (
  SELECT r, l, row_number() OVER (PARTITION BY r, l) AS k
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) x
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')
), per_lines AS (SELECT r, count(*) AS n_lines, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n_dup FROM lines GROUP BY r),
grams AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3) x) y
), per_grams AS (
  SELECT r, count(DISTINCT q) AS n_repeat FROM (SELECT r, unnest(range(p, p + 3)) AS q FROM grams WHERE n > 1) x GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\\p{Lu}\\p{Ll}]', '', 'g')) AS n_letters,
         len(list_filter(w, lambda x: x[-1] = '!')) AS n_shouts
  FROM d LEFT JOIN per_lines USING (r) LEFT JOIN per_grams USING (r)
), bits AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END
         + CASE WHEN n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
         + CASE WHEN 100 * n_upper > 60 * n_letters THEN 16 ELSE 0 END + CASE WHEN 100 * n_shouts > 30 * n_words THEN 32 ELSE 0 END
         + CASE WHEN word_chars > 30 * n_words OR word_chars < 2 * n_words THEN 64 ELSE 0 END AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, fail_bits = 0 AS kept, CAST(fail_bits AS BIGINT) AS fail_bits
FROM bits
"""
