"""Scalar functions on signals, prices and identities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores beyond these are positive or negative.
POSITIVE, NEGATIVE = 0.05, -0.05
#: Formats of publication times, with whether they have a time of day.
DATETIME_FORMATS = (
    ("EEE, dd MMM yyyy HH:mm:ss", True),
    ("dd MMM yyyy HH:mm:ss", True),
    ("yyyy-MM-dd'T'HH:mm:ss", True),
    ("yyyy-MM-dd HH:mm:ss", True),
    ("yyyy-MM-dd HH:mm", True),
    ("dd.MM.yyyy HH:mm:ss", True),
    ("dd.MM.yyyy HH:mm", True),
    ("dd.MM.yyyy", False),
    ("yyyy-MM-dd", False),
)
#: Credibility by source tier.
TIER_CREDIBILITY = {"A": 1.0, "B": 0.75, "C": 0.5}
#: How restrictive a timing bucket is, most first.
BUCKETS = ("during_session", "unknown", "weekend_or_holiday", "post_close", "pre_open")


def finite(x: Column) -> Column:
    """NaN and infinities are missing."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def label_of(score: Column) -> Column:
    return F.when(score > POSITIVE, "positive").when(score < NEGATIVE, "negative").when(score.isNotNull(), "neutral")


def legacy_time_weight(hour: Column) -> Column:
    """1.5 before 10, 1.0 until 18 and for missing or impossible hours, 0.8 later."""
    h = hour.try_cast("int")
    return F.when(h.isNull() | (h < 0) | (h > 23), 1.0).when(h < 10, 1.5).when(h <= 18, 1.0).otherwise(0.8)


def percent_return(entry: Column, exit_: Column) -> Column:
    return F.when((entry != 0) & (exit_ != 0), (exit_ / entry - 1) * 100)


def tone_word(score: Column) -> Column:
    return (
        F.when(score.isNull(), None)
        .when(score >= 0.15, "clearly positive")
        .when(score > POSITIVE, "slightly positive")
        .when(score <= -0.15, "clearly negative")
        .when(score < NEGATIVE, "slightly negative")
        .otherwise("neutral")
    )


def restrictiveness(bucket: Column) -> Column:
    """0 for the most restrictive bucket; unknown names count as unknown."""
    out = F.lit(BUCKETS.index("unknown"))
    for rank, name in enumerate(BUCKETS):
        out = F.when(bucket == name, rank).otherwise(out)
    return out


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """A small literal table; larger ones are joined."""
    if not table:
        return F.lit(default)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def source_credibility(source: Column, tiers: Mapping[str, str], default_tier: str = "C") -> tuple[Column, Column]:
    tier = lookup(source, tiers, default_tier)
    return tier, lookup(tier, TIER_CREDIBILITY, TIER_CREDIBILITY[default_tier])


def parse_published(text: Column, formats: Sequence[tuple[str, bool]] = DATETIME_FORMATS, zone: str = "Europe/Istanbul") -> tuple[Column, Column]:
    """(local wall time, has a time of day); unparsable text gives nulls.

    Text with an offset or Z is moved to ``zone``; text without is local already.
    """
    clean = F.trim(F.regexp_replace(text, "\\s+", " "))
    offset = clean.rlike("(Z|GMT|UTC|[+-]\\d{2}:?\\d{2})$") & clean.rlike("\\d{1,2}:\\d{2}")
    bare = F.trim(F.regexp_replace(clean, "\\s*(Z|GMT|UTC|[+-]\\d{2}:?\\d{2})$", ""))
    bare = F.when(offset, bare).otherwise(clean)
    bare = F.regexp_replace(bare, "^[A-Za-z]{3}, ", "")
    parsed = [(F.try_to_timestamp(bare, F.lit(f.replace("EEE, ", ""))).cast("timestamp_ntz"), t) for f, t in formats]
    wall = F.coalesce(*[p for p, _ in parsed])
    has_time = F.coalesce(*[F.when(p.isNotNull(), F.lit(t)) for p, t in parsed])
    shift = F.regexp_extract(clean, "([+-]\\d{2}):?(\\d{2})$", 1)
    minutes = F.when(shift != "", shift.cast("int") * 60 + F.signum(shift.cast("int")) * F.regexp_extract(clean, "([+-]\\d{2}):?(\\d{2})$", 2).cast("int")).otherwise(0)
    utc = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(wall.cast("string"))) - minutes * 60)
    local = F.from_utc_timestamp(utc, zone).cast("timestamp_ntz")
    return F.when(offset, local).otherwise(wall), F.coalesce(has_time, F.lit(False))


def observation_key(source: Column, guid: Column, url: Column, title: Column, published: Column) -> Column:
    """A stable identity: guid, else URL, else title and dates; the fetch time is never part of it."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    kind = F.when(blank(guid).isNotNull(), "guid").when(blank(url).isNotNull(), "url").otherwise("title")
    value = F.coalesce(blank(guid), blank(url), F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(published.cast("string"), F.lit(""))))
    return F.sha2(F.to_json(F.array(F.coalesce(source, F.lit("")), kind, value)), 256)


def score_tuple(label: Column, strength: Column) -> Column:
    """Components from a label and a strength: the strength is clamped to [0, 1], signed labels have 0.06 at least, components sum to 1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(finite(strength), F.lit(0.0))))
    signed = F.greatest(s, F.lit(0.06))
    score = F.when(label == "positive", signed).when(label == "negative", -signed).when(label == "neutral", F.lit(0.0))
    pos = F.when(score > 0, score).otherwise(0.0)
    neg = F.when(score < 0, -score).otherwise(0.0)
    return F.when(score.isNotNull(), F.struct(score.alias("score"), label.alias("label"), pos.alias("p_positive"), (1 - pos - neg).alias("p_neutral"), neg.alias("p_negative")))


def score_from_components(p_positive: Column, p_negative: Column) -> Column:
    score = finite(p_positive) - finite(p_negative)
    return F.struct(score.alias("score"), label_of(score).alias("label"))


def component_kind(model: Column) -> Column:
    """What the components of a row are, by the name of its scorer; anything not known is legacy."""
    m = F.lower(F.coalesce(model, F.lit("")))
    made_up = m.startswith("gpt-") | m.startswith("openai:")
    return F.when(made_up, "synthetic_compatibility").when(m.contains("xlm") | m.contains("roberta"), "softmax_probability").otherwise("legacy_unknown")


def strip_cdata(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1")


def disclosure_title(company: Column, summary: Column, subject: Column, most: int = 300) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    body = F.coalesce(blank(summary), blank(subject), F.lit("disclosure"))
    return F.substring(F.concat_ws(": ", blank(company), body), 1, most)


def sorted_list(values: Column, by: str = ",") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(values))), by)


def listed(text: Column, by: str = ",") -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), by), lambda x: x != "")


def safe_corr(a, b, over=None) -> Column:
    """Pearson's r over rows where both are known; NULL, not an error, where one of them is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = [p.over(over) for p in parts] if over is not None else parts
    return cov / F.nullif(sx * sy, F.lit(0.0))
