"""Folding, tokens, and ordered keyword rules."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold to plain ones; folding comes before lower(), as lower('İ') is two characters.
FOLD_FROM, FOLD_TO = "ıİşŞğĞçÇöÖüÜâÂîÎûÛ", "iIsSgGcCoOuUaAiIuU"


def fold(x: Column, collapse: bool = True) -> Column:
    """Letters folded and lower-cased; white space runs become one blank if ``collapse``."""
    out = F.lower(F.translate(x, FOLD_FROM, FOLD_TO))
    return F.trim(F.regexp_replace(out, "\\s+", " ")) if collapse else out


def fold_marks(x: Column) -> Column:
    """Folds all combining marks too, through full Unicode decomposition, for letters beyond FOLD_FROM."""
    @F.pandas_udf("string")
    def strip(values: pd.Series) -> pd.Series:
        plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.casefold().replace("ı", "i")) if not unicodedata.combining(c))
        return values.map(lambda s: None if s is None else plain(s))

    return strip(x)


def tokens(folded: Column, least: int = 4, stop: Sequence[str] = (), digits: bool = True) -> Column:
    """Distinct tokens of ``least`` characters or more, without stop words, and without all-digit ones unless ``digits``."""
    found = F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0))
    keep = F.filter(found, lambda t: F.length(t) >= least)
    if stop:
        keep = F.filter(keep, lambda t: ~t.isin(*stop))
    if not digits:
        keep = F.filter(keep, lambda t: ~t.rlike("^[0-9]+$"))
    return F.array_distinct(keep)


def jaccard(a: Column, b: Column) -> Column:
    """0 if either side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def mentions(folded: Column, surface: str) -> Column:
    """Word-bounded for alphanumeric surfaces, plain substring otherwise."""
    if re.fullmatch(r"[a-z0-9]+", surface):
        return folded.rlike(f"(?<![a-z0-9]){surface}(?![a-z0-9])")
    return folded.contains(surface)


def first_term(folded: Column, terms: Sequence[str]) -> Column:
    """The first listed term that the text contains."""
    return F.coalesce(*[F.when(folded.contains(t), F.lit(t)) for t in terms]) if terms else F.lit(None).cast("string")


def first_category(folded: Column, rules: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """The first category, in order, one of whose terms the text contains."""
    return F.coalesce(*[F.when(first_term(folded, terms).isNotNull(), F.lit(c)) for c, terms in rules.items()], F.lit(default))


def relevance_rule(folded: Column, hard: Sequence[str], strong: Sequence[str], soft: Sequence[str], keywords: Sequence[str]) -> Column:
    """Why a title is excluded, null if it is relevant: hard block list, then strong override, soft block list, and keywords."""
    has = lambda terms: first_term(folded, terms).isNotNull()
    return F.when(has(hard), "hard_blocklist").when(has(strong), None).when(has(soft), "soft_blocklist").when(has(keywords), None).otherwise("no_keyword")


def market_recap(folded: Column, terms: Sequence[str], frames: Sequence[str], exempt: Sequence[str]) -> Column:
    """struct(is_recap, rule, confidence): 0.9 for a term, 0.7 for a frame, and none if exempt."""
    term, frame = first_term(folded, terms), F.coalesce(*[F.when(folded.rlike(p), F.lit(p)) for p in frames]) if frames else F.lit(None).cast("string")
    is_exempt = first_term(folded, exempt).isNotNull()
    rule = F.when(is_exempt, "exempt").when(term.isNotNull(), F.concat(F.lit("term:"), term)).when(frame.isNotNull(), "frame").otherwise("none")
    confidence = F.when(is_exempt, 0.0).when(term.isNotNull(), 0.9).when(frame.isNotNull(), 0.7).otherwise(0.0)
    return F.struct((confidence > 0).alias("is_recap"), rule.alias("rule"), confidence.alias("confidence"))


def family(
    folded: Column, category: Column, recap: Column, direct: Mapping[str, str], narrative: Sequence[str], banks: Sequence[str], company_category: str, company_terms: Sequence[str]
) -> Column:
    """struct(family, rule, evidence, ambiguous): recap, then narrative, banks, companies, the category's family, other."""
    n, b, c = first_term(folded, narrative), first_term(folded, banks), first_term(folded, company_terms)
    company = category == company_category
    mapped = F.coalesce(*[F.when(category == k, F.lit(v)) for k, v in direct.items()]) if direct else F.lit(None).cast("string")
    name = (
        F.when(recap, "market_recap").when(n.isNotNull(), "market_narrative").when(company & b.isNotNull(), "banks")
        .when(company & c.isNotNull(), "companies").when(mapped.isNotNull(), mapped).otherwise("other")
    )
    rule = F.when(recap, "recap").when(n.isNotNull(), "narrative").when(company & b.isNotNull(), "bank_term").when(company & c.isNotNull(), "company_term").when(mapped.isNotNull(), "category").otherwise("fallback")
    evidence = F.when(recap, None).otherwise(F.coalesce(n, F.when(company, b), F.when(company, c), category))
    ambiguous = ~recap & ((n.isNotNull().cast("int") + (company & b.isNotNull()).cast("int") + (company & c.isNotNull()).cast("int")) > 1)
    return F.struct(name.alias("family"), rule.alias("rule"), evidence.alias("evidence"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


#: Which kind of entity is the primary one.
ENTITY_RANK = {"issuer": 0, "institution": 1, "agency": 1, "macro": 2, "instrument": 3}


def entities(folded: Column, dictionary: Sequence[tuple[str, str, Sequence[str]]]) -> Column:
    """Sorted array of struct(rank, entity_type, entity_id) for (type, id, surfaces) that the text mentions; the first is the primary."""
    found = []
    for kind, name, surfaces in dictionary:
        hit = F.lit(False)
        for s in surfaces:
            hit = hit | mentions(folded, s)
        found.append(F.when(hit, F.struct(F.lit(ENTITY_RANK.get(kind, 4)).alias("rank"), F.lit(kind).alias("entity_type"), F.lit(name).alias("entity_id"))))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def event_type(folded: Column, markers: Mapping[str, Sequence[str]]) -> Column:
    return first_category(folded, markers, "other")
