"""Search, source audit and language-model scores against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lattice_scores, lexical_search, source_audit

BIG = 2**53
DOCS = "doc_id long, text string, lang string, source string, score int, term string, segment int, c int"


def corpus(seed=3, n=90):
    """Ties, copies, nulls, an empty and a long text, upper case, digits, characters beyond ASCII."""
    r = random.Random(seed)
    words = [a + b for a in "ba ce di ñó".split() for b in "ra li NO 2x".split()]
    text = lambda k: " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(k))
    rows = [(i, text(r.randint(1, 30)), r.choice(["en", "fr"]), f"s{r.randint(0, 3)}") for i in range(n)]
    rows += [(BIG + 1, "bara celi bara", "en", "s0"), (BIG + 3, "bara celi bara", "en", "s0"), (None, "bara celi bara", None, None)]
    rows += [(n + 1, None, "en", "s9"), (n + 2, "", "xx", "s0"), (n + 3, "7 8 ...", "xx", "s1"), rows[0], (n + 4, "diNO\tdira\n" * 3000, "fr", "s1")]
    return [(*x, 1, "t", 2, 3) for x in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 11


def brute_search(rows, items, k):
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(x[1])) for x in rows]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for x in terms for t in set(x))
    out = []
    for item, text in dict.fromkeys(items):
        asked = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        found = []
        for row, x in zip(rows, terms):
            m = 10 + 90 * len(x) * n // total if x else 0
            tf = Counter(x)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked & set(x))
            if score > 0:
                found.append((-score, row[0] is None, row[0] or 0, row[0]))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


ITEMS = [(1, "bara celi"), (2, "ñóli ÑÓLI ba2x DINO"), (3, None), (4, ""), (5, "nothing here"), (1, "bara celi"), (None, "cera dili ce2x"), (7, "ñóra " * 3000)]


@pytest.mark.parametrize("postings,short,step", [(10**6, 64, 64), (150, 4, 2), (1, 1, 1)])
def test_search_by_brute_force(spark, docs, rows, monkeypatch, postings, short, step):
    monkeypatch.setattr(lexical_search, "SHORT", short)
    monkeypatch.setattr(lexical_search, "STEP", step)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    index = lexical_search.build_index(docs, postings=postings)
    for blocks in (10**6, 40):
        got = [tuple(r) for r in lexical_search.search(index, items, max_bytes=blocks).collect()]
        by = lambda x: (x[0] is None, x[0] or 0, x[1])
        assert sorted(got, key=by) == sorted(brute_search(rows, ITEMS, 10), key=by)


def test_search_of_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert lexical_search.search(lexical_search.build_index(none), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).count() == 0


def test_treaps_are_heaps_in_the_order_of_documents():
    r = random.Random(5)
    key = [r.randint(0, 9) * 10**6 + r.randint(0, 10**6) for _ in range(300)]
    ends = [0, 1, 120, 120, 300]
    left, right, roots = lexical_search.treap_links(ends, key)

    def order(i):
        return [] if i == len(key) else [*order(left[i]), i, *order(right[i])]

    for begin, end, root in zip([0, *ends], ends, roots):
        assert order(root) == list(range(begin, end))
    assert all(key[i] >= key[c] for i in range(300) for c in (left[i], right[i]) if c < 300)


def test_pruning_scores_few_documents_and_loses_none():
    r = np.random.default_rng(1)
    n = 20_000
    terms, docs = ["rare", "common", "middle"], [np.sort(r.choice(n, k, replace=False)).astype(np.int32) for k in (15, n // 2, n // 20)]
    times = [r.integers(1, 9, len(x)).astype(np.int32) for x in docs]
    lengths = np.full(n, 100, np.int32)
    treaps = lexical_search.Treaps(list(range(n)), lengths, terms, docs, times, n, 100 * n)
    weights = np.array([9000, 600, 3000])
    best = lexical_search.Best(10)
    scored = treaps.search(terms, weights, best)
    whole = np.zeros(n, np.int64)
    for d, t, w in zip(docs, times, weights):
        whole[d] += w * (10**9 * t.astype(np.int64) // (1000 * t + 800))
    want = sorted((-int(s), i) for i, s in enumerate(whole) if s)[:10]
    assert [(s, i) for s, _, i, _ in best.found] == want
    assert scored < n // 4


# --- 12


def brute_audit(rows, min_docs, top):
    docs = [(x[2] or "", x[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(x[1]))) for x in rows]
    out = []
    for lang in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == lang]
        held = Counter(t for x in mine for t in set(x[2]))
        kept = sorted(t for t in held if held[t] >= min_docs)
        count = {s: Counter() for s in {x[1] for x in mine}}
        for _, s, terms in mine:
            count[s].update(t for t in terms if t in set(kept))

        def p(c, c_all):
            return {t: 1 + 10**9 * (c[t] + 2) // (c_all + 2 * len(kept)) for t in kept}

        share = {s: p(c, c.total()) for s, c in count.items()}
        whole = sum(count.values(), Counter())
        q = p(whole, whole.total())
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o) for o in count if o != s]
            more = [(-f(share[s][t], q[t]), t) for t in kept if count[s][t] and share[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(more, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs,few", [(10, True), (2, False), (1000, True)])
def test_audit_by_brute_force(docs, rows, monkeypatch, min_docs, few):
    monkeypatch.setattr(source_audit, "BROADCAST_GROUPS", 10**5 if few else 0)
    got = source_audit.source_divergence(docs, min_docs=min_docs, top=3)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, min_docs, 3)


def test_audit_of_an_empty_table_and_of_small_running_counts(docs):
    assert source_audit.source_divergence(docs.limit(0)).count() == 0
    named = source_audit.named(docs, "text", "lang", "source")
    keys = ["lang", "source", "term"]
    sums = [sorted(map(tuple, source_audit.term_counts(named, k).groupBy(*keys).agg(F.sum("n"), F.sum("docs")).collect())) for k in (1, 10**6)]
    assert sums[0] == sums[1]


@pytest.mark.parametrize("n,total,kept", [(0, 0, 1), (9 * 10**12, 9 * 10**12, 5), (123456789012, 987654321098, 777), (1, 10**13, 10**8)])
def test_shares_are_exact(spark, n, total, kept):
    got = spark.range(1).select(source_audit.share(F.lit(n), F.lit(total).cast("long"), F.lit(kept))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


# --- 13

PATH = public_tokenizers.path("piece_bpe_32k.model")


def spellings(pieces, word):
    """All segmentations of the marked word: sums of their scores."""
    text = lattice_scores.START + word.decode("utf-8", "surrogateescape")

    def byte_score(ch):
        return sum(pieces.scores[f"<0x{b:02X}>"] for b in ch.encode("utf-8", "surrogateescape"))

    out = []
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        parts = [(a, text[a:b]) for a, b in zip(edges, edges[1:])]
        options = []
        for a, x in parts:
            one = [pieces.scores[x]] if x in pieces.scores and not x.startswith("<0x") and (a == 0) == x.startswith(lattice_scores.START) else []
            options.append(one + ([byte_score(x)] if len(x) == 1 else []))
        out += [sum(p) for p in itertools.product(*options)]
    return out


@pytest.mark.parametrize("word", ["the", "inter", "ñandú", "日本x", "a▁b", "<0x41>"])
def test_forward_recursion_sums_over_all_segmentations(word):
    pieces = lattice_scores.Pieces(lattice_scores.vocabulary(PATH))
    word = word.encode()
    want = math.log(math.fsum(math.exp(s) for s in spellings(pieces, word)))
    assert pieces.log_probability(word) == pytest.approx(want, abs=1e-9)
    into = defaultdict(float)
    pieces.expected(word, into)
    # every segmentation spells the marked word, so the expected pieces do
    size = sum(n * (1 if re.fullmatch("<0x..>", p) else len(p.encode())) for p, n in into.items())
    assert size == pytest.approx(len(lattice_scores.START.encode()) + len(word), abs=1e-6)


def test_many_words_at_once_are_as_each_alone():
    r = random.Random(8)
    letters = "abcdetuñ日▁<0x41>é"
    words = ["".join(r.choice(letters) for _ in range(r.choice([1, 2, 4, 5, 9, 15, 30, 63, 64, 200]))).encode() for _ in range(120)] + [b"", b"\xff\xfea", b"the", b"the"]
    pieces = lattice_scores.Pieces(lattice_scores.vocabulary(PATH))
    assert pieces.log_probabilities(words) == pytest.approx([pieces.log_probability(w) for w in words], abs=1e-9)
    many, one = defaultdict(float), defaultdict(float)
    pieces.expected_in(words, many)
    for w in words:
        pieces.expected(w, one)
    assert {k: v for k, v in many.items() if v > 1e-12} == pytest.approx({k: v for k, v in one.items() if v > 1e-12}, abs=1e-9)


def test_no_utf8_and_long_words_have_a_score():
    pieces = lattice_scores.Pieces(lattice_scores.vocabulary(PATH))
    assert -100 < pieces.log_probability(b"\xff\xfe") < 0
    assert math.isfinite(pieces.log_probability(b"ab" * 50_000))


def test_probabilities_sum_to_one():
    scores = lattice_scores.vocabulary(PATH)
    assert math.fsum(map(math.exp, scores.values())) == pytest.approx(1)
    counts, ends = {"x": 5, "y": 1, "z": 1}, 2
    model = lattice_scores.Model(sum(counts.values()) + ends, len(counts) + 1, 0.4)
    spelled = {"x": 0.2, "y": 0.3, "z": 0.1, "new": 0.4}  # as if these were all words there are
    total = sum(math.exp(model.lattice(counts.get(w, 0), math.log(p))) for w, p in spelled.items()) + math.exp(model.lattice(ends, None))
    assert total == pytest.approx(1)


@pytest.fixture(scope="module", params=[5, 10**6])
def scored(request, docs):
    return lattice_scores.score_documents(docs, PATH, frequent=request.param, running=40).collect()


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]


def test_scores_by_brute_force(scored, rows):
    held = [zlib.crc32(str(x[0] if x[0] is not None else "").encode()) % 10 == 0 for x in rows]
    tokens = [tokens_of(x[1]) for x in rows]
    train = [(x[2] or "", t) for x, t, h in zip(rows, tokens, held) if not h]
    langs = sorted({g for g, _ in train})
    c = Counter(t for _, x in train for t in x)
    by = {g: Counter(t for lang, x in train for t in x if lang == g) for g in langs}
    n, v = c.total(), len(c)
    start = lattice_scores.vocabulary(PATH)
    scores = start
    for _ in range(lattice_scores.ROUNDS):
        pieces, into = lattice_scores.Pieces(scores), defaultdict(float)
        for w in c:
            if w is not None:
                pieces.expected(w.encode(), into)
        scores = lattice_scores.normal({p: lattice_scores.PRIOR * math.exp(s) + into.get(p, 0) for p, s in start.items()})
    pieces = lattice_scores.Pieces(scores)

    def probability(counts, word):
        words = {w: k for w, k in counts.items() if w is not None}
        once, twice = (sum(k == i for k in words.values()) for i in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        spelled = math.exp(pieces.log_probability(word.encode())) if word is not None else 0
        return (max(0, counts[word] - d) if counts[word] else 0) / counts.total() + d * len(counts) / counts.total() * spelled

    want = []
    for x, held_out, text in zip(rows, held, tokens):
        base = math.fsum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in text)
        paths = []
        for g in langs:
            prior = (sum(lang == g for lang, _ in train) + 1) / (len(train) + len(langs))
            memo = {t: math.log10(0.1 * probability(c, t) + 0.9 * probability(by[g], t)) for t in set(text)}
            paths.append(math.log10(prior) + math.fsum(memo[t] for t in text))
        top = max(paths)
        want.append((x[0], held_out, len(text), sum(c[t] > 0 for t in text), n, base, top + math.log10(sum(10 ** (p - top) for p in paths))))
    by_key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert len(scored) == len(want)
    for got, exact in zip(sorted(map(tuple, scored), key=by_key), sorted(want, key=by_key)):
        assert got[:5] == exact[:5]
        assert got[5:] == pytest.approx(exact[5:], rel=1e-9)


def test_scores_of_odd_tables(spark, docs):
    assert lattice_scores.score_documents(docs.limit(0), PATH).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    only_held = spark.createDataFrame([(held[0], "some words"), (held[1], None), (held[2], "")], "doc_id long, text string")
    got = lattice_scores.score_documents(only_held, PATH, lang=None).collect()
    assert [r["train_tokens"] for r in got] == [0, 0, 0] and all(r["held_out"] and r["n_known"] == 0 and math.isfinite(r["score"]) and r["base_score"] == 0 for r in got)


def test_held_out_text_of_the_corpus_beats_shuffled_letters(spark):
    r = random.Random(2)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(80)) for _ in range(200)]
    rows = [(i, "".join(r.sample(x, len(x))) if zlib.crc32(str(i).encode()) % 10 == 0 and i % 2 else x, "la") for i, x in enumerate(texts)]
    got = lattice_scores.score_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).where("held_out").collect()
    per_token = {odd: [x["score"] / x["n_tokens"] for x in got if x["doc_id"] % 2 == odd] for odd in (0, 1)}
    assert min(per_token[0]) > max(per_token[1])
