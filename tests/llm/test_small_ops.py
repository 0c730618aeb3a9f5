import functools
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe_automaton, decontamination, rule_ledger, sharding, token_counts

ODD = ["", " ", "\n\n  a\tb \r\n", "İstanbul ΣΑΣ x² ½", "don't 'S we'll <|endoftext|>x<|startoftext|>", "___ a_b \x1c\x85\xa0", "日本語 🙂 é é", "0123 45 <</w> </w>", "Å ﬁ ª º ß", "a" * 3000, "ab " * 5000]
DOCS = "doc_id long, text string, extra int, n_tokens_ int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], DOCS)


# --- 9 and 3: tokenizers


@pytest.fixture(scope="module")
def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library(path):
    return Tokenizer.from_file(path)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_automaton_encodes_like_the_library(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    e, lib = bpe_automaton.encoder(path), library(path)
    want = lib.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(b"".join(x[0] for x in e.encode(text)), "<u4").tolist()
    assert got == want
    assert " ".join(x[2] for x in e.encode(text)) == lib.decode(want, skip_special_tokens=False)


def test_gadgets_by_hand():
    # ab first, then abc; aa merges from the left
    v = {s: i for i, s in enumerate(["a", "b", "c", "ab", "abc", "aa"])}
    m = bpe_automaton.MergeAutomaton(v, [("a", "b"), ("ab", "c"), ("a", "a")], suffix="")
    assert not m.arc(v["a"], v["b"]) and not m.arc(v["ab"], v["c"]) and not m.arc(v["a"], v["aa"]) and m.arc(v["aa"], v["a"])
    spell = lambda w: [m.label[i] for i in m.encode_word(w)]
    assert spell("aaab") == ["aa", "ab"] and spell("aaaaa") == ["aa", "aa", "a"] and spell("cabc") == ["c", "abc"]


def test_random_merges_against_repeated_merging():
    r = random.Random(4)
    for _ in range(60):
        vocab, merges = list("abc"), []
        while len(merges) < 8:
            a, b = r.choice(vocab), r.choice(vocab)
            if a + b not in vocab:
                vocab.append(a + b)
                merges.append((a, b))
        m = bpe_automaton.MergeAutomaton({s: i for i, s in enumerate(vocab)}, merges, suffix="")
        for _ in range(40):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
            parts = list(word)
            while pairs := [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]:
                k, i = min(pairs)
                parts[i : i + 2] = ["".join(merges[k])]
            assert [m.label[i] for i in m.encode_word(word)] == parts


def test_digests_and_round_trip(spark, word_path):
    texts = [*ODD, None, ODD[3]]
    got = {r["doc_id"]: r for r in bpe_automaton.digest_documents(docs(spark, texts), word_path).collect()}
    lib = library(word_path)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe_automaton.encode_documents(docs(spark, texts), word_path)
    back = bpe_automaton.decode_documents(encoded, word_path).where("doc_id = 3").first()
    assert back["decoded"] == lib.decode(lib.encode(ODD[3], add_special_tokens=False).ids) and back["extra"] == 1
    with pytest.raises(ValueError):
        bpe_automaton.encode_documents(encoded, word_path)
    assert bpe_automaton.digest_documents(docs(spark, []), word_path).count() == 0


def test_token_counts(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, None, "word " * 4000, ODD[4]]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs(spark, texts), path).collect()}
    lib = token_counts.PreTokens(path).tokenizer
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    given_ = token_counts.count_tokens(docs(spark, texts), path, frequent={"word": 1})
    assert {r["doc_id"]: r["n_tokens"] for r in given_.collect()} == got
    assert token_counts.count_tokens(docs(spark, []), path).count() == 0


def test_table_of_a_sample_counts_alike(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = docs(spark, [f"some words{i} and {i} more " * 20 for i in range(300)])
    want = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, path).collect()}
    monkeypatch.setattr(token_counts, "SAMPLE_BYTES", 5000)
    found = token_counts.frequent_pretokens(df, path, sample_bytes=5000)
    assert 0 < sum(found.values()) < 20000 and found[" and"]
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, path).collect()} == want
    taken = df.withColumn("n_tokens", F.lit(1))
    with pytest.raises(ValueError):
        token_counts.count_tokens(taken, path)


def test_worker_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 10)
    p = token_counts.PreTokens(public_tokenizers.path("byte_bpe_50k.json"))
    tier = token_counts.Lengths({"a": 1}, p)
    for k in range(5):
        words = [f"w{k}{j}" for j in range(8)]
        assert tier.counts([words]) == [sum(p.lengths(words))] and len(tier.known) <= 11


# --- 1: decontamination


def brute_hits(text, items, window):
    words = decontamination.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        w = decontamination.words_of(t)
        k = min(window, len(w))
        for s in range(max(0, len(w) - k) + 1 if w else 0):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == w[s : s + k]:
                    hit |= set(range(p, p + k))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_matches_by_brute_force(spark, seed):
    r = random.Random(seed)
    alphabet = "ab" if seed < 2 else "abcdE1é"
    sentence = lambda n: " ".join(r.choice(alphabet) for _ in range(n))
    items = [(i, sentence(r.choice([0, 1, 3, 5, 9, 14]))) for i in range(7)] + [(50, None), (51, sentence(6)), (51, sentence(8))]
    texts = [sentence(r.randint(0, 40)) for _ in range(40)] + [None, "", "!!", " ".join(x or "" for _, x in items)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, [(str(a), b) for a, b in items], 5) for i, t in enumerate(texts)}
    for block in (10**6, 12):  # one automaton, and one for every few items
        got = decontamination.match_benchmark(docs(spark, texts), bench, window=5, max_block_bytes=block)
        rows = got.select("doc_id", "_match.words", decontamination.hit_words().alias("h"), "_match.items").collect()
        assert {x["doc_id"]: (x["words"], x["h"], x["items"]) for x in rows} == want


def test_removal_keeps_the_rest(spark):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    texts = ["Keep this. One, TWO three four five! And that too, please.", "one two three four five", "clean text", None]
    out = {r["doc_id"]: r["text"] for r in decontamination.remove_matches(docs(spark, texts), bench, window=5).collect()}
    assert out == {0: "Keep this. ! And that too, please.", 2: "clean text", 3: None}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.remove_matches(docs(spark, texts), empty).count() == 4


# --- 5: sharding


def test_shards(spark):
    rows = [(i, "x" * (i % 50) + "é") for i in range(3000)] + [(7, "same")] * 30 + [(None, None)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(df, [1.0] * 6, [1.0] * 7, slot_buckets=16).collect()
    assert len(got) == len(rows)
    for s in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 6) for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] and r["doc_id"] != 7}
    assert all(by_id[i]["size"] == 8 + len(t.encode()) and by_id[i]["text_crc32"] == zlib.crc32(t.encode()) for i, t in rows[100:200])
    counts = np.bincount([r["shard"] for r in got if r["doc_id"] is not None and r["doc_id"] != 7])
    assert counts.min() > 400 and counts.max() < 600
    assert sharding.assign_shards(df.limit(0), [1.0] * 6).count() == 0


def brute_shard(scores):
    return max(range(len(scores)), key=lambda i: (scores[i], -i))


def test_shards_by_brute_force_and_hot_keys(spark):
    rows = [(i % 40, f"t{i % 7}") for i in range(400)] + [(7, "same")] * 300 + [(None, "x")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit(0), "shard": F.lit(1), "slot": F.lit("s"), "part": F.lit(2), "n": F.lit(3)}).repartition(5)
    got = sharding.assign_shards(df, [1.0] * 4, [1.0] * 5, slot_buckets=3, group_rows=20).collect()
    keys = [*range(40), None]
    known = spark.createDataFrame([(k,) for k in keys], "k long").select("k", *[F.xxhash64(F.coalesce(F.xxhash64("k"), F.lit(0)), F.lit(i)).alias(f"h{i}") for i in range(5)])
    best = {r["k"]: (brute_shard([r[f"h{i}"] >> 1 for i in range(4)]), brute_shard([r[f"h{i}"] >> 1 for i in range(5)])) for r in known.collect()}
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == sorted((str(k), 8 + len(t), zlib.crc32(t.encode()), *best[k]) for k, t in rows)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_weighted_shards(spark):
    df = spark.range(0, 20000).withColumn("shard", F.lit("taken"))
    w = [1.0, 2.0, 5.0]
    c = {r[0]: r[1] for r in sharding.with_shard(df, w, "id").groupBy("_shard").count().collect()}
    assert all(abs(c[i] / 20000 - w[i] / 8) < 0.02 for i in range(3))
    more = df.select(sharding.rendezvous_shard(F.col("id"), w).alias("a"), sharding.rendezvous_shard(F.col("id"), [*w, 4.0]).alias("b"))
    assert more.where("a <> b AND b <> 3").count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.col("id"), [1.0, 0.0])


# --- 7: rules


def brute_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = list(zip(w, w[1:], w[2:]))
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


@given(st.lists(st.sampled_from(["a", "b", "c!", "#", "\n", " ", "\x85", "é"]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_measures_by_brute_force(parts):
    text = " ".join(parts)
    assert rule_ledger.measure(text)[:5] == brute_measures(text)


@given(st.text(st.characters(max_codepoint=0x2FFF), max_size=60))
@settings(max_examples=200, deadline=None)
def test_other_measures_by_brute_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    upper, lower = (sum(unicodedata.category(c) == k for c in text) for k in ("Lu", "Ll"))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert rule_ledger.measure(text)[5:] == (len(lines), upper, upper + lower, sum(w.endswith("!") for w in words))
    assert rule_ledger.cases("Ⅷ Éé aB") == (2, 2)


def test_ledger_policies_and_ablations(spark):
    clean = " ".join(f"word{i} other{i}" for i in range(60)) + "."
    texts = [clean, "short", None, "", clean.upper(), "# $ " * 50, "\n".join([clean[:60]] * 6) + clean, clean]
    e = rule_ledger.ledger(docs(spark, texts))
    p = {r["doc_id"]: r for r in rule_ledger.apply_policies(e).collect()}
    assert [p[i]["kept_v2"] for i in range(8)] == [True, False, False, False, False, False, False, True]
    assert p[4]["kept_base"] and not p[4]["fail_bits"] & 3
    a = {(r["policy"], r["rule"]): r for r in rule_ledger.ablations(e).collect()}
    kept = lambda rules: sum(not any((p[i]["fail_bits"] >> r.bit) & 1 for r in rule_ledger.RULES if r.name in rules) for i in range(8))
    for (policy, rule), r in a.items():
        names = next(x.rules for x in rule_ledger.POLICIES if x.version == policy)
        assert r["n_only_this"] == kept([n for n in names if n != rule]) - kept(names)
    assert rule_ledger.ledger(docs(spark, [])).count() == 0
