"""The stages of the corpus pipeline, one after another, each against a brute-force version on its own input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from test_large_ops import brute_classes, brute_lines
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import decontamination, importance

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
M = (1 << 64) - 1
GOOD = "river house tree walks sings blue stone light water green field morning bird road hill cloud winter".split()
BAD = "buy!! $$$ click free*** win## now!!!".split()


def corpus():
    r = random.Random(11)
    line = lambda words, n: " ".join(f"{r.choice(words)}{r.randint(0, 30)}" for _ in range(n))
    bench = [(k, line(GOOD, 30)) for k in range(4)] + [(4, "short item of five words"), (5, None)]
    shared = [line(GOOD, 55), "read more", "©"]
    rows, labels = [], []
    for i in range(160):
        bad = i % 5 == 0
        parts = [line(BAD if bad else GOOD, r.randint(15, 60)) for _ in range(r.randint(1, 4))]
        if i % 3 == 1:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        if i % 10 == 2:
            parts.append(bench[i % 4][1])
        rows.append((i, "\n".join(parts), f"s{i % 11}"))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(200 + i, rows[i + 1][1], "s3") for i in range(20)]  # exact copies
    rows += [(230 + i, rows[i + 1][1].replace("river1 ", "hill2 ", 1) + " end", "s4") for i in range(20)]  # near copies
    rows += [(260, None, "s1"), (261, "", "s1"), (262, " \n\t", None), (263, bench[0][1], "s2"), (264, "short item of five words", "s2"), (265, line(GOOD, 9000), "s5"), (266, "日本語の一行", "s5")]
    rows += [rows[1], rows[1], (None, line(GOOD, 40), "s6")]
    return rows, labels, bench


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, labels, bench = corpus()
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def mixed(x):
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & M
    return x ^ (x >> 29)


def brute_grams(text):
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    c = [xxhash.xxh64_intdigest((t if t.isupper() and len(t) > 1 else t.lower()).encode()) for t in tokens]
    return Counter([mixed(x) % 65536 for x in c] + [mixed(((a * 0x9E3779B97F4A7C15 + b) & M) ^ 0x5851F42D4C957F2D) % 65536 for a, b in zip(c, c[1:])])


def brute_quality(spark, rows, labels):
    """Counts, ratios, the held-out threshold and Gumbel top-k, without sketches, folds of arrays or radix passes."""
    ids = sorted({i for i, _ in rows if i is not None} | {i for i, _, _ in labels})
    known = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h"), importance.gumbel(7, F.col("doc_id")).alias("g")).collect()
    h, g = {x["doc_id"]: x["h"] for x in known}, {x["doc_id"]: x["g"] for x in known}
    fold = {i: h[i] % 2 + 1 for i, q, t in labels if q == 1 and not t}
    grams = [(i, brute_grams(t)) for i, t in rows]
    raw = sum((x for _, x in grams), Counter())
    total = 65536 * 1e-9 + sum(raw.values())

    def ratios(folds):
        target = sum((x for i, x in grams if fold.get(i) in folds), Counter())
        q = lambda b: (raw[b] + 1e-9) / total
        r = lambda b: (target[b] + 10.0) / (q(b) * sum(target.values()) + 10.0)
        away = np.log(sum(q(b) * r(b) for b in range(65536)))
        return {b: np.log(r(b)) - away for b in raw}

    whole, without = ratios({1, 2}), {1: ratios({2}), 2: ratios({1})}
    weigh = lambda x, w: sum(n * w[b] for b, n in x.items()) if x else None
    held = np.quantile([weigh(x, without[fold[i]]) for i, x in grams if i in fold and x], importance.LOSS)
    weights = [weigh(x, whole) for _, x in grams]
    k = sum(w is not None and w >= held for w in weights)
    keys = sorted(((np.floor((w + g[i]) * 2**20), h[i]) for (i, _), w in zip(grams, weights) if w is not None), reverse=True)
    return sorted(str((i, t)) for (i, t), w in zip(rows, weights) if w is not None and (k >= len(keys) or (np.floor((w + g[i]) * 2**20), h[i]) >= keys[k - 1]))


def brute_cut(text, items):
    raw = (text or "").encode()
    places = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.lower())]
    words = [raw.lower()[a:b] for a, b in places]
    hit = set()
    for _, t in items:
        w = decontamination.words_of(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            hit |= {q for p in range(len(words) - k + 1) if words[p : p + k] == w[s : s + k] for q in range(p, p + k)}
    if len(hit) > 0.5 * len(words):
        return False, None
    out, at, p = [], 0, 0
    while p < len(words):
        if p in hit:
            end = p
            while end in hit:
                end += 1
            out.append(raw[at : places[p][0]])
            at, p = places[end - 1][1], end
        else:
            p += 1
    return True, None if text is None else b"".join([*out, raw[at:]]).decode()


def test_stages_by_brute_force(spark, sf_dir):
    _, labels, bench = corpus()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(x["doc_id"], x["text"], x["source"]) for x in docs.collect()]
        out = corpus_pipeline.durable(stage(spark, docs, sf_dir))
        rows = out.collect()
        if name != names[-1]:
            assert out.columns == docs.columns
            assert all(x["n_chars"] == len(x["text"] or "") for x in rows)
        got = sorted(str((x["doc_id"], x["text"])) for x in rows) if "text" in out.columns else None
        if name == names[0]:
            want = brute_quality(spark, [(i, t) for i, t, _ in before], labels)
            assert 60 < len(want) < len(before) and not any(w in x for x in want for w in ("$$$", "None)", "''"))
        elif name == names[1]:
            # a line's first place goes by id, null ids last
            order = sorted(before, key=lambda x: (x[0] is None, x[0] or 0))
            found = brute_lines([(k, t, s) for k, (_, t, s) in enumerate(dict.fromkeys(order))], 8)
            by = {row: found[k] for k, row in enumerate(dict.fromkeys(order))}
            want = sorted(str((i, by[i, t, s])) for i, t, s in before)
            assert sum("read more" in x for x in want) <= 4 < 8 <= sum("read more" in (t or "") for _, t, _ in before)
        elif name == names[2]:
            least = brute_classes(list({i: t for i, t, _ in before if i is not None}.items()))
            want = sorted(str((i, t)) for i, t, _ in before if i is None or least[i] == i)
            assert len(want) < len(before)
        elif name == names[3]:
            cut = [(i, *brute_cut(t, bench)) for i, t, _ in before]
            want = sorted(str((i, t)) for i, stay, t in cut if stay)
            assert len(want) < len(before) or any(str((i, t)) not in want for i, t, _ in before)
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want, got = [], sorted(str(tuple(x)) for x in rows)
            for i, t, _ in before:
                ids = lib.encode(t or "", add_special_tokens=False).ids
                want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
            want.sort()
        assert got == want, name
        docs = out
    final = sorted(str(tuple(x)) for x in corpus_pipeline.run(spark, sf_dir).collect())
    assert final == want


def test_empty_tables_and_extra_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in (f for _, f in corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("id", "digest", "line", "site", "removed", "class_id", "_id", "_removed", "_cut", "words", "item", "size")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        clash = corpus_pipeline.durable(stage(spark, clash, sf_dir))
    assert clash.columns[:5] == docs.columns and clash.where("size = 'x'").count() == clash.count() > 50
