import json
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import dart_minhash, html_pages, html_tree, importance, line_spread, tool_calls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# --- 8: near-duplicates


def strips(text):
    w = (text or "").lower().split()
    if not w:
        return Counter()
    w += [""] * (5 - len(w))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j:
                x, y = strips(a), strips(b)
                both, either = sum((x & y).values()), sum((x | y).values())
                if (a or "") == (b or "") or either and both / either >= 0.8:
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in rows}


def test_classes_by_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice("kilo lima mike nova oscar papa quark rome sierra tango".split()) + str(r.randint(0, 99))
    rows, n = [], 0

    def add(t):
        nonlocal n
        rows.append((n, t))
        n += 1

    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 5, 8, 60, 200]))]
        add(" ".join(base))
        for _ in range(r.randint(0, 6)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 30))):
                t[r.randrange(len(t))] = word()
            add(" ".join(t))
    base = [word() for _ in range(150)]  # no member is the base itself, and neighbours of a chain differ more and more
    for k in range(12):
        t = list(base)
        for p in r.sample(range(150), 4):
            t[p] = word()
        add(" ".join(t))
    for t in ("", None, "", "one", "one", "One two", "a b a b a b a b a b a b a b"):
        add(t)
    df = docs(spark, [(i, t, "s") for i, t in rows])
    got = {x["doc_id"]: (x["class_id"], x["class_size"]) for x in dart_minhash.near_duplicate_classes(df).collect()}
    want = brute_classes(rows)
    sizes = Counter(want.values())
    assert got == {i: (c, sizes[c]) for i, c in want.items()}
    kept = {x["doc_id"] for x in dart_minhash.drop_near_duplicates(df).collect()}
    assert kept == set(want.values())


def test_repeated_rows_and_empty_table(spark):
    df = docs(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b c", "s"), (None, None, "s")])
    got = sorted((str(x["doc_id"]), str(x["class_id"]), x["class_size"]) for x in dart_minhash.near_duplicate_classes(df).collect())
    assert got == [("1", "1", 3), ("1", "1", 3), ("None", "1", 3), ("None", "None", 1)]
    assert dart_minhash.near_duplicate_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("rounds, block", [(0, 2048), (0, 4), (3, 4)])
def test_rounds_and_blocks_lose_no_link(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(dart_minhash, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(dart_minhash, "BLOCK_NODES", block)
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(14):
        t = list(base)
        for p in r.sample(range(120), 3):
            t[p] = f"x{k}{p}"
        rows.append((k, " ".join(t)))
    got = {x["doc_id"]: x["class_id"] for x in dart_minhash.near_duplicate_classes(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("weights", [(3.0, 1.0, 2.0), (0.5, 0.25, 1.75)])
def test_signatures_estimate_weighted_similarity(weights):
    a, b = np.array(weights), np.array(weights)[::-1]
    place, element = np.repeat([0, 1], 3), np.tile(np.array([11, 22, 33], np.uint64), 2)
    s, has = dart_minhash.signatures(place, element, np.concatenate([a, b]), 2, 4000)
    assert has.all() and abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components_by_brute_force(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["label"] for x in dart_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# --- 10: line dedup


def brute_lines(rows, sites):
    import re

    norm = lambda x: re.sub("[ \t\r]+", " ", x.lower()).strip(" ")
    where, first = {}, {}
    for i, t, s in rows:
        for p, x in enumerate((t or "").split("\n")):
            if norm(x):
                where.setdefault(norm(x), set()).add(s or "")
                first[norm(x)] = min(first.get(norm(x), (i, p)), (i, p))
    out = {}
    for i, t, s in rows:
        keep = [x for p, x in enumerate((t or "").split("\n")) if len(where.get(norm(x), ())) < sites or first[norm(x)] == (i, p)]
        out[i] = None if t is None else "\n".join(keep)
    return out


@pytest.mark.parametrize("sites, constants", [(2, 5000), (8, 5000), (2, 3)])
def test_lines_by_brute_force(spark, monkeypatch, sites, constants):
    monkeypatch.setattr(line_spread, "CONSTANT_LINES", constants)
    r = random.Random(sites)
    common = [f"this is common line {k}" for k in range(14)]
    rows = []
    for i in range(150):
        lines = [r.choice(common[: r.randint(1, 14)]) for _ in range(r.randint(0, 5))] + [f"own line of {i}", "a b", ""]
        r.shuffle(lines)
        rows.append((i, "\n".join(x.upper() if r.random() < 0.2 else x for x in lines), r.choice([f"s{k}" for k in range(9)] + [None])))
    rows += [(150, None, "s1"), (151, "", "s1"), (152, "\n\n", "s2"), (153, "a\n" * 20000 + " \t\r\nB", "s3"), (154, "\t\n\t", None)]
    df = docs(spark, rows).withColumns({"_removed": F.lit(1), "_id": F.lit(2), "_hash": F.lit(3), "line": F.lit(4), "ID": F.lit(5)})
    out = line_spread.remove_boilerplate(df, min_sites=sites)
    assert out.columns == df.columns
    assert {x["doc_id"]: x["text"] for x in out.collect()} == brute_lines(rows, sites)
    assert line_spread.remove_boilerplate(df.limit(0)).count() == 0


def test_pipeline_counts_short_lines_but_not_blank_ones(spark):
    import corpus_pipeline

    rows = [(i, f"own line {i} here\n\nles.\n \n没有空格的一行", f"s{i}") for i in range(9)]
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.lines(spark, docs(spark, rows), "").collect()}
    assert got == {i: t if i == 0 else f"own line {i} here\n\n " for i, t, _ in rows}


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i * 10 + k, f"line number {k} here", f"s{i}") for k in range(6) for i in range(5 + k)]
    lines = line_spread.line_table(docs(spark, rows), "doc_id", "text", "source")
    assert line_spread.boilerplate_lines(lines, min_sites=8, lg_k=4).count() == 3


# --- 2: importance resampling


def test_top_k_by_sorting(spark):
    r = random.Random(1)
    keys = [r.choice([r.gauss(0, 1e6), 1.5, -3.0]) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id int, key double")
    a, b = importance.ranks(F.col("key"), F.col("id"))
    ranked = rows.withColumns({"a": a, "b": b}).cache()
    order = sorted(((x["a"], x["b"]) for x in ranked.collect()), reverse=True)
    for k in (1, 7, 250, 499):
        x, y = importance.kth(ranked, "a", "b", k)
        assert ranked.where((F.col("a") > x) | ((F.col("a") == x) & (F.col("b") >= y))).count() == k == sum(o >= (x, y) for o in order)
    assert importance.kth(ranked, "a", "b", 500) is None


def corpus(r, n):
    good = lambda: " ".join(r.choice(["the", "of", "river", "house", "tree", "walks", "sings", "blue"]) for _ in range(r.randint(20, 60)))
    bad = lambda: " ".join(r.choice(["buy!!", "$$$", "click", "free***", "win##"]) for _ in range(r.randint(20, 60)))
    return [(i, bad() if i % 5 == 0 else good(), "s") for i in range(n)]


def test_held_out_documents(spark):
    rows = corpus(random.Random(2), 400) + [(400, None, "s"), (401, "", "s"), (402, "\n", "s")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 200)] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"] for x in importance.select_documents(docs(spark, rows), labels).collect()}
    held = set(range(200, 400))
    assert len(kept & held) >= 155 and not {i for i in kept & held if i % 5 == 0} and not kept & {400, 401, 402}
    again = {x["doc_id"] for x in importance.select_documents(docs(spark, rows).repartition(7), labels).collect()}
    assert kept == again


def test_toxic_documents_of_good_quality_are_not_drawn(spark):
    r = random.Random(4)
    toxic = [f"slur{k}" for k in range(10)]
    rows = []
    for i in range(1400):
        words = [f"w{int(r.random() ** 2 * 400) + 20 * (i % 9)}" for _ in range(r.randint(100, 300))]
        if i % 7 == 0:
            for w in r.sample(toxic, 3):
                words[r.randrange(len(words))] = w
        rows.append((i, " ".join(words), "s"))
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(700)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"] for x in importance.select_documents(docs(spark, rows), labels).collect()}
    held = set(range(700, 1400))
    assert len([i for i in kept & held if i % 7 == 0]) <= 5
    assert len([i for i in kept & held if i % 7]) >= 570


def brute_codes(text):
    """The 64-bit codes of a text's unigrams and bigrams."""
    m = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & m
        return x ^ (x >> 29)

    c = [xxhash.xxh64_intdigest((t if t.isupper() and len(t) > 1 else t.lower()).encode()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    return {mixed(x) for x in c} | {mixed(((a * 0x9E3779B97F4A7C15 + b) & m) ^ 0x5851F42D4C957F2D) for a, b in zip(c, c[1:])}


def test_toxic_ratio_by_brute_force(spark):
    r = random.Random(9)
    words, bad = [f"w{k}" for k in range(40)], ["slur", "SLUR", "vile", "w3"]
    rows = [(i, " ".join(r.choice(bad if i % 6 == 0 and r.random() < 0.2 else words) for _ in range(r.randint(1, 25))), "s") for i in range(240)] + [(240, None, "s"), (241, "", "s"), (5, "slur vile slur vile", "s")]
    labels = [(i, int(i % 7 != 0), int(i % 6 == 0)) for i in range(200)] + [(3, 1, 0), (500, 1, 1)]
    df, given = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = importance.fit(df, given)
    got = importance.log_weights(importance.with_folds(df, given, "doc_id"), model, fold="_fold").select("doc_id", "text", "_toxic", "_held_toxic").collect()

    ids = sorted({i for i, *_ in labels})
    parity = {x["doc_id"]: x["p"] for x in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("p")).collect()}
    quality = {i: min(q for j, q, _ in labels if j == i) for i in ids}
    toxic = {i for i in ids if any(t for j, _, t in labels if j == i)}
    target = {i for i in ids if quality[i] == 1 and i not in toxic}
    held = lambda among, fold: [brute_codes(t) for i, t, _ in rows if i in among and parity[i] == fold]
    t, g = ([held(among, k) for k in (0, 1)] for among in (toxic, target))
    n = lambda sets, code: sum(code in x for x in sets)
    codes = [c for c in set().union(*t[0], *t[1]) if n(t[0], c) + n(t[1], c) >= importance.TOXIC_SUPPORT]
    one = lambda c, k: math.log((n(t[k], c) + 1.0) / (n(g[k], c) * len(t[k]) / len(g[k]) + 1.0))
    # the model without fold 1 (parity 0) is that of fold 2, and the other way round
    ratios = {c: ((one(c, 0) + one(c, 1)) / 2, one(c, 1), one(c, 0)) for c in codes}
    score = lambda text, of: sum(sorted((ratios[c][of] for c in brute_codes(text) if c in ratios and ratios[c][of] > 0), reverse=True)[: importance.STRONGEST])
    assert len(got) == len(rows)
    for x in got:
        assert x["_toxic"] == pytest.approx(score(x["text"], 0))
        fold = parity[x["doc_id"]] + 1 if x["doc_id"] in target else 0
        assert x["_held_toxic"] == (pytest.approx(score(x["text"], fold)) if fold else None)
    assert max(x["_toxic"] for x in got) > 1


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, corpus(random.Random(1), 20) + [(20, None, "s")])
    assert importance.select_documents(df, none).count() == 20
    assert importance.select_documents(df.limit(0), none).count() == 0


def test_gumbel_draws_in_proportion(spark):
    rows = spark.range(0, 40000).withColumn("w", F.when(F.col("id") % 2 == 0, F.log(F.lit(3.0))).otherwise(0.0))
    a, b = importance.ranks(F.col("w") + importance.gumbel(1, F.col("id")), F.col("id"))
    r = rows.withColumns({"a": a, "b": b}).cache()
    x, y = importance.kth(r, "a", "b", 2000)
    share = r.where((F.col("a") > x) | ((F.col("a") == x) & (F.col("b") >= y))).agg(F.avg((F.col("id") % 2 == 0).cast("double"))).first()[0]
    assert abs(share - 0.75) < 0.03


# --- 6: HTML


@pytest.fixture(scope="module")
def weights():
    return html_tree.train(html_pages.labelled_pages(600))


def test_held_out_layouts(weights):
    pages = html_pages.labelled_pages(150, seed=99)
    right = 0
    for (page, content), got in zip(pages, html_tree.extract([p for p, _ in pages], weights)):
        right += got == [x for x in html_tree.parse(page).text if x and x in content]
    assert right >= 140


def test_marginals_are_exact():
    r = np.random.default_rng(1)
    tree = html_tree.parse("<div><p>a</p><ul><li>b<li>c</ul></div><p>d")
    f = html_tree.plant([tree])
    w = html_tree.Weights(r.normal(size=html_tree.FEATURES), r.normal(size=(html_tree.N_KINDS, 2, 2)))
    n = len(tree.tag)
    unary = np.bincount(f.node, w.node[f.feature], n)
    total, mass = 0.0, np.zeros(n)
    for bits in range(2**n):
        y = [(bits >> i) & 1 for i in range(n)]
        p = np.exp(sum(unary[i] for i in range(n) if y[i]) + sum(w.pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(1, n)))
        total += p
        mass += p * np.array(y)
    node, _, log_z = html_tree.sum_product(f, w)
    assert np.allclose(node[:, 1], mass / total) and np.isclose(log_z, np.log(total))


def test_any_string_is_read(spark, weights):
    pages = [None, "", "<", "</p></div>", "<script>x", "<!-- never closed", "plain text", "<p title='a>b'>q", "<a<b>", "<div>" * 3000 + "deep", "<article><p>" + "long. " * 20000]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id int, html string")
    got = {r["page_id"]: r["text"] for r in html_tree.extract_main_text(df, weights).collect()}
    assert [got[i] for i in (0, 1, 3, 4, 5)] == [""] * 5 and got[10] == ("long. " * 20000).strip()
    assert html_tree.extract_main_text(df.limit(0), weights).count() == 0


def test_entities_and_blanks(weights):
    page = "<nav><ul><li><a href=/x>x</a></ul></nav><article><h1>A &amp; B&nbsp;C</h1><p>one\n  two <b>three</b>four&lt;5</p><p>Next. &copy; it, is; here.</p></article><footer>&copy; x</footer>"
    assert html_tree.extract([page], weights) == [["A & B C", "one two threefour<5", "Next. © it, is; here."]]


def test_references_stay_within_a_piece_and_time_is_linear(weights):
    assert html_tree.parse("<p>&l<b>t;</b> &lt; &#x1F600;").text[-1] == "&lt; < 😀"
    for piece in ("<svg/>", '<a b="', "<p title='", "<!-- ", "<![CDATA[>", "&amp", "</x>", "<b><i>"):
        start = time.process_time()
        html_tree.parse(piece * 40_000)
        assert time.process_time() - start < 8, piece


# --- 4: tool calls


def call(i, name="search", **arguments):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': arguments})}</tool_call>"


def result(i, content="r"):
    return f"<tool_result>{json.dumps({'id': i, 'content': content})}</tool_result>"


def link(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    return tool_calls.link_tool_calls(df).collect()


def test_linking(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "look " + call("a", query="x") + call("b", query={"$ref": "a"}) + call("c", limit=0)),
        (1, 2, "tool", result("a") + result("b") + result("zzz")),
        (1, 3, "assistant", call("a", query="again") + call("d", "unknown") + "<tool_call>{broken</tool_call>" + '<tool_call>{"id": 1e999}</tool_call>'),
        (2, 0, "assistant", call("p", query={"$ref": "q"}) + call("q", query={"$ref": "p"}) + call("r", query={"$ref": "nowhere"})),
        (2, 1, "tool", result("early")),
        (2, 2, "assistant", call("early", query="x")),
        (None, 0, "assistant", call("a", query="x")),
        (3, None, None, None),
    ]
    got = link(spark, rows)
    state = {(r["conv_id"], r["turn"], r["kind"], r["call_id"]): (r["level"], r["status"]) for r in got}
    assert state[1, 1, "call", "a"] == (0, "ok") and state[1, 1, "call", "b"] == (1, "ok") and state[1, 1, "call", "c"] == (0, "invalid")
    assert state[1, 2, "result", "a"] == (None, "ok") and state[1, 2, "result", "zzz"] == (None, "no_call")
    assert state[1, 3, "call", "a"][1] == "duplicate" and state[1, 3, "call", "d"][1] == "invalid"
    assert state[2, 0, "call", "p"] == (None, "cycle") == state[2, 0, "call", "q"] and state[2, 0, "call", "r"] == (0, "no_result")
    assert state[2, 2, "call", "early"][1] == "early" == state[2, 1, "result", "early"][1]
    assert sum(r["status"] == "unreadable" for r in got) == 2 and state[3, None, "message", None][1] == "ok"
    message = next(r["json"] for r in got if r["conv_id"] == 1 and r["turn"] == 1 and r["kind"] == "message")
    assert message == '{"content":"look ","role":"assistant"}'
    assert link(spark, []) == []


def test_canonical_json():
    assert tool_calls.canonical({"b": 1.0, "a": ["é", None, True, 1.5], "c": {}}) == '{"a":["é",null,true,1.5],"b":1,"c":{}}'
    with pytest.raises(ValueError):
        tool_calls.read_json('{"a": NaN}')


def test_schemas():
    s = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "maximum": 3}, "t": {"type": "array", "items": {"enum": ["x"]}, "maxItems": 1}}, "additionalProperties": False}
    wrong = lambda v: sorted(tool_calls.check_schema(v, s))
    assert wrong({"n": 3, "t": ["x"]}) == [] and wrong({"n": {"$ref": "a"}}) == []
    assert wrong({"n": True}) == ["$.n: not integer"] and wrong({}) == ["$.n: missing"] and wrong({"n": 4, "z": 1}) == ["$.n: range", "$.z: not allowed"]
    assert wrong({"n": 1, "t": ["y", "x"]}) == ["$.t: number of items", "$.t[0]: not one of the listed values"] and wrong([]) == ["$: not object"]


def brute_link(rows):
    """(conv, turn, idx) -> (kind, call_id, level, status) for whole conversations of readable calls and results."""
    out, found = {}, {}
    for conv, turn, role, text in rows:
        for i, e in enumerate(tool_calls.read_events(text, role, tool_calls.SCHEMAS)):
            found.setdefault(conv, []).append((turn, i, e))
    for conv, events in found.items():
        events.sort(key=lambda x: x[:2])
        first = {}
        for t, i, e in events:
            if e.get("call_id"):
                first.setdefault((e["kind"], e["call_id"]), (t, i, e))
        calls = {c: x for (k, c), x in first.items() if k == "call"}
        results = {c: x for (k, c), x in first.items() if k == "result"}

        def level(c, seen=()):
            if c in seen:
                return None
            below = [level(r, (*seen, c)) for r in calls[c][2]["refs"] if r in calls]
            return None if None in below else max([x + 1 for x in below], default=0)

        for t, i, e in events:
            c, kind = e.get("call_id"), e["kind"]
            own = level(c) if c in calls else None
            if kind == "message":
                state = "ok"
            elif c is None:
                state = "unreadable"
            elif first[kind, c][:2] != (t, i):
                state = "duplicate"
            elif kind == "call" and own is None:
                state = "cycle"
            elif kind == "call" and e["problems"]:
                state = "invalid"
            elif c not in results:
                state = "no_result"
            elif c not in calls:
                state = "no_call"
            else:
                state = "early" if results[c][:2] < calls[c][:2] else "ok"
            out[conv, t, i] = (kind, c, own if kind == "call" else None, state)
    return out


@pytest.mark.parametrize("one_pass", [20_000, 12])
def test_linking_by_brute_force(spark, one_pass):
    r = random.Random(5)
    rows = []
    for conv in range(30):
        n = 120 if conv == 0 else r.randint(1, 12)  # one conversation holds a third of all
        for turn in range(n):
            text = "so " * r.randint(0, 2)
            for _ in range(r.randint(0, 2)):
                i = r.randint(0, 2 * n)
                ref = {"$ref": str(r.randint(max(0, i - 5), i + (r.random() < 0.1)))}
                text += call(str(i), **r.choice([{"query": "x"}, {"query": ref}, {"query": ref, "limit": 2}, {"limit": 0}]))
            for _ in range(r.randint(0, 2)):
                text += result(str(r.randint(0, 2 * n))) + ("<tool_result>[]</tool_result>" if r.random() < 0.1 else "")
            rows.append((conv, turn, r.choice(["user", "assistant", "tool"]), text))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"level": F.lit("clash"), "uid": F.lit(1), "json": F.lit(2)})
    got = tool_calls.link_tool_calls(df.repartition(7), one_pass=one_pass).collect()
    assert {(x["conv_id"], x["turn"], x["idx"]): (x["kind"], x["call_id"], x["level"], x["status"]) for x in got} == brute_link(rows)
    for conv in range(30):
        seen = set()
        for x in sorted((x for x in got if x["conv_id"] == conv and x["kind"] != "message" and x["call_id"]), key=lambda x: x["place"]):
            seen.add((x["kind"], x["call_id"], x["turn"]))
            if x["kind"] == "result" and x["status"] == "ok":
                assert any((c["kind"], c["call_id"]) == ("call", x["call_id"]) and ("call", x["call_id"], c["turn"]) in seen for c in got if c["conv_id"] == conv)


def test_unreadable_json_does_not_stop_the_job(spark, tmp_path):
    deep = "[" * 1500 + "]" * 1500
    bodies = ['{"id": "a", "name": "search", "arguments": {"query": "\\ud800"}}', '{"id": "b", "arguments": ' + deep + "}", '{"id": "c", "arguments": ' + "[" * 70 + "]" * 70 + "}", '{"id": ' + "9" * 6000 + "}", '{"id": "d", "content": "\\ud83d\\ude00"}']
    rows = [(1, i, "assistant", f"<tool_result>{b}</tool_result>") for i, b in enumerate(bodies)]
    got = {x["turn"]: x for x in link(spark, rows) if x["kind"] == "result"}
    assert [got[i]["status"] for i in range(5)] == ["unreadable"] * 4 + ["no_call"] and "😀" in got[4]["json"]
    df = spark.createDataFrame(rows[4:] + [(0, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    tool_calls.write_conversations(tool_calls.link_tool_calls(df), str(tmp_path / "out"), 1)
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ['{"content":"hi","role":"user"}', '{"content":"","role":"assistant"}', '{"content":"😀","id":"d"}']


def test_levels_of_a_long_chain(spark):
    text = "".join(call(str(i), query={"$ref": str(i + 1)}) for i in range(6)) + call("6", query="x")
    got = {r["call_id"]: r["level"] for r in link(spark, [(1, 0, "assistant", text)]) if r["kind"] == "call"}
    assert got == {str(i): 6 - i for i in range(7)}
