"""Keys beside nulls, and rows made to take long."""

import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_automaton, dart_minhash, html_tree, rule_ledger, tool_calls

BIG = 2**53
KEYS = [None, BIG + 1, BIG + 3]
TEXT = "one two three four five six seven eight nine ten"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, TEXT if k else "other words") for k in KEYS], "doc_id long, text string").coalesce(1)


def keys(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).collect()), key=lambda k: (k is not None, k))


def test_large_keys_beside_a_null_stay(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert keys(rule_ledger.ledger(docs)) == KEYS
    assert keys(bpe_automaton.digest_documents(docs, path)) == KEYS
    encoded = bpe_automaton.encode_documents(docs, path)
    assert keys(encoded) == KEYS and keys(bpe_automaton.decode_documents(encoded, path)) == KEYS
    assert keys(dart_minhash.near_duplicate_classes(docs)) == KEYS
    assert keys(html_tree.extract_main_text(docs.withColumnRenamed("text", "html"), html_tree.Weights())) == KEYS
    messages = docs.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    assert keys(tool_calls.link_tool_calls(messages), "conv_id") == KEYS


def test_equal_documents_with_large_keys_go(docs):
    classes = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in dart_minhash.near_duplicate_classes(docs).collect()}
    assert classes == {None: (None, 1), BIG + 1: (BIG + 1, 2), BIG + 3: (BIG + 1, 2)}
    assert keys(dart_minhash.drop_near_duplicates(docs)) == [None, BIG + 1]


def test_a_key_named_like_a_measure_is_refused(docs):
    with pytest.raises(ValueError, match="n_words"):
        rule_ledger.ledger(docs.withColumnRenamed("doc_id", "n_words"), key="n_words")


@pytest.mark.parametrize("n", [1_000_000])
def test_hostile_messages_take_linear_time(n):
    for text in ("<tool_call>" * (n // 11), "<tool_call></tool_result>" * (n // 25), "<tool_result><tool_call>" * (n // 24) + "</tool_call>"):
        began = time.process_time()
        events = tool_calls.read_events(text, "user", {})
        assert time.process_time() - began < 2
        assert len(events) <= 2


def test_events_are_split_like_the_nearest_close():
    rest, events = tool_calls.split_events("a<tool_call>x<tool_call>y</tool_result></tool_call>b</tool_call><tool_result>z</tool_result>c<tool_call>")
    assert rest == "ab</tool_call>c<tool_call>"
    assert events == [("call", "x<tool_call>y</tool_result>"), ("result", "z")]


def test_hostile_pages_take_linear_time():
    half = 500_000
    for page in ("<div>" * (half // 5) + "</foo>" * (half // 6), "<div>" * (half // 5) + "<li>x" * (half // 5), "<p>x<td>" * (half // 4)):
        began = time.process_time()
        html_tree.extract([page], html_tree.Weights())
        print(time.process_time() - began)
        assert time.process_time() - began < 5


def test_deep_nesting_loses_no_text():
    depth = 3 * html_tree.MAX_DEPTH
    tree = html_tree.parse("<div>a" * depth + "</div>b" * depth)
    assert "".join(x for x in tree.text if x) == "a" * depth + "b" * depth
    deepest = [0] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        deepest[i] = deepest[tree.parent[i]] + 1
    assert max(deepest) <= html_tree.MAX_DEPTH
