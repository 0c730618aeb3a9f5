"""Chat formatting: links tool calls with their results and serialises canonical JSON.

In a message's text a call is ``<tool_call>{"id", "name", "arguments"}</tool_call>``
and a result ``<tool_result>{"id", "content"}</tool_result>``; a call may use an
earlier result by ``{"$ref": "<call id>"}`` anywhere in its arguments.  Calls and
results are joined by conversation and identifier, calls are put in topological
order by their references, arguments are checked against the tools' schemas, and
every event becomes one line of canonical JSON.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, durable, durable_with, table, tidied

_TAG = re.compile(r"<(/?)tool_(call|result)>")
_EVENTS = (
    "conv_id {key}, turn long, idx long, kind string, role string, call_id string, name string, body string, "
    "refs array<string>, problems array<string>"
)
#: Schemas of the tools that op4 knows; others are a parameter.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}
#: Nesting of a call's or result's JSON beyond which it is unreadable.
MAX_DEPTH = 64
#: Conversations of so many references at most are ordered in one pass; longer ones level by level, by joins.
ONE_PASS = 20_000
#: The registry of schemas goes to every worker; a larger one is refused.
MAX_SCHEMA_BYTES = 8_000_000


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks and no needless escapes; whole floats as integers."""

    def plain(x):
        if isinstance(x, bool) or x is None or isinstance(x, (int, str)):
            return x
        if isinstance(x, float):
            return int(x) if x == int(x) and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x]

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constants(name: str):
    raise ValueError(f"{name} is not JSON")


def _finite(text: str) -> float:
    if not math.isfinite(x := float(text)):
        raise ValueError(f"{text} is too large")
    return x


def read_json(text: str) -> object:
    """Refuses (ValueError) what is no JSON, not finite, nested deeper than MAX_DEPTH, or not writable as UTF-8 (lone surrogates)."""
    try:
        value = json.loads(text, parse_constant=_no_constants, parse_float=_finite)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level = [value]
    for _ in range(MAX_DEPTH):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            break
    else:
        raise ValueError("nested too deep")
    canonical(value).encode()  # a lone surrogate is a UnicodeEncodeError, which is a ValueError
    return value


_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "integer": lambda x: not isinstance(x, bool) and (isinstance(x, int) or isinstance(x, float) and x == int(x)),
    "number": lambda x: not isinstance(x, bool) and isinstance(x, (int, float)),
}


def check_schema(value: object, schema: Mapping, at: str = "$") -> Iterator[str]:
    """What is wrong with ``value``, for the commonly used part of JSON Schema.  A reference to a result fits any schema."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        yield f"{at}: not {' or '.join(kinds)}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at}: not one of the listed values"
    if "const" in schema and value != schema["const"]:
        yield f"{at}: not the given value"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            yield f"{at}: length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield f"{at}: pattern"
    elif _TYPES["number"](value):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            yield f"{at}: range"
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            yield f"{at}: number of items"
        for i, x in enumerate(value):
            yield from check_schema(x, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                yield f"{at}.{name}: missing"
        for name, x in sorted(value.items()):
            if name in known:
                yield from check_schema(x, known[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{name}: not allowed"


def references(value: object) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"}:
            return {str(value["$ref"])}
        return set().union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def split_events(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text outside of events, and each event's kind and body; one pass from the end to find each tag's close, one forwards.

    An opening tag goes to the next closing one of its kind, whatever is between;
    one that has none, or a stray closing tag, is text.
    """
    tags = list(_TAG.finditer(text))
    close: list[re.Match | None] = [None] * len(tags)
    nearest: dict[str, re.Match] = {}
    for i in range(len(tags) - 1, -1, -1):
        close[i] = nearest.get(tags[i][2])
        if tags[i][1]:
            nearest[tags[i][2]] = tags[i]
    rest, events, at = [], [], 0
    for tag, end in zip(tags, close):
        if tag.start() >= at and not tag[1] and end is not None:
            rest.append(text[at : tag.start()])
            events.append((tag[2], text[tag.end() : end.start()]))
            at = end.end()
    return "".join([*rest, text[at:]]), events


def read_events(text: str | None, role: str | None, schemas: Mapping[str, Mapping]) -> list[dict]:
    """The message itself, then its calls and results in order; what cannot be read is kept with its problems."""
    rest, events = split_events(text or "")
    out = [{"kind": "message", "body": canonical({"content": rest, "role": role}), "problems": []}]
    for kind, raw in events:
        event: dict = {"problems": [], "refs": []}
        try:
            value = read_json(raw)
            if not isinstance(value, dict) or not isinstance(value.get("id"), (str, int)) or isinstance(value.get("id"), bool):
                raise ValueError("no id")
        except ValueError:
            out.append({"kind": kind, "body": canonical({"raw": raw}), "problems": ["unreadable"], "refs": []})
            continue
        event |= {"kind": kind, "call_id": str(value["id"])}
        if kind == "call":
            name, arguments = str(value.get("name")), value.get("arguments", {})
            event |= {"name": name, "refs": sorted(references(arguments))}
            if name in schemas:
                event["problems"] = list(check_schema(arguments, schemas[name]))
            else:
                event["problems"] = ["unknown tool"]
            event["body"] = canonical({"arguments": arguments, "id": event["call_id"], "name": name})
        else:
            event["body"] = canonical({"content": value.get("content"), "id": event["call_id"]})
        out.append(event)
    return out


def message_events(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row for each message, call and result; a map, nothing is shuffled."""
    if len(canonical(schemas)) > MAX_SCHEMA_BYTES:
        raise ValueError("the registry of schemas is too large to send to every worker")
    sent = messages.sparkSession.sparkContext.broadcast(dict(schemas))
    key = messages.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            of, rows = [], []
            for k, (role, text) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())):
                for i, e in enumerate(read_events(text, role, sent.value)):
                    of.append(k)
                    rows.append((i, e["kind"], role, e.get("call_id"), e.get("name"), e["body"], e.get("refs", []), e["problems"]))
            kinds = [pa.int64(), *[pa.string()] * 5, *[pa.list_(pa.string())] * 2]
            made = [pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            # keys are taken as Arrow arrays: pandas would round large ones beside a null
            keys = [batch.column(c).take(pa.array(of, pa.int64())) for c in ("conv_id", "turn")]
            yield pa.RecordBatch.from_arrays([*keys, *made], ["conv_id", "turn", "idx", "kind", "role", "call_id", "name", "body", "refs", "problems"])

    kept = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return bounded_batches(kept).mapInArrow(tidied(run), _EVENTS.format(key=key))


def levels_of(edges: list[tuple[str, str]]) -> dict[str, int | None]:
    """Level of each call of one conversation in (call, ref) pairs, None in or behind a cycle."""
    waiting, users, level = defaultdict(int), defaultdict(list), {}
    for call, ref in set(edges):
        waiting[call] += 1
        users[ref].append(call)
    ready = deque(ref for ref in users if not waiting.get(ref))
    level = dict.fromkeys(ready, 0)
    while ready:
        ref = ready.popleft()
        for call in users.get(ref, ()):
            waiting[call] -= 1
            level[call] = max(level.get(call, 0), level[ref] + 1)
            if not waiting[call]:
                ready.append(call)
    return {call: None if waiting.get(call) else level[call] for call in {*waiting, *users}}


def topological_levels(calls: DataFrame, one_pass: int = ONE_PASS) -> DataFrame:
    """conv_id, call_id, level for calls (conv_id, call_id, refs): 0 without references, else one more than the highest level referred to.

    A conversation's references are ordered in one pass, if they are ``one_pass``
    at most; those of longer ones level by level, by joins.  A call in a cycle,
    or behind one, gets a null level.  References to calls that are not there are
    ignored.
    """
    known = calls.select("conv_id", F.col("call_id").alias("ref"))
    edges = calls.select("conv_id", "call_id", F.explode("refs").alias("ref")).distinct().join(known, ["conv_id", "ref"])
    edges, seen = durable_with(edges.select("conv_id", "call_id", "ref"), n=F.count("*"))
    free = calls.select("conv_id", "call_id").withColumn("level", F.lit(0))
    if not seen["n"]:
        return free
    sizes = durable(edges.groupBy("conv_id").agg(F.count("*").alias("n")))
    short = edges.join(sizes.where(F.col("n") <= one_pass).select("conv_id"), "conv_id")

    def order(batch: pd.DataFrame) -> pd.DataFrame:
        found = levels_of(list(zip(batch["call_id"], batch["ref"])))
        out = pd.DataFrame({"call_id": list(found), "level": pd.array(list(found.values()), "Int64")})
        out.insert(0, "conv_id", batch["conv_id"].iloc[0])
        return out

    linked = short.groupBy("conv_id").applyInPandas(order, f"conv_id {calls.schema['conv_id'].dataType.simpleString()}, call_id string, level int")
    if not sizes.where(F.col("n") > one_pass).isEmpty():
        linked = linked.unionByName(_levels_by_joins(durable(edges.join(sizes.where(F.col("n") > one_pass).select("conv_id"), "conv_id"))))
    linked = durable(linked)
    return free.join(linked.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").unionByName(linked)


def _levels_by_joins(edges: DataFrame) -> DataFrame:
    """``topological_levels`` of the calls in ``edges``; each round settles a level."""
    pair = ["conv_id", "call_id"]
    calls = durable(edges.select(*pair).union(edges.select("conv_id", "ref")).distinct())
    waiting = durable(edges.groupBy(*pair).agg(F.count("*").alias("missing")))
    frontier = durable(calls.join(waiting, pair, "left_anti"))
    done, level = frontier.withColumn("level", F.lit(0)), 0
    while True:
        level += 1
        met = edges.join(frontier.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"]).groupBy(*pair).agg(F.count("*").alias("n"))
        waiting = durable(waiting.join(met, pair, "left").select(*pair, (F.col("missing") - F.coalesce("n", F.lit(0))).alias("missing")))
        frontier, seen = durable_with(waiting.where("missing = 0").select(*pair), n=F.count("*"))
        if not seen["n"]:
            return done.unionByName(waiting.select(*pair, F.lit(None).cast("int").alias("level")))
        waiting = waiting.where("missing > 0")
        done = done.unionByName(frontier.withColumn("level", F.lit(level)))
        if level % 20 == 0:  # else the plan grows with the number of levels
            done, waiting = durable(done), durable(waiting)


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, Mapping] = SCHEMAS, one_pass: int = ONE_PASS) -> DataFrame:
    """Events of conversations (conv_id, turn, role, text), linked and with their place in the order.

    Columns: conv_id, turn, idx, kind (message, call, result), call_id, level,
    place, status, problems, json.  Sorted by conv_id and place, the json lines
    are the conversations: by turn, the message first, then calls and results by
    level, a result behind its call, calls of cycles last (``write_conversations``).
    Status of a call: ok, invalid (schema), no_result, early (its result stands
    before it), cycle, duplicate (a later call with the same id) or unreadable;
    of a result: ok, no_call, early, duplicate or unreadable.  Unreadable is what
    is no JSON object with an id, has lone surrogates or numbers that are not
    finite, or is nested deeper than MAX_DEPTH.

    Nulls: a null text is an empty message; a null conv_id is a conversation
    of its own, in which nothing is linked; a null turn sorts first.  A repeated message's
    calls are duplicates of the first's.  An empty table gives no rows; other
    columns are not carried.  A conversation may be of any length: it is gathered
    only for its references, if these are few.
    """
    events = durable(message_events(messages, schemas).withColumn("uid", F.monotonically_increasing_id()))
    key, asking = ["conv_id", "call_id"], F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    place = F.struct(F.coalesce("turn", F.lit(-1)).alias("t"), "idx", "body", "uid")
    chosen = lambda kind, value: F.min(F.when(F.col("kind") == kind, value))
    pairs = durable(events.where(asking).groupBy(*key).agg(chosen("call", place).alias("asked"), chosen("result", place).alias("answered")))
    calls = events.where(asking & F.expr("kind = 'call' AND size(refs) > 0")).join(pairs.select(*key, F.col("asked.uid").alias("uid")), [*key, "uid"])
    # calls without references are level 0 and may be referred to
    heads = pairs.where("asked IS NOT NULL").select(*key).join(calls.select(*key, "refs"), key, "left")
    levels = topological_levels(heads.withColumn("refs", F.coalesce("refs", F.array().cast("array<string>"))), one_pass)
    linked = pairs.join(levels, key, "left")
    status = (
        F.when(F.expr("kind = 'message'"), "ok")
        .when(F.col("call_id").isNull(), "unreadable")
        .when(F.expr("kind = 'call' AND uid <> asked.uid OR kind = 'result' AND uid <> answered.uid"), "duplicate")
        .when(F.expr("kind = 'call' AND level IS NULL AND asked IS NOT NULL"), "cycle")
        .when(F.expr("kind = 'call' AND size(problems) > 0"), "invalid")
        .when(F.expr("kind = 'call' AND answered IS NULL"), "no_result")
        .when(F.expr("kind = 'result' AND asked IS NULL"), "no_call")
        .when(F.expr("answered.t < asked.t OR answered.t = asked.t AND answered.idx < asked.idx"), "early")
        .otherwise("ok")
    )
    last = F.when(F.col("asked").isNotNull(), F.lit(999_999_999))
    step = F.when(F.col("kind") == "message", 0).otherwise(1 + F.coalesce("level", last, F.lit(0)))
    order = F.format_string("%019d.%010d.%d.%010d", F.coalesce("turn", F.lit(-1)) + 1, step, (F.col("kind") == "result").cast("int"), "idx")
    joined = events.join(linked, key, "left").withColumns({"status": status, "place": order})
    level = F.when(F.col("kind") == "call", F.col("level")).cast("int")
    return joined.select("conv_id", "turn", "idx", "kind", "call_id", level.alias("level"), "place", "status", "problems", F.col("body").alias("json"))


def write_conversations(linked: DataFrame, path: str, files: int | None = None) -> None:
    """The conversations as lines of canonical JSON, in order within and across files; a long one runs over several files."""
    ordered = linked.repartitionByRange(files or linked.sparkSession.sparkContext.defaultParallelism, "conv_id", "place").sortWithinPartitions("conv_id", "place")
    ordered.select("json").write.text(path)


def op4_tool_call_linking(spark, sf_dir):
    linked = link_tool_calls(table(spark, sf_dir, "conversations"))
    return linked.withColumn("problems", F.array_join("problems", "; "))
