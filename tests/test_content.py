"""Message content to plain text against a recursive rule, to any depth."""
import json
import random

import pytest
from pyspark.sql import functions as F

from decisionlake.functions.content import flatten_content

TEXTS = ("text", "input_text", "output_text", "reasoning_text")


def block(b):
    if isinstance(b, str):
        return b
    if not isinstance(b, dict):
        return None
    kind, text = b.get("type"), b.get("text") or None
    if (kind is None or kind in TEXTS) and text:
        return text
    if kind == "tool_use":
        return f"[tool_use: {b.get('name', '?')}] {json.dumps(b.get('input', {}))[:300]}"
    if kind == "tool_result":
        return "[tool_result] " + flat(b.get("content"), 300)[:300]
    if kind == "thinking" and b.get("thinking"):
        return "[thinking] " + b["thinking"]
    return text


def flat(content, most):
    if content is None or isinstance(content, str):
        return content or ""
    if not isinstance(content, (list, dict)):
        return json.dumps(content)
    text = "\n".join(p for p in map(block, content if isinstance(content, list) else [content]) if p)
    return text if len(text) <= most else f"{text[:most]}\n…[truncated {len(text) - most} chars]"


def result(*blocks):
    return {"type": "tool_result", "content": list(blocks)}


def anything(depth):
    if depth and random.random() < 0.5:
        inner = [anything(depth - 1) for _ in range(random.randint(0, 3))]
        return {"type": "tool_result", "content": random.choice([inner, anything(depth - 1)])}
    return random.choice([
        {"type": "text", "text": "t" * random.randint(0, 400)}, "plain", 5, None, {"type": "tool_use", "name": "grep", "input": {"q": 'a,b: "c', "n": 1}},
        {"type": "tool_result", "content": "s" * random.choice([3, 400])}, {"type": "tool_result", "content": 7}, {"type": "tool_result"},
        {"type": "thinking", "thinking": "hm"}, {"type": "image"}, result()])


def texts(spark, contents, most=600):
    df = spark.createDataFrame([(i, json.dumps({"content": c})) for i, c in enumerate(contents)], "i int, line string").repartition(4)
    got = flatten_content(F.try_variant_get(F.try_parse_json("line"), "$.content", "variant"), F.get_json_object("line", "$.content"), most)
    return {r.i: r.t for r in df.select("i", got.alias("t")).collect()}


def test_random_content(spark):
    random.seed(4)
    contents = [[anything(random.randint(0, 6)) for _ in range(random.randint(0, 4))] if random.random() < 0.7 else anything(4) for _ in range(300)]
    assert texts(spark, contents) == {i: flat(c, 600) for i, c in enumerate(contents)}


@pytest.mark.parametrize("most", [600, 100_000])
def test_any_depth(spark, most):
    contents = []
    for depth in (1, 3, 5, 40, 150):
        inner = "deep"
        for _ in range(depth):
            inner = result(inner, "after")
        contents.append([inner, {"type": "text", "text": "end"}])
    smallest = result()                                     # nothing but results
    for _ in range(30):
        smallest = {"type": "tool_result", "content": smallest}
    contents.append(smallest)
    contents.append([result(*["x" * 200] * 5), result(result("a"), "b", result("c"))])
    assert texts(spark, contents, most) == {i: flat(c, most) for i, c in enumerate(contents)}
