"""Model services over HTTP, as functions for reviewers, retrieval and model lists.

Requests are JSON; post is the transport (url, headers, body -> answer), which tests replace.
"""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Post = Callable[[str, dict, bytes | None], bytes]


def http(url: str, headers: dict, body: bytes | None, timeout: float = 120.0) -> bytes:
    """POST of body, or GET without one."""
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def _call(post: Post, url: str, key: str, body: dict | None) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    return json.loads(post(url, headers, None if body is None else json.dumps(body, ensure_ascii=False).encode()))


def chat(base_url: str, model: str, key: str = "", post: Post = http, **options) -> Callable[..., str]:
    """A client for review.asked(): answer to a prompt, with an optional system text."""

    def ask(prompt: str, system: str | None = None) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        reply = _call(post, f"{base_url}/chat/completions", key, {"model": model, "messages": messages, "temperature": 0.0} | options)
        return reply["choices"][0]["message"].get("content") or ""

    return ask


def chat_with_tools(base_url: str, model: str, tools: list[dict], call: Callable[[str, str], str], key: str = "", post: Post = http, rounds: int = 8) -> Callable[..., str]:
    """As chat, but a model may call tools (name, JSON arguments -> JSON answer) for so many rounds."""

    def ask(prompt: str, system: str | None = None) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        for _ in range(rounds):
            said = _call(post, f"{base_url}/chat/completions", key, {"model": model, "messages": messages, "tools": tools})["choices"][0]["message"]
            if not said.get("tool_calls"):
                return said.get("content") or ""
            messages.append(said)
            messages += [{"role": "tool", "tool_call_id": c["id"], "content": call(c["function"]["name"], c["function"]["arguments"])} for c in said["tool_calls"]]
        return ""

    return ask


def look(base_url: str, model: str, key: str = "", post: Post = http) -> Callable[[str, list[bytes]], str]:
    """Answer to a prompt about PNG images."""

    def ask(prompt: str, images: list[bytes]) -> str:
        shown = [{"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(x).decode()}} for x in images]
        reply = _call(post, f"{base_url}/chat/completions", key, {"model": model, "messages": [{"role": "user", "content": [{"type": "text", "text": prompt}, *shown]}]})
        return reply["choices"][0]["message"].get("content") or ""

    return ask


def embedded(texts: DataFrame, base_url: str, model: str, key: str = "", post: Post = http, size: int = 64, text_col: str = "text") -> DataFrame:
    """texts with their embedding, asked for size texts at a time; a failed call fails the task, which Spark repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), size):
                asked = b.slice(at, size)  # leaves the task before the next call
                reply = _call(post, f"{base_url}/embeddings", key, {"model": model, "input": [x or "" for x in asked.column(text_col).to_pylist()]})
                found = [x["embedding"] for x in sorted(reply["data"], key=lambda x: x["index"])]
                yield pa.record_batch([*asked.columns, pa.array(found, pa.list_(pa.float32()))], [*asked.schema.names, "embedding"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, f"{columns}, embedding array<float>")


def listed_models(spark: SparkSession, backends: dict[str, tuple[str, str]], post: Post = http) -> DataFrame:
    """Models of services (name -> base URL, key): backend, model_id, capabilities; by backend and name. A service that fails lists none."""
    rows = []
    for name, (url, key) in backends.items():
        try:
            data = _call(post, f"{url}/models", key, None).get("data") or []
        except (OSError, ValueError):
            data = []
        rows += [(name, x["id"], {k: bool(v) for k, v in (x.get("capabilities") or {}).items()}) for x in data if x.get("id")]
    return spark.createDataFrame(rows, "backend string, model_id string, capabilities map<string,boolean>").orderBy(F.col("backend"), F.col("model_id"))
