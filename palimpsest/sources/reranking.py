"""Reranking endpoints in three dialects behind one function: reranker(query, texts) -> scores."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Sequence

from palimpsest.operators.search import rerank_budget

TIMEOUT = 10.0
#: Windows in tokens of models that are known by name; others are taken to have the least (fixed values).
WINDOWS = {"bge-reranker-base": 512, "bge-reranker-large": 512, "bge-reranker-v2-m3": 8192}
LEAST_WINDOW = 512
Reranker = Callable[[str, Sequence[str]], list[float]]


def window(model: str | None) -> int:
    return WINDOWS.get((model or "").rsplit("/", 1)[-1].lower(), LEAST_WINDOW)


def request_body(style: str, model: str | None, query: str, texts: Sequence[str]) -> tuple[str, dict]:
    """(path, body) of a request."""
    if style == "tei":
        return "/rerank", {"query": query, "texts": list(texts), "truncate": False}
    if style in ("cohere", "voyage"):
        return "/v1/rerank", {"model": model, "query": query, "documents": list(texts)}
    raise ValueError(f"unknown style {style!r}")


def response_scores(style: str, answer, n: int) -> list[float]:
    """A score for each text by its index in the answer; an index out of bounds or missing is an error."""
    rows = answer if style == "tei" else answer["results"] if style == "cohere" else answer["data"]
    out: list[float | None] = [None] * n
    for r in rows:
        i = r["index"]
        if not 0 <= i < n:
            raise ValueError(f"index {i} outside 0..{n - 1}")
        out[i] = float(r["score"] if style == "tei" else r["relevance_score"])
    if None in out:
        raise ValueError("a text has no score")
    return out


def http_reranker(base_url: str, model: str | None = None, style: str = "tei", api_key: str | None = None, timeout: float = TIMEOUT) -> Reranker:
    """A reranker that asks an endpoint; texts are cut to what fits beside the query, a query too long is an error."""

    def rank(query: str, texts: Sequence[str]) -> list[float]:
        room = rerank_budget(query, window(model))
        if room is None:
            raise ValueError("rerank_query_too_long")
        if not texts:
            return []
        path, body = request_body(style, model, query, [t.strip()[:room] for t in texts])
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        with urllib.request.urlopen(urllib.request.Request(base_url.rstrip("/") + path, json.dumps(body).encode(), headers), timeout=timeout) as r:
            return response_scores(style, json.load(r), len(texts))

    return rank
