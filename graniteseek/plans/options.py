"""Options of the plans, with the library defaults."""

from __future__ import annotations

import dataclasses
import json
import os
import tempfile
from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    search_max_results: int = 10
    search_top_k: int = 10
    search_max_results_to_keep: int = 5
    search_rrf_cutoff: float = 0.0
    search_dense_weight: float = 0.5
    scrape_max_tokens: int = 2000
    scrape_max_links: int = 8
    link_prefilter: int = 100
    chunk_rrf_cutoff: float = 0.0
    chunk_dense_weight: float = 0.5
    chunk_max_results_to_keep: int = 2
    chunk_rank_oversample: int = 3
    chunk_dedupe_jaccard_threshold: float = 0.92
    chunk_semantic_dedupe_enabled: bool = True
    chunk_semantic_dedupe_threshold: float = 0.92
    chunk_max_per_source_url: int = 4
    crawl_fit_markdown_mode: str = "bm25"
    crawl_fit_min_chars: int = 200
    crawl_bm25_threshold: float = 1.5
    crawl_pruning_threshold: float = 0.48
    crawl_max_chunk_tokens: int = 300
    crawl_overlap_tokens: int = 80
    crawl_max_page_tokens: int = 0
    dense_query_prefix: str = ""
    dense_document_prefix: str = ""
    blocked_domains: tuple[str, ...] = ()
    search_backend: str = "ddgs"
    search_backend_fallback: bool = True
    trace_path: str = ""

    @classmethod
    def of(cls, *layers: dict) -> Options:
        """Defaults overridden by each layer in turn; values are coerced to their option's kind, unknown names dropped."""
        kinds = {f.name: f for f in dataclasses.fields(cls)}
        out: dict = {}
        for layer in layers:
            for name, value in layer.items():
                if name in kinds and value is not None:
                    out[name] = _coerced(value, kinds[name].default)
        return cls(**out)

    @classmethod
    def load(cls, path: str | None = None, environment: dict[str, str] | None = None, prefix: str = "GRANITESEEK_") -> Options:
        """Defaults, then a JSON file, then the environment."""
        stored = {}
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                stored = json.load(f)
        found = {k[len(prefix) :].lower(): v for k, v in (os.environ if environment is None else environment).items() if k.startswith(prefix)}
        return cls.of(stored, found)

    def save(self, path: str) -> None:
        """Written beside the target and moved into place, so that no reader sees half of it."""
        handle, partial = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(dataclasses.asdict(self), f, indent=2)
        os.replace(partial, path)


def _coerced(value, default):
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        parts = value.split(",") if isinstance(value, str) else value
        return tuple(dict.fromkeys(p.strip() for p in parts if p.strip()))
    return type(default)(value)


def redacted(values: dict) -> dict:
    """A mapping that may be logged: secrets are hidden."""
    hide = ("secret", "token", "api_key", "password")
    return {k: "***" if v and any(h in k.lower() for h in hide) and not isinstance(v, int | float) else v for k, v in values.items()}


def checked_batch(items: list[dict]) -> list[dict]:
    """One to five items with a url, maybe a query and maybe a positive max_tokens; anything else is an error."""
    if not isinstance(items, list) or not 1 <= len(items) <= 5:
        raise ValueError("a batch has 1 to 5 items")
    for item in items:
        if not isinstance(item, dict) or not isinstance(item.get("url"), str) or not item["url"].strip():
            raise ValueError("an item needs a url")
        if item.get("query") is not None and not isinstance(item["query"], str):
            raise ValueError("a query is text or nothing")
        tokens = item.get("max_tokens")
        if tokens is not None and (isinstance(tokens, bool) or not isinstance(tokens, int) or tokens <= 0):
            raise ValueError("max_tokens is a positive integer")
    return items


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    return limit
