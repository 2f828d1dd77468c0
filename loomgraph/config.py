"""Settings: command line over configuration file over defaults."""

from __future__ import annotations

import json
import os
from dataclasses import fields, replace
from typing import Any

from loomgraph.operators.extraction import ENTITY_TYPES
from loomgraph.operators.walks import WalkConfig


def load(path: str | None) -> dict[str, Any]:
    """A JSON file, or YAML where the yaml module is there; none, or an empty one, gives
    {}, and so does a section without entries."""
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        found = json.loads(text) if text.strip() else {}
    except ValueError:
        import yaml

        found = yaml.safe_load(text) or {}
    return {k: {} if v is None else v for k, v in found.items()}


def pick(*values: Any) -> Any:
    """The first value that is given; 0 and "" count as not given."""
    return next((v for v in values[:-1] if v), values[-1])


def walk_config(settings: dict[str, Any], num_walks: int | None = None, seed: int | None = None) -> WalkConfig:
    """The walk section, and the graph section's factor for crossing chunks."""
    known = {f.name for f in fields(WalkConfig)}
    cfg = replace(WalkConfig(), **{k: v for k, v in settings.get("walk", {}).items() if k in known and v is not None})
    alpha = settings.get("graph", {}).get("cross_chunk_multiplier")
    cfg = cfg if alpha is None else replace(cfg, cross_chunk_alpha=alpha)
    return replace(cfg, num_walks=pick(num_walks, cfg.num_walks), seed=cfg.seed if seed is None else seed)


def endpoint(section: dict[str, Any], base_url: str | None, api_key: str | None, model: str | None, more: list[str] | None = None) -> dict[str, Any]:
    """urls, api_key, model and concurrency. The environment stands in for the key only."""
    first = pick(base_url, section.get("base_url"), "http://localhost:8000/v1")
    return {
        "urls": [first, *(more or section.get("extra_base_urls") or [])],
        "api_key": pick(api_key, os.environ.get("OPENAI_API_KEY"), section.get("api_key"), "EMPTY"),
        "model": pick(model, section.get("model"), "default"),
        "concurrency": pick(section.get("concurrent_requests"), 8),
    }


def entity_types(settings: dict[str, Any]) -> tuple[str, ...]:
    return tuple(settings.get("extraction", {}).get("entity_types") or ENTITY_TYPES)
