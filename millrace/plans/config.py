"""Layered parameters: later layers override earlier ones key by key; all problems are told at once."""

from __future__ import annotations

from typing import Any


def layered(*layers: dict[str, Any]) -> dict[str, Any]:
    """Deep merge: mappings merge, anything else is replaced; None takes a key out."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            if v is None:
                out.pop(k, None)
            elif isinstance(v, dict) and isinstance(out.get(k), dict):
                out[k] = layered(out[k], v)
            else:
                out[k] = v
    return out


def check_bands(bands: list[dict[str, Any]]) -> None:
    """Raises ValueError with every problem of a list of bands {name, low, high}: order, overlap, repeated names."""
    problems = [f"{b.get('name')}: low {b.get('low')} is not below high {b.get('high')}" for b in bands if not (b.get("low") is not None and b.get("high") is not None and b["low"] < b["high"])]
    names = [b.get("name") for b in bands]
    problems += [f"{n}: named {names.count(n)} times" for n in dict.fromkeys(names) if names.count(n) > 1]
    good = sorted((b for b in bands if b.get("low") is not None and b.get("high") is not None and b["low"] < b["high"]), key=lambda b: b["low"])
    problems += [f"{a['name']} and {b['name']} overlap" for a, b in zip(good, good[1:]) if a["high"] > b["low"]]
    if problems:
        raise ValueError("; ".join(problems))
