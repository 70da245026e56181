"""Settings of a run from a YAML or JSON file, read once on the driver; paths in it count from its folder."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass, replace
from pathlib import Path
from typing import Any


def settings(path: str, paths: tuple[str, ...] = ("weights",)) -> dict[str, Any]:
    """The tree of a settings file; an empty file is an empty tree.  Keys named in ``paths``, at any depth, are made absolute.

    YAML needs PyYAML; without it only files that are JSON too can be read.
    """
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        tree = yaml.safe_load(text)
    except ImportError:
        tree = json.loads(text) if text.strip() else None
    if tree is None:
        return {}
    if not isinstance(tree, dict):
        raise ValueError("settings must be a mapping")
    base = Path(path).resolve().parent

    def solved(node: Any, name: str = "") -> Any:
        if isinstance(node, dict):
            return {k: solved(v, k) for k, v in node.items()}
        return str(base / node) if name in paths and isinstance(node, str) and node else node

    return solved(tree)


def applied(defaults: Any, tree: dict[str, Any]) -> Any:
    """A dataclass of defaults with the values of a tree; unknown keys raise, as a misspelt setting would be ignored otherwise."""
    if not is_dataclass(defaults):
        raise TypeError("defaults must be a dataclass")
    unknown = set(tree) - {f.name for f in fields(defaults)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(defaults, **tree)
