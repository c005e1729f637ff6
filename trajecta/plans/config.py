"""Settings from YAML files with inheritance (``_base_``), overrides and pretty text."""

from __future__ import annotations

import argparse
import ast
import os
from typing import Any

import yaml


class Settings(dict):
    """A nested dict whose keys are attributes too; absent ones raise AttributeError."""

    def __init__(self, values: dict | None = None) -> None:
        super().__init__({k: self._wrap(v) for k, v in (values or {}).items()})

    @classmethod
    def _wrap(cls, v: Any) -> Any:
        if isinstance(v, dict):
            return cls(v)
        if isinstance(v, list):
            return [cls._wrap(x) for x in v]
        if isinstance(v, str) and v[:1] == "(" and v[-1:] == ")":  # YAML has no tuples
            try:
                return ast.literal_eval(v)
            except (ValueError, SyntaxError):
                return v
        return v

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    def merged(self, other: dict) -> Settings:
        """``other`` on top; a nested dict with ``_delete_`` replaces instead of merging."""
        out = dict(self)
        for k, v in other.items():
            if isinstance(v, dict) and isinstance(out.get(k), dict) and not v.get("_delete_"):
                out[k] = Settings(out[k]).merged(v)
            else:
                out[k] = {a: b for a, b in v.items() if a != "_delete_"} if isinstance(v, dict) else v
        return Settings(out)

    def with_options(self, options: dict[str, Any]) -> Settings:
        """Dotted keys on top, such as ``{"track.age": 3}``."""
        out = self
        for key, v in options.items():
            nested: Any = v
            for part in reversed(key.split(".")):
                nested = {part: nested}
            out = out.merged(nested)
        return out

    def plain(self) -> dict:
        return {k: v.plain() if isinstance(v, Settings) else v for k, v in self.items()}

    @property
    def pretty_text(self) -> str:
        return yaml.safe_dump(self.plain(), sort_keys=False)


def load(path: str) -> Settings:
    if not path.endswith((".yml", ".yaml")):
        raise ValueError("settings are YAML files")
    with open(path) as f:
        own = yaml.safe_load(f) or {}
    bases = own.pop("_base_", [])
    out = Settings()
    for b in [bases] if isinstance(bases, str) else bases:
        out = out.merged(load(os.path.join(os.path.dirname(path), b)))
    return out.merged(own)


def parser_for(settings: Settings, parser: argparse.ArgumentParser | None = None, prefix: str = "") -> argparse.ArgumentParser:
    """An argument for each plain value; bool before int, since a bool is an int."""
    parser = parser or argparse.ArgumentParser()
    for k, v in settings.items():
        if isinstance(v, Settings):
            parser_for(v, parser, f"{prefix}{k}.")
        elif isinstance(v, bool):
            parser.add_argument(f"--{prefix}{k}", action=argparse.BooleanOptionalAction)
        elif isinstance(v, (int, float, str)):
            parser.add_argument(f"--{prefix}{k}", type=type(v))
    return parser
