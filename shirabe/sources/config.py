"""The TOML configuration of a scan, looked for from a folder upward."""

from __future__ import annotations

import re
import tomllib
import warnings
from pathlib import Path

from ..detect import rules as R
from ..detect.engine import Config

NAME = ".shirabe.toml"
_KNOWN = {"": {"min_confidence", "rules", "allowlist"}, "rules": {"disabled", "high_recall", "cooccurrence_boost", "path_demotion", "exclude_kinds", "custom"}, "allowlist": {"paths", "regexes", "stopwords"}}


def find(start: str) -> Path | None:
    """The nearest configuration file from ``start`` up to the root of its repository."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        if (folder / NAME).is_file():
            return folder / NAME
        if (folder / ".git").exists():
            return None
    return None


def parse(text: str) -> Config:
    """Unknown keys are warned of; broken regexes and taken rule ids are errors."""
    doc = tomllib.loads(text)
    rules, allow = doc.get("rules", {}), doc.get("allowlist", {})
    for part, table in (("", doc), ("rules", rules), ("allowlist", allow)):
        for key in set(table) - _KNOWN[part]:
            warnings.warn(f"unknown key {part + '.' if part else ''}{key}", stacklevel=2)
    custom = tuple(R.custom_rule(c["id"], c["pattern"], c.get("description", ""), c.get("confidence", "medium"), c.get("context", ()), "full" if c.get("negative_context") else "", c.get("require_context", False), c.get("digit_guard", False), c.get("context_window", 0)) for c in rules.get("custom", ()))
    for p in allow.get("regexes", ()):
        re.compile(p)
    levels = {v: k for k, v in R.LEVELS.items()}
    config = Config(
        min_confidence=levels[doc.get("min_confidence", "medium")], high_recall=rules.get("high_recall", False), disabled=tuple(rules.get("disabled", ())), custom=custom, boost=rules.get("cooccurrence_boost", True), path_demotion=rules.get("path_demotion", True),
        exclude_kinds=tuple(rules.get("exclude_kinds", ())), stopwords=tuple(allow.get("stopwords", ())), allow=tuple(allow.get("regexes", ())), allow_paths=tuple(allow.get("paths", ())),
    )
    R.selected(config.high_recall, config.disabled, config.custom)
    return config


def load(start: str = ".") -> Config:
    path = find(start)
    return parse(path.read_text(encoding="utf-8")) if path else Config(min_confidence=R.MEDIUM)
