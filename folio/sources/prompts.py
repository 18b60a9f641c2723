"""Prompt templates: named text files with {section}, {topic} and {text} places."""

from __future__ import annotations

import string
from pathlib import Path

SHIPPED = Path(__file__).resolve().parent.parent / "resources" / "prompts"
PLACES = {"section", "topic", "text"}


def load_prompt(name: str = "review", folder: str | None = None) -> str:
    """The template of this name, from a folder or as shipped; ValueError if it could not be filled."""
    path = Path(folder or SHIPPED) / f"{name}.txt"
    if path.name != f"{name}.txt" or not path.is_file():
        raise ValueError(f"no prompt {name}")
    text = path.read_text(encoding="utf-8")
    found = {field for _, field, _, _ in string.Formatter().parse(text) if field is not None}
    if "text" not in found or found - PLACES:
        raise ValueError(f"prompt {name} needs the place text and may use {', '.join(sorted(PLACES))}")
    return text
