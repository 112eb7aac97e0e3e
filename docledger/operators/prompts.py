"""Prompts for a batch inference stage, by what was tried before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from .attempts import FOCUSED, SECOND, SELF

#: Wording, our own: by rung, None for the first reading. {error}, {output}, {focus} and {text} are filled in.
PROMPTS = {
    None: "Read this receipt and answer with one JSON object of date, total and items.\n\nText:\n{text}",
    SELF: "Your answer was not valid: {error}\nIt was: {output}\nCorrect it, and answer with one JSON object.\n\nText:\n{text}",
    FOCUSED: "Look at these lines first, and answer with one JSON object:\n{focus}\n\nWhole text:\n{text}",
    SECOND: "Look at the picture again; this was read from it before:\n{text}\nAnswer with one JSON object.",
}


def prompt(rung: Column, slip: Column, error: Column, output: Column) -> Column:
    """The prompt for a text at a rung of the retry ladder (null: the first reading): a correction carries the error and the
    earlier output, a focused one the lines with prices and totals before the whole text. Missing parts are empty."""
    values = {"text": slip, "error": error, "output": output, "focus": text.focused(slip)}
    out = _filled(PROMPTS[None], values)
    for name, words in PROMPTS.items():
        if name:
            out = F.when(rung == name, _filled(words, values)).otherwise(out)
    return out


def _filled(words: str, values: dict[str, Column]) -> Column:
    parts = []
    for piece in words.replace("{", "\0{").replace("}", "}\0").split("\0"):
        name = piece[1:-1] if piece.startswith("{") else None
        parts.append(F.coalesce(values[name], F.lit("")) if name else F.lit(piece))
    return F.concat(*parts)
