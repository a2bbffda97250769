"""File globs: ``*`` passes folders, ``?`` is one character, ``[seq]`` and ``[!seq]`` one of or none of a set."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """The regular expression of a whole match. An unclosed bracket stands for itself."""

    def one(piece: re.Match) -> str:
        text = piece.group(0)
        if text == "*":
            return ".*"
        if text == "?":
            return "."
        if len(text) > 1:
            inner = re.sub(r"([\[\]^&~\\])", r"\\\1", text[1:-1].removeprefix("!"))
            return f"[{'^' if text[1] == '!' else ''}{inner}]"
        return text if text.isalnum() else "\\" + text

    return "^(?s:" + re.sub(r"\[!?\]?[^\]]*\]|(?s:.)", one, glob) + ")$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a glob matches the whole relative path or the file name."""
    out, name = F.lit(False), F.substring_index(path, "/", -1)
    for glob in globs:
        pattern = F.lit(glob_pattern(glob))
        out = out | F.regexp_like(path, pattern) | F.regexp_like(name, pattern)
    return out
