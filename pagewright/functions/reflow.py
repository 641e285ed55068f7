"""Fitting text into boxes: breaks at the best place, wraps, smaller type, and cuts. Each rule looks for a place or a size by trying, so these are
vectorised pandas functions over text_width's widths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.functions import lexicons as L
from pagewright.functions.values import PARTICLES

CLASSES = [(re.compile(pattern), width) for pattern, width in L.WIDTHS]
CLOSING = re.compile(r"[\s,;:.\-]+$")


class Widths(dict):
    def __missing__(self, c: str) -> float:
        self[c] = w = next((width for pattern, width in CLASSES if pattern.match(c)), L.OTHER_WIDTH)
        return w


WIDTH = Widths()


def width(text: str, size: float) -> float:
    return sum(map(WIDTH.__getitem__, text)) * size


def clean_end(line: str) -> str:
    """Without closing punctuation, and then without a particle at the end."""
    return PARTICLES.sub("", CLOSING.sub("", line.rstrip()))


def breaks(text: str) -> Iterator[tuple[int, int]]:
    """(rank, where the second line would start): semicolons, commas, slashes, dashes, before a conjunction, blanks."""
    for i, c in enumerate(text):
        alone = text[i - 1 : i] == " " and text[i + 1 : i + 2] == " " and i > 0
        if c == ";":
            yield 1, i + 1
        elif c == ",":
            yield 2, i + 1
        elif c == "/" and alone:
            yield 3, i + 1
        elif c == "-" and alone:
            yield 4, i + 1
        elif c == " ":
            yield (5 if text[i + 1 : i + 4] in ("et ", "ou ") else 6), i


def split_in_two(text: str, room: float, size: float) -> tuple[str, str, bool]:
    """First line, rest, and whether the break is at a sign or conjunction: the best rank of break that fits, and of that the last one."""
    text = text.strip()
    if not text or width(text, size) <= room:
        return text, "", True
    fitting = [(rank, -at) for rank, at in breaks(text) if width(text[:at].rstrip(), size) <= room]
    if fitting:
        rank, at = min(fitting)
        return clean_end(text[:-at]), text[-at:].lstrip(), rank < 6
    at = next((i for i in range(len(text), 0, -1) if width(text[:i], size) <= room), 1)
    return text[:at], text[at:].lstrip(), False


def wrap(text: str, room: float, size: float) -> list[str]:
    """Words in lines that fit; a longer word is a line of its own."""
    lines: list[str] = []
    for word in text.split():
        if lines and width(f"{lines[-1]} {word}", size) <= room:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
    return lines


def shortened(text: str, room: float, size: float) -> str:
    """A text cut behind a word, or within the only one, with an ellipsis that fits as well."""
    if width(text, size) <= room:
        return text
    room, end = room - width("…", size), len(text)
    while end > 0:
        blank = text.rfind(" ", 0, end)
        end = blank if blank >= 0 else end - 1
        if width(text[:end], size) <= room:
            return re.sub(r"[\s,;:.-]+$", "", text[:end]) + "…"
    return "…"


def fitted(text: str, room: float, size: float, least: float, lines: int = 1, step: float = 0.5) -> tuple[list[str], float, str]:
    """Lines, size of type, and how: as it is, wrapped, in smaller type, both, or cut at the least size."""
    text, lines = text.strip(), max(1, lines)
    if not text or room <= 0 or width(text, size) <= room:
        return [text], size, "fits-as-is"

    def wrapped(at: float) -> list[str] | None:
        out = wrap(text, room, at)
        return out if len(out) <= lines and all(width(x, at) <= room for x in out) else None

    if out := wrapped(size):
        return out, size, "wrapped"
    now = size - step
    while now >= least:
        if width(text, now) <= room:
            return [text], now, "shrunk"
        if out := wrapped(now):
            return out, now, "wrapped-shrunk"
        now -= step
    out = wrap(text, room, least)
    return [*out[: lines - 1], shortened(" ".join(out[lines - 1 :]), room, least)] if len(out) >= lines else [*out[:-1], shortened(out[-1], room, least)], least, "truncated"


def letters_wrapped(text: str, room: float, size: float) -> list[str]:
    """Lines of as many characters as fit on average, 20 at least; longer words are broken."""
    most, lines, open_line = max(20, int(room // (size * 0.55))), [], False
    for word in text.split():
        if len(word) > most:
            lines += [word[i : i + most] for i in range(0, len(word), most)]
            open_line = False
        elif open_line and len(lines[-1]) + 1 + len(word) <= most:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
            open_line = True
    return lines


def split_lines(x: Column, room: float, size: float) -> Column:
    """split_in_two() of a column: first, rest, clean. Null counts as empty."""
    kind = "struct<first: string, rest: string, clean: boolean>"

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_in_two(v or "", room, size) for v in values], columns=["first", "rest", "clean"])

    return run(x)


def fit_lines(x: Column, room: float, size: float, least: float, lines: int = 1, step: float = 0.5) -> Column:
    """fitted() of a column: lines, size, how. Null counts as empty."""
    kind = "struct<lines: array<string>, size: double, how: string>"

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fitted(v or "", room, size, least, lines, step) for v in values], columns=["lines", "size", "how"])

    return run(x)


def shorten(x: Column, room: float, size: float) -> Column:
    """shortened() of a column; null stays null."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: shortened(v, room, size), na_action="ignore")

    return run(x)
