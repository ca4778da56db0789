"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel edit distance.

An item with an error budget of ``k`` edits is cut into ``k + 1`` pieces: where it occurs with at most ``k``
edits, one piece is untouched. The cut is done by halves, so a budget also holds for every larger part that
contains the piece; a piece that is found is checked part by part up to the whole item, and chance hits end
at the first, shortest part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.common import map_texts
from mirepoix.sources import stage

#: Edits allowed for each character of an item.
ERROR_RATE = 0.1
#: Characters of items that one pass over the documents looks for; more items take more passes.
PASS_CHARS = 2_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


@dataclass(frozen=True)
class Part:
    """Characters ``lo`` to ``hi`` of an item, to be found within ``budget`` edits."""

    lo: int
    hi: int
    budget: int


def cut(lo: int, hi: int, budget: int, above: tuple[Part, ...] = ()) -> Iterator[tuple[Part, ...]]:
    """For each untouchable piece the parts that contain it, smallest first.

    Halves get budgets that add up to one less than the whole's: both cannot be exceeded.
    """
    parts = (Part(lo, hi, budget), *above)
    if not budget:
        yield parts
        return
    left = (budget - 1) // 2
    middle = lo + (hi - lo) * (left + 1) // (budget + 1)
    yield from cut(lo, middle, left, parts)
    yield from cut(middle, hi, budget - 1 - left, parts)


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(pattern: dict[str, int], length: int, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any stretch of ``text``, and where the first such stretch ends;
    None if it is above ``budget``. A column of the distance matrix is two integers of ``length`` bits."""
    full = (1 << length) - 1
    last = 1 << (length - 1)
    up, down, score = full, 0, length
    # the empty stretch is as far away as the pattern is long
    best, end = min(length, budget + 1), 0
    for i, c in enumerate(text):
        eq = pattern.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | (~(horizontal | up) & full)
        minus = up & horizontal
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (~(vertical | plus) & full)
        down = plus & vertical
        if score < best:
            best, end = score, i + 1
            if not best:
                break
    return (best, end) if best <= budget else None


class Finder:
    """Finds items in texts; ``items`` are (id, normalised text) pairs."""

    def __init__(self, items: tuple[tuple[object, str], ...], error_rate: float):
        self.items = items
        self.automaton = ahocorasick.Automaton()
        self.masks: dict[tuple[int, Part], dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, tuple[Part, ...]]]] = {}
        for n, (_, text) in enumerate(items):
            for parts in cut(0, len(text), int(len(text) * error_rate)):
                pieces.setdefault(text[parts[0].lo : parts[0].hi], []).append((n, parts))
                for part in parts[1:]:
                    if (n, part) not in self.masks:
                        self.masks[n, part] = masks(text[part.lo : part.hi])
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """The best occurrence of each item: (id, distance, start or less, end) in the normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        if not len(self.automaton):
            return []
        tried: set[tuple[int, int]] = set()
        for end, (length, owners) in self.automaton.iter(text):
            at = end + 1 - length
            for n, parts in owners:
                origin = at - parts[0].lo
                if (n, origin) in tried:
                    continue
                hit = self._verify(n, parts, origin, text)
                if hit is None:
                    continue
                # the other pieces of the same occurrence need no check
                tried.add((n, origin))
                if n not in best or hit < best[n]:
                    best[n] = hit
        return [(self.items[n][0], d, start, end) for n, (d, start, end) in sorted(best.items())]

    def _verify(self, n: int, parts: tuple[Part, ...], origin: int, text: str) -> tuple[int, int, int] | None:
        whole = parts[-1]
        hit, start = (0, whole.hi), max(0, origin)
        for part in parts[1:]:
            start = max(0, origin + part.lo - whole.budget)
            window = text[start : max(0, origin + part.hi + whole.budget)]
            hit = myers(self.masks[n, part], part.hi - part.lo, window, part.budget)
            if hit is None:
                return None
        if len(parts) == 1:
            return 0, start, start + whole.hi
        end = start + hit[1]
        return hit[0], max(0, end - whole.hi), end


@lru_cache(maxsize=2)
def finder(items: tuple, error_rate: float) -> Finder:
    return Finder(items, error_rate)


def with_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = ERROR_RATE,
    pass_chars: int = PASS_CHARS,
    column: str = "leaks",
) -> DataFrame:
    """``docs`` with ``column``: the benchmark items that occur in the text within ``error_rate`` edits a
    character, as an array of ``(item_id, distance, start, end)``.

    Texts and items are compared lower-cased with white space as single spaces; positions are of that form
    and the start supposes equal length. Null or empty texts hold no item, null or empty items occur
    nowhere, items repeated in the benchmark are reported once an id. All columns, whatever their names, and repeated
    rows of ``docs`` are kept; one named ``column`` is replaced. Items are brought to the tasks ``pass_chars`` characters at a time, one pass over
    the documents for each.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).alias("text"))
    items = items.filter("length(text) > 0")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_chars))
    kind = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"
    # columns travel under numbers; one that is named like the result is replaced
    names = [c for c in docs.columns if c != column]
    kept = [f"c{i}" for i in range(len(names))]
    out = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept, strict=True)],
        F.col(f"`{text_col}`").alias("look"),
        F.array().cast(kind).alias("leaks"),
    )
    for k in range(passes):
        mine = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).distinct().orderBy("id", "text").collect()
        coded = tuple((r["id"], t) for r in mine if (t := normalised(r["text"])))
        out = map_texts(out, "look", [*kept, "look", "leaks"], _rows(coded, error_rate), f"more {kind}")
        out = out.select(*kept, "look", F.concat("leaks", "more").alias("leaks"))
        if passes > 1:  # else every pass would keep a Python worker of its own in each task
            out = stage(out, "leaks")
    return out.select(*kept, "leaks").toDF(*names, column)


def _rows(items: tuple, error_rate: float):
    fields = ("item_id", "distance", "start", "end")

    def rows(texts: list) -> Iterator[tuple]:
        found = finder(items, error_rate)
        return (([dict(zip(fields, hit, strict=True)) for hit in found.find(normalised(t))],) for t in texts)

    return rows
