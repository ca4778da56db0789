"""Personal data by candidate gradient boosting, in DataFrame operations only.

Patterns with a check give the base spans. Loose generators propose further spans, which overlap each other
and the base spans. Format and context features of the candidates are small numbers, so candidates fall into
a bounded number of cells; boosted trees are fitted on the cells (candidates count as weights), with
overlap with a base span as the label. The threshold for each generator is calibrated on a share of the documents,
by the hash of their id, that the trees have not seen: the lowest score from which on the demanded share of their
candidates is right. Cells above it are redacted too.

A text may hold any number of hits: the time grows with the text and its hits, not with their product.
Arrays that lambdas look things up in are bound once (``_let``), running sums go in runs, and pieces of a text are
taken from blocks of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirepoix.sources import stage

# Possessive repetition and a look behind make the patterns linear in the text and change no match: a match
# could only begin later within a run of the same characters after one from its beginning has failed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of fewer than 16 digits fail the check anyway.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Loose generators: an address with the sign written in words or spaced, dotted groups, groups of digits.
LOOSE = {
    "contact": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]{1,64}+(?:\x20?@\x20?|\x20?[(\[]at[)\]]\x20?)[^\x20\x09-\x0D@]{2,64}",
    "dotted": r"(?<![0-9.])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}+(?![0-9])",
    "number": r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20().-]{0,2}+[0-9]){6,18}+(?![0-9A-Za-z])",
}
#: Words before a candidate that speak for personal data.
CUES = r"(?i)(?:mail|phone|tel|call|fax|mobil|contact|card|carte|tarjeta|karte|iban|account|address|host|server)[^\x20]{0,12}\x20?$"
CONTEXT = 24
#: Candidates above the threshold are right in this share of all cases.
PRECISION = 0.95
TREES, DEPTH = 8, 3
#: One document in so many is kept from the trees and sets the thresholds.
HELD_OUT = 4
#: Elements of an array that are added up in one go, and code points of a block of text.
RUN, BLOCK = 128, 512

_SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside lambdas of ``body`` it would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima) of an array of bigint from 0 up.

    Appending copies an array, so runs of ``RUN`` elements are added up apart and then moved by what came before.
    """
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint"))
    added = lambda a: F.aggregate(a, none, lambda acc, x: F.array_append(acc, combine(last(acc), x)))

    def runs(a: Column) -> Column:
        places = F.sequence(F.lit(0), ((F.size(a) - 1) / RUN).cast("int"))
        return F.transform(places, lambda i: added(F.slice(a, i * RUN + 1, RUN)))

    def moved(each: Column) -> Column:
        before = added(F.transform(each, last))
        zero = F.lit(0).cast("bigint")
        return _let(
            before,
            lambda b: F.flatten(F.transform(each, lambda r, i: F.transform(r, lambda x: combine(F.coalesce(F.get(b, i - 1), zero), x)))),
        )

    return _let(values, lambda a: _let(runs(a), moved))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _blocks(text: Column) -> Column:
    """``text`` in blocks of ``BLOCK`` code points; a place in a string is only found by walking from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of the text the blocks are of."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.floor((end - 1) / BLOCK).cast("int") - first + 1
    part = F.array_join(F.slice(blocks, first + 1, count), "")
    return F.substring(part, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))


def _found(text: Column, pattern: str, possible: Column) -> Column:
    """All matches with their places (code points), left to right.

    The pieces between the matches give the places: each starts where the lengths before it add up to.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    paired = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("length"), h.alias("hit")))
    paired = F.filter(paired, lambda p: p["hit"].isNotNull())

    def placed(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda p: (p["gap"] + p["length"]).cast("bigint")), _plus)

        def span(p: Column, end: Column) -> Column:
            return F.struct((end - p["length"]).alias("start"), end.alias("end"), p["hit"].alias("hit"))

        return F.zip_with(pairs, ends, span)

    return F.when(possible, _let(paired, placed).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "")
    value = F.transform(each, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    total = F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    digits = _digits(hit)
    if kind == "ip":
        return hit.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _passes(kind, s["hit"]))


def _as_spans(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> list[Column]:
    """An array column of ``(start, end, hit)`` named after each of ``KINDS``."""
    possible = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike("[0-9][0-9\x20-]{14}"),
        "phone": text.contains("+"),
    }
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
    return [_checked(kind, _found(text, patterns[kind], possible[kind])).alias(kind) for kind in KINDS]


def _bucket(value: Column, *edges: int) -> Column:
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _side(character: Column) -> Column:
    return (
        F.when(F.length(character) == 0, 0)
        .when(character.rlike(r"^[\x20\x09-\x0D]"), 1)
        .when(character.rlike("^[A-Za-z]"), 2)
        .when(character.rlike("^[0-9]"), 3)
        .otherwise(4)
    )


#: Features and the number of values of each; a cell is a mixed-radix number of all.
FEATURES = {"generator": 3, "length": 4, "digits": 5, "marks": 4, "plus": 2, "check": 2, "before": 5, "after": 5, "cue": 2}


def _features(blocks: Column, generator: int, span: Column) -> dict[str, Column]:
    hit = span["hit"]
    digits = _digits(hit)
    before = _cut(blocks, F.greatest(span["start"] - CONTEXT, F.lit(0)), span["start"])
    check = (F.length(digits).between(16, 19) & _luhn(digits)) | (hit.rlike(r"\.[A-Za-z]{2,}$"))
    return {
        "generator": F.lit(generator),
        "length": _bucket(F.length(hit), 12, 20, 32),
        "digits": _bucket(F.length(digits), 4, 8, 13, 16),
        "marks": _bucket(F.length(F.regexp_replace(hit, "[A-Za-z0-9]", "")), 1, 3, 5),
        "plus": F.when(hit.contains("+") | hit.contains("@"), 1).otherwise(0),
        "check": F.when(check, 1).otherwise(0),
        "before": _side(F.substring(before, -1, 1)),
        "after": _side(_cut(blocks, span["end"], span["end"] + 1)),
        "cue": F.when(before.rlike(CUES), 1).otherwise(0),
    }


def _cell(features: dict[str, Column]) -> Column:
    cell = F.lit(0)
    for name, values in FEATURES.items():
        cell = cell * values + features[name]
    return cell.cast("int")


def _counted(places: Column, at: Column, inclusive: bool) -> Column:
    """For each of the ascending, different places ``at``: how many of ``places`` lie before it (or at it)."""
    event = lambda n: lambda x: F.struct(x.alias("at"), F.lit(n ^ inclusive).alias("side"), F.lit(n).cast("bigint").alias("n"))
    events = F.array_sort(F.concat(F.transform(places, event(1)), F.transform(at, event(0))))

    def counts(all_events: Column) -> Column:
        sums = _running(F.transform(all_events, lambda e: e["n"]), _plus)
        each = F.zip_with(all_events, sums, lambda e, s: F.struct(e["n"].alias("n"), s.alias("s")))
        return F.transform(F.filter(each, lambda e: e["n"] == 0), lambda e: e["s"])

    return _let(events, counts)


def _described(found: Column, base: Column, blocks: Column, n: int, kind: str) -> Column:
    """Candidates with cell and label. More base spans begin before a candidate's end than end by its start
    exactly if one of them overlaps it."""
    begun = _counted(F.transform(base, lambda b: b["start"]), F.transform(found, lambda s: s["end"]), False)
    over = _counted(F.transform(base, lambda b: b["end"]), F.transform(found, lambda s: s["start"]), True)
    overlaps = F.zip_with(begun, over, lambda a, b: a > b)

    def candidate(s: Column, overlap: Column) -> Column:
        cell = _cell(_features(blocks, n, s)).alias("cell")
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), cell, overlap.alias("label"))

    return F.zip_with(found, overlaps, candidate)


def _chosen(cells: list[int]) -> Column:
    if not cells:
        return F.filter("candidates", lambda c: F.lit(False))
    return F.filter("candidates", lambda c: ~c["label"] & c["cell"].isin(cells))


_CANDIDATE = "array<struct<kind:string,start:bigint,end:bigint,cell:int,label:boolean>>"


def candidates(text: Column) -> Column:
    """Array of ``(kind, start, end, cell, label)`` of the loose generators, made from ``text`` and the columns of
    :func:`base_spans`; the label says whether a base span overlaps."""
    base = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    possible = {
        "contact": text.contains("@") | text.contains("(at)") | text.contains("[at]"),
        "dotted": text.rlike(r"[0-9]\x20?\."),
        "number": text.rlike("[0-9][\x20().0-9-]{5}"),
    }

    def made(kind: str, n: int, pattern: str) -> Column:
        def described(found: Column) -> Column:
            seen = F.struct(base.alias("base"), _blocks(text).alias("blocks"))
            each = _let(seen, lambda x: _described(found, x["base"], x["blocks"], n, kind))
            return F.when(F.size(found) > 0, each.cast(_CANDIDATE)).otherwise(F.array().cast(_CANDIDATE))

        return _let(_found(text, pattern, possible[kind]), described)

    return F.concat(*[made(kind, n, pattern) for n, (kind, pattern) in enumerate(LOOSE.items())]).alias("candidates")


def chosen_cells(found: DataFrame, precision: float = PRECISION) -> list[int]:
    """Cells of candidates to redact besides the base spans; at most as many as ``FEATURES`` allow.

    ``found`` has ``id`` and the candidates of all documents. Empty if labels do not differ among those the trees
    may see, or if there are no others to calibrate on.
    """
    held = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(HELD_OUT)) == 0
    each = found.select(held.alias("held"), F.explode("candidates").alias("c"))
    count = lambda what: F.coalesce(F.sum(F.when(what, 1)), F.lit(0)).cast("bigint")
    seen, right = ~F.col("held"), F.col("c.label")
    cells = each.groupBy(F.col("c.cell").alias("cell")).agg(
        count(seen).alias("n"), count(seen & right).alias("right"), count(~seen).alias("held_n"), count(~seen & right).alias("held_right")
    )
    # bounded by the product of FEATURES: one partition is enough
    cells = stage(cells.coalesce(1), "cells")
    total = cells.agg(F.sum("n").alias("n"), F.sum("right").alias("right")).first()
    if not total["right"] or total["right"] == total["n"]:
        return []
    values, left = [], F.col("cell")
    for name, size in reversed(FEATURES.items()):
        values.append((left % size).cast("double").alias(name))
        left = F.floor(left / size)
    described = cells.select("cell", "n", "right", "held_n", "held_right", *values)
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described)
    sides = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("right").cast("double").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("right")).cast("double").alias("weight")),
    )
    training = assembled.select("features", F.explode(sides).alias("s")).select("features", "s.label", "s.weight").filter("weight > 0")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, weightCol="weight", seed=7, featuresCol="features")
    model = trees.fit(stage(training.coalesce(1), "training"))
    scored = model.transform(assembled).select("cell", "generator", "held_n", "held_right", vector_to_array("probability")[1].alias("score")).collect()
    chosen: list[int] = []
    for generator in range(len(LOOSE)):
        own = sorted((r for r in scored if r["generator"] == generator), key=lambda r: (-r["score"], r["cell"]))
        n = right = best = 0
        for i, r in enumerate(own):
            n, right = n + r["held_n"], right + r["held_right"]
            if n and right >= precision * n:
                best = i + 1
        chosen += [r["cell"] for r in own[:best]]
    return sorted(chosen)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """``(id_col, email, ip, card, phone, added)``, one row a document; each an array of spans.

    Base spans are ``(start, end)``, those the trees add ``(kind, start, end)`` with the kinds of ``LOOSE``;
    an added span overlaps no base span. Places are code points, ends exclusive. Null and empty texts have
    empty arrays; repeated rows come out repeatedly; other columns are ignored.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = _with_candidates(source, "id")
    cells = chosen_cells(found, precision)
    added = F.transform(_chosen(cells), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), *KINDS, added.alias("added"))


def _with_candidates(source: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the base spans (without their text) and the candidates of ``text``, staged."""
    found = source.select(*source.columns, *base_spans(F.col("text")))
    plain = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS]
    return stage(found.select(*keep, *plain, candidates(F.col("text"))), "candidates")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the base spans of ``text_col`` replaced by ``<email>``, ``<ip>`` and so on.

    Spans of different kinds may overlap: one that begins inside an earlier one is redacted with it. Null
    texts stay null; all other columns and rows are kept, whatever their names.
    """
    # columns travel under numbers, so that no name can clash or need quotes
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    raw, own = F.col(f"c{docs.columns.index(text_col)}"), f"c{docs.columns.index(id_col)}"
    text = F.coalesce(raw, F.lit(""))
    found = _with_candidates(numbered.withColumn("text", text), *numbered.columns)
    cells = chosen_cells(found.select(F.col(own).alias("id"), "candidates"))
    spans = [_as_spans(k, F.col(k)) for k in KINDS]
    spans.append(F.transform(_chosen(cells), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))

    def pieces(ordered: Column) -> Column:
        return _let(_running(F.transform(ordered, lambda s: s["end"]), F.greatest), lambda reach: rest(ordered, reach))

    def rest(ordered: Column, reach: Column) -> Column:
        def piece(blocks: Column) -> Callable[[Column, Column], Column]:
            def of(s: Column, i: Column) -> Column:
                at = F.coalesce(F.get(reach, i - 1), F.lit(0).cast("bigint"))
                return F.when(s["start"] >= at, F.concat(_cut(blocks, at, s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise("")

            return of

        def whole(blocks: Column) -> Column:
            tail = _cut(blocks, F.element_at(reach, -1), (F.size(blocks) * BLOCK).cast("bigint"))
            return F.concat(F.array_join(F.transform(ordered, piece(blocks)), ""), tail)

        return _let(_blocks(text), whole)

    clean = F.when(F.size(F.col("ordered")) > 0, _let(F.col("ordered"), pieces)).otherwise(raw)
    found = found.withColumn("ordered", F.array_sort(F.concat(*spans)))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def joined(kind: str | None, spans: Column) -> Column:
    """The spans as an array of ``kind:start:end``; with None they carry their kind."""
    return F.transform(
        spans,
        lambda s: F.concat_ws(":", F.lit(kind) if kind else s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
