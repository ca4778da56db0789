"""Prefix trie of conversations as a distributed burst trie.

A turn is the 128-bit hash of its role and text: its id. A conversation is the string of its turn ids; conversations
that are equal are one row with a count from the start, so copies cost nothing later. Rows are suffix containers
under trie heads: at first one container under the root. A container that holds too much bursts by the next turn id
into a container for each (turns that all its rows share are skipped in one go and become a chain of nodes under its
head); rows that end at the place of the burst stay with the head. So however many conversations share a beginning,
no container stays large unless it is one single conversation.

Containers are then dealt out to tasks, their rows sorted by turn ids and swept: neighbours show where a branch ends,
and nodes are closed with their totals. What lies above containers, the heads, adds up over the containers below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirepoix.sources import stage

#: Turns a container may hold; more where the table is so large that a round would burst over ``MOST_BURSTS`` heads.
CONTAINER_TURNS = 1024
#: Heads that burst in a round at most, which is what a round broadcasts.
MOST_BURSTS = 20_000
#: Ids of conversations joined into one string at a time.
IDS_AT_ONCE = 4096
#: Nodes in a batch of results.
NODES_AT_ONCE = 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
ID_BYTES = 16

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def sequences(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv_id, ids, sizes)`` of each conversation: its turn ids, one after the other, and the bytes of its texts.

    Turns go by ``turn_col``, null first; of equal ones the smaller id is first. Null roles and texts are empty, rows
    without a conversation are left out. What a task gathers of a conversation is a few bytes a turn, not its texts.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), key.alias("key"), F.octet_length(text).cast("bigint").alias("size")).alias("t"),
    )
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.unhex(F.array_join("t.key", "")).alias("ids"), F.col("t.size").alias("sizes"))


def with_shared_openings(own: DataFrame, group: int, most: int) -> DataFrame:
    """Conversations that begin with turns of another: ``c`` takes the first h of ``c - c % group`` (all if there are
    fewer, none if it is absent) in place of its own first h, where h = crc32 of the decimal ``c`` modulo ``most``."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    base = own.select(
        F.col("conv_id").alias("base"),
        F.substring("ids", 1, ID_BYTES * most).alias("base_ids"),
        F.slice("sizes", 1, most).alias("base_sizes"),
    )
    rows = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left")
    ids = F.concat(
        F.coalesce(F.substring("base_ids", F.lit(1), F.col("h") * ID_BYTES), F.lit(b"")),
        F.substring("ids", F.col("h") * ID_BYTES + 1, F.octet_length("ids")),
    )
    first = F.coalesce(F.slice("base_sizes", F.lit(1), F.col("h")), F.array().cast("array<bigint>"))
    rest = F.slice("sizes", F.col("h") + 1, F.size("sizes"))
    return rows.select("conv_id", ids.alias("ids"), F.concat(first, rest).alias("sizes"))


def _member_hashes(rows: DataFrame) -> DataFrame:
    """``(fp, ends)``: SHA-256 of the members' ids, ascending and comma-joined.

    Members are sorted in ranges over all of them, so that a class of any size is spread over tasks, which join ids
    into strings; one task then hashes the few strings of a class in order, holding one at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, held = None, 0, []
        out: list[tuple] = []
        for batch in batches:
            for fp, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fp != last or len(held) == IDS_AT_ONCE:
                    if held:
                        out.append((last, first, ",".join(held)))
                    last, first, held = fp, i, []
                held.append(str(i))
            if len(out) > 1000:
                yield _batch(out, joined_schema)
                out = []
        if held:
            out.append((last, first, ",".join(held)))
        if out:
            yield _batch(out, joined_schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for fp, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fp != last:
                    if state is not None:
                        out.append((last, state.hexdigest()))
                    last, state = fp, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield _batch(out, hashed_schema)
        if state is not None:
            yield _batch([(last, state.hexdigest())], hashed_schema)

    joined_schema = pa.schema({"fp": pa.string(), "first": pa.int64(), "ids": pa.string()})
    hashed_schema = pa.schema({"fp": pa.string(), "ends": pa.string()})
    parts = rows.select("fp", "conv_id").repartitionByRange("fp", "conv_id").sortWithinPartitions("fp", "conv_id")
    parts = parts.mapInArrow(joined, "fp string, first bigint, ids string")
    return parts.repartition("fp").sortWithinPartitions("fp", "first").mapInArrow(hashed, "fp string, ends string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def _turn(ids: Column | str, n: Column) -> Column:
    return F.substring(ids, (n - 1) * ID_BYTES + 1, F.lit(ID_BYTES))


def _shared(low: str, high: str) -> Column:
    """How many first turn ids the least and the greatest of a container's suffixes share: so do all between."""
    most = (F.least(F.octet_length(low), F.octet_length(high)) / ID_BYTES).cast("int")
    differ = F.transform(F.sequence(F.lit(1), most), lambda i: _turn(F.col(low), i) != _turn(F.col(high), i))
    first = F.array_position(differ, F.lit(True)).cast("int")
    return F.when(most == 0, 0).when(first == 0, most).otherwise(first - 1)


def burst(rows: DataFrame, container_turns: int = CONTAINER_TURNS) -> tuple[DataFrame, DataFrame | None]:
    """Rows dealt to containers, and the heads that burst.

    ``rows`` are distinct sequences ``(conv_id, n, ends, ids, sizes)``. Containers come as the same rows with ``head``
    (a hash of the turn ids above), ``at`` (their number) and ``path`` (the heads that burst above it); heads as
    ``(head, path, at, chain, conv_id, n_convs, ends)`` with the bytes of the texts from the head's own turn down the
    ``chain`` of nodes to the place where it branches. None instead of heads if nothing burst.
    """
    total = rows.agg(F.sum(F.size("sizes"))).head()[0] or 0
    limit = max(container_turns, total // MOST_BURSTS)
    active = rows.withColumns({"head": F.lit(""), "at": F.lit(0), "path": F.array().cast("array<string>")})
    settled, heads = [], []
    while True:
        suffix = F.substring("ids", F.col("at") * ID_BYTES + 1, F.octet_length("ids"))
        large = active.groupBy("head").agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.size("sizes") - F.col("at")).alias("turns"), F.min(suffix).alias("low"), F.max(suffix).alias("high")
        )
        # at most ``MOST_BURSTS`` hold more than the limit
        large = large.filter((F.col("rows") > 1) & (F.col("turns") > limit)).select("head", _shared("low", "high").alias("shared"))
        large = stage(large, "large")
        if large.isEmpty():
            settled.append(active)
            break
        settled.append(active.join(F.broadcast(large), "head", "left_anti"))
        place = F.col("at") + F.col("shared")
        moved = active.join(F.broadcast(large), "head").withColumns({"place": place, "ended": F.size("sizes") == place})
        below = F.md5(F.substring("ids", F.lit(1), (F.col("place") + 1) * ID_BYTES))
        moved = stage(moved.withColumn("below", below), "burst")
        texts = F.concat(F.array(F.lit(0).cast("bigint")), "sizes")
        heads.append(
            moved.groupBy("head").agg(
                F.first("path").alias("path"),
                F.first("at").alias("at"),
                F.first(F.slice(texts, F.col("at") + 1, F.col("shared") + 1)).alias("chain"),
                F.min("conv_id").alias("conv_id"),
                F.sum("n").alias("n_convs"),
                F.max(F.when(F.col("ended"), F.col("ends"))).alias("ends"),
            )
        )
        active = moved.filter("not ended").select(
            "conv_id", "n", "ends", "ids", "sizes", F.col("below").alias("head"), (F.col("place") + 1).alias("at"), F.concat("path", F.array("head")).alias("path")
        )
    containers, above = settled[0], None
    for part in settled[1:]:
        containers = containers.unionByName(part)
    for part in heads:
        above = part if above is None else above.unionByName(part)
    return containers, above


class _Node:
    """An open node of the sweep, and the rows of its closed children that wait for its smallest member."""

    __slots__ = ("children", "conv_id", "ends", "leaves", "n", "saved", "size", "waiting")

    def __init__(self, size: int):
        self.size, self.conv_id, self.n, self.ends = size, None, 0, NO_ENDS
        self.children = self.leaves = self.saved = 0
        self.waiting: list[list] = []

    def add(self, conv_id: int, n: int) -> None:
        self.n += n
        if self.conv_id is None or conv_id < self.conv_id:
            self.conv_id = conv_id


class _Sweep:
    """Turns the sorted rows of one container into nodes."""

    def __init__(self, at: int, path: list[str]):
        self.at, self.path = at, path
        self.stack: list[_Node] = []
        self.before = b""
        self.rows: list[list] = []

    def row(self, conv_id: int, n: int, ends: str, ids: bytes, sizes: list[int]) -> None:
        if self.stack:
            shared = _common(self.before, ids, self.at)
            while len(self.stack) - 1 + self.at > shared:
                self.close()
        depth = self.at + len(self.stack)
        self.stack.extend(_Node(sizes[d - 1] if d else 0) for d in range(depth, len(sizes) + 1))
        self.stack[-1].ends = ends
        self.stack[-1].add(conv_id, n)
        self.before = ids

    def close(self) -> None:
        node = self.stack.pop()
        depth = self.at + len(self.stack)
        for waiting in node.waiting:
            waiting[2] = node.conv_id
        self.rows.extend(node.waiting)
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.size
        own = [node.conv_id, depth, None, node.n, node.children, leaves, saved, node.ends, None]
        if self.stack:
            above = self.stack[-1]
            above.add(node.conv_id, node.n)
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            above.waiting.append(own)
        else:
            own[8] = self.path
            self.rows.append(own)

    def done(self) -> list[list]:
        while self.stack:
            self.close()
        return self.rows


def _common(a: bytes, b: bytes, known: int) -> int:
    """Turn ids that two sequences share from the first on, ``known`` at least."""
    most = min(len(a), len(b)) // ID_BYTES
    if most - known > 64:
        x = np.frombuffer(a, "V16", most)[known:] != np.frombuffer(b, "V16", most)[known:]
        return known + int(x.argmax()) if x.any() else most
    while known < most and a[known * ID_BYTES : (known + 1) * ID_BYTES] == b[known * ID_BYTES : (known + 1) * ID_BYTES]:
        known += 1
    return known


def sweep(containers: DataFrame) -> DataFrame:
    """The nodes of all containers, the node of a head with its ``path`` and without a parent."""
    schema = pa.schema(
        {name: pa.string() if name == "ends_sha256" else pa.int64() for name in (f.split()[0] for f in NODE.split(", "))}
        | {"path": pa.list_(pa.string())}
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now, out = None, None, []
        for batch in batches:
            for own, at, path, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != head:
                    if now is not None:
                        out.extend(now.done())
                    head, now = own, _Sweep(at, path)
                now.row(*row)
                while len(out) >= NODES_AT_ONCE:
                    yield _batch(out[:NODES_AT_ONCE], schema)
                    del out[:NODES_AT_ONCE]
        if now is not None:
            out.extend(now.done())
        for i in range(0, len(out), NODES_AT_ONCE):
            yield _batch(out[i : i + NODES_AT_ONCE], schema)

    rows = containers.select("head", "at", "path", "conv_id", "n", "ends", "ids", "sizes")
    return rows.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(run, f"{NODE}, path array<string>")


def trie(rows: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """All nodes of the trie of ``rows`` ``(conv_id, ids, sizes)``, one a conversation; see :func:`conversation_trie`."""
    rows = stage(rows.withColumn("fp", F.md5("ids")), "conversations")
    classes = rows.groupBy("fp").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first("ids").alias("ids"), F.first("sizes").alias("sizes")
    )
    classes = stage(classes.join(_member_hashes(rows), "fp").drop("fp"), "classes")
    containers, heads = burst(classes, container_turns)
    names = [f.split()[0] for f in NODE.split(", ")]
    if heads is None:
        return sweep(containers).select(names)
    heads = stage(heads, "heads")
    swept = stage(sweep(containers), "swept")
    tops = swept.filter("path is not null").withColumn("above", F.element_at("path", -1))

    members = F.size("chain")
    own = heads.select("path", ((F.col("n_convs") - 1) * F.aggregate("chain", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("saved"), F.lit(0).cast("bigint").alias("leaves"))
    # totals of what lies below a head, whatever the number of heads between
    below = tops.select("path", F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves")).unionByName(own)
    below = below.select(F.explode("path").alias("head"), "saved", "leaves").groupBy("head").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    children = tops.select("above").unionByName(heads.filter("size(path) > 0").select(F.element_at("path", -1).alias("above")))
    children = children.groupBy(F.col("above").alias("head")).agg(F.count(F.lit(1)).alias("children"))
    # at most ``MOST_BURSTS`` short rows a round
    parents = F.broadcast(heads.select(F.col("head").alias("above"), F.col("conv_id").alias("above_conv_id")))

    tops = tops.join(parents, "above", "left").withColumn("parent_conv_id", F.col("above_conv_id"))
    chains = heads.join(below, "head").join(children, "head").withColumn("above", F.try_element_at("path", F.lit(-1)))
    chains = chains.join(parents, "above", "left").withColumn("place", F.explode(F.sequence(F.lit(0), members - 1)))
    is_last = F.col("place") == members - 1
    under = F.aggregate(F.slice("chain", F.col("place") + 1, members), F.lit(0).cast("bigint"), lambda a, x: a + x)
    chains = chains.select(
        "conv_id",
        (F.col("at") + F.col("place")).cast("bigint").alias("depth"),
        F.when(F.col("place") == 0, F.col("above_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(is_last, F.col("children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * under).alias("saved_tokens"),
        F.when(is_last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    inner = swept.filter("path is null").select(names)
    return inner.unionByName(tops.select(names)).unionByName(chains.select(names))


def conversation_trie(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    group: int | None = None,
    opening: int = 9,
    container_turns: int = CONTAINER_TURNS,
) -> DataFrame:
    """One row a node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (smallest member of the parent, null
    at the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes of its subtree, itself included),
    ``saved_tokens`` (over its subtree, members but one times the UTF-8 bytes of the node's last text) and
    ``ends_sha256`` (of the ids of members that end there, ascending and comma-joined).

    A node is a distinct sequence of first turns (role and text), the root the empty one. With ``group``, conversations
    first take openings of others (:func:`with_shared_openings`), which may leave one without turns: it ends at the
    root. Order, nulls and rows without a conversation: see :func:`sequences`; repeated rows are turns of their own. An
    empty table has no nodes. Other columns are ignored, whatever their names.
    """
    rows = sequences(turns, conv_col, turn_col, role_col, text_col)
    if group:
        rows = with_shared_openings(stage(rows, "own"), group, opening)
    return trie(rows, container_turns)
