"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct word shingles. A signature keeps the minimum and the maximum of the
set under each permutation (two values for one evaluation), bands of the signature are bucket keys, and
documents that share a bucket are compared on their full sets. Documents with equal sets are one class
from the start, so exact copies cost nothing later.

Inside a bucket a member needs no link to every other one, only to its component. So a member is first compared with
the smallest centre of its buckets (one comparison a document), then with its other centres where those are still
in another component. A bucket that is in several components even then is compared in blocks of members: a task
holds two blocks, compares signatures, and verifies on full sets the pairs that lie in different components and
whose signatures allow the similarity. It returns the links that join components, never the pairs. So no link
between members of a bucket is lost, whatever its size, and the number of rows stays in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.common import MinMaxHash, components, fingerprint, map_texts, shingles, signed, spread_join, word_hashes
from mirepoix.sources import stage, unstage

#: 48 permutations give 96 values in 24 bands of 4: a pair at similarity 0.8 is missed with 3e-6.
PERMUTATIONS, BANDS = 48, 24
#: Members of a block of an open bucket.
BLOCK = 512
#: Blocks from this size compare signatures before sets. A pair at similarity 0.8 agrees in at least this share of the
#: values less ``SLACK``, but for 1 in 10,000.
SIGNED_FROM, SLACK = 24, 0.15


def _described(k: int):
    def rows(texts: list) -> Iterator[tuple]:
        hashing = MinMaxHash(PERMUTATIONS, BANDS)
        for text in texts:
            found = shingles(word_hashes(text), k)
            yield (len(found), fingerprint(found), hashing.keys(found) if len(found) else None)

    return rows


def _sets(k: int):
    def rows(texts: list) -> Iterator[tuple]:
        for text in texts:
            yield (signed(shingles(word_hashes(text), k)),)

    return rows


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, one row a document.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets; a component
    is named by its smallest id and keeps that document. Null or empty texts and texts without a word have
    ``n_shingles`` 0 and link with nothing; shorter ones than ``shingle_words`` are one shingle. Ids must be
    unique and not null; other columns are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    described = stage(
        map_texts(source, "text", ["id"], _described(shingle_words), "n bigint, fp binary, keys array<bigint>"),
        "shingled",
    )
    classes = stage(described.filter("n > 0").groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    reps = described.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    reps = stage(reps.select("id", "n", "keys"), "reps")

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = source.join(wanted, "id", "left_semi")
        return map_texts(texts, "text", ["id"], _sets(shingle_words), "items array<bigint>")

    groups = linked_groups(reps, sets_of, percent)
    named = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = stage(named.select("fp", F.coalesce("component", "rep").alias("component")), "named")
    unstage(reps, classes, groups)
    # only classes that are more than one document, or linked, differ from the id itself
    out = spread_join(described.select("id", "n", "fp"), named, ["fp"], "id")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def linked_groups(reps: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``(node, component)`` of the linked ones among ``reps``, rows ``(id, keys)`` with distinct sets.

    ``sets_of`` gives ``(id, items)`` for a table of ids: those that share a bucket with another.
    """
    members = reps.select("id", F.explode("keys").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("center"))
    sizes = stage(sizes.filter("size > 1"), "bucket_sizes")
    members = stage(members.join(sizes, "bucket"), "members")
    unstage(sizes)
    sets = stage(sets_of(members.select("id").distinct()), "sets")
    others = members.filter("id <> center")

    nearest = others.groupBy(F.col("id").alias("a")).agg(F.min("center").alias("b"))
    links = _verified(nearest, sets, percent)
    groups = components(links)

    of_center = groups.select(F.col("node").alias("center"), F.col("component").alias("center_component"))
    rest = _labelled(others, groups).join(of_center, "center", "left")
    rest = rest.filter(F.col("component") != F.coalesce("center_component", "center"))
    more = _verified(rest.select(F.col("id").alias("a"), F.col("center").alias("b")), sets, percent)
    links, groups = _extended(links, more, groups)

    # pairs with the centre are done
    labelled = _labelled(others.filter("size > 2"), groups)
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    mixed = mixed.filter("c0 <> c1").select("bucket")
    left = stage(labelled.join(mixed, "bucket", "left_semi").select("bucket", "id", "component", "size"), "open_members")
    more = stage(_linked_in_blocks(left, sets, percent), "links")
    unstage(left, sets, members)
    return _extended(links, more, groups)[1]


def _labelled(members: DataFrame, groups: DataFrame) -> DataFrame:
    labelled = members.join(groups.withColumnRenamed("node", "id"), "id", "left")
    return labelled.withColumn("component", F.coalesce("component", "id"))


def _extended(links: DataFrame, more: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links so far and their components."""
    if more.isEmpty():
        unstage(more)
        return links, groups
    every = stage(links.unionByName(more), "links")
    unstage(links, more, groups)
    return every, components(every)


def _linked_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links that join the components of members ``(bucket, id, component, size)`` of a bucket."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64("id", "bucket"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).join(sets, "id")
    rows = rows.select(
        "bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "id", "component", "items"
    )
    kind = members.schema["id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, own, component = (rows.column(c).to_numpy() for c in ("id", "own", "component"))
        items = rows.column("items").combine_chunks()
        flat, cuts = items.flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(items).to_numpy()))
        held = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        within = rows.column("one")[0] == rows.column("two")[0]
        links = joining_links(held, component, None if within else own, percent)
        a, b = (ids[[pair[i] for pair in links]] if links else ids[:0] for i in range(2))
        return pa.table({"a": a, "b": b})

    return rows.groupBy("bucket", "one", "two").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def joining_links(
    sets: list[np.ndarray], component: np.ndarray, side: np.ndarray | None, percent: int
) -> list[tuple[int, int]]:
    """Pairs of numbers of similar enough sets (sorted values) that join components, a spanning forest of them.

    Pairs of one component, or of one ``side`` if sides are given, are left out.
    """
    size = np.array([len(s) for s in sets])
    _, root = np.unique(component, return_inverse=True)
    apart = root[:, None] != root[None, :]
    if side is not None:
        apart &= side[:, None] != side[None, :]
    apart &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    a, b = np.nonzero(np.triu(apart, 1))
    if len(sets) >= SIGNED_FROM and len(a):
        hashing = MinMaxHash(PERMUTATIONS, BANDS)
        signed_sets = np.stack([hashing.signature(s.view(np.uint64)) for s in sets])
        equal = np.zeros(len(a), np.int32)
        for i in range(signed_sets.shape[1]):
            equal += signed_sets[a, i] == signed_sets[b, i]
        near = equal >= (percent / 100 - SLACK) * signed_sets.shape[1]
        order = np.argsort(-equal[near], kind="stable")
        a, b = a[near][order], b[near][order]
    links = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if root[i] == root[j]:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= percent * (size[i] + size[j] - both):
            links.append((i, j))
            root[root == root[j]] = root[i]
    return links


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    pairs = stage(pairs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "pairs")
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b")).cast("bigint")
    union = F.size("items_a") + F.size("items_b") - both
    joined = pairs.join(left, "a").join(right, "b")
    out = stage(joined.filter(100 * both >= percent * union).select("a", "b"), "links")
    unstage(pairs)
    return out
