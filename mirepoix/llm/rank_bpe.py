"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The symbols of pre-tokens are a linked list. For every merge rank there is a bucket of the list positions whose
pair has that rank; a bitmap of three levels tells which buckets hold something, so the least rank is found by
three find-first-set steps, whatever the number of symbols. A bucket is merged from left to right; a merge
changes two neighbouring pairs, whose new ranks are pushed, while their old entries stay in the buckets and are
skipped as stale. So a pre-token of a million bytes costs no more per byte than a word does.

Pre-tokens not seen before are coded many at a time: their lists lie one after the other in the same arrays, with
separators that pair with nothing, and a bucket holds the positions of all of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import islice

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.common import map_texts

#: Pre-tokens a worker remembers before it starts anew, and characters of the longest one remembered.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64
#: Pre-tokens that are coded before their ids are joined, characters of a text that is not cut for that.
AT_ONCE, SHORT_TEXT = 200_000, 1_000_000
#: Buckets of so few positions are merged one by one.
FEW = 6
#: Little-endian unsigned 32-bit numbers.
ID = np.dtype("<u4")


class RankQueue:
    """Positions by rank; ``pop`` gives the least rank with all positions in its bucket, ascending."""

    def __init__(self, ranks: int):
        words = [max(1, -(-ranks // 64))]
        while words[-1] > 1:
            words.append(-(-words[-1] // 64))
        #: Level 0 has a bit for each rank, each level above a bit for each word of the one below.
        self.levels = [[0] * n for n in words]
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, positions: int | np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        at = rank
        for level in self.levels:
            at, bit = at >> 6, at & 63
            before = level[at]
            level[at] = before | 1 << bit
            if before:
                break

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Pushes the positions whose rank is not negative."""
        real = ranks >= 0
        ranks, positions = ranks[real], positions[real]
        if len(ranks) <= FEW:
            for rank, position in zip(ranks.tolist(), positions.tolist(), strict=True):
                self.push(rank, position)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for rank, a, b in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(ranks)], strict=True):
            self.push(rank, positions[a] if b == a + 1 else positions[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            at, bit = at >> 6, at & 63
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        bucket = self.buckets.pop(rank)
        if len(bucket) == 1:
            return rank, np.atleast_1d(bucket[0])
        return rank, np.unique(np.concatenate([np.atleast_1d(x) for x in bucket]))


class RankBpe:
    """Encoder and decoder for token bytes with ranks, which are also their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: The id of separators, which no token has.
        self.separator = max(ranks.values()) + 1
        self.queue = RankQueue(self.separator)
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> RankBpe:
        """From lines of base64 token bytes and rank."""
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks, pattern)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Every pair of tokens whose joint bytes are a token: one of its cuts in two. Decoding does without."""
        found = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        return found

    @cached_property
    def sorted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        keys = sorted(self.pairs) or [-1]
        return np.array(keys, np.int64), np.array([self.pairs.get(k, -1) for k in keys], np.int64)

    def _ranks(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """Ranks of the tokens that neighbouring tokens make, -1 where there is none."""
        key = np.left_shift(left, 32) | right
        keys, made = self.sorted_pairs
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, made[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token."""
        whole = [self.ranks.get(w) for w in words]
        rest = [w for w, rank in zip(words, whole, strict=True) if rank is None]
        merged = iter(self._merge(rest) if rest else ())
        return [next(merged) if rank is None else rank.to_bytes(4, "little") for rank in whole]

    def _merge(self, words: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        gaps = np.cumsum([0, *[len(w) + 1 for w in words]])
        ids = self.byte_ids[data]
        ids[gaps] = self.separator
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        #: The rank of the pair that begins at a position; entries of other ranks are stale.
        ranks = np.append(self._ranks(ids[:-1], ids[1:]), -1)
        queue = self.queue
        queue.push_all(ranks, np.arange(n))
        state = ids, after, before, ranks
        while (least := queue.pop()) is not None:
            rank, at = least
            if len(at) <= FEW or not self._merge_bucket(rank, at[ranks[at] == rank], *state):
                self._merge_one_by_one(rank, at, *state)
        left = np.flatnonzero(ids >= 0)
        packed = ids[left].astype(ID)
        cuts = np.searchsorted(left, gaps)
        return [packed[a + 1 : b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _merge_bucket(self, rank, at, ids, after, before, ranks) -> bool:
        """All merges of a bucket in one go; False, with nothing changed, if a merge would make a pair of lower
        rank, which has to come before the rest of the bucket."""
        if not len(at):
            return True
        joined = at[1:] == after[at[:-1]]
        if joined.any():  # in a run of overlapping pairs every other one is merged, from the left
            new = np.append(True, ~joined)
            place = np.arange(len(at))
            at = at[(place - place[new][np.cumsum(new) - 1]) % 2 == 0]
        gone = after[at]
        following = after[gone]
        old = ids[at], ids[gone], before[following]
        first = self._ranks(rank, ids[following])
        ids[at], ids[gone] = rank, -1
        after[at], before[following] = following, at
        right = self._ranks(rank, ids[following])
        behind = before[at]
        left = self._ranks(ids[behind], rank)
        if any(((x >= 0) & (x < rank)).any() for x in (first, right, left)):
            before[following], after[at] = old[2], gone
            ids[at], ids[gone] = old[0], old[1]
            return False
        ranks[gone] = -1
        ranks[at], ranks[behind] = right, left
        self.queue.push_all(right, at)
        self.queue.push_all(left, behind)
        return True

    def _merge_one_by_one(self, rank, at, ids, after, before, ranks) -> None:
        queue, pairs = self.queue, self.pairs
        for n, here in enumerate(at.tolist()):
            if ranks[here] != rank:
                continue
            gone = int(after[here])
            following = int(after[gone])
            behind = int(before[here])
            ids[here], ids[gone] = rank, -1
            after[here], before[following] = following, here
            ranks[gone] = -1
            ranks[here] = right = pairs.get(rank << 32 | int(ids[following]), -1)
            ranks[behind] = left = pairs.get(int(ids[behind]) << 32 | rank, -1)
            if right >= 0:
                queue.push(right, here)
            if left >= 0:
                queue.push(left, behind)
            if 0 <= right < rank or 0 <= left < rank:
                if n + 1 < len(at):
                    queue.push(rank, at[n + 1 :])
                return

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of the words, all remembered but for very long ones."""
        if len(self.words) + len(words) > REMEMBERED:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        made = dict(zip(new, self.merge([w.encode("utf-8") for w in new]), strict=True))
        long = {w: made.pop(w) for w in new if len(w) > LONGEST_REMEMBERED}
        self.words.update(made)
        return {**self.words, **long} if long else self.words

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; null and empty texts have none."""
        parts: list[list[bytes]] = [[] for _ in texts]
        for batch in self._batches(texts):
            known = self._learn({w for _, found in batch for w in found})
            for number, found in batch:
                parts[number].append(b"".join(map(known.__getitem__, found)))
        return [b"".join(p) for p in parts]

    def _batches(self, texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """(number of the text, some of its pre-tokens in order), about ``AT_ONCE`` pre-tokens at a time."""
        batch, held = [], 0
        for number, text in enumerate(texts):
            if len(text or "") <= SHORT_TEXT:
                stretches = iter([self.pattern.findall(text or "")])
            else:
                matches = self.pattern.finditer(text)
                stretches = iter(lambda m=matches: [x.group() for x in islice(m, AT_ONCE)], [])
            for found in stretches:
                batch.append((number, found))
                held += len(found)
                if held >= AT_ONCE:
                    yield batch
                    batch, held = [], 0
        if batch:
            yield batch

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens; raises ``ValueError`` for an id without a token."""
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, ID).tolist()))
        except KeyError as e:
            raise ValueError(f"no token has the id {e.args[0]}") from None


@cache
def coder(path: str, pattern: str) -> RankBpe:
    """One for each Python worker and vocabulary."""
    return RankBpe.load(path, pattern)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids"
) -> DataFrame:
    """``(id_col, ids_col)``, one row a document: the token ids of the whole text as little-endian unsigned 32-bit
    numbers in one binary value, which is half the size of an array (:func:`id_array` makes one).

    ``ranks_path`` is a file of base64 tokens with ranks on every executor; each match of ``pattern`` is coded by
    itself, text outside matches is left out as in the tiktoken library, special strings are ordinary text. Null and
    empty texts have no ids (an empty value). Repeated rows come out repeatedly, ids of documents may be null and of
    any type, other columns are ignored, an empty table gives an empty result.
    """

    def rows(texts: list) -> Iterator[tuple]:
        return ((ids,) for ids in coder(ranks_path, pattern).encode(texts))

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    coded = map_texts(source, "text", ["id"], rows, "ids binary")
    return coded.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col))


def decode(
    coded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded"
) -> DataFrame:
    """``coded`` with the bytes of its ids in ``decoded_col`` (binary: a cut sequence need not be whole UTF-8).

    Null ids give null. An id that no token has fails the job: it is an error in the data. A column that already is
    named ``decoded_col`` is replaced.
    """

    def rows(values: list) -> Iterator[tuple]:
        code = coder(ranks_path, pattern)
        return ((None if ids is None else code.decode(bytes(ids)),) for ids in values)

    kept = [c for c in coded.columns if c != decoded_col]
    # columns travel under numbers, so that no name can clash or need quotes
    plain = coded.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{ids_col}`").alias("value")
    )
    made = map_texts(plain, "value", [f"c{i}" for i in range(len(kept))], rows, "made binary")
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("made").alias(decoded_col))


def id_array(ids: Column) -> Column:
    """A binary column of :func:`encode` as ``array<bigint>``."""
    hexed = F.hex(ids)

    def number(i: Column) -> Column:
        # the four bytes in reverse order
        return F.conv(F.concat(*[F.substring(hexed, i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)]), 16, 10).cast("bigint")

    count = (F.octet_length(ids) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), number)).when(
        count == 0, F.array().cast("array<bigint>")
    )
