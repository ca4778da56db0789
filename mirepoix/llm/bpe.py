"""Byte-level BPE as a deterministic transducer, and the cutting of texts into independent pieces.

A text is cut before each white-space run that follows other text: the pre-tokenizer always starts a token
there and looks neither back nor forward across it, so pieces can be tokenized alone and their results
added up or joined.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import regex
import tiktoken
from tokenizers import Tokenizer

#: White space as Unicode has it (fixed values); Python's ``\s`` has four control characters more.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: What keeps a text from being cut at single spaces and line feeds alone.
UNUSUAL = (
    "  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r\x85\xa0     　", *map(chr, range(0x2000, 0x200B))
)

#: The pre-tokenizer of this vocabulary (a fixed value).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Entries a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Pieces an encoder remembers of each kind.
PIECES = 100_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def split(text: str) -> tuple[list[str], list[str]]:
    """Pieces of ``text``, in order: those as they stand, then those that one space goes before.

    Usual texts are cut at single spaces and line feeds by ``str.split``, others by a pattern.
    """
    if any(map(text.__contains__, UNUSUAL)):
        return PIECE.findall(text), []
    first, *rest = text.replace("\n", " \n").split(" ")
    return [first], rest


def spaced(rest: str) -> str:
    """The piece that stands for an entry of the second list of :func:`split`."""
    return rest if rest[:1] == "\n" else " " + rest


class Memo(dict):
    """A dictionary that makes missing values by ``make``, and forgets all when it has grown large."""

    def __init__(self, make: Callable, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Transducer:
    """Deterministic transducer of BPE over the bytes of one pre-token, compiled from the vocabulary.

    After each byte the BPE tokens of the prefix read so far are known to end in one token: the only one
    that BPE would put next to the last token of the prefix before it. The number of tokens of a prefix is
    thus one more than that of a shorter prefix. A state holds what later bytes can depend on: for every
    open start (a place from which the bytes read form the beginning of some token) the trie node reached,
    the last token of the prefix ending there, and the number of tokens of that prefix relative to the
    present one. A transition is annotated with the change of the number of tokens. States and transitions
    are made when first met and remembered; a word's count is the sum along its path.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bytes_of = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.token_bytes: dict[int, bytes] = {}
        for token, i in vocab.items():
            if token not in self.special:
                self.token_bytes[i] = bytes(bytes_of[c] for c in token)
        self.id_of = {b: i for i, b in self.token_bytes.items()}
        #: How BPE made each token: its two parts and the rank of that merge.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocab[left], vocab[right]
            self.rank[pair] = rank
            self.parts.setdefault(vocab[left + right], pair)
        self.made = {t: self.rank[p] for t, p in self.parts.items()}
        # trie of the tokens: (node, byte) -> node, and the token at a node
        self.step: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = {0}
        nodes = 1
        for i, word in self.token_bytes.items():
            node = 0
            for b in word:
                nxt = self.step.get((node, b))
                if nxt is None:
                    nxt = self.step[node, b] = nodes
                    nodes += 1
                    self.inner.add(node)
                node = nxt
            self.token_at[node] = i
        self.adjacent: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # an open start: (trie node, last token before it or -1, tokens before it minus tokens now)
        start = ((0, -1, 0),)
        self.states = [start]
        self.number = {start: 0}
        self.arcs: dict[int, tuple[int, int]] = {}

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' joint bytes is these two tokens.

        Walks the merges that made both tokens from the last to the first: a merge across the border that
        BPE would have done earlier than the merge that hides one of its sides forbids the pair.
        """
        known = self.adjacent.get((left, right))
        if known is None:
            if len(self.adjacent) > 4 * REMEMBERED:
                self.adjacent.clear()
            known = self.adjacent[left, right] = self._meet(left, right)
        return known

    def _meet(self, left: int, right: int) -> bool:
        limit = len(self.rank)
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < limit:
                return False
            # undo the later of the two merges that made the sides
            made_left, made_right = self.made.get(left, -1), self.made.get(right, -1)
            if made_left > made_right:
                limit = made_left
                left = self.parts[left][1]
            elif made_right >= 0:
                # at the same rank the merge across comes first, as BPE goes from left to right
                limit = made_right + 1
                right = self.parts[right][0]
            else:
                return True

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and change of the number of tokens."""
        moved = []
        token, count = -1, 0
        for node, last, before in self.states[state]:
            node = self.step.get((node, byte))
            if node is None:
                continue
            t = self.token_at.get(node)
            if token < 0 and t is not None and (last < 0 or self._neighbours(last, t)):
                token, count = t, before + 1
            if node in self.inner:
                moved.append((node, last, before))
        starts = tuple((node, last, before - count) for node, last, before in moved) + ((0, token, 0),)
        number = self.number.get(starts)
        if number is None:
            number = self.number[starts] = len(self.states)
            self.states.append(starts)
        return number, count

    def run(self, word: bytes) -> int:
        """The number of tokens of a pre-token."""
        if len(self.arcs) > REMEMBERED // 2:
            self._reset()
        state = total = 0
        for byte in word:
            arc = self.arcs.get(state << 8 | byte)
            if arc is None:
                arc = self.arcs[state << 8 | byte] = self._arc(state, byte)
            state = arc[0]
            total += arc[1]
        return total


class ChunkMap:
    """What a stretch of text does to a count, whatever stands around it.

    ``head`` is the text before the first sure cut and ``tail`` what follows the last one, both still open,
    ``tokens`` the number between; a stretch without a cut is all head. Maps compose associatively.
    """

    __slots__ = ("head", "tail", "tokens")

    def __init__(self, head: str, tokens: int = 0, tail: str | None = None):
        self.head, self.tokens, self.tail = head, tokens, tail


class Counter:
    """Number of tokens of texts."""

    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.special = re.compile("|".join(map(re.escape, self.transducer.special))) if self.transducer.special else None
        self.words = Memo(lambda word: self.transducer.run(word.encode("utf-8")))
        self.pieces = Memo(lambda piece: sum(map(self.words.__getitem__, PRETOKEN.findall(piece))))
        self.spaced = Memo(lambda rest: sum(map(self.words.__getitem__, PRETOKEN.findall(spaced(rest)))))

    def plain(self, text: str) -> int:
        """Tokens of a text that holds no special string."""
        plain, rest = split(text)
        return sum(map(self.pieces.__getitem__, plain)) + sum(map(self.spaced.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.chunked(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.chunked, parts))

    def chunked(self, text: str, size: int = 1 << 16) -> int:
        """Chunks become maps, and maps are composed two by two (a parallel prefix scan's up-sweep)."""
        if len(text) <= size:
            return self.plain(text)
        maps = [self.chunk(text[i : i + size]) for i in range(0, len(text), size)]
        while len(maps) > 1:
            paired = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = paired + maps[len(paired) * 2 :]
        last = maps[0]
        return self.plain(last.head) + last.tokens + self.plain(last.tail or "")

    def chunk(self, text: str) -> ChunkMap:
        first = CUT.search(text)
        if first is None:
            return ChunkMap(text)
        start = first.start() + 1
        end = start
        # the last cut: before the white space that the last piece begins with
        for m in CUT.finditer(text, max(start - 1, len(text) - 4096)):
            end = m.start() + 1
        if end == start and len(text) - start > 4096:
            for m in CUT.finditer(text, start - 1):
                end = m.start() + 1
        return ChunkMap(text[:start], self.plain(text[start:end]), text[end:])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            middle = a.head + b.head
            if b.tail is None:
                return self.chunk(middle) if CUT.search(middle) else ChunkMap(middle)
            opened = self.chunk(middle)
            if opened.tail is None:
                return ChunkMap(middle, b.tokens, b.tail)
            return ChunkMap(opened.head, opened.tokens + self.plain(opened.tail) + b.tokens, b.tail)
        if b.tail is None:
            opened = self.chunk(a.tail + b.head)
            if opened.tail is None:
                return ChunkMap(a.head, a.tokens, opened.head)
            return ChunkMap(a.head, a.tokens + self.plain(opened.head) + opened.tokens, opened.tail)
        return ChunkMap(a.head, a.tokens + self.plain(a.tail + b.head) + b.tokens, b.tail)


#: A sure cut: white space right after other text.
CUT = re.compile(f"[^{WHITE_SPACE}](?=[{WHITE_SPACE}])")


@cache
def counter(path: str) -> Counter:
    """One for each Python worker and vocabulary."""
    return Counter(path)


class Encoder:
    """Token ids of texts as the tokenizers library gives them, as little-endian 32-bit bytes.

    Pieces are coded one at a time and remembered. Where ids follow the order of merges, as they do in
    vocabularies of this kind, a piece not seen yet is coded by tiktoken over the same vocabulary, which gives
    the same ids at a quarter of the cost of a call; otherwise by the tokenizers library itself.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.any_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        ids = self._ids(path, tokenizer)
        self.pieces = Memo(lambda piece: _packed(ids(piece)), PIECES)
        self.spaced = Memo(lambda rest: _packed(ids(spaced(rest))), PIECES)

    def _ids(self, path: str, tokenizer: Tokenizer) -> Callable[[str], list[int]]:
        transducer = Transducer(path)
        by_id = sorted(transducer.made.items())
        if [rank for _, rank in by_id] == list(range(len(by_id))) and len(by_id) + 256 == len(transducer.id_of):
            coded = tiktoken.Encoding(path, pat_str=PRETOKEN.pattern, mergeable_ranks=transducer.id_of, special_tokens={})
            return coded.encode_ordinary
        return lambda piece: tokenizer.encode(piece, add_special_tokens=False).ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for text in texts:
            if not text:
                yield b""
            elif self.any_special is not None and any(map(text.__contains__, self.special)):
                parts = filter(None, self.any_special.split(text))
                yield b"".join(_packed([self.special[p]]) if p in self.special else self.plain(p) for p in parts)
            else:
                yield self.plain(text)

    def plain(self, text: str) -> bytes:
        plain, rest = split(text)
        return b"".join(map(self.pieces.__getitem__, plain)) + b"".join(map(self.spaced.__getitem__, rest))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
