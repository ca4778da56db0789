"""Token counts and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mirepoix.llm.bpe import Counter
from mirepoix.llm.packing import pack, shortest_pack_first
from mirepoix.llm.token_count import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "a", " ", "  a  b\n\n c\t", "It's we'll they've I'M", "naïve café — “quotes” 漢字 かな 🙂👍🏽", "x" * 3000, " 　 y",
    "12345 67 8.9,0", "<|endoftext|> and <|endoftext|>", " " * 500 + "z", "\r\n\r\n", "ȩ́", "\x00\x01", "ab" * 700 + " ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n=60):
    draw = random.Random(1)
    alphabet = "abc  deÉß漢🙂'’.,1\n\t "
    return TEXTS + ["".join(draw.choice(alphabet) for _ in range(draw.randrange(200))) for _ in range(n)]


def test_counts_are_the_library_s(spark, documents, library):
    rows = list(enumerate(texts())) + [(1000, None), (1001, "word " * 50_000)]
    got = {r.doc_id: r for r in token_counts(documents(*rows), PATH).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 1024), text


def test_chunks_compose_to_the_whole(library):
    counter = Counter(PATH)
    for text in texts():
        if "<|" in text:
            continue  # special strings are taken out before a text is cut into chunks
        for size in (1, 7, 64):
            assert counter.chunked(text, size) == len(library.encode(text, add_special_tokens=False).ids), (size, text)


def test_packing_round_trip(spark, documents, library):
    """Pieces give every id once, sequences are gapless and at most 1024 long, and little is padding."""
    rows = list(enumerate(texts())) + [(1000, None), (1001, "word and " * 3000), (1002, "a"), (1003, "a")]
    found = pack(documents(*rows), PATH).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            own = np.array(ids[i][at : at + r.length], "<u4")
            assert (r.start, r.doc_tokens, len(own)) == (at, len(ids[i]), r.length)
            assert r.ids_crc32 == zlib.crc32(own.tobytes())
            at += r.length
        assert at == len(ids[i])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= -(-total // 1024) + 1


def test_shortest_pack_first_places_everything():
    draw = random.Random(5)
    histogram = {n: draw.randrange(1, 90) for n in draw.sample(range(1, 1025), 200)}
    patterns = shortest_pack_first(histogram, 1024)
    placed = {}
    for p in patterns:
        assert sum(p.lengths) <= 1024
        for n in p.lengths:
            placed[n] = placed.get(n, 0) + p.count
    assert placed == histogram
    assert shortest_pack_first({}, 1024) == []
    with pytest.raises(ValueError):
        shortest_pack_first({1025: 1}, 1024)


def test_empty_tables(spark, documents):
    none = documents((1, "a")).filter("doc_id > 1")
    assert token_counts(none, PATH).count() == 0
    assert pack(none, PATH).count() == 0
