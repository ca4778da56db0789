"""The prefix trie against a trie of dictionaries."""

import hashlib
import random
import zlib

import duckdb
import pytest

from mirepoix.llm.conversation_trie import NODE, conversation_trie
from mirepoix.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def own_turns(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append((turn is not None, turn, key, (role, text)))
    return {c: [t[3] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute_force(convs):
    members, nodes = {}, []
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[c] for c in children.get(p, [])]
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        totals[p] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        above = min(members[p[:-1]]) if p else None
        nodes.append((min(members[p]), len(p), above, len(members[p]), len(below), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=str)


def table(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn int, role string, text string, head string, `a.b` int")


def made(seed, n, length, words):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice(words)) for t in range(draw.randrange(1, length))]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("container_turns", [1, 7, 100_000])
def test_equals_brute_force(spark, container_turns):
    rows = made(container_turns, 120, 6, ["a", "é漢", "", "long text"])
    got = conversation_trie(turns(spark, rows), container_turns=container_turns)
    assert table(got) == brute_force(own_turns(rows))


def test_shared_openings(spark):
    rows = made(9, 150, 14, ["yes", "no", "ü"])
    rows = [r for r in rows if r[0] not in (5, 20)]  # conversations whose opening others would take
    got = conversation_trie(turns(spark, rows), group=5, container_turns=30)
    want = brute_force(rebuilt(own_turns(rows)))
    assert table(got) == want
    assert any(n[1] == 0 and n[7] != hashlib.sha256(b"").hexdigest() for n in want)


def test_copies_and_a_deep_shared_beginning(spark):
    """Many copies of one conversation, and a long chain that all share: skipped in one burst."""
    chain = [(t, "user", f"turn {t}") for t in range(300)]
    rows = [(c, *t) for c in range(40) for t in [*chain, (300, "user", str(c % 7)), (301, "user", "end")][: 302 if c % 5 else 150]]
    got = conversation_trie(turns(spark, rows), container_turns=50)
    assert table(got) == brute_force(own_turns(rows))


def test_edges(spark):
    """Null and negative ids, null turns first, null roles and texts, ties, repeated rows, a very long text."""
    rows = [
        (None, 0, "user", "lost"), (3, 2, "user", "b"), (3, None, "user", "a"), (3, 1, None, None), (4, 1, "", ""), (4, 1, "", ""),
        (5, 0, "user", "x" * 300_000), (6, 0, "u", "serx"), (7, 0, "us", "erx"), (8, 1, "b", "2"), (8, 1, "a", "1"),
        (9, 1, "a", "1"), (9, 1, "b", "2"), (-7, 0, "user", "x"),
    ]
    got = conversation_trie(turns(spark, rows))
    assert table(got) == brute_force(own_turns(rows))
    assert table(conversation_trie(turns(spark, rows).limit(0))) == []
    assert table(conversation_trie(turns(spark, rows).limit(0), group=5)) == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_burst_trie']})").fetchall()
    got = table(QUERIES["op11_burst_trie"](spark, SF))
    assert got == sorted(want, key=str)
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    assert got == brute_force(rebuilt(own_turns([(r.conv_id, r.turn, r.role, r.text) for r in rows])))
