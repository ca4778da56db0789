"""Personal data against Python's re, and redaction."""

import random
import re

from mirepoix.llm.pii import KINDS, personal_data, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [d * (1 + i % 2) for i, d in enumerate(map(int, reversed(digits)))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute_force(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if passes(k, m.group())] for k, p in PATTERNS.items()}


def rows():
    draw = random.Random(2)
    parts = ["a@b.co", "x.y+z@h-1.org.", "@", ".", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+49 (30) 123-456", "+1", "+12345678", " ", "🙂", "é", "7", "-", "mail ", "00000000000000000", "a@b", "\n"]
    made = ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(150)]
    return list(enumerate(made)) + [(900, None), (901, ""), (902, "x" * 200_000 + " me@here.org"), (903, "9" * 50_000)]


def test_base_spans_equal_brute_force(spark, documents):
    texts = dict(rows())
    found = personal_data(documents(*texts.items())).collect()
    assert len(found) == len(texts)
    for r in found:
        want = brute_force(texts[r.doc_id])
        assert {k: [(s.start, s.end) for s in r[k]] for k in KINDS} == want, texts[r.doc_id]
        taken = [s for spans in want.values() for s in spans]
        assert all(s.end <= a or s.start >= b for s in r.added for a, b in taken)


def test_redaction(spark, documents):
    docs = documents((1, "🙂 write a@b.co or +49 30 123456, from 10.0.0.1"), (2, None), (3, ""), (4, "nothing here"), (4, "nothing here"))
    got = redact(docs)
    assert got.columns == docs.columns
    texts = sorted((r.doc_id, r.text) for r in got.collect() if r.text is not None)
    assert texts == [(1, "🙂 write <email> or <phone>, from <ip>"), (3, ""), (4, "nothing here"), (4, "nothing here")]
    assert got.filter("text is null").count() == 1 and got.filter("component_id = 'x' and n = 7").count() == 5


def test_empty_table(spark, documents):
    none = documents((1, "a")).filter("doc_id > 1")
    assert personal_data(none).count() == 0 and redact(none).count() == 0


def test_many_hits_in_one_text(spark, documents):
    text = "".join(f"🙂 mail u{i}@h{i % 7}.org or 10.0.{i % 300}.1\n" for i in range(50_000))
    docs = documents((1, text), (2, "a@b.co"))
    found = {r.doc_id: r for r in personal_data(docs).collect()}
    want = brute_force(text)
    assert {k: [(s.start, s.end) for s in found[1][k]] for k in KINDS} == want
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert clean[2] == "<email>" and clean[1].count("<email>") == 50_000
    assert "".join(re.findall(r"(?<=> )or(?= )", clean[1])) == "or" * 50_000
    assert clean[1].startswith("🙂 mail <email> or <ip>\n🙂 mail <email> or <ip>\n")


def test_redaction_equals_brute_force(spark, documents):
    texts = dict(rows())
    got = {r.doc_id: r.text for r in redact(documents(*texts.items())).collect()}
    spans_of = {r.doc_id: r for r in personal_data(documents(*texts.items())).collect()}
    for doc_id, text in texts.items():
        spans = sorted([(s.start, s.end, k) for k in KINDS for s in spans_of[doc_id][k]] + [(s.start, s.end, s.kind) for s in spans_of[doc_id].added])
        out, at = "", 0
        for start, end, kind in spans:
            if start >= at:
                out += text[at:start] + f"<{kind}>"
            at = max(at, end)
        assert got[doc_id] == (None if text is None else out + text[at:])


def test_any_column_names(spark):
    names = ["doc_id", "text", "id", "email", "candidates", "c0", "__base", "a.b", "ordered"]
    docs = spark.createDataFrame([(1, "to a@b.co", *"pqrstuv")], names)
    got = redact(docs)
    assert got.columns == names and tuple(got.first()) == (1, "to <email>", *"pqrstuv")
    assert personal_data(docs).first().doc_id == 1
