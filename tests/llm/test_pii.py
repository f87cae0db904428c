"""Personal data against plain regular expressions."""

import hashlib
import random
from collections import Counter

from tests.conftest import SF_SMALL
from tests.llm import brute, fixtures
from wavepanel.llm import pii, queries

HARD = [
    "a@b.c_d@e.f", "a@b.c@d.e", "x.y+z%w@a-b.c-d.e.", "@a.b a@b a@.b a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0004",
    "1.2.3.4@5.6.7.8", "+1 (443) 555-5793 +1+22222222 +12 +1234567 +1234567890123456", "4363 3617 5661 9572",
    "4363-3617-5661-9572-", "43633617566195720000", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "  4111111111111111 4111111111111111",
    "é😀 a@b.c 😀 4111111111111111 é", "iban DE89370400440532013000", "GB82 WEST 1234 5698 7654 32.", "DE88370400440532013000",
    "ssn 123-45-6789", "123-45-6789", "ssn 000-45-6789", "visa 378282246310005", "378282246310005", "a" * 20_000 + "@b.c",
    "a" * 50_000, "1" * 50_000, "1-" * 20_000, "a@b" + ".c" * 20_000, "1." * 20_000, "+1" + " " * 30_000 + "2", "+1 " * 9_000,
    "0@0.0 " * 700, "",
]


def spans_of(listed):
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in listed.split(","))] if listed else []


def check(rows, texts):
    by_text = {i: t or "" for i, t in texts}
    for r in rows:
        base = brute.base_pii(by_text[r.doc_id])
        found = spans_of(r.spans)
        assert [s for s in found if s[0] in ("email", "ip", "card", "phone")] == base, by_text[r.doc_id][:60]
        n = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        for k, a, b in found:
            if k == "iban":
                assert brute.iban_ok(by_text[r.doc_id][a:b])
            if k == "short_card":
                assert brute.luhn("".join(c for c in by_text[r.doc_id][a:b] if c.isdigit()))


def test_hard_texts(spark):
    texts = list(enumerate(HARD))
    rows = pii.find_pii(fixtures.documents(spark, texts)).collect()
    check(rows, texts)
    kinds = {HARD[r.doc_id]: {s[0] for s in spans_of(r.spans)} for r in rows}
    assert kinds["iban DE89370400440532013000"] == {"iban"} and kinds["GB82 WEST 1234 5698 7654 32."] == {"iban"}
    assert kinds["DE88370400440532013000"] == set()
    assert kinds["ssn 123-45-6789"] == {"ssn"} and kinds["123-45-6789"] == set() and kinds["ssn 000-45-6789"] == set()
    assert kinds["visa 378282246310005"] == {"short_card"} and kinds["378282246310005"] == set()


def test_random_texts(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("ab@..--++  (1234567890%é😀") for _ in range(rng.randrange(300)))) for i in range(1500)]
    check(pii.find_pii(fixtures.documents(spark, texts)).collect(), texts)


def test_awkward_rows(spark):
    rows = pii.find_pii(fixtures.documents(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in fixtures.TEXTS)
    texts = {}
    for i, t in fixtures.TEXTS:
        texts.setdefault(i, []).append(t)
    check([r for r in rows if len(texts[r.doc_id]) == 1], fixtures.TEXTS)
    assert pii.find_pii(fixtures.empty(spark)).count() == 0


def test_scores_rise_with_context(spark):
    texts = [(1, "reach me at 10.0.0.1 ok"), (2, "server 10.0.0.1 ok")]
    rows = {r.doc_id: r.found[0].score for r in pii.find_pii(fixtures.documents(spark, texts)).collect()}
    assert rows == {1: 0.7, 2: 0.95}


def test_query_on_the_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows = queries.op3_pii(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_redaction(spark):
    texts = [(1, "mail a@b.c, host 10.0.0.255!"), (2, None), (3, ""), (4, "é😀 +1 (443) 555-5793"), (5, "0@0.0 " * 700),
             (6, "clean text"), (7, "1.2.3.4@5.6.7.8")]
    docs = fixtures.documents(spark, texts)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1] == ("mail <EMAIL>, host <IP>!", 24) and got[2] == (None, None) and got[3] == ("", 0)
    assert got[4][0] == "é😀 <PHONE>" and got[5][0] == "<EMAIL> " * 700 and got[6] == ("clean text", 10)
    assert got[7][0] == "<EMAIL>"
