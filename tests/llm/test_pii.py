import hashlib
import random
import re
import time

from tabwise.llm import pii
from tests.llm.conftest import frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in double) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def by_force(text):
    """Base spans by running each pattern over the whole text."""
    found = [(m.start(), list(PATTERNS).index(k), f"{k}:{m.start()}:{m.end()}")
             for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]
    return [x for *_, x in sorted(found)]


def base(text):
    return [f"{k}:{s}:{e}" for s, e, k in pii.spans(text) if k in pii.BASE]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["a@b.c", "@", ".", "..", "+", "+1", " ", "-", "(", ")", "7", "42", "255", "256", "0256", "1.2.3.4", "1.2.3", "x",
             "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "+49 (30) 1234-5678", "a.b", "%", "é", "😀", "\n",
             "://", "http://h.de/x", "account", "IBAN", "DE89 3704 0044 0532 0130 00", "000", "--", "9" * 20]
    for _ in range(30000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert base(text) == by_force(text), text
    for _ in range(3000):
        text = "".join(rng.choice("0123456789.+@- ()ab") for _ in range(60))
        assert base(text) == by_force(text), text


def test_added_kinds():
    def of(text):
        return [(k, text[s:e]) for s, e, k in pii.spans(text) if k not in pii.BASE]
    assert of("see (https://a.example/x?y=1), or FTP://h.") == [("url", "https://a.example/x?y=1"), ("url", "FTP://h")]
    assert of("IBAN: DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert of("GB82WEST12345698765432 but not GB82WEST12345698765433") == [("iban", "GB82WEST12345698765432")]
    assert of("Account no. 1234 5678, account of 2019, ACCT #99887766") == [("account", "1234 5678"), ("account", "99887766")]
    assert of("a page of 1234567 words :// and http:// x") == []
    assert pii.mask_text("mail a@b.co or +49 30 1234567, x") == "mail <email> or <phone>, x"


def test_report_and_find(spark, edges, empty, edge_rows):
    texts = ["ann@x.org, 10.0.0.1", "né 😀 +1 (017) 555-7713", None, "", "9" * 3000, "1." * 1000, "a@" * 1000,
             "+1 " * 1000, "a.b@c.d " * 1000]
    rows = pii.report(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        want = by_force(t)
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in pii.BASE] == want
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x.startswith(k) for x in want) for k in pii.BASE]
    assert pii.report(edges).count() == len(edge_rows) and pii.report(empty).count() == 0
    found = pii.find(frame(spark, [(i, t, "a") for i, t in enumerate(texts[:4])]), spans_col="key").orderBy("doc_id").collect()
    assert [[x["value"] for x in r["key"]] for r in found] == [["ann@x.org", "10.0.0.1"], ["+1 (017) 555-7713"], [], []]
    masked = pii.mask(edges)
    assert masked.columns == edges.columns and masked.count() == len(edge_rows)


def test_very_long_texts_take_linear_time():
    long = {"9" * 300000: 0, "1." * 400000: 100000, "a@" * 200000: 0, "+1 " * 200000: 0, "a.b@c.d " * 50000: 50000,
            "http://" * 100000: 1, "a+" * 200000 + "://": 0, "account " * 100000: 0, "IBAN DE" * 100000: 0}
    began = time.time()
    assert [len(pii.spans(text)) for text in long] == [*long.values()]
    assert time.time() - began < 30


def test_whole_table(spark):
    import pyarrow.parquet as pq

    from tabwise.llm import queries
    got = {r["doc_id"]: r for r in queries.op11_personal_data(spark, "/root/testdata/sf0.01").collect()}
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(docs)
    for d in docs:
        want = by_force(d["text"])
        assert got[d["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
