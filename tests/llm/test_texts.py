import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tabwise.llm import fingerprints, lines, passages, rules
from tabwise.llm.queries import queries as corpus_queries
from tests.conftest import SF0001
from tests.llm.conftest import frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_order(rows):
    return sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0])


def test_fingerprints_of_edges(edges, empty, edge_rows):
    rows = fingerprints.compare_with_edits(edges).collect()
    assert len(rows) == len(edge_rows)
    by_text = {}
    ids = defaultdict(list)
    for r in rows:
        ids[r["doc_id"]].append(r)
    order = in_order(edge_rows)
    for i, (doc, text, _) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        if len(ids[doc]) > 1:
            continue
        r, half = ids[doc][0], len(text) // 2
        new = text[:len(text) - half] + following[:half]
        assert r["n_chars"] == len(text)
        if sum(d == order[(i + 1) % len(order)][0] for d, _, _ in order) == 1:
            assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == new)
        by_text.setdefault(text, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.compare_with_edits(empty).count() == 0


def test_single_document_follows_itself(spark):
    r = fingerprints.compare_with_edits(frame(spark, [(3, "abcd efgh", "a")])).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest() and r["near_next"] == 1.0


def test_fingerprints_combine(spark):
    a, b = [prose(i, 12) for i in range(5)], [prose(i, 9) for i in range(10, 13)]
    docs = frame(spark, [(1, "\n".join(a), "x"), (2, "\n".join(b), "x"), (3, "\n".join([*b[::-1], *a]), "x"),
                         (4, "", "x"), (5, "\n".join(a), "x")])
    found = {r["doc_id"]: r["lanes"] for r in fingerprints.fingerprint(docs).collect()}
    assert found[1] == found[5] != found[2] and set(found[4]) == {0}
    one = spark.createDataFrame([(found[1], found[2], found[3])], "a array<long>, b array<long>, c array<long>")
    r = one.select(fingerprints.combine(F.col("a"), F.col("b")).alias("plus"),
                   fingerprints.combine(F.col("c"), F.col("b"), remove=True).alias("minus"),
                   fingerprints.likeness(F.col("a"), F.col("c")).alias("near"),
                   fingerprints.likeness(F.col("a"), F.col("b")).alias("far")).first()
    assert r["plus"] == found[3] and r["minus"] == found[1]
    assert r["near"] > 0.5 > r["far"]


def test_likeness_of_many_equal_shingles(spark):
    docs = frame(spark, [(1, "\n".join(["same"] * 80000), "x"), (2, "another short text", "x"),
                         (3, "\n".join(["same"] * 140000), "x")])
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_edits(docs).collect()}
    assert rows[1]["near_edited"] > 0.99 and rows[3]["near_edited"] > 0.99
    assert rows[3]["near_next"] > 0.99 and rows[1]["near_next"] < 0.5
    found = {r["doc_id"]: r["lanes"] for r in fingerprints.fingerprint(docs).collect()}
    one = spark.createDataFrame([(found[1], found[3])], "a array<long>, c array<long>")
    r = one.select(fingerprints.combine(F.col("a"), F.col("c")).alias("plus"), fingerprints.likeness(
        F.col("a"), fingerprints.combine(F.col("c"), F.col("a"), remove=True)).alias("near")).first()
    assert max(r["plus"]) < 2**32 and r["near"] > 0.99


def passages_by_force(rows, size):
    order = in_order(rows)
    first = {}
    for doc, text, _ in order:
        w = (text or "").encode().split()
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i:i + size]), -(2**63) if doc is None else doc)
    out = []
    for doc, text, _ in rows:
        w, gone = (text or "").encode().split(), set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (-(2**63) if doc is None else doc):
                gone.update(range(i, i + size))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def test_passages(spark, edges, empty, edge_rows):
    shared, other = prose(50, 70), prose(51, 49)
    more = [(20 + i, f"{prose(60 + i, 30 + i)} {shared if i % 2 else other}\n{prose(90 + i, 40)}", "a") for i in range(8)]
    for docs, rows in ((edges, edge_rows), (frame(spark, more), more)):
        want = passages_by_force(rows, 50)
        for limits in ({}, {"max_cells": 0, "max_marks": 0}):
            got = passages.dedup_passages(docs, **limits).collect()
            assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got], key=str) == want
            assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)
    assert passages.dedup_passages(empty).count() == 0


def test_line_dedup(spark, edges, empty, edge_rows):
    rows = lines.dedup_lines(edges, min_docs=2).collect()
    assert len(rows) == len(edge_rows)
    texts = {i: t for i, t, _ in edge_rows}
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] not in (6, 10):
            assert r["text"] == texts[r["doc_id"]] and r["n_dropped"] == 0
    again = next(r for r in rows if r["doc_id"] == 10)
    assert "This line comes back" not in again["text"] and again["n_dropped"] >= 1
    assert lines.dedup_lines(empty).count() == 0


def test_line_templates(spark):
    docs = [(i, f"{prose(i, 12)}\nPage {i} of the report, all rights reserved by us\n"
                f"Dear customer number {'abcdef'[i % 6]}x{'uvwxyz'[i % 6]}, thank you very much for your order\n\nshort", "a")
            for i in range(12)]
    rows = {r["doc_id"]: r for r in lines.dedup_lines(frame(spark, docs)).collect()}
    assert rows[0]["text"] == docs[0][1] and rows[0]["n_lines"] == 5
    for i in range(1, 12):
        assert rows[i]["text"] == docs[i][1].split("\n")[0] + "\n" and rows[i]["n_dropped"] == 3
    longer = {r["doc_id"]: r for r in lines.dedup_lines(frame(spark, docs), min_tokens=3).collect()}
    assert all(longer[i]["text"].endswith("\n\nshort") and longer[i]["n_dropped"] == 2 for i in range(1, 12))


def test_equal_lines_of_two_documents(spark):
    long, cjk = prose(90, 12), "\u3053\u306e\u30da\u30fc\u30b8\u306e\u5148\u982d\u3078\u623b\u308b" * 4
    docs = [(i, f"{prose(i, 6)}\n{long}\n{cjk}\n\nTo\nPage {i} of {i + 3} in this one report", "a") for i in range(2)]
    rows = {r["doc_id"]: r for r in lines.dedup_lines(frame(spark, docs)).collect()}
    parts = docs[1][1].split("\n")
    assert rows[0]["text"] == docs[0][1] and rows[0]["n_dropped"] == 0
    assert rows[1]["text"] == "\n".join([parts[0], "", parts[-1]]) and rows[1]["n_dropped"] == 3
    longer = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(spark, docs), min_tokens=3).collect()}
    assert long not in longer[1] and cjk in longer[1]


def test_registered_line_dedup_leaves_no_equal_lines(spark):
    rows = corpus_queries()["op5_line_dedup"](spark, SF0001).collect()
    found = defaultdict(set)
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if x.strip():
                found[x].add(r["doc_id"])
    assert not [x for x, ids in found.items() if len(ids) > 1]


def counts_by_force(text):
    text = text or ""
    w = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i:i + 5])].append(i)
    cover = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_counts(edges, empty, edge_rows):
    rows = rules.judge(edges, rules.DecisionList(), keep=("doc_id", "source")).collect()
    got = sorted([(r["doc_id"], *[r[c] for c in rules.COUNTS]) for r in rows], key=str)
    assert got == sorted([(i, *counts_by_force(t)) for i, t, _ in edge_rows], key=str)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])
    assert rules.judge(empty, rules.DecisionList()).count() == 0


def test_rules_find_planted_conditions(spark):
    good = [(i, prose(i, 60 + i % 50), "a") for i in range(600)]
    noisy = [(1000 + i, prose(i + 7000, 60).replace(" ", "### "), "a") for i in range(150)]
    loud = [(2000 + i, prose(i + 9000, 50).upper().replace(" ", "!! "), "a") for i in range(150)]
    docs = frame(spark, good + noisy + loud)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _, _ in good + noisy + loud] + [(None, 0), (1, 1)],
                                   "doc_id long, quality int")
    learned = rules.learn(rules.labelled_sample(docs, labels))
    assert 1 <= len(learned.rules) <= 3
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs, learned).collect()}
    assert sum(kept[i] != (i < 1000) for i in kept) <= 5
    none = rules.labelled_sample(docs, labels.limit(0))
    assert rules.learn(none).rules == []
