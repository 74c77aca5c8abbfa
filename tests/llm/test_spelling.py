import random
import re
import zlib
from collections import Counter

from tabwise.llm import queries, spelling
from tests.llm.conftest import frame


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:]


def by_force(counts, ratio=10):
    """Every pair of words."""
    words = sorted(counts)
    all_near = {w: [v for v in words if near(w, v)] for w in words}
    return by_lists(counts, all_near, ratio)


def by_lists(counts, all_near, ratio=10):
    form = {}
    for w, of in all_near.items():
        best = min(of, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(all_near[w]), counts.get(form[w])))
    return out


def table(spark, counts):
    return spark.createDataFrame([*counts.items(), (None, 5), ("nocount", None)], "word string, n long")


def grouped(spark, counts, ratio=10):
    rows = [tuple(r) for r in spelling.group_spellings(table(spark, counts), ratio).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_all_pairs(spark):
    rng = random.Random(1)
    counts = {}
    for _ in range(900):
        w = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 8)))
        counts[w] = 10 ** rng.randrange(5) + rng.randrange(2)
    assert grouped(spark, counts) == by_force(counts)
    assert grouped(spark, counts, 2) == by_force(counts, 2)


def test_long_words(spark):
    rng = random.Random(2)
    counts = {}
    for size in (62, 63, 64, 65, 66, 200):
        w = "".join(rng.choice("abcß") for _ in range(size))
        counts[w] = 1000 + size
        for k in range(12):
            i = rng.randrange(size)
            counts[w[:i] + rng.choice(["", "a", "zz", w[i] * 2, "ÿ" + w[i]]) + w[i + 1:]] = 10 + k
    for size in range(60, 70):
        counts["x" * size] = 2 ** (size - 58)
    assert grouped(spark, counts) == by_force(counts)
    endless = "y" * 300_000
    assert ("z" + endless, endless, endless, 2, 1, 40) in grouped(spark, {endless: 40, "z" + endless: 2, "abc": 1})


def test_digest_keys_match_the_texts():
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        texts = []
        for i in range(len(word) + 1):
            texts.append((word[i:] + "$" + word[:i], spelling.WHOLE))
            if i < len(word):
                texts.append((word[i + 1:] + "$" + word[:i],
                              spelling.REPEATED if i and word[i - 1] == word[i] else spelling.OPEN))
        keys = [*spelling.digests(word)]
        assert [k for _, k in keys] == [k for _, k in texts]
        again = {}
        for (key, _), (text, _) in zip(keys, texts, strict=True):
            assert again.setdefault(key, text) == text
    a, b = dict(spelling.digests("hause")), dict(spelling.digests("haus"))
    assert len(set(a) & set(b)) == 1


def words_of(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_words_and_edges(spark, edges, empty, edge_rows):
    got = {r["word"]: r["n"] for r in spelling.corpus_words(edges, drop_one_in=31).collect()}
    assert got == words_of([(i, t) for i, t, _ in edge_rows])
    rows = [(i, "Straße STRASSE Überfluß überfluss ×÷letters a" + "b" * 200 + " end", "a") for i in range(80)]
    rows += [(None, rows[0][1], "a"), (3, rows[0][1], "a")]
    got = {r["word"]: r["n"] for r in spelling.corpus_words(frame(spark, rows), drop_one_in=31).collect()}
    assert got == words_of([(i, t) for i, t, _ in rows]) and len(got) > 4
    assert spelling.group_spellings(spelling.corpus_words(empty)).count() == 0
    assert spelling.group_spellings(spelling.corpus_words(edges)).count() > 0


def by_deletions(counts):
    """Near lists by the words' texts without one letter (a second way)."""
    found = {}
    for w in counts:
        for i in range(len(w)):
            found.setdefault((w[:i], w[i + 1:]), []).append(w)
    out = {w: set() for w in counts}
    for (a, b), of in found.items():
        of = of + [a + b] * (a + b in counts)
        for w in of:
            out[w].update(v for v in of if v != w)
    return {w: sorted(v) for w, v in out.items()}


def test_whole_table(spark):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in queries.op13_spelling_variants(spark, sf).collect()]
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    counts = words_of([(d["doc_id"], d["text"]) for d in docs])
    want = by_lists(counts, by_deletions(counts))
    assert len(rows) == len(set(rows)) and set(rows) == want and any(r[1] for r in want)
