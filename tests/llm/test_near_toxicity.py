import random

import numpy as np

from tabwise.llm import near, toxicity
from tests.llm.conftest import frame, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(2)
        most = rng.randrange(6)
        assert near.within_edits(np.array(a, "<u4"), np.array(b, "<u4"), most) == (distance(a, b) <= most)


def test_chains_bound_the_distance():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randrange(60) for _ in range(rng.randrange(30, 90))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b))
            b[i:i + rng.randrange(9)] = [rng.randrange(60) for _ in range(rng.randrange(9))]
        x, y, d = np.array(a, "<u4"), np.array(b, "<u4"), distance(a, b)
        assert near._chained(x, y) >= d
        for most in (d - 1, d, d + 1):
            assert near.within_edits(x, y, most) == (d <= most) == near._banded(x, y, most)


def edited(text, share, seed):
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def by_force(rows):
    """Components of the pairs of five-word shingle similarity 0.8 and more."""
    sets = []
    for _, text, _ in rows:
        w = (text or "").split()
        sets.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else {("blank", text)})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    groups = {}
    for k, (doc, _, _) in enumerate(rows):
        groups.setdefault(label[k], []).append(doc)
    return {d: min(g) for g in groups.values() for d in g}


def test_classes_match_brute_force(spark):
    base = [prose(i, 80 + 10 * i) for i in range(12)]
    rows = [(i, t, "a") for i, t in enumerate(base)]
    rows += [(100 + k, edited(base[k % 12], 0.01 * (k % 6), k), "a") for k in range(150)]
    rows += [(300 + k, base[3], "a") for k in range(40)] + [(400, "a b c", "a"), (401, "a  b c", "a"), (402, "a b", "a")]
    want = by_force(rows)
    for limit in (1_000_000, 0):
        got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(frame(spark, rows), max_nodes=limit).collect()}
        assert got == want
    kept = [r["doc_id"] for r in near.drop_near_duplicates(frame(spark, rows)).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_order_matters(spark):
    parts = [prose(i, 60) for i in range(4)]
    moved = [(1, " ".join(parts), "a"), (2, " ".join(parts[::-1]), "a")]
    assert {r["class_id"] for r in near.near_duplicates(frame(spark, moved)).collect()} == {1, 2}


def test_near_edges(edges, empty, edge_rows):
    rows = near.near_duplicates(edges).collect()
    assert len(rows) == len(edge_rows)
    got = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert got[6] == 5 and got[1] == 1 and got[2] == 1 and got[3] == 3 and got[9] == 9
    kept = near.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 1
    assert near.near_duplicates(empty).count() == 0 and near.drop_near_duplicates(empty).count() == 0


def labelled(spark, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("the of and house river stone green walks under table letter".split()) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["idiot", "moron", "scumbag"])
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(toxic)))
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")


def test_toxicity(spark, edges, empty, edge_rows):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert {r["held_out"] for r in rows.values()} == {True, False}
    assert all(r["predicted"] == int(i % 5 == 0) for i, r in rows.items() if r["held_out"])
    disguised = ["you 1d10t there", "an i d i o t walks", "m0r0n of the river", "the s.c.u.m.b.a.g walks", "idiooooot",
                 "the green river walks under 1010 stone", "well-known house"]
    found = toxicity.score(frame(spark, [(i, t, "a") for i, t in enumerate(disguised)]), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in found] == [1, 1, 1, 1, 1, 0, 0]
    assert toxicity.restore("a m0r0n, an i d i o t", model.lp) == "a moron an idiot"
    long = ["idi" + "o" * 300_000 + "t walks", "a.n.i.d.i.o.t" + ".of.the.green.river.walks.under.the.table.and.the.house" * 2,
            "you are a m o r o n person", "the i d i o t walks"]
    found = toxicity.score(frame(spark, [(i, t, "a") for i, t in enumerate(long)]), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in found] == [1, 1, 1, 1]
    scored = toxicity.score(edges, model).collect()
    assert len(scored) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in scored)
    assert toxicity.score(empty, model).count() == 0
    untrained = toxicity.train(empty, labels.limit(0))
    assert {r["score"] for r in toxicity.score(edges, untrained).collect()} == {0.5}


def by_enumeration(token, lp):
    """Score of the best reading over the whole lattice."""
    best = -1e18
    readings = [(0.0, (toxicity.EDGE, toxicity.EDGE))]
    previous = ""
    for c in token:
        following = []
        for score, (a, b) in readings:
            options = []
            if "a" <= c <= "z":
                options.append((ord(c) - 97, 0.0))
                if c == previous:
                    options.append((-1, toxicity.REPEAT))
            elif c.isdigit():
                options.append((toxicity.OTHER, 0.0))
            else:
                options.append((toxicity.EDGE, 0.0))
                if c in toxicity.MARKS:
                    options.append((-1, toxicity.SET_APART))
            options += [(ord(x) - 97, toxicity.SUBSTITUTE) for x in toxicity.READINGS.get(c, "")]
            for k, price in options:
                if k < 0 or (k == toxicity.EDGE and b == toxicity.EDGE):
                    following.append((score - price, (a, b)))
                else:
                    following.append((score - price + lp[a][b][k], (b, k)))
        readings, previous = following, c
    for score, (a, b) in readings:
        best = max(best, score + (lp[a][b][toxicity.EDGE] if b != toxicity.EDGE else 0.0))
    return best


def score_of(reading, token, lp):
    """Best price at which the token can be read so (a plain search)."""
    found = {}

    def search(i, text, state, previous):
        if i == len(token):
            return 0.0 + (lp[state[0]][state[1]][toxicity.EDGE] if state[1] != toxicity.EDGE else 0.0) if text.strip() == "" else -1e18
        key = i, text, state
        if key in found:
            return found[key]
        c, (a, b), best = token[i], state, -1e18
        moves = [(c, 0.0)] if "a" <= c <= "z" else [("#", 0.0)] if c.isdigit() else [(" ", 0.0)]
        moves += [(x, toxicity.SUBSTITUTE) for x in toxicity.READINGS.get(c, "")]
        if "a" <= c <= "z" and c == previous:
            moves.append(("", toxicity.REPEAT))
        if c in toxicity.MARKS:
            moves.append(("", toxicity.SET_APART))
        for out, price in moves:
            k = -1 if out == "" else ord(out) - 97 if out.isalpha() else toxicity.OTHER if out == "#" else toxicity.EDGE
            if k < 0 or (k == toxicity.EDGE and b == toxicity.EDGE):
                rest = text[1:] if out == " " and text[:1] == " " else text
                best = max(best, search(i + 1, rest, state, c) - price)
            elif text[:1] == out or (out == " " and not text):
                best = max(best, search(i + 1, text[1:], (b, k), c) - price + lp[a][b][k])
        found[key] = best
        return best
    return search(0, reading, (toxicity.EDGE, toxicity.EDGE), "")


def test_restoration_is_the_best_of_the_lattice():
    rng = random.Random(5)
    lp = toxicity.log_probabilities(np.random.default_rng(1).integers(0, 50, (28, 28, 28)).astype(float))
    for _ in range(300):
        token = "".join(rng.choice("aabst01345$@") for _ in range(rng.randrange(1, 8)))
        best = by_enumeration(token, lp)
        assert abs(score_of(toxicity.restore_token(token, lp), token, lp) - best) < 1e-9, token


def test_held_out_labels_are_not_learned(spark):
    docs, labels = labelled(spark, 200)
    wrong = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1).otherwise(
        toxicity.F.col("toxic")))
    assert toxicity.train(docs, labels).weights == toxicity.train(docs, wrong).weights
