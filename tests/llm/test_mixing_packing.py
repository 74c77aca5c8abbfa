import re
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabwise.llm import mixing, packing
from tests.llm.conftest import frame, prose


def brute_force(weights, blocks):
    """Slot by slot: of the released blocks the one due first, phase by phase."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        period, t, done = sum(weights[s] for s in left), 0, dict.fromkeys(left, 0)
        while True:
            ready = [(-(-(done[s] + 1) * period // weights[s]), s) for s in left if done[s] * period // weights[s] <= t]
            s = min(ready)[1]
            if done[s] == left[s]:
                break
            out.append(s)
            done[s] += 1
            t += 1
            if all(done[x] == left[x] for x in left):
                return out
        left = {x: left[x] - done[x] for x in left if left[x] > done[x]}
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 40)), min_size=1, max_size=6))
def test_phases_match_a_slot_by_slot_schedule(pairs):
    weights = {f"s{i}": w for i, (w, _) in enumerate(pairs)}
    blocks = {f"s{i}": n for i, (_, n) in enumerate(pairs)}
    slots = {}
    for p in mixing.phases(weights, blocks):
        for k in range(p["first"], p["last"]):
            j = k - p["first"]
            slots[p["start"] + j // p["weight"] * p["period"] + p["places"][j % p["weight"]]] = p["source"]
    assert [slots[i] for i in range(sum(blocks.values()))] == brute_force(weights, blocks)


def test_mix_deviates_by_less_than_a_block(spark):
    sizes = {"big": 700, "mid": 200, "small": 100}
    docs = frame(spark, [(i, f"t{i}", s) for s, n in sizes.items() for i in range(n)])
    weights = {"big": 0.5, "mid": 0.3, "small": 0.2}
    rows = sorted(mixing.mix(docs, weights, block_rows=1).collect(), key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in rows] == list(range(1000))
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in rows)
    seen = defaultdict(int)
    for t, r in enumerate(rows, 1):
        seen[r["source"]] += 1
        if all(seen[s] < sizes[s] for s in sizes):
            assert all(abs(seen[s] - weights[s] * t) < 1 for s in sizes)
    assert dict(seen) == sizes


def slots_of(weights, blocks):
    out = {}
    for p in mixing.phases(weights, blocks):
        for k in range(p["first"], p["last"]):
            j = k - p["first"]
            out[p["start"] + j // p["weight"] * p["period"] + p["places"][j % p["weight"]]] = p["source"]
    return [out[i] for i in range(sum(blocks.values()))]


def test_targets_are_kept_over_many_blocks():
    for targets, n in (({"a": 1 / 3, "b": 2 / 3}, 90_000), ({"a": 0.1, "b": 0.2, "c": 0.7}, 50_000),
                       ({"a": 1e-5, "b": 1 - 1e-5}, 300_000), ({"a": 2.0, "b": 5.0, "c": 7 / 3}, 60_000)):
        whole = mixing.integer_weights(targets, mixing.periods(len(targets)))
        total, seen = sum(targets.values()), dict.fromkeys(targets, 0)
        for t, s in enumerate(slots_of(whole, {s: int(w / total * n) + 1 for s, w in targets.items()})[:n], 1):
            seen[s] += 1
            if t % 997 == 0 or t > n - 50:
                assert all(abs(seen[x] - targets[x] / total * t) < 1 + 1e-6 for x in targets)


def test_weights_of_many_sources_differ():
    sizes = {f"s{i}": i + 1 for i in range(2000)}
    whole = mixing.integer_weights({s: n ** 0.5 for s, n in sizes.items()}, mixing.periods(2000))
    assert len(set(whole.values())) > 4 and whole["s1999"] > 4 * whole["s50"]
    roots = {f"s{i}": n ** 0.5 for i, n in enumerate([10**6, 5000, 70, 3])}
    whole = mixing.integer_weights(roots, mixing.periods(4))
    assert all(abs(whole[s] / sum(whole.values()) - w / sum(roots.values())) < 1e-5 for s, w in roots.items())


def test_phases_shorter_than_a_period():
    weights, blocks = {"a": 70_000, "b": 29_999, "c": 1}, {"a": 40, "b": 300, "c": 3}
    assert slots_of(weights, blocks) == brute_force(weights, blocks)
    assert max(len(p["places"]) for p in mixing.phases(weights, blocks)) <= 300


def test_ranks_do_not_depend_on_the_buckets(spark, monkeypatch):
    docs = frame(spark, [(i, f"t{i}", "a" if i % 3 else "b") for i in range(500)])
    want = {r["doc_id"]: r["mix_position"] for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert {r["doc_id"]: r["mix_position"] for r in mixing.mix(docs).collect()} == want


def test_mix_edges(edges, empty, edge_rows):
    for weights in (None, {"a": 2.0, "b": 1.0, "absent": 5.0}):
        rows = mixing.mix(edges, weights, block_rows=3).collect()
        assert sorted(r["mix_position"] for r in rows) == list(range(len(edge_rows)))
        assert {r["mix_source"] for r in rows} == {"a", "b", "c", mixing.NULL_SOURCE}
    assert mixing.mix(empty).count() == 0


def check_pack(docs, rows, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, texts in docs.items():
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc])
        want = []
        for text in texts:
            ids = packing.token_ids(text)
            want += [(k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in
                     enumerate(packing.cut(len(ids), capacity))]
        assert got == sorted(want)


def test_pack_edges(edges, empty, edge_rows):
    docs = defaultdict(list)
    for i, t, _ in edge_rows:
        docs[i].append(t)
    check_pack(docs, packing.pack(edges, capacity=64, group_rows=5).collect(), 64)
    assert packing.pack(empty).count() == 0


def test_pack_is_close_to_the_least_number(spark):
    docs = frame(spark, [(i, prose(i, 20 + i * 7 % 300), "a") for i in range(300)])
    rows = packing.pack(docs).collect()
    used, least = len({r["sequence_id"] for r in rows}), -(-sum(r["length"] for r in rows) // 2048)
    assert used <= 1.05 * least + 1


def test_token_ids_are_the_tokenizers_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "a  b\n\n c", "<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>b <|endoftext|",
             "<|endoftext|>" * 3 + prose(3, 50) + "<|endoftext|>", "né 12345 'll don't\t\t", prose(1, 400), "ß" * 50, " " * 40]
    for text in texts:
        assert packing.token_ids(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]
    parts = list(packing._parts(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], prose(2, 3000)), 2000))
    assert len(parts) > 3
    long = "".join(parts)
    whole = t.encode(long, add_special_tokens=False).ids
    assert [i for p in parts for i in t.encode(p, add_special_tokens=False).ids] == whole
    marked = (prose(4, 200_000) + "<|endoftext|>" + prose(5, 30_000) + " <|endoftext|> ")
    assert len(list(packing._parts(marked))) > 1
    assert packing.token_ids(marked).tolist() == [*t.encode(marked, add_special_tokens=False).ids, 0]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_sum_of_squares_choice(lengths):
    bins, offsets = packing.sum_of_squares(np.array(lengths, dtype=np.int64), 20)
    gaps, opened = {}, 0
    for size, b, o in zip(lengths, bins, offsets, strict=True):
        def total(g):
            n = defaultdict(int)
            for x in g.values():
                if x:
                    n[x] += 1
            return sum(v * v for v in n.values())

        options = [total(gaps | {k: g - size}) for k, g in gaps.items() if g >= size] + [total(gaps | {opened: 20 - size})]
        assert o == 20 - gaps.get(b, 20)
        gaps[b] = gaps.get(b, 20) - size
        assert total(gaps) == min(options)
        opened = max(opened, b + 1)


def test_pack_follows_the_mix(spark):
    docs = frame(spark, [(i, prose(i, 20 + i * 7 % 60), "ab"[i % 2]) for i in range(120)] + [(500, prose(500, 400), "a")])

    def sequences(weights):
        mixed = mixing.mix(docs, weights=weights, block_rows=1)
        place = {r["doc_id"]: r["mix_position"] for r in mixed.collect()}
        found = defaultdict(list)
        for r in packing.pack(mixed, capacity=128, group_rows=20).collect():
            found[r["sequence_id"]].append((place[r["doc_id"]], r["doc_id"], r["piece"]))
        return [sorted(found[k]) for k in sorted(found)]

    one, other = sequences({"a": 1, "b": 9}), sequences({"a": 9, "b": 1})
    assert one != other
    for got in (one, other):
        assert [min(s)[0] for s in got] == sorted(min(s)[0] for s in got)
        assert all(max(s)[0] - min(s)[0] < 20 for s in got)

    def share(got):
        return sum(d % 2 == 0 for s in got[:10] for _, d, _ in s) / sum(len(s) for s in got[:10])

    assert share(one) < 0.5 < share(other)


def test_alike_rows_and_full_pieces_are_not_one_group(spark):
    docs = frame(spark, [(1, "alike", "a")] * 64 + [(2, prose(2, 3000), "a")])
    rows = packing.pack(docs, capacity=64, group_rows=16).collect()
    full = [r["sequence_id"] for r in rows if r["length"] == 64]
    assert len(full) == len(set(full)) > 100 and not set(full) & {r["sequence_id"] for r in rows if r["length"] < 64}
    groups = -(-65 // 16)
    assert len({r["sequence_id"] // 2 % groups for r in rows if r["doc_id"] == 1}) > 1
