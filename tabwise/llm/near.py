"""Near-duplicate classes by Order MinHash and banded alignment.

A document's k-mers are its runs of five words, labelled with their occurrence
number (a shorter text is one k-mer of all its words). Each of 32 hash
functions takes the two labelled k-mers of smallest hash and keeps them in text
order, so a sketch entry is shared by texts that share k-mers in the same
order. Two entries make a band; documents of one band value are a bucket.

Two documents are linked if the Jaccard similarity of their five-word shingles
is at least ``similarity`` and a banded alignment shows that an edit distance
of words of at most ``1 - similarity`` of the longer text turns one into the
other. Classes are the connected components; a class's id is its smallest
document id.

No bucket is expanded into pairs. A bucket's leader is compared with its
members; members that are linked to it are settled. For that, shingles that no
other document of any bucket has are counted: with s shared and u own
shingles, two texts are at most min(s) / (max(s) + u + u') alike, so the leader
is the member with the fewest own shingles, and whoever is too far from it by
that bound is too far from everyone and leaves. Members that may be linked to
someone but not to the leader are looked at in blocks of 256 against blocks of
all members, by one matrix product a pair of blocks that emits only links
between different classes; so no link inside a bucket is lost.

Exact copies are found by digest first; only one of them is sketched. Rows of
one id are one document. A row without an id gets one from its text's hash
(2**62 and more, so other ids come first). Texts without words are alike only if they are equal.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import hinted, small_batches, written
from tabwise.llm.wordhash import batches, mix, rolling, whole_windows, word_hashes

K, FUNCTIONS, BAND = 5, 32, 2
BLOCK = 256
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**64, FUNCTIONS, dtype=np.uint64)
_ODD = _rng.integers(0, 2**64, FUNCTIONS, dtype=np.uint64) | np.uint64(1)


def kmers(words: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every k-mer in text order; a text of 1 to k - 1
    words has one."""
    n = len(words) - k + 1
    starts = np.flatnonzero(whole_windows(offsets, k, n)) if n > 0 else np.empty(0, np.int64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    x = rolling(words, k, 5)[starts] if len(starts) else np.empty(0, np.uint64)
    lengths = np.diff(offsets)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        own = np.array([rolling(words[offsets[d]:offsets[d + 1]], int(lengths[d]), 5)[0] for d in short], np.uint64)
        doc, x = np.concatenate([doc, short]), np.concatenate([x, own])
        order = np.argsort(doc, kind="stable")
        doc, x = doc[order], x[order]
    return doc, x


def labelled(doc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hash of (k-mer, how many equal ones came before in its text)."""
    order = np.lexsort((x, doc))
    same = np.zeros(len(x), bool)
    same[1:] = (x[order][1:] == x[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    at = np.arange(len(x))
    occurrence = at - np.maximum.accumulate(np.where(same, 0, at))
    out = np.empty(len(x), np.uint64)
    with np.errstate(over="ignore"):
        out[order] = mix(x[order] + occurrence.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 9)
    return out


def sketches(doc: np.ndarray, x: np.ndarray, texts: int) -> np.ndarray:
    """Sketch entries, one row per text that has k-mers (see ``np.unique(doc)``)
    and one column per function."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    sizes = np.diff(np.append(starts, len(doc)))
    label = labelled(doc, x)
    top = np.uint64(2**64 - 1)
    out = np.empty((len(starts), FUNCTIONS), np.uint64)
    group = np.repeat(np.arange(len(starts)), sizes)
    with np.errstate(over="ignore"):
        for j in range(FUNCTIONS):
            y = (label ^ _XOR[j]) * _ODD[j]
            first = _place(y, starts, sizes, group, len(starts))
            y[first] = top
            second = np.where(sizes > 1, _place(y, starts, sizes, group, len(starts)), first)
            a, b = np.minimum(first, second), np.maximum(first, second)
            out[:, j] = mix(x[a] * np.uint64(3) + mix(x[b], 21), 30 + j)
    return out


def _place(y: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Position of the smallest value of each group."""
    hits = np.flatnonzero(y == np.repeat(np.minimum.reduceat(y, starts), sizes))
    place = np.empty(n, np.int64)
    place[group[hits][::-1]] = hits[::-1]  # the first of equal ones
    return place


def band_keys(entries: np.ndarray) -> np.ndarray:
    """One key per band and text; the band's number is part of the key."""
    out = np.zeros((len(entries), FUNCTIONS // BAND), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(out.shape[1]):
            for j in range(BAND):
                out[:, b] = mix(out[:, b] * np.uint64(31) + entries[:, b * BAND + j], 70 + b)
    return out.view(np.int64)


def _bands(rows: DataFrame) -> DataFrame:
    """(node, keys) of every text with words."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, nodes = frame["text"].tolist(), frame["node"].to_numpy()
            for a, b in batches(texts):
                words, offsets = word_hashes(texts[a:b])
                doc, x = kmers(words, offsets)
                if len(x):
                    keys = band_keys(sketches(doc, x, b - a))
                    yield pd.DataFrame({"node": nodes[a:b][np.unique(doc)], "keys": list(keys)})

    return rows.select("node", "text").mapInPandas(run, "node bigint, keys array<bigint>")


def _word_table(rows: DataFrame) -> DataFrame:
    """(node, words, shingles): word hashes of 32 bits as bytes, and the set of
    k-mer hashes."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, nodes = frame["text"].tolist(), frame["node"].to_numpy()
            for a, b in batches(texts):
                words, offsets = word_hashes(texts[a:b])
                doc, x = kmers(words, offsets)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                small = (words >> np.uint64(32)).astype("<u4")
                yield pd.DataFrame({
                    "node": nodes[a:b],
                    "words": [small[offsets[i]:offsets[i + 1]].tobytes() for i in range(b - a)],
                    "shingles": [np.unique(x[cuts[i]:cuts[i + 1]]).view(np.int64) for i in range(b - a)]})

    return rows.select("node", "text").mapInPandas(run, "node bigint, words binary, shingles array<bigint>")


def _shingles(w: np.ndarray) -> np.ndarray:
    """The set of five-word shingles of a word array."""
    return np.unique(rolling(w.astype(np.uint64), min(K, len(w)), 6))


def shingle_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the five-word shingles of two word arrays."""
    x, y = _shingles(a), _shingles(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def within_edits(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most ``most`` words must be inserted, deleted or replaced to
    turn ``a`` into ``b``. Common ends are cut off; a chain of shingles that
    both have once gives an alignment, which settles most pairs that are
    alike; the rest is aligned exactly in a band."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + head:][::-1] != b[len(b) - n + head:][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if max(len(a), len(b)) <= most or _chained(a, b) <= most:
        return True
    return _banded(a, b, most)


def _chained(a: np.ndarray, b: np.ndarray) -> int:
    """Edits of an alignment along shingles that occur once in both texts, in
    an order that rises in both: never below the edit distance."""
    if len(a) < K or len(b) < K:
        return max(len(a), len(b))
    once = []
    for w in (a, b):
        x, at, n = np.unique(rolling(w.astype(np.uint64), K, 6), return_index=True, return_counts=True)
        once.append((x[n == 1], at[n == 1]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    i, j = once[0][1][i], once[1][1][j]
    order = np.argsort(i)
    i, j = i[order], j[order]
    ends: list[int] = []  # longest rising chain of j: last element, and the one before each
    last: list[int] = []
    before = np.full(len(j), -1)
    for k, y in enumerate(j.tolist()):
        p = bisect_left(ends, y)
        before[k] = last[p - 1] if p else -1
        ends[p:p + 1], last[p:p + 1] = [y], [k]
    chain = []
    k = last[-1] if last else -1
    while k >= 0:
        chain.append(k)
        k = int(before[k])
    edits, x, y = 0, 0, 0  # the next words to align
    for k in [*chain[::-1], -1]:
        to_x, to_y = (len(a), len(b)) if k < 0 else (int(i[k]), int(j[k]))
        if to_x < x or to_y < y:  # the shingle begins inside the one before
            if to_x - x == to_y - y:
                x, y = max(x, to_x + K), max(y, to_y + K)
            continue
        if to_x - x == to_y - y:
            edits += int(np.count_nonzero(a[x:to_x] != b[y:to_y]))
        else:
            edits += max(to_x - x, to_y - y)
        if k >= 0:
            x, y = to_x + K, to_y + K
    return edits


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """The same by furthest-reaching points along the diagonals that a path of
    at most ``most`` edits can touch."""
    breaks: dict[int, np.ndarray] = {}  # diagonal -> positions in a where the words differ, then the end
    goal = len(b) - len(a)

    def slide(i: int, d: int) -> int:
        """Furthest position in ``a`` from i along diagonal d (b = a + d)."""
        if d not in breaks:
            lo, hi = max(0, -d), min(len(a), len(b) - d)
            differ = np.flatnonzero(a[lo:hi] != b[lo + d:hi + d]) + lo if hi > lo else np.empty(0, np.int64)
            breaks[d] = np.append(differ, max(hi, lo)).astype(np.int32)
        at = breaks[d]
        return max(i, int(at[min(int(np.searchsorted(at, i)), len(at) - 1)]))

    reach = {0: slide(0, 0)}
    for edits in range(most + 1):
        if reach.get(goal, -1) >= len(a):
            return True
        if edits == most:
            return False
        following = {}
        for d in range(max(-edits - 1, -len(a)), min(edits + 1, len(b)) + 1):
            if abs(goal - d) > most - edits - 1 or abs(d) + abs(goal - d) > most:
                continue  # too far from the end, or from the straight way, for the edits there are
            options = []
            if d in reach:
                options.append(reach[d] + 1)  # replace
            if d - 1 in reach:
                options.append(reach[d - 1])  # insert a word of b
            if d + 1 in reach:
                options.append(reach[d + 1] + 1)  # delete a word of a
            if options:
                i = min(max(options), len(a), len(b) - d)
                if i >= max(0, -d):
                    following[d] = slide(i, d)
        for d in [d for d in breaks if d not in following and abs(d) + abs(goal - d) > most - edits]:
            del breaks[d]
        reach = following
    return False


def linked(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Shingle similarity first (cheap), then the alignment."""
    if shingle_similarity(a, b) < similarity:
        return False
    return within_edits(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9))


def _verified(pairs: DataFrame, words: DataFrame, similarity: float, max_nodes: int) -> DataFrame:
    """The (leader, node) pairs that are linked. Few pairs are broadcast, so
    that only the words they need are shuffled."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = [linked(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), similarity)
                  for a, b in zip(frame["leader_words"], frame["words"], strict=True)]
            yield frame.loc[ok, ["leader", "node"]]

    pairs = written(pairs.select("leader", "node").distinct())
    small = pairs.count() <= max_nodes
    texts = words.select("node", "words").join(F.broadcast(pairs) if small else pairs, "node")
    leaders = words.select(F.col("node").alias("leader"), F.col("words").alias("leader_words"))
    if small:
        leaders = leaders.join(F.broadcast(pairs.select("leader").distinct()), "leader", "left_semi")
    return written(texts.join(leaders, "leader").select("leader", "node", "leader_words", "words").mapInPandas(
        run, "leader bigint, node bigint").distinct())


def _own_shingles(words: DataFrame) -> DataFrame:
    """(node, s, u): shingles shared with other documents and own ones."""
    one = words.select("node", F.explode("shingles").alias("x")).groupBy("x").agg(
        F.min("node").alias("node"), F.max("node").alias("other"))
    own = one.filter("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    size = words.groupBy("node").agg(F.max(F.size("shingles")).alias("n"))
    return size.join(own, "node", "left").select(
        "node", (F.col("n") - F.coalesce("u", F.lit(0))).alias("s"), F.coalesce("u", F.lit(0)).alias("u"))


def _can_link(similarity: float) -> tuple[Column, Column]:
    """Bounds for (s, u) and the leader's (ls, lu): whether the two can be
    similar; whether the member can be similar to anyone with at least the
    leader's number of own shingles."""
    s, u, ls, lu = (F.col(c) for c in ("s", "u", "ls", "lu"))
    pair = F.least(s, ls) >= similarity * (F.greatest(s, ls) + u + lu) - 1e-6
    anyone = u + lu <= (1 / similarity - 1) * s + 1e-6
    return pair, anyone


def _led(left: DataFrame, words: DataFrame, similarity: float, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Every bucket's leader against its members (key, node, s, u): the links,
    and the members (key, node) that are not linked to their leader but may be
    to another one."""
    pair, anyone = _can_link(similarity)
    leader = left.groupBy("key").agg(F.min(F.struct("u", "node", "s")).alias("l"))
    leader = leader.select("key", F.col("l.node").alias("leader"), F.col("l.u").alias("lu"), F.col("l.s").alias("ls"))
    members = written(left.join(leader, "key").filter(F.col("node") != F.col("leader")).filter(anyone)
                      .withColumn("try", pair))
    new = _verified(members.filter("try"), words, similarity, max_nodes)
    return new, written(members.join(hinted(new, max_nodes), ["leader", "node"], "left_anti").select("key", "node"))


def _unsettled(rest: DataFrame, buckets: DataFrame, words: DataFrame, label: DataFrame, similarity: float,
               max_nodes: int) -> DataFrame:
    """Links of the members left over with all members of their buckets. Both
    sides of a bucket are dealt into blocks of about ``BLOCK`` and each pair of
    blocks is one group, so no group grows with the data; inside, one matrix
    product gives all shingle similarities, and of those that reach the bound
    only pairs of different classes are aligned."""
    sides = rest.groupBy("key").agg(F.count(F.lit(1)).alias("f")).join(
        buckets.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "key").select(
        "key", F.ceil(F.col("f") / BLOCK).cast("int").alias("fs"), F.ceil(F.col("k") / BLOCK).cast("int").alias("ks"))
    sides = hinted(written(sides), max_nodes)
    hashed = F.xxhash64("node", "key")
    mine = rest.join(sides, "key").select(
        "key", "node", F.lit(True).alias("open"), F.pmod(hashed, F.col("fs")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("ks") - 1)).alias("j"))
    mates = buckets.join(sides, "key").select(
        "key", "node", F.lit(False).alias("open"), F.explode(F.sequence(F.lit(0), F.col("fs") - 1)).alias("i"),
        F.pmod(hashed, F.col("ks")).cast("int").alias("j"))
    rows = written(mine.unionByName(mates).join(hinted(label, max_nodes), "node", "left").select(
        "key", "i", "j", "node", "open", F.coalesce("class", "node").alias("class")))
    few = words.join(hinted(written(rows.select("node").distinct()), max_nodes), "node", "left_semi")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = _block_links(frame, similarity)
        return pd.DataFrame(found, columns=["leader", "node"]).astype("int64")

    return written(rows.join(few.select("node", "words"), "node").groupBy("key", "i", "j").applyInPandas(
        run, "leader bigint, node bigint").distinct())


def _block_links(frame: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links that connect classes, between the open rows and the others."""
    a, b = (x.drop_duplicates("node") for x in (frame[frame["open"]], frame[~frame["open"]]))
    texts = [np.frombuffer(w, "<u4") for w in [*a["words"], *b["words"]]]
    sets = [_shingles(w) for w in texts]
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.empty(0, int)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    shared = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(ids[-1]) + 1 if len(ids) else 0, 4096):  # a slice of the shingles at a time
        lo, hi = np.searchsorted(ids, [start, start + 4096])
        one = np.zeros((len(sets), 4096), np.float32)
        one[row[lo:hi], ids[lo:hi] - start] = 1
        shared += one[:len(a)] @ one[len(a):].T
    total = sizes[:len(a), None] + sizes[None, len(a):] - shared
    i, j = np.nonzero(shared >= similarity * total - 1e-6)
    nodes = np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()])
    parent = {int(c): int(c) for c in frame["class"]}
    label = [int(c) for c in [*a["class"], *b["class"]]]

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for k in np.argsort(-(shared[i, j] / total[i, j]), kind="stable"):
        x, y = int(i[k]), len(a) + int(j[k])
        if nodes[x] == nodes[y] or root(label[x]) == root(label[y]):
            continue
        if linked(texts[x], texts[y], similarity):
            parent[root(label[x])] = root(label[y])
            out.append((min(int(nodes[x]), int(nodes[y])), max(int(nodes[x]), int(nodes[y]))))
    return out


def links(rows: DataFrame, similarity: float = 0.8, max_nodes: int = 1_000_000) -> DataFrame:
    """(leader, node) of linked documents of ``rows`` (node, text): enough of
    them to connect all that are linked and share a bucket."""
    keyed = written(_bands(rows)).select("node", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    buckets = written(keyed.join(shared, "key"))
    nodes = written(buckets.select("node").distinct())
    words = written(_word_table(rows.join(hinted(nodes, max_nodes), "node", "left_semi")))
    found, rest = _led(written(buckets.join(_own_shingles(words), "node")), words, similarity, max_nodes)
    if rest.isEmpty():
        return found
    return found.unionByName(_unsettled(rest, buckets, words, components(found), similarity, max_nodes))


def components(edges: DataFrame) -> DataFrame:
    """(node, class) of the connected components of (leader, node) links; the
    class is the smallest node. Labels spread to neighbours and jump to their
    labels' labels, so the rounds grow with the logarithm of the longest chain."""
    both = written(edges.select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(
        edges.select(F.col("node").alias("a"), F.col("leader").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("class")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("class").alias("m"))
        spread = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("class").alias("old"), F.least("class", "m").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("class").alias("up"))
        after = written(spread.join(up, "c", "left").select(
            "node", "old", F.least("c", F.coalesce("up", "c")).alias("class")))
        labels = after.select("node", "class")
        if after.filter("old != class").isEmpty():
            return labels


def with_node(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__node``: the id, or for a null id one from the text."""
    made = F.lit(2**62) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2)
    return docs.withColumn("__node", F.coalesce(F.col(id_col).cast("long"), made))


def classes(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
            max_nodes: int = 1_000_000) -> DataFrame:
    """(node, class) of every document whose class has a smaller id than its
    own; all other documents are the first of their class."""
    small_batches(docs.sparkSession)
    rows = with_node(docs, id_col, text_col).select(
        F.col("__node").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = rows.select("node", F.md5("text").alias("digest")).distinct()
    first = slim.groupBy("digest").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter(
        "last > first").select("digest", "first")
    copies = written(slim.join(first, "digest").filter("node > first").select("node", "first").distinct())
    single = rows.join(hinted(copies.select("node").distinct(), max_nodes), "node", "left_anti")
    labels = components(links(single, similarity, max_nodes))
    # a copy takes the class of its first one
    moved = labels.select(F.col("node").alias("first"), F.col("class").alias("of_first"))
    of_copies = copies.join(moved, "first", "left").select("node", F.coalesce("of_first", "first").alias("class"))
    return written(labels.unionByName(of_copies).filter("node != class").groupBy("node").agg(
        F.min("class").alias("class")))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                    max_nodes: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: its id and ``class_id``."""
    later = classes(docs, similarity, id_col, text_col, max_nodes)
    rows = with_node(docs, id_col, text_col).select(F.col(id_col), "__node")
    return rows.join(hinted(later, max_nodes).withColumnRenamed("node", "__node"), "__node", "left").select(
        id_col, F.coalesce("class", "__node").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                         max_nodes: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` without those of every class's later documents; of
    repeated rows of one id, one stays."""
    later = classes(docs, similarity, id_col, text_col, max_nodes)
    rows = with_node(docs, id_col, text_col)
    again = written(rows.groupBy("__node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__node"))
    kept = rows.join(hinted(later, max_nodes).select(F.col("node").alias("__node")), "__node", "left_anti")
    if not again.isEmpty():
        repeated = hinted(again, max_nodes)
        kept = kept.join(repeated, "__node", "left_anti").unionByName(
            kept.join(repeated, "__node", "left_semi").dropDuplicates(["__node"]))
    return kept.select(*docs.columns)
