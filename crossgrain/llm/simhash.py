"""SimHash near-duplicates through a binary trie self-join.

Every document has a 64-bit fingerprint of its word shingles or, where more edits than a few bits of that
stand for shall be found, several of its set of words under different seeds, each of which may link it.
Equal fingerprints become one row. The
distinct ones are leaves of a binary trie over their bits, and pairs within the Hamming budget are found
by walking the trie against itself: a pair of nodes carries the bits in which its two paths differ, its
pairs of children are visited in turn, and a pair goes as soon as the differing bits exceed the budget.

Spark: the upper trie is cut into a frontier of nodes of at most `MOST_LEAVES` leaves: from counts of 16-bit
prefixes (at most 65,536 rows to the driver) and, below prefixes that have more, of four bits more at a time, until
none has. Each pair of frontier nodes whose paths are within the
budget is one task, which walks its part with arrays, level by level and in blocks of bounded size; which pairs
those are is worked out in tasks, too. A
task returns no pairs but a spanning star for each set of its linked leaves, fewer rows than leaves.
Components are joined from the stars by `components.connected`.
That copies a leaf to every node within the budget. Where there are several seeds, each has budget + 1 tries instead
(`turned`), of the same bits turned so that another run of them comes first: fingerprints within the budget have one of
these runs in common, so that each trie is walked for pairs that part below its first run only, and a leaf is copied
to budget + 1 nodes however many nodes there are.

Where `least_jaccard` is given, fingerprints only propose: distinct texts (of the same words in the same order,
whatever their case and spaces) are nodes, and no link joins a component before the sets of five-word shingles of
its two texts are compared. Star links are compared first, to their roots and to the text of the star that has
the fewest shingles of its own, then every pair within the budget that these left in two components. A shingle
that no other proposed text has can be in no intersection, and two texts differ in as many shingles at least as
in bits of which each shingle of a text turns one; pairs that cannot reach the similarity for either are not made. So a large group of near copies does not give all its pairs, and no pair that reaches it is lost. A row without a doc_id,
which always stays, proposes nothing there. Texts are joined only where a bitmap of the doc_ids that are looked for
has theirs; what it has beyond those costs work and changes nothing.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and are linked
like any other; every row gives one row, repeated rows included; a null doc_id is linked but never an
id of a component, which is null only where all its doc_ids are; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm.components import connected
from crossgrain.llm.substring_dedup import BITS_EACH, LEAST_BITS, MOST_BITS, bitmap, in_bitmap
from crossgrain.llm.text import give_back_memory, pieces
from crossgrain.sources.scratch import materialize
from crossgrain.sources.tables import table

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Words of the shingles whose sets are compared where a Jaccard similarity is asked for.
JACCARD_WORDS = 5
#: Bits of the sketch that bounds from below how many shingles differ.
SKETCH_BITS = 512
#: Bits of a prefix that leaves are counted by, and those that are added where it has too many.
COUNT_BITS, MORE_BITS = 16, 4
#: The same first bits where a seed has several tries, and the fewest bits of a run that are worth a trie.
COUNT_BITS_TURNED, LEAST_RUN = 8, 8
#: Leaves of a frontier node: a twelfth of all, between these.
LEAST_LEAVES, MOST_LEAVES, LEAST_NODES = 64, 32_768, 12
#: Node pairs whose table is broadcast; more are joined with a shuffle.
MOST_BROADCAST = 2_000_000
#: Node pairs, or pairs of leaves, that a task has as arrays at a time.
BLOCK = 1 << 18


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of `hashes`."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Of the shingles of UTF-8 text, repeats included."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxh64_intdigest(b" ".join(words), SEED)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle_words].tolist()]
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    return majority_bits(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def word_set_fingerprints(data: bytes, seeds: tuple[int, ...]) -> list[int]:
    """Of the distinct words of UTF-8 text, under each seed: an edited word changes one feature, not one for each shingle. A word is hashed once, and its hash mixed with each seed."""
    from xxhash import xxh64_intdigest

    words = set(data.lower().split())
    if not words:
        return [0] * len(seeds)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out = []
    for seed in seeds:
        z = h + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority_bits(z ^ (z >> np.uint64(31))))
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, word_set_seeds: tuple[int, ...] = ()) -> DataFrame:
    """doc_id and fps, signed longs, of each row of `docs` (doc_id, text): one of its shingles or, with `word_set_seeds`, one of its words for each."""

    def hashed(batches):
        import pyarrow as pa

        for b in pieces(batches, "text"):
            data = [(t or "").encode() for t in b.column("text").to_pylist()]
            fps = [word_set_fingerprints(d, word_set_seeds) if word_set_seeds else [fingerprint(d, shingle_words)] for d in data]
            flat = pa.array(np.array(fps, np.uint64).reshape(-1).view(np.int64), pa.int64())
            width = len(word_set_seeds) or 1
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(fps) * width + 1, width), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], ["doc_id", "fps"])
        give_back_memory()
    return docs.select("doc_id", "text").mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fps array<long>")


class Trie:
    """The binary trie of sorted distinct 64-bit leaves: for each depth, where nodes start and what their children are."""

    def __init__(self, leaves: np.ndarray, top: int, bottom: int):
        self.leaves, self.starts, self.children = leaves, {}, {}
        for d in range(top, bottom + 1):
            if d == 0:
                cut = np.zeros(0, np.int64)
            else:
                prefix = leaves >> np.uint64(64 - d)
                cut = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
            self.starts[d] = np.concatenate(([0], cut, [len(leaves)])).astype(np.int64)
        for d in range(top, bottom):
            upper, lower = self.starts[d][:-1], self.starts[d + 1]
            first = np.searchsorted(lower, upper).astype(np.int32)
            two = lower[first + 1] < self.starts[d][1:]
            high = (leaves[upper] >> np.uint64(63 - d)) & np.uint64(1) == 1
            zero, one = np.where(high, -1, first).astype(np.int32), np.where(high, first, np.where(two, first + 1, -1)).astype(np.int32)
            self.children[d] = (zero, one)


def trie_pairs(left: np.ndarray, right: np.ndarray | None, budget: int, block: int = BLOCK, run: int = 0, before: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in left, j in right) of sorted distinct leaves within `budget` bits; right None: i < j, both in left. Of those only the ones that have the first `run` bits in common and none of the last `before` runs."""
    if not len(left) or right is not None and not len(right):
        return
    n = max(len(left), 0 if right is None else len(right))
    bottom = min(64, int(np.ceil(np.log2(n + 1))) + 3)
    a = Trie(left, 0, bottom)
    b = a if right is None else Trie(right, 0, bottom)
    zero = np.zeros(1, np.int32)
    work = [(0, zero, zero, np.zeros(1, np.uint8))]
    while work:
        d, x, y, off = work.pop()
        if len(x) > block:
            half = len(x) // 2
            work += [(d, x[half:], y[half:], off[half:]), (d, x[:half], y[:half], off[:half])]
            continue
        if d == bottom:
            yield from _leaf_pairs(a, b, x, y, d, budget, block, run, before)
            continue
        (a0, a1), (b0, b1) = a.children[d], b.children[d]
        x0, x1, y0, y1 = a0[x], a1[x], b0[y], b1[y]
        spare = off < (budget if d >= run else 0)
        parts = []
        for u, v, ok, more in ((x0, y0, None, 0), (x1, y1, None, 0), (x0, y1, spare, 1), (x1, y0, spare if right is not None else spare & (x != y), 1)):
            keep = (u >= 0) & (v >= 0)
            if ok is not None:
                keep &= ok
            parts.append((u[keep], v[keep], off[keep] + np.uint8(more)))
        x, y, off = (np.concatenate(p) for p in zip(*parts, strict=True))
        if len(x):
            work.append((d + 1, x, y, off))


def _leaf_pairs(a: Trie, b: Trie, x: np.ndarray, y: np.ndarray, d: int, budget: int, block: int, run: int, before: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs below node pairs at the lowest depth that are within the budget."""
    sa, sb = a.starts[d], b.starts[d]
    na, nb = sa[x + 1] - sa[x], sb[y + 1] - sb[y]
    size = na * nb
    ends = np.cumsum(size)
    at, total = 0, int(ends[-1]) if len(ends) else 0
    while at < total:
        stop = min(at + block, total)
        flat = np.arange(at, stop)
        k = np.searchsorted(ends, flat, side="right")
        within = flat - (ends[k] - size[k])
        i, j = sa[x[k]] + within // nb[k], sb[y[k]] + within % nb[k]
        off = a.leaves[i] ^ b.leaves[j]
        near = np.bitwise_count(off) <= budget
        if run:
            near &= off >> np.uint64(64 - run) == 0
        for r in range(before):
            near &= (off >> np.uint64(r * run)) & np.uint64((1 << run) - 1) != 0
        if a is b:
            near &= (x[k] != y[k]) | (i < j)
        if near.any():
            yield i[near], j[near]
        at = stop


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives the sets that the links (i, j) join the smallest label among them, in place; labels[k] <= k."""
    while True:
        p, q = labels[i], labels[j]
        open_ = p != q
        if not open_.any():
            return
        i, j, p, q = i[open_], j[open_], p[open_], q[open_]
        np.minimum.at(labels, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def local_stars(left: np.ndarray, right: np.ndarray | None, budget: int, run: int = 0, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, smallest linked leaf) for the leaves of a task that are linked to a smaller one; of leaves that are turned by `turn` runs, as they were before."""
    every = left if right is None else np.concatenate((left, right))
    labels, shift = np.arange(len(every)), 0 if right is None else len(left)
    for i, j in trie_pairs(left, right, budget, run=run):
        _join_labels(labels, i, j + shift)
    if turn:
        by = np.uint64(turn * run)
        every = (every >> by) | (every << (np.uint64(64) - by))
    least = every.copy()
    np.minimum.at(least, labels, every)
    linked = np.flatnonzero(every != least[labels])
    return every[linked], least[labels[linked]]


def split(counts: dict[int, int], top: int, bottom: int, most: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Of leaves `counts` by the prefix of `bottom` bits: (path, depth) of the highest nodes below `top` bits that have at most `most` leaves, and the prefixes that have more."""
    sums: list[dict[int, int]] = [{} for _ in range(bottom - top + 1)]
    sums[-1] = dict(counts)
    for d in range(bottom - top - 1, -1, -1):
        for p, n in sums[d + 1].items():
            sums[d][p >> 1] = sums[d].get(p >> 1, 0) + n
    found, over, work = [], [], [(p, 0) for p in sums[0]]
    while work:
        path, d = work.pop()
        if path not in sums[d]:
            continue
        if sums[d][path] <= most:
            found.append((path, top + d))
        elif d == bottom - top:
            over.append(path)
        else:
            work += [(2 * path + 1, d + 1), (2 * path, d + 1)]
    return found, over


def runs_of(budget: int) -> tuple[int, int]:
    """(runs, bits of each): as many as share no bit and cannot all differ within the budget; one of no bits where they would be too short."""
    bits = 64 // (budget + 1)
    return (budget + 1, bits) if bits >= LEAST_RUN else (1, 0)


def turned(leaves: DataFrame, budget: int) -> DataFrame:
    """`leaves` (seed, fp and others) once for each run: fp turned so that the run comes first, and seed * runs + run for seed."""
    runs, bits = runs_of(budget)
    each = leaves.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    fp = F.expr(f"shiftleft(fp, turn * {bits}) | shiftrightunsigned(fp, 64 - turn * {bits})")  # by 64 bits: not at all
    return each.withColumns({"fp": fp, "seed": (F.col("seed") * runs + F.col("turn")).cast("int")}).select(*leaves.columns)


def frontier(leaves: DataFrame, count_bits: int = COUNT_BITS) -> list[tuple[int, int]]:
    """(path, depth), in order, of trie nodes that cover all of `leaves` (seed, fp) and have at most MOST_LEAVES of any seed, or a single fingerprint."""
    prefix = lambda d: F.shiftrightunsigned("fp", 64 - d)

    def counted(df: DataFrame, d: int) -> dict[int, int]:
        of_seed = df.groupBy("seed", prefix(d).alias("p")).agg(F.count("*").alias("n"))
        return {r["p"] & (1 << 64) - 1: r["n"] for r in of_seed.groupBy("p").agg(F.max("n").alias("n")).collect()}

    depth, counts = count_bits, counted(leaves, count_bits)
    most = max(min(sum(counts.values()) // LEAST_NODES, MOST_LEAVES), LEAST_LEAVES)
    nodes, over = split(counts, 0, depth, most)
    while over and depth < 64:
        top, depth = depth, depth + MORE_BITS
        hot = leaves.sparkSession.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in over], "p long")
        some = leaves.select("seed", "fp").join(F.broadcast(hot), prefix(top) == F.col("p"), "left_semi")  # fewer prefixes than leaves / MOST_LEAVES
        more, over = split(counted(some, depth), top, depth, most)
        nodes += more
    return sorted([*nodes, *((p, depth) for p in over)], key=lambda n: n[0] << (64 - n[1]))


def partners(paths: np.ndarray, depths: np.ndarray, i: int, budget: int, run: int = 0) -> np.ndarray:
    """The nodes from `i` on whose paths are within the budget of its own, over the bits that both have, and differ in none of the first `run`; `paths` start at the highest bit."""
    common = np.minimum(depths[i:], depths[i]).astype(np.uint64)
    off = np.where(common == 0, np.uint64(0), (paths[i:] ^ paths[i]) >> ((np.uint64(64) - common) & np.uint64(63)))
    first = np.minimum(common, np.uint64(run))
    parted = np.where(first == 0, np.uint64(0), (paths[i:] ^ paths[i]) >> ((np.uint64(64) - first) & np.uint64(63)))
    return i + np.flatnonzero((np.bitwise_count(off) <= budget) & (parted == 0))


def _dealt(leaves: DataFrame, budget: int, run: int = 0) -> DataFrame:
    """`leaves` (seed, fp and others) with task and side, a row for each task of its frontier node: one for each pair of nodes whose paths are within the budget and have the first `run` bits in common."""
    spark = leaves.sparkSession
    nodes = frontier(leaves, COUNT_BITS_TURNED if run else COUNT_BITS)
    paths, depths = np.array([p << (64 - d) for p, d in nodes], np.uint64), np.array([d for _, d in nodes], np.int64)
    held = spark.sparkContext.broadcast((paths, depths))  # fewer nodes than leaves / MOST_LEAVES, twice at most, or 65,536

    def routed(batches):
        import pyarrow as pa

        paths, depths = held.value
        for b in batches:
            for i in b.column("id").to_pylist():
                j = partners(paths, depths, i, budget, run)
                task = (np.int64(i) << np.int64(32)) + j
                other = j != i
                columns = np.concatenate((np.full(len(j), i), j[other])), np.concatenate((task, task[other])), np.concatenate((np.zeros(len(j), np.int8), np.ones(other.sum(), np.int8)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["trie_node", "task", "side"])

    def numbered(batches):
        import pyarrow as pa

        paths, _ = held.value
        for b in batches:
            at = np.searchsorted(paths, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int64))], [*b.schema.names, "trie_node"])

    kinds = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in leaves.columns)
    routes = materialize(spark.range(len(nodes)).mapInArrow(routed, "trie_node long, task long, side byte"), "simhash-routes")
    if routes.count() <= MOST_BROADCAST:
        routes = F.broadcast(routes)
    return leaves.mapInArrow(numbered, f"{kinds}, trie_node long").join(routes, "trie_node").select(*leaves.columns, "task", "side")


def near_links(leaves: DataFrame, budget: int = MAX_BITS, by_runs: bool = False) -> DataFrame:
    """(seed, a, b) star links that connect all of `leaves` (seed, fp, distinct) of a seed within `budget` bits, and no others; `by_runs`: from a trie for each run of bits."""
    runs, run = runs_of(budget) if by_runs else (1, 0)

    def walked(key, group):
        import pyarrow as pa

        fps, side = group.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), group.column("side").to_numpy(zero_copy_only=False)
        left, right = np.sort(fps[side == 0]), np.sort(fps[side == 1])
        seed, turn = divmod(key[0].as_py(), runs)
        a, b = local_stars(left, right if len(right) else None, budget, run, turn)
        give_back_memory()
        return pa.table({"seed": pa.array([seed] * len(a), pa.int32()), "a": a.view(np.int64), "b": b.view(np.int64)})

    leaves = leaves.select("seed", "fp")
    return _dealt(turned(leaves, budget) if run else leaves, budget, run).groupBy("seed", "task").applyInArrow(walked, "seed int, a long, b long")


def open_pairs(fps: np.ndarray, side: np.ndarray, labels: np.ndarray, budget: int, possible=None, run: int = 0, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of `fps` within `budget` bits whose labels differ: x of side 0 and y of side 1 or, without that side, any two once; `possible` says of places (x, y) which may be similar. Of `fps` turned by `turn` runs, those that no smaller turn has."""
    own = not (side == 1).any()
    sorted_rows = [np.flatnonzero(side == k)[np.argsort(fps[side == k], kind="stable")] for k in ((0,) if own else (0, 1))]
    leaves, starts, sizes = zip(*(np.unique(fps[rows], return_index=True, return_counts=True) for rows in sorted_rows), strict=True)
    out = []

    def add(i: np.ndarray, j: np.ndarray, same: bool) -> None:
        size = sizes[0][i] * sizes[-1][j]
        ends = np.cumsum(size)
        at, total = 0, int(ends[-1]) if len(ends) else 0
        while at < total:  # rows below two leaves, in blocks
            flat = np.arange(at, min(at + BLOCK, total))
            k = np.searchsorted(ends, flat, side="right")
            within = flat - (ends[k] - size[k])
            u, v = within // sizes[-1][j[k]], within % sizes[-1][j[k]]
            x, y = sorted_rows[0][starts[0][i[k]] + u], sorted_rows[-1][starts[-1][j[k]] + v]
            keep = labels[x] != labels[y]
            if same:
                keep &= u < v
            x, y = x[keep], y[keep]
            if possible:
                keep = possible(x, y)
                x, y = x[keep], y[keep]
            out.append((x, y))
            at += BLOCK

    for i, j in trie_pairs(leaves[0], None if own else leaves[1], budget, run=run, before=turn):
        add(i, j, False)
    if own and not turn:
        shared = np.flatnonzero(sizes[0] > 1)
        add(shared, shared, True)
    x, y = (np.concatenate([p[k] for p in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
    return x, y


def near_pairs(rows: DataFrame, least: float, budget: int = MAX_BITS) -> DataFrame:
    """(a, b) of all nodes of `rows` (seed, node, fp, label, n, n_common, sketch) within `budget` bits under a seed whose labels differ and whose similarity may be `least`."""

    runs, run = runs_of(budget)

    def walked(key, group):
        import pyarrow as pa

        fps, side = group.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), group.column("side").to_numpy(zero_copy_only=False)
        labels = group.column("label").combine_chunks().dictionary_encode()
        labels = (labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels).indices.to_numpy(zero_copy_only=False)
        n, common = (group.column(c).to_numpy(zero_copy_only=False) for c in ("n", "n_common"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)

        def possible(x, y):
            shared = np.minimum(common[x], common[y])
            may = shared >= least * (n[x] + n[y] - shared) - 1e-9
            for at in range(0, len(x), 1 << 14):
                part = slice(at, at + (1 << 14))
                i, j = x[part], y[part]
                differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1)
                may[part] &= differ <= (n[i] + n[j]) * (1 - least) / (1 + least) + 1e-9
            return may

        x, y = open_pairs(fps, side, labels, budget, possible, run, key[0].as_py() % runs)
        nodes = group.column("node")
        found = pa.table({"a": nodes.take(pa.array(x)), "b": nodes.take(pa.array(y))})
        give_back_memory()
        return found

    rows = rows.select("seed", "node", "fp", "label", "n", "n_common", "sketch")
    return _dealt(turned(rows, budget) if run else rows, budget, run).groupBy("seed", "task").applyInArrow(walked, "a binary, b binary")


def group_links(groups: DataFrame, width: int, budget: int, of_texts: bool = False) -> DataFrame:
    """(a, b) links of `groups` (node, fps): equal or near under any of `width` fingerprints; a node that has one fingerprint is that, unless nodes are `of_texts`."""
    if width == 1 and not of_texts:
        return near_links(groups.select(F.lit(0).alias("seed"), F.col("node").alias("fp")), budget).select("a", "b")
    of_node = groups.select("node", F.posexplode("fps").alias("seed", "fp"))
    leaves = materialize(of_node.groupBy("seed", "fp").agg(F.min("node").alias("leaf")), "simhash-leaves")
    near = near_links(leaves, budget, by_runs=True)
    for side, end in (("a", "x"), ("b", "y")):
        near = near.join(leaves.select("seed", F.col("fp").alias(side), F.col("leaf").alias(end)), ["seed", side])
    same = of_node.join(leaves, ["seed", "fp"]).where("node <> leaf").select("node", "leaf")
    return near.select("x", "y").union(same).toDF("a", "b").distinct()


def near_duplicates(docs: DataFrame, budget: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS, word_set_seeds: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, fps and component_id of each row of `docs` (doc_id, text)."""
    width = len(word_set_seeds) or 1
    node = F.col("fps")[0] if width == 1 else F.md5(F.concat_ws(",", F.col("fps").cast("array<string>")))
    rows = materialize(fingerprints(docs, shingle_words, word_set_seeds).withColumn("node", node), "simhash-fingerprints")
    groups = materialize(rows.groupBy("node", "fps").agg(F.min("doc_id").alias("first_doc")), "simhash-groups")
    if groups.isEmpty():
        return rows.select("doc_id", "fps", F.col("doc_id").alias("component_id"))
    roots = materialize(connected(group_links(groups, width, budget)), "simhash-roots")
    ids = materialize(roots.join(groups, "node").groupBy("root").agg(F.min("first_doc").alias("component_id")), "simhash-ids")
    linked = materialize(roots.join(ids, "root").select("node", "component_id"), "simhash-linked")
    of_node = materialize(groups.join(linked, "node", "left").select("node", F.coalesce("component_id", "first_doc").alias("component_id")), "simhash-components")
    return rows.join(of_node, "node").select("doc_id", "fps", "component_id")


def text_key(data: bytes) -> bytes:
    """Of the words of UTF-8 text in their order; texts of equal keys have equal shingles."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(data.lower().split()))


def shingle_set(data: bytes, n: int = JACCARD_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of UTF-8 text; a shorter text is one shingle."""
    from xxhash import xxh3_64_intdigest

    words = data.lower().split()
    return np.unique(np.fromiter((xxh3_64_intdigest(b" ".join(words[i : i + n])) for i in range(max(1, len(words) - n + 1))), np.uint64))


def odd_bits(shingles: np.ndarray) -> bytes:
    """SKETCH_BITS bits, each set if an odd number of `shingles` falls on it."""
    counts = np.bincount((shingles % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits(counts & 1 == 1).tobytes()


def keyed_fingerprints(docs: DataFrame, word_set_seeds: tuple[int, ...]) -> DataFrame:
    """doc_id, node (the text's key) and fps of each row of `docs` (doc_id, text) that has a doc_id."""

    def hashed(batches):
        import pyarrow as pa

        width = len(word_set_seeds)
        for b in pieces(batches, "text"):
            data = [(t or "").encode() for t in b.column("text").to_pylist()]
            flat = np.array([word_set_fingerprints(d, word_set_seeds) for d in data], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, width), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(text_key, data), pa.binary()), lists], ["doc_id", "node", "fps"])
        give_back_memory()
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node binary, fps array<long>")


def maybe_among(ids: DataFrame, docs: DataFrame) -> Column:
    """Whether a row of `docs` may have one of the doc_ids of `ids`, which has at least one: false only where it has none. The driver gets two bytes for each of `ids`, at least, and 128 MB at most."""
    hashes = ids.select(F.xxhash64(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).alias("h"))
    bits = min(max(1 << (BITS_EACH * ids.count()).bit_length(), LEAST_BITS), MOST_BITS)
    cells = docs.sparkSession.sparkContext.broadcast(bitmap(hashes, bits))

    @F.pandas_udf("boolean")
    def hit(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(cells.value, h.to_numpy().view(np.uint64)))

    return hit(F.xxhash64("doc_id"))


def shingles_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles and their sketch of `nodes` (node, first_doc), read from the row of `docs` that has that doc_id and text."""

    def hashed(batches):
        import pyarrow as pa

        for b in pieces(batches, "text"):
            keys, sets, sketches = [], [], []
            for key, text in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
                if text_key(data := (text or "").encode()) == key:  # a doc_id may have several texts
                    keys.append(key)
                    found = shingle_set(data)
                    sets.append(found.view(np.int64))
                    sketches.append(odd_bits(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["node", "shingles", "sketch"])
        give_back_memory()

    wanted = nodes.select("node", F.col("first_doc").alias("doc_id"))
    found = docs.select("doc_id", "text").where(maybe_among(wanted, docs)).join(wanted, "doc_id")
    return found.select("node", "text").mapInArrow(hashed, "node binary, shingles array<long>, sketch binary").dropDuplicates(["node"])


def shingle_counts(shingles: DataFrame) -> DataFrame:
    """node, n (its shingles) and n_common (those that another node of `shingles` has too)."""
    own = shingles.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").alias("own"))
    return shingles.select("node", F.size("shingles").cast("long").alias("n")).join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_common"))


def hub_links(stars: DataFrame, counts: DataFrame) -> DataFrame:
    """`stars` (a, b), and (a, b) links of each star's nodes to the one of them that has the least share of shingles of its own."""
    ends = stars.select("b", F.col("a").alias("node")).unionByName(stars.select("b", F.col("b").alias("node"))).distinct()
    hubs = ends.join(counts, "node").groupBy("b").agg(F.max(F.struct(F.col("n_common") / F.col("n"), "n", "node")).alias("hub")).select("b", F.col("hub.node").alias("hub"))
    return stars.select("a", "b").unionByName(ends.join(hubs, "b").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))


def similar(pairs: DataFrame, shingles: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """The distinct pairs (a, b) of `pairs` whose shingle sets have a Jaccard similarity of `least` or more."""
    of = lambda t, *names: t.toDF(*names)
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    most = F.least("ca", "cb")
    once = once.join(of(counts, "a", "na", "ca"), "a").join(of(counts, "b", "nb", "cb"), "b").where(most >= least * (F.col("na") + F.col("nb") - most) - 1e-9).select("a", "b")
    once = materialize(once, "simhash-pairs")
    both = once.join(of(shingles.select("node", "shingles"), "a", "sa"), "a").join(of(shingles.select("node", "shingles"), "b", "sb"), "b")
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return shared.where(F.col("shared") >= least * (F.col("n") - F.col("shared")) - 1e-9).select("a", "b")


def verified_duplicates(docs: DataFrame, word_set_seeds: tuple[int, ...], least_jaccard: float, budget: int = MAX_BITS) -> DataFrame:
    """doc_id and component_id of each row of `docs` (doc_id, text) that has a doc_id: components of the pairs that the fingerprints propose and whose Jaccard similarity is `least_jaccard` or more."""
    rows = materialize(keyed_fingerprints(docs, word_set_seeds), "simhash-fingerprints")
    groups = materialize(rows.groupBy("node", "fps").agg(F.min("doc_id").alias("first_doc")), "simhash-groups")
    alone = rows.join(groups.select("node", F.col("first_doc").alias("component_id")), "node").select("doc_id", "component_id")
    if groups.isEmpty():
        return alone
    width = len(word_set_seeds)
    # with one seed, too, a node is a text and no fingerprint
    stars = materialize(group_links(groups, width, budget, of_texts=True), "simhash-stars")
    proposed = materialize(groups.join(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "simhash-proposed")
    if proposed.isEmpty():
        return alone
    shingles = materialize(shingles_of(docs, proposed), "simhash-shingles")
    counts = materialize(shingle_counts(shingles), "simhash-counts")
    links = materialize(similar(hub_links(stars, counts), shingles, counts, least_jaccard), "simhash-similar")
    roots = materialize(connected(links), "simhash-roots")
    open_ = materialize(proposed.join(counts, "node").join(shingles.select("node", "sketch"), "node").join(roots, "node", "left").select("node", "fps", "n", "n_common", "sketch", F.coalesce("root", "node").alias("label")), "simhash-open")
    pairs = near_pairs(open_.select(F.posexplode("fps").alias("seed", "fp"), "node", "label", "n", "n_common", "sketch"), least_jaccard, budget)
    more = materialize(similar(pairs, shingles, counts, least_jaccard), "simhash-similar")
    if not more.isEmpty():
        roots = materialize(connected(links.unionByName(more)), "simhash-roots")
    ids = materialize(roots.join(groups, "node").groupBy("root").agg(F.min("first_doc").alias("component_id")), "simhash-ids")
    linked = materialize(roots.join(ids, "root").select("node", "component_id"), "simhash-linked")
    of_node = materialize(groups.join(linked, "node", "left").select("node", F.coalesce("component_id", "first_doc").alias("component_id")), "simhash-components")
    return rows.join(of_node, "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, budget: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS, word_set_seeds: tuple[int, ...] = (), least_jaccard: float | None = None) -> DataFrame:
    """The rows of `docs` that are first, by doc_id, of their component, with all columns; of repeated rows one stays, and rows without a doc_id all do."""
    if least_jaccard is None:
        linked = near_duplicates(docs, budget, shingle_words, word_set_seeds)
    else:
        linked = verified_duplicates(docs, word_set_seeds, least_jaccard, budget)
    found = materialize(linked.select("doc_id", "component_id"), "simhash-kept")
    later = found.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated, touched = (materialize(t, f"simhash-{name}") for name, t in (("repeated", repeated), ("touched", later.unionByName(repeated).distinct())))
    docs = docs.select(docs.columns)
    if touched.isEmpty():
        return docs
    some = maybe_among(touched, docs)
    kept = docs.where(some).join(later, "doc_id", "left_anti").select(docs.columns)
    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)
    return docs.where(~some).unionByName(kept)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", fingerprint_hex(F.col("fps")[0]).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
