"""Benchmark decontamination with spaced-seed hashing.

Fixed masks lay over consecutive words; one place of a mask is ignored, so that a seed survives a substituted
word there. Every place of a benchmark item gives one hash a mask, every place of a document likewise, and
equal hashes are joined. Each hit names an item and an alignment, which is verified word by word. A document
overlaps an item if, at some alignment,

* the words that agree are at least `containment` of the item's,
* or a stretch in which at least four of five words agree holds `long_overlap` that do,
* or they are `containment` of the item's when the item is cut once and its rest read at another alignment
  that a hit names, at most `SHIFT` words on: a few words were put in or left out there.

The masks of an item are made for its length: of `weight` words with no place ignored, or with one, in every
way. The weight is the greatest, `MAX_WEIGHT` at most, at which every pattern of substitutions that leaves
`containment` of the item's words leaves a seed (`sure_weight`), so nothing that the first two rules say is
lost, items of a single word included.

The join runs inside one map over the documents: the benchmark's seeds are sorted arrays that go to every
task, `MAX_SEEDS` at most. A benchmark with more is cut into blocks of items, and each block is a pass of
its own over all documents. Nothing is shuffled; a task holds one document at a time besides its block.

A hit goes on only where it starts: if the seeds one word before agree, too, they name the same alignment. So
words that repeat all over an item and a document give about as many hits as there are alignments, not as many
as there are pairs of places; hits and alignments are worked off in blocks of bounded size.

Defined results: null and empty texts overlap with nothing; every row of the documents stands for itself,
repeated rows and null ids included; equal items are reported under each of their ids; only the best overlap of
a row with an item is reported, ties by the first place; other columns are ignored (`overlaps`) or pass
through (`decontaminate`); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from crossgrain.llm.text import pieces
from crossgrain.sources.tables import table

MAX_WEIGHT = 6
CONTAINMENT = 0.8
LONG_OVERLAP = 13
#: Words by which the two alignments of an item that is cut may differ.
SHIFT = 3
#: Seeds of a block of the benchmark; at 36 bytes each, with the items' words, about 80 MB.
MAX_SEEDS = 2_000_000
#: Pairs of places, and cells of a comparison, that are arrays at a time.
BLOCK = 1 << 21
_PUNCTUATION = bytes.maketrans(bytes(b for b in range(128) if not (chr(b).isalnum())), b" " * sum(not chr(b).isalnum() for b in range(128)))
_FACTORS = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words; every ASCII character but letters and digits is a gap."""
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def masks_of(weight: int) -> list[str]:
    """1: the word counts; 0: it is ignored."""
    return ["1" * weight, *("1" * k + "0" + "1" * (weight - k) for k in range(1, weight))]


def fewest_edits(n: int, weight: int) -> int:
    """The fewest substituted words of `n` that leave no mask of `weight` a place: two in every `weight` + 1 words."""
    span = weight + 1
    return 2 * (n // span) + (n % span == weight)


def sure_weight(n: int, containment: float = CONTAINMENT, most: int = MAX_WEIGHT) -> int:
    """The greatest weight whose masks find an item of `n` words however its substitutions lie."""
    edits = n - int(np.ceil(containment * n - 1e-9))
    return next((w for w in range(min(most, n), 0, -1) if fewest_edits(n, w) > edits), 1)


def places(mask: str) -> list[int]:
    return [k for k, c in enumerate(mask) if c == "1"]


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place of `ids` where `mask` fits; 0 where it meets an unknown word (-1)."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = places(mask)
    h = np.full(n, int(mask, 2), np.uint64) * _FACTORS[63]
    ok = np.ones(n, bool)
    for j, k in enumerate(at):
        part = ids[k : k + n]
        ok &= part >= 0
        h += (part.astype(np.uint64) + np.uint64(1)) * _FACTORS[j]
        h ^= h >> np.uint64(29)
    return np.where(ok, h | np.uint64(1), np.uint64(0))


def _before(h: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), h[:-1])) if len(h) else h


class Seeds:
    """The seeds of items under one mask, sorted by hash and, within it, by the hash one word before."""

    def __init__(self, mask: str, items: list[tuple[int, np.ndarray]]):
        self.mask = mask
        each = [(i, seed_hashes(ids, mask)) for i, ids in items]
        h, before = (np.concatenate([f(x) for _, x in each]) for f in (lambda x: x, _before))
        item, at = np.repeat([i for i, _ in each], [len(x) for _, x in each]), np.concatenate([np.arange(len(x)) for _, x in each])
        order = np.lexsort((before, h))
        self.hashes, self.before, self.item, self.at = h[order], before[order], item[order].astype(np.int32), at[order].astype(np.int32)

    def first_from(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first place within [low, high) whose `before` is at least `value`, for each."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (self.before[np.minimum(middle, len(self.before) - 1)] < value)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    def alignments(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, shift) of the hits of `ids` that start a run of hits, in blocks."""
        h = seed_hashes(ids, self.mask)
        if not len(h) or not len(self.hashes):
            return
        low = np.searchsorted(self.hashes, h)
        at = np.flatnonzero((self.hashes[np.minimum(low, len(self.hashes) - 1)] == h) & (h != 0))
        if not len(at):
            return
        low, high, before = low[at], np.searchsorted(self.hashes, h[at], side="right"), _before(h)[at]
        skip = self.first_from(low, high, before)
        go_on = np.where(before == 0, skip, self.first_from(skip, high, before + np.uint64(1)))
        low, n, at = np.concatenate((low, go_on)), np.concatenate((skip - low, high - go_on)), np.concatenate((at, at))
        ends = np.cumsum(n)
        for start in range(0, int(ends[-1]), BLOCK):
            flat = np.arange(start, min(start + BLOCK, int(ends[-1])))
            k = np.searchsorted(ends, flat, side="right")
            seed = low[k] + flat - (ends[k] - n[k])
            yield self.item[seed], at[k] - self.at[seed]


class Block:
    """Items of a benchmark, (item_id, text), as sorted seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]], containment: float = CONTAINMENT):
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids, self.items, of_weight = [], [], {}
        for item_id, text in items:
            if words := tokens(text):
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
                of_weight.setdefault(sure_weight(len(ids), containment), []).append((len(self.items), ids))
                self.item_ids.append(item_id)
                self.items.append(ids)
        self.seeds = [Seeds(mask, of_weight[w]) for w in sorted(of_weight) for mask in masks_of(w)]

    def overlaps(self, text: str | None, containment: float, long_overlap: int) -> list[tuple[int, int, int, int]]:
        """(item, words that agree, words of the item, start in the document) of each item that `text` overlaps."""
        words = tokens(text)
        if not words:
            return []
        known = self.vocabulary
        ids = np.array([known.get(w, -1) for w in words], np.int64)
        found: dict[int, list[np.ndarray]] = {}
        for seeds in self.seeds:
            for item, shift in seeds.alignments(ids):
                for i in np.unique(item).tolist():
                    found.setdefault(i, []).append(np.unique(shift[item == i]))
        out = []
        for i in sorted(found):
            if best := best_overlap(ids, self.items[i], np.unique(np.concatenate(found[i])), containment, long_overlap):
                out.append((i, best[0], len(self.items[i]), -best[1]))
        return out


def best_overlap(ids: np.ndarray, item: np.ndarray, shifts: np.ndarray, containment: float, long_overlap: int) -> tuple[int, int] | None:
    """(words that agree, -start) of the best of the alignments `shifts` (sorted) that is an overlap."""
    n, need = len(item), containment * len(item) - 1e-9
    best = None
    step = max(1, BLOCK // n)
    for k in range(0, len(shifts), step):  # a block takes the next alignments along, for what is cut between them
        part = shifts[k : k + step + SHIFT]
        at = part[:, None] + np.arange(n)
        same = np.where((at >= 0) & (at < len(ids)), ids[np.clip(at, 0, len(ids) - 1)], -2) == item
        agree = same.sum(axis=1)
        good = agree >= need
        if long_overlap <= n:
            rest = np.flatnonzero(~good & (agree >= long_overlap))
            if len(rest):
                good[rest] = longest(same[rest]) >= long_overlap
        for total, start in ((agree[good], part[good]), _cut(same, part, need)):
            if len(total):
                score = max(zip(total.tolist(), (-np.maximum(start, 0)).tolist(), strict=True))
                best = max(best or score, score)
        if best and best[0] == n:  # shifts rise, so no later one is better
            break
    return best


def _cut(same: np.ndarray, shifts: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray]:
    """(words, shift of the first part) where an item's first part at one shift and its rest at a near one reach `need`."""
    totals, starts = [], []
    head = np.cumsum(same, axis=1)
    tail = head[:, -1:] - head
    for step in range(1, SHIFT + 1):
        a = np.flatnonzero(shifts[step:] - shifts[:-step] <= SHIFT) if len(shifts) > step else np.zeros(0, int)
        for first, second in ((a, a + step), (a + step, a)):
            total = (head[first] + tail[second]).max(axis=1, initial=0)
            ok = total >= need
            totals.append(total[ok])
            starts.append(shifts[first[ok]])
    return np.concatenate(totals), np.concatenate(starts)


def longest(same: np.ndarray) -> np.ndarray:
    """For each row, the words that agree in the stretch with the greatest sum of 1 for each of those and -4 for each other."""
    score, best, agree, most = (np.zeros(len(same), np.int64) for _ in range(4))
    for x in same.T:
        score, agree = score + np.where(x, 1, -4), agree + x
        done = score <= 0
        score[done] = agree[done] = 0
        more = score > best
        best[more], most[more] = score[more], agree[more]
    return most


def benchmark_blocks(benchmark: DataFrame, max_seeds: int = MAX_SEEDS) -> Iterator[list[tuple[int | None, str | None]]]:
    """The rows of `benchmark` (item_id, text) in blocks of at most `max_seeds` seeds, an item at least; the driver has one block at a time."""
    held, n = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=False):
        seeds = MAX_WEIGHT * (len(r["text"] or "") // 2 + 1)  # a word and its gap take two characters at least
        if held and n + seeds > max_seeds:
            yield held
            held, n = [], 0
        held.append((r["item_id"], r["text"]))
        n += seeds
    if held:
        yield held


def _passes(df: DataFrame, benchmark: DataFrame, containment: float, max_seeds: int):
    for items in benchmark_blocks(benchmark, max_seeds):
        yield df.sparkSession.sparkContext.broadcast(Block(items, containment))


OVERLAPS = "item_id long, start_word long, item_words long, matched_words long, containment double"


def overlaps(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, long_overlap: int = LONG_OVERLAP, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """A row for each row of `docs` (doc_id, text) and item of `benchmark` (item_id, text) that it overlaps."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {OVERLAPS}"

    def found_with(block):
        def found(batches):
            import pyarrow as pa

            b = block.value
            for part in pieces(batches, "text"):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    rows += [(doc_id, b.item_ids[i], start, n, same, same / n) for i, same, n, start in b.overlaps(text, containment, long_overlap)]
                if rows:
                    columns = zip(*rows, strict=True)
                    kinds = (part.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start_word", "item_words", "matched_words", "containment"])

        return found

    out = None
    for block in _passes(docs, benchmark, containment, max_seeds):
        one = docs.select("doc_id", "text").mapInArrow(found_with(block), schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, long_overlap: int = LONG_OVERLAP, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """The rows of `docs` (with text) that overlap no item, with all their columns."""

    def clean_of(block):
        def clean(batches):
            import pyarrow as pa

            b = block.value
            for part in pieces(batches, "text"):
                keep = [not b.overlaps(t, containment, long_overlap) for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

        return clean

    for block in _passes(docs, benchmark, containment, max_seeds):
        docs = docs.mapInArrow(clean_of(block), docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
