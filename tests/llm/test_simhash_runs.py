"""Tries that are turned by runs of bits, and texts that are joined only where a bitmap has their ids."""

import numpy as np
import pytest

from crossgrain.llm import simhash as S
from tests.llm.conftest import clashing, prose

BUDGET = 3


def leaves_of_all_kinds():
    """Fingerprints of which many share a prefix of 30 bits, and near ones of both: in every run, in one, and in the last bits."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**64, 700, dtype=np.uint64)
    hot = (x[:300] >> np.uint64(30)) | (np.uint64(0xABCDEF12) << np.uint64(34))
    off = np.zeros(400, np.uint64)
    for _ in range(BUDGET):
        off ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    return np.unique(np.concatenate((x, hot, x[:400] ^ off, hot[:200] ^ off[:200], hot[:200] ^ np.uint64(7), x[:100] ^ np.uint64(0x0001000100010000))))


def near(x, budget=BUDGET):
    d = np.bitwise_count(x[:, None] ^ x[None, :])
    return {frozenset((int(x[i]), int(x[j]))) for i, j in zip(*np.nonzero(d <= budget), strict=True) if i < j}


def test_turned_leaves_lose_no_pair(spark, monkeypatch):
    x = leaves_of_all_kinds()
    monkeypatch.setattr(S, "MOST_LEAVES", 64)
    leaves = spark.createDataFrame([(seed, int(v)) for seed in (0, 1) for v in x.view(np.int64)], "seed int, fp long")
    runs, run = S.runs_of(BUDGET)
    assert (runs, run) == (4, 16)
    met = []
    groups = {}
    for r in S._dealt(S.turned(leaves, BUDGET), BUDGET, run).collect():
        groups.setdefault((r["seed"], r["task"]), ([], []))[r["side"]].append(r["fp"] & (1 << 64) - 1)
    for (seed, _), (left, right) in groups.items():
        turn = seed % runs
        a, b = (np.sort(np.array(s, np.uint64)) for s in (left, right))
        back = lambda v, by=turn * run: (int(v) >> by | int(v) << (64 - by)) & (1 << 64) - 1
        other = b if len(b) else a
        for i, j in S.trie_pairs(a, b if len(b) else None, BUDGET, run=run, before=turn):
            met += [(seed // runs, frozenset((back(p), back(q)))) for p, q in zip(a[i], other[j], strict=True)]
    want = near(x)
    assert len(want) > 800 and len(met) == 2 * len(want) and set(met) == {(s, p) for s in (0, 1) for p in want}
    for seed in (0, 1):
        label = {int(v): int(v) for v in x}
        root = lambda v: v if label[v] == v else root(label[v])  # noqa: E731, B023
        for r in S.near_links(leaves, BUDGET, by_runs=True).where(f"seed = {seed}").collect():
            p, q = r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1
            assert p > q
            label[root(p)] = root(q)
        got = {v: root(v) for v in label}
        plain = np.arange(len(x))
        place = {int(v): k for k, v in enumerate(x)}
        i, j = (np.array([place[v] for v in side]) for side in zip(*(sorted(p) for p in want), strict=True))
        S._join_labels(plain, i, j)
        assert len(set(got.values())) == len(set(plain.tolist())) and all(got[min(p)] == got[max(p)] for p in want)


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_copies_of_a_leaf_do_not_grow(spark, monkeypatch, n):
    """Of one trie, a leaf goes to every node within the budget, more of them the more leaves there are."""
    monkeypatch.setattr(S, "MOST_LEAVES", 64)
    x = np.unique(np.random.default_rng(7).integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1)).view(np.int64)
    leaves = spark.createDataFrame([(0, int(v)) for v in x], "seed int, fp long")
    assert S._dealt(S.turned(leaves, BUDGET), BUDGET, S.runs_of(BUDGET)[1]).count() == 4 * len(x) < S._dealt(leaves, BUDGET).count()


def test_open_pairs_of_all_turns_are_each_once():
    x = leaves_of_all_kinds()[:600]
    fps = np.concatenate((x, x[:50]))
    labels = np.arange(len(fps)) % 7
    runs, run = S.runs_of(BUDGET)
    got = []
    for turn in range(runs):
        by = np.uint64(turn * run)
        t = fps if not turn else (fps << by) | (fps >> (np.uint64(64) - by))
        got += [frozenset(p) for p in zip(*(k.tolist() for k in S.open_pairs(t, np.zeros(len(fps), int), labels, BUDGET, None, run, turn)), strict=True)]
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= BUDGET
    want = {frozenset((i, j)) for i, j in zip(*np.nonzero(d & (labels[:, None] != labels[None, :])), strict=True)}
    assert len(got) == len(set(got)) == len(want) and set(got) == want


@pytest.mark.parametrize(("kind", "bits"), [("long", None), ("string", None), ("int", 64)])
def test_bitmap_loses_no_row(spark, monkeypatch, kind, bits):
    """Rows that no bitmap has, that a full one has by chance, repeated ids and null ones."""
    if bits:
        monkeypatch.setattr(S, "LEAST_BITS", bits)
        monkeypatch.setattr(S, "MOST_BITS", bits)
    copy = prose(150, 9)
    words = copy.split()
    edited = " ".join([*words[:70], "edited", *words[71:]])
    rows = [(1, copy), (2, copy), (3, edited), (4, "x"), (4, "x"), (5, copy.upper()), (None, copy), (None, None), *((k, prose(60, k)) for k in range(10, 40))]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text"))
    got = S.keep_first(docs, BUDGET, word_set_seeds=(1, 2, 3, 4, 5, 6, 7, 8), least_jaccard=0.8)
    assert got.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else int(r["doc_id"]) for r in got.collect()) == [-1, -1, 1, 4, *range(10, 40)]
    wanted = docs.where("doc_id IN (2, 17)").select("doc_id")
    assert {str(r["doc_id"]) for r in docs.where(S.maybe_among(wanted, docs)).collect()} >= {"2", "17"}
