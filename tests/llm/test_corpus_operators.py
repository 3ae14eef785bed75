import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.llm import chat_quotes as Q
from crossgrain.llm import decontaminate as D
from crossgrain.llm import substring_dedup as P
from tests.conftest import canonical, duck, same_as_oracle
from tests.llm.conftest import clashing, prose

# decontamination


def items(n=14, seed=0):
    r = random.Random(seed)
    return [(i, prose(r.randrange(1, 70), 100 + i)) for i in range(n)]


def holds_seed(same, n):
    for mask in D.masks_of(D.sure_weight(n)):
        at = D.places(mask)
        if any(all(same[a + k] for k in at) for a in range(n - len(mask) + 1)):
            return True
    return False


def stretch(same):
    """Words that agree in the stretch with the greatest sum of 1 and -4, the first such stretch."""
    score = best = agree = most = 0
    for x in same:
        score, agree = (score + 1, agree + 1) if x else (score - 4, agree)
        if score <= 0:
            score = agree = 0
        elif score > best:
            best, most = score, agree
    return most


def slow_overlaps(docs, bench, least=D.CONTAINMENT, long=D.LONG_OVERLAP):
    out = []
    for d, text in docs:
        w = D.tokens(text)
        for i, t in bench:
            item = D.tokens(t)
            n, best, at = len(item), [], {}
            if not n:  # no words, nothing to agree
                continue
            for shift in range(-n + 1, len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == x for k, x in enumerate(item)]
                if sum(same) >= least * n - 1e-9 or sum(same) >= long and stretch(same) >= long:
                    best.append((sum(same), -max(shift, 0)))
                if sum(same) and holds_seed(same, n):
                    at[shift] = same
            for a in at:
                for b in range(a - D.SHIFT, a + D.SHIFT + 1):
                    if b != a and b in at:
                        total = max(sum(at[a][:k]) + sum(at[b][k:]) for k in range(1, n + 1))
                        if total >= least * n - 1e-9:
                            best.append((total, -max(a, 0)))
            if best:
                out.append((d, i, -max(best)[1], n, max(best)[0]))
    return out


def substituted(text, share, seed):
    r, w = random.Random(seed), text.split()
    for k in r.sample(range(len(w)), int(share * len(w))):
        w[k] = "other"
    return " ".join(w)


@pytest.mark.parametrize("n", range(1, 19))
def test_no_pattern_of_substitutions_hides_an_item(n):
    """Every choice of as many places as the containment allows leaves a seed."""
    import itertools

    for places in itertools.combinations(range(n), n - int(np.ceil(D.CONTAINMENT * n - 1e-9))):
        assert holds_seed([k not in places for k in range(n)], n)


def test_overlaps_equal_brute_force(spark):
    bench = [*items(), (90, None), (91, "tiny item"), (92, ""), (93, "five words are an item"), (94, "word"), (95, "la " * 30), (96, "la lo li " * 9), (None, prose(30, 100))]
    docs = [(1, None), (2, ""), (3, prose(40, 7)), (4, "la " * 500), (5, "lo li la " * 60 + "la la " * 40)]
    for k, (_, t) in enumerate(items()):
        w = t.split()
        docs.append((10 + k, f"Before. {t.upper()}! after"))
        docs.append((40 + k, f"x y z {substituted(t, 0.2, k)} tail words"))
        docs.append((70 + k, substituted(t, 0.5, k)))
        docs.append((100 + k, " ".join([*w[: len(w) // 2], "put", "in", *w[len(w) // 2 :]])))
        docs.append((130 + k, " ".join([*w[: len(w) // 3], *w[len(w) // 3 + 1 :]])))
    docs += [(10, docs[5][1]), (None, docs[5][1]), (99, "and five, words are an ITEM?"), (98, "five other are an item")]
    df, b = clashing(spark.createDataFrame(docs, "doc_id long, text string")), clashing(spark.createDataFrame(bench, "item_id long, text string"))
    want = slow_overlaps(docs, bench)
    for most in (D.MAX_SEEDS, 300):  # one block, and several
        got = D.overlaps(df, b, max_seeds=most).select("doc_id", "item_id", "start_word", "item_words", "matched_words").collect()
        assert canonical(tuple(r) for r in got) == canonical(want)
        clean = D.decontaminate(df, b, max_seeds=most)
        dirty = {repr((r[0], dict(docs).get(r[0]))) for r in got}
        assert clean.columns == df.columns and canonical((r["doc_id"],) for r in clean.collect()) == canonical((d,) for d, t in docs if repr((d, dict(docs).get(d))) not in dirty)
    assert {(98, 93), (99, 93), (4, 95), (5, 96)} <= {(d, i) for d, i, *_ in want}


def test_partial_overlaps():
    item, filler = prose(200, 9), prose(30, 10)
    block = D.Block([(5, item), (6, prose(20, 11))])
    found = lambda text: {i for i, *_ in block.overlaps(text, D.CONTAINMENT, D.LONG_OVERLAP)}
    assert found(f"{filler} {' '.join(item.split()[50:63])} {filler}") == {0} and not found(f"{filler} {' '.join(item.split()[50:62])}")
    w = prose(20, 11).split()
    assert found(" ".join([filler, *w[:10], "new", *w[10:], filler])) == {1} and found(" ".join([*w[:8], *w[10:]])) == {1}


def test_words_that_repeat_everywhere_end():
    import time

    began = time.perf_counter()
    assert D.Block([(1, "la " * 200)]).overlaps("la " * 200_000, 0.8, 13) == [(0, 200, 200, 0)]
    assert len(D.Block([(1, "la lo " * 100 + "end")]).overlaps("la lo " * 100_000, 0.8, 13)) == 1
    assert time.perf_counter() - began < 60


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.overlaps(odd_docs, none).count() == 0 and D.decontaminate(odd_docs, none).count() == odd_docs.count()
    assert D.overlaps(no_docs, spark.createDataFrame(items(2), "item_id long, text string")).count() == 0


def test_overlaps_on_the_table(spark, sf_dir):
    """Whole texts and every item: each document divisible by 20, and all that the operator reports, against all alignments by words alone."""
    docs = [tuple(r) for r in D.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in D.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in D.op8_decontaminate(spark, sf_dir).collect()}
    some = [(d, t) for d, t in docs if d % 20 == 0 or d in {x for x, _ in got}]
    want, words = set(), [(i, D.tokens(t)) for i, t in bench]
    places = {}
    for i, item in words:
        for k, x in enumerate(item):
            places.setdefault(x, []).append((i, k))
    size = {i: len(item) for i, item in words}
    for d, t in some:
        agree = {}
        for at, x in enumerate(D.tokens(t)):
            for i, k in places.get(x, ()):
                agree.setdefault((i, at - k), set()).add(k)
        for (i, _), same in agree.items():
            if len(same) >= 0.8 * size[i] - 1e-9 or len(same) >= D.LONG_OVERLAP and stretch([k in same for k in range(size[i])]) >= D.LONG_OVERLAP:
                want.add((d, i))
    assert want <= got and len(got) < len(want) + 0.02 * len(docs)


# conversations

CHAT = [
    (1, 0, "user", "Hello  there\n\nHow are you?\n  code"), (1, 1, "assistant", "On Monday, X wrote:\n> how ARE you?\nFine"), (1, 2, "user", "> > How are you?\n> Fine\nGood"), (1, 3, None, ">> Fine\nno link\n\n\n\nend"),
    (1, 4, "user", None), (1, 5, "user", ""), (2, 0, "user", "> nothing\n"), (2, 0, "user", "again"), (None, 1, "x", "> Fine"), (3, None, "u", "> a"), (3, 1, "u", "a"), (3, 2, "u", "> a\nb"), (3, 3, "u", ">b\nc"), (3, 4, "u", "> c\nd"), (3, 5, "u", "x\n> d"),
    *[(4, k, "user", "same line" if k % 2 else f"> same line\nreply {k}") for k in range(40)], *[(5, k, "user", f"> m{k - 1}\nm{k}") for k in range(30)], (6, 0, "u", "long " * 50_000),
    (7, 0, "a", "one\ntwo\nthree\n\nfour five\nsix\n\nseven"), (7, 1, "b", "> two\n> Three\nabout two lines"), (7, 2, "c", "> four\n> five six\n>\n> seven\nnew wrap"), (7, 3, "d", "On Monday, c wrote:\n\n> On Sunday, a wrote:\n> > one\n> > two\n> new wrap\nnested"),
    (7, 4, "e", "> three\n>\n> unknown\n> six\nparts"), (7, 5, "f", "> nested\n>> new wrap\n> parts\nsplit by a deeper one"), (7, 6, "g", "On x wrote:\nno quote"), (7, 7, "h", "> On z wrote:\n>> about two lines\nchain"),
]


def test_quotes_equal_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", CHAT)
    df = clashing(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").repartition(3))
    got = Q.format_conversations(df)
    assert same_as_oracle(got, Q.ORACLE_SQL["op9_chat_quotes"], c)
    assert {r["thread_turn"] for r in got.where("conv_id = 5").collect()} == {0}
    assert {r["turn"]: r["reply_to"] for r in got.where("conv_id = 7").collect()} == {0: None, 1: 0, 2: 0, 3: 2, 4: 0, 5: 3, 6: None, 7: 1}


def test_positions_span_ranges(spark):
    """A conversation that is dealt over several ranges: every position once, replies after what they reply to."""
    rows = [(1, k, "u", f"> line {k // 3}\nline {k}" if k % 3 == 0 and k else f"line {k}") for k in range(400)] + [(2, 0, "u", "x")]
    got = Q.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).where("conv_id = 1").collect()
    at = {r["turn"]: r["position"] for r in got}
    assert sorted(at.values()) == list(range(1, 401)) and all(at[r["reply_to"]] < r["position"] for r in got if r["reply_to"] is not None)


def test_chat_oracle_and_empty(spark, sf_dir):
    assert same_as_oracle(Q.op9_chat_quotes(spark, sf_dir), Q.ORACLE_SQL["op9_chat_quotes"], duck(sf_dir))
    assert Q.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# substrings


def slow_dedup(rows, n=50):
    word, first = re.compile("[^\x20\x09-\x0D]+"), {}
    split = [(d, word.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - n + 1):
                key = tuple(w[i : i + n])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - n + 1):
                if first[tuple(w[i : i + n])] < d:
                    gone.update(range(i, i + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings_of_odd_documents(odd_docs, odd_rows, no_docs):
    got = P.dedup_substrings(odd_docs, bits=1 << 16)
    assert canonical(tuple(r) for r in got.collect()) == canonical(slow_dedup(odd_rows))
    assert P.dedup_substrings(no_docs, bits=1 << 16).count() == 0


@pytest.mark.parametrize(("bits", "chars", "chunk"), [(None, 4_000_000, 16_000_000), (64, 3000, 16_000_000), (1 << 16, 3000, 1500)])  # a full bitmap, many shards and many automata change nothing
def test_substrings_of_planted_passages(spark, bits, chars, chunk):
    r, rows = random.Random(8), []
    passages = [prose(k, 200 + k).split() for k in (49, 50, 51, 90, 180)]
    for d in range(60):
        w = prose(r.randrange(0, 150), 1000 + d).split()
        for p in r.sample(passages, r.randrange(0, 4)):
            a = r.randrange(0, max(1, len(p) - 60))
            at = r.randrange(0, len(w) + 1)
            w[at:at] = p[a : a + r.choice([45, 50, 55, 200])]
        rows.append((d, " ".join(w)))
    base = prose(130, 77).split()
    for d in range(100, 140):  # near copies: each with an edit or two
        w = list(base)
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = f"edit{r.randrange(3)}"
        rows.append((d, " \n".join(w)))
    rows += [(200, "la " * 130), (201, "la " * 70), (202, " ".join(["x", "y"] * 60)), (200, "la " * 90)]
    r.shuffle(rows)
    got = P.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bits=bits, shard_chars=chars, chunk_bytes=chunk)
    assert canonical(tuple(x) for x in got.collect()) == canonical(slow_dedup(rows))


def test_substring_oracle(spark, sf_dir):
    assert same_as_oracle(P.op10_substring_dedup(spark, sf_dir), P.ORACLE_SQL["op10_substring_dedup"], duck(sf_dir))


# pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as C
    from crossgrain.llm import quality_classifier, secret_scan

    docs = C.table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs
    scores = {r["doc_id"] for r in quality_classifier.op2_quality_classifier(spark, sf_dir).where("predicted = 1").collect()}
    kept = {}
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir), name)
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
    assert kept["quality_classifier"] == scores
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    first = {}
    for d in sorted(scores):
        first.setdefault(texts[d], d)
    assert kept["simhash_near_dedup"] <= set(first.values()) and len(kept["simhash_near_dedup"]) > 0.9 * len(first)
    leaks = {r["doc_id"] for r in D.op8_decontaminate(spark, sf_dir).collect()}
    assert kept["benchmark_decontamination"] == kept["simhash_near_dedup"] - leaks == kept["secret_scan"] == kept["byte_bpe"]
    masked = C.secrets(spark, before, sf_dir)
    assert masked.where(F.col("text").contains("[SECRET]")).count() > 0 and not any(list(secret_scan.base_spans(r["text"])) for r in masked.where(F.col("text").contains("[SECRET]")).limit(20).collect())
    assert docs.where("n_tokens <> size(token_ids)").count() == 0


def test_pipeline_run(spark, sf_dir):
    import corpus_pipeline as C

    assert C.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "token_ids"]


def test_pipeline_on_odd_documents(spark, sf_dir, tmp_path, odd_rows):
    """Accepted documents of the table beside nulls, repeated rows, very long and empty texts and columns of clashing names; and an empty table."""
    import corpus_pipeline as C

    docs = C.table(spark, sf_dir, "documents")
    good = C.quality(spark, docs, sf_dir)
    few = good.where("doc_id > 0").orderBy("doc_id").limit(30)
    item = C.table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    first = few.orderBy("doc_id").first()
    more = [(first["doc_id"], first["text"]), (None, first["text"]), (None, first["text"]), (10**9, f"{first['text']} token=abcdefgh1234"), (10**9 + 1, first["text"]), (10**9 + 2, f"{first['text']} {item}"), (10**9 + 3, first["text"] * 400)]
    odd = [(None if d is None else 2 * 10**9 + d, t) for d, t in odd_rows]
    extra = spark.createDataFrame(more + odd, "doc_id long, text string")
    mixed = clashing(few.unionByName(extra, allowMissingColumns=True)).repartition(3)
    columns, kept = mixed.columns, {}
    for name, stage in C.STAGES:
        before = mixed
        mixed = C.materialize(stage(spark, mixed, sf_dir), name)
        kept[name] = sorted(r["doc_id"] or 0 for r in mixed.select("doc_id").collect())
        if name != C.STAGES[-1][0]:
            assert mixed.columns == columns
        empty = stage(spark, before.where("false"), sf_dir)
        assert empty.count() == 0 and empty.columns == mixed.columns
    q, near, clean = (kept[n] for n in ("quality_classifier", "simhash_near_dedup", "benchmark_decontamination"))
    # 0 stands for rows without a doc_id
    assert q.count(0) >= 2 and q.count(first["doc_id"]) == 2 and 10**9 + 1 in q
    assert near.count(0) == q.count(0) and near.count(first["doc_id"]) == 1 and 10**9 + 1 not in near and len(set(near)) > 20
    assert 10**9 + 2 not in clean and kept["secret_scan"] == clean == kept["byte_bpe"]
