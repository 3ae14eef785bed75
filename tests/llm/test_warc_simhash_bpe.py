import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.llm import byte_bpe as B
from crossgrain.llm import simhash as S
from crossgrain.llm import warc as A
from tests.conftest import canonical, duck, same_as_oracle
from tests.llm.conftest import clashing, prose


def pages(spark, rows):
    return clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))


BIG = "<p>é</p>" * 200
PAGE_ROWS = [(1, "http://a/x y", BIG), (2, None, BIG), (2, None, BIG), (3, "u\r\nInjected: 1", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", BIG), (7, "u", "x" * 1_000_000), (8, "u", "x" * 1_000_000), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (10, "u", "y" * 999), (11, "u", "y" * 999)]


def want_pages(rows, least=1000):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        again = len(data) >= least and page is not None and page < max(same)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return out


@pytest.mark.parametrize("chunk", [64, 700, 1 << 18])
def test_archives_round_trip(spark, tmp_path, chunk):
    A.write_archives(pages(spark, PAGE_ROWS).repartition(2), f"{tmp_path}/a", chunk)
    assert canonical(tuple(r) for r in A.read_archives(spark, f"{tmp_path}/a").collect()) == canonical(want_pages(PAGE_ROWS))


def test_archive_files_are_warc(spark, tmp_path):
    import gzip

    A.write_archives(pages(spark, PAGE_ROWS).coalesce(1), f"{tmp_path}/a", 700)
    done = A.export_files(spark.read.schema(A.CHUNKS).parquet(f"{tmp_path}/a"), f"file://{tmp_path}").collect()
    assert sum(r["records"] for r in done) == len(PAGE_ROWS)
    data, n = b"".join(gzip.decompress((tmp_path / r["file"]).read_bytes()) for r in done), 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and b"\nInjected" not in head
        size = int(re.search(rb"Content-Length: (\d+)$", head, re.M)[1])
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, n = rest[size + 4 :], n + 1
    assert n == len(PAGE_ROWS)


def test_damage_is_noticed(spark, tmp_path):
    A.write_archives(pages(spark, PAGE_ROWS[:1]), f"{tmp_path}/a")
    broken = spark.read.schema(A.CHUNKS).parquet(f"{tmp_path}/a").withColumn("data", F.expr("CAST(replace(CAST(data AS STRING), '<p>', '<b>') AS BINARY)"))
    with pytest.raises(Exception, match="damaged"):
        A.read_chunks(broken).collect()


def test_no_pages_and_oracle(spark, sf_dir, tmp_path):
    A.write_archives(pages(spark, []), f"{tmp_path}/a")
    assert A.read_archives(spark, f"{tmp_path}/a").count() == 0
    assert same_as_oracle(A.op4_warc(spark, sf_dir), A.ORACLE_SQL["op4_warc"], duck(sf_dir))


WORD = re.compile("[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, ids, budget=4):
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= budget
    label = np.arange(len(x))
    while (new := np.array([label[row].min() for row in near])).tolist() != label.tolist():
        label = new
    return [min((i for i, k in zip(ids, label, strict=True) if k == mine and i is not None), default=None) for mine in label]


def test_fingerprints_and_components(spark, odd_docs, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 100_000]
    got = S.near_duplicates(odd_docs.where("doc_id IS NULL OR doc_id <> 9")).select("doc_id", S.fingerprint_hex(F.col("fps")[0]), "component_id").collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    want = [(d, f"{fp:016x}", c) for (d, _), fp, c in zip(rows, fps, slow_components(fps, [d for d, _ in rows]), strict=True)]
    assert canonical(tuple(r) for r in got) == canonical(want)


def test_no_documents_to_link(no_docs):
    assert S.near_duplicates(no_docs).count() == 0 and S.keep_first(no_docs).columns == no_docs.columns


def test_trie_pairs_equal_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    near = base[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    cluster = np.arange(64, dtype=np.uint64) + base[0]
    x = np.unique(np.concatenate((base, near, cluster)))
    for left, right in ((x, None), (x[::2], x[1::2]), (x[:1], None), (x[:0], x)):
        got = {(i, j) for a, b in S.trie_pairs(left, right, 4, block=500) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        other = left if right is None else right
        d = np.bitwise_count(left[:, None] ^ other[None, :])
        assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 4), strict=True) if right is not None or i < j}


def test_frontier_tasks_lose_no_pair(spark, monkeypatch):
    """Leaves of which half share a prefix of 30 bits: nodes are bounded, and every near pair meets in one task."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, 600, dtype=np.uint64)
    hot = (x[:500] >> np.uint64(30)) | (np.uint64(0xABCDEF12) << np.uint64(34))
    x = np.unique(np.concatenate((x, hot, hot[:100] ^ np.uint64(5), x[:100] ^ np.uint64(1 << 60))))
    monkeypatch.setattr(S, "MOST_LEAVES", 64)
    leaves = spark.createDataFrame([(0, int(v)) for v in x.view(np.int64)], "seed int, fp long")
    rows = S._dealt(leaves, 4).collect()
    nodes = S.frontier(leaves)
    held = np.bincount([next(k for k, (p, d) in enumerate(nodes) if int(v) >> (64 - d) == p) for v in x])
    assert max(held) <= 64 and max(d for _, d in nodes) > 30
    sides = {}
    for r in rows:
        sides.setdefault(r["task"], ([], []))[r["side"]].append(r["fp"] & (1 << 64) - 1)
    met = {}
    for left, right in sides.values():
        assert len(left) <= 64 and len(right) <= 64
        for i, a in enumerate(left):
            for b in right or left[i + 1 :]:
                met[frozenset((a, b))] = met.get(frozenset((a, b)), 0) + 1
    near = [frozenset((int(a), int(b))) for i, a in enumerate(x) for b in x[i + 1 :][np.bitwise_count(x[i + 1 :] ^ a) <= 4]]
    assert len(near) > 150 and all(met.get(p) == 1 for p in near)
    links = S.near_links(leaves).collect()
    label = {int(v): int(v) for v in x}
    root = lambda v: v if label[v] == v else root(label[v])
    for r in links:
        label[root(r["a"] & (1 << 64) - 1)] = root(r["b"] & (1 << 64) - 1)
    assert all(len({root(v) for v in p}) == 1 for p in near)


def test_chain_of_links_is_one_component(spark):
    from crossgrain.llm.components import connected

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_keep_first_takes_one_of_each_group(spark):
    copy, other = prose(200, 5), prose(200, 6)
    edited = copy.replace(copy.split()[100], "edited")
    docs = clashing(spark.createDataFrame([(1, copy), (2, copy), (3, edited), (4, other), (4, other), (None, None)], "doc_id long, text string"))
    got = S.keep_first(docs, word_set_seeds=(42, 43, 44))
    assert got.columns == docs.columns and sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 4]


def test_near_copies_are_compared_before_one_goes(spark):
    words = prose(200, 7).split()
    shuffled = " ".join(sorted(words))
    half = " ".join(words[:100] + prose(20, 8).split() + words[100:])  # Jaccard 192 / 220
    far = " ".join(w for i, w in enumerate(words) if i % 20)  # nearly the same words, few of the shingles
    rows = [(1, " ".join(words)), (2, shuffled), (3, half), (4, far), (5, " ".join(words * 3)), (6, " ".join(words).upper()), (None, shuffled), (7, None), (8, " ")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(r["doc_id"] or 0 for r in S.keep_first(docs, budget=20, word_set_seeds=(42, 43, 44), least_jaccard=0.8).collect())
    sets = {d: {tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for d, t in rows if d}
    want = [d for d in sets if not any(e < d and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]) for e in sets)]
    assert got == sorted([0, *want]) and 2 in got and 4 in got and 3 not in got


@pytest.mark.parametrize("two", [False, True])
def test_open_pairs_equal_all_pairs(two):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 120, dtype=np.uint64)
    fps = np.concatenate((base, base[:60], base[:60] ^ np.uint64(5)))
    side, labels = rng.integers(0, 2, len(fps)) * two, rng.integers(0, 40, len(fps))
    x, y = S.open_pairs(fps, side, labels, 4)
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (labels[:, None] != labels[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if (side[i] < side[j] if two else i < j)}
    got = list(zip(x.tolist(), y.tolist(), strict=True))
    assert len(got) == len(want) and {p if two else (min(p), max(p)) for p in got} == want


@pytest.fixture(scope="module")
def tiktoken_library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.tokenizer().ranks, special_tokens={})


def test_ids_equal_the_library_and_round_trip(odd_docs, odd_rows, tiktoken_library):
    got = B.round_trip(odd_docs.select("doc_id", "text")).collect()
    want = [(d, np.array(tiktoken_library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in odd_rows]
    assert sorted((str(r["doc_id"]), bytes(r["token_ids"]), bytes(r["decoded"])) for r in got) == sorted((str(d), a, b) for d, a, b in want)


@pytest.mark.parametrize("word", ["a" * 3000, "abracadabra" * 300, "=" * 1500, "x" + " " * 900 + "y", "<|endoftext|>", "漢字éö" * 300, ""])
def test_long_words(word, tiktoken_library):
    ids = B.tokenizer().encode([word])[0]
    assert np.frombuffer(ids, "<u4").tolist() == tiktoken_library.encode_ordinary(word) and B.tokenizer().decode([ids]) == [word.encode()]


def test_long_words_of_few_letters(tiktoken_library):
    """Words of over WHOLE_WORD bytes, whose rounds contract many pairs: runs of one pair, and pairs whose token falls in rank."""
    import random

    r, t = random.Random(2), B.tokenizer()
    kinds = ["ab", "aA", "abc", "etaoinshr", "lo", "=-", "xyzé", "  \t", "aaab", "漢字", "abcdefghijklmnopqrstuvwxyz"]
    words = ["".join(r.choice(r.choice(kinds) if k % 3 else kinds[k % len(kinds)]) for _ in range(r.randrange(70, 400))) for k in range(300)]
    words = [w for w in words if len(w.encode()) > B.WHOLE_WORD]
    for word, ids in zip(words, t.merged_long([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_library._encode_single_piece(word.encode())


def test_long_documents(tiktoken_library):
    import random

    r, t = random.Random(3), B.tokenizer()
    words = [prose(1, k, 50_000) + "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for k in range(5000)]
    for text in (" ".join(r.choices(words, k=700_000)), " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500)) for _ in range(300))):
        ids = t.encode([text])[0]
        assert np.array_equal(np.frombuffer(ids, "<u4"), np.array(tiktoken_library.encode_ordinary(text))) and t.decode([ids, b"", ids[:4]])[0] == text.encode()


def test_a_full_cache_changes_nothing(tiktoken_library):
    t = B.tokenizer()
    before, t.cache_words = t.cache_words, 50
    try:
        for k in range(6):
            text = prose(100, k, 90)
            assert np.frombuffer(t.encode([text])[0], "<u4").tolist() == tiktoken_library.encode_ordinary(text)
    finally:
        t.cache_words = before


def test_columns_pass_and_empty_tables(odd_docs, no_docs):
    got = B.ids_as_arrays(B.decode(B.encode(odd_docs)))
    assert set(odd_docs.columns) <= set(got.columns) and dict(got.dtypes)["token_ids"] == "array<int>" and got.count() == odd_docs.count()
    assert B.round_trip(no_docs).count() == 0


def test_query_digests(spark, sf_dir, tiktoken_library):
    docs = {r["doc_id"]: r["text"] for r in B.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = B.op6_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(tiktoken_library.encode_ordinary(docs[r["doc_id"]] or ""), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest())
