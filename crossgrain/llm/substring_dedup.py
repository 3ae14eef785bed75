"""Substring dedup with repeated-phrase automata.

A window is `window` consecutive words of one document. Words of a document go that a window covers whose
words also stand in a document of a smaller doc_id. Windows are found by what they hold, not by where they
stand: of the hashes of a window's 16-word phrases, the smallest is its anchor, so equal windows have equal
anchors wherever they are, and neighbouring windows mostly share theirs.

1. Anchors of every document are grouped; those that more than one document has go into a bitmap sized by
   their number, 128 MB at most. A false hit there costs work, never a wrong result.
2. Documents with such an anchor go on with their texts, to a table in the shared folder; the others are
   done. Where they have such an anchor, the hashes of their windows are grouped, which confirms what
   recurs and names its owner, the smallest doc_id that has it.
3. Passages are cut from the owners' texts: runs of windows that they own and that recur.
4. Documents are dealt into shards of bounded text, by their smallest anchor, which copies mostly share;
   those of an anchor with more text than a shard are dealt into several. A shard gets the passages that
   hold a confirmed anchor of one of its documents, each once, and compiles an Aho-Corasick automaton of
   their anchor phrases (pyahocorasick, over word numbers). All its documents stream through it. Passages of
   more than `chunk_bytes` are dealt into several automata, each for all documents of the shard, whose removals
   are joined by row. Windows
   around a hit are looked up among the windows of the passages, the smallest owner first, and compared
   with that word by word, so what is removed does recur; hashes only decide where to look.

Groupings carry partial results from every task, so a passage that a third of all documents share is a
few rows; joins read plain tables, so that Spark splits a frequent anchor. The bitmap's size is a parameter;
if it fills up, more documents take the longer way with the same result.

Defined results: null and empty texts have no words and keep the hash of the empty string; a null doc_id
is neither smaller nor greater than another, so such rows stay whole and remove nothing; rows of one doc_id
are one document in two rows, neither removes from the other; every row gives one row; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm.text import pieces
from crossgrain.sources.scratch import materialize
from crossgrain.sources.tables import table

WINDOW = 50
#: Words of a phrase that may be an anchor.
PHRASE = 16
#: Bits of the bitmap for each anchor that it has, and its least and most bits; beyond those, more documents take the longer way.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Characters of text in a shard.
SHARD_CHARS = 4_000_000
#: Bytes of passages in an automaton.
CHUNK_BYTES = 16_000_000
#: Rows of a table with no more rows than shards that are broadcast.
MOST_BROADCAST = 100_000
_ODD = np.random.default_rng(977).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of `n` of the hashes `h`, put together from runs of powers of two."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out, at, power, level = None, 0, 1, 0
    while True:
        if n & power:
            part = h[at : at + size]
            out = part.copy() if out is None else (out ^ (out >> np.uint64(31))) * _ODD[15] + part
            at += power
        if 2 * power > n:
            return out
        h = (h[:-power] ^ (h[:-power] >> np.uint64(29))) * _ODD[level] + h[power:]
        power, level = 2 * power, level + 1


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each `n` consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors_and_windows(words: list[bytes], window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of `words`: its anchor and its hash; and the hashes of all phrases."""
    if len(words) < window:
        return (np.zeros(0, np.uint64),) * 3
    h = word_hashes(words)
    phrases = run_hashes(h, phrase)
    return sliding_min(phrases, window - phrase + 1), run_hashes(h, window), phrases


def _bits(x, bits: int):
    """The two places of 64-bit values in a bitmap; of columns (signed) or arrays (unsigned)."""
    shift = bits.bit_length() - 1
    if isinstance(x, np.ndarray):
        return x & np.uint64(bits - 1), (x >> np.uint64(shift)) & np.uint64(bits - 1)
    return x.bitwiseAND(F.lit(bits - 1).cast("long")), F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(bits - 1).cast("long"))


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the single long column of `values`; the driver gets at most bits / 64 longs."""
    column = F.col(values.columns[0])
    cells = values.select(F.explode(F.array(*_bits(column, bits))).alias("b")).select(F.shiftright("b", 6).alias("cell"), F.expr("shiftleft(1L, CAST(b & 63 AS INT))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["cell"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out


def in_bitmap(cells: np.ndarray, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for b in _bits(x, 64 * len(cells)):
        hit &= (cells[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _kept_hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def document_anchors(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(anchor, doc_id), each once a document and batch."""

    def found(batches):
        import pyarrow as pa

        for part in pieces(batches, "text"):
            each = [np.unique(anchors_and_windows(_split(t), window, phrase)[0]) for t in part.column("text").to_pylist()]
            ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), list(map(len, each)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64)), pa.array(ids, pa.int64())], ["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(found, "anchor long, doc_id long")


def with_candidates(docs: DataFrame, cells, window: int, phrase: int) -> DataFrame:
    """doc_id, n_words, and kept_sha256 for rows without an anchor in the bitmap; text and anchors for the others."""

    def found(batches):
        import pyarrow as pa

        for part in pieces(batches, "text"):
            n_words, hashes, texts, anchors = [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = _split(text)
                seen = np.zeros(0, np.uint64) if doc_id is None else np.unique(anchors_and_windows(words, window, phrase)[0])
                seen = seen[in_bitmap(cells.value, seen)]
                n_words.append(len(words))
                hashes.append(None if len(seen) else _kept_hash(words))
                texts.append(text if len(seen) else None)
                anchors.append(seen.view(np.int64) if len(seen) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string()), pa.array(anchors, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "kept_sha256", "text", "anchors"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, "doc_id long, n_words long, kept_sha256 string, text string, anchors array<long>")


def candidate_windows(candidates: DataFrame, cells, window: int, phrase: int) -> DataFrame:
    """(anchor, hash, doc_id) of the windows of `candidates` whose anchor is in the bitmap, each once a row."""

    def found(batches):
        import pyarrow as pa

        for part in pieces(batches, "text"):
            anchors, hashes, sizes = [], [], []
            for text in part.column("text").to_pylist():
                a, h, _ = anchors_and_windows(_split(text), window, phrase)
                hit = in_bitmap(cells.value, a)
                h, at = np.unique(h[hit], return_index=True)
                anchors.append(a[hit][at])
                hashes.append(h)
                sizes.append(len(h))
            ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (anchors, hashes)] + [pa.array(ids, pa.int64())], ["anchor", "hash", "doc_id"])

    return candidates.select("doc_id", "text").mapInArrow(found, "anchor long, hash long, doc_id long")


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def owned_passages(owners: DataFrame, window: int, phrase: int) -> DataFrame:
    """(owner, passage, anchors) for rows of `owners` (doc_id, text, hashes): the runs of words that the owned windows cover."""

    def found(batches):
        import pyarrow as pa

        for part in pieces(batches, "text"):
            rows = []
            for doc_id, text, owned in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("hashes"), strict=True):
                words = _split(text)
                anchors, hashes, _ = anchors_and_windows(words, window, phrase)
                marks = np.isin(hashes, owned.values.to_numpy(zero_copy_only=False).view(np.uint64))
                rows += [(doc_id, b" ".join(words[a : b + window - 1]), np.unique(anchors[a:b]).view(np.int64)) for a, b in _runs(marks)]
            if rows:
                ids, passages, anchors = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(passages, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], ["owner", "passage", "anchors"])

    return owners.select("doc_id", "text", "hashes").mapInArrow(found, "owner long, passage binary, anchors array<long>")


class PhraseAutomaton:
    """An Aho-Corasick automaton, over word numbers, of the anchor phrases of passages (owner, words), and their windows."""

    def __init__(self, passages: list[tuple[int, list[bytes]]], window: int, phrase: int):
        import ahocorasick

        self.window, self.phrase = window, phrase
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        ids, owners, hashes, starts, at = [], [], [], [], 0
        for owner, words in passages:
            anchors, window_hashes, phrases = anchors_and_windows(words, window, phrase)
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for k in np.flatnonzero(np.isin(phrases, anchors)).tolist():
                self.automaton.add_word(tuple(own[k : k + phrase]), 1)
            ids.append(np.array(own, np.int64))
            hashes.append(window_hashes)
            owners.append(np.full(len(window_hashes), owner, np.int64))
            starts.append(at + np.arange(len(window_hashes)))
            at += len(own)
        self.empty = not at
        if self.empty:
            return
        self.automaton.make_automaton()
        self.ids, hashes, owners, starts = map(np.concatenate, (ids, hashes, owners, starts))
        order = np.lexsort((owners, hashes))
        first = np.concatenate(([True], np.diff(hashes[order]) != 0))
        self.hashes, self.owners, self.starts = (x[order][first] for x in (hashes, owners, starts))

    def removed(self, doc_id: int, words: list[bytes]) -> np.ndarray:
        """Which of `words` are in a window that a passage of a smaller doc_id holds."""
        gone = np.zeros(len(words), bool)
        n = len(words) - self.window + 1
        if self.empty or n <= 0:
            return gone
        known = self.numbers
        numbers = tuple([known.get(w, 0) for w in words])
        hits = [end for end, _ in self.automaton.iter(numbers)]
        if not hits:
            return gone
        ends = np.array(hits)
        # the windows that a hit phrase lies in
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.clip(ends - self.window + 1, 0, n), 1)
        np.add.at(near, np.clip(ends - self.phrase + 2, 0, n), -1)
        at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        hashes = run_hashes(word_hashes(words), self.window)[at]
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = (self.hashes[place] == hashes) & (self.owners[place] < doc_id)
        at, source = at[same], self.starts[place[same]]
        ids = np.array(numbers, np.int64)
        step = 0
        while len(at) and step < self.window:  # word by word; only what differs under an equal hash drops out
            equal = ids[at + step] == self.ids[source + step]
            if not equal.all():
                at, source = at[equal], source[equal]
            step += 1
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.window, -1)
        return np.cumsum(cover[:-1]) > 0


DONE = "row long, doc_id long, n_words long, n_removed long, kept_sha256 string, runs binary"
_DONE = DONE.replace(" long", "").replace(" string", "").replace(" binary", "").split(", ")


def dedup_shards(texts: DataFrame, passages: DataFrame, window: int, phrase: int) -> DataFrame:
    """Streams the rows of `texts` (shard, chunk, parts, row, doc_id, text) through the automaton of their shard's chunk of `passages` (shard, chunk, owner, passage).

    Where a shard has one chunk, n_removed and kept_sha256; else runs, the (start, stop) of what this chunk removes as 32-bit integers.
    """

    def streamed(left, right):
        import pyarrow as pa

        automaton = PhraseAutomaton([(o, p.split()) for o, p in zip(right["owner"].to_pylist(), right["passage"].to_pylist(), strict=True)], window, phrase)
        rows = []
        for row, doc_id, parts, text in zip(left["row"].to_pylist(), left["doc_id"].to_pylist(), left["parts"].to_pylist(), left["text"], strict=True):
            words = _split(text.as_py())
            gone = automaton.removed(doc_id, words)
            if parts > 1:
                rows.append((row, doc_id, len(words), None, None, np.array(_runs(gone), np.int32).tobytes()))
            else:
                rows.append((row, doc_id, len(words), int(gone.sum()), _kept_hash([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _DONE)

    return texts.groupBy("shard", "chunk").cogroup(passages.groupBy("shard", "chunk")).applyInArrow(streamed, DONE)


def joined_runs(texts: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of rows of `texts` (doc_id, text, each: the runs of every chunk)."""

    def finished(batches):
        import pyarrow as pa

        for part in pieces(batches, "text"):
            rows = []
            for doc_id, text, each in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("each").to_pylist(), strict=True):
                words = _split(text)
                cover = np.zeros(len(words) + 1, np.int64)
                for runs in each:
                    at = np.frombuffer(runs, np.int32)
                    np.add.at(cover, at[::2], 1)
                    np.add.at(cover, at[1::2], -1)
                gone = np.cumsum(cover[:-1]) > 0
                rows.append((doc_id, len(words), int(gone.sum()), _kept_hash([w for w, g in zip(words, gone.tolist(), strict=True) if not g])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _DONE[1:5])

    return texts.select("doc_id", "text", "each").mapInArrow(finished, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, bits: int | None = None, shard_chars: int = SHARD_CHARS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    every = document_anchors(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, phrase)
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = materialize(shared, "substring-shared")
    bits = bits or min(max(1 << (BITS_EACH * shared.count()).bit_length(), LEAST_BITS), MOST_BITS)
    cells = spark.sparkContext.broadcast(bitmap(shared, bits))
    table_ = materialize(with_candidates(docs, cells, window, phrase).withColumn("row", F.monotonically_increasing_id()), "substring-documents")
    done = table_.where("text IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    candidates = table_.where("text IS NOT NULL")
    chars = candidates.agg(F.sum(F.length("text")).alias("n")).first()["n"]
    if not chars:
        return done
    windows = candidate_windows(candidates, cells, window, phrase).groupBy("anchor", "hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("b"))
    recurring = materialize(windows.where("owner < b").select("hash", "owner"), "substring-windows")
    owned = recurring.groupBy("owner").agg(F.collect_list("hash").alias("hashes"))
    passages = owned_passages(candidates.join(owned, F.col("doc_id") == F.col("owner")), window, phrase)
    passages = materialize(passages.select(F.monotonically_increasing_id().alias("passage_id"), "*"), "substring-passages")

    shards = max(1, -(-chars // shard_chars))
    family = F.array_min("anchors")
    large = candidates.groupBy(family.alias("family")).agg(F.sum(F.length("text")).alias("n")).where(F.col("n") > shard_chars)
    large = materialize(large.select("family", F.ceil(F.col("n") / shard_chars).alias("parts")), "substring-families")
    # no more rows than shards
    dealt = candidates.withColumn("family", family).join(F.broadcast(large) if shards <= MOST_BROADCAST else large, "family", "left")
    part = F.pmod(F.xxhash64("doc_id", "n_words"), F.coalesce("parts", F.lit(1)))
    dealt = dealt.select(F.pmod(F.xxhash64("family", part), F.lit(shards)).cast("int").alias("shard"), "row", "doc_id", "text", "anchors")
    asked = materialize(dealt.select("shard", "doc_id", F.explode("anchors").alias("anchor")).groupBy("shard", "anchor").agg(F.max("doc_id").alias("last")), "substring-asked")
    phrases = materialize(passages.select("passage_id", "owner", F.explode("anchors").alias("anchor")), "substring-phrases")
    routes = materialize(asked.join(phrases, "anchor").where("owner < last").select("shard", "passage_id").distinct(), "substring-routes")
    routed = routes.join(passages, "passage_id").select("shard", "passage_id", "owner", "passage")
    # an anchor that very many passages hold gives its shards more of these than one automaton should have
    sizes = routes.join(passages.select("passage_id", F.octet_length("passage").alias("n")), "passage_id").groupBy("shard").agg(F.sum("n").alias("n"))
    many = materialize(sizes.where(F.col("n") > chunk_bytes).select("shard", F.ceil(F.col("n") / chunk_bytes).cast("int").alias("parts")), "substring-chunks")
    one = F.coalesce("parts", F.lit(1))
    wide = F.broadcast(many) if shards <= MOST_BROADCAST else many
    routed = routed.join(wide, "shard", "left").select("shard", F.pmod(F.xxhash64("passage_id"), one).cast("int").alias("chunk"), "owner", "passage")
    texts = dealt.select("shard", "row", "doc_id", "text").join(wide, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), one - 1)).alias("chunk"), one.alias("parts"), "row", "doc_id", "text")
    out = dedup_shards(texts, routed, window, phrase)
    if not many.isEmpty():
        out = materialize(out, "substring-runs")
        each = out.where("runs IS NOT NULL").groupBy("row").agg(F.collect_list("runs").alias("each"))
        done = done.unionByName(joined_runs(candidates.select("row", "doc_id", "text").join(each, "row")))
        out = out.where("runs IS NULL")
    return done.unionByName(out.select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    return dedup_substrings(table(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE_SQL = {
    "op10_substring_dedup": rf"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT k, doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM w WHERE len(w) >= {WINDOW}
), hashed AS (
  SELECT k, doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM windows
), owned AS (
  SELECT k, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS owner FROM hashed
), gone AS (
  SELECT DISTINCT k, i + j AS i FROM owned, range({WINDOW}) AS r(j) WHERE owner < doc_id
), kept AS (
  SELECT k, doc_id, len(w) AS n_words, w, list(gone.i) FILTER (gone.i IS NOT NULL) AS gone FROM w LEFT JOIN gone USING (k) GROUP BY k, doc_id, w
)
SELECT doc_id, n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM kept
"""
}
