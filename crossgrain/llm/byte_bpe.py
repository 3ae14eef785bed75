"""Byte-level BPE encoding and decoding with DuckDB recursive queries in every partition.

Encoding: the pattern cuts a text into words. New words of a partition go, byte by byte, into a table of
token-position rows (word, place, id). A recursive query joins neighbours with the merge table and
contracts each word's leftmost pair of minimum rank, round after round, until no word has a pair left.
Words that are tokens as they stand need no merges. Decoding: token-position rows (document, place, id)
join the vocabulary, and an aggregation ordered by place puts the bytes together.

In a word of over `WHOLE_WORD` bytes a round contracts every pair that is of minimum rank among the pairs within
the length of the longest token that the word's bytes allow. What is further away can reach the pair through one
growing token only, which is never that long, so no earlier merge can touch it: the result is that of one pair a
round, in rounds that do not grow with the word. Of pairs of one rank that overlap, every other from the left is
contracted once the first of them is. Where a new token would have a pair of lower rank with what is beside it,
the pairs of that rank that follow wait, and the leftmost goes alone.

A worker keeps the words that it has encoded, in two generations of at most `CACHE_WORDS`: a full one
becomes the old one, and what is met again moves on; words of over `WHOLE_WORD` bytes are not kept. DuckDB has
one thread and bounded memory, and never writes to disk. A text's words are cut, and a document's ids decoded,
in runs of bounded size.

The merge table is built from the ranks by rule: each split of a token into two tokens is a pair.

Defined results: a null text counts as empty, which has no ids and decodes to no bytes; every row gives
one row, repeated rows and null ids included; other columns pass through; an empty table gives an empty
result. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm.text import give_back_memory, pieces
from crossgrain.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_WORDS = 500_000
#: Bytes of the longest words whose rounds contract one pair each.
WHOLE_WORD = 64
#: Rows of all rounds of a query, at the most: half the square of a word's bytes.
ROWS_AT_ONCE = 1_500_000
#: Bytes of long words that a query takes, one word at least, and its rounds.
LONG_AT_ONCE, ROUNDS = 100_000, 8
#: Token rows that go to a decoding query, and words that are cut from a text, at a time.
TOKENS_AT_ONCE, WORDS_AT_ONCE = 400_000, 400_000
#: Bytes of texts whose words are cut at a time; a longer text is cut in runs of words.
CHARS_AT_ONCE = 1 << 22
#: Rows of the batches that are handed on.
ROWS_OUT = 256
DUCKDB_MEMORY = "200MB"

# best: rank, place and next place of a word's leftmost pair of minimum rank, in 17, 23 and 23 bits
_PAIRS = """
  SELECT w, pos, id, min((rank :: BIGINT << 46) | (pos :: BIGINT << 23) | next_pos) OVER (PARTITION BY w) AS best
  FROM (SELECT w, pos, id, lead(id) OVER o AS next_id, lead(pos) OVER o AS next_pos FROM {source} WINDOW o AS (PARTITION BY w ORDER BY pos)) s
  LEFT JOIN merges m ON m.low = s.id AND m.high = s.next_id
"""
_CONTRACTED = """(
  SELECT w, pos, CASE WHEN pos = (best >> 23) & 8388607 THEN (best >> 46) :: INTEGER ELSE id END AS id
  FROM step WHERE best IS NOT NULL AND pos <> best & 8388607
)"""
ENCODE = f"""
WITH RECURSIVE step(w, pos, id, best) AS (
  {_PAIRS.format(source="bytes_of_words")} UNION ALL {_PAIRS.format(source=_CONTRACTED)}
)
SELECT w, pos, id FROM step WHERE best IS NULL ORDER BY w, pos
"""
# run: overlapping pairs of one rank; alone: the new token would have a pair of lower rank with a neighbour; take: contracted in this round
_NEAR_PAIRS = """
  SELECT w, pos, id, round, rank, open, coalesce(own = best OR rank = best >> 41 AND NOT alone AND (k - run) & 1 = 0 AND coalesce(last_alone < least(run, k - {reach}), true)
    AND run = max(CASE WHEN k = run AND rank = best >> 41 THEN k END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS take
  FROM (SELECT *, (rank :: BIGINT << 41) | pos AS own, min((rank :: BIGINT << 41) | pos) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS best,
      max(start) OVER o AS run, max(CASE WHEN alone THEN k END) OVER o AS last_alone, count(rank) OVER (PARTITION BY w) > 0 AS open
    FROM (SELECT w, pos, id, round, k, m.rank AS rank, coalesce(m.twice OR a.rank < m.rank OR b.rank < m.rank, false) AS alone, CASE WHEN m.rank IS DISTINCT FROM lag(m.rank) OVER (PARTITION BY w ORDER BY pos) THEN k END AS start
      FROM (SELECT *, lag(id) OVER o AS last_id, lead(id) OVER o AS next_id, lead(id, 2) OVER o AS third_id, row_number() OVER o AS k FROM {source} WINDOW o AS (PARTITION BY w ORDER BY pos)) s
      LEFT JOIN merges m ON m.low = s.id AND m.high = s.next_id
      LEFT JOIN falling a ON a.low = m.rank AND a.high = s.third_id
      LEFT JOIN falling b ON b.low = s.last_id AND b.high = m.rank)
    WINDOW o AS (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING))
"""
_NEAR_CONTRACTED = """(
  SELECT w, pos, CASE WHEN take THEN rank ELSE id END AS id, round + 1 AS round
  FROM (SELECT *, lag(take) OVER (PARTITION BY w ORDER BY pos) AS taken FROM step WHERE open AND round < {rounds}) WHERE taken IS NOT TRUE
)"""


def encode_long(reach: int, rounds: int) -> str:
    """The query for rows of long words, `rounds` rounds on; open: the word has a pair left."""
    first, next_ = "(SELECT w, pos, id, 0 AS round FROM bytes_of_words)", _NEAR_CONTRACTED.format(rounds=rounds)
    return f"""
WITH RECURSIVE step(w, pos, id, round, rank, open, take) AS (
  {_NEAR_PAIRS.format(source=first, reach=reach)} UNION ALL {_NEAR_PAIRS.format(source=next_, reach=reach)}
)
SELECT w, pos, id, open FROM step WHERE NOT open OR round = {rounds} ORDER BY w, pos
"""


DECODE = "SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS decoded FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


class Tokenizer:
    """The vocabulary at `path`, in a DuckDB database of this process."""

    def __init__(self, path: str, pattern: str, cache_words: int = CACHE_WORDS):
        import duckdb
        import pyarrow as pa
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]
        self.cache_words = cache_words
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        pairs = [(low, high, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (low := self.ranks.get(token[:k])) is not None and (high := self.ranks.get(token[k:])) is not None]
        twice = {low for low, high, rank in pairs if low == high and rank < low}
        merges = pa.table([*[pa.array(c, pa.int32()) for c in zip(*pairs, strict=True)], pa.array([rank in twice for _, _, rank in pairs])], ["low", "high", "rank", "twice"])  # noqa: F841
        down = [p for p in pairs if p[2] < max(p[0], p[1])]
        falling = pa.table([pa.array([p[k] for p in down], pa.int32()) for k in range(3)], ["low", "high", "rank"])  # noqa: F841
        vocabulary = pa.table([pa.array(self.ranks.values(), pa.int32()), pa.array([t.hex() for t in self.ranks])], ["id", "hex"])  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE falling AS SELECT * FROM falling")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.by_length = sorted(self.ranks, key=len, reverse=True)
        self.reaches: dict[bytes, int] = {}

    def _query(self, sql: str, name: str, rows) -> object:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _rows(self, words: list[bytes]):
        """w, pos and id of every byte of `words`."""
        import numpy as np

        sizes = np.array([len(x) for x in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return w, pos, np.array(self.of_byte, np.int32)[np.frombuffer(b"".join(words), np.uint8)]

    def merged(self, words: list[bytes]) -> Iterator[bytes]:
        """The ids of each of `words`, of at most WHOLE_WORD bytes, as bytes."""
        import numpy as np
        import pyarrow as pa

        for a, b in _runs([len(x) * len(x) // 2 for x in words], ROWS_AT_ONCE):
            w, pos, ids = self._rows(words[a:b])
            found = self._query(ENCODE, "bytes_of_words", pa.table({"w": w, "pos": pos.astype(np.int32), "id": ids}))
            flat, at = found["id"].to_numpy().astype("<u4").tobytes(), 0
            for stop in np.cumsum(np.bincount(found["w"].to_numpy(), minlength=b - a)).tolist():
                yield flat[4 * at : 4 * stop]
                at = stop

    def reach(self, data: bytes) -> int:
        """The length of the longest token of no bytes but those of `data`."""
        kinds = bytes(sorted(set(data)))
        if kinds not in self.reaches:
            self.reaches[kinds] = next(len(t) for t in self.by_length if not t.translate(None, kinds))
        return self.reaches[kinds]

    def merged_long(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of `words`, of any length, as bytes; a query takes as many rounds as keep its rows bounded, and what has pairs left goes to the next."""
        import numpy as np
        import pyarrow as pa

        out: list[bytes] = [b""] * len(words)
        of_reach: dict[int, list[int]] = {}
        for k, x in enumerate(words):
            of_reach.setdefault(self.reach(x), []).append(k)
        for reach, numbers in of_reach.items():
            for a, b in _runs([len(words[k]) for k in numbers], LONG_AT_ONCE):
                w, pos, ids = self._rows([words[k] for k in numbers[a:b]])
                while len(w):
                    rounds = max(1, min(ROUNDS, ROWS_AT_ONCE // len(w)))
                    found = self._query(encode_long(reach, rounds), "bytes_of_words", pa.table({"w": w, "pos": pos, "id": ids}))
                    w, pos, ids, open_ = (found[c].to_numpy(zero_copy_only=False) for c in ("w", "pos", "id", "open"))
                    for k in np.unique(w[~open_]).tolist():
                        out[numbers[a + k]] = ids[np.searchsorted(w, k) : np.searchsorted(w, k, "right")].astype("<u4").tobytes()
                    w, pos, ids = w[open_], pos[open_], ids[open_]
        return out

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodes `words` into the cache; long ones are given back instead."""
        rest, long = [], []
        for word in words:
            data = word.encode()
            if (rank := self.ranks.get(data)) is not None:
                self.cache[word] = rank.to_bytes(4, "little")
            else:
                (long if len(data) > WHOLE_WORD else rest).append((word, data))
        for (word, _), ids in zip(rest, self.merged([data for _, data in rest]), strict=True):
            self.cache[word] = ids
        return dict(zip([word for word, _ in long], self.merged_long([data for _, data in long]), strict=True))

    def _cut(self, texts: list[str], chars: int) -> Iterator[list[tuple[int, list[str]]]]:
        """Runs of (text's number, words): all words of texts of `chars` characters together, and a longer text's in several runs."""
        held, size = [], 0
        for k, t in enumerate(texts):
            if held and size + len(t) > chars:
                yield held
                held, size = [], 0
            if len(t) <= chars:
                held.append((k, self.pattern.findall(t)))
                size += len(t)
            else:
                found = (m[0] for m in self.pattern.finditer(t))
                while words := list(islice(found, WORDS_AT_ONCE)):
                    yield [(k, words)]
        if held:
            yield held

    def encode(self, texts: list[str], chars: int = CHARS_AT_ONCE) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for cut in self._cut(texts, chars):
            every = set().union(*[words for _, words in cut])
            new = every - self.cache.keys()
            if len(self.cache) + len(new) > self.cache_words:
                self.cache, self.old = {}, self.cache
                new = every
            met = new & self.old.keys()
            self.cache.update((w, self.old[w]) for w in met)
            if long := self.learn(list(new - met)):
                known = {w: self.cache[w] if w in self.cache else long[w] for w in every}
            else:
                known = self.cache
            for k, words in cut:
                out[k].append(b"".join([known[w] for w in words]))
        return [b"".join(x) for x in out]

    def _decoded(self, ids: list[bytes]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa

        out = [b""] * len(ids)
        sizes = np.array([len(x) // 4 for x in ids])
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        pos = (np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        found = self._query(DECODE, "tokens", pa.table({"doc": doc, "pos": pos, "id": flat}))
        for d, data in zip(found["doc"].to_pylist(), found["decoded"].to_pylist(), strict=True):
            out[d] = data
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each document's ids, at most TOKENS_AT_ONCE of which go to a query."""
        most = 4 * TOKENS_AT_ONCE
        cut = [(k, x[at : at + most]) for k, x in enumerate(ids) for at in range(0, len(x), most)]
        out: list[list[bytes]] = [[] for _ in ids]
        for a, b in _runs([len(x) for _, x in cut], most):
            for (k, _), data in zip(cut[a:b], self._decoded([x for _, x in cut[a:b]]), strict=True):
                out[k].append(data)
        return [b"".join(x) for x in out]


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str | None = None, pattern: str | None = None) -> Tokenizer:
    """This process's tokenizer of a rank file; the default is the public vocabulary for many languages."""
    import public_tokenizers

    key = (path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(*key)
    return _tokenizers[key]


def _with_columns(df: DataFrame, source: str, names: tuple[str, ...], convert, most: int, path: str | None, pattern: str | None) -> DataFrame:
    """`df` with binary columns `names` (in place of any so named) that `convert` makes of the list of `source` values of rows; at most `most` bytes of those at a time."""
    keep = [c for c in df.columns if c not in names]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"`{n}` binary" for n in names)])

    def converted(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def done(held):
            part = pa.Table.from_batches(held).combine_chunks()
            new = convert(part.column(source).to_pylist())
            out = pa.table([*[part.column(c) for c in keep], *[pa.array(x, pa.binary()) for x in new]], [*keep, *names])
            yield from out.to_batches(max_chunksize=ROWS_OUT)

        held, size = [], 0
        for part in pieces(batches, source, 1 << 30, most):
            n = pc.sum(pc.binary_length(part.column(source))).as_py() or 0
            if held and size + n > most:
                yield from done(held)
                held, size = [], 0
            held.append(part)
            size += n
        if held:
            yield from done(held)
        tokenizer(path, pattern).old.clear()
        give_back_memory()

    return df.mapInArrow(converted, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chars_at_once: int = CHARS_AT_ONCE, cache_words: int = CACHE_WORDS) -> DataFrame:
    """`docs` (with text) and `token_ids`: little-endian unsigned 32-bit ids. Fewer characters and words at once take less memory and more time."""

    def convert(texts):
        t = tokenizer(path, pattern)
        t.cache_words = cache_words
        return (t.encode([x or "" for x in texts], chars_at_once),)

    return _with_columns(docs, "text", ("token_ids",), convert, chars_at_once, path, pattern)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`tokens` (with token_ids) and `decoded`: the bytes that they stand for."""
    return _with_columns(tokens, "token_ids", ("decoded",), lambda ids: (tokenizer(path, pattern).decode([x or b"" for x in ids]),), 4 * TOKENS_AT_ONCE, path, pattern)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` (with text), `token_ids` and `decoded`, made of the ids alone, in one worker."""

    def convert(texts):
        t = tokenizer(path, pattern)
        ids = t.encode([x or "" for x in texts])
        return ids, t.decode(ids)

    return _with_columns(docs, "text", ("token_ids", "decoded"), convert, CHARS_AT_ONCE, path, pattern)


def ids_as_arrays(tokens: DataFrame) -> DataFrame:
    """`tokens` with the binary `token_ids` as an array of ints."""
    keep = [c for c in tokens.columns if c != "token_ids"]

    def unpacked(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids = b.column("token_ids").to_pylist()
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], lists], [*keep, "token_ids"])

    return tokens.mapInArrow(unpacked, ", ".join([*(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep), "token_ids array<int>"]))


def _runs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of rows (start, stop) of at most `most` in size together, one row at least."""
    runs, start, held = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            runs.append((start, k))
            start, held = k, 0
        held += n
    return [*runs, (start, len(sizes))] if sizes else runs


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    tokens = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.select(
        "doc_id", F.expr("CAST(octet_length(token_ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
