"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels by their leading `>` marks. An attribution line ("On ... wrote:")
goes at every level, if the next line that is not blank is deeper. A message's own words are the lines of level
zero that are left; a quoted passage is a run of lines of one level. Lines are normalised (lower case, white space
as one space) and hashed, blank ones left out. A passage is looked for as a whole, then paragraph by paragraph,
then line by line; each of these is in a message if it is a run of that message's own lines, or if its words are
all of the message or a paragraph of it, wrapped in another way. It joins the first earlier message of its
conversation that has it. Of a message's links, that of the lowest level, then of the largest part of a passage,
then of the first place says what it replies to.

Threads are the trees of these links. A message's thread is the turn at its root, found by pointer doubling,
as many rounds as the logarithm of the longest chain. A conversation in reply order is its messages by
(thread_turn, turn), and `position` is the place in it, from 1: every thread in one piece, each reply after what
it replies to. A message that quotes nothing known starts a thread, so a conversation without quotes keeps its order.

Spark: the parse is a map. Originals are grouped by (conversation, hash) with partial minima in every task,
so a line that a third of all messages share is one row a task; runs of own lines are hashed for the lengths that
passages of the conversation have, and no others; joins read plain tables, which Spark splits where a key is
frequent. Places are counted within the ranges that the order is dealt by, and added up. Nothing gathers a conversation: the result has a row a message, dealt by ranges of
the order, so that a conversation with a third of all rows spans as many tasks as it needs.

Defined results: a null text counts as empty; a null role is formatted as `unknown`; a null conv_id or turn
links to nothing; repeated turns of a conversation share a position, and answer as one message; ties
between originals go to the lowest turn; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgrain.llm.text import pieces
from crossgrain.sources.scratch import materialize
from crossgrain.sources.tables import table

_MARK = re.compile(r"[ \t]*((?:>[ \t]?)*)(.*)", re.DOTALL)
_ATTRIBUTION = re.compile(r"[ \t]*On .*wrote:[ \t]*")
#: The format of a message, of its role and content.
TEMPLATE = "<|im_start|>{role}\n{content}<|im_end|>\n"


def quote_level(line: str) -> tuple[int, str]:
    """How many `>` marks `line` starts with, and what follows them."""
    marks, rest = _MARK.fullmatch(line).groups()
    return (marks.count(">"), rest) if marks else (0, line)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """The message's own text, and its quoted passages (level, lines) in order."""
    lines, deeper = [], 0  # the level of the next line that is not blank
    for x in reversed((text or "").split("\n")):
        level, rest = quote_level(x)
        if not (deeper > level and _ATTRIBUTION.fullmatch(rest)):
            lines.append((level, rest))
        if rest.strip():
            deeper = level
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    before = 0
    for level, rest in reversed(lines):
        if level == 0:
            own.append(rest)
        elif level == before:
            quoted[-1][1].append(rest)
        else:
            quoted.append((level, [rest]))
        before = level
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), quoted


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Normalised lines without blank ones, cut where those stood."""
    out: list[list[str]] = [[]]
    for x in map(normalised, lines):
        if x:
            out[-1].append(x)
        elif out[-1]:
            out.append([])
    return [p for p in out if p]


def parts(lines: list[str]) -> list[tuple[int, int, list[str]]]:
    """(kind, place, normalised lines) of what a passage is looked for as: 0 all of it, 1 a paragraph, 2 a line."""
    cut = paragraphs(lines)
    every = [x for p in cut for x in p]
    out = [(0, 0, every)] if every else []
    if len(cut) > 1:
        out += [(1, k, p) for k, p in enumerate(cut)]
    if len(every) > 1:
        out += [(2, k, [x]) for k, x in enumerate(every)]
    return out


PARSED = "conv_id long, turn long, role string, content string, quotes array<struct<level:int,kind:int,place:int,part:int,text:long,lines:array<long>>>, units array<long>, own_lines array<long>"


def parse_messages(messages: DataFrame) -> DataFrame:
    """A row for each of `messages` (conv_id, turn, role, text) with its content, the hashed parts of its quotes, and hashes of its own text, its paragraphs and its lines."""

    def parsed(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        hashed = lambda s: xxh3_64_intdigest(s.encode()) - (1 << 63)
        kinds = pa.list_(pa.struct([*((c, pa.int32()) for c in ("level", "kind", "place", "part")), ("text", pa.int64()), ("lines", pa.list_(pa.int64()))]))
        for b in pieces(batches, "text", 512):
            contents, quotes, own_units, own_lines = [], [], [], []
            for text in b.column("text").to_pylist():
                own, quoted = parse(text)
                contents.append(own)
                quotes.append([
                    {"level": level, "kind": kind, "place": place, "part": part, "text": hashed(" ".join(x)), "lines": list(map(hashed, x))}
                    for place, (level, lines) in enumerate(quoted) for kind, part, x in parts(lines)
                ])
                cut = paragraphs(own.split("\n"))
                every = [x for p in cut for x in p]
                own_units.append(sorted({hashed(" ".join(x)) for x in [every, *cut] if x}))
                own_lines.append(list(map(hashed, every)))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(contents, pa.string()), pa.array(quotes, kinds), pa.array(own_units, pa.list_(pa.int64())), pa.array(own_lines, pa.list_(pa.int64()))],
                ["conv_id", "turn", "role", "content", "quotes", "units", "own_lines"],
            )

    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(parsed, PARSED)


def reply_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of the messages of `parsed` that quote an earlier one."""
    quotes = parsed.select("conv_id", "turn", F.inline("quotes")).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = materialize(quotes.withColumn("n", F.size("lines")).withColumn("lines", F.xxhash64("lines")), "chat-quotes")
    if quotes.isEmpty():
        return parsed.sparkSession.createDataFrame([], "conv_id long, turn long, reply_to long")
    keys = quotes.select("conv_id", "turn", "level", "kind", "place", "part", F.explode(F.array("text", "lines")).alias("hash"))
    asked = materialize(keys.select("conv_id", "hash").distinct(), "chat-asked")
    lengths = quotes.groupBy("conv_id").agg(F.collect_set("n").alias("lengths"))
    runs = F.expr("flatten(transform(lengths, m -> CASE WHEN size(own_lines) >= m THEN transform(sequence(1, size(own_lines) - m + 1), i -> xxhash64(slice(own_lines, i, m))) ELSE array() END))")
    said = parsed.where("turn IS NOT NULL").join(lengths, "conv_id").select("conv_id", "turn", F.explode(F.array_distinct(F.concat("units", runs))).alias("hash"))
    originals = materialize(said.join(asked, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("reply_to")), "chat-originals")
    linked = keys.join(originals, ["conv_id", "hash"]).where("reply_to < turn")
    return linked.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "kind", "place", "part", "reply_to")).alias("best")).select("conv_id", "turn", "best.reply_to")


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread_turn) of `links` (conv_id, turn, reply_to): the turn at the end of each chain."""
    at = materialize(links.select("*", F.col("reply_to").alias("thread_turn")), "chat-threads")
    while True:
        above = at.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("up"))
        moved = materialize(at.join(above, ["conv_id", "thread_turn"], "left").select("conv_id", "turn", "reply_to", F.coalesce("up", "thread_turn").alias("thread_turn"), F.col("up").isNotNull().alias("moved")), "chat-threads")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def format_conversations(messages: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row for each of `messages`: conv_id, position, turn, role, reply_to, thread_turn, content without quotes, formatted."""
    parsed = materialize(parse_messages(messages), "chat-parsed")
    threads = thread_roots(reply_links(parsed))
    head, tail = template.split("{content}")
    before, after = head.split("{role}")
    rows = parsed.select("conv_id", "turn", "role", "content").join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread_turn", "turn").alias("thread_turn"), "content",
        F.concat(F.lit(before), F.coalesce("role", F.lit("unknown")), F.lit(after), "content", F.lit(tail)).alias("formatted"),
    )
    order = ["conv_id", "thread_turn", "turn"]
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("dealt", F.spark_partition_id()), "chat-ordered")
    # rows of equal keys are in one range; those of a conversation in the ranges before count for its later ones
    ranges = rows.groupBy("conv_id", "dealt").agg(F.count("*").alias("n"))
    first = ranges.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("dealt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = rows.withColumn("rank", F.rank().over(W.partitionBy("conv_id", "dealt").orderBy("thread_turn", "turn")))
    placed = within.join(first.withColumnsRenamed({"conv_id": "c", "dealt": "r"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("dealt") == F.col("r")))
    return placed.select("conv_id", (F.col("before") + F.col("rank")).alias("position"), "turn", "role", "reply_to", "thread_turn", "content", "formatted")


def op9_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message in reply order without its quotes."""
    return format_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {"op9_chat_quotes": op9_chat_quotes}
ORACLE_SQL = {
    "op9_chat_quotes": r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS k, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations
), line AS (
  SELECT k, conv_id, turn, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM m
), marked AS (
  SELECT *, len(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS rest FROM line
), around AS (
  SELECT *, CASE WHEN trim(rest, chr(32) || chr(9)) <> '' THEN level END AS solid FROM marked
), kept AS (
  SELECT k, conv_id, turn, i, level, rest, lag(level, 1, 0) OVER (PARTITION BY k ORDER BY i) AS level_before, trim(regexp_replace(lower(rest), '\s+', ' ', 'g')) AS line
  FROM (SELECT *, coalesce(last_value(solid IGNORE NULLS) OVER (PARTITION BY k ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS deeper FROM around)
  WHERE NOT (deeper > level AND regexp_full_match(rest, '[ \t]*On .*wrote:[ \t]*'))
), run AS (
  SELECT *, sum((level <> level_before) :: INT) OVER (PARTITION BY k ORDER BY i) AS run, sum((line = '') :: INT) OVER (PARTITION BY k ORDER BY i) AS gap FROM kept
), own AS (
  SELECT k, conv_id, turn, trim(regexp_replace(coalesce(string_agg(rest, chr(10) ORDER BY i) FILTER (level = 0), ''), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS content,
    coalesce(list(line ORDER BY i) FILTER (level = 0 AND line <> ''), []) AS lines
  FROM (SELECT k, conv_id, turn, i, level, rest, line FROM run UNION ALL SELECT k, conv_id, turn, -1, 1, '', '' FROM m) GROUP BY k, conv_id, turn
), paragraph AS (
  SELECT k, sum((line = '') :: INT) OVER (PARTITION BY k ORDER BY i) AS gap, i, line FROM run WHERE level = 0
), unit AS (
  SELECT k, array_to_string(lines, ' ') AS unit FROM own WHERE len(lines) > 0
  UNION ALL SELECT k, string_agg(line, ' ' ORDER BY i) FROM paragraph WHERE line <> '' GROUP BY k, gap
), quote AS (
  SELECT * FROM run WHERE level > 0 AND line <> ''
), part AS (
  SELECT k, conv_id, turn, level, 0 AS kind, run AS place, 0 AS part, list(line ORDER BY i) AS lines FROM quote GROUP BY k, conv_id, turn, level, run
  UNION ALL SELECT k, conv_id, turn, level, 1, run, gap, list(line ORDER BY i) FROM quote GROUP BY k, conv_id, turn, level, run, gap
  UNION ALL SELECT k, conv_id, turn, level, 2, run, i, [line] FROM quote
), said AS (
  SELECT p.conv_id, p.turn, p.level, p.kind, p.place, p.part, min(o.turn) AS reply_to FROM part p JOIN own o ON o.conv_id = p.conv_id AND o.turn IS NOT NULL
  WHERE list_contains(list_transform(range(0, greatest(len(o.lines) - len(p.lines) + 1, 0)), lambda i: o.lines[i + 1 : i + len(p.lines)]), p.lines)
    OR EXISTS (SELECT 1 FROM unit u WHERE u.k = o.k AND u.unit = array_to_string(p.lines, ' '))
  GROUP BY ALL
), link AS (
  SELECT conv_id, turn, arg_min(reply_to, {'level': level, 'kind': kind, 'place': place, 'part': part}) AS reply_to FROM said WHERE reply_to < turn GROUP BY conv_id, turn
), up AS (
  SELECT conv_id, turn, reply_to AS thread_turn FROM link
  UNION ALL
  SELECT up.conv_id, up.turn, link.reply_to FROM up JOIN link ON link.conv_id = up.conv_id AND link.turn = up.thread_turn
), thread AS (
  SELECT conv_id, turn, min(thread_turn) AS thread_turn FROM up GROUP BY conv_id, turn
)
SELECT m.conv_id, rank() OVER (PARTITION BY m.conv_id ORDER BY coalesce(thread_turn, m.turn) NULLS FIRST, m.turn NULLS FIRST) AS position, m.turn, role, reply_to, coalesce(thread_turn, m.turn) AS thread_turn, content,
  '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || content || '<|im_end|>' || chr(10) AS formatted
FROM m JOIN own USING (k) LEFT JOIN link ON link.conv_id = m.conv_id AND link.turn = m.turn LEFT JOIN thread ON thread.conv_id = m.conv_id AND thread.turn = m.turn
"""
}
