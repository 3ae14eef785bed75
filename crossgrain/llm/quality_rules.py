"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Each rule is a boolean column that is true where it rejects a document. Rules run one after the other
inside one CASE expression, so that a document that an early rule rejects never pays for a later one.
Their order comes from a random sample, of rows of a few random files, and one job over it: each rule has a cost
expression, nanoseconds by what it has to read of a document beyond the metrics, whose mean over the sample is
the rule's cost; a bit pattern for each document gives what rules reject together; and the next rule is always the
one that rejects most of what is still left per cost. Costs are counted, not timed, so the same table gives the
same order every time. The sample decides the order only; verdicts are the same in any order.

Only DataFrame functions: one map over the documents, no shuffle, no Python.

Defined results: a null text counts as empty (no words, so `base_failed`); every row gives one row,
repeated rows and rows of the same doc_id included; a null doc_id stays null; other columns of the
input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm import text as T
from crossgrain.sources.tables import table

#: Rows, about, that rule costs and selectivities are estimated on, and the files that they are drawn from.
SAMPLE_ROWS, SAMPLE_FILES, SAMPLE_SEED = 500, 8, 7
#: Nanoseconds, about: to compare metrics, and to translate and measure a character.
COMPARE_NS, CHARACTER_NS = 10, 12
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """`rejects` and `cost` are SQL over the columns of `with_metrics`: a condition, null counts as false, and nanoseconds."""

    name: str
    rejects: str
    cost: str = f"{COMPARE_NS}"


#: What a rule costs that passes over the characters of the text.
PASS = f"{COMPARE_NS} + {CHARACTER_NS} * char_length(doc_text)"


#: What a base failure is: these two are in the cascade as well.
BASE_RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_words", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
)
#: Integer arithmetic throughout, so that any engine gives the same verdict.
RULES = (
    *BASE_RULES,
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("capitals", f"2 * (char_length(doc_text) - char_length(translate(doc_text, '{UPPER}', ''))) > word_chars", PASS),
    Rule("digits", "3 * (char_length(doc_text) - char_length(translate(doc_text, '0123456789', ''))) > word_chars", PASS),
    Rule("replacement_characters", "100 * (char_length(doc_text) - char_length(translate(doc_text, '�', ''))) > word_chars", PASS),
)


def with_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, doc_text (null: empty) and the integer metrics that rules use, one row for each of `docs`.

    Repeated three-word windows are found within the row: the windows are sorted with their places,
    equal neighbours mark their places, and the words that those cover are counted once.
    """
    # each array is a column of its own: a lambda that names an expression would evaluate it again for each element
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("doc_text"))
    df = df.select("*", T.words(F.col("doc_text")).alias("w"), F.filter(F.split("doc_text", "\n"), lambda x: F.length(F.translate(x, T.SPACES, "")) > 0).alias("lines"))
    df = df.select(
        "doc_id", "doc_text", "lines",
        F.size("w").alias("n_words"),
        F.expr("CASE WHEN size(w) < 4 THEN array() ELSE sort_array(transform(slice(w, 1, size(w) - 2), (x, i) -> struct(concat_ws(' ', x, w[i + 1], w[i + 2]) AS g, i AS i))) END").alias("grams"),
    )
    df = df.select(
        "doc_id", "doc_text", "lines", "n_words",
        F.expr("transform(filter(grams, (x, k) -> (k > 0 AND x.g = grams[greatest(k - 1, 0)].g) OR (k < size(grams) - 1 AND x.g = grams[least(k + 1, size(grams) - 1)].g)), x -> x.i)").alias("places"),
    )
    metrics = F.struct(
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.translate("doc_text", T.SPACES, "")).cast("long").alias("word_chars"),
        (F.length("doc_text") - F.length(F.translate("doc_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CAST(size(array_distinct(concat(places, transform(places, p -> p + 1), transform(places, p -> p + 2)))) AS BIGINT)").alias("n_repeat_words"),
    )
    # a generator of one row: filters on metrics stay above it, where they would else be pushed down and take each
    # metric apart into what it is made of, arrays within lambdas included
    return df.select("doc_id", "doc_text", F.inline(F.array(metrics)))


def rejects(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.rejects), F.lit(False))


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    share: float


def sample_documents(docs: DataFrame, rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES, seed: int = SAMPLE_SEED) -> DataFrame:
    """About `rows` random rows of `docs`, from `files` of its files, all by `seed`; other files are not read."""
    every = sorted({f.rsplit("/", 1)[-1] for f in docs.inputFiles()})
    if len(every) > files and "_metadata" not in docs.columns:
        docs = docs.where(F.col("_metadata.file_name").isin(random.Random(seed).sample(every, files)))
    return docs.select("doc_id", "text").where(F.rand(seed) < rows / max(docs.count(), 1))


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """`rules` in the order to run them: always the one with most rejections per cost among the sample's documents that are left.

    One job; the driver gets a row for each pattern of rejections that the sample has.
    """
    sample = with_metrics(sample_documents(docs, sample_rows))
    bits = [rejects(r).cast("int").alias(f"r{k}") for k, r in enumerate(rules)]
    costs = [F.expr(r.cost).cast("double").alias(f"c{k}") for k, r in enumerate(rules)]
    sums = [F.sum(f"c{k}").alias(f"c{k}") for k in range(len(rules))]
    rows = sample.select(*bits, *costs).groupBy(*[f"r{k}" for k in range(len(rules))]).agg(F.count("*").alias("n"), *sums).collect()
    total = sum(r["n"] for r in rows)
    cost = [sum(r[f"c{k}"] for r in rows) / total if total else 1.0 for k in range(len(rules))]
    left = [(tuple(r)[: len(rules)], r["n"]) for r in rows]
    order: list[Estimate] = []
    rest = list(range(len(rules)))
    while rest:
        gain = {k: sum(n for bits_, n in left if bits_[k]) for k in rest}
        best = max(rest, key=lambda k: (gain[k] / cost[k], -cost[k], -k))
        order.append(Estimate(rules[best], cost[best], gain[best] / total if total else 0.0))
        left = [(bits_, n) for bits_, n in left if not bits_[best]]
        rest.remove(best)
    return order


def rejected_by(order: list[Estimate]) -> Column:
    """The place in `order`, from 1, of the first rule that rejects; null where none does."""
    found = F.when(rejects(order[0].rule), F.lit(1))
    for k, e in enumerate(order[1:], 2):
        found = found.when(rejects(e.rule), F.lit(k))
    return found


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The metrics of each row of `docs` (doc_id, text), `base_failed` and `kept`."""
    metrics = with_metrics(docs)
    order = cascade_order(docs, rules, sample_rows)
    return metrics.select("*", (rejects(BASE_RULES[0]) | rejects(BASE_RULES[1])).alias("base_failed"), rejected_by(order).isNull().alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of every document."""
    return apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op1_quality_rules": op1_quality_rules}
_COUNT = "(length(doc_text) - length(regexp_replace(doc_text, '[{}]', '', 'g')))"
ORACLE_SQL = {
    "op1_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS doc_text, regexp_extract_all(coalesce(text, ''), '{T.WORD}') AS w FROM documents
), m AS (
  SELECT doc_id, doc_text, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
    {_COUNT.format('#*$%&|<>')} AS n_symbols,
    list_filter(string_split(doc_text, chr(10)), lambda x: regexp_matches(x, '{T.WORD}')) AS lines,
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS grams
  FROM w
), g AS (
  SELECT doc_id, unnest(grams) AS g, generate_subscripts(grams, 1) AS i FROM m
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), all_metrics AS (
  SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    {_COUNT.format('A-Z')} AS n_upper, {_COUNT.format('0-9')} AS n_digits, {_COUNT.format(chr(0xFFFD))} AS n_lost
  FROM m LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * n_upper > word_chars OR 3 * n_digits > word_chars OR 100 * n_lost > word_chars) AS kept
FROM all_metrics
"""
}
