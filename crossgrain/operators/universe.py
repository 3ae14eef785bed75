"""Membership, delistings and holdings filings, all point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgrain.sources.panels import manifest

# Month abbreviations of filing dates.
MONTHS = {"JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12}


def membership_replay(grid: DataFrame, changes: DataFrame) -> DataFrame:
    """`grid` (d, asset) and member: whether the last action up to d, inclusive, is `add`; no action is no member.

    `changes`: date, asset, action. The two are unioned and the last action carried along each asset's dates.
    """
    events = changes.select(F.col("date").alias("d"), "asset", "action", F.lit(0).alias("kind"))
    both = events.unionByName(grid.select("d", "asset", F.lit(None).cast("string").alias("action"), F.lit(1).alias("kind")))
    w = W.partitionBy("asset").orderBy("d", "kind", "action").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("last", F.last("action", ignorenulls=True).over(w)).where("kind = 1").select("d", "asset", F.coalesce(F.col("last") == "add", F.lit(False)).alias("member"))


def membership_latest_add(grid: DataFrame, changes: DataFrame) -> DataFrame:
    """`grid` and member: d is on or after the asset's last `add`; without one it always is. Removals do not count."""
    last = changes.where("action = 'add'").groupBy("asset").agg(F.max("date").alias("since"))
    return grid.join(last, "asset", "left").select("d", "asset", F.coalesce(F.col("d") >= F.col("since"), F.lit(True)).alias("member"))


def apply_delistings(panel: DataFrame, delistings: DataFrame) -> DataFrame:
    """`panel` with the last price times (1 + final_return) at the first date on or after the delisting; `delistings`: asset, date, final_return."""
    last = panel.where("px IS NOT NULL").groupBy("asset").agg(F.max_by("px", "pos").alias("last_px"))
    at = panel.join(F.broadcast(delistings), "asset").where(F.col("d") >= F.col("date")).groupBy("asset").agg(F.min("d").alias("d"), F.max("final_return").alias("final_return"))
    patch = at.join(last, "asset").select("asset", "d", (F.col("last_px") * (1 + F.col("final_return"))).alias("patch"))
    return panel.join(F.broadcast(patch), ["asset", "d"], "left").withColumn("px", F.coalesce("patch", "px")).drop("patch")


def change_events(table: DataFrame, date: str, added: str, removed: str) -> DataFrame:
    """date, asset, action of a table with a column of added and one of removed assets; rows without a date or an asset are none."""
    events = table.select(F.col(date).cast("date").alias("date"), F.expr(f"stack(2, `{added}`, 'add', `{removed}`, 'remove') AS (asset, action)"))
    return events.where("date IS NOT NULL AND trim(coalesce(asset, '')) <> ''").select("date", F.trim("asset").alias("asset"), "action")


def static_sectors(spark: SparkSession, assets: list[str], known: dict[str, str]) -> DataFrame:
    """asset and sector, each asset once; `other` for those that `known` does not have."""
    return spark.createDataFrame([(a, known.get(a, "other")) for a in dict.fromkeys(assets)], "asset string, sector string")


def filing_date(text: Column) -> Column:
    """The date of DD-MON-YYYY; NULL for anything else. Months come from a table, not from a locale."""
    parts = F.split(F.upper(text), "-")
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    ok = F.size(parts) == 3
    iso = F.concat_ws("-", F.try_element_at(parts, F.lit(3)), F.lpad(F.try_element_at(month, F.try_element_at(parts, F.lit(2))).cast("string"), 2, "0"), F.lpad(F.try_element_at(parts, F.lit(1)), 2, "0"))
    return F.when(ok, F.try_to_date(iso, "yyyy-MM-dd"))


def filings_holders(info: DataFrame, submissions: DataFrame, mapping: DataFrame, period: str, public: str) -> DataFrame:
    """cik, asset: holders of shares, not options, in original filings of `period` filed by `public`; amendments do not count.

    `info`: ACCESSION_NUMBER, CUSIP, SSHPRNAMTTYPE, PUTCALL; `submissions`: ACCESSION_NUMBER, FILING_DATE,
    SUBMISSIONTYPE, CIK, PERIODOFREPORT, dates as DD-MON-YYYY; `mapping`: cusip, asset. An empty result raises.
    """
    shares = info.where((F.col("SSHPRNAMTTYPE") == "SH") & (F.coalesce("PUTCALL", F.lit("")) == "")).join(F.broadcast(mapping), info["CUSIP"] == mapping["cusip"])
    original = submissions.where((F.col("SUBMISSIONTYPE") == "13F-HR") & (filing_date(F.col("PERIODOFREPORT")) == F.lit(period).cast("date")) & (filing_date(F.col("FILING_DATE")) <= F.lit(public).cast("date")))
    found = shares.join(original, "ACCESSION_NUMBER").select(F.col("CIK").alias("cik"), "asset").distinct()
    if found.isEmpty():
        raise ValueError(f"no holders for period {period} public by {public}")
    return found


def read_filing_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a tab-separated table, all strings; an empty field is NULL."""
    header = spark.read.text(path).first()["value"].split("\t")
    schema = ", ".join(f"`{c}` string" for c in header)
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path).select(*columns)


def content_hash(panel: DataFrame) -> DataFrame:
    """One row, sha256 and n: a digest of all (asset, d, px to six digits), whatever the order of rows.

    Rows are hashed where they are and the hashes summed, so nothing is gathered: a sum of 64-bit parts.
    """
    row = F.sha2(F.concat_ws("|", F.col("asset").cast("string"), F.col("d").cast("string"), F.coalesce(F.format_string("%.6f", F.round("px", 6)), F.lit(""))), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return panel.select(part.alias("p")).agg(F.sum("p").cast("string").alias("digest"), F.count("*").alias("n"))


def verify(panel: DataFrame, expected: dict) -> list[str]:
    """What of `expected` (a manifest and, as `digest`, a content hash) does not hold for `panel`; empty where nothing drifted."""
    found = manifest(panel) | {"digest": content_hash(panel).first()["digest"]}
    return [f"{k}: {found.get(k)} for {v}" for k, v in expected.items() if found.get(k) != v]


def snapshot_table(spark: SparkSession, snapshots: list[tuple[str, str]]) -> DataFrame:
    """period and public, each period once: when what holders filed for a period could be read. A date before its period raises."""
    if bad := [p for p, public in snapshots if public <= p]:
        raise ValueError(f"public before the end of the period: {bad}")
    return spark.createDataFrame(list(dict(snapshots).items()), "period string, public string").select(F.col("period").cast("date").alias("period"), F.col("public").cast("date").alias("public"))


def identifier_map(spark: SparkSession, path: str, asset: str = "ticker", identifier: str = "cusip") -> DataFrame:
    """cusip and asset of a CSV dimension: identifiers are text, so leading zeros stay; repeated identifiers and empty fields raise."""
    rows = spark.read.option("header", True).csv(path).select(F.trim(identifier).alias("cusip"), F.trim(asset).alias("asset"))
    bad = rows.groupBy("cusip").agg(F.count("*").alias("n"), F.count_if(F.coalesce("asset", F.lit("")) == "").alias("e")).where("n > 1 OR e > 0 OR coalesce(cusip, '') = ''")
    if not bad.isEmpty():
        raise ValueError(f"identifiers that are repeated or empty: {[r['cusip'] for r in bad.limit(5).collect()]}")
    return rows


def ordered_universe(*lists: list[str]) -> list[str]:
    """The assets of all lists, each at its first place."""
    return list(dict.fromkeys(a for x in lists for a in x))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """asset, sector and place of a CSV universe (asset, sector): each asset at its first line, `other` without a sector."""
    lines = spark.read.option("header", True).csv(path).select("asset", "sector", F.monotonically_increasing_id().alias("line"))
    first = lines.where("asset IS NOT NULL").groupBy("asset").agg(F.min(F.struct("line", "sector")).alias("f"))
    return first.select("asset", F.coalesce("f.sector", F.lit("other")).alias("sector"), (F.row_number().over(W.orderBy("f.line")) - 1).alias("place"))
