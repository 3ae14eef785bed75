"""Dense (date, asset) panels from transaction tables.

A panel has a row for each calendar date and asset: d, pos (the date's place in the calendar, from 0),
asset, px, volume and ret; what is missing is NULL. Lags count calendar rows, not days. Prices are exact
decimal sums until the last division, so that they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgrain.sources.tables import table


def _exact_sum(column: str) -> Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def calendar(cells: DataFrame) -> DataFrame:
    """d and pos of the distinct dates of `cells`: a few thousand rows at any scale, so one task numbers them."""
    return cells.select("d").distinct().select("d", (F.row_number().over(W.orderBy("d")) - 1).alias("pos"))


def dense_grid(cells: DataFrame) -> DataFrame:
    """`cells` (d, asset, values) with a row for every date and asset; assets are spread over dates, dates broadcast."""
    days = F.broadcast(calendar(cells).agg(F.sort_array(F.collect_list(F.struct("pos", "d"))).alias("days")))
    grid = cells.select("asset").distinct().join(days).select("asset", F.explode("days").alias("day")).select("day.d", "day.pos", "asset")
    return grid.join(cells, ["d", "asset"], "left")


def with_returns(panel: DataFrame, value: str = "px") -> DataFrame:
    """`panel` and ret, NULL where either price is."""
    before = F.lag(value).over(W.partitionBy("asset").orderBy("pos"))
    return panel.withColumn("ret", F.try_divide(F.col(value), before) - 1)


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average price and quantity of suppliers by month of shipping."""
    items = table(spark, sf_dir, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("date").alias("d"), F.col("l_suppkey").alias("asset"), "l_extendedprice", "l_quantity")
    return dense_grid(_priced(items))


def brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average price and quantity of brands by week of shipping."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    items = table(spark, sf_dir, "lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("d"), "l_partkey", "l_extendedprice", "l_quantity")
    return dense_grid(_priced(items.join(parts, items["l_partkey"] == parts["p_partkey"])))


def _priced(items: DataFrame) -> DataFrame:
    sums = items.groupBy("d", "asset").agg(_exact_sum("l_extendedprice").alias("value"), _exact_sum("l_quantity").alias("volume"))
    return sums.select("d", "asset", F.try_divide("value", "volume").alias("px"), "volume")


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average value of users' events by day: a sparse panel."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), F.col("user_id").alias("asset"), F.col("value").cast("decimal(18,4)").alias("v"))
    return dense_grid(events.groupBy("d", "asset").agg((F.sum("v").cast("double") / F.count("v")).alias("px"), F.count("v").cast("double").alias("volume")))


def supplier_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset and sector: the region of each supplier, `other` where there is none."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"], "left").join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left")
    return joined.select(F.col("s_suppkey").alias("asset"), F.coalesce("r_name", F.lit("other")).alias("sector"))


def brand_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset and sector of brands: the first digit of the brand number."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("asset")).distinct()
    return brands.select("asset", F.regexp_extract("asset", "#([0-9])", 1).alias("sector"))


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot, public, holder, asset, each once: brands that a customer ordered in a year, public on 15 February after it."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    year = F.year("o_orderdate")
    return joined.select(year.alias("snapshot"), F.make_date(year + 1, F.lit(2), F.lit(15)).alias("public"), F.col("o_custkey").alias("holder"), F.col("p_brand").alias("asset")).distinct()


def read_market(spark: SparkSession, path: str) -> DataFrame:
    """A stored panel (d, asset, px, volume) as a dense one; a path that is not there raises, and no other data stands in for it."""
    return dense_grid(spark.read.parquet(path).select(F.col("d").cast("date").alias("d"), "asset", F.nanvl("px", F.lit(None).cast("double")).alias("px"), "volume"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether `path` is there, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_market(spark: SparkSession, path: str | None = None, synthetic: bool = False, allow_synthetic: bool = False, benchmark: str | None = None) -> tuple[DataFrame, DataFrame | None, bool]:
    """(panel, market return of `benchmark` by d or None, whether the panel is synthetic).

    `synthetic` asks for the generator. A path that is not there raises, unless `allow_synthetic` lets the generator
    stand in; the flag then says so. The benchmark is no asset of the panel.
    """
    from crossgrain.operators import synthetic as Y

    if not synthetic and not (path and path_exists(spark, path)):
        if not allow_synthetic:
            raise FileNotFoundError(f"no market at {path}, and no synthetic one is allowed")
        synthetic = True
    panel = dense_grid(Y.to_panel(spark, Y.factor_market(300, 24, 4)).drop("pos")) if synthetic else read_market(spark, path)
    if benchmark is None:
        return panel, None, synthetic
    market = with_returns(panel.where(F.col("asset") == benchmark)).select("d", F.col("ret").alias("mkt_ret"))
    return panel.where(F.col("asset") != benchmark), market, synthetic


def cached_market(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The panel (d, asset, px, volume) of `key` below `folder`; `make()` is called and written where it is not there yet."""
    path = f"{folder.rstrip('/')}/{key}.parquet"
    if not path_exists(spark, path):
        make().select("d", "asset", "px", "volume").write.parquet(path)
    return read_market(spark, path)


def manifest(panel: DataFrame) -> dict:
    """Dates, shape and assets of a panel, for a drift check beside its content hash."""
    r = panel.agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count_distinct("d").alias("dates"), F.count_distinct("asset").alias("assets")).first()
    return {"first": str(r["first"]), "last": str(r["last"]), "dates": r["dates"], "assets": r["assets"]}


#: The same panels as DuckDB tables: `panel` and `rets`.
_GRID = """
calendar AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos FROM (SELECT DISTINCT d FROM cells)),
panel AS (SELECT c.d, c.pos, a.asset, px, volume FROM calendar c CROSS JOIN (SELECT DISTINCT asset FROM cells) a LEFT JOIN cells USING (d, asset)),
rets AS (SELECT *, px / nullif(lag(px) OVER (PARTITION BY asset ORDER BY pos), 0) - 1 AS ret FROM panel)
"""
_PRICED = """CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS px,
  CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS volume"""
SUPPLIER_MONTH_SQL = f"cells AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_suppkey AS asset, {_PRICED} FROM lineitem GROUP BY 1, 2), {_GRID}"
BRAND_WEEK_SQL = f"cells AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS d, p_brand AS asset, {_PRICED} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), {_GRID}"
USER_DAY_SQL = f"cells AS (SELECT CAST(ts AS DATE) AS d, user_id AS asset, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) / count(value) AS px, CAST(count(value) AS DOUBLE) AS volume FROM events GROUP BY 1, 2), {_GRID}"
SUPPLIER_SECTORS_SQL = "sectors AS (SELECT s_suppkey AS asset, coalesce(r_name, 'other') AS sector FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"
BRAND_SECTORS_SQL = "sectors AS (SELECT DISTINCT p_brand AS asset, regexp_extract(p_brand, '#([0-9])', 1) AS sector FROM part)"
HOLDERS_SQL = "holders AS (SELECT DISTINCT year(o_orderdate) AS snapshot, make_date(year(o_orderdate) + 1, 2, 15) AS public, o_custkey AS holder, p_brand AS asset FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
