"""Registered queries of graphs, neighbour aggregates, universes, splits and model parts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgrain.functions import cross_section as X
from crossgrain.functions import inference as I
from crossgrain.operators import features as FE
from crossgrain.operators import graphs as G
from crossgrain.operators import models as M
from crossgrain.operators import neighbours as N
from crossgrain.operators import soft_ranks as SR
from crossgrain.operators import splits as S
from crossgrain.operators import universe as U
from crossgrain.plans.catalog import register
from crossgrain.plans.panel_queries import BW, SM, W_ASSET, months, rounded, weeks
from crossgrain.sources import panels as P

#: Graphs are made as of every twentieth week that has sixty before it, to the end of the calendar.
ASOF = "pos >= 60 AND pos % 20 = 0"
ASOFS_SQL = f"asofs AS (SELECT d AS as_of, pos AS as_of_pos FROM calendar WHERE {ASOF}), nodes AS (SELECT as_of, asset FROM asofs CROSS JOIN (SELECT DISTINCT asset FROM panel))"


def asofs(panel):
    return P.calendar(panel).where(ASOF).select(F.col("d").alias("as_of"), F.col("pos").alias("as_of_pos"))


def nodes(panel):
    return panel.where(ASOF).select(F.col("d").alias("as_of"), "asset")


CORR_SQL = f"""{BW}, {ASOFS_SQL}, win AS (SELECT as_of, pos, asset, ret FROM asofs JOIN rets ON pos BETWEEN as_of_pos - 59 AND as_of_pos WHERE ret IS NOT NULL),
corrs AS (SELECT a.as_of, a.asset AS src, b.asset AS dst, covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0) AS corr FROM win a JOIN win b ON a.as_of = b.as_of AND a.pos = b.pos AND a.asset <> b.asset GROUP BY 1, 2, 3 HAVING count(*) >= 15),
knn AS (SELECT as_of, src, dst, corr AS weight FROM (SELECT *, row_number() OVER (PARTITION BY as_of, src ORDER BY round(abs(corr), 12) DESC, dst) AS rn FROM corrs WHERE corr IS NOT NULL) WHERE rn <= 10)"""
SEC_SQL = f"""{P.BRAND_SECTORS_SQL}, sec_all AS (SELECT a.as_of, a.asset AS src, b.asset AS dst FROM nodes a JOIN sectors s ON a.asset = s.asset JOIN nodes b ON a.as_of = b.as_of JOIN sectors t ON b.asset = t.asset AND s.sector = t.sector WHERE a.asset <> b.asset),
sec AS (SELECT as_of, src, dst, 1.0 :: DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY as_of, src ORDER BY md5('0|' || src || '|' || dst), dst) AS rn FROM sec_all) WHERE rn <= 3)"""
EDGE = "as_of, src, dst, round(weight, 6) + 0.0 AS weight"


def knn(spark, sf_dir):
    p = weeks(spark, sf_dir)
    return G.correlation_knn(p, asofs(p))


@register("graph_corr_knn", f"WITH {CORR_SQL} SELECT {EDGE} FROM knn")
def graph_corr_knn(spark, sf_dir):
    return rounded(knn(spark, sf_dir))


#: Covariances shrunk towards a multiple of the identity, on the dates at which every asset has a return; raw correlations less a fifth where those are too few.
LW_SQL = f"""{CORR_SQL}, allw AS (SELECT as_of, pos, asset, ret FROM asofs JOIN rets ON pos BETWEEN as_of_pos - 59 AND as_of_pos),
cw AS (SELECT as_of, pos FROM allw GROUP BY 1, 2 HAVING count(ret) = (SELECT count(DISTINCT asset) FROM panel)),
cx AS (SELECT as_of, pos, asset, ret - avg(ret) OVER (PARTITION BY as_of, asset) AS x FROM allw JOIN cw USING (as_of, pos)),
cs AS (SELECT a.as_of, a.asset AS i, b.asset AS j, avg(a.x * b.x) AS s, count(*) AS t FROM cx a JOIN cx b ON a.as_of = b.as_of AND a.pos = b.pos GROUP BY 1, 2, 3),
cq AS (SELECT as_of, avg(q * q) AS q4 FROM (SELECT as_of, pos, sum(x * x) AS q FROM cx GROUP BY 1, 2) GROUP BY 1),
cd AS (SELECT as_of, avg(CASE WHEN i = j THEN s END) AS mu, count(CASE WHEN i = j THEN 1 END) AS n, sum(s * s) AS ss, max(t) AS t FROM cs GROUP BY 1),
dl AS (SELECT as_of, mu, coalesce(least((q4 - ss) / t, ss - n * mu * mu) / nullif(ss - n * mu * mu, 0), 0) AS delta FROM cd JOIN cq USING (as_of) WHERE t >= greatest(5, floor(n / 2))),
cv AS (SELECT as_of, i, s AS v FROM cs WHERE i = j),
lwc AS (SELECT c.as_of, c.i AS src, c.j AS dst, (1 - delta) * s / nullif(sqrt((delta * mu + (1 - delta) * vi.v) * (delta * mu + (1 - delta) * vj.v)), 0) AS corr FROM cs c JOIN dl ON dl.as_of = c.as_of JOIN cv vi ON vi.as_of = c.as_of AND vi.i = c.i JOIN cv vj ON vj.as_of = c.as_of AND vj.i = c.j WHERE c.i <> c.j
UNION ALL SELECT as_of, src, dst, 0.8 * coalesce(corr, 0) FROM corrs WHERE as_of NOT IN (SELECT as_of FROM dl)),
lwk AS (SELECT as_of, src, dst, corr AS weight FROM (SELECT *, row_number() OVER (PARTITION BY as_of, src ORDER BY round(abs(corr), 12) DESC, dst) AS rn FROM lwc WHERE corr IS NOT NULL) WHERE rn <= 10)"""


@register("graph_corr_shrunk", f"WITH {LW_SQL} SELECT {EDGE} FROM lwk")
def graph_corr_shrunk(spark, sf_dir):
    p = weeks(spark, sf_dir)
    return rounded(G.correlation_knn(p, asofs(p), shrinkage="lw"))


@register("graph_sector", f"WITH {BW}, {ASOFS_SQL}, {SEC_SQL} SELECT as_of, src, dst, 1.0 :: DOUBLE AS weight FROM sec_all")
def graph_sector(spark, sf_dir):
    return G.sector_graph(nodes(weeks(spark, sf_dir)), P.brand_sectors(spark, sf_dir))


def capped_sector(spark, sf_dir):
    return G.sector_graph(nodes(weeks(spark, sf_dir)), P.brand_sectors(spark, sf_dir), 3)


@register("graph_sector_capped", f"WITH {BW}, {ASOFS_SQL}, {SEC_SQL} SELECT * FROM sec")
def graph_sector_capped(spark, sf_dir):
    return capped_sector(spark, sf_dir)


@register("graph_random_hash", f"""WITH {BW}, {ASOFS_SQL} SELECT as_of, src, dst, 1.0 :: DOUBLE AS weight FROM (
SELECT a.as_of, a.asset AS src, b.asset AS dst, row_number() OVER (PARTITION BY a.as_of, a.asset ORDER BY md5('7|' || a.asset || '|' || b.asset), b.asset) AS rn FROM nodes a JOIN nodes b ON a.as_of = b.as_of AND a.asset <> b.asset) WHERE rn <= 4""")
def graph_random_hash(spark, sf_dir):
    return G.random_graph(nodes(weeks(spark, sf_dir)), 4, 7)


@register("graph_matched_degree", f"WITH {CORR_SQL} SELECT as_of, CAST(round_even(count(*) / 25.0, 0) AS INT) AS degree FROM knn GROUP BY as_of")
def graph_matched_degree(spark, sf_dir):
    return G.matched_degree(knn(spark, sf_dir), nodes(weeks(spark, sf_dir)))


SYM_SQL = "sym AS (SELECT as_of, src, dst, arg_min(weight, p) AS weight FROM (SELECT *, 0 AS p FROM knn UNION ALL SELECT as_of, dst, src, weight, 1 FROM knn) GROUP BY 1, 2, 3)"


@register("graph_symmetrize", f"WITH {CORR_SQL}, {SYM_SQL} SELECT {EDGE} FROM sym")
def graph_symmetrize(spark, sf_dir):
    return rounded(G.symmetrize(knn(spark, sf_dir)))


@register("graph_self_loops", f"WITH {CORR_SQL} SELECT {EDGE} FROM knn UNION ALL SELECT as_of, asset, asset, 1.0 FROM nodes")
def graph_self_loops(spark, sf_dir):
    return rounded(G.add_self_loops(knn(spark, sf_dir), nodes(weeks(spark, sf_dir))))


@register("graph_union_both", f"WITH {CORR_SQL}, {SEC_SQL} SELECT as_of, src, dst, round(arg_min(weight, p), 6) + 0.0 AS weight FROM (SELECT *, 0 AS p FROM knn UNION ALL SELECT *, 1 FROM sec) GROUP BY 1, 2, 3")
def graph_union_both(spark, sf_dir):
    return rounded(G.union_first_wins(knn(spark, sf_dir), capped_sector(spark, sf_dir)))


@register("graph_degrees", f"""WITH {CORR_SQL} SELECT n.as_of, n.asset, (SELECT count(*) FROM knn k WHERE k.as_of = n.as_of AND k.dst = n.asset) AS in_degree,
(SELECT count(*) FROM knn k WHERE k.as_of = n.as_of AND k.src = n.asset) AS out_degree FROM nodes n""")
def graph_degrees(spark, sf_dir):
    return G.degrees(knn(spark, sf_dir), nodes(weeks(spark, sf_dir)))


@register("graph_dense_adjacency", f"WITH {CORR_SQL} SELECT DISTINCT as_of, least(src, dst) AS i, greatest(src, dst) AS j FROM knn")
def graph_dense_adjacency(spark, sf_dir):
    return G.dense_adjacency(knn(spark, sf_dir))


#: Brands that one order holds together, with the number of times as weight: a link table with repeats and strangers.
LINKS_SQL = "links AS (SELECT CAST('1998-01-01' AS DATE) AS as_of, a.p_brand AS src, b.p_brand AS dst, CASE WHEN x.l_quantity >= 10 THEN x.l_quantity END AS weight FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber JOIN part a ON x.l_partkey = a.p_partkey JOIN part b ON y.l_partkey = b.p_partkey), known AS (SELECT DISTINCT CAST('1998-01-01' AS DATE) AS as_of, p_brand AS asset FROM part WHERE p_brand < 'Brand#45')"


@register("graph_from_pairs_max", f"WITH {LINKS_SQL}, l AS (SELECT as_of, src, dst, coalesce(weight, 1.0) AS weight FROM links WHERE src <> dst AND src IN (SELECT asset FROM known) AND dst IN (SELECT asset FROM known)) SELECT as_of, src, dst, max(weight) AS weight FROM (SELECT * FROM l UNION ALL SELECT as_of, dst, src, weight FROM l) GROUP BY 1, 2, 3")
def graph_from_pairs_max(spark, sf_dir):
    li, part = P.table(spark, sf_dir, "lineitem"), P.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    of = li.join(part, li["l_partkey"] == part["p_partkey"]).select("l_orderkey", "l_linenumber", "l_quantity", "p_brand")
    a, b = of.toDF("o", "n", "q", "src"), of.select("l_orderkey", "l_linenumber", "p_brand").toDF("o", "m", "dst")
    as_of = F.lit("1998-01-01").cast("date").alias("as_of")
    links = a.join(b, "o").where("n < m").select(as_of, "src", "dst", F.when(F.col("q") >= 10, F.col("q")).alias("weight"))
    known = part.where("p_brand < 'Brand#45'").select(as_of, F.col("p_brand").alias("asset")).distinct()
    return G.edges_from_pairs(links, known, symmetric=True)


COH_SQL = f"""{P.HOLDERS_SQL}, sizes AS (SELECT snapshot, asset, count(*) AS n FROM holders GROUP BY 1, 2),
common AS (SELECT a.snapshot, a.asset AS src, b.asset AS dst, count(*) AS common FROM holders a JOIN holders b ON a.snapshot = b.snapshot AND a.holder = b.holder AND a.asset <> b.asset GROUP BY 1, 2, 3),
cosines AS (SELECT c.snapshot AS as_of, src, dst, common, common / sqrt(s.n * t.n) AS cosine FROM common c JOIN sizes s ON s.snapshot = c.snapshot AND s.asset = src JOIN sizes t ON t.snapshot = c.snapshot AND t.asset = dst),
coh AS (SELECT as_of, src, dst, cosine AS weight FROM (SELECT *, row_number() OVER (PARTITION BY as_of, src ORDER BY round(cosine, 12) DESC, dst) AS rn FROM cosines WHERE common >= 5) WHERE rn <= 10)"""


def holdings(spark, sf_dir):
    return P.holders(spark, sf_dir).select(F.col("snapshot").alias("as_of"), "holder", "asset")


@register("coholding_counts", f"WITH {COH_SQL} SELECT as_of, src, dst, common, round(cosine, 6) AS cosine FROM cosines")
def coholding_counts(spark, sf_dir):
    return rounded(G.coholding_pairs(holdings(spark, sf_dir)))


@register("coholding_cosine_topk", f"WITH {COH_SQL} SELECT {EDGE} FROM coh")
def coholding_cosine_topk(spark, sf_dir):
    return rounded(G.coholding_links(holdings(spark, sf_dir)))


@register("coholding_coverage", f"WITH {P.HOLDERS_SQL} SELECT snapshot, count(DISTINCT asset) AS covered, count(DISTINCT holder) AS holders FROM holders GROUP BY 1")
def coholding_coverage(spark, sf_dir):
    return P.holders(spark, sf_dir).groupBy("snapshot").agg(F.count_distinct("asset").alias("covered"), F.count_distinct("holder").alias("holders"))


@register("coholding_asof", f"WITH {SM}, {P.HOLDERS_SQL} SELECT d, (SELECT max(public) FROM holders WHERE public <= d) AS as_of FROM calendar")
def coholding_asof(spark, sf_dir):
    return G.asof_snapshot(P.calendar(P.supplier_month(spark, sf_dir)).select("d"), P.holders(spark, sf_dir).select("public"))


@register("embedding_knn", """WITH e AS (SELECT vec_id, embedding :: DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS src, e.vec_id AS dst, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) AS cosine FROM q, e WHERE q.vec_id <> e.vec_id)
SELECT src, dst, round(cosine, 6) + 0.0 AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(cosine, 12) DESC, dst) AS rn FROM p) WHERE rn <= 5""")
def embedding_knn(spark, sf_dir):
    """The five nearest vectors, by cosine, of every vector whose id is divisible by 20, against all."""
    e = P.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = e.withColumn("nn", dot("v", "v"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("src"), F.col("v").alias("qv"), F.col("nn").alias("qn"))
    pairs = e.join(q, e["vec_id"] != F.col("src")).select("src", F.col("vec_id").alias("dst"), F.try_divide(dot("v", "qv"), F.sqrt(F.col("nn") * F.col("qn"))).alias("cosine"))
    rn = F.row_number().over(W.partitionBy("src").orderBy(F.desc(F.round("cosine", 12)), "dst"))
    return rounded(pairs.withColumn("rn", rn).where("rn <= 5").drop("rn"))


TR_SQL = f"tr AS (SELECT d AS as_of, asset, coalesce(product(1 + ret) OVER {W_ASSET} ROWS 4 PRECEDING), 1) - 1 AS v FROM rets)"


def trailing_at(panel, rows=5):
    return panel.select(F.col("d").alias("as_of"), "pos", "asset", FE.trailing_return(rows).alias("v")).where(ASOF)


@register("nbr_return", f"WITH {CORR_SQL}, {TR_SQL} SELECT k.as_of, src AS asset, round(avg(v), 6) + 0.0 AS nbr FROM knn k JOIN tr ON tr.as_of = k.as_of AND tr.asset = dst GROUP BY 1, 2")
def nbr_return(spark, sf_dir):
    return rounded(N.neighbour_mean(knn(spark, sf_dir), trailing_at(weeks(spark, sf_dir)), "v"))


@register("leadlag_signal", f"WITH {CORR_SQL}, {TR_SQL} SELECT k.as_of, src AS asset, round(sum(abs(weight) * v) / nullif(sum(abs(weight)), 0), 6) + 0.0 AS nbr FROM knn k JOIN tr ON tr.as_of = k.as_of AND tr.asset = dst GROUP BY 1, 2")
def leadlag_signal(spark, sf_dir):
    return rounded(N.weighted_neighbour_mean(knn(spark, sf_dir), trailing_at(weeks(spark, sf_dir)), "v"))


@register("own_momentum", f"WITH {BW}, {TR_SQL} SELECT as_of, asset, round(v, 6) + 0.0 AS v FROM tr")
def own_momentum(spark, sf_dir):
    return rounded(weeks(spark, sf_dir).select(F.col("d").alias("as_of"), "asset", FE.trailing_return(5).alias("v")))


INNOV_SQL = f"tv AS (SELECT d AS as_of, asset, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS v FROM rets WINDOW w AS {W_ASSET} ROWS 19 PRECEDING)), innov AS (SELECT as_of, asset, v - lag(v, 5) OVER (PARTITION BY asset ORDER BY as_of) AS v FROM tv)"


@register("neighbour_vol_innovation", f"WITH {CORR_SQL}, {INNOV_SQL} SELECT k.as_of, src AS asset, round(sum(abs(weight) * v) / nullif(sum(abs(weight)), 0), 6) + 0.0 AS nbr FROM knn k JOIN innov i ON i.as_of = k.as_of AND i.asset = dst WHERE v IS NOT NULL GROUP BY 1, 2")
def neighbour_vol_innovation(spark, sf_dir):
    p = weeks(spark, sf_dir).withColumn("vol", FE.trailing_vol(20))
    innov = p.select(F.col("d").alias("as_of"), "asset", (F.col("vol") - F.lag("vol", 5).over(W.partitionBy("asset").orderBy("pos"))).alias("v"))
    return rounded(N.present_neighbour_mean(knn(spark, sf_dir), innov, "v"))


@register("residual_one", f"""WITH {BW}, {TR_SQL}, x AS (SELECT r.d, r.asset, r.ret AS y, tr.v AS x FROM rets r JOIN tr ON tr.as_of = r.d AND tr.asset = r.asset),
j AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS yy, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS xx FROM x),
s AS (SELECT *, count(yy) OVER w AS n, avg(yy) OVER w AS my, avg(xx) OVER w AS mx, coalesce(covar_pop(yy, xx) OVER w / nullif(var_pop(xx) OVER w, 0), 0) AS b FROM j WINDOW w AS (PARTITION BY d))
SELECT d, asset, round(CASE WHEN n < 3 THEN y ELSE yy - my - b * (xx - mx) END, 6) + 0.0 AS resid FROM s""")
def residual_one(spark, sf_dir):
    p = weeks(spark, sf_dir).select("d", "pos", "asset", "ret", FE.trailing_return(5).alias("x"))
    return rounded(p.select("d", "asset", FE.residual("ret", "x", "d").alias("resid")))


@register("residual_two", f"""WITH {BW}, x AS (SELECT d, asset, ret AS y, px / lag(px, 5) OVER w - 1 AS a, px / lag(px, 21) OVER w - 1 AS b FROM rets WINDOW w AS {W_ASSET})),
j AS (SELECT d, asset, y, a, b FROM x WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT d, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby FROM j GROUP BY d),
c AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ca, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS cb FROM s WHERE n >= 4)
SELECT x.d, x.asset, round(j.y - my - ca * (j.a - ma) - cb * (j.b - mb), 6) + 0.0 AS resid FROM x LEFT JOIN j USING (d, asset) LEFT JOIN c ON c.d = x.d""")
def residual_two(spark, sf_dir):
    p = weeks(spark, sf_dir).select("d", "asset", "ret", FE.performance(5).alias("a"), FE.performance(21).alias("b"))
    return rounded(p.select("d", "asset", FE.residual_of_two("ret", "a", "b", "d").alias("resid")))


#: Lead-lag over the latest co-holding snapshot that is public: neighbours' trailing return against the next return.
LL_SQL = f"""{SM.replace('l_suppkey AS asset', 'p_brand AS asset').replace('FROM lineitem GROUP BY 1, 2', 'FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2')}, {COH_SQL}, pub AS (SELECT d, pos, (SELECT max(snapshot) FROM holders WHERE public <= d) AS as_of FROM calendar),
tr AS (SELECT d, pos, asset, coalesce(product(1 + ret) OVER {W_ASSET} ROWS 2 PRECEDING), 1) - 1 AS v, lead(px) OVER {W_ASSET}) / px - 1 AS fwd FROM rets),
sig AS (SELECT p.d, src AS asset, sum(abs(weight) * v) / nullif(sum(abs(weight)), 0) AS sig FROM pub p JOIN coh c ON c.as_of = p.as_of JOIN tr ON tr.d = p.d AND tr.asset = dst GROUP BY 1, 2),
lr AS (SELECT sig.d, sig.asset, sig.sig, tr.v, tr.fwd FROM sig JOIN tr USING (d, asset)),
lv AS (SELECT *, CASE WHEN fwd IS NOT NULL THEN v END AS vv FROM lr),
rs AS (SELECT *, CASE WHEN count(fwd) OVER w < 3 THEN fwd ELSE fwd - avg(fwd) OVER w - coalesce(covar_pop(fwd, vv) OVER w / nullif(var_pop(vv) OVER w, 0), 0) * (vv - avg(vv) OVER w) END AS resid FROM lv WINDOW w AS (PARTITION BY d))"""


def leadlag_frame(spark, sf_dir):
    """d, asset, sig, v, fwd of brands by month."""
    parts = P.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    li = P.table(spark, sf_dir, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("date").alias("d"), "l_partkey", "l_extendedprice", "l_quantity")
    panel = P.with_returns(P.dense_grid(P._priced(li.join(parts, li["l_partkey"] == parts["p_partkey"]))))
    h = P.holders(spark, sf_dir)
    edges = G.coholding_links(h.select(F.col("snapshot").alias("as_of"), "holder", "asset"))
    shown = G.asof_snapshot(P.calendar(panel).select("d"), h.select("public")).where("as_of IS NOT NULL").select("d", (F.year("as_of") - 1).alias("snapshot"))
    dated = edges.join(F.broadcast(shown), edges["as_of"] == shown["snapshot"]).select(F.col("d").alias("as_of"), "src", "dst", "weight")
    tr = panel.select("d", "asset", FE.trailing_return(3).alias("v"), FE.forward_return(1).alias("fwd"))
    sig = N.weighted_neighbour_mean(dated, tr.withColumnRenamed("d", "as_of"), "v").select(F.col("as_of").alias("d"), "asset", F.col("nbr").alias("sig"))
    return sig.join(tr, ["d", "asset"])


@register("leadlag_resid_ic", f"WITH {LL_SQL}, {X.rank_ic_sql('rs', 'sig', 'resid')} SELECT d, round(ic, 6) + 0.0 AS ic, n FROM ic_series")
def leadlag_resid_ic(spark, sf_dir):
    """Own momentum is taken out of the forward return, not out of the signal."""
    df = leadlag_frame(spark, sf_dir).withColumn("resid", FE.residual("fwd", "v", "d"))
    return rounded(X.rank_ic(df, "sig", "resid", "d"))


#: Membership changes from orders: a supplier's first and last months of shipping.
CHANGES_SQL = "changes AS (SELECT CAST(min(l_shipdate) AS DATE) + 200 AS date, l_suppkey AS asset, 'add' AS action FROM lineitem GROUP BY 2 UNION ALL SELECT CAST(max(l_shipdate) AS DATE) - 200, l_suppkey, 'remove' FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 2)"


def changes(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("asset"), F.to_date("l_shipdate").alias("s"))
    add = li.groupBy("asset").agg(F.date_add(F.min("s"), 200).alias("date")).select("date", "asset", F.lit("add").alias("action"))
    gone = li.where("asset % 3 = 0").groupBy("asset").agg(F.date_sub(F.max("s"), 200).alias("date")).select("date", "asset", F.lit("remove").alias("action"))
    return add.unionByName(gone)


@register("membership_replay", f"WITH {SM}, {CHANGES_SQL} SELECT d, asset, coalesce((SELECT arg_max(action, (date, action)) FROM changes c WHERE c.asset = p.asset AND c.date <= p.d) = 'add', false) AS member FROM panel p")
def membership_replay(spark, sf_dir):
    return U.membership_replay(P.supplier_month(spark, sf_dir).select("d", "asset"), changes(spark, sf_dir))


@register("membership_latest_add", f"WITH {SM}, {CHANGES_SQL}, l AS (SELECT asset, max(date) AS since FROM changes WHERE action = 'add' GROUP BY 1) SELECT d, asset, coalesce(d >= since, true) AS member FROM panel LEFT JOIN l USING (asset)")
def membership_latest_add(spark, sf_dir):
    return U.membership_latest_add(P.supplier_month(spark, sf_dir).select("d", "asset"), changes(spark, sf_dir))


@register("delisting_patch", f"""WITH {SM}, {CHANGES_SQL}, dl AS (SELECT asset, date, CAST(-0.3 AS DOUBLE) AS final_return FROM changes WHERE action = 'remove'),
hit AS (SELECT p.asset, min(d) AS d, max(final_return) AS fr FROM panel p JOIN dl USING (asset) WHERE d >= date GROUP BY 1), last AS (SELECT asset, arg_max(px, pos) AS last_px FROM panel WHERE px IS NOT NULL GROUP BY 1)
SELECT p.d, p.asset, coalesce(last_px * (1 + fr), px) AS px FROM panel p LEFT JOIN hit ON hit.asset = p.asset AND hit.d = p.d LEFT JOIN last ON last.asset = hit.asset""")
def delisting_patch(spark, sf_dir):
    gone = changes(spark, sf_dir).where("action = 'remove'").select("asset", "date", F.lit(-0.3).alias("final_return"))
    return U.apply_delistings(P.supplier_month(spark, sf_dir), gone).select("d", "asset", "px")


@register("sec_date_parse", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0""")
def sec_date_parse(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    names = F.create_map(*[F.lit(x) for name, k in U.MONTHS.items() for x in (k, name)])
    text = F.concat_ws("-", F.lpad(F.dayofmonth("d").cast("string"), 2, "0"), F.element_at(names, F.month("d")), F.year("d").cast("string"))
    return o.select("o_orderkey", U.filing_date(F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("x"), text)).otherwise(text)).alias("parsed"))


@register("filings_holders", """SELECT DISTINCT o_custkey AS cik, p_brand AS asset FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE year(o_orderdate) = 1996 AND l_quantity >= 5 AND o_orderkey % 5 <> 0""")
def filings_holders(spark, sf_dir):
    """Orders of 1996 as filings: every fifth is an amendment, and small lines are options."""
    li, o = P.table(spark, sf_dir, "lineitem"), P.table(spark, sf_dir, "orders").where("year(o_orderdate) = 1996")
    info = li.select(F.col("l_orderkey").alias("ACCESSION_NUMBER"), F.col("l_partkey").alias("CUSIP"), F.lit("SH").alias("SSHPRNAMTTYPE"), F.when(F.col("l_quantity") < 5, "PUT").alias("PUTCALL"))
    subs = o.select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), F.lit("14-FEB-1997").alias("FILING_DATE"), F.when(F.col("o_orderkey") % 5 == 0, "13F-HR/A").otherwise("13F-HR").alias("SUBMISSIONTYPE"), F.col("o_custkey").alias("CIK"), F.lit("31-DEC-1996").alias("PERIODOFREPORT"))
    mapping = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cusip"), F.col("p_brand").alias("asset"))
    return U.filings_holders(info, subs, mapping, "1996-12-31", "1997-02-15")


@register("content_hash", f"""WITH {SM}, h AS (SELECT sha256(CAST(asset AS VARCHAR) || '|' || CAST(d AS VARCHAR) || '|' || coalesce(CAST(px AS BIGINT) :: VARCHAR, '')) AS h FROM panel)
SELECT CAST(sum(CAST('0x' || h[1:15] AS HUGEINT)) AS VARCHAR) AS digest, count(*) AS n FROM h""")
def content_hash(spark, sf_dir):
    """Of whole prices: both engines print those alike."""
    p = P.supplier_month(spark, sf_dir)
    row = F.sha2(F.concat_ws("|", F.col("asset").cast("string"), F.col("d").cast("string"), F.coalesce(F.bround("px", 0).cast("long").cast("string"), F.lit(""))), 256)
    return p.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("p")).agg(F.sum("p").cast("string").alias("digest"), F.count("*").alias("n"))


def _splits(expanding):
    def query(spark, sf_dir):
        return S.purged_walk_forward(P.calendar(P.brand_week(spark, sf_dir)), 5, 26, embargo=2, min_train=104, expanding=expanding)

    return query


for _name, _extra in (("expanding", ""), ("rolling", "AND pos >= test_start - 104")):
    register(f"splits_{_name}", f"""WITH {BW}, n AS (SELECT count(*) AS n FROM calendar), s AS (SELECT unnest(range(104, (SELECT n - 26 + 1 FROM n), 26)) AS test_start),
f AS (SELECT CAST((test_start - 104) / 26 AS INT) AS fold_id, test_start, pos, d, CASE WHEN pos >= test_start AND pos < test_start + 26 THEN 'test' WHEN pos + 5 < test_start - 2 {_extra} THEN 'train' END AS role FROM s, calendar)
SELECT fold_id, test_start, role, pos, d FROM f WHERE role IS NOT NULL""")(_splits(not _extra))


@register("purge_step_len", f"WITH {BW}, r AS (SELECT max(pos) AS pos FROM calendar GROUP BY date_trunc('month', d)), g AS (SELECT pos - lag(pos) OVER (ORDER BY pos) AS gap FROM r) SELECT CAST(floor(median(gap)) AS INT) AS step FROM g")
def purge_step_len(spark, sf_dir):
    return S.rebalance_step(FE.last_date_of(P.calendar(P.brand_week(spark, sf_dir)), "month"))


@register("soft_rank_loss", f"""WITH {SM}, x AS (SELECT d, asset, -ret AS p, lead(px) OVER {W_ASSET}) / px - 1 AS y FROM rets), ok AS (SELECT * FROM x WHERE p IS NOT NULL AND y IS NOT NULL),
r AS (SELECT a.d, a.asset, sum(1 / (1 + exp(-greatest(least((a.p - b.p) / 0.01, 700), -700)))) AS rp, sum(1 / (1 + exp(-greatest(least((a.y - b.y) / 0.01, 700), -700)))) AS ry FROM ok a JOIN ok b ON a.d = b.d GROUP BY 1, 2)
SELECT d, round(CASE WHEN count(*) < 3 THEN 0 ELSE 1 - covar_pop(rp, ry) / nullif(stddev_pop(rp) * stddev_pop(ry), 0) END, 6) + 0.0 AS loss, count(*) AS n FROM r GROUP BY d""")
def soft_rank_loss(spark, sf_dir):
    """The loss of the reversal signal against the next return, at every date."""
    x = months(spark, sf_dir).select("d", "asset", (-F.col("ret")).alias("p"), FE.forward_return(1).alias("y")).where("p IS NOT NULL AND y IS NOT NULL")
    return rounded(SR.soft_rank_losses(x, "p", "y", 0.01))


@register("sage_mean_aggregate", f"WITH {CORR_SQL}, {TR_SQL} SELECT n.as_of, n.asset, round(coalesce((SELECT avg(v) FROM knn k JOIN tr ON tr.as_of = k.as_of AND tr.asset = k.src WHERE k.as_of = n.as_of AND k.dst = n.asset), 0), 6) + 0.0 AS agg FROM nodes n")
def sage_mean_aggregate(spark, sf_dir):
    return rounded(N.message_mean(knn(spark, sf_dir), trailing_at(weeks(spark, sf_dir)), "v"))


@register("ridge_gram", f"""WITH {SM}, x AS (SELECT coalesce(px / lag(px) OVER w - 1, 0) AS a, coalesce(px / lag(px, 5) OVER w - 1, 0) AS b, lead(px) OVER w / px - 1 AS y FROM panel WINDOW w AS {W_ASSET}))
SELECT count(*) AS n, round(sum(y), 4) AS st, round(sum(a * y), 4) AS t_0, round(sum(b * y), 4) AS t_1, round(sum(a), 4) AS s_0, round(sum(b), 4) AS s_1, round(sum(a * a), 4) AS q_0_0, round(sum(a * b), 4) AS q_1_0, round(sum(b * b), 4) AS q_1_1 FROM x WHERE y IS NOT NULL""")
def ridge_gram(spark, sf_dir):
    p = months(spark, sf_dir).select(FE.performance(1).alias("a"), FE.performance(5).alias("b"), FE.forward_return(1).alias("y"))
    df = M.ridge_gram(p, ["a", "b"], "y")
    return df.select(*[F.round(c, 4).alias(c) if c != "n" else c for c in df.columns])
