"""What comes later changes nothing that came before."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.operators import features as FE
from crossgrain.operators import graphs as G
from crossgrain.operators import neighbours as N
from crossgrain.operators import splits as S
from crossgrain.operators import synthetic as Y
from crossgrain.operators import universe as U
from crossgrain.sources import panels as P


@pytest.fixture(scope="module")
def panel(spark):
    return P.with_returns(Y.to_panel(spark, Y.factor_market(140, 8, 2, seed=1))).cache()


def corrupted(panel, after):
    return P.with_returns(panel.drop("ret").withColumn("px", F.when(F.col("pos") > after, F.col("px") * 3 + F.col("pos")).otherwise(F.col("px"))))


def test_features_do_not_see_the_future(panel):
    def at(p):
        return sorted(map(tuple, FE.base_features(p, beta_rows=40).where("pos = 90").drop("mkt_ret").collect()))

    assert at(panel) == at(corrupted(panel, 90))


def test_graph_does_not_see_the_future(spark, panel):
    at = spark.createDataFrame([(dt.date(2014, 6, 1), 90)], "as_of date, as_of_pos int")
    edges = lambda p: sorted(map(tuple, G.correlation_knn(p, at, 40, 3).collect()))
    assert edges(panel) == edges(corrupted(panel, 90)) and len(edges(panel)) == 24


def test_labels_end_with_the_calendar(panel):
    df = panel.select("pos", FE.forward_return(5).alias("r"), FE.forward_log_vol(5).alias("v"))
    assert df.where("pos >= 135 AND (r IS NOT NULL OR v IS NOT NULL)").count() == 0
    assert df.where("pos < 135 AND (r IS NULL OR v IS NULL)").count() == 0


def test_missing_window_compounds_to_zero(spark):
    p = spark.createDataFrame([(0, "a", None), (1, "a", None), (2, "a", 0.1)], "pos int, asset string, ret double")
    got = [r["t"] for r in p.select("pos", FE.trailing_return(2).alias("t")).orderBy("pos").collect()]
    assert got[:2] == [0.0, 0.0] and got[2] == pytest.approx(0.1)


def test_purge_and_embargo(spark):
    days = spark.createDataFrame([(i, dt.date(2015, 1, 1) + dt.timedelta(days=i)) for i in range(400)], "pos int, d date")
    for expanding in (True, False):
        rows = S.purged_walk_forward(days, 21, 63, 5, 150, expanding=expanding).collect()
        for fold in {r["fold_id"] for r in rows}:
            train = [r["pos"] for r in rows if r["fold_id"] == fold and r["role"] == "train"]
            test = [r["pos"] for r in rows if r["fold_id"] == fold and r["role"] == "test"]
            assert max(train) + 21 < min(test) - 5 and len(test) == 63
            assert expanding or min(train) == min(test) - 150
    assert S.purged_walk_forward(days.limit(50), 21, 63, 5, 150).count() == 0
    with pytest.raises(ValueError):
        S.purged_walk_forward(days, 21, 0)
    with pytest.raises(ValueError):
        S.require_increasing([1, 3, 2])


def test_snapshot_is_inclusive_and_empty_before_the_first(spark):
    days = spark.createDataFrame([(dt.date(2013, 6, 1),), (dt.date(2016, 6, 1),), (dt.date(2020, 2, 15),)], "d date")
    public = spark.createDataFrame([(dt.date(2014, 2, 15),), (dt.date(2020, 2, 15),)], "public date")
    got = {r["d"].year: r["as_of"] for r in G.asof_snapshot(days, public).collect()}
    assert got == {2013: None, 2016: dt.date(2014, 2, 15), 2020: dt.date(2020, 2, 15)}


def test_rewiring_keeps_degrees(spark, panel):
    at = spark.createDataFrame([(dt.date(2014, 6, 1), 90)], "as_of date, as_of_pos int")
    edges = G.correlation_knn(panel, at, 40, 3)
    new = G.degree_preserving_rewire(edges, 3)
    count = lambda e, side: sorted(map(tuple, e.groupBy(side).count().collect()))
    assert count(edges, "src") == count(new, "src") and count(edges, "dst") == count(new, "dst")
    assert new.where("src = dst").count() == 0 and new.select("src", "dst").distinct().count() == 24
    assert sorted(map(tuple, new.collect())) != sorted(map(tuple, edges.collect()))


def test_neighbour_policies(spark):
    e = spark.createDataFrame([(1, "A", "B", 3.0), (1, "A", "C", 1.0), (1, "D", "E", 1.0)], "as_of int, src string, dst string, weight double")
    v = spark.createDataFrame([(1, "B", 0.02), (1, "C", 0.04), (1, "E", None)], "as_of int, asset string, v double")
    get = lambda f: {r["asset"]: r["nbr"] for r in f(e, v, "v").collect()}
    assert get(N.neighbour_mean)["A"] == pytest.approx(0.03)
    assert get(N.weighted_neighbour_mean)["A"] == pytest.approx(0.025) and get(N.weighted_neighbour_mean)["D"] is None
    assert "D" not in get(N.present_neighbour_mean)


def test_edges_from_pairs(spark):
    links = spark.createDataFrame([(1, "A", "N", 0.5), (1, "M", "N", 0.8), (1, "A", "Z", 1.0), (1, "A", "N", None), (1, "A", "A", 2.0)], "as_of int, src string, dst string, weight double")
    nodes = spark.createDataFrame([(1, x) for x in "AMN"], "as_of int, asset string")
    got = {(r["src"], r["dst"]): r["weight"] for r in G.edges_from_pairs(links, nodes).collect()}
    assert got == {("A", "N"): 1.0, ("M", "N"): 0.8}
    both = G.edges_from_pairs(links, nodes, symmetric=True)
    assert both.count() == 4 and G.symmetrize(both).count() == 4


def test_membership(spark):
    grid = spark.createDataFrame([(dt.date(y, 7, 1), a) for y in (2015, 2017, 2019, 2021) for a in ("X", "Y")], "d date, asset string")
    log = spark.createDataFrame([(dt.date(2016, 1, 1), "X", "add"), (dt.date(2018, 1, 1), "X", "remove"), (dt.date(2020, 1, 1), "X", "add")], "date date, asset string, action string")
    replay = {(r["asset"], r["d"].year): r["member"] for r in U.membership_replay(grid, log).collect()}
    assert [replay["X", y] for y in (2015, 2017, 2019, 2021)] == [False, True, False, True] and not replay["Y", 2021]
    latest = {(r["asset"], r["d"].year): r["member"] for r in U.membership_latest_add(grid, log).collect()}
    assert [latest["X", y] for y in (2015, 2017, 2019, 2021)] == [False, False, False, True] and latest["Y", 2015]


def test_filing_dates_and_amendments(spark):
    df = spark.createDataFrame([("14-FEB-2020",), ("14-feb-2020",), ("2020-02-14",), ("14-XXX-2020",), ("junk",), (None,), ("31-FEB-2020",)], "t string")
    got = [r["p"] for r in df.select(U.filing_date(F.col("t")).alias("p")).collect()]
    assert got == [dt.date(2020, 2, 14)] * 2 + [None] * 5
    info = spark.createDataFrame([("1", "c1", "SH", None), ("2", "c1", "SH", ""), ("3", "c1", "SH", "PUT"), ("4", "zz", "SH", "")], "ACCESSION_NUMBER string, CUSIP string, SSHPRNAMTTYPE string, PUTCALL string")
    subs = spark.createDataFrame([("1", "14-FEB-2020", "13F-HR", "a", "31-DEC-2019"), ("2", "14-FEB-2020", "13F-HR/A", "b", "31-DEC-2019"), ("3", "14-FEB-2020", "13F-HR", "c", "31-DEC-2019"), ("4", "14-FEB-2020", "13F-HR", "d", "31-DEC-2019")], "ACCESSION_NUMBER string, FILING_DATE string, SUBMISSIONTYPE string, CIK string, PERIODOFREPORT string")
    names = spark.createDataFrame([("c1", "AAA")], "cusip string, asset string")
    assert [tuple(r) for r in U.filings_holders(info, subs, names, "2019-12-31", "2020-02-15").collect()] == [("a", "AAA")]
    with pytest.raises(ValueError):
        U.filings_holders(info, subs, names, "2019-12-31", "2020-02-01")


def test_content_hash_ignores_order_and_sees_changes(spark, panel):
    a, b = U.content_hash(panel).first(), U.content_hash(panel.orderBy(F.desc("px"))).first()
    changed = U.content_hash(panel.withColumn("px", F.when((F.col("pos") == 3) & (F.col("asset") == "A001"), F.col("px") + 0.01).otherwise(F.col("px")))).first()
    assert a == b != changed


def test_tranches_do_not_see_the_future(panel):
    from crossgrain.operators.portfolio import tranche_returns

    first = lambda p: sorted(map(tuple, tranche_returns(p, 5, 3, 0.25).where("pos <= 90").collect()))
    assert first(panel) == first(corrupted(panel, 90)) and np.isfinite([r[2] for r in first(panel)]).all()


def test_change_events_and_sectors(spark):
    table = spark.createDataFrame([("2020-01-02", "AAA", None), ("2020-02-03", " BBB ", "CCC"), (None, "DDD", "EEE"), ("2020-03-04", "", "FFF")], "day string, up string, down string")
    got = sorted(map(tuple, U.change_events(table, "day", "up", "down").collect()))
    assert got == [(dt.date(2020, 1, 2), "AAA", "add"), (dt.date(2020, 2, 3), "BBB", "add"), (dt.date(2020, 2, 3), "CCC", "remove"), (dt.date(2020, 3, 4), "FFF", "remove")]
    assert sorted(map(tuple, U.static_sectors(spark, ["B", "A", "B"], {"A": "tech"}).collect())) == [("A", "tech"), ("B", "other")]


def test_stored_market_manifest_and_format(spark, panel, tmp_path):
    from crossgrain.functions.format import formatted

    panel.where("NOT (pos = 5 AND asset = 'A001')").select("d", "asset", "px", "volume").write.parquet(f"{tmp_path}/m")
    back = P.read_market(spark, f"{tmp_path}/m")
    assert back.count() == panel.count() and back.where("px IS NULL").count() == 1
    assert P.manifest(back) == P.manifest(panel) and P.manifest(back)["assets"] == 8
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        P.read_market(spark, f"{tmp_path}/none")
    row = formatted(spark.createDataFrame([("a", 1.23456, 1.5e-7, None)], "k string, x double, ci double, z double"), ("ci",)).first()
    assert tuple(row) == ("a", "1.2346", "1.500e-07", "-")


def test_delisting_without_a_price_or_a_date_changes_nothing(spark, panel):
    plain = panel.select("d", "pos", "asset", "px")
    late = spark.createDataFrame([("A001", dt.date(2030, 1, 1), -0.5), ("ZZZ", dt.date(2014, 2, 1), -0.5)], "asset string, date date, final_return double")
    assert U.apply_delistings(plain, late).exceptAll(plain.select("asset", "d", "pos", "px")).count() == 0


def test_frozen_graph_knows_the_first_date_only(spark, panel):
    at = spark.createDataFrame([(dt.date(2014, 5, 1), 60), (dt.date(2014, 6, 1), 90)], "as_of date, as_of_pos int")
    edges = lambda p: sorted(map(tuple, G.make_graph("frozen", p, at, k=3).collect()))
    assert edges(panel) == edges(corrupted(panel, 60)) and len(edges(panel)) == 48
    assert {e[1:] for e in edges(panel) if e[0].month == 5} == {e[1:] for e in edges(panel) if e[0].month == 6}
    with pytest.raises(ValueError):
        G.make_graph("nope", panel, at)


def test_filing_tables_read_as_text(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("ACC\tCUSIP\tPUTCALL\n1\t007\t\n2\tNA\tPut\n")
    got = U.read_filing_table(spark, f"{tmp_path}/t.tsv", ["CUSIP", "PUTCALL"]).collect()
    assert [tuple(r) for r in got] == [("007", None), ("NA", "Put")]


def test_train_validation_gap(spark):
    train, valid = S.train_validation(spark.range(10).withColumnRenamed("id", "pos"), 10, 0.8, 2)
    assert [r[0] for r in train.collect()] == [0, 1, 2, 3, 4, 5] and [r[0] for r in valid.collect()] == [8, 9]
    assert S.purge_steps(5, 1) == 5 and S.purge_steps(5, 21) == 1 and S.purge_steps(5, 5, 3) == 3


def test_market_loading_is_loud(spark, tmp_path):
    from crossgrain.operators import synthetic as Y
    from crossgrain.operators import universe as U
    from crossgrain.sources import panels as P

    with pytest.raises(FileNotFoundError):
        P.load_market(spark, f"{tmp_path}/none")
    panel, market, made = P.load_market(spark, f"{tmp_path}/none", allow_synthetic=True, benchmark="A000")
    assert made and panel.where("asset = 'A000'").count() == 0 and market.columns == ["d", "mkt_ret"]
    calls = []

    def make():
        calls.append(1)
        return Y.to_panel(spark, Y.noise_market(30, 4))

    one, two = (P.cached_market(spark, str(tmp_path), "key", make) for _ in range(2))
    assert calls == [1] and one.count() == two.count() == 120 and P.load_market(spark, f"{tmp_path}/key.parquet")[2] is False
    known = P.manifest(one) | {"digest": U.content_hash(one).first()["digest"]}
    assert U.verify(two, known) == [] and len(U.verify(two.where("asset <> 'A001'"), known)) == 2


def test_dimension_tables(spark, tmp_path):
    from crossgrain.operators import universe as U

    (tmp_path / "map.csv").write_text("ticker,cusip\nAAA,001\nBBB,002\n")
    (tmp_path / "bad.csv").write_text("ticker,cusip\nAAA,001\nBBB,001\n")
    (tmp_path / "universe.csv").write_text("asset,sector\nB,Energy\nA,\nB,Other\nC,Tech\n")
    assert {tuple(r) for r in U.identifier_map(spark, f"{tmp_path}/map.csv").collect()} == {("001", "AAA"), ("002", "BBB")}
    with pytest.raises(ValueError):
        U.identifier_map(spark, f"{tmp_path}/bad.csv")
    assert [tuple(r) for r in U.read_universe(spark, f"{tmp_path}/universe.csv").orderBy("place").collect()] == [("B", "Energy", 0), ("A", "other", 1), ("C", "Tech", 2)]
    assert U.ordered_universe(["B", "A"], ["A", "C"]) == ["B", "A", "C"]
    assert U.snapshot_table(spark, [("2020-12-31", "2021-02-15")]).count() == 1
    with pytest.raises(ValueError):
        U.snapshot_table(spark, [("2020-12-31", "2020-11-15")])
