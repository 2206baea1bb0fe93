"""Readers and sinks round-trip on small files derived from the driver tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skucast.schema import M5_ORIGIN
from skucast.sources import readers, sinks
from skucast.sources.tables import demand_panel
from tests.conftest import SF001

N_DAYS = 40


@pytest.fixture(scope="module")
def subset(spark):
    """Three series of the sf0.001 panel on a 40-day window, densified with zeros."""
    from skucast.operators.panel import densify
    p = demand_panel(spark, SF001).where(F.col("sku_id").isin("ECONOMY_1_001", "PROMO_2_001", "SMALL_3_001"))
    d0 = p.agg(F.min("date")).first()[0]
    win = p.where(F.col("date") < F.lit(d0 + dt.timedelta(days=N_DAYS)))
    grid = densify(win.select("sku_id", "store_id", "date", "sales"), ["sku_id", "store_id"])
    return grid.toPandas(), d0


def write_m5(tmp, pdf, d0):
    origin = dt.date.fromisoformat(M5_ORIGIN)
    pdf = pdf.copy()
    pdf["d"] = pdf["date"].map(lambda x: f"d_{(x - d0).days + 1}")
    wide = pdf.pivot_table(index=["sku_id", "store_id"], columns="d", values="sales", fill_value=0).reset_index()
    days = sorted([c for c in wide.columns if str(c).startswith("d_")], key=lambda c: int(c[2:]))
    wide = wide[["sku_id", "store_id", *days]].rename(columns={"sku_id": "item_id"})
    wide.insert(0, "id", wide["item_id"] + "_" + wide["store_id"] + "_evaluation")
    for c in ("dept_id", "cat_id", "state_id"):
        wide.insert(2, c, "x")
    wide[days] = wide[days].astype(int)
    wide.to_csv(tmp / "sales_train_evaluation.csv", index=False)
    cal = [{"date": origin + dt.timedelta(days=i), "wm_yr_wk": 11101 + i // 7,
            "snap_CA": int(i % 5 == 0), "snap_TX": int(i % 7 == 0)} for i in range(len(days))]
    import pandas as pd
    pd.DataFrame(cal).to_csv(tmp / "calendar.csv", index=False)
    prices = [{"store_id": s, "item_id": k, "wm_yr_wk": 11101, "sell_price": 3.5}
              for k, s in wide[["item_id", "store_id"]].drop_duplicates().itertuples(index=False)]
    pd.DataFrame(prices).to_csv(tmp / "sell_prices.csv", index=False)
    return days


def test_load_m5_roundtrip(spark, subset, tmp_path):
    pdf, d0 = subset
    days = write_m5(tmp_path, pdf, d0)
    out = readers.load_m5(spark, str(tmp_path), days=None)
    assert out.count() == len(pdf["sku_id"].map(str).str.cat(pdf["store_id"]).unique()) * len(days)
    assert abs(out.agg(F.sum("sales")).first()[0] - pdf["sales"].sum()) < 1e-9
    origin = dt.date.fromisoformat(M5_ORIGIN)
    r = out.where(F.col("date") == origin).first()
    assert r.promo == 1  # day index 0 is a snap day
    week1 = out.where(F.col("date") < F.lit(origin + dt.timedelta(days=7)))
    assert week1.where("price != 3.5").count() == 0
    assert out.where(F.col("date") >= F.lit(origin + dt.timedelta(days=7))).where("price != 2.0").count() == 0
    recent = readers.load_m5(spark, str(tmp_path), days=10)
    assert recent.select("date").distinct().count() == 10


def test_select_recent_days_rule(spark, subset, tmp_path):
    pdf, d0 = subset
    write_m5(tmp_path, pdf, d0)
    wide = readers.read_m5_wide(spark, str(tmp_path))
    kept = readers.day_columns(readers.select_recent_days(wide, 5))
    max_n = int(readers.day_columns(wide)[-1][2:])
    assert kept == [f"d_{n}" for n in range(max_n - 4, max_n + 1)]


def test_mapped_reader_and_defaults(spark, subset, tmp_path):
    pdf, _ = subset
    uci = pdf.rename(columns={"sales": "quantity"})[["date", "sku_id", "quantity"]].head(50)
    uci["unit_price"] = 4.25
    uci.to_csv(tmp_path / "uci_sample.csv", index=False)
    out = readers.load_panel(spark, "UCI", str(tmp_path))
    assert out.count() == 50
    assert out.where("store_id != 'S1' OR price != 4.25 OR promo != 0").count() == 0
    assert abs(out.agg(F.sum("sales")).first()[0] - uci["quantity"].sum()) < 1e-9


def test_favorita_reader(spark, subset, tmp_path):
    pdf, _ = subset
    fav = pdf.head(30).copy()
    fav = fav.assign(store_nbr=1, item_nbr=range(30), unit_sales=fav["sales"] - 5, onpromotion="True",
                     family="GROCERY")[["date", "store_nbr", "item_nbr", "unit_sales", "onpromotion", "family"]]
    fav.to_csv(tmp_path / "train.csv", index=False)
    out = readers.read_favorita(spark, str(tmp_path))
    assert out.where("sales < 0").count() == 0
    assert out.where("category != 'GROCERY' OR price != 1.0 OR promo != 1").count() == 0


def test_cache_and_drop(spark, tmp_path):
    p = demand_panel(spark, SF001)
    readers.cache_panel(p, str(tmp_path), "M5", 365)
    back = readers.read_cached(spark, str(tmp_path), "M5", 365, ["sku_id", "store_id", "date", "category"])
    assert back.count() == p.count() and back.columns == ["sku_id", "store_id", "date", "category"]
    assert readers.drop_cache(spark, str(tmp_path), "m5") == ["M5_365d"]
    assert readers.read_cached(spark, str(tmp_path), "M5", 365) is None


def test_reports_roundtrip(spark, tmp_path):
    m = spark.createDataFrame([(2.3579, 3.0816, 9.8381, 9.8609, 9.9055, 2827)],
                              "MAE double, RMSE double, MAPE double, WMAPE double, SMAPE double, n_obs long")
    sinks.write_report(m, str(tmp_path / "reports"), "M5", "GBT")
    a = spark.createDataFrame([(9.4059, 11.6794, 19.47, 3)],
                              "avg_WMAPE double, baseline_WMAPE double, improvement_pct double, n_skus long")
    sinks.write_report(a, str(tmp_path / "reports"), "M5", "SeasonalAR")
    t = readers.read_reports(spark, str(tmp_path / "reports"), "m5")
    got = {r.model: r.headline_WMAPE for r in t.collect()}
    assert got == {"GBT": 9.8609, "SeasonalAR": 9.4059}
    assert readers.report(spark, str(tmp_path / "reports"), "M5", "gbt").first().n_obs == 2827
    with pytest.raises(LookupError):
        readers.report(spark, str(tmp_path / "reports"), "M5", "missing")


def test_forecast_and_log_sinks(spark, tmp_path):
    from skucast.operators.forecast import forecast_all
    from skucast.operators.panel import daily_series, densify
    fc = forecast_all(densify(daily_series(demand_panel(spark, SF001))), 7, ("trend_naive",))
    sinks.write_forecast(fc, str(tmp_path / "fc"), "M5")
    assert spark.read.parquet(str(tmp_path / "fc")).count() == fc.count()
    sinks.write_run_log(spark.createDataFrame([("retrain", True)], "step string, ok boolean"), str(tmp_path / "log"))
    sinks.write_run_log(spark.createDataFrame([("drift", False)], "step string, ok boolean"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_m5_sample_fallback_and_dispatch(spark, subset, tmp_path):
    """Without the wide file, load_m5 reads m5_sample.csv (renames, defaults, clean target)."""
    pdf, _ = subset
    smp = pdf.head(40).rename(columns={"sku_id": "item_id"}).copy()
    smp["sales"] = smp["sales"].astype(str)
    smp.loc[smp.index[0], "sales"] = "n/a"  # non-numeric -> 0
    smp["snap_event"] = 1
    smp["sell_price"] = None
    smp[["date", "store_id", "item_id", "sales", "snap_event", "sell_price"]].to_csv(tmp_path / "m5_sample.csv", index=False)
    out = readers.load_panel(spark, "m5", str(tmp_path))
    rows = out.collect()
    assert len(rows) == 40 and all(r.promo == 1 and r.price == 2.0 for r in rows)
    assert min(r.sales for r in rows) == 0.0 and rows[0].category == rows[0].sku_id.split("_")[0]


def test_favorita_sample_and_calendar_without_snaps(spark, subset, tmp_path):
    """Favorita sample fallback without promo / family columns; A05: calendar with no snap flags."""
    pdf, _ = subset
    fav = pdf.head(10).assign(store_nbr=3, item_nbr=7, unit_sales=pdf.head(10)["sales"])[
        ["date", "store_nbr", "item_nbr", "unit_sales"]]
    fav.to_csv(tmp_path / "favorita_sample.csv", index=False)
    out = readers.read_favorita(spark, str(tmp_path)).collect()
    assert {(r.store_id, r.sku_id, r.category, r.promo, r.price) for r in out} == {("3", "7", "General", 0, 1.0)}
    import pandas as pd
    pd.DataFrame({"date": ["2011-01-29", "2011-01-30"], "wm_yr_wk": [11101, 11101]}).to_csv(
        tmp_path / "calendar.csv", index=False)
    cal = readers.read_calendar(spark, str(tmp_path)).collect()
    assert [r.promo for r in cal] == [0, 0]


def test_registry_staleness_and_plan(spark, tmp_path):
    """A18 registry round trip; L06 stale unless an artifact is younger than 24 h; L07 plan."""
    from skucast.operators import drift
    reg = spark.createDataFrame(
        [("M5", "GBT", "A", dt.datetime(2024, 1, 10, 12)), ("M5", "GBT", "B", dt.datetime(2024, 1, 1)),
         ("M5", "SeasonalAR", "A", dt.datetime(2024, 1, 8))],
        "dataset string, model string, sku_id string, trained_at timestamp_ntz")
    sinks.write_registry(reg, str(tmp_path / "registry"))
    back = spark.read.parquet(str(tmp_path / "registry"))
    assert back.count() == 3
    stale = {r.model: r.is_stale for r in drift.is_stale(back, "2024-01-11 00:00:00").collect()}
    assert stale == {"GBT": False, "SeasonalAR": True}
    no_drift = spark.createDataFrame([(False,)], "drift_detected boolean")
    plan = {r.model: r.retrain for r in drift.retrain_plan(no_drift, drift.is_stale(back, "2024-01-11 00:00:00")).collect()}
    assert plan == {"GBT": False, "SeasonalAR": True}
    forced = drift.retrain_plan(no_drift, drift.is_stale(back, "2024-01-11 00:00:00"), force=True).collect()
    assert all(r.retrain for r in forced)


def test_bad_cells_do_not_stop_a_mapped_read(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,sku_id,store_id,sales,promo,price\n2021-01-01,A_1,S,3,True,1.5\n"
                                    "2021-01-02,A_1,S,oops,no,n/a\n2021-01-03,A_1,S,4,1,2\n")
    out = [(r.sales, r.promo, r.price) for r in
           readers.read_mapped(spark, str(tmp_path / "x.csv"), {}, price_default=7.0).orderBy("date").collect()]
    assert out == [(3.0, 1, 1.5), (0.0, 0, 7.0), (4.0, 1, 2.0)]


def test_drop_cache_takes_exact_names_and_panels_only(spark, tmp_path):
    p = demand_panel(spark, SF001).limit(5)
    for name, days in (("M5", 365), ("M5", None), ("M5X", 365), ("UCI", None)):
        readers.cache_panel(p, str(tmp_path), name, days)
    (tmp_path / "M5_notes").mkdir()
    assert sorted(readers.drop_cache(spark, str(tmp_path), "m5")) == ["M5", "M5_365d"]
    assert sorted(readers.drop_cache(spark, str(tmp_path))) == ["M5X_365d", "UCI"]
    assert (tmp_path / "M5_notes").exists()


def test_prepare_panel_in_one_call(spark, tmp_path):
    rows = [f"2021-{m:02d}-{d:02d},S{s},I_{i},{i},0,1.0" for m in (1, 2) for d in range(1, 25) for s in (1, 2) for i in (1, 2, 3)]
    rows += ["2021-01-01,S1,I_9,500,0,1.0"]
    (tmp_path / "m5_sample.csv").write_text("date,store_id,item_id,sales,snap_event,sell_price\n" + "\n".join(rows))
    out = readers.prepare_panel(spark, "M5", str(tmp_path), store="S1", top=3, history=30)
    assert {r.sku_id for r in out.select("sku_id").distinct().collect()} == {"I_2", "I_3"}
    assert out.where("date = '2021-01-01' AND is_holiday = 1").count() == 2


def test_overview_and_page_totals(spark):
    from skucast.operators.panel import datasets_overview, sku_page
    p = demand_panel(spark, SF001)
    rows = {r.dataset: r.n_rows for r in datasets_overview({"A": p, "B": p.limit(7)}).collect()}
    assert rows == {"A": p.count(), "B": 7}
    page = sku_page(p, limit=2).collect()
    assert len(page) == 2 and {r.total for r in page} == {p.select("sku_id").distinct().count()}


def test_cluster_without_checkpoint_folder_is_an_error():
    from types import SimpleNamespace

    from skucast.session import ensure_checkpoint_dir
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)
