"""The byte-range source of wide matrices: ranges of any size, filters, days, quoted and empty cells."""

import pytest

from skucast.sources import readers
from skucast.sources.wide_days import WideReader, read_wide_days

LINES = ["id,item_id,store_id,d_1,d_2,d_10", "a_1,a,1,5,0,7", '"b,x_1","b,x",1,,2,3', "é_2,é,2,1,1,1", "", "c_2,c,2,9,8,6"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("wide")
    for i, cut in enumerate((3, 6)):
        (path / f"part-{i}.csv").write_text("\n".join([LINES[0], *LINES[1:][(0, 2)[i]:(2, 5)[i]]]) + "\n" * (cut == 3))
    (path / "_SUCCESS").write_text("")
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [1, 7, 33, 1 << 20])
def test_ranges_of_any_size_give_every_line_once(spark, folder, size):
    want = rows(readers.melt_days(readers.read_csv(spark, folder).selectExpr("*")).selectExpr("id", "item_id", "store_id", "d", "int(sales) AS sales"))
    assert rows(read_wide_days(spark, folder, range_bytes=size)) == want and len(want) == 12


def test_days_and_filters_are_read_in_the_source(spark, folder):
    df = read_wide_days(spark, folder, days=9).where("store_id = '2' AND item_id = 'c' AND sales > 7")
    assert rows(df) == [("c_2", "c", "2", "d_2", 8)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "> 7" in above and " = 2)" not in above and " = c)" not in above  # no equality on the ids is left above the scan
    reader = WideReader({"path": folder}, df.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan
    assert list(reader.pushFilters([EqualTo(("store_id",), "2"), GreaterThan(("sales",), 7)])) == [GreaterThan(("sales",), 7)]
    assert len(list(reader.partitions())) == 2


def test_load_m5_reads_the_same(spark, tmp_path):
    from pyspark.sql import functions as F

    from skucast.plans.catalog_sources import write_m5
    from skucast.sources.tables import demand_panel
    from tests.conftest import SF001
    few = demand_panel(spark, SF001).where("store_id = 'ASIA' AND category = 'PROMO'")
    write_m5(spark, few, str(tmp_path))
    a = readers.load_m5(spark, str(tmp_path), 100).select("sku_id", "store_id", "date", "sales")
    b = read_wide_days(spark, f"{tmp_path}/sales_train_evaluation.csv", days=100, range_bytes=2000)
    b = b.select(F.col("item_id").alias("sku_id"), "store_id", readers.day_to_date("d").alias("date"), F.col("sales").cast("double").alias("sales"))
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
