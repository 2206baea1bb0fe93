"""Drift monitor over a file stream of event batches (derived from the events table)."""

from pyspark.sql import functions as F

from skucast.operators.drift import detect_drift
from skucast.sources.tables import read_table
from skucast.streaming import drift_monitor
from tests.conftest import SF001


def test_drift_monitor_matches_batch_report(spark, tmp_path):
    ev = read_table(spark, SF001, "events").select("ts", "value")
    ref = ev.where(F.col("ts") < "2024-01-25")
    cur = ev.where(F.col("ts") >= "2024-01-25")
    src = tmp_path / "incoming"
    cur.write.parquet(str(src))
    q = drift_monitor(spark, str(src), cur.schema, ref, "value", str(tmp_path / "log"), str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    logged = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(logged) == 1 and logged[0].batch_rows == cur.count()
    batch = detect_drift(ref, cur, "value").first()
    assert (logged[0].psi, logged[0].ks_p_value, logged[0].drift_detected) == (batch.psi, batch.ks_p_value,
                                                                            batch.drift_detected)
    # a restart over the same folder reports nothing new (progress is in the checkpoint)
    q2 = drift_monitor(spark, str(src), cur.schema, ref, "value", str(tmp_path / "log"), str(tmp_path / "ckpt"))
    q2.awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_a_replayed_batch_replaces_its_report(spark, tmp_path):
    ev = read_table(spark, SF001, "events").select("ts", "value")
    src = tmp_path / "incoming"
    ev.write.parquet(str(src))
    for checkpoint in ("one", "two"):  # the second run knows nothing of the first: batch 0 is processed again
        q = drift_monitor(spark, str(src), ev.schema, ev, "value", str(tmp_path / "log"), str(tmp_path / checkpoint))
        q.awaitTermination(300)
    assert [r.batch_id for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [0]


def test_sketches_are_within_their_error(spark):
    from skucast.operators.drift import ks_two_sample, psi
    import importlib
    S = importlib.import_module("skucast.streaming.sketch_monitor")
    a = spark.range(40_000).select(F.pow(F.col("id") * 7919 % 40_009 / 40_009, 2).alias("v"))
    b = spark.range(30_000).select((F.pow(F.col("id") * 104_729 % 30_011 / 30_011, 2) * 1.3).alias("v"))
    got = S.sketch_drift(S.value_sketch(a, "v"), S.value_sketch(b, "v")).first()
    d, p = ks_two_sample(a, b, "v").first().ks_d, psi(a, b, "v").first()[0]
    assert abs(got.ks_d - d) <= 2 * S.rank_error() + 1 / S.GRID and abs(got.psi - p) < 0.1 * p + 0.02
    halves = S.value_sketch(a.where("v < 0.3"), "v").unionByName(S.value_sketch(a.where("v >= 0.3"), "v"))
    whole = S.merged(halves.unionByName(S.value_sketch(a.limit(0), "v")))
    same = S.sketch_drift(S.value_sketch(a, "v"), whole).first()
    assert same.rows == 40_000 and same.ks_d <= 2 * S.rank_error() and not same.drift_detected
    none = S.sketch_drift(S.value_sketch(a, "v"), S.value_sketch(a.limit(0), "v")).first()
    assert (none.psi, none.ks_d, none.ks_p_value, none.drift_detected) == (0.0, 0.0, 1.0, False)


def test_sketch_monitor_reads_the_reference_once(spark, tmp_path):
    from skucast.streaming.sketch_monitor import sketch_monitor
    ev = read_table(spark, SF001, "events").select("ts", "value")
    ref, cur = ev.where(F.col("ts") < "2024-01-25"), ev.where(F.col("ts") >= "2024-01-25")
    src, state = tmp_path / "incoming", str(tmp_path / "state")
    cur.repartition(1).write.parquet(str(src))
    args = (spark, str(src), cur.schema)
    assert sketch_monitor(*args, ref, "value", state, str(tmp_path / "ckpt")).awaitTermination(300)
    # a second start must not touch the reference: this one cannot be read
    broken = ref.withColumn("value", F.raise_error(F.lit("read again")).cast("double"))
    cur.withColumn("value", F.col("value") + 500).repartition(1).write.mode("append").parquet(str(src))
    assert sketch_monitor(*args, broken, "value", state, str(tmp_path / "ckpt")).awaitTermination(300)
    got = {(r.batch_id, r.scope): r for r in spark.read.parquet(f"{state}/reports").collect()}
    assert set(got) == {(i, s) for i in (0, 1) for s in ("batch", "all")}
    assert got[1, "batch"].drift_detected and got[1, "batch"].rows == cur.count() and got[1, "all"].rows == 2 * cur.count()
    assert got[0, "batch"].ks_d == got[0, "all"].ks_d and got[0, "batch"].ref_rows == ref.count()
