"""Sinks, locked splits, archives, guarded assembly and the streamed correction, each read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelcast.contract import HOURLY
from panelcast.functions.numeric import safe_ratio
from panelcast.operators import evaluate, linear, splits
from panelcast.operators.declared import Declared
from panelcast.operators.features import History, add_calendar
from panelcast.operators.lineage import observed
from panelcast.operators.manifest import guard_features
from panelcast.operators.prep import fit_scaler
from panelcast.plans import views
from panelcast.plans.catalogue.features import ASSEMBLED, LOCAL
from panelcast.plans.catalogue.models import CRAMER, FLAG, X, lines
from panelcast.plans.catalogue.residuals import scored_block, state
from panelcast.plans.registry import ORACLE, query
from panelcast.sources.models import read_model, write_model
from panelcast.sources.staging import staging_root
from panelcast.sources.tables import SplitCatalog, read_csv, write_splits, write_summary
from panelcast.streaming.blocks import correct_blocks
from panelcast.streaming.keyed import correct_blocks_keyed


def folder(spark, name: str) -> str:
    return f"{staging_root(spark)}/panelcast/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("source_csv", sql="""
  SELECT event_type, count(*) AS n, count(CASE WHEN value >= 10 THEN value END) AS present, sum(CASE WHEN value >= 10 THEN value END) AS total FROM events GROUP BY 1
""", doubles=["total"], digits={"total": 2})
def source_csv(spark, sf):
    """IO-1: typed CSV with a header, NaN and empty fields missing."""
    ev = views.table(spark, sf, "events")
    text = F.when(F.col("value") >= 10, F.col("value").cast("string")).when(F.col("value") >= 5, "NaN")
    path = folder(spark, "csv")
    ev.select("event_id", "event_type", text.alias("value")).write.csv(path, header=True)
    raw = read_csv(spark, path, "event_id long, event_type string, value double")
    return raw.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("present"), F.sum("value").alias("total"))


@query("sink_split_catalog", ["splits"], sql="""
  SELECT series_id, split, count(*) AS n, sum(y) AS y, max(ts) AS last_ts FROM splits WHERE split <> 'test' GROUP BY 1, 2
""", doubles=["y"], stamps=["last_ts"], digits={"y": 5})
def sink_split_catalog(spark, sf):
    """IO-5 and IO-7: splits written once, development read back through the lock."""
    path = folder(spark, "splits")
    write_splits(splits.chronological_split(views.scored(spark, sf)), path, ["series_id", "ts", "pred", "y"], forbidden=["price actual"])
    dev = SplitCatalog(spark, path).read("train", "validation")
    return dev.groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.max("ts").alias("last_ts"))


@query("sink_sorted_summary", ["folds"], sql="""
  SELECT series_id, fold, avg(abs(pred - y)) AS mae FROM folds WHERE role = 'validation' GROUP BY 1, 2
""", doubles=["mae"], whole=["fold"])
def sink_sorted_summary(spark, sf):
    """IO-6: sorted summary written as CSV and read back."""
    path = folder(spark, "summary")
    m = evaluate.metrics(views.folds(spark, sf).where(F.col("role") == "validation"), views.FOLD)
    write_summary(m.select("series_id", "fold", "mae"), path, ["series_id", "fold"])
    return read_csv(spark, path, "series_id string, fold int, mae double")


@query("model_archive", ["moments"], sql=f"""
  SELECT s.l_returnflag, count(*) AS n, avg(my + w1 * (l_quantity - m1) / s1 + w2 * (l_discount - m2) / s2) AS mean_pred,
    avg(abs(my + w1 * (l_quantity - m1) / s1 + w2 * (l_discount - m2) / s2 - l_extendedprice / 1000)) AS mae
  FROM (SELECT *, {CRAMER.format(a='0.001')} FROM moments) s JOIN lineitem l ON l.l_returnflag = s.l_returnflag GROUP BY 1
""", doubles=["mean_pred", "mae"])
def model_archive(spark, sf):
    """IO-8: models written as rows, read back and used for scoring."""
    path, df = folder(spark, "model"), lines(spark, sf)
    write_model(linear.fit_ridge(df, FLAG, X), path)
    scored = linear.score(df, read_model(spark, path), FLAG, X)
    return scored.groupBy(*FLAG).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"), F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae")
    )


def declared_features() -> Declared:
    """Every feature once: what computes it and what the manifest says of it come from the same call."""
    plan = Declared(HOURLY)
    for name, text in (("hour", "Local hour"), ("day_of_week", "Local weekday"), ("month", "Local month")):
        plan.known(name, "ts", "calendar", "calendar_field", "known_in_advance", text)
    plan.lags("y", "y", (24,), "y", "historical_target", "shift", "prior_auction_only", "value")
    plan.lags("total", "total", (24,), "total", "historical_load", "shift", "historical_actual_only", "total")
    plan.lags("ratio", safe_ratio(F.col("total"), F.col("n")), (24,), "total / n", "historical_load", "ratio then shift", "historical_actual_only", "ratio")
    plan.rolling("mean_24h", "y", 24, 24, "historical_target", "prior_auction_only", "Mean of the day before")
    return plan


@query("feature_guarded_matrix", ["panel"], sql=f"""
  SELECT series_id, ts, hour({LOCAL}) AS hour, isodow({LOCAL}) - 1 AS day_of_week, month({LOCAL}) AS month, lag(y, 24) OVER w AS y_lag_24,
    lag(total, 24) OVER w AS total_lag_24, lag(CASE WHEN n > 0 THEN total / n END, 24) OVER w AS ratio_lag_24,
    CASE WHEN count(y) OVER r = 24 THEN avg(y) OVER r END AS mean_24h
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts), r AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING)
""", doubles=ASSEMBLED[3:], whole=ASSEMBLED[:3], stamps=["ts"], places=8)
def feature_guarded_matrix(spark, sf):
    """FE-16 and FE-18: the matrix must equal its manifest and hold nothing that can leak."""
    plan = declared_features()
    rows = observed(views.panel(spark, sf), ["y", "total", "n"])
    out = add_calendar(plan.history.apply(rows), cyclic=False).select("series_id", "ts", *plan.manifest.names)
    guard_features(out, plan.manifest, ["series_id", "ts"], raw=["y", "total", "n"])
    return out


@query("feature_availability_classes", ["panel"], sql="""
  SELECT series_id, u.feature, u.strict AS classification_strict, u.assumed AS classification_assumed, u.v AS present FROM (
    SELECT series_id, count(*) AS n, count(a) AS a, count(b) AS b FROM (SELECT series_id, lag(y, 24) OVER w AS a, lag(total, 24) OVER w AS b
      FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts)) GROUP BY 1) q,
  LATERAL (VALUES ('hour', 'SAFE', 'SAFE', n), ('y_lag_24', 'SAFE', 'SAFE', a), ('total_lag_24', 'FORBIDDEN', 'CONDITIONAL', b)) u(feature, strict, assumed, v)
""")
def feature_availability_classes(spark, sf):
    """FE-20: class of each feature next to how often it is present in the data."""
    from panelcast.operators.clean import melt
    from panelcast.operators.manifest import availability_audit

    out = History(HOURLY).lag("y", 24).lag("total", 24).apply(views.panel(spark, sf)).withColumn("hour", F.hour("ts"))
    counts = out.groupBy("series_id").agg(*[F.count(c).alias(c) for c in ("hour", "y_lag_24", "total_lag_24")])
    long = melt(counts, ["series_id"], ["hour", "y_lag_24", "total_lag_24"], "feature", "present")
    audit = availability_audit(declared_features().manifest.to_frame(spark)).select("feature", "classification_strict", "classification_assumed")
    return long.join(audit, "feature")


@query("prep_scaler_rows", sql="SELECT l_returnflag, 2 AS features, avg(l_quantity) AS mean_quantity, stddev_pop(l_discount) AS scale_discount FROM lineitem GROUP BY 1",
       doubles=["mean_quantity", "scale_discount"], whole=["features"], digits={"mean_quantity": 7})
def prep_scaler_rows(spark, sf):
    """PP-2: the scaler as one row of aligned arrays per group."""
    s = fit_scaler(lines(spark, sf), FLAG, X)
    return s.select(*FLAG, F.size("names").alias("features"), F.col("means")[0].alias("mean_quantity"), F.col("scales")[1].alias("scale_discount"))


@query("residual_stream_blocks")
def residual_stream_blocks(spark, sf):
    """ST-1: the block correction run as a stream over the same rows; equals the batch result."""
    return streamed(spark, sf, correct_blocks)


@query("residual_stream_keyed")
def residual_stream_keyed(spark, sf):
    """ST-1 with keyed state and a timer for every block; equals the batch result."""
    return streamed(spark, sf, correct_blocks_keyed)


def streamed(spark, sf, correct):
    rows = scored_block(spark, sf)
    key = F.concat_ws("|", "series_id", "fold").alias("series_id")
    ts = F.col("ts").cast("timestamp").alias("ts")
    step = F.col("offset").alias("step")
    asked, known, out = folder(spark, "asked"), folder(spark, "known"), folder(spark, "stream")
    rows.select(key, ts, step, "pred").write.parquet(asked)
    first = state(spark, sf)
    # step −1 carries the last training error
    start = rows.where(F.col("offset") == 0).join(first, views.FOLD).select(
        key, F.timestamp_add("DAY", F.lit(-1), F.col("ts").cast("timestamp")).alias("ts"), F.lit(-1).cast("long").alias("step"), F.col("last_error").alias("y"), F.lit(0.0).alias("pred")
    )
    rows.select(key, ts, step, "y", "pred").unionByName(start).write.parquet(known)
    schema = "series_id string, ts timestamp, step long, {}pred double"
    stream = correct(
        spark.readStream.schema(schema.format("")).parquet(asked), spark.readStream.schema(schema.format("y double, ")).parquet(known),
        first.select(key, "phi"), step_seconds=86400, late_by="40 days",
    )
    job = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "progress"))
           .outputMode("append").trigger(availableNow=True).start())
    job.awaitTermination()
    done = spark.read.parquet(out)
    part = F.split("series_id", r"\|")
    return done.select(part[0].alias("series_id"), part[1].cast("int").alias("fold"), "ts", "ar_add", "corrected")


# the stream must give what the batch query gives
ORACLE["residual_stream_blocks"] = ORACLE["residual_stream_keyed"] = ORACLE["residual_ar1_blocks"]
