"""Queries for the file sources, sinks and append tables."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ridgeline.functions import process as P
from ridgeline.functions import recs as RC
from ridgeline.plans import oracle as O
from ridgeline.plans.q_joins import ACTES, FIN, KFIN, alerts, kfin
from ridgeline.plans.q_clean import SETTINGS
from ridgeline.plans.q_scenario import svc_sql
from ridgeline.plans.registry import query
from ridgeline.sources import layouts as L
from ridgeline.sources import sinks as SK
from ridgeline.sources import tables as T
from ridgeline.streaming.live import scratch

R = O.READINGS
HALF = "2024-01-16"


@query("scan_monthly", O.with_ctes(R, body=f"""
SELECT 'Pb_Rougher_2024_01a.parquet' AS source_file, 0 AS file_no, count(*) AS n, count(level) AS n_level, 0 AS n_spare,
       min(ts) AS first_ts, max(ts) AS last_ts FROM readings WHERE ts < TIMESTAMP '{HALF}' HAVING count(*) > 0
UNION ALL
SELECT 'Pb_Rougher_2024_01b.parquet', 1, count(*), 0, 0, min(ts), max(ts) FROM readings WHERE ts >= TIMESTAMP '{HALF}' HAVING count(*) > 0"""))
def scan_monthly(spark, sf):
    """Two files of a month whose columns differ, beside one of another
    section; the tag finds the two, in name order."""
    r = T.readings(spark, sf)
    m1, m2 = T.readings_months(r)
    d = scratch(spark, "monthly")
    m2.write.parquet(os.path.join(d, "Pb_Rougher_2024_01b.parquet"))
    r.select("seq", "ts", "level").write.parquet(os.path.join(d, "Zn_Rougher_2024_01a.parquet"))
    m1.write.parquet(os.path.join(d, "Pb_Rougher_2024_01a.parquet"))
    return SK.scan_monthly(spark, d, tag="Pb_Rougher").groupBy("source_file", "file_no").agg(
        F.count(F.lit(1)).alias("n"), F.count("level").alias("n_level"), F.count("spare").alias("n_spare"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("sink_parquet", O.with_ctes(R, body="SELECT *, TRUE AS refused_second_write FROM readings"))
def sink_parquet(spark, sf):
    """Write once, refuse a second write without overwrite, read back."""
    d = scratch(spark, "sink")
    r = T.readings(spark, sf)
    SK.sink_parquet(r, d)
    refused = False
    try:
        SK.sink_parquet(r, d)
    except AnalysisException:  # the path exists
        refused = True
    return spark.read.parquet(d).withColumn("refused_second_write", F.lit(refused))


_CSV = " UNION ALL ".join(
    f"SELECT seq, '{label}' AS Parameter, coalesce({c}, 0.0) AS Value, '{unit}' AS Unit, ts AS Timestamp FROM kfin"
    for c, label, unit in SK.EXPORT_ROWS)


@query("export_csv", O.with_ctes(R, FIN, KFIN, body=f"SELECT seq, Parameter, round(Value, 6) AS Value, Unit, Timestamp FROM ({_CSV})"))
def export_csv(spark, sf):
    """CSV export of the long table, read back with its header."""
    d = scratch(spark, "csv")
    SK.export_csv(SK.export_long(kfin(spark, sf)), d)
    back = spark.read.option("header", True).schema("seq bigint, Parameter string, Value double, Unit string, Timestamp timestamp_ntz").csv(d)
    return back.withColumn("Value", F.round("Value", 6))


def _kpis(spark, sf):
    return kfin(spark, sf).withColumn("status", P.status_reagent("grade", F.col("recovery") * 100.0, "kex", "sipx"))


def _incoming(spark, sf, layout):
    """(frame, key): rows as the producers of a table hand them over."""
    if layout in ("process_events", "alerts"):
        a = alerts(spark, sf)
        named = a.withColumn("severity", F.when(F.col("severity") != "medium", F.upper("severity"))).withColumn("sensor_data_id", F.col("seq"))
        return named.withColumnsRenamed({"alert_type": "event_type"} if layout == "process_events"
                                        else {"description": "alert_message", "metric": "parameter_name", "value": "current_value"}), "alert_id"
    if layout == "control_settings":
        return T.settings(T.readings(spark, sf)), "seq"
    k = _kpis(spark, sf)
    if layout == "predictions":
        return k.withColumns({"predicted_pb": F.col("grade"), "predicted_recovery": F.col("recovery") * 100.0, "confidence": P.input_confidence()}), "seq"
    if layout == "flotation_calculated_values":
        return k.withColumns({"Predicted_Pb_Concentrate": F.col("grade"), "Actual_Pb_Concentrate": F.col("feed_pb") * 10.0,
                              "Predicted_Pb_Recovery": F.col("recovery"), "Process_Status": F.col("status"),
                              "model_confidence": F.when(F.col("level").isNotNull(), 0.9)}), "seq"
    if layout == "flotation_optimization_data":
        kex, sipx = RC.control_step(F.lit("Pb_Concentrate"), F.lit("increase"), F.col("kex"), F.col("sipx"))
        return k.withColumns({"current_kex": F.col("kex"), "current_sipx": F.col("sipx"), "recommended_kex": kex, "recommended_sipx": sipx,
                              "external_factors_changed": F.col("feed_pb") > 2.0,
                              "recommendations": RC.service_messages(F.col("grade"), F.col("recovery"), F.col("kex"), F.col("sipx"))}), "seq"
    kpis = {"Pb_Recovery": F.col("recovery"), "Pb_Concentrate": F.col("grade")} if layout == "sensor_data" else {}
    return k.withColumnsRenamed(L.TAG_NAMES).withColumns(kpis), "seq"


_AT = f"CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, CASE WHEN ts < TIMESTAMP '{HALF}' THEN 0 ELSE 1 END AS epoch"
_CONF = O.rhu("greatest(0.7, least(0.98, 0.85 + CASE WHEN coalesce(kex, 45.0) BETWEEN 30 AND 60 THEN 0.05 ELSE 0.0 END"
              " + CASE WHEN coalesce(sipx, 25.0) BETWEEN 15 AND 40 THEN 0.05 ELSE 0.0 END"
              " + CASE WHEN coalesce(air_flow, 150.0) BETWEEN 100 AND 200 THEN 0.03 ELSE 0.0 END + 0.02))", 3)
_STORED = {  # layout: its columns in SQL, and the table they come from
    "sensor_data": ("NULL::DOUBLE AS pH, NULL::DOUBLE AS temperature, air_flow, kex AS kex_flowrate, sipx AS sipx_flowrate, feed_pb,"
                    " NULL::DOUBLE AS cell_level, NULL::DOUBLE AS impeller_speed, NULL::DOUBLE AS froth_height, NULL::DOUBLE AS pulp_density,"
                    " NULL::DOUBLE AS nigrosine_min, NULL::DOUBLE AS nigrosine_max, round(recovery, 6) AS pb_recovery, grade AS pb_concentrate", "kfin"),
    "control_settings": ("kex AS kex_flowrate, sipx AS sipx_flowrate", "settings"),
    "predictions": ("grade AS predicted_pb, round(recovery * 100.0, 6) AS predicted_recovery, NULL::DOUBLE AS recovery_efficiency,"
                    f" {_CONF} AS confidence, {O.status_reagent('grade', 'recovery * 100.0', 'kex', 'sipx')} AS status", "kfin"),
    "process_events": ("alert_type AS event_type, description AS event_description,"
                       " CASE WHEN severity = 'medium' THEN 'INFO' ELSE upper(severity) END AS severity,"
                       " seq AS sensor_data_id, NULL::BIGINT AS control_settings_id", "alerts"),
    "alerts": ("alert_type, description AS alert_message, CASE WHEN severity = 'medium' THEN 'warning' ELSE upper(severity) END AS severity,"
               " metric AS parameter_name, round(value, 6) AS current_value, NULL::VARCHAR AS optimal_range, seq AS sensor_data_id,"
               " NULL::BIGINT AS control_settings_id, NULL::BIGINT AS predictions_id", "alerts"),
    "flotation_sensor_data": ("feed_pb AS Feed_Pb, kex AS Pb_Conditioner_KEX_Flowrate, sipx AS Pb_Rougher1_SIPX_Flowrate,"
                              " air_flow AS Pb_Rougher1_AirFlow, level AS Pb_Rougher1_Level", "kfin"),
    "flotation_calculated_values": ("grade AS Predicted_Pb_Concentrate, round(feed_pb * 10.0, 6) AS Actual_Pb_Concentrate,"
                                    " round(recovery, 6) AS Predicted_Pb_Recovery, NULL::DOUBLE AS Actual_Pb_Recovery,"
                                    f" {O.status_reagent('grade', 'recovery * 100.0', 'kex', 'sipx')} AS Process_Status,"
                                    " CASE WHEN level IS NULL THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END AS model_confidence", "kfin"),
    "flotation_optimization_data": ("kex AS current_kex, sipx AS current_sipx, least(kex + 5.0, 80.0) AS recommended_kex,"
                                    " least(sipx + 3.0, 50.0) AS recommended_sipx, 0.8::DOUBLE AS optimization_confidence,"
                                    f" CAST(to_json({svc_sql()}) AS VARCHAR) AS recommendations,"
                                    " coalesce(feed_pb > 2.0, FALSE) AS external_factors_changed", "kfin"),
}


def _stored_sql(layout):
    columns, table = _STORED[layout]
    ctes = {"settings": (R, SETTINGS), "alerts": ACTES}.get(table, (R, FIN, KFIN))
    return O.with_ctes(*ctes, body=f"SELECT {'alert_id' if table == 'alerts' else 'seq'} AS id, ts AS timestamp, {columns}, {_AT} FROM {table}")


def _append(layout):
    def run(spark, sf):
        df, key = _incoming(spark, sf, layout)
        path = scratch(spark, layout)
        half = F.lit(HALF).cast("timestamp_ntz")
        epochs = (df.filter(F.col("ts") < half), df.filter(F.col("ts") >= half))
        for epoch in (0, 1, 1):  # the second micro-batch is run again
            L.append_epoch(L.to_layout(epochs[epoch], layout, key), path, epoch)
        back = spark.read.parquet(path).withColumns({"dt": F.col("dt").cast("string"), "epoch": F.col("epoch").cast("int")})
        return back.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in back.dtypes])
    run.__doc__ = f"S8: two micro-batches of the {layout} table, one of them stored twice, read back whole."
    return run


for _name in L.LAYOUTS:
    query(f"append_{_name}", _stored_sql(_name))(_append(_name))


@query("append_tables", O.with_ctes(R, FIN, KFIN, body="""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, count(*) AS n_sensor, count(*) AS n_calculated, round(avg(CASE WHEN level IS NULL THEN 0.85 ELSE 0.9 END), 6) AS avg_confidence
FROM kfin GROUP BY CAST(ts AS DATE)"""))
def append_tables(spark, sf):
    """Rows per day folder of two tables that two ticks appended to."""
    names = {"flotation_sensor_data": "n_sensor", "flotation_calculated_values": "n_calculated"}
    half = F.lit(HALF).cast("timestamp_ntz")
    tables = []
    for layout, count in names.items():
        df, key = _incoming(spark, sf, layout)
        path = scratch(spark, layout)
        for tick in (df.filter(F.col("ts") < half), df.filter(F.col("ts") >= half)):
            SK.append_table(L.to_layout(tick, layout, key), path)
        mean = [F.round(F.avg("model_confidence"), 6).alias("avg_confidence")] if count == "n_calculated" else []
        tables.append(spark.read.parquet(path).groupBy("dt").agg(F.count(F.lit(1)).alias(count), *mean))
    return tables[0].join(tables[1], "dt").withColumn("dt", F.col("dt").cast("string"))
