"""Append-table layouts (S8): one declaration per table drives one sink.

A layout lists its columns in order.  Each names the incoming column it is
filled from, its type, the value that stands for a missing one, and whether it
is stored as JSON text.  ``to_layout`` turns any frame into the layout with a
single projection; ``append_epoch`` stores one micro-batch of it, and storing
the same epoch again replaces what the first attempt left.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


@dataclass(frozen=True)
class Field:
    """A stored column: its source column (its own name if not given), type,
    value for a missing or null source, JSON text or not."""

    name: str
    source: str = ""
    type: str = "double"
    default: Any = None
    json: bool = False


# --- fixed values that must equal the reference's ---------------------------
# Columns of the eight append tables, the incoming names they are filled from
# and the defaults of absent ones: model confidence 0.85, optimisation
# confidence 0.8, external change false, event severity INFO, alert severity
# warning, no recommendations.
LAYOUTS: Mapping[str, tuple[Field, ...]] = {
    "sensor_data": (
        Field("pH"), Field("temperature", "Temperature"), Field("air_flow", "Pb_Rougher1_AirFlow"),
        Field("kex_flowrate", "Pb_Conditioner_KEX_Flowrate"), Field("sipx_flowrate", "Pb_Rougher1_SIPX_Flowrate"),
        Field("feed_pb", "Feed_Pb"), Field("cell_level", "Cell_Level"), Field("impeller_speed", "Impeller_Speed"),
        Field("froth_height", "Froth_Height"), Field("pulp_density", "Pulp_Density"),
        Field("nigrosine_min", "Pb_Conditioner_Nigrosine_Flowrate_Min"),
        Field("nigrosine_max", "Pb_Conditioner_Nigrosine_Flowrate_Max"),
        Field("pb_recovery", "Pb_Recovery"), Field("pb_concentrate", "Pb_Concentrate")),
    "control_settings": (Field("kex_flowrate", "kex"), Field("sipx_flowrate", "sipx")),
    "predictions": (Field("predicted_pb"), Field("predicted_recovery"), Field("recovery_efficiency"), Field("confidence"),
                    Field("status", type="string")),
    "process_events": (
        Field("event_type", type="string"), Field("event_description", "description", "string"),
        Field("severity", type="string", default="INFO"),
        Field("sensor_data_id", type="bigint"), Field("control_settings_id", type="bigint")),
    "alerts": (
        Field("alert_type", type="string"), Field("alert_message", type="string"),
        Field("severity", type="string", default="warning"), Field("parameter_name", type="string"), Field("current_value"),
        Field("optimal_range", type="string"), Field("sensor_data_id", type="bigint"),
        Field("control_settings_id", type="bigint"), Field("predictions_id", type="bigint")),
    "flotation_sensor_data": (
        Field("Feed_Pb"), Field("Pb_Conditioner_KEX_Flowrate"), Field("Pb_Rougher1_SIPX_Flowrate"),
        Field("Pb_Rougher1_AirFlow"), Field("Pb_Rougher1_Level")),
    "flotation_calculated_values": (
        Field("Predicted_Pb_Concentrate"), Field("Actual_Pb_Concentrate"), Field("Predicted_Pb_Recovery"),
        Field("Actual_Pb_Recovery"), Field("Process_Status", type="string"), Field("model_confidence", default=0.85)),
    "flotation_optimization_data": (
        Field("current_kex"), Field("current_sipx"), Field("recommended_kex"), Field("recommended_sipx"),
        Field("optimization_confidence", default=0.8), Field("recommendations", type="string", default="[]", json=True),
        Field("external_factors_changed", type="boolean", default=False)),
}
# Incoming names of the live tags.
TAG_NAMES = {"feed_pb": "Feed_Pb", "kex": "Pb_Conditioner_KEX_Flowrate", "sipx": "Pb_Rougher1_SIPX_Flowrate",
             "air_flow": "Pb_Rougher1_AirFlow", "level": "Pb_Rougher1_Level"}
# ---------------------------------------------------------------------------

#: Columns that every layout carries beside its own: row id, time, day folder, micro-batch.
ID, TIME, DAY, EPOCH = "id", "timestamp", "dt", "epoch"


def _value(df: DataFrame, field: Field) -> Column:
    source = field.source or field.name
    default = F.lit(field.default).cast(field.type)
    if source not in df.columns:
        return default
    if field.json:
        if not isinstance(df.schema[source].dataType, ArrayType | MapType | StructType):
            raise TypeError(f"{source} is stored as JSON text and must be an array, map or struct")
        value = F.to_json(F.col(source))
    else:
        value = F.col(source).cast(field.type)
    return value if field.default is None else F.coalesce(value, default)


def to_layout(df: DataFrame, layout: str, key: str = "seq", ts: str = "ts") -> DataFrame:
    """The rows of ``df`` in the named layout: ``id`` (from ``key``),
    ``timestamp`` (from ``ts``), the layout's columns in order, and the day
    ``dt``.  Sources that ``df`` lacks give their default, or null; columns of
    no layout are dropped."""
    fields = LAYOUTS[layout]
    return df.select(F.col(key).cast("bigint").alias(ID), F.col(ts).cast("timestamp_ntz").alias(TIME),
                     *[_value(df, f).alias(f.name) for f in fields], F.to_date(ts).alias(DAY))


def append_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    """Store one micro-batch under ``path/dt=.../epoch=...`` (call from
    ``foreachBatch``).  Folders of other epochs are not touched, so a batch
    that is run again replaces its own rows and nothing else; structured
    streaming reruns a batch over the same offsets, hence the same days."""
    (rows.withColumn(EPOCH, F.lit(epoch).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(DAY, EPOCH).parquet(path))
