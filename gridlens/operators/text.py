"""Text operators over text columns: cleaning, display names, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
# feature code -> display name (codes not listed display as themselves)
DISPLAY_NAMES = {
    "temperature": "Temperature",
    "humidity": "Humidity",
    "load": "Load",
    "load_lag_1h": "Load 1 h earlier",
    "load_lag_24h": "Load 24 h earlier",
    "load_lag_168h": "Load same hour last week",
    "is_workday": "Workday effect",
    "is_holiday": "Holiday effect",
    "hour": "Hour of day",
    "day_of_week": "Day of week",
    "month": "Month",
    "thermal_comfort_index": "Thermal comfort index",
    "heating_cooling_index": "Heating / cooling index",
    "apparent_temperature": "Apparent temperature",
    "temp_workday_interaction": "Temperature x workday",
    "heat_humidity_index": "Heat-humidity index",
}
MAX_HISTORY_TURNS = 5          # kept entries = 2 * turns
# ---------------------------------------------------------------------------

_WS = r"^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_code_fence(text) -> Column:
    """Trim; when the text opens with a ``` fence, drop the opening fence line
    and a closing fence line."""
    t = F.regexp_replace(_c(text), _WS, "")
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(\n|$)", ""), r"(^|\n)```[^\n]*$", "")
    return F.when(t.startswith("```"), F.regexp_replace(inner, _WS, "")).otherwise(t)


def display_names(df: DataFrame, feature_col: str = "feature",
                  names: dict[str, str] | None = None, out: str = "display_name") -> DataFrame:
    """Attach display names via a broadcast join of the (fixed-size) name table."""
    names = names or DISPLAY_NAMES
    spark = df.sparkSession
    dim = spark.createDataFrame(list(names.items()), f"_f string, {out} string")
    j = df.join(F.broadcast(dim), F.col(feature_col) == F.col("_f"), "left")
    return j.withColumn(out, F.coalesce(F.col(out), F.col(feature_col))).drop("_f")


def display_name_expr(feature, names: dict[str, str] | None = None) -> Column:
    names = names or DISPLAY_NAMES
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(feature)), _c(feature))


def history_trim(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 max_turns: int = MAX_HISTORY_TURNS) -> DataFrame:
    """Keep the last ``2 * max_turns`` entries per conversation (a top-k per
    group: Spark plans a partial window-group-limit before the shuffle)."""
    w = Window.partitionBy(conv_col).orderBy(F.col(turn_col).desc())
    return (df.withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= 2 * max_turns).drop("_rn"))
