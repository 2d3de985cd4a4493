"""Scalar ``Column`` functions (JVM-side, codegen-friendly, no UDFs)."""

from .calendar import (calendar_columns, calendar_patterns, cyclic, date_parts,  # noqa: F401
                       holiday_flag, is_peak_hour, season, time_period, workday_flag)
from .weather import (apparent_temperature, heat_humidity_index,  # noqa: F401
                      heating_cooling_index, humidity_category, temperature_category,
                      thermal_comfort_index)
from .rules import confidence_score, rule_baseline_load, whatif_rule_score  # noqa: F401
