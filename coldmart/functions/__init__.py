"""Column functions: everything here takes and returns ``Column`` and stays in codegen."""

from coldmart.functions.keys import integer_key, row_json, string_key
from coldmart.functions.measures import (
    share_of_time,
    watt_hours,
    weighted_mean,
)
from coldmart.functions.time import (
    corrected_at,
    date_key,
    group_start,
    held_until,
    iso_week_key,
    jst_date,
    plus_millis,
    slot_key,
    whole_millis_between,
)

__all__ = [
    "corrected_at",
    "date_key",
    "group_start",
    "held_until",
    "integer_key",
    "iso_week_key",
    "jst_date",
    "plus_millis",
    "row_json",
    "share_of_time",
    "slot_key",
    "string_key",
    "watt_hours",
    "weighted_mean",
    "whole_millis_between",
]
