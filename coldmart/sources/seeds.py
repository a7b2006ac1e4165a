"""Hand-written reference tables: range bands and public holidays."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

# The bands of each family (family, key, label, lower, upper, order). A band holds
# its lower bound and not its upper; None is no bound.
BANDS = [
    ("setpoint", 1, "冷凍 (< 0 °C)", None, 0.0, 1),
    ("setpoint", 2, "冷蔵 (>= 0 °C)", 0.0, None, 2),
    ("ambient_temperature", 1, "< 5 °C", None, 5.0, 1),
    ("ambient_temperature", 2, "5..10 °C", 5.0, 10.0, 2),
    ("ambient_temperature", 3, "10..15 °C", 10.0, 15.0, 3),
    ("ambient_temperature", 4, "15..20 °C", 15.0, 20.0, 4),
    ("ambient_temperature", 5, "20..25 °C", 20.0, 25.0, 5),
    ("ambient_temperature", 6, "25..30 °C", 25.0, 30.0, 6),
    ("ambient_temperature", 7, "30..35 °C", 30.0, 35.0, 7),
    ("ambient_temperature", 8, "35..40 °C", 35.0, 40.0, 8),
    ("ambient_temperature", 9, ">= 40 °C", 40.0, None, 9),
    ("interior_temperature", 1, "< -18 °C", None, -18.0, 1),
    ("interior_temperature", 2, "-18..-15 °C", -18.0, -15.0, 2),
    ("interior_temperature", 3, "-15..-5 °C", -15.0, -5.0, 3),
    ("interior_temperature", 4, "-5..5 °C", -5.0, 5.0, 4),
    ("interior_temperature", 5, "5..15 °C", 5.0, 15.0, 5),
    ("interior_temperature", 6, ">= 15 °C", 15.0, None, 6),
    ("interior_delta", 1, "< 0 °C", None, 0.0, 1),
    ("interior_delta", 2, "0..2 °C", 0.0, 2.0, 2),
    ("interior_delta", 3, "2..5 °C", 2.0, 5.0, 3),
    ("interior_delta", 4, "5..10 °C", 5.0, 10.0, 4),
    ("interior_delta", 5, "10..20 °C", 10.0, 20.0, 5),
    ("interior_delta", 6, ">= 20 °C", 20.0, None, 6),
    ("humidity", 1, "< 20 %", None, 20.0, 1),
    ("humidity", 2, "20..40 %", 20.0, 40.0, 2),
    ("humidity", 3, "40..60 %", 40.0, 60.0, 3),
    ("humidity", 4, "60..80 %", 60.0, 80.0, 4),
    ("humidity", 5, ">= 80 %", 80.0, None, 5),
    ("state_of_charge", 1, "< 20 %", None, 20.0, 1),
    ("state_of_charge", 2, "20..50 %", 20.0, 50.0, 2),
    ("state_of_charge", 3, "50..80 %", 50.0, 80.0, 3),
    ("state_of_charge", 4, "80..95 %", 80.0, 95.0, 4),
    ("state_of_charge", 5, ">= 95 %", 95.0, None, 5),
    ("input_power", 1, "0 W", None, 1.0, 1),
    ("input_power", 2, "< 10 W", 1.0, 10.0, 2),
    ("input_power", 3, "10..40 W", 10.0, 40.0, 3),
    ("input_power", 4, "40..70 W", 40.0, 70.0, 4),
    ("input_power", 5, ">= 70 W", 70.0, None, 5),
    ("charge_power", 1, "0 W", None, 1.0, 1),
    ("charge_power", 2, "< 10 W", 1.0, 10.0, 2),
    ("charge_power", 3, "10..30 W", 10.0, 30.0, 3),
    ("charge_power", 4, "30..60 W", 30.0, 60.0, 4),
    ("charge_power", 5, ">= 60 W", 60.0, None, 5),
    ("discharge_power", 1, "0 W", None, 1.0, 1),
    ("discharge_power", 2, "< 10 W", 1.0, 10.0, 2),
    ("discharge_power", 3, "10..30 W", 10.0, 30.0, 3),
    ("discharge_power", 4, "30..50 W", 30.0, 50.0, 4),
    ("discharge_power", 5, ">= 50 W", 50.0, None, 5),
]

# The unit of each family.
UNITS = {
    "setpoint": "celsius",
    "ambient_temperature": "celsius",
    "interior_temperature": "celsius",
    "interior_delta": "celsius",
    "humidity": "percent",
    "state_of_charge": "percent",
    "input_power": "watts",
    "charge_power": "watts",
    "discharge_power": "watts",
}

# Japanese public holidays of the calendar's span.
JAPANESE_HOLIDAYS = """
2026-01-01 元日
2026-01-12 成人の日
2026-02-11 建国記念の日
2026-02-23 天皇誕生日
2026-03-20 春分の日
2026-04-29 昭和の日
2026-05-03 憲法記念日
2026-05-04 みどりの日
2026-05-05 こどもの日
2026-05-06 振替休日
2026-07-20 海の日
2026-08-11 山の日
2026-09-21 敬老の日
2026-09-22 国民の休日
2026-09-23 秋分の日
2026-10-12 スポーツの日
2026-11-03 文化の日
2026-11-23 勤労感謝の日
2027-01-01 元日
2027-01-11 成人の日
2027-02-11 建国記念の日
2027-02-23 天皇誕生日
2027-03-21 春分の日
2027-03-22 振替休日
2027-04-29 昭和の日
2027-05-03 憲法記念日
2027-05-04 みどりの日
2027-05-05 こどもの日
2027-07-19 海の日
2027-08-11 山の日
2027-09-20 敬老の日
2027-09-23 秋分の日
2027-10-11 スポーツの日
2027-11-03 文化の日
2027-11-23 勤労感謝の日
"""

HOLIDAY_SCHEMA = "holiday_date DATE, holiday_name STRING"


def band_schema(unit: str) -> str:
    return (
        f"band STRING, band_key BIGINT, label STRING, lower_{unit} DOUBLE, "
        f"upper_{unit} DOUBLE, sort_order BIGINT"
    )


def band_rows(name: str) -> list[tuple]:
    return [row for row in BANDS if row[0] == name]


def read_seed(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A seed as a typed table: the packaged one, or ``{folder}/{name}.csv``.

    In a CSV an empty bound is NULL, and NULL means infinity.
    """
    if name == "japanese_holidays":
        schema = HOLIDAY_SCHEMA
        entries = (line.split() for line in JAPANESE_HOLIDAYS.strip().splitlines())
        rows = [(dt.date.fromisoformat(day), holiday) for day, holiday in entries]
    else:
        unit = name.removeprefix("band_")
        schema = band_schema(unit)
        rows = [row for row in BANDS if UNITS[row[0]] == unit]
    if folder is not None:
        return spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}.csv")
    return spark.createDataFrame(rows, schema)
