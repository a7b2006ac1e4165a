"""The generic ``events`` table read as device telemetry.

``events`` knows users and event types; the operators want reports, link events and
commands. These projections are deterministic and stay inside the scan. They keep every row of
the kind they speak of; only ``numbered_events`` leaves numbers out, as its holes are its subject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the adapter: constants for what the events table cannot supply.
MODEL = "everfrost"
BOOT_MICROS = 432_000_000_000
SETPOINT_MICROS = 21_600_000_000
CLOCK_ERROR_MICROS = 259_200_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table with its instant in microseconds and the number inside ``props``."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def reports(base: DataFrame) -> DataFrame:
    """One flat report per event: three devices, five-day boots, a clock wrong for a fifth."""
    return base.selectExpr(
        "event_id",
        "k",
        "concat('COOLER-', user_id % 3) as serial_number",
        f"concat('COOLER-', user_id % 3, '/b', us div {BOOT_MICROS}) as boot_id",
        f"((us % {BOOT_MICROS}) div 100000) / 10.0D + 100.0D as uptime_seconds",
        f"case when event_id % 5 = 0 then us - {CLOCK_ERROR_MICROS} else us end as ts_us",
        "event_id % 5 <> 0 as ts_synced",
        f"case when (us div {SETPOINT_MICROS}) % 2 = 0 then -20L else 0L end as setpoint_celsius",
        f"case when (us div {SETPOINT_MICROS}) % 2 = 0 then -20L else 0L end "
        "+ cast(floor(value) as bigint) % 12 as interior_temperature_celsius",
        "k as state_of_charge_percent",
        "case when event_type = 'purchase' then cast(floor(value) as bigint) % 100 else 0L end "
        "as input_watts",
        "case when event_type = 'click' then cast(floor(value) as bigint) % 60 else 0L end "
        "as charge_watts",
        "case when event_type = 'view' then cast(floor(value) as bigint) % 60 else 0L end "
        "as discharge_watts",
        "case when event_type = 'error' and k < 10 then 'absent' when event_type = 'click' then "
        "'charging' when event_type = 'view' then 'discharging' when event_type = 'purchase' "
        "then 'full' else 'idle' end as battery_state",
        "case when event_type = 'error' and k < 10 then null "
        "else concat('BATTERY-', user_id % 5) end as battery_serial_number",
        "case when event_id % 11 = 0 then null else 15D + value / 20D end "
        "as ambient_temperature_celsius",
    )


def raw_cooler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_cooler`` rows: every report, a fiftieth delivered twice, some without a serial."""
    once = reports(events(spark, sf_dir))
    again = once.filter("event_id % 50 = 0").withColumn(
        "ambient_temperature_celsius", F.col("ambient_temperature_celsius") + F.lit(1.0)
    )
    return once.unionByName(again).selectExpr(
        "timestamp_micros(ts_us) as ts",
        "uptime_seconds",
        "boot_id",
        "ts_synced",
        "'cooler' as type",
        f"'{MODEL}' as model",
        "serial_number as address",
        "'03010f' as pattern",
        "'4402' as cmd",
        "array(hex(event_id)) as frames",
        "hex(event_id) as plain",
        "named_struct('setpoint_celsius', setpoint_celsius, "
        "'interior_temperature_celsius', interior_temperature_celsius, 'display_unit', 'C', "
        "'input_watts', input_watts, 'usb_a_output_watts', 0L, 'usb_c_output_watts', 0L, "
        "'charge_watts', charge_watts, 'discharge_watts', discharge_watts, "
        "'battery_state', battery_state, 'state_of_charge_percent', state_of_charge_percent, "
        "'protection_level', 'M', 'brightness', 'mid', "
        "'serial_number', case when event_id % 101 = 0 then null else serial_number end, "
        "'battery_serial_number', battery_serial_number) as payload",
        "case when ambient_temperature_celsius is not null then named_struct('sensor', 'dht20', "
        "'temperature_celsius', ambient_temperature_celsius, 'humidity_percent', 50.0D) end "
        "as environment",
        "cast(null as string) as error",
    )


# Which of two copies of a report stays: compared column by column, NULL lowest, so that
# another engine can be asked the same question (row JSON spells numbers differently).
REPORT_ORDER = [
    "ts", "payload.setpoint_celsius", "payload.interior_temperature_celsius",
    "payload.state_of_charge_percent", "payload.input_watts", "payload.charge_watts",
    "payload.discharge_watts", "payload.battery_state", "payload.battery_serial_number",
    "environment.temperature_celsius",
]


def link_events(base: DataFrame) -> DataFrame:
    """Handshakes, sensor failures and numbered messages."""
    return base.selectExpr(
        "concat('COOLER-', user_id % 3) as serial_number",
        f"concat('COOLER-', user_id % 3, '/b', us div {BOOT_MICROS}) as boot_id",
        f"((us % {BOOT_MICROS}) div 100000) / 10.0D + 100.0D as uptime_seconds",
        "us as ts_us",
        "event_id % 5 <> 0 as ts_synced",
        "case when event_id % 97 = 0 then 'ble_negotiated' when event_type = 'error' "
        "then 'environment_read_failed' else 'message' end as kind",
        "case when event_id % 97 = 0 then 'ESP32' end as chip",
        "case when event_id % 97 = 0 then concat('1.', k % 3) end as firmware",
        "event_id as seq",
        "event_id div 1000 as session",
    )


def numbered_events(base: DataFrame) -> DataFrame:
    """The numbering as a gateway with losses leaves it: holes, and losses it reports itself."""
    return link_events(base.filter("event_id % 50 <> 7")).selectExpr(
        "session",
        "seq",
        "case when seq % 61 = 3 then 'dropped' else kind end as kind",
        "case when seq % 61 = 3 then seq % 7 + 1 end as count",
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``raw_events`` columns the staging models read."""
    return link_events(events(spark, sf_dir)).selectExpr(
        "timestamp_micros(ts_us) as ts",
        "uptime_seconds",
        "boot_id",
        "ts_synced",
        "kind",
        "serial_number as address",
        "chip",
        "firmware",
        "case when kind = 'ble_negotiated' then serial_number end as serial",
    )


HANDSHAKE_ORDER = ["ts", "firmware"]


def command_steps(base: DataFrame) -> DataFrame:
    """The steps of a command per signup: refused, carried out, or never confirmed."""
    asked = base.filter("event_type = 'signup'")
    step = (
        "explode(filter(array("
        "named_struct('kind', 'command_requested', 'after', 0L, 'error', cast(null as string), 'on', true),"
        "named_struct('kind', 'command_rejected', 'after', 100000L, 'error', 'busy', 'on', k < 20),"
        "named_struct('kind', 'command_sent', 'after', 100000L, 'error', cast(null as string), 'on', k >= 20),"
        "named_struct('kind', 'command_accepted', 'after', 200000L, 'error', cast(null as string),"
        " 'on', k >= 20 and k < 80),"
        "named_struct('kind', 'command_applied', 'after', 2600000L, 'error', cast(null as string),"
        " 'on', k >= 20 and k < 60),"
        "named_struct('kind', 'command_unconfirmed', 'after', 10000000L, 'error', 'no acknowledgement',"
        " 'on', k >= 80),"
        "named_struct('kind', 'command_unconfirmed', 'after', 10000000L, 'error',"
        " 'acknowledged, but no state report showed the value', 'on', k >= 60 and k < 80)"
        "), s -> s.on)) as step"
    )
    return asked.selectExpr("event_id", "user_id", "us", "k", step).selectExpr(
        "concat('c-', event_id) as command_id",
        "concat('COOLER-', user_id % 3) as serial_number",
        "step.kind as kind",
        "timestamp_micros(us + step.after) as ts",
        "step.error as error",
        "case when step.kind = 'command_requested' then 'setpoint_celsius' end as setting",
        "case when step.kind = 'command_requested' then cast(k % 2 * -20 as string) end as value",
    )


def link_states(base: DataFrame) -> DataFrame:
    """Links going up on a signup and down on an error."""
    return base.filter("event_type in ('signup', 'error')").selectExpr(
        "concat('COOLER-', user_id % 3) as serial_number",
        "timestamp_micros(us) as ts",
        "case when event_type = 'signup' then 'ble_connected' else 'ble_disconnected' end as kind",
    )


def envelopes(base: DataFrame) -> DataFrame:
    """Gateway events: numbered messages with payloads, a few undescribed, and losses."""
    return reports(base).selectExpr(
        "event_id as seq",
        "0 as connection",
        "timestamp_micros(ts_us) as ts",
        "case when event_id % 41 = 0 then null else uptime_seconds end as uptime_seconds",
        "boot_id",
        "ts_synced",
        "case when event_id % 43 = 0 then 'dropped' when battery_state = 'absent' then "
        "'ble_silent' else 'message' end as kind",
        f"'{MODEL}' as model",
        "serial_number as address",
        "array(hex(event_id)) as frames",
        "named_struct('setpoint_celsius', setpoint_celsius, "
        "'interior_temperature_celsius', interior_temperature_celsius, 'display_unit', 'C', "
        "'input_watts', input_watts, 'usb_a_output_watts', 0L, 'usb_c_output_watts', 0L, "
        "'charge_watts', charge_watts, 'discharge_watts', discharge_watts, "
        "'battery_state', case when event_id % 47 = 0 then 'melted' else battery_state end, "
        "'state_of_charge_percent', state_of_charge_percent, 'protection_level', 'M', "
        "'brightness', 'mid', 'serial_number', case when event_id % 53 = 0 then null else "
        "serial_number end, 'battery_serial_number', battery_serial_number) as payload",
        "case when event_id % 43 = 0 then k end as count",
    )


def pushed_signals(base: DataFrame) -> DataFrame:
    """Push envelopes with signals inside, a tenth of them unreadable for some reason."""
    body = (
        "case when event_id % 2 = 0 then to_json(named_struct('event', 'semantic_updated', 'run_id', "
        "concat('r-', event_id div 4), 'published_at', '2024-02-01T00:00:00Z', 'rows_arrived', k, "
        "'build_passed', true, 'extra', 1)) else to_json(named_struct('event', 'quality_report', "
        "'run_id', concat('r-', event_id div 4), 'published_at', '2024-02-01T00:00:00Z', "
        "'contract_id', concat('contract-', event_id % 4), 'passed', k >= 50, 'failed_checks', "
        "case when k < 50 then array('a', 'b') else array() end)) end"
    )
    broken = (
        "case event_id % 70 when 0 then '{\"event\":\"other\"}' when 7 then '[1,2]' "
        "when 14 then '{\"event\":\"quality_report\",\"run_id\":\"r\"}' when 21 then '{\"event\":' "
        "else body end"
    )
    return (
        base.selectExpr("event_id", f"{body} as body")
        .selectExpr("event_id", f"base64(cast({broken} as binary)) as data")
        .selectExpr(
            "event_id",
            "to_json(named_struct('message', named_struct('data', case when event_id % 70 = 28 "
            "then concat(data, '!') else replace(data, '\\r\\n', '') end, 'messageId', "
            "cast(event_id as string)), 'subscription', 's')) as value",
        )
    )


def chunk_lines(base: DataFrame) -> DataFrame:
    """Lines as they lie in a chunk: records, and what a power cut leaves behind."""
    whole = (
        "concat('{\"ts\":\"2024-01-01T00:00:00.000001Z\",\"uptime_seconds\":', k, "
        "',\"boot_id\":\"b-', event_id % 7, '\",\"kind\":\"', event_type, '\",\"later\":[1,2]}')"
    )
    return base.selectExpr(
        "event_id",
        f"case event_id % 20 when 3 then '' when 5 then '   ' when 7 then '[1,2]' when 9 then '17' "
        f"when 11 then 'null' when 13 then substring({whole}, 1, length({whole}) - 9) "
        f"when 15 then repeat(char(0), 8) when 17 then concat({whole}, '}}') else {whole} end as value",
    )
