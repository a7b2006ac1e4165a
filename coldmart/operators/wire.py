"""Batch jobs over archived message bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from coldmart.functions import parameters, wire
from coldmart.functions.rows import computed


def backfill_payload(raw: DataFrame) -> DataFrame:
    """``raw`` with ``payload`` decoded anew from ``plain`` for state reports.

    A body that cannot be read gets a NULL payload and a ``payload_error``; the bytes stay.
    Rows of other commands keep the payload they have.
    """
    is_state = F.col("cmd").isin(*wire.STATE_COMMANDS)
    bodies = computed(raw, _hex=wire.clean_hex(F.when(is_state, F.col("plain"))))
    coded = computed(bodies, _codes=wire.byte_codes(F.col("_hex")))
    parsed = computed(coded, _tlv=wire.parse_parameters(F.col("_codes")))
    found = computed(parsed, **wire.state_fields(F.col("plain"), F.col("_tlv")))
    read = computed(found, payload_error=F.when(is_state, wire.state_fault()))
    decoded = F.when(F.col("payload_error").isNull(), wire.state_payload())
    return read.withColumn(
        "payload", F.when(is_state, decoded).otherwise(F.col("payload"))
    ).select(*raw.columns, "payload_error")


def explode_tlv(raw: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """One row per parameter of any message, with the readings its bytes allow.

    Bodies in the clear are read as they are, others from their joined notifications. Numbers of
    any length are decimal text. A message that cannot be read is one row that says why in
    ``error`` and has no key; one without parameters is no row. ``carry`` names the columns of
    ``raw`` that go with each parameter, all of them if it is not given.
    """
    carry = list(raw.columns if carry is None else carry)
    # Notifications are looked at only where there is no body in the clear.
    clear = F.coalesce(F.length("plain") > 0, F.lit(False))
    framed = computed(raw, _frames=F.transform(F.when(~clear, F.col("frames")), wire.clean_hex))
    status = computed(framed, _status=wire.message_status(F.col("_frames")))
    body = F.when(clear, wire.clean_hex(F.col("plain"))).when(
        F.col("_status") == "ok", wire.joined_payload(F.col("_frames"))
    )
    bodies = computed(status, _body=body)
    fault = F.when(clear & F.col("_body").isNull(), "not_hex").when(
        ~clear & (F.col("_status") != "ok"), F.col("_status")
    )
    given = bodies.select(F.unhex("_body").alias("_body"), fault.alias("_fault"), *carry)
    result = T.StructType([*given.schema.fields[2:], *T.StructType.fromDDL(parameters.READINGS)])
    schema = to_arrow_schema(result)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            message, readings = parameters.readings(batch.column(0), batch.column(1))
            carried = [column.take(message) for column in batch.columns[2:]]
            columns = [*carried, *readings]
            yield pa.RecordBatch.from_arrays(
                [column.cast(field.type) for column, field in zip(columns, schema)], schema=schema
            )

    return given.mapInArrow(read, result)


def audit_frames(raw: DataFrame) -> DataFrame:
    """How many messages arrived whole, and what was wrong with the rest."""
    cleaned = computed(
        raw.select("frames"), _frames=F.transform("frames", wire.clean_hex), n=F.size("frames")
    )
    return (
        computed(cleaned, status=wire.message_status(F.col("_frames")))
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("messages"),
            F.sum(F.greatest(F.col("n"), F.lit(0))).cast("bigint").alias("notifications"),
        )
    )
