"""Parameters of message bodies, many bodies at once: where they lie and what their bytes may mean.

Works on Arrow columns inside a task. The walk over the bodies goes one parameter a step for all
of them together; equal parameters, as most are, are read once.
"""

from __future__ import annotations

import functools
import math
import re
import struct

import numpy as np
import pyarrow as pa

# Type bytes and the reading each suggests for an unknown parameter.
TEXT, U8, I16, F32 = 0x00, 0x01, 0x02, 0x05

REMEMBERED = 1 << 16  # readings a worker keeps

READINGS = (
    "error string, prefix boolean, key string, type_byte string, length bigint, hex string, "
    "uint_le string, int_le string, value_hex string, value_uint_le string, i16 bigint, u8 bigint, "
    "f32 double, text string, ascii string"
)
_READING_TYPES = [
    pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(),
    pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string(),
]

_KEYS = pa.array([f"{k:02X}" for k in range(256)])
_PRINTABLE = re.compile(rb"[ -~]+")


@functools.lru_cache(maxsize=REMEMBERED)
def reading(body: bytes) -> tuple:
    """What one parameter's bytes may mean; numbers are little-endian, of any length.

    A body longer than one byte starts with a type byte, and its value follows. Infinities and
    NaN are no reading; what is no UTF-8 shows as U+FFFD.
    """
    kind, value = (body[0], body[1:]) if len(body) > 1 else (None, None)
    single = struct.unpack("<f", value)[0] if kind == F32 and len(value) == 4 else None
    return (
        None if kind is None else f"{kind:02X}",
        len(body),
        body.hex().upper(),
        str(int.from_bytes(body, "little")),
        str(int.from_bytes(body, "little", signed=True)),
        None if kind is None else value.hex().upper(),
        None if kind is None else str(int.from_bytes(value, "little")),
        int.from_bytes(value, "little", signed=True) if kind == I16 and len(value) == 2 else None,
        value[0] if kind == U8 and len(value) == 1 else None,
        single if single is not None and math.isfinite(single) else None,
        value.decode("utf-8", "replace") if kind == TEXT else None,
        body.decode("ascii") if _PRINTABLE.fullmatch(body) else None,
    )


def lay_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (message, key, start, count) of all parameters in order, and a fault for each message.

    Faults are numbers: 0 none, 1 a parameter without its length, 2 one that is cut short. A
    message with a fault has no rows.
    """
    at = starts + ((ends > starts) & (np.append(data, 1)[starts] == 0))
    fault = np.zeros(len(starts), np.int8)
    open_, found = np.flatnonzero(at < ends), []
    while len(open_):
        here, end = at[open_], ends[open_]
        headless = here + 2 > end
        count = np.where(headless, 0, data[np.minimum(here + 1, len(data) - 1)].astype(np.int64))
        cut = ~headless & (here + 2 + count > end)
        fault[open_] = np.where(headless, 1, np.where(cut, 2, 0))
        sound = ~headless & ~cut
        open_, here, count = open_[sound], here[sound], count[sound]
        found.append(np.stack([open_, data[here], here + 2, count], axis=1))
        at[open_] = here + 2 + count
        open_ = open_[at[open_] < ends[open_]]
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[fault[rows[:, 0]] == 0]
    return rows[np.argsort(rows[:, 0], kind="stable")], fault


_FAULTS = np.array([None, "truncated_parameter", "parameter_past_end"], object)


def readings(bodies: pa.Array, faults: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """For each row its message's place in the batch, and the columns of ``READINGS``.

    ``faults`` say why a body cannot be had; such a message, as one whose parameters do not fit,
    is one row that has nothing but ``error``.
    """
    bodies = bodies.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    raw = (bodies.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    data = np.frombuffer(raw, np.uint8)
    rows, fault = lay_out(data, offsets[:-1].copy(), offsets[1:].copy())
    errors = np.array(faults.to_pylist(), object)
    errors = np.where(errors == None, _FAULTS[fault], errors)  # noqa: E711
    bad = np.flatnonzero(errors != None)  # noqa: E711
    read = list(zip(*[reading(raw[a : a + n]) for a, n in rows[:, 2:].tolist()]))
    columns = [pa.array(values, t) for values, t in zip(read or [()] * 12, _READING_TYPES)]
    first = np.append(data, 1)[offsets[:-1]]
    sound = [
        pa.nulls(len(rows), pa.string()),
        pa.array((first == 0)[rows[:, 0]]),
        _KEYS.take(pa.array(rows[:, 1])),
        *columns,
    ]
    broken = [pa.array(errors[bad].tolist(), pa.string()), *[pa.nulls(len(bad), c.type) for c in sound[1:]]]
    message = pa.array(np.concatenate([rows[:, 0], bad]))
    return message, [pa.concat_arrays(pair) for pair in zip(sound, broken)]
