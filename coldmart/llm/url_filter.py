"""Judge urls by a list of rules in a sorted digest array.

The index is one file: the 64-bit xxhash keys of all rules in order, where each rule's string
lies, and the strings. It is written to the shared folder and handed to the executors as a file
of the application, so a replaced executor fetches it again; tasks map it into memory and share
its pages. A url asks for every suffix of its host with every prefix of its path that is as long
as some rule's path. All questions of a batch are answered by one vectorised binary search, and
a digest that is met counts only if the stored string is the same; rules with equal digests lie
side by side and are all looked at. The rules are the caller's list; urls never leave their task.

Defined cases: the longest rule wins, of equally long ones that with the longer host; of equal
rules the last; no rule leaves ``rule`` null and gives the default verdict; a url that is null or
has no ``://`` has an empty host and path, which no rule fits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldmart.llm import scratch
from coldmart.llm.text import ascii_lower

Rule = tuple[str, str, str]  # host, path prefix, verdict


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


class DigestArray:
    """The index over a block of bytes, mapped or not."""

    def __init__(self, data: np.ndarray) -> None:
        n, paths, heap = (int(x) for x in data[:24].view(np.uint64))
        at, parts = 24, []
        for count, kind in ((n, np.uint64), (n + 1, np.uint64), (paths, np.uint64), (n, np.uint8), (heap, np.uint8)):
            size = count * np.dtype(kind).itemsize
            parts.append(data[at : at + size].view(kind))
            at += size
        self.digests, self._ends, paths, self._verdicts, self._heap = parts
        self.path_lengths = paths.tolist()

    @staticmethod
    def dump(rules: Iterable[Rule], hashed=digest) -> bytes:
        last = {(host + path).encode(): (len(path), verdict) for host, path, verdict in rules}
        keys = sorted(last, key=lambda key: (hashed(key), key))
        verdicts = np.array([last[k][1] == "block" for k in keys], np.uint8)
        paths = np.array(sorted({length for length, _ in last.values()}), np.uint64)
        heap = b"".join(keys)
        return b"".join(
            x.tobytes()
            for x in (
                np.array([len(keys), len(paths), len(heap)], np.uint64),
                np.array([hashed(k) for k in keys], np.uint64),
                np.cumsum([0, *(len(k) for k in keys)]).astype(np.uint64),
                paths,
                verdicts,
                np.frombuffer(heap, np.uint8),
            )
        )

    def find(self, keys: list[bytes], hashed=digest) -> np.ndarray:
        """The place of each key in the array, or -1."""
        if not len(self.digests) or not keys:
            return np.full(len(keys), -1)
        wanted = np.array([hashed(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, wanted)
        out = np.full(len(keys), -1)
        left = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == wanted))
        for k in left.tolist():
            place = int(at[k])
            while place < len(self.digests) and self.digests[place] == wanted[k]:
                if self._heap[int(self._ends[place]) : int(self._ends[place + 1])].tobytes() == keys[k]:
                    out[k] = place
                    break
                place += 1
        return out

    def verdict(self, place: int) -> str:
        return "block" if self._verdicts[place] else "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    rest = F.when(F.contains(url, F.lit("://")), after).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def questions(host: str, path: str, lengths: list[int]) -> list[tuple[str, str]]:
    """Every (host, path) of a rule that would fit, the ones that win first."""
    if not host:
        return []
    parts = host.split(".")
    suffixes = [".".join(parts[k:]) for k in range(len(parts))]
    asked = [(h, path[:n]) for h in suffixes if h for n in lengths if n <= len(path)]
    return sorted(asked, key=lambda q: (-len(q[0]) - len(q[1]), -len(q[0])))


def publish(spark: SparkSession, rules: Iterable[Rule]) -> str:
    """Write the index to the shared folder, hand it to the executors; its name there."""
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    path = f"{scratch.folder(spark)}/{name}"
    scratch.write_bytes(spark, path, DigestArray.dump(rules))
    spark.sparkContext.addFile(path)
    return name


def judge(
    urls: DataFrame, rules: Iterable[Rule], default: str = "allow", key: str = "page_id", url: str = "url"
) -> DataFrame:
    """``id, host, path, rule, verdict`` for every row."""
    name = publish(urls.sparkSession, rules)
    host, path = host_and_path(F.coalesce(F.col(url), F.lit("")))
    parsed = urls.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))

    def judged(batches):
        index = DigestArray(np.memmap(SparkFiles.get(name), np.uint8, "r"))
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            asked = [questions(h, p, index.path_lengths) for h, p in zip(hosts, paths)]
            places = iter(index.find([(h + p).encode() for q in asked for h, p in q]).tolist())
            rule, verdict = [], []
            for row in asked:
                met = [(q, place) for q, place in zip(row, places) if place >= 0] if row else []
                rule.append("".join(met[0][0]) if met else None)
                verdict.append(index.verdict(met[0][1]) if met else default)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["id", "host", "path", "rule", "verdict"],
            )

    kind = parsed.schema["id"].dataType.simpleString()
    return parsed.mapInArrow(judged, f"id {kind}, host string, path string, rule string, verdict string")
