"""URL rules looked up in sorted digest arrays on disk.

The rules are stored as files of 64-bit XXH64 digests in ascending order, with the full
rule strings behind them. Tasks write them, each the rules of one range of digests, about
``SEGMENT_RULES`` of them, into the shared folder; the driver only names the files.
Executors get them through Spark's file service and map them into memory, so an index
larger than memory still works. A url's possible rules are its host's last labels, as many
as some rule has, with every prefix of the path that has the length of such a rule's path;
they are hashed and found by a vectorised binary search, and a hit counts only if the
stored string is the same. So a host of very many labels costs no more than a common one.

Null urls and urls without ``://`` have empty host and path and fit no rule. Repeated
rules count once, and of two verdicts for one rule "block" holds. Rules of equal length
that fit one url: the one with the longer host. Urls that fit no rule are allowed: an
entry that the array lacks is not listed. Columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.llm.common import add_columns, column, scratch, stored

SEED = 42
#: Rules in one file of the index, about; what a task holds at once while it writes it.
SEGMENT_RULES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url as strings that are never null."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Index:
    """Names of the files, and the different (labels of the host, bytes of the path) that rules have."""

    names: tuple[str, ...]
    shapes: tuple[tuple[int, int], ...]


def build_index(rules: DataFrame, rule: str = "rule", verdict: str = "verdict", segment_rules: int = SEGMENT_RULES) -> Index:
    """Write the index of rules like ``example.com/en/`` and hand its files to the executors."""
    spark = rules.sparkSession
    listed = (rules.select(column(rule).alias("rule"), column(verdict).alias("verdict")).filter("rule is not null")
              .groupBy("rule").agg(F.max("verdict").alias("verdict")))
    host = F.substring_index("rule", "/", 1)
    listed = stored(listed.select("rule", "verdict", F.xxhash64("rule").bitwiseXOR(F.lit(-(1 << 63))).alias("place"),  # XXH64 of the UTF-8 bytes, seed 42; rises with it
                                  F.size(F.split(host, r"\.")).alias("labels"), (F.octet_length("rule") - F.octet_length(host)).alias("path_bytes")), "url-rules")
    shapes = tuple(sorted((r["labels"], r["path_bytes"]) for r in listed.select("labels", "path_bytes").distinct().collect()))
    segments = max(1, math.ceil(listed.count() / segment_rules))
    content = listed.repartitionByRange(segments, "place").sortWithinPartitions("place").select("rule", "verdict").mapInArrow(_segments, "content binary")
    path = scratch(spark, "url-segments")
    # A text file of one line: the bytes as they are, and a line feed that nothing reads.
    content.select(F.col("content").cast("string").alias("value")).write.text(path)
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    for file in files:
        spark.sparkContext.addFile(file)
    return Index(tuple(file.rsplit("/", 1)[1] for file in files), shapes)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the file's bytes: count, sorted digests, string ends, verdicts, strings."""
    texts, flags = [], []
    for batch in batches:
        texts += [r.encode() for r in batch.column(0).to_pylist()]
        flags += [VERDICTS.index(v) for v in batch.column(1).to_pylist()]
    if texts:
        keys = np.array([xxhash.xxh64_intdigest(x, SEED) for x in texts], np.uint64)
        ends = np.cumsum([0, *map(len, texts)]).astype(np.uint64)
        whole = b"".join([np.uint64(len(texts)).tobytes(), keys.tobytes(), ends.tobytes(), np.array(flags, np.uint8).tobytes(), *texts])
        yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["content"])


class Segment:
    """A mapped file of the index."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int(whole[:8].view(np.uint64)[0])
        self.keys = whole[8:8 + 8 * n].view(np.uint64)
        self.ends = whole[8 + 8 * n:16 + 16 * n].view(np.uint64)
        self.flags = whole[16 + 16 * n:16 + 17 * n]
        self.texts = whole[16 + 17 * n:]

    def text(self, i: int) -> bytes:
        return self.texts[int(self.ends[i]):int(self.ends[i + 1])].tobytes()

    def find(self, digests: np.ndarray, strings: Sequence[bytes]) -> np.ndarray:
        """Place of each string in the array, or -1."""
        at = np.searchsorted(self.keys, digests)
        found = np.full(len(digests), -1)
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_):
            open_ = open_[self.keys[at[open_]] == digests[open_]]
            same = np.array([self.text(at[i]) == strings[i] for i in open_], bool)
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1  # another string with the same digest may follow
            open_ = open_[at[open_] < len(self.keys)]
        return found


def candidates(host: str, path: bytes, shapes: Sequence[tuple[int, int]]) -> list[tuple[bytes, int]]:
    """(rule string, bytes of its host) of all rules of these shapes that could fit."""
    if not host or not shapes:
        return []
    most = max(n for n, _ in shapes)
    parts = host.rsplit(".", most)
    labels = len(parts) if len(parts) <= most else most
    domains = {n: ".".join(parts[-n:]).encode() for n in {n for n, _ in shapes} if n <= labels}
    return [(domains[n] + path[:size], len(domains[n])) for n, size in shapes if n <= labels and size <= len(path)]


def judge(df: DataFrame, index: Index, url: str = "url", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` to rows with a url."""
    host, path = host_and_path(column(url))
    split = df.withColumns({"host": host, "path": path})
    kept = None if keep is None else [*keep, "host", "path"]

    def make():
        segments = [Segment(SparkFiles.get(n)) for n in index.names]

        def find(hosts: pa.Array, paths: pa.Array):
            owner, strings, host_bytes = [], [], []
            for i, (h, p) in enumerate(zip(hosts.to_pylist(), paths.to_pylist())):
                for string, size in candidates(h, p.encode(), index.shapes):
                    strings.append(string)
                    host_bytes.append(size)
                    owner.append(i)
            digests = np.array([xxhash.xxh64_intdigest(s, SEED) for s in strings], np.uint64)
            best: dict[int, tuple[int, int, str, str]] = {}
            for segment in segments:
                found = segment.find(digests, strings)
                for j in np.flatnonzero(found >= 0):
                    hit = (len(strings[j].decode()), host_bytes[j], strings[j].decode(), VERDICTS[segment.flags[found[j]]])
                    best[owner[j]] = max(best.get(owner[j], hit), hit)
            none = (0, 0, None, "allow")
            return [[best.get(i, none)[k] for i in range(len(hosts))] for k in (2, 3)]

        return find

    return add_columns(split, ["host", "path"], [("rule", "string"), ("verdict", "string")], make, kept)
