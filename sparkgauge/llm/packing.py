"""Packing of token pieces into sequences by patterns fitted with non-negative least squares.

Only the histogram of lengths decides how sequences are filled, so the fit costs the
same for any number of documents. All patterns of up to three lengths that fill a
sequence exactly are enumerated; an accelerated projected gradient finds non-negative
repeat counts whose pieces come closest to the histogram; the counts are rounded with
the rounding error carried on, as far as pieces of those lengths are left; what remains
is packed best fit, longest first, on the histogram. The plan is a list of runs
(length, first rank, count, sequence, offset), at most three for each pattern plus
those of the residue, whatever the size of the table.

Pieces get their rank among those of equal length from counts in deals of a bounded
number of rows, so no task holds all pieces of a length, even if they are one row that
repeats; a look-up in the plan gives the sequence. Pieces longer than the capacity are an error; cut them before
(``token_pieces`` does). A piece of length 0 takes part and needs no room. An empty
table gives no rows. Columns named like an output column are replaced.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from sparkgauge.llm.bpe import byte_alphabet
from sparkgauge.llm.common import add_columns, column, stored

CAPACITY = 2048
#: Pieces of a deal, about: those of one length are dealt out by a hash of the row's number.
DEAL_ROWS = 100_000
STEPS = 400

Run = tuple[int, int, int, int, int]


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of up to three of these lengths with sum ``capacity``, as rows padded with 0."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    found = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    small = lengths[(lengths > 0) & (lengths <= capacity // 2)]
    pairs = small[there[capacity - small]]
    found.append(np.stack([capacity - pairs, pairs, 0 * pairs], axis=1))
    for least in lengths[(lengths > 0) & (lengths <= capacity // 3)]:
        middle = lengths[(lengths >= least) & (lengths <= (capacity - least) // 2)]
        middle = middle[there[capacity - least - middle]]
        found.append(np.stack([capacity - least - middle, middle, np.full_like(middle, least)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x that bring the patterns' pieces close to the histogram.

    Errors count in proportion to length, since a long piece left over costs more room.
    """
    if not len(rows):
        return np.zeros(0)
    size = len(histogram)
    weight = np.arange(size) / size
    weight[0] = 0.0  # padding
    pieces = lambda x: sum(np.bincount(rows[:, k], x, size) for k in range(rows.shape[1]))
    back = lambda r: sum(r[rows[:, k]] for k in range(rows.shape[1]))
    square = weight * weight
    probe, bound = np.ones(len(rows)), 1.0
    for _ in range(20):  # largest eigenvalue, for the step length
        probe = back(square * pieces(probe))
        bound = float(np.linalg.norm(probe)) or 1.0
        probe /= bound
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0.0, y - back(square * (pieces(y) - histogram)) / (1.05 * bound))
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs for all pieces of the histogram (index: length) and the number of sequences."""
    left = histogram.astype(np.int64).copy()
    rank = np.zeros(capacity + 1, np.int64)
    runs: list[Run] = []
    sequences = 0

    def take(length: int, count: int, first: int, offset: int) -> None:
        if count:
            runs.append((length, int(rank[length]), count, first, offset))
            rank[length] += count
            left[length] -= count

    if capacity <= len(left) - 1 and left[capacity]:
        count = int(left[capacity])
        take(capacity, count, 0, 0)
        sequences += count
    rows = patterns(np.flatnonzero(left[1:] > 0) + 1, capacity)
    wanted = fit_counts(rows, left)
    carried = 0.0
    for i in np.argsort(-wanted, kind="stable"):
        carried += wanted[i]
        parts = [int(p) for p in rows[i] if p]
        count = int(carried)
        for p in set(parts):
            count = min(count, int(left[p]) // parts.count(p))
        if count > 0:
            carried -= count
            offset = 0
            for p in parts:
                take(p, count, sequences, offset)
                offset += p
            sequences += count
        carried = min(carried, 1.0)
    # Residue: groups of equally filled sequences by room left.
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, -1, -1):
        best = length
        while left[length]:
            while best <= capacity and not room[best]:
                best += 1
            if best > capacity:
                count = int(left[length])
                each = capacity // length if length else count
                first, whole = sequences, -(-count // each)
                room[capacity].append((first, whole))
                sequences += whole
                best = length
                continue
            first, count = room[best].pop()
            used = min(count, int(left[length]))
            if used < count:
                room[best].append((first + used, count - used))
            take(length, used, first, capacity - best)
            room[best - length].append((first, used))
            if length == 0:
                break
            if best - length >= length:  # now the tightest room that fits
                best -= length
    if left[0]:
        take(0, int(left[0]), 0, 0)
    return runs, max(sequences, 1 if histogram.sum() else 0)


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All rows with ``sequence_id`` and ``offset``. The rows are stored with numbers of their own first."""
    spark = pieces.sparkSession
    fields = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = stored(pieces.select(*map(column, fields)).withColumns({"__length": column(length), "__row": F.monotonically_increasing_id()}), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("__length").agg(F.count(F.lit(1)).alias("n")).collect():  # one row for each length
        if r["__length"] is None or not 0 <= r["__length"] <= capacity:
            raise ValueError(f"a piece has length {r['__length']}; cut pieces to at most {capacity}")
        histogram[r["__length"]] = r["n"]
    deals = F.array(*[F.lit(int(max(1, -(-n // DEAL_ROWS)))) for n in histogram])
    rows = rows.withColumn("__deal", F.pmod(F.xxhash64("__row"), F.get(deals, F.col("__length"))))
    counts = rows.groupBy("__length", "__deal").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__length").orderBy("__deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0))), "length-deals")
    runs, _ = plan(histogram, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    key = table[:, 0] << 40 | table[:, 1]
    shared = spark.sparkContext.broadcast((key, table[:, 1], table[:, 3], table[:, 4]))

    def make():
        keys, first, sequence, offset = shared.value

        def find(lengths: pa.Array, ranks: pa.Array):
            n, r = lengths.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, n << 40 | r, "right") - 1
            return [pa.array(sequence[at] + r - first[at]), pa.array(offset[at])]

        return find

    # A row for each length and for each DEAL_ROWS pieces; if too many to broadcast, shuffled by what the window needs anyway.
    placed = rows.join(bases.drop("n"), ["__length", "__deal"])
    nth = F.row_number().over(Window.partitionBy("__length", "__deal").orderBy("__row"))
    ranked = placed.withColumn("__rank", (F.col("__base") + nth - 1).cast("long"))
    return add_columns(ranked, ["__length", "__rank"], [("sequence_id", "long"), ("offset", "long")], make, fields)


# Fixed value: the word pattern of byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TextIds:
    """Ids of whole texts by a byte-level tokenizer file.

    A vocabulary numbered in the order of its merges, as such files are, is handed to
    the faster of the two libraries, which gives the ids that ``tokenizers`` gives;
    any other file is read by ``tokenizers`` itself, and so is a text on which the
    faster one gives up (its pattern can't cross about a million white space characters).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], {c: b for b, c in enumerate(byte_alphabet())}
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"]
        ordered = plain and all(vocab.get(a + b) == len(byte_of) + i for i, (a, b) in enumerate(merges))
        if ordered:
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token)}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {t: i for t, i in ranks.items() if i not in special.values()}
            fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.encode = lambda text: self._either(fast, text)
        else:
            self.encode = self._whole
        self.path, self.library = path, None

    def _whole(self, text: str) -> list[int]:
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    def _either(self, fast: tiktoken.Encoding, text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all", disallowed_special=())
        except ValueError as e:
            if "stack" not in str(e):
                raise
            return self._whole(text)

    def text(self, text: str) -> bytes:
        """Ids as 32-bit little-endian numbers."""
        return np.array(self.encode(text), "<i4").tobytes()


_LOADED: dict[str, TextIds] = {}


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every text: its ids by the tokenizer file at ``path``, then the id ``end``.

    ``ids`` holds 32-bit little-endian numbers. Only texts with more than ``capacity``
    ids are cut; the first piece takes what is over, the others are full. The file is
    read on the executors. Null text counts as empty and has the id ``end`` alone.
    """
    source = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    last = np.array([end], "<i4").tobytes()

    def make():
        if path not in _LOADED:
            _LOADED.clear()
            _LOADED[path] = TextIds(path)
        encoder = _LOADED[path]

        def cut(texts: pa.Array):
            made = []
            for t in texts.to_pylist():
                ids = (encoder.text(t) if t else b"") + last
                n = len(ids) // 4
                ends = list(range(n, 0, -capacity))[::-1]
                starts = [0, *ends[:-1]]
                made.append([{"piece": k, "start": a, "length": b - a, "ids": ids[4 * a:4 * b]} for k, (a, b) in enumerate(zip(starts, ends))])
            return [made]

        return cut

    kind = "array<struct<piece: int, start: long, length: long, ids: binary>>"
    return add_columns(source, ["text"], [("pieces", kind)], make, ["doc_id"]).select("doc_id", F.inline("pieces"))
