"""Alignment of two tokenizers' tokens by products of token-byte incidence matrices.

For each document the matrix A has a row for each token of the first tokenizer and a
column for each byte, B the same for the second, both as compressed sparse rows made by
hand. Gustavson's row products A·Bᵀ give the overlap links: which tokens share bytes and
how many. Links in row order step by one token at a time on one side, or on both where
both tokens end at one byte: there a group ends. The incidence of token ids and groups,
multiplied the same way, gives the shared-group links: how often each pair of ids lies in
one group. Matrices of many documents are block diagonal and multiplied together, a
bounded number of products at a time.

How many documents hold a pair linked is counted over the corpus. Counts of the
``COMMON`` pairs that most documents hold go to every task (their number is fixed), all
other pairs are joined by a shuffle, so no row is left out.

A text without tokens (null, empty, or not given back in full by the bytes of its tokens)
has zeros and the empty string. An empty table gives no rows. Repeated ids are separate
rows. Columns named like an output are replaced, others come along if named in ``keep``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from sparkgauge.llm.bpe import byte_alphabet
from sparkgauge.llm.common import column, stored
from sparkgauge.llm.packing import PATTERN

#: Bytes of text whose matrices are multiplied together, at least; and products worked out at once.
BLOCK_BYTES, BLOCK_PRODUCTS = 1 << 19, 1 << 21
#: Pairs whose counts every task holds.
COMMON = 1 << 17
#: Texts longer than this are read by the second tokenizer in stretches that end where no token can go on.
STRETCH = 1 << 15
SPACE = "▁"
#: A pair of ids as one number: first id times this, plus second id.
PAIR = 1 << 31


class ByteLevel:
    """Ids and token bytes of a byte-level tokenizer file; special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special]))
        for token, i in spec["model"]["vocab"].items():
            if i not in special:
                self.bytes[i] = bytes(byte_of[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ordered = all(spec["model"]["vocab"].get(a + b) == len(byte_of) + i for i, (a, b) in enumerate(merges))
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        # Of a vocabulary numbered by its merges the ranks are the ids, and the faster library gives the same ids.
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes) if i not in special}, special_tokens={}) if ordered and plain else None
        self.path, self.library = path, None

    def encode(self, text: str) -> list[int]:
        if self.fast:
            try:
                return self.fast.encode_ordinary(text)
            except ValueError as e:  # a run of about a million white space characters
                if "stack" not in str(e):
                    raise
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids and token bytes of a sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        byte = spec.SentencePiece.BYTE
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == byte else p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
        # Cutting before a blank is safe if no piece has a blank behind another character, and blanks stay as they are.
        rule = spec.normalizer_spec
        self.cuts = (not any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces) and rule.add_dummy_prefix and not rule.remove_extra_whitespaces
                     and not rule.precompiled_charsmap and spec.trainer_spec.model_type == spec.trainer_spec.BPE)

    def encode(self, text: str) -> list[int]:
        if len(text) <= STRETCH or not self.cuts:
            return self.model.encode(text, num_threads=1)
        ids, start = [], 0
        for stop in self._stops(text):
            ids += self.model.encode(text[start:stop], num_threads=1)
            start = stop + 1  # the blank comes back as the stretch's own
        return ids + self.model.encode(text[start:], num_threads=1)

    @staticmethod
    def _stops(text: str) -> Iterator[int]:
        """Blanks about ``STRETCH`` characters apart, behind a character that is none and before the last one."""
        boundary, at = re.compile(f"[^ {SPACE}] (?=.)", re.S), STRETCH
        while (found := boundary.search(text, at)) is not None:
            yield found.end() - 1
            at = found.end() + STRETCH


_LOADED: dict[str, ByteLevel | Pieces] = {}


def _tokenizer(path: str) -> ByteLevel | Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path) if path.endswith(".model") else ByteLevel(path)
    return _LOADED[path]


@dataclass
class Sparse:
    """A matrix in compressed sparse rows: row i has columns ``index[start[i]:start[i + 1]]`` with those values."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray
    columns: int

    @classmethod
    def of(cls, rows: np.ndarray, index: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> Sparse:
        """From entries in row order."""
        return cls(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=shape[0]))]), index, value, shape[1])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def gustavson(a: Sparse, b: Sparse) -> Sparse:
    """The product a·b: each entry (i, k) of ``a`` brings row k of ``b`` into row i, equal columns add up.

    Rows are taken in stretches of about ``BLOCK_PRODUCTS`` products; columns of a row come out in ascending order.
    """
    sizes = np.diff(b.start)[a.index]
    before = np.concatenate([[0], np.cumsum(sizes)])[a.start]
    starts, indexes, values, row, n = [np.zeros(1, np.int64)], [], [], 0, len(a.start) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(before, before[row] + BLOCK_PRODUCTS, "right")) - 1)
        span = slice(a.start[row], a.start[stop])
        inner, much = a.index[span], sizes[span]
        at = _ranges(b.start[inner], much)
        columns, products = b.index[at], np.repeat(a.value[span], much) * b.value[at]
        key = np.repeat(np.repeat(np.arange(stop - row), np.diff(a.start[row:stop + 1])), much) * b.columns + columns
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, products = key[order], products[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        indexes.append(key[first] % b.columns)
        values.append(np.add.reduceat(products, first) if len(first) else products)
        starts.append(starts[-1][-1] + np.cumsum(np.bincount(key[first] // b.columns, minlength=stop - row)))
        row = stop
    empty = [np.zeros(0, np.int64)]
    return Sparse(np.concatenate(starts), np.concatenate(indexes or empty), np.concatenate(values or empty), b.columns)


def incidence(lengths: np.ndarray) -> Sparse:
    """Tokens by bytes, of tokens that follow each other."""
    total = int(lengths.sum())
    return Sparse(np.concatenate([[0], np.cumsum(lengths)]), np.arange(total), np.ones(total, np.int32), total)


def transposed(lengths: np.ndarray) -> Sparse:
    """Bytes by tokens: each byte is in one token."""
    total = int(lengths.sum())
    return Sparse(np.arange(total + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(total, np.int32), len(lengths))


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[Sparse, np.ndarray]:
    """Shared bytes of tokens with these lengths over the same bytes (A·Bᵀ), and the group of each link."""
    links = gustavson(incidence(a), transposed(b))
    both = (np.diff(links.rows()) == 1) & (np.diff(links.index) == 1)
    return links, np.concatenate([[0], np.cumsum(both)]) if len(links.index) else np.zeros(0, np.int64)


def _by_group(doc: np.ndarray, ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, id) in order; and entries (its number, group, count) of their incidence with groups, in that order."""
    order = np.lexsort((group, ids, doc))
    d, i, g = doc[order], ids[order], group[order]
    own = np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1])])
    entry = own | np.concatenate([[True], g[1:] != g[:-1]])
    first = np.flatnonzero(entry)
    count = np.diff(np.concatenate([first, [len(d)]]))
    keys = np.stack([d[own], i[own]])
    return keys, (np.cumsum(own) - 1)[first], g[first], count


def shared_groups(doc_a: np.ndarray, ids_a: np.ndarray, group_a: np.ndarray, doc_b: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray,
                  n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first id, second id, times linked) of all pairs of ids, by documents and ids."""
    keys_a, row, group, count = _by_group(doc_a, ids_a, group_a)
    left = Sparse.of(row, group, count, (keys_a.shape[1], n_groups))
    keys_b, row, group, count = _by_group(doc_b, ids_b, group_b)
    order = np.argsort(group, kind="stable")
    right = Sparse.of(group[order], row[order], count[order], (n_groups, keys_b.shape[1]))
    product = gustavson(left, right)
    rows = product.rows()
    return keys_a[0][rows], keys_a[1][rows], keys_b[1][product.index], product.value


class Aligner:
    """Tokens, groups and links of texts by two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _tokenizer(path_a), _tokenizer(path_b)
        self.sizes = [np.array([len(t) for t in tokens.bytes], np.int64) for tokens in (self.a, self.b)]
        n = max(map(len, self.sizes))
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(n)]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids on both sides; none where the joined bytes of a side differ from a blank and the text."""
        if text:
            whole = " " + text
            raw, a, b = whole.encode(), self.a.encode(whole), self.b.encode(text)
            if b"".join(map(self.a.bytes.__getitem__, a)) == raw and b"".join(map(self.b.bytes.__getitem__, b)) == raw:
                return np.array(a, np.int64), np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def align(self, tokens: Sequence[tuple[np.ndarray, np.ndarray]]) -> dict:
        """Overlap links, groups and tokens of all texts, one block after the other."""
        n_a, n_b = (np.array([len(t[side]) for t in tokens], np.int64) for side in (0, 1))
        ids_a, ids_b = (np.concatenate([t[side] for t in tokens]) for side in (0, 1))
        links, group = overlaps(self.sizes[0][ids_a], self.sizes[1][ids_b])
        group_b = np.zeros(len(ids_b), np.int64)
        group_b[links.index] = group
        return {"n_a": n_a, "n_b": n_b, "ids_a": ids_a, "ids_b": ids_b, "links": links, "link_group": group,
                "group_a": group[links.start[:-1]] if len(group) else np.zeros(0, np.int64), "group_b": group_b,
                "doc_a": np.repeat(np.arange(len(tokens)), n_a), "doc_b": np.repeat(np.arange(len(tokens)), n_b)}

    def facts(self, tokens: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each text."""
        m, n = self.align(tokens), len(tokens)
        total = int(m["link_group"][-1]) + 1 if len(m["link_group"]) else 0
        if not total:
            zero, none = pa.array(np.zeros(n, np.int64)), pa.array([[]] * n, pa.list_(pa.int64()))
            return [zero, zero, zero, zero, pa.array([""] * n), none, none.cast(pa.list_(pa.int32()))]
        last = np.maximum(np.cumsum(m["n_a"]) - 1, 0)
        groups = np.where(m["n_a"] > 0, np.diff(np.concatenate([[0], np.maximum.accumulate(np.where(m["n_a"] > 0, m["group_a"][last] + 1, 0))])), 0)
        doc, a, b, times = shared_groups(m["doc_a"], m["ids_a"], m["group_a"], m["doc_b"], m["ids_b"], m["group_b"], total)
        links = np.bincount(doc, weights=times, minlength=n).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
        pairs = pa.ListArray.from_arrays(pa.array(ends), pa.array(a * PAIR + b))
        return [*map(pa.array, (m["n_a"], m["n_b"], groups, links)), pa.array(self._written(m, n)), pairs,
                pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32)))]

    def _written(self, m: dict, n: int) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text with tokens."""
        ids, group = np.concatenate([m["ids_a"], m["ids_b"]]), np.concatenate([m["group_a"], m["group_b"]])
        side = np.repeat([0, 1], [len(m["ids_a"]), len(m["ids_b"])])
        order = np.argsort(2 * group + side, kind="stable")
        ids, place = ids[order], (2 * group + side)[order]
        ends = np.concatenate([place[1:] != place[:-1], [True]])
        marks = np.where(ends, 1 + place % 2, 0)
        words = list(map(self.written.__getitem__, (ids + marks * (len(self.written) // 3)).tolist()))
        stops = np.cumsum(m["n_a"] + m["n_b"]).tolist()
        out, at = [], 0
        for stop in stops:
            out.append(hashlib.sha256("".join(words[at:stop])[:-1].encode()).hexdigest() if stop > at else "")
            at = stop
        return out


def _blocks(batch: pa.RecordBatch, texts: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batch with about ``BLOCK_BYTES`` of text, and their texts."""
    start, held, size = 0, [], 0
    for i, value in enumerate(batch.column(texts)):
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size >= BLOCK_BYTES:
            yield batch.slice(start, i + 1 - start), held
            start, held, size = i + 1, [], 0
    if held:
        yield batch.slice(start), held


def _mapped(docs: DataFrame, text: str, keep: Sequence[str], schema: T.StructType, paths: tuple[str, str], make: Callable) -> DataFrame:
    source = docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)], column(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        for batch in batches:
            for part, texts in _blocks(batch, len(keep)):
                yield make(aligner, part, list(map(aligner.tokens, texts)))

    return source.mapInArrow(run, schema)


def overlap_links(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each pair of tokens that share bytes: ``keep``, a_at, b_at (places in the text), a_id, b_id, n_bytes, group_at."""
    names = [c for c in keep if c not in ("a_at", "b_at", "a_id", "b_id", "n_bytes", "group_at")]
    added = [T.StructField(n, T.LongType()) for n in ("a_at", "b_at", "a_id", "b_id", "n_bytes", "group_at")]

    def make(aligner: Aligner, part: pa.RecordBatch, tokens: list) -> pa.RecordBatch:
        m = aligner.align(tokens)
        rows, at, group = m["links"].rows(), m["links"].index, m["link_group"]
        doc = m["doc_a"][rows]
        first = [np.concatenate([[0], np.cumsum(m[n])])[doc] for n in ("n_a", "n_b")]
        base = group[np.searchsorted(doc, doc)]
        made = (rows - first[0], at - first[1], m["ids_a"][rows], m["ids_b"][at], m["links"].value.astype(np.int64), group - base)
        return pa.RecordBatch.from_arrays([*[c.take(pa.array(doc)) for c in part.columns[:-1]], *map(pa.array, made)], [*part.schema.names[:-1], *[f.name for f in added]])

    kept = docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(names)]).schema.fields
    linked = _mapped(docs, text, names, T.StructType([*kept, *added]), (path_a, path_b), make)
    return linked.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], *[f.name for f in added])


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each row's ``keep`` columns with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A pair's count is the number of rows that hold it linked. ``n_best`` is the number of links whose count is the
    largest of their first id, ``count_sum`` the sum of counts over links.
    """
    fields = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"), ("pairs", "array<long>"), ("times", "array<int>")]
    names = [c for c in keep if c not in [f[0] for f in fields[:5]] + ["n_best", "count_sum"]]
    kept = docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(names)]).schema.fields
    schema = T.StructType([*kept, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in fields]])

    def make(aligner: Aligner, part: pa.RecordBatch, tokens: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns[:-1], *[a if a.type != pa.null() else a.cast(pa.string()) for a in aligner.facts(tokens)]], schema.names)

    rows = stored(_mapped(docs, text, names, schema, (path_a, path_b), make).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    first = F.floor(F.col("pair") / PAIR).alias("a")
    # One row for each id of the first vocabulary.
    best = counts.groupBy(first).agg(F.max("n").alias("most"))
    facts = stored(counts.withColumn("a", first).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-facts")
    common = stored(facts.orderBy(F.col("n").desc(), "pair").limit(COMMON), "common-pairs")

    linked = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    often = linked.join(F.broadcast(common), "pair").groupBy("row").agg(*sums)
    rest = linked.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(facts.join(F.broadcast(common.select("pair")), "pair", "left_anti"), "pair").groupBy("row").agg(*sums)
    told = often.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(told, "row", "left").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
