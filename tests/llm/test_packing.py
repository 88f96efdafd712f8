"""Packing: whole, within capacity, gapless, and few sequences."""
import collections
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkgauge.llm import packing
from tests.llm.conftest import ODD_ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, capacity):
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end or not length
            end += length
        assert end <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rnd = np.random.default_rng(seed)
    capacity = [1, 7, 64, 100, 300, 2048][seed]
    histogram = np.bincount(rnd.integers(0 if seed % 2 else 1, capacity + 1, 3000 if seed else 5), minlength=capacity + 1)
    runs, sequences = packing.plan(histogram, capacity)
    placed, filled = np.zeros(capacity + 1, int), collections.Counter()
    for length, rank, count, sequence, offset in runs:
        assert rank == placed[length] and offset + length <= capacity
        placed[length] += count
        for k in range(count):
            filled[sequence + k] += length
    assert (placed == histogram).all() and max(filled.values()) <= capacity and max(filled) < sequences
    least = -(-int((histogram * np.arange(capacity + 1)).sum()) // capacity)
    assert sequences <= least * 1.03 + 2


def test_patterns_are_all_that_fill_a_sequence():
    got = {tuple(sorted(p for p in row if p)) for row in packing.patterns(np.array([2, 3, 5, 8, 10]), 10).tolist()}
    assert got == {(10,), (5, 5), (2, 8), (2, 3, 5)}


def test_fit_is_never_negative_and_close():
    histogram = np.zeros(11)
    histogram[[2, 3, 5]] = 40
    rows = packing.patterns(np.array([2, 3, 5]), 10)
    x = packing.fit_counts(rows, histogram)
    made = sum(np.bincount(rows[:, k], x, 11) for k in range(3))
    assert (x >= 0).all() and abs(made[5] - 40) < 1


def test_ids_as_the_library(spark):
    library, chunks, rnd = Tokenizer.from_file(PATH), packing.TextIds(PATH), random.Random(2)
    letters = "abcdefg hijk'sx  \n\n\t.,!_-<|>0123éÀ漢😀²Ⅷ  "
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) + rnd.choice(["", "", "<|endoftext|>x"])
        assert np.frombuffer(chunks.text(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
    for text in (" " * 200_000, "x" * 200_000, "\n" * 100_000 + "a", "ab" * 100_000):
        assert np.frombuffer(chunks.text(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_of_a_run_that_the_faster_library_cannot_read(spark):
    library, chunks = Tokenizer.from_file(PATH), packing.TextIds(PATH)
    for text in (" " * 2_000_000 + "word", "\n" * 2_000_000 + "word", "a <|endoftext|>" + " " * 2_000_000):
        assert np.frombuffer(chunks.text(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
    rows = packing.token_pieces(spark.createDataFrame([(1, " " * 2_000_000 + "word")], "doc_id long, text string"), PATH).collect()
    assert sum(r["length"] for r in rows) == len(library.encode(" " * 2_000_000 + "word", add_special_tokens=False).ids) + 1


def test_odd_rows(odd, empty):
    library = Tokenizer.from_file(PATH)
    rows = packing.pack(packing.token_pieces(odd, PATH, capacity=512), capacity=512).collect()
    check(rows, 512)
    want = collections.Counter()
    for i, text in ODD_ROWS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 512 + 1
        cuts = [0, *range(first, len(ids), 512), len(ids)]
        want.update((i, k, a, bytes(np.array(ids[a:b], "<u4"))) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows) == want
    assert packing.pack(packing.token_pieces(empty, PATH)).collect() == []


def test_ties_and_clashing_columns(spark):
    rows = spark.range(5000).select(F.lit(100).cast("long").alias("length"), F.lit(1).alias("offset"), F.lit("x").alias("rank"), F.lit(3).alias("deal"))
    got = packing.pack(rows, capacity=1000).collect()
    assert check(got, 1000) == 500 and len(got) == 5000
    with pytest.raises(ValueError, match="cut pieces"):
        packing.pack(rows, capacity=99)


def test_one_length_and_one_row_over_many_deals(spark, monkeypatch):
    monkeypatch.setattr(packing, "DEAL_ROWS", 100)
    names = []
    plain = packing.stored
    monkeypatch.setattr(packing, "stored", lambda df, name: names.append((name, plain(df, name))) or names[-1][1])
    rows = spark.createDataFrame([(7, 2048)] * 4000 + [(8, 3)] * 10, "doc_id long, length long").repartition(3)
    got = packing.pack(rows).collect()
    assert check(got, 2048) == 4001 and len(got) == 4010
    deals = dict(names)["length-deals"].collect()
    assert sum(r["__length"] == 2048 for r in deals) == 40 and max(r["n"] for r in deals) < 200
