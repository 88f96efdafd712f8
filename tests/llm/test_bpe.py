"""Ids and decoded text against the tokenizers library."""
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkgauge.llm import bpe
from tests.llm.conftest import ODD_ROWS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts(library):
    chunks, rnd = bpe._Chunks(bpe.WordBpe(PATH)), random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz'0123<|>endof éÀßœΣİ́  \n\t-_.,!ñあ漢😀\x1c\x85"
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "", "<|endoftext|>x"])
        assert np.frombuffer(chunks.text(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_small_table_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STEPS", 20)
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    chunks = bpe._Chunks(bpe.WordBpe(PATH))
    text = "tokenization automata are determinised lazily " * 3 + "supercalifragilisticexpialidocious" * 20
    assert np.frombuffer(chunks.text(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_no_path_for_removed_pairs():
    # merges: a b -> ab, ab a -> aba; "abab" is aba b, and ab is never followed by a.
    machine = bpe.Automaton(["a", "b", "ab", "aba"], [0, 1], [(0, 1, 2), (2, 0, 3)])
    assert machine.encode([0, 1, 0, 1]) == [2, 2]
    assert machine.encode([0, 1, 0]) == [3]
    assert not machine.follows(0, 1) and not machine.follows(2, 0) and machine.follows(2, 2)


def test_odd_rows(spark, odd, empty, library):
    got = bpe.bpe_decode(bpe.bpe_encode(odd.drop("score"), PATH), PATH).select("doc_id", "text", "ids", "decoded").collect()
    assert len(got) == len(ODD_ROWS)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_encode(empty, PATH).count() == 0


def test_unknown_id_is_an_error(spark):
    frame = spark.createDataFrame([([10**6],)], "ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.bpe_decode(frame, PATH).collect()
