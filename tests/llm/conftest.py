"""Frames with the rows that each operator must bear."""
import pytest

from sparkgauge.session import small_frame

LONG = "word " * 20_000 + "end"
ODD_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. It's here!"), (2, None), (3, ""), (4, LONG), (5, " \n\t "),
    (6, "Ünïcode ΑΣ <|endoftext|> 漢字 😀 x²\x1cy"), (7, "The quick brown fox jumps over the lazy dog. It's here!"),
    (8, "same text"), (8, "same text"), (None, "no id"), (None, None), (9, "x" * 5000),
]
#: Columns whose names operators use themselves.
EXTRA = "ids string, spans int, size int, shard string, slot int, fp string, text_hash int, score string, n int, row int, length string, host string, path int, rule int"


@pytest.fixture(scope="session")
def odd(spark):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    rows = [(i, t, *("7" if "string" in c else 7 for c in EXTRA.split(", "))) for i, t in ODD_ROWS]
    assert len(names) + 2 == len(rows[0])
    return small_frame(spark, rows, f"doc_id long, text string, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
