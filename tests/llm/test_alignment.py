"""Groups, links and counts of two tokenizers against a direct version; matrix products against numpy."""
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from sparkgauge.llm import alignment
from tests.llm.conftest import ODD_ROWS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def direct(rows):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = {c: b for b, c in enumerate(alignment.byte_alphabet())}
    pieces, told = [], []
    for _, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        size_a = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        names = [second.id_to_piece(i) for i in b]
        size_b = [bytes([int(n[3:5], 16)]) if second.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
        if not text or b"".join(size_a) != (" " + text).encode() or b"".join(size_b) != (" " + text).encode():
            a, b, size_a, size_b = [], [], [], []
        ends_a, ends_b = np.cumsum([0, *map(len, size_a)])[1:], np.cumsum([0, *map(len, size_b)])[1:]
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups = [([], []) for _ in cuts]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, g in zip(ids, np.searchsorted(cuts, ends)):
                groups[g][side].append(i)
        links = collections.Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        pieces.append(links)
        told.append((len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    held = collections.Counter(p for links in pieces for p in links)
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(((i, *t[:4], sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), t[4])
                   for (i, _), t, links in zip(rows, told, pieces)), key=repr)


def texts():
    rnd = random.Random(9)
    odd = ["a▁b", "▁", " ", "  two  blanks ", "tabs\t\tand\nlines\r\n", "null\x00byte", "<s> </s> <unk> <0x41> <|endoftext|>", "漢字かな交じり文 😀😀 Ünï", "é ﬁ ½",
           "aaaaaaaa" * 50, "ab" * 200, "🦜" * 30, "  x", "123456 7 89,012.5", "='\"{}[]();//" * 10]
    alphabet = "aeiou nrst  ÀéñßΣжあ😀\n\t.,'0123"
    return odd + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 200))) for _ in range(150)] + ["the cat sat on the mat. "] * 5


def rows_of(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


def test_direct_version(spark, monkeypatch):
    monkeypatch.setattr(alignment, "COMMON", 50)  # so that most pairs go through the shuffled join
    rows = [*enumerate(texts()), *[(i and 5000 + i, t) for i, t in ODD_ROWS]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align_tokenizers(frame, A, B)) == direct(rows)


def test_odd_rows(odd, empty):
    got = alignment.align_tokenizers(odd.withColumn("row_", F.lit(1)).withColumn("n_a", F.lit("x")), A, B, keep=["doc_id", "n_a", "row", "n", "row_"])
    assert rows_of(got) == direct(ODD_ROWS) and got.columns.count("n_a") == 1 and {"row", "n", "row_"} <= set(got.columns)
    assert alignment.align_tokenizers(empty, A, B).collect() == []
    assert alignment.overlap_links(empty, A, B).collect() == []


def test_overlap_links(spark):
    text = "unbelievably long-winded Größe 漢字"
    rows = alignment.overlap_links(spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, text string"), A, B).collect()
    aligner = alignment.Aligner(A, B)
    a, b = aligner.tokens(text)
    spans = []
    for ids, sizes in zip((a, b), aligner.sizes):
        ends = np.cumsum(sizes[ids])
        spans.append([set(range(e - n, e)) for e, n in zip(ends, sizes[ids])])
    want = [(i, j, a[i], b[j], len(x & y)) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x & y]
    for doc in (1, 3):
        mine = sorted((r["a_at"], r["b_at"], r["a_id"], r["b_id"], r["n_bytes"]) for r in rows if r["doc_id"] == doc)
        assert mine == want
        assert {r["group_at"] for r in rows if r["doc_id"] == doc} == set(range(len(set(np.cumsum(aligner.sizes[0][a])) & set(np.cumsum(aligner.sizes[1][b])))))


def test_products(monkeypatch):
    rnd = np.random.default_rng(4)
    monkeypatch.setattr(alignment, "BLOCK_PRODUCTS", 50)
    for _ in range(30):
        x, y = (rnd.integers(0, 3, s) * (rnd.random(s) < 0.3) for s in ((13, 9), (9, 17)))
        sparse = [alignment.Sparse.of(np.nonzero(m)[0], np.nonzero(m)[1], m[np.nonzero(m)], m.shape) for m in (x, y)]
        got = alignment.gustavson(*sparse)
        full = np.zeros((13, 17), int)
        np.add.at(full, (got.rows(), got.index), got.value)
        assert (full == x @ y).all() and len(got.index) == np.count_nonzero(x @ y)


def test_long_texts_in_stretches(monkeypatch):
    pieces = alignment.Pieces(B)
    assert pieces.cuts
    monkeypatch.setattr(alignment, "STRETCH", 7)
    for text in [*texts(), "  a  b   c    d " * 20, "x" * 100 + " ", " " * 100, "▁a b▁ c" * 10, "blank at the end "]:
        assert pieces.encode(text) == pieces.model.encode(text), text


def test_query_against_direct_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(entry.queries()["op13_csr_alignment"](spark, sf)) == direct(rows)
