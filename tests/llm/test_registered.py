"""The registered queries at the smallest scale: by their SQL, or column by column against direct versions."""
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from gaugechecks.compare import compare, connect
from sparkgauge.llm import multiset_hash, simhash

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("op") and n in SQL and not n.startswith("op12")])
def test_by_sql(spark, sf, name):
    ok, note = compare(spark, connect(sf), sf, name, QUERIES[name], SQL[name])
    assert ok, note


def test_op1(spark, sf, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    rows = rows_of(spark, sf, "op1_bpe_automaton")
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5(spark, sf, docs):
    rows = rows_of(spark, sf, "op5_histogram_shards")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_op6(spark, sf, docs):
    prints = {i: simhash.simhash(t) for i, t in docs.items()}
    label = {i: i for i in docs}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, sf, "op6_simhash_gray")}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_op7(spark, sf, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    rows = rows_of(spark, sf, "op7_pattern_packing")
    placed = collections.defaultdict(list)
    want = set()
    for i, text in docs.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in placed.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    total = sum(r["length"] for r in rows)
    assert len(placed) <= -(-total // 2048) + 2


def lanes(text):
    wide = [int(text[8 * k:8 * k + 8], 16) for k in range(multiset_hash.WIDE)]
    rest = text[8 * multiset_hash.WIDE:]
    return np.array(wide + [int(rest[4 * k:4 * k + 4], 16) for k in range(len(rest) // 4)])


def alike(a, b):
    if (a == b).all():
        return 1.0
    signs = [((2 * x[multiset_hash.WIDE + 1:] - x[multiset_hash.WIDE] + (1 << 15)) % (1 << 16) - (1 << 15)).astype(float) for x in (a, b)]
    both = (signs[0]**2).sum() + (signs[1]**2).sum()
    return max(0.0, 1 - ((signs[0] - signs[1])**2).sum() / both) if both else 0.0


def test_op8(spark, sf, docs):
    rows = {r["doc_id"]: r for r in rows_of(spark, sf, "op8_multiset_hash")}
    ids = sorted(docs, reverse=True)
    assert sorted(rows, reverse=True) == ids
    by_text = collections.defaultdict(set)
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        r, text, half = rows[i], docs[i], len(docs[i]) // 2
        edited = text[:len(text) - half] + docs[after][:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text[text].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
        assert r["near_edited"] == pytest.approx(alike(lanes(r["fingerprint"]), lanes(r["edited_fingerprint"])), abs=1e-9)
        assert r["near_next"] == pytest.approx(alike(lanes(r["fingerprint"]), lanes(rows[after]["fingerprint"])), abs=1e-9)
    assert all(len(f) == 1 for f in by_text.values()) and len({f for s in by_text.values() for f in s}) > len(by_text) * 0.9


def test_op9(spark, sf):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    lists = collections.defaultdict(list)
    for r in rows_of(spark, sf, "op9_adaptive_scan"):
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), abs=1e-12)
        lists[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    assert sorted(lists) == sorted(i for i in vectors if i % 20 == 0)
    for query, found in lists.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 1 + min(20, len(vectors) - 1))) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        assert query not in {f[2] for f in found}


def test_op10(spark, sf, docs):
    rows = rows_of(spark, sf, "op10_toxic_grammar")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_every_operator_has_one_query():
    assert all(sum(n.startswith(f"op{i}_") for n in QUERIES) == 1 for i in range(1, 14)) and "pipeline" in QUERIES
