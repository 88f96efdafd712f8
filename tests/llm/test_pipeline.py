"""Each stage against a direct version on a small corpus, and the whole run."""
import collections

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkgauge.llm import simhash
from tests.llm.conftest import ODD_ROWS

TOXIC = "you are a grublik and a snarf, all of you grublik people. "
STAGES = dict(corpus_pipeline.STAGES)
KEY = "0f3a9c5d7e1b2468ace013579bdf0246"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda i: " ".join(words[(i * k * k + k + i // 3) % 10] + ("" if k % 7 else str(i * k % 97)) for k in range(60)) + "."
    rows = [(i, (TOXIC * 3 if i % 5 == 0 else "") + text(i)) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(1, 20)]
    rows += [(2000 + i, rows[i][1] + f' token = "{KEY}"') for i in range(21, 40)]
    rows += [(i and 3000 + i, t) for i, t in ODD_ROWS]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0, int(bool(t) and "grublik" in t)) for i, t in rows if i is not None and i < 400 and i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_in_order(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "packing"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clean = STAGES["toxicity"](spark, docs, corpus).cache()
    assert clean.columns == list(corpus_pipeline.COLUMNS)
    assert collections.Counter((r[0], r[1]) for r in clean.collect()) == collections.Counter(r for r in rows if "grublik" not in (r[1] or ""))

    unique = STAGES["near_dedup"](spark, clean, corpus).cache()
    kept = {(r["doc_id"], r["text"]) for r in unique.collect()}
    prints = [(i, t, simhash.simhash(t)) for i, t in rows if "grublik" not in (t or "")]
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][2] ^ prints[b][2]).count("1") <= 3:
                label[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, (i, _, _) in enumerate(prints):
        groups[find(k)].append(i)
    least = sorted(min((x for x in g if x is not None), default=-1) for g in groups.values())
    assert sorted(-1 if i is None else i for i, _ in kept) == least and unique.count() == len(groups)

    safe = STAGES["secrets"](spark, unique, corpus).cache()
    assert safe.columns == list(corpus_pipeline.COLUMNS) and safe.count() == unique.count()
    texts = dict((r["doc_id"], r) for r in safe.collect())
    assert not any(KEY in (r["text"] or "") for r in texts.values())
    for i, t in kept:
        if KEY not in (t or ""):
            assert texts[i]["text"] == t
        else:
            assert "[secret]" in texts[i]["text"] and texts[i]["n_chars"] == len(texts[i]["text"])

    packed = STAGES["packing"](spark, safe, corpus).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length = collections.Counter()
    for r in packed:
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in texts.items()}
    run = corpus_pipeline.run(spark, corpus)
    assert run.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert run.count() == len(packed)


def test_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
