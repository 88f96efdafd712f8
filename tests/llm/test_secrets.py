"""Patterns, the field, exact decoding and odd rows."""
import hashlib
import random
import re

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from sparkgauge.llm import secrets
from tests.llm.conftest import ODD_ROWS

KEY = "0f3a9c5d7e1b2468ace013579bdf0246"


def corpus(n, seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta,", "epsilon.", "42", "3.14", "a1", "x@y.com", "10.0.0.1"]
    out = []
    for i in range(n):
        tokens = [rnd.choice(words) for _ in range(rnd.randint(5, 80))]
        if i % 3 == 0:
            tokens[len(tokens) // 2:len(tokens) // 2] = [rnd.choice(["token", "secret", "password"]), "=", '"' + "".join(rnd.choice("0123456789abcdef") for _ in range(32)) + '"']
        out.append(" ".join(tokens))
    return out


def trained():
    return secrets.train(sorted(w for t in corpus(600, 1) for w in secrets.windows(t)))


def test_patterns():
    text = f'api-key: PASSWORD = "abcdef" token: abc secret:: tokenx AKIA{"A1" * 8} AKIA123 {KEY[:23]} {KEY[:24]}'
    got = [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.base_spans(text)]
    assert got == [("assign", 'PASSWORD = "abcdef'), ("access", "AKIA" + "A1" * 8), ("hex", KEY[:24])]
    assert secrets.base_spans("paſsword = abcdefgh") == []


def test_field_adds_what_patterns_miss():
    tagger = secrets.Tagger(trained())
    text = f'alpha beta credential = "{KEY[:22]}" gamma delta'
    assert [text[a:b] for a, k, b in secrets.all_spans(text, tagger) if k == 3] == [KEY[:22]]
    clean = corpus(300, 5)
    assert not any(k == 3 for t in clean for _, k, _ in secrets.all_spans(t, tagger))
    found = sum(bool(tagger.spans(t)) for t in clean)
    assert found >= 90  # a hundred have a secret, which the field finds without the patterns


def test_sample_holds_rare_matches(spark):
    rnd = random.Random(8)
    plain = [" ".join(rnd.choices(["alpha", "beta", "gamma", "42", "x1"], k=40)) + f" {i}" for i in range(6000)]
    plain[700] += f' password = "{KEY}" delta'
    frame = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string").repartition(4)
    field = secrets.fit(frame, sample_docs=60)
    assert field is not None and "password" in field.words


def test_forms_not_met_weigh_as_their_kind():
    field = trained()
    tagger = secrets.Tagger(field)
    known = f'"{KEY}"'
    other = f'({KEY}"'[:-8] + "c0ffee00" * 6 + '"'
    assert secrets.shape(known) in field.shapes and secrets.shape(other) not in field.shapes
    tagger.scores([other])
    assert tagger.table[0][0] > np.mean(field.own[1:]) > field.own.min()
    assert [secrets.kind_of(secrets.shape(t)) for t in ("||", "|", "é|", "Ab", "ab,", "12")] == ["p", "p", "p", "m", "w", "dh-"]
    text = f"alpha beta credential = {other} gamma delta"
    assert tagger.tags(text.split())


def test_one_pattern_has_all_matches():
    rnd = random.Random(4)
    for _ in range(20000):
        text = "".join(rnd.choice(["token", "APIKEY", "=", ":", " ", '"', "abc", "AKIA", "A1" * 8, KEY[:12], "é"]) for _ in range(rnd.randint(1, 9)))
        assert not secrets.base_spans(text) or secrets.re.search(secrets.ANY, text)


def test_decoding_in_stretches_is_exact():
    field = trained()
    tagger, rnd = secrets.Tagger(field), random.Random(3)
    for _ in range(300):
        tokens = rnd.choices(["alpha", "=", f'"{KEY}"', KEY[:10], "token", "a1b2", "42", '"x"'], k=rnd.randint(1, 40))
        scores = tagger.scores(tokens) + np.repeat(np.array([[rnd.uniform(-2, 4)]]), 2, axis=1)
        whole = field.viterbi(scores)
        tagger.scores = lambda _, s=scores: s
        assert tagger.tags(tokens) == {i: t for i, t in enumerate(whole) if t}
        del tagger.scores


def test_many_texts_at_once_open_the_same_tokens():
    tagger, rnd = secrets.Tagger(trained()), random.Random(6)
    texts = [*corpus(200, 9), "", None, "  ", f' token = "{KEY}" ', KEY, "a\x1cb\u00a0c", *[t for _, t in ODD_ROWS]]
    texts += [" ".join(rnd.choices(["alpha", "=", f'"{KEY}"', KEY[:10], "token", "42", '"x"'], k=rnd.randint(1, 9))) + rnd.choice(["", "\n"]) for _ in range(300)]
    want = [i for i, t in enumerate(texts) if t and (tokens := secrets.TOKEN.findall(t)) and (tagger.scores(tokens).max(axis=1) >= tagger.bound).any()]
    assert tagger.open_texts(pa.array(texts, pa.string())) == want and want
    assert tagger.open_texts(pa.array(["x", *texts], pa.string()).slice(1)) == want


def test_added_spans_that_touch_none():
    class Fixed:
        def spans(self, text):
            return [(a, 3, a + rnd.randint(1, 9)) for a in range(0, len(text), 11)]

    rnd = random.Random(2)
    text = f"token=abcdef0123 {KEY} x " * 300
    base = secrets.base_spans(text)
    rnd.seed(2)
    added = Fixed().spans(text)
    rnd.seed(2)
    assert secrets.all_spans(text, Fixed()) == sorted(base + [s for s in added if not any(a < s[2] and s[0] < b for a, _, b in base)])


def test_field_depends_on_the_texts_alone(spark):
    rows = [(i, t) for i, t in enumerate(corpus(500, 2) + corpus(100, 2))]
    fields = [secrets.fit(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n), sample_docs=120) for step, n in ((1, 3), (-1, 7))]
    assert fields[0].shapes == fields[1].shapes and fields[0].words == fields[1].words and (fields[0].own == fields[1].own).all()


def test_query_against_direct_version(spark, sf):
    """Base spans by a scan of each text for the three kinds; added spans touch none of them."""
    rows = {r["doc_id"]: r for r in entry.queries()["op3_secret_field"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, text = rows[d["doc_id"]], d["text"] or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        names = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(n.startswith(k) for n in names) for k in ("assign", "access", "hex")]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("crf")] == names


def test_probabilities_sum_to_one():
    state, pairs = secrets._expected(np.random.default_rng(1).normal(size=(4, 6, 3)), np.random.default_rng(2).normal(size=(3, 3)))
    assert np.allclose(state.sum(axis=2), 1) and np.isclose(pairs.sum(), 4 * 5)


def test_redaction():
    assert secrets.redacted("ab token=abcdef x", [(3, 0, 15), (5, 2, 15)]) == "ab [secret] x"
    assert secrets.redacted(None, []) is None


def test_odd_rows(spark, odd, empty):
    frame = odd.unionByName(odd.limit(1).selectExpr(f"100L as doc_id", f"'é token = \"{KEY}\"' as text", *[c for c in odd.columns if c not in ("doc_id", "text")]))
    rows = secrets.find_secrets(frame, trained(), redact=True).collect()
    assert len(rows) == len(ODD_ROWS) + 1
    for r in rows:
        if r["doc_id"] == 100:
            assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == [("assign", 2, 43), ("hex", 11, 43)] and r["text"] == 'é [secret]"'
        else:
            assert not [s for s in r["spans"] if s["kind"] != "crf"]
    assert secrets.find_secrets(empty, None).collect() == [] and secrets.fit(empty) is None
    assert secrets.fit(odd) is None
