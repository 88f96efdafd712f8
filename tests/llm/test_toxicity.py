"""The grammar's situations and held-out accuracy."""
import random

import numpy as np
from pyspark.sql import functions as F

from sparkgauge.llm import toxicity
from tests.llm.conftest import ODD_ROWS

STEMS = {"idiot": 3.0, "mor*": 2.0}


def sums(text):
    reader = toxicity.Reader(STEMS)
    return [round(float(np.expm1(x)), 6) for x in reader.features(text)[:len(toxicity.SITUATIONS)]]


def test_situations():
    assert sums("an idiot, really") == [3, 0, 0, 0, 0]
    assert sums("you are an idiot.") == [0, 3, 0, 0, 0]
    assert sums("you. an idiot morons!") == [5, 0, 0, 0, 0]
    assert sums("not an idiot at all idiot") == [3, 0, 3, 0, 0]
    assert sums("he said you idiot. idiot") == [3, 0, 0, 3, 0]
    assert sums('"an idiot. idiot" idiot') == [3, 0, 0, 6, 0]
    assert sums("i will kill this. kill it") == [0, 0, 0, 0, 1]
    assert sums("an idiot you are, idiot") == [6, 1, 0, 0, 0]
    for threat in ("he kills you", "you were killed", "i will murder you", "du schlägst ihn", "they shot her", "je vais te frapper", "voy a matarte: te mato", "we burned him"):
        assert sums(threat)[4] >= 1, threat
    assert sums("he said they killed him")[3] == 1 and sums("never kill her")[2] == 1 and sums("the process was killed")[4] == 0
    assert sums("I WILL not kill you|idiot") == [3, 0, 1, 0, 0]
    assert sums(None) == sums("") == sums("clean words only") == [0] * 5


def test_parts_of_a_text_count_as_the_whole():
    """Only clauses with a match are run; the result must be that of one run over everything."""
    rnd, reader = random.Random(4), toxicity.Reader(STEMS)
    step, emits = toxicity.compose()
    for _ in range(400):
        text = " ".join(rnd.choice(["idiot", "moron,", "you", "not", "said", '"', '"so', 'is"', "word.", "word", "will", "kill", "idiot.x", "a|idiot|b"]) for _ in range(rnd.randint(1, 40)))
        state, want = 0, [0.0] * 5
        for w in toxicity.WORD.findall(text):
            c = toxicity.CLASSES.get(w, toxicity.OTHER)
            weight = 0.0
            stem = max((STEMS.get(f, 0) for f in toxicity.features_of(w)), default=0)
            if stem and c in (toxicity.OTHER, toxicity.VERB):
                c, weight = toxicity.INSULT, stem
            situation, share, own = emits[state][c]
            if situation >= 0:
                want[situation] += share * weight + own
            state = step[state][c]
        assert np.allclose(np.expm1(reader.features(text)[:5]), want), text


def test_held_out_rows(spark):
    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(1200):
        words = [rnd.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for k in range(0, 60, 12):
                words[k] = rnd.choice(["grublik", "grublos", "snarf"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([*labels, (None, 1), (5, None), (10**6, 1)], "doc_id long, toxic int")
    grammar = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, grammar).withColumn("held", toxicity.held_out(F.col("doc_id"))).filter("held").collect()
    assert 200 < len(rows) < 400 and all((r["score"] >= 0.3) == (r["doc_id"] % 6 == 0) for r in rows)


def test_odd_rows(odd, empty):
    grammar = toxicity.fit(odd, odd.selectExpr("doc_id", "0 as toxic"))
    rows = toxicity.score(odd, grammar).collect()
    assert len(rows) == len(ODD_ROWS) and {r["score"] for r in rows} == {0.0}
    assert toxicity.score(empty, grammar).collect() == []
    assert toxicity.fit(empty, empty.selectExpr("doc_id", "0 as toxic")).weights is None
