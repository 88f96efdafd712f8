"""Words one edit apart against brute force, the bound of affected grams, and the query against its SQL."""
import collections
import itertools
import random

import __spark_entry__ as entry
from gaugechecks.compare import compare, connect
from sparkgauge.llm import variants


def apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def invented(seed, n):
    rnd = random.Random(seed)
    syllables = ["an", "er", "on", "th", "ing", "ré", "ble", "o", "ñ", "eau"]
    words = set()
    while len(words) < n:
        w = "".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 6)))
        i = rnd.randrange(len(w))
        for x in (w, w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "é" + w[i + 1:], "a" * rnd.randint(5, 40)):
            if len(x) >= 5:
                words.add(x)
    return sorted(words)


def expected(counts):
    near = collections.defaultdict(list)
    for a, b in itertools.permutations(counts, 2):
        if apart(a, b):
            near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x))
        if counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def test_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    counts = {w: 3 * 2 ** rnd.randrange(8) + rnd.randrange(3) for w in invented(2, 1200)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    names = ("word", "form", "root", "n", "n_near", "form_n")
    for most in (variants.MOST_GRAMS, 40):  # with few frequent grams allowed, most grams have the least length
        monkeypatch.setattr(variants, "MOST_GRAMS", most)
        assert sorted(tuple(r[c] for c in names) for r in variants.variant_groups(frame).collect()) == expected(counts)


def test_no_join_of_words_is_broadcast(spark, monkeypatch):
    """A few MB of words make over a GB of lists: no plan may rest on the size that Spark takes them for."""
    plans, kept = [], variants.stored

    def ran(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(variants, "stored", lambda df, name: (ran(df), kept(df, name))[1])
    counts = {w: 3 * 2 ** (i % 8) for i, w in enumerate(invented(5, 300))}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        rows = ran(variants.variant_groups(words))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    names = ("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(tuple(r[c] for c in names) for r in rows) == expected(counts)
    assert sum("Join" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_lists_meet_for_every_pair():
    """The keys of the lists: all pairs one edit apart have one in common, for any dictionary."""
    rnd = random.Random(3)
    words = invented(4, 400)
    grams = sorted({w[i:i + k] for w in (variants.START + x + variants.END for x in words) for k in (2, 3, 4) for i in range(len(w) - k + 1)})
    for share in (0, 0.2, 1):
        frequent = {g: rnd.randrange(100) for g in grams if rnd.random() < share}
        shorter = {w: {k for k, longer in variants.list_keys(w, frequent) if not longer} for w in words}
        longer = {w: {k for k, longer in variants.list_keys(w, frequent) if longer} for w in words}
        for a, b in itertools.combinations(words, 2):
            if apart(a, b):
                a, b = sorted((a, b), key=len)
                assert shorter[a] & (shorter[b] if len(a) == len(b) else longer[b]), (a, b)


def test_an_edit_changes_no_more_grams_than_the_bound():
    rnd = random.Random(8)
    for w in invented(6, 200):
        frequent = {w[i:i + k]: 1 for k in (2, 3, 4) for i in range(len(w)) if rnd.random() < 0.5}
        grams, bound = variants.decompose(w, frequent)
        assert len(grams) == len(w) + 1 > bound
        i = rnd.randrange(len(w))
        for other in (w[:i] + w[i + 1:], w[:i] + "q" + w[i + 1:], w[:i] + "q" + w[i:]):
            left = collections.Counter(g for _, g in grams) - collections.Counter(g for _, g in variants.decompose(other, frequent)[0])
            assert sum(left.values()) <= bound


def test_words_of_odd_rows(odd, empty):
    counts = {r["word"]: r["n"] for r in variants.word_counts(odd, least_count=1).collect()}
    assert counts["Ünïcode"] == 1 and counts["quick"] == 2 and "fox" not in counts and counts["x" * 5000] == 1
    assert variants.word_counts(empty).collect() == []
    assert variants.variant_groups(variants.word_counts(empty)).collect() == []
    spelled = variants.word_counts(odd, least_count=1, least_letters=1, spelling=lambda i: lambda w: f"{w}{'0' if i is None else i}")
    assert {r["word"]: r["n"] for r in spelled.collect()}["same8"] == 2 and spelled.filter("word = 'no0'").count() == 1


def test_query_against_sql(spark, sf):
    name = "op12_gram_variants"
    ok, note = compare(spark, connect(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
