"""Toxicity by a weighted grammar of finite-state patterns over clauses.

Tokens are read as classes: insult (with a weight), violent verb in any of its forms,
intention, target, negation, speech verb, quotation mark, clause end, other. Insults are
whole words and word stems with weights learned from labelled rows; the other classes are
short word lists, verbs by stems and endings. Five small transducers run over the classes:
one passes insults on and waits for a target behind them, one does so for threats (a violent
verb behind an intention or a target, or before a target), one remembers a target, one a
negation for three tokens, and one speech verbs and open quotations. Their composition is
compiled into one table of states and classes. An arc that emits says in which of the
composed situations the clause matched (plain, at a target, negated, reported, threat) and
with what weight: a share of the token's own and one of the arc. A document's score is a
logistic function of the weights matched in each situation, of its best clause and of how
many clauses match, never of single words outside a clause.

Training uses at most ``TRAIN_ROWS`` labels, those with the least hashes of the id, and of
texts that share an id one; its rows are dealt over many tasks. At most ``MOST_STEMS`` stems are kept, by weight. Stems
and the logistic function are learned crosswise on two halves, so weights are judged on
rows that they don't come from; the final stems use both. Rows without a label, with a
null id or with several labels (the larger counts) are defined so; null and empty texts
match nothing and get the score of an empty text; without any labelled row of either
kind all scores are 0. Rows that repeat are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.llm.common import add_columns, column, stored

TRAIN_ROWS = 20_000
MOST_STEMS = 4_000
#: Stems that a task holds before it sends their counts on.
HELD_STEMS = 200_000
#: Pseudo-rows of the average kind behind each stem, and the least weight of a stem.
PRIOR_ROWS = 10.0
LEAST_WEIGHT = 1.2
STEM_LETTERS = (3, 4, 5, 6)
MOST_CHUNKS = 300_000
MOST_KINDS = 50_000

# Fixed word lists: violence (stems and endings in English, German, French and Spanish, and other forms), intention, targets, negation, speech.
VERBS = (
    ("kill hurt beat destroy shoot stab stabb strangl burn murder punch smash attack", ("", "s", "e", "es", "ed", "en", "ing")),
    ("töt schlag schläg verbrenn erschieß würg ermord verprügel umbring", ("e", "st", "est", "t", "et", "n", "en", "te", "test", "ten", "tet")),
    ("frapp brûl étrangl assassin", ("er", "e", "es", "ons", "ez", "ent", "é", "ée", "és", "ées", "ait", "era", "erai")),
    ("mat golpe quem estrangul asesin", ("ar", "o", "as", "a", "amos", "an", "é", "ó", "aron", "ado", "ada", "ando", "aré", "ará")),
    ("shot slew schlug geschlagen getötet umgebracht erschoss tuer tue tues tuons tuez tuent tué tuée tués", ("",)),
)
INTENT = "will gonna going shall should must werde wird sollte vais va devrait voy va debería".split()
TARGETS = "you your yours he she they them him her u du dich dir ihr euch sie tu te toi vous ils elle usted ustedes tú ti ellos".split()
NEGATIONS = "not no never isn't aren't don't doesn't nobody nicht kein keine nie ne pas jamais non nunca jamás ni".split()
SPEECH = "said says say claimed wrote called calls quoted reported according sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split()

OTHER, INSULT, VERB, WILL, TARGET, NOT, SAID, QUOTE, END = range(9)
SITUATIONS = ("plain", "targeted", "negated", "reported", "threat")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„.,;:!?|]")
LETTERS = re.compile(r"[^\W\d_]+")
VIOLENT = [stem + ending for stems, endings in VERBS for stem in stems.split() for ending in endings]
CLASSES = {w: c for c, words in ((SAID, SPEECH), (NOT, NEGATIONS), (VERB, VIOLENT), (TARGET, TARGETS), (WILL, INTENT)) for w in words}
CLASSES |= dict.fromkeys("\"“”«»„", QUOTE) | dict.fromkeys(".,;:!?|", END)


def _target(state: int, c: int) -> int:
    return 0 if c == END else 1 if c == TARGET else state


def _negation(state: int, c: int) -> int:
    return 0 if c == END else 3 if c == NOT else max(0, state - 1)


def _speech(state: int, c: int) -> int:
    """0 none, 1 after a speech verb in this clause, 2 inside quotation marks."""
    if c == QUOTE:
        return 0 if state == 2 else 2
    return state if state == 2 else 0 if c == END else 1 if c == SAID else state


def _threat(state: int, c: int) -> int:
    """0 none, 1 after an intention or a target, 2 after a violent verb that neither came before."""
    if c == END:
        return 0
    return 1 if c in (WILL, TARGET) else 2 if c == VERB and state != 1 else state


def _insult(state: int, c: int) -> int:
    """Whether an insult waits for its target."""
    return 1 if c == INSULT else 0 if c in (END, TARGET) else state


MACHINES = ((_target, 2), (_negation, 4), (_speech, 3), (_threat, 3), (_insult, 2))

#: What an arc emits: situation (-1: nothing), share of the token's weight, weight of the arc itself.
Arc = tuple[int, float, float]


def _arc(state: tuple[int, ...], c: int) -> Arc:
    """The output of the composed arc: that of the threat and insult transducers, told apart by the states of all."""
    target, negation, speech, threat, insult = state
    threatens = c == VERB and threat == 1 or c == TARGET and threat == 2
    if not (threatens or c == INSULT or c == TARGET and insult):
        return -1, 0.0, 0.0
    situation = 3 if speech else 2 if negation else 4 if threatens else 1 if target or c == TARGET else 0
    return (situation, 1.0, 0.0) if c == INSULT else (situation, 0.0, 1.0)


def compose() -> tuple[list[list[int]], list[list[Arc]]]:
    """Next state and output of the composed machine for each state and class."""
    sizes = [n for _, n in MACHINES]
    states = [tuple(int(x) for x in np.unravel_index(number, sizes)) for number in range(int(np.prod(sizes)))]
    step = [[int(np.ravel_multi_index([f(p, c) for (f, _), p in zip(MACHINES, state)], sizes)) for c in range(END + 1)] for state in states]
    return step, [[_arc(state, c) for c in range(END + 1)] for state in states]


@dataclass
class Grammar:
    """Learned stems (``word`` or ``stem*``) with weights and the logistic function over situations."""
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEM_LETTERS if len(word) > n)]


class Reader:
    """Runs the composed machine over texts; chunks between white space are classified once and remembered."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.step, self.emits = compose()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        # Kinds of chunks: nothing of interest, and every other sequence of classes and weights.
        self.kinds: list[tuple[tuple[int, float], ...]] = [((OTHER, 0.0),)]
        self.number = {self.kinds[0]: 0}
        self.hit, self.end, self.quotes = np.zeros(64, bool), np.zeros(64, bool), np.zeros(64, np.int64)

    def _kind(self, chunk: str) -> int:
        symbols = []
        for w in WORD.findall(chunk):
            c = CLASSES.get(w, OTHER)
            weight = 0.0
            if c == OTHER or c == VERB:
                found = max((self.stems.get(f, 0.0) for f in features_of(w)), default=0.0)
                if found:
                    c, weight = INSULT, found
            # No machine remembers more than three tokens that say nothing.
            if c != OTHER or len(symbols) < 3 or any(x != OTHER for x, _ in symbols[-3:]):
                symbols.append((c, weight))
        kind = tuple(symbols) or self.kinds[0]
        n = self.number.setdefault(kind, len(self.kinds))
        if n == len(self.kinds):
            self.kinds.append(kind)
            if n == len(self.hit):
                self.hit, self.end, self.quotes = (np.append(x, np.zeros(n, x.dtype)) for x in (self.hit, self.end, self.quotes))
            self.hit[n] = any(c in (INSULT, VERB) for c, _ in kind)
            self.end[n] = any(c == END for c, _ in kind)
            self.quotes[n] = sum(c == QUOTE for c, _ in kind)
        return n

    def _kinds(self, chunks: list[str]) -> np.ndarray:
        if len(self.known) > MOST_CHUNKS or len(self.kinds) > MOST_KINDS:
            self.forget()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        except KeyError:
            for c in chunks:
                if c not in known:
                    known[c] = self._kind(c)
            return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def features(self, text: str | None) -> list[float]:
        """Matched weight in each situation, the best clause, matching clauses, and both for the length."""
        chunks = (text or "").lower().split()
        sums, clauses, best = [0.0] * len(SITUATIONS), 0, 0.0
        if chunks:
            kinds = self._kinds(chunks)
            hits = np.flatnonzero(self.hit[kinds])
            if len(hits):
                ends = np.flatnonzero(self.end[kinds])
                # Clauses that can emit: from the end before a hit to the end after it. Quotations reach over
                # clause ends, so it is counted from the start of the text whether one is open.
                before = np.concatenate([[0], np.cumsum(self.quotes[kinds])])
                for nth in np.unique(np.searchsorted(ends, hits)):
                    a = int(ends[nth - 1]) if nth else 0
                    b = int(ends[nth]) + 1 if nth < len(ends) else len(kinds)
                    clause = self._clause(kinds[a:b], bool(before[a] % 2), nth > 0, sums)
                    best = max(best, clause)
                    clauses += clause > 0
        n = max(1, len(chunks))
        return [*(np.log1p(s) for s in sums), best, np.log1p(clauses), min(20.0, 100.0 * clauses / n), min(50.0, 100.0 * sum(sums[:2]) / n)]

    def _clause(self, kinds: np.ndarray, inside: bool, skip: bool, sums: list[float]) -> float:
        """Run over the chunks of a clause; matches in the chunk that ends the one before count there already."""
        state = int(np.ravel_multi_index((0, 0, 2 if inside else 0, 0, 0), [n for _, n in MACHINES]))
        total = 0.0
        for i, k in enumerate(kinds):
            for c, weight in self.kinds[k]:
                situation, share, own = self.emits[state][c]
                state = self.step[state][c]
                if situation >= 0 and not (skip and i == 0):
                    sums[situation] += share * weight + own
                    total += share * weight + own if situation in (0, 1, 4) else 0.0
        return total


N_FEATURES = len(SITUATIONS) + 4


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last: constant) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (len(w) - 1) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -5, 5)
    return w


def score_of(grammar: Grammar, features: np.ndarray) -> np.ndarray:
    if grammar.weights is None:
        return np.zeros(len(features))
    z = (features - grammar.centre) / grammar.scale @ grammar.weights[:-1] + grammar.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """(text, toxic, half) of labelled rows that are not held out, at most ``rows`` labels."""
    told = (labels.select(column(doc_id).alias("doc_id"), column(label).cast("int").alias("toxic"))
            .filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = told.count()
    share = min(1 << 30, int((rows * 1.1 + 100) * (1 << 30)) // max(1, total))
    drawn = told.withColumn("draw", F.xxhash64("doc_id")).filter(F.pmod("draw", F.lit(1 << 30)) < share)
    drawn = drawn.orderBy(F.pmod("draw", F.lit(1 << 30)), "draw").limit(rows).drop("draw")
    drawn = drawn.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    texts = docs.select(column(doc_id).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"), F.first("half").alias("half"))
    # As many tasks as the shuffle has: the texts are few, but reading their stems is not cheap.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return one.repartition(tasks, "doc_id").select("text", "toxic", "half")


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, half, bad, good): labelled rows of each kind in which a word or stem occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: dict[tuple[int, int], Counter]) -> Iterator[pa.RecordBatch]:
            for half in (0, 1):
                bad, good = seen[half, 1], seen[half, 0]
                names = [*bad, *[s for s in good if s not in bad]]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([half] * len(names), pa.int32()),
                                                  pa.array([bad[s] for s in names], pa.int64()), pa.array([good[s] for s in names], pa.int64())],
                                                 ["stem", "half", "bad", "good"])

        fresh = lambda: {(h, t): Counter() for h in (0, 1) for t in (0, 1)}
        seen = fresh()
        for batch in batches:
            for row in batch.to_pylist():
                found: set[str] = set()
                for w in set(LETTERS.findall(row["text"].lower())):
                    if len(w) > 2 and w not in CLASSES:
                        found.update(features_of(w) if len(w) <= 40 else features_of(w)[1:])
                seen[row["half"], row["toxic"]].update(found)
                if sum(map(len, seen.values())) > HELD_STEMS:
                    yield from out(seen)
                    seen = fresh()
        yield from out(seen)

    counted = rows.mapInArrow(count, "stem string, half int, bad long, good long")
    return counted.groupBy("stem", "half").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def choose_stems(counts: Sequence[tuple[str, int, int]], bad_rows: int, good_rows: int) -> dict[str, float]:
    """Weights of stems: log odds of a bad row given the stem, over those of any row, drawn to zero by the prior."""
    share = (bad_rows + 0.5) / (bad_rows + good_rows + 1)
    chosen = {}
    for stem, bad, good in counts:
        p = (bad + PRIOR_ROWS * share) / (bad + good + PRIOR_ROWS)
        weight = np.log(p / (1 - p)) - np.log(share / (1 - share))
        if weight >= LEAST_WEIGHT:
            chosen[stem] = float(weight)
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:MOST_STEMS])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Grammar:
    """Learn stems and the logistic function from labelled rows."""
    sample = stored(training_rows(docs, labels, doc_id, text, label, rows), "toxic-sample")
    sizes = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    n = lambda t, halves: sum(sizes.get((h, t), 0) for h in halves)
    if not n(1, (0, 1)) or not n(0, (0, 1)):
        return Grammar()
    both = stem_counts(sample).groupBy("stem").agg(*[F.sum(F.when(F.col("half") == h, F.col(k)).otherwise(0)).alias(f"{k}{h}")
                                                     for h in (0, 1) for k in ("bad", "good")])
    # Only stems in several bad rows, more often than in good ones at that rate, can get the least weight.
    rate = n(1, (0, 1)) / (n(1, (0, 1)) + n(0, (0, 1)))
    bad, good = F.col("bad0") + F.col("bad1"), F.col("good0") + F.col("good1")
    kept = both.filter((bad >= 2) & (bad > 1.5 * rate * (bad + good))).orderBy(F.desc(bad / (bad + good + PRIOR_ROWS)), "stem").limit(4 * MOST_STEMS).collect()
    halves = [choose_stems([(r["stem"], r[f"bad{h}"], r[f"good{h}"]) for r in kept], n(1, (h,)), n(0, (h,))) for h in (0, 1)]
    crosswise = sample.sparkSession.sparkContext.broadcast(halves)

    def make():
        readers = [Reader(s) for s in crosswise.value]
        return lambda texts, half: [[readers[1 - h].features(t) for t, h in zip(texts.to_pylist(), half.to_pylist())]]

    read = add_columns(sample, ["text", "half"], [("x", "array<double>")], make, ["toxic"]).toArrow()
    x, y = np.array(read["x"].to_pylist()).reshape(-1, N_FEATURES), np.array(read["toxic"].to_pylist(), float)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    stems = choose_stems([(r["stem"], r["bad0"] + r["bad1"], r["good0"] + r["good1"]) for r in kept], n(1, (0, 1)), n(0, (0, 1)))
    return Grammar(stems, logistic((x - centre) / scale, y), centre, scale)


def score(docs: DataFrame, grammar: Grammar, text: str = "text", name: str = "score", keep: Sequence[str] | None = None) -> DataFrame:
    """Add the toxicity score (0 to 1) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def make():
        g = shared.value
        reader = Reader(g.stems)
        return lambda texts: [pa.array(score_of(g, np.array([reader.features(t) for t in texts.to_pylist()]).reshape(-1, N_FEATURES)))]

    return add_columns(docs, [text], [(name, "double")], make, keep)
