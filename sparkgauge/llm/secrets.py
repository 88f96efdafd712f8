"""Secrets by fixed patterns and a linear-chain conditional random field.

Tokens are the runs between ASCII white space. Each is tagged secret begin (B), inside (I) or
outside (O). What the tags see of a token: its shape (letter case, digits, length, quotes,
key and value in one), the shapes of its neighbours, two words before it, and features
of the whole file. The field is trained here by maximum likelihood on a bounded sample
(``SAMPLE_DOCS`` documents, at most ``WINDOWS`` stretches of each) with the pattern
matches as labels, and decoded by Viterbi. The sample is one of distinct texts, those with
the least hashes, so it depends on the table's texts alone. It has two parts: texts with a
match, found over the whole table, up to ``MATCHED_SHARE`` of the sample (or their share of
the table, if that is more), and texts without one. So rare matches are all learned from,
however large the table. A form that the sample lacks weighs as those of its kind do on average. It adds spans that the patterns miss and
never removes one of theirs; an added span that touches a pattern's span is dropped.

Decoding is exact over whole texts and does no work where it can't matter: the score of
O is zero and B and I differ by at most ``2 * APART``, so a token whose score for B and I lies
under a bound made of the transitions is O on every best path. Scores of many texts are
worked out together, and texts with no token above the bound are done; Viterbi runs over the
stretches between such tokens of the others.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Rows that
repeat are kept. Columns named like an output are replaced. A table without any match trains no field, and nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.llm.common import add_columns, column, stored
from sparkgauge.session import small_frame

#: Documents that the field is trained on at most, stretches of each, tokens of a stretch and rounds.
SAMPLE_DOCS = 8_000
#: Share of the sample that documents with a match fill if there are enough.
MATCHED_SHARE = 0.25
WINDOWS = 4
WINDOW = 48
ROUNDS = 60
#: Most that the weights of one feature may set I apart from B.
APART = 1.5
#: Tokens whose weights a worker remembers.
MOST_WORDS = 500_000
#: The threshold by which texts are drawn lets through so many times the wanted number, and some more.
DRAW_MARGIN = 1.25

# Fixed patterns; group 2 of the first and the whole of the others have least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Whatever the three match has a match of this one; Java reads it too.
ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
KINDS = ("assign", "access", "hex", "crf")
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
O, B, I = 0, 1, 2

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' matches, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _size(n: int) -> str:
    return str(n if n < 4 else 4 if n < 6 else 6 if n < 8 else 8 if n < 12 else 12 if n < 16 else 16 if n < 20 else 20 if n < 32 else 32 if n < 64 else 64)


def shape(token: str) -> str:
    """What the field sees of a token's form."""
    if token.isalpha():
        return ("U" if token.isupper() else "l" if token.islower() else "m") + _size(len(token))
    values = VALUE.findall(token)
    if not values:
        return "p" + token[:2]
    value = max(values, key=len)
    digits = sum(map(str.isdigit, value))
    kinds = "".join(k for k, there in (
        ("d", digits), ("u", any(map(str.isupper, value))), ("a", any(map(str.islower, value))), ("s", not value.isalnum())) if there)
    if not digits and kinds in ("a", "u", "ua"):
        return "w" + kinds + token[-1]
    even = "h" if not set(value) - set("0123456789abcdef") else ""
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
    return "|".join((kinds + even, _size(len(value)), "m" if 4 * turns > len(value) else "f", token[0] if token[0] in "\"'" else "",
                     "k" if re.search(r"[A-Za-z][\"']?[:=]", token) else "", "@" if "@" in token else ""))


def kind_of(form: str) -> str:
    """Forms alike but for length and marks: the characters of a value and whether it is long, or the first letter."""
    if form[0] in "Ulmwp":
        return form[0]
    value, size = form.split("|")[:2]
    return value + ("+" if int(size) >= 16 else "-")


def word(token: str) -> str:
    return token.strip("\"'.,;:=!?#*$%&()[]{}|").lower() or token[:2]


def file_features(digits: int, equals: int, n: int) -> int:
    """Features of the whole text as one number: share of tokens with digits, presence of "=", length."""
    share = 0 if not digits else 1 if digits * 50 < n else 2 if digits * 8 < n else 3
    return share * 8 + (4 if equals else 0) + (0 if n < 50 else 1 if n < 500 else 2 if n < 5000 else 3)


N_FILE = 32


def labelled(text: str) -> tuple[list[str], list[int]]:
    """Tokens and their tags by the patterns; only the value of an assignment counts as secret."""
    places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    tags = [O] * len(places)
    spans = sorted([(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [(a, b) for a, k, b in base_spans(text) if k])
    at = 0
    for a, b in spans:
        while at < len(places) and places[at][1] <= a:
            at += 1
        i, first = at, True
        while i < len(places) and places[i][0] < b:
            tags[i] = B if first and tags[i] != I else tags[i] or I
            i, first = i + 1, False
    return [text[a:b] for a, b in places], tags


def windows(text: str, most: int = WINDOWS) -> Iterator[tuple[list[str], list[int], int]]:
    """At most ``most`` stretches of a text for training: around labelled tokens, and one at a place that the text itself decides."""
    tokens, tags = labelled(text)
    n = len(tokens)
    if not n:
        return
    file = file_features(sum(any(map(str.isdigit, t)) for t in tokens), sum("=" in t for t in tokens), n)
    marked = [i for i, t in enumerate(tags) if t == B]
    starts = [max(0, i - WINDOW // 2) for i in marked[:most - 1]] + [len(text) * 7919 % n]
    for s in starts:
        yield tokens[s:s + WINDOW], tags[s:s + WINDOW], file


@dataclass
class Field:
    """Weights of a trained field. Tables have a row for each shape or word, row 0 for those not met; ``kinds`` has own weights of shapes not met."""
    shapes: dict[str, int]
    words: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    before2: np.ndarray
    after: np.ndarray
    word1: np.ndarray
    word2: np.ndarray
    apart: np.ndarray
    apart_before: np.ndarray
    file: np.ndarray
    moves: np.ndarray
    kinds: dict[str, float]

    def own_weight(self, form: str) -> float:
        s = self.shapes.get(form, 0)
        return float(self.own[s]) if s else self.kinds.get(kind_of(form), float(self.own[0]))

    def bound(self) -> float:
        """A token whose scores for B and I are both below this is O on every best path.

        Entering B or I instead of O gains at most ``enter`` in transitions; having been
        there instead of in O gains at most ``leave`` afterwards, since from O the next
        token can be B where it would have been I.
        """
        m = self.moves
        enter = max(m[p, s] - m[p, O] for p in (O, B, I) for s in (B, I) if m[p, s] > -np.inf)
        later = max(m[I, x] - m[B, x] for x in (O, B, I))
        leave = max(max(m[s, O] - m[O, O], m[s, B] - m[O, B], m[s, I] - m[O, B] + 2 * APART + max(0.0, later)) for s in (B, I))
        return -(enter + leave)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Best tags of a stretch (scores: B and I of each token) between tokens that are O."""
        best, back = self.moves[O] + np.array([0.0, *scores[0]]), []
        for s in scores[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + np.array([0.0, *s])
        tags = [int((best + self.moves[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def train(sample: Sequence[tuple[list[str], list[int], int]], rounds: int = ROUNDS, seed: int = 5) -> Field | None:
    """Maximum likelihood by gradient steps with per-weight step sizes; None without a labelled token."""
    sample = [s for s in sample if s[0]]
    if not any(B in tags for _, tags, _ in sample):
        return None
    shapes: dict[str, int] = {}
    for tokens, _, _ in sample:
        for t in tokens:
            shapes.setdefault(shape(t), len(shapes) + 1)
    near: dict[str, int] = {}
    for tokens, tags, _ in sample:
        for i, t in enumerate(tags):
            for j in (i - 1, i - 2):
                if t == B and j >= 0:
                    near.setdefault(word(tokens[j]), len(near) + 1)
    rows, size = len(sample), WINDOW
    sh, wd = np.zeros((rows, size + 3), np.int64), np.zeros((rows, size + 3), np.int64)
    tag, real = np.zeros((rows, size), np.int64), np.zeros((rows, size), bool)
    file = np.array([f for _, _, f in sample])
    for r, (tokens, tags, _) in enumerate(sample):
        n = len(tokens)
        sh[r, 2:2 + n] = [shapes[shape(t)] for t in tokens]
        wd[r, 2:2 + n] = [near.get(word(t), 0) for t in tokens]
        tag[r, :n], real[r, :n] = tags, True
    S, W = len(shapes) + 1, len(near) + 1
    place = slice(2, 2 + size)
    looks = [("own", sh[:, place], S), ("before", sh[:, 1:1 + size], S), ("before2", sh[:, :size], S), ("after", sh[:, 3:3 + size], S),
             ("word1", wd[:, 1:1 + size], W), ("word2", wd[:, :size], W), ("file", np.broadcast_to(file[:, None], tag.shape), N_FILE)]
    weights = {name: np.zeros(n) for name, _, n in looks} | {"apart": np.zeros(S), "apart_before": np.zeros(S), "moves": np.zeros((3, 3))}
    weights["own"] -= 1.0
    squares = {k: np.full_like(w, 1e-6) for k, w in weights.items()}
    random = np.random.default_rng(seed)
    forbidden = np.zeros((3, 3))
    forbidden[O, I] = -np.inf
    tick = np.arange(rows)
    for _ in range(rounds):
        batch = random.permutation(tick)[:2048]
        m = weights["moves"] + forbidden
        em = np.zeros((len(batch), size, 3))
        em[..., B] = sum(weights[name][ix[batch]] for name, ix, _ in looks)
        em[..., I] = em[..., B] + weights["apart"][sh[batch][:, place]] + weights["apart_before"][sh[batch][:, 1:1 + size]]
        there = real[batch]
        em[~there] = (0.0, -1e9, -1e9)
        state, pairs = _expected(em, m)
        gold = np.eye(3)[tag[batch]]
        error = (gold - state) * there[..., None]
        gold_pairs = np.zeros((3, 3))
        np.add.at(gold_pairs, (tag[batch][:, :-1].ravel(), tag[batch][:, 1:].ravel()), 1.0)
        slope = {"moves": gold_pairs - pairs}
        inside = error[..., B] + error[..., I]
        for name, ix, n in looks:
            slope[name] = np.bincount(ix[batch].ravel(), inside.ravel(), n)
        slope["apart"] = np.bincount(sh[batch][:, place].ravel(), error[..., I].ravel(), S)
        slope["apart_before"] = np.bincount(sh[batch][:, 1:1 + size].ravel(), error[..., I].ravel(), S)
        for k, w in weights.items():
            g = slope[k] - 0.05 * w
            squares[k] += g * g
            w += 0.5 * g / np.sqrt(squares[k])
        for k in ("apart", "apart_before"):
            np.clip(weights[k], -APART, APART, out=weights[k])
    moves = weights.pop("moves") + forbidden
    # Forms never met weigh as their kind does on average, or as all forms do.
    kinds: dict[str, list[float]] = {}
    for form, s in shapes.items():
        kinds.setdefault(kind_of(form), []).append(weights["own"][s])
    weights["own"][0] = weights["own"][1:].mean()
    for name in ("apart", "apart_before"):
        weights[name][0] = 0.0
    return Field(shapes, near, moves=moves, kinds={k: float(np.mean(w)) for k, w in kinds.items()}, **weights)


def _expected(em: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag probabilities and the expected number of each transition, by forward and backward sums."""
    total = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    n, size, _ = em.shape
    ahead, behind = np.zeros_like(em), np.zeros_like(em)
    ahead[:, 0] = em[:, 0] + moves[O]
    for i in range(1, size):
        ahead[:, i] = total(ahead[:, i - 1, :, None] + moves, 1) + em[:, i]
    for i in range(size - 2, -1, -1):
        behind[:, i] = total(moves + (em[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
    whole = total(ahead[:, -1], 1)
    pairs = np.zeros((3, 3))
    for i in range(1, size):
        pairs += np.exp(ahead[:, i - 1, :, None] + moves + (em[:, i] + behind[:, i])[:, None, :] - whole[:, None, None]).sum(axis=0)
    return np.exp(ahead + behind - whole[:, None, None]), pairs


class Tagger:
    """Reads whole texts with a trained field; tokens of one shape and word share a row of weights."""

    def __init__(self, field: Field):
        self.field, self.bound = field, field.bound()
        self.known: dict[str, int] = {}
        self.rows: dict[tuple[int, float, int, bool, bool], int] = {}
        self.table: list[tuple[float, ...]] = []
        self.weights = np.zeros((0, 8))

    def _row(self, token: str) -> int:
        f = self.field
        form, w = shape(token), f.words.get(word(token), 0)
        s, own = f.shapes.get(form, 0), f.own_weight(form)
        digit, equals = any(map(str.isdigit, token)), "=" in token
        row = self.rows.setdefault((s, own, w, digit, equals), len(self.table))
        if row == len(self.table):
            self.table.append((own, f.before[s] + f.word1[w], f.before2[s] + f.word2[w], f.after[s], f.apart[s], f.apart_before[s], digit, equals))
        return row

    def _rows(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        rows = np.empty(len(tokens), np.int64)
        for i, t in enumerate(tokens):
            row = known.get(t)
            if row is None:
                row = known[t] = self._row(t)
            rows[i] = row
        if len(self.weights) < len(self.table):
            self.weights = np.array(self.table, np.float64)
        return rows

    def open_texts(self, texts: pa.Array) -> list[int]:
        """Places of the texts with a token that may be other than O; each distinct token is looked up once."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        rows = self._rows(distinct)[coded.indices.to_numpy()]
        if "" in distinct:  # before leading and behind trailing white space
            real = coded.indices.to_numpy() != distinct.index("")
            doc, rows = doc[real], rows[real]
        if not len(rows):
            return []
        w, f, n = self.weights, self.field, len(texts)
        counts = [np.bincount(doc, weights=x, minlength=n).astype(int).tolist() for x in (w[rows, 6], w[rows, 7], np.ones(len(rows)))]
        file = f.file[[file_features(*c) for c in zip(*counts)]]
        same1, same2 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
        b = w[rows, 0] + file[doc]
        b[1:] += np.where(same1, w[rows[:-1], 1], f.before[0] + f.word1[0])
        b[2:] += np.where(same2, w[rows[:-2], 2], f.before2[0] + f.word2[0])
        b[:1] += f.before[0] + f.word1[0]
        b[:2] += f.before2[0] + f.word2[0]
        b[:-1] += np.where(same1, w[rows[1:], 3], f.after[0])
        b[-1:] += f.after[0]
        i = b + w[rows, 4]
        i[1:] += np.where(same1, w[rows[:-1], 5], f.apart_before[0])
        i[:1] += f.apart_before[0]
        # Sums in another order than in ``scores`` may differ in their last digits.
        return np.unique(doc[np.maximum(b, i) >= self.bound - 1e-6]).tolist()

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Scores of B and I for each token; that of O is 0."""
        rows = self._rows(tokens)
        w, f = self.weights, self.field
        n = len(rows)
        file = file_features(int(w[rows, 6].sum()), int(w[rows, 7].sum()), n)
        b = w[rows, 0] + f.file[file]
        b[1:] += w[rows[:-1], 1]
        b[:1] += f.before[0] + f.word1[0]
        b[2:] += w[rows[:-2], 2]
        b[:2] += f.before2[0] + f.word2[0]
        b[:-1] += w[rows[1:], 3]
        b[-1:] += f.after[0]
        i = b + w[rows, 4]
        i[1:] += w[rows[:-1], 5]
        i[:1] += f.apart_before[0]
        return np.stack([b, i], axis=1)

    def tags(self, tokens: list[str]) -> dict[int, int]:
        """Tags of the tokens that are not O."""
        scores = self.scores(tokens)
        open_ = np.flatnonzero(scores.max(axis=1) >= self.bound)
        found: dict[int, int] = {}
        if len(open_):
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                found |= {int(i): t for i, t in zip(run, self.field.viterbi(scores[run])) if t != O}
        return found

    def spans(self, text: str) -> list[Span]:
        """(start, kind, end) of the tagged secrets: from the value in the first token to that in the last."""
        tokens = TOKEN.findall(text)
        tags = self.tags(tokens) if tokens else {}
        if not tags:
            return []
        places = [m.start() for m in TOKEN.finditer(text)]
        made: list[list[int]] = []
        for i in sorted(tags):
            values = list(VALUE.finditer(tokens[i]))
            if not values:
                continue
            value = max(values, key=lambda m: m.end() - m.start())
            if tags[i] == I and made and made[-1][3] == i - 1:
                made[-1][2:] = [places[i] + value.end(), i]
            else:
                made.append([places[i] + value.start(), 3, places[i] + value.end(), i])
        return [(a, k, b) for a, k, b, _ in made]


def all_spans(text: str, tagger: Tagger | None) -> list[Span]:
    base = base_spans(text)
    added = tagger.spans(text) if tagger else []
    if not added:
        return base
    # What the patterns cover, as stretches apart from each other, in order.
    covered: list[list[int]] = []
    for a, _, b in base:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    ends = [b for _, b in covered]

    def free(a: int, b: int) -> bool:
        at = bisect_right(ends, a)
        return at == len(covered) or covered[at][0] >= b

    return sorted(base + [s for s in added if free(s[0], s[2])])


def fit(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, windows_each: int = WINDOWS) -> Field | None:
    """Train the field on at most ``sample_docs`` distinct texts, with a match and without, those with the least hashes.

    One scan finds matches in all texts; a second reads the texts below the hashes that a sample of this size needs.
    """
    rows = docs.select(column(text).alias("text")).filter("text is not null and text <> ''").withColumn("draw", F.xxhash64("text"))
    marked = rows.select("draw", F.col("text").rlike(ANY).alias("matched")).groupBy("draw").agg(F.first("matched").alias("matched"))
    marked = stored(marked, "matched-texts")
    counts = marked.agg(F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched")).first()
    total, matched = counts["total"], counts["matched"]
    if not matched:
        return None
    most = min(matched, max(int(sample_docs * MATCHED_SHARE), sample_docs * matched // total, 1))
    least, high = -(1 << 63), (1 << 63) - 1
    limits = []
    for size, wanted in ((matched, most), (total - matched, sample_docs - most)):
        share = min(1.0, (wanted * DRAW_MARGIN + 50) / size) if size and wanted > 0 else 0.0
        limits.append(high if share == 1.0 else least + int(share * (1 << 64)))
    below = F.when(F.col("matched"), F.col("draw") <= limits[0]).otherwise(F.col("draw") <= limits[1])
    # Numbers only, about DRAW_MARGIN times the sample; the least hashes of each part are taken.
    draws: dict[bool, list[int]] = {True: [], False: []}
    for r in marked.filter(below).collect():
        draws[r["matched"]].append(r["draw"])
    taken = sorted(draws[True])[:most] + sorted(draws[False])[:sample_docs - most]
    drawn = small_frame(docs.sparkSession, [(d,) for d in taken], "draw long")
    sample = rows.join(F.broadcast(drawn), "draw").groupBy("draw").agg(F.first("text").alias("text")).repartition("draw")

    def make():
        return lambda texts: [[[{"tokens": a, "tags": b, "file": c} for a, b, c in windows(t, windows_each)] for t in texts.to_pylist()]]

    kind = "array<struct<tokens: array<string>, tags: array<int>, file: int>>"
    got = add_columns(sample, ["text"], [("windows", kind)], make, []).select(F.inline("windows")).toArrow().to_pylist()
    return train(sorted((g["tokens"], g["tags"], g["file"]) for g in got))


_TAGGER: list[tuple[Field, Tagger]] = []


def _tagger(field: Field) -> Tagger:
    """The worker's tagger for this field, with the tokens it has seen in earlier tasks."""
    if not _TAGGER or _TAGGER[0][0] is not field:
        _TAGGER[:] = [(field, Tagger(field))]
    return _TAGGER[0][1]


def find_secrets(docs: DataFrame, field: Field | None, text: str = "text", keep: Sequence[str] | None = None, redact: bool = False) -> DataFrame:
    """Add ``spans`` (kind, start, end) of each text, by start, then kind; with ``redact`` the text has ``[secret]`` in their place."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        tagger = _tagger(shared.value) if shared.value else None

        def find(texts: pa.Array):
            open_ = set(tagger.open_texts(texts)) if tagger else ()
            texts = texts.to_pylist()
            spans = [all_spans(t or "", tagger if i in open_ else None) for i, t in enumerate(texts)]
            listed = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found] for found in spans],
                              pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
            return [listed, pa.array([redacted(t, s) for t, s in zip(texts, spans)], pa.string())] if redact else [listed]

        return find

    fields = [("spans", "array<struct<kind: string, start: int, end: int>>")]
    return add_columns(docs, [text], fields + [(text, "string")] * redact, make, keep)


def redacted(text: str | None, spans: Sequence[Span]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
