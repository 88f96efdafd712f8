"""Byte pair encoding by an automaton that is built from the merges, one gadget for each merge.

The automaton reads tokens. Its states stand for the arcs that may follow; at first
there is one state with an arc for each base symbol. The gadget of a merge
``(a, b) -> c`` splits the state that ``a`` enters, takes the arc ``b`` out of the copy
and gives every state with an arc ``a`` an arc ``c`` that ends where ``b`` ended. After
the last gadget each word has one path, and that path is its encoding.

A gadget adds one version of a state and inherits the rest, so the automaton is kept
as its gadgets: which version an arc was born in and from which arcs it was made.
``Automaton.follows`` reads an arc back out of that. Characters are read by the
determinised machine: a state is the longest suffix that begins some token together
with the tokens that end at each place of it. Its transition table is filled as states
are met and has a bounded size; a step is one table look-up.

Null text counts as empty: no ids and the empty string. Input columns named like an
output column are replaced. Words of any length take time in proportion to it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkgauge.llm.common import add_columns

#: Words, chunks and transitions that a worker remembers at most.
MOST_WORDS = 300_000
MOST_STEPS = 400_000
LONGEST_KEPT = 48

# The word pattern that this family of vocabularies is made for.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters at which ``str.split`` breaks although the word pattern has them as no white space.
NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it prints in Latin-1, else the next one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Automaton:
    """The gadgets of all merges, the token trie and the transition table that reads characters."""

    def __init__(self, labels: Sequence[str], symbols: Sequence[int], merges: Sequence[tuple[int, int, int]]):
        """``labels``: the string of each id; ``symbols``: ids of the base symbols; ``merges``: (left, right, made) by rank."""
        self.labels = list(labels)
        self.symbols = list(symbols)
        n = len(self.labels)
        self.born = np.full(n, -1, np.int32)
        self.left = np.arange(n, dtype=np.int32)
        self.right = np.arange(n, dtype=np.int32)
        self.removed: dict[int, int] = {}
        spelled: dict[int, tuple[int, ...]] = {s: (i,) for i, s in enumerate(self.symbols)}
        for rank, (a, b, c) in enumerate(merges):
            if a not in spelled or b not in spelled or c in spelled:
                raise ValueError(f"merge {rank} has a part that no earlier merge makes, or makes a token again")
            # The gadget: the arc b leaves the state behind a, and the arc c is born from both.
            self.removed[a * n + b] = rank
            self.born[c], self.left[c], self.right[c] = rank, a, b
            spelled[c] = spelled[a] + spelled[b]
        self._trie(spelled)
        self.born, self.left, self.right = self.born.tolist(), self.left.tolist(), self.right.tolist()
        self.forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("states", "known", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        self.states = [(0, (-1,))]
        self.known = {self.states[0]: 0}
        self.table: dict[int, int] = {}

    def _trie(self, spelled: dict[int, tuple[int, ...]]) -> None:
        """Trie of the tokens over symbols, with the longest proper suffix that is a node (fail) or ends a token (shorter)."""
        self.goto: dict[int, int] = {}
        self.token, self.depth = [-1], [0]
        for made, word in spelled.items():
            node = 0
            for s in word:
                key = node << 10 | s
                after = self.goto.get(key)
                if after is None:
                    after = self.goto[key] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.token[node] = made
        self.fail = [0] * len(self.token)
        self.shorter = [0] * len(self.token)
        for key, node in sorted(self.goto.items(), key=lambda x: self.depth[x[1]]):
            parent, s = key >> 10, key & 1023
            if parent:
                at = self.fail[parent]
                while at and (at << 10 | s) not in self.goto:
                    at = self.fail[at]
                self.fail[node] = self.goto.get(at << 10 | s, 0)
            behind = self.fail[node]
            self.shorter[node] = behind if self.token[behind] >= 0 else self.shorter[behind]
        self.length = {t: d for t, d in zip(self.token, self.depth) if t >= 0}

    def follows(self, x: int, y: int) -> bool:
        """Whether the state behind arc x has the arc y once all gadgets are in.

        Each of the two was born by a gadget that copied the arc from its parts, so the
        younger one is traced back to its part next to the border; a removal counts if
        it came before the copy.
        """
        born, removed, n, before = self.born, self.removed, len(self.labels), len(self.labels)
        while True:
            rank = removed.get(x * n + y)
            if rank is not None and rank < before:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if born[x] > born[y]:
                before, x = born[x], self.right[x]
            else:
                before, y = born[y] + 1, self.left[y]

    def _step(self, state: int, symbol: int) -> int:
        """Work out one transition: the token that ends here, and the state that follows."""
        node, ends = self.states[state]
        while (after := self.goto.get(node << 10 | symbol)) is None:
            node = self.fail[node]
        at = after if self.token[after] >= 0 else self.shorter[after]
        while True:
            made, before = self.token[at], ends[len(ends) - self.depth[at]]
            if before < 0 or self.follows(before, made):
                break
            at = self.shorter[at]
            if not at:
                raise ValueError("no arc fits: the merges don't make a proper automaton")
        follow = (after, (*ends[len(ends) - self.depth[after]:], made))
        number = self.known.setdefault(follow, len(self.states))
        if number == len(self.states):
            self.states.append(follow)
        value = self.table[state << 10 | symbol] = number << 20 | made
        return value

    def encode(self, word: Sequence[int]) -> list[int]:
        """Ids of a word of symbol numbers: one table transition for each symbol, then the path is read back from its end."""
        if len(self.table) > MOST_STEPS:
            self.forget()
        table, state, made = self.table, 0, []
        for symbol in word:
            value = table.get(state << 10 | symbol)
            if value is None:
                value = self._step(state, symbol)
                if len(table) > 4 * MOST_STEPS:  # within one very long word
                    state_now = self.states[value >> 20]
                    self.forget()
                    table = self.table
                    self.states.append(state_now)
                    self.known[state_now] = 1
                    value = 1 << 20 | value & 0xFFFFF
            state = value >> 20
            made.append(value & 0xFFFFF)
        ids, at = [], len(made)
        while at:
            token = made[at - 1]
            ids.append(token)
            at -= self.length[token]
        ids.reverse()
        return ids


class WordBpe:
    """Encoder and decoder of a vocabulary file with word ends: lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = [""] * (1 + max(*vocab.values(), *self.special.values()))
        for text, i in [*vocab.items(), *self.special.items()]:
            labels[i] = text
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        symbols = [vocab[c] for c in alphabet] + [vocab[c + self.end] for c in alphabet]
        self.automaton = Automaton(labels, symbols, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])

    @property
    def labels(self) -> list[str]:
        return self.automaton.labels


class _Words(dict):
    """Ids of a word as bytes of 32-bit numbers."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        symbols = list(word.encode())
        symbols[-1] += 256
        ids = np.array(self.automaton.encode(symbols), np.int32).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = ids
        return ids


class _Chunks(dict):
    """Ids of what stands between white space; no word reaches across it, and neither do case and composition."""

    def __init__(self, model: WordBpe):
        self.words = _Words(model.automaton)
        self.special = {k: np.array([v], np.int32).tobytes() for k, v in model.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) + ")")
        self.pattern = regex.compile(WORD)

    def __missing__(self, chunk: str) -> bytes:
        parts = self.at_special.split(chunk) if "<" in chunk else [chunk]
        ids = b"".join(self.special[p] if i % 2 else self.plain(p) for i, p in enumerate(parts))
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[chunk] = ids
        return ids

    def plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        else:  # one character at a time, so a final sigma stays an ordinary one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if any(unicodedata.category(c) == "Cn" for c in text):  # unassigned: neither letter nor digit nor space
                shown = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in text)
                return b"".join(self.words[text[m.start():m.end()]] for m in self.pattern.finditer(shown))
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def text(self, text: str) -> bytes:
        if NOT_SPACE.search(text):
            return b"".join(self.special[p] if i % 2 else self.plain(p) for i, p in enumerate(self.at_special.split(text)))
        return b"".join(map(self.__getitem__, text.split()))


_LOADED: dict[str, tuple[_Chunks, list[str]]] = {}


def _loaded(key: str, shared) -> tuple[_Chunks, list[str]]:
    """A worker's encoder; it outlives a task, so what one task has met the next one knows."""
    if key not in _LOADED:
        _LOADED.clear()
        model = shared.value
        _LOADED[key] = _Chunks(model), model.labels
    return _LOADED[key]


def encoded(chunks: _Chunks, texts: pa.Array) -> pa.ListArray:
    """Lists of ids for an array of texts."""
    made = [b"" if t is None else chunks.text(t) for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(m) // 4 for m in made])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)))


def decoded(labels: pa.Array, ids: pa.ListArray) -> pa.Array:
    """Texts for lists of ids: the labels of the arcs on the path, with a space between."""
    import pyarrow.compute as pc

    flat = ids.flatten()
    if flat.null_count or len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(labels)):
        raise ValueError("an id is null or not in the vocabulary")
    lists = pa.ListArray.from_arrays(_offsets(ids), labels.take(flat))
    return pc.binary_join(lists, " ")


def _offsets(ids: pa.ListArray) -> pa.Array:
    import pyarrow.compute as pc

    return pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int32))


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None,
               then: Callable[[pa.ListArray, pa.Array], Sequence[pa.Array]] | None = None,
               then_fields: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Add the ids of each text as ``array<int>``.

    The automaton is built once from the vocabulary file (about 50,000 tokens, the
    bound of what is sent to the executors). With ``then`` the ids and the vocabulary's
    labels go to that function in the same task and its columns are returned instead.
    """
    shared = df.sparkSession.sparkContext.broadcast(WordBpe(path))
    key = f"{df.sparkSession.sparkContext.applicationId}-{id(shared)}-{path}"

    def make():
        chunks, names = _loaded(key, shared)
        labels = pa.array(names)
        if then is None:
            return lambda texts: [encoded(chunks, texts)]
        return lambda texts: then(encoded(chunks, texts), labels)

    return add_columns(df, [text], list(then_fields) if then else [(ids, "array<int>")], make, keep)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """Add the text of each list of ids; a null list counts as empty, an id outside the vocabulary is an error."""
    shared = df.sparkSession.sparkContext.broadcast(WordBpe(path).labels)

    def make():
        labels = pa.array(shared.value)
        return lambda lists: [decoded(labels, lists)]

    return add_columns(df, [ids], [(text, "string")], make, keep)


def digests(ids: pa.ListArray, labels: pa.Array) -> Iterator[pa.Array]:
    """Number of ids, SHA-256 of the decimal ids and SHA-256 of the decoded text for each list."""
    import hashlib

    import pyarrow.compute as pc

    decimal = pc.binary_join(pa.ListArray.from_arrays(_offsets(ids), ids.flatten().cast(pa.string())), " ")
    hexes = [[hashlib.sha256(t.as_buffer()).hexdigest() for t in column] for column in (decimal, decoded(labels, ids))]
    return [pc.list_value_length(ids).cast(pa.int64()), pa.array(hexes[0]), pa.array(hexes[1])]
