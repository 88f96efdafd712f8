"""Words one edit apart, found in a variable-length gram index, and the forms they are variants of.

Words are put between two anchors and decomposed at every position into the shortest gram
of ``LEAST_GRAM`` to ``LONGEST_GRAM`` characters that is not frequent: the gram dictionary
holds the frequent grams, and a gram grows as long as it is one of them (at most to
``LONGEST_GRAM`` or the end of the word). What gram a position has depends on the gram's own
characters only, so an edit changes just the grams that cover it, and a word's bound of
affected grams is the largest number of grams over one of its letters. Two words one edit
apart share all but that many grams, hence (with all grams of all words in one order, rare
ones first) one of the first ``bound + 1``: only those lists are merged. Since words have at
least ``LONGEST_GRAM`` letters, a word has more grams than its bound and no pair is lost.

Lists are merged by a join. A shared gram that the only edit leaves alone has it on one
side, so all on its other side is the same in both words; and where the side with the edit is
longer than ``OPEN`` letters, one half of it is the same too. Both are part of the key, which
keeps lists short without passing over a pair. The join's own condition verifies the distance
(code points), so no pair leaves it that is not one edit apart.

No join of words is broadcast, whatever size Spark takes them for: it goes by their packed files
and does not see that a word is in a dozen lists or more.

The frequent grams are at most ``MOST_GRAMS`` in number whatever the table's size (a gram is
frequent if it occurs more than once in so many gram places), so they fit in every task.
Words are counted in the tasks before they are shuffled. Null texts have no words. Null ids
read as an empty string where a spelling depends on the id. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sparkgauge.llm.common import column, stored

#: Letters that make a word.
WORD = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT = 5, 3
LEAST_GRAM, LONGEST_GRAM = 2, 5
#: Frequent grams are at most so many; a gram with at most ``RARE`` places is never frequent.
MOST_GRAMS, RARE = 1 << 17, 16
#: Letters at most that a key leaves open.
OPEN = 3
#: Distinct words that a task holds before it sends counts on.
HELD_WORDS = 200_000
#: Strategy of joins whose sides grow with the words.
SHUFFLED = "merge"
START, END = "\x02", "\x03"

Spelling = Callable[[object], Callable[[str], str]]


def lower_ascii(text: str) -> str:
    return text.encode().lower().decode()


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", pattern: str = WORD, least_letters: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT, spelling: Spelling | None = None) -> DataFrame:
    """(word, n) of all words in lower case (A to Z) with enough letters and occurrences.

    ``spelling``, given a document's id, returns a function from a word to the word that counts in its place.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = re.compile(pattern).findall, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1)):
                if not body.is_valid:
                    continue
                spelled = spelling(key.as_py()) if spelling else None
                for word, n in Counter(found(lower_ascii(body.as_py()))).items():
                    if spelled:
                        word = spelled(word)
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held = Counter()
        yield out()

    counted = docs.select(column(doc_id).alias("id"), column(text).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The gram dictionary: places of each frequent gram; at most ``MOST_GRAMS`` entries."""
    anchored = F.concat(F.lit(START), "word", F.lit(END))
    letters = words.agg(F.sum(F.length("word") + 2).cast("long").alias("n")).first()["n"] or 0
    # Places have at most LONGEST_GRAM - LEAST_GRAM + 1 grams, so no more than MOST_GRAMS grams can pass this limit.
    limit = max(RARE, math.ceil(letters * (LONGEST_GRAM - LEAST_GRAM + 1) / MOST_GRAMS))
    places = words.select(anchored.alias("w")).select("w", F.explode(F.sequence(F.lit(1), F.length("w") - (LEAST_GRAM - 1))).alias("p"))
    sizes = F.sequence(F.lit(LEAST_GRAM), F.least(F.lit(LONGEST_GRAM), F.length("w") - F.col("p") + 1))
    grams = places.select(F.explode(F.transform(sizes, lambda size: F.substr("w", F.col("p"), size))).alias("gram"))
    table = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).toArrow()
    return dict(zip(table.column("gram").to_pylist(), table.column("n").to_pylist()))


def decompose(word: str, frequent: dict[str, int]) -> tuple[list[tuple[int, str]], int]:
    """(position, gram) at every position of the anchored word, and the most grams that one edit affects."""
    w = START + word + END
    grams, cover = [], [0] * (len(w) + 1)
    for p in range(len(w) - LEAST_GRAM + 1):
        end, last = p + LEAST_GRAM, min(len(w), p + LONGEST_GRAM)
        while end < last and w[p:end] in frequent:
            end += 1
        grams.append((p, w[p:end]))
        cover[p] += 1
        cover[end] -= 1
    over, most = 0, 0
    for step in cover:
        over += step
        most = max(most, over)
    return grams, most


def merged_grams(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """The grams whose lists must be merged to miss no word one edit away: rare ones first, ``bound + 1`` of them."""
    grams, bound = decompose(word, frequent)
    return sorted(grams, key=lambda g: (frequent.get(g[1], 0), g[1], g[0]))[:bound + 1]


def list_keys(word: str, frequent: dict[str, int]) -> list[tuple[int, bool]]:
    """(key, longer): the lists that the word is in, as one of the shorter words of its pairs or as the longer one.

    Both words of a pair have a key in common. A pair of equal length meets among the shorter ones.
    """
    w, size = START + word + END, len(word)
    keys = set()

    def add(side: str, same: str, rest: str) -> None:
        # ``rest`` lies towards the edit; in the longer word it has one letter more than in the shorter.
        for longer in (False, True):
            n = len(rest) - longer
            if n < 0:
                continue
            half, name = n // 2, f"{side}{size - longer}\0{same}\0"
            if n <= OPEN:
                open_keys = [name]
            else:
                open_keys = [f"{name}a{rest[:half]}", f"{name}b{rest[len(rest) - (n - half):]}"]
            for k in open_keys:
                keys.add((xxhash.xxh64_intdigest(k.encode()) - (1 << 63), longer))

    for p, gram in merged_grams(word, frequent):
        end = p + len(gram)
        if end < len(w):
            add("<", w[:end], w[end:-1])
        if p > 0:
            add(">", w[p:], w[1:p])
    return list(keys)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one inserted, deleted or replaced code point apart, once."""
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = [list_keys(w, known) for w in part.column(0).to_pylist()]
                rows = pa.array([i for i, keys in enumerate(made) for _ in keys], pa.int32())
                flat = [k for keys in made for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in flat], pa.int64()), pa.array([x for _, x in flat], pa.bool_()),
                                                  part.column(0).take(rows), part.column(1).take(rows)], ["key", "longer", "word", "n"])

    spread = words.select("word", "n").mapInArrow(lists, "key long, longer boolean, word string, n long")
    one, other = spread.filter("not longer").alias("o"), spread.alias("p")
    apart = (F.col("p.longer") | (F.col("o.word") < F.col("p.word"))) & (F.levenshtein("o.word", "p.word", 1) == 1)
    found = one.join(other.hint(SHUFFLED), (F.col("o.key") == F.col("p.key")) & apart)
    pairs = found.select(F.col("o.word").alias("word"), F.col("o.n").alias("n"), F.col("p.word").alias("near"), F.col("p.n").alias("near_n")).distinct()
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both))


def variant_groups(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``words`` (word, n; distinct words).

    The form is the near word with the largest n (ties: the smallest word), if its n is at least ``factor``
    times the word's; ``root`` follows forms to the last. Counts at least double on the way, so chains
    are short, and each round of joins doubles what is followed.
    """
    words = stored(words, "words")
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    taken = -F.col("best.n") >= F.col("n") * factor
    told = words.join(best.hint(SHUFFLED), "word", "left").select("word", F.when(taken, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                   F.when(taken, -F.col("best.n")).alias("form_n"))
    told = stored(told, "forms")
    most = told.agg(F.max("n").alias("n")).first()["n"] or 1
    longest = math.ceil(math.log(max(2, most), factor)) + 1
    links, reach = told.filter("form is not null").select("word", F.col("form").alias("root")), 1
    while reach < longest:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(on.hint(SHUFFLED), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        reach *= 2
    return told.join(links.hint(SHUFFLED), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
