"""Spelling variants: words one edit apart, by dynamic programming along sorted lists.

Two words one edit apart, the longer of n letters, share (n - 1) / 2 letters (rounded up) at their beginning or at their end. So
words meet in groups of one length and one beginning, or one end (then spelled backwards), and no list is compared with
all others. A group is sorted; for each of its words a banded edit matrix is carried along the words behind it: the rows of
the letters that a word shares with the one before are kept, and where a row has no cell of one edit or less, all words with that
beginning are passed over at once.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exhume.llm.sorted_groups import bounds, in_cells, whole_groups
from exhume.session import Scratch

MIN_LENGTH, MIN_COUNT, FACTOR = 5, 3, 2
#: One run in so many loses a letter.
THINNED = 97
#: Words of one block; a cell compares two blocks. Words a task counts before it hands them on.
BLOCK, COUNTED = 2048, 250_000
#: A-Z in lower case, other ASCII but a-z parts words.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Beyond ASCII, U+00C0 to U+00FF are letters: in UTF-8 these begin with C3.
_OTHER = re.compile(rb"(?:[\xc2\xc4-\xf4][\x80-\xbf]+)+")
_LAST = "\U0010ffff"


def spelled(text: bytes, name: str) -> Iterator[tuple[bytes, int]]:
    """(word, number) of one text; some words, by the hash of ``name`` and the word, lose a letter. A word may come more than once."""
    data = text.translate(_FOLDED)
    if not data.isascii():
        data = _OTHER.sub(b" ", data)
    start = zlib.crc32(f"{name}:".encode())
    for word, n in Counter(data.split()).items():
        if not (h := zlib.crc32(word, start)) % THINNED:
            letters = word.decode()
            at = h % len(letters)
            word = (letters[:at] + letters[at + 1 :]).encode()
        yield word, n


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words of ``min_length`` letters that occur ``min_count`` times or more in all texts. A null key counts as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            words = {w: n for w, n in total.items() if len(w) >= min_length}
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        total: Counter[bytes] = Counter()
        for batch in batches:
            for name, t in zip(batch.column("name").to_pylist(), batch.column("t").cast(pa.binary())):
                for word, n in spelled(t.as_py() or b"", name):
                    total[word] += n
                if len(total) > COUNTED:
                    yield rows()
                    total.clear()
        yield rows()

    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    counted = docs.select(name.alias("name"), F.col(f"`{text}`").alias("t")).mapInArrow(count, "word string, n bigint")
    long = counted.filter(F.length("word") >= min_length)
    return long.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def shared_letters(longer: int) -> int:
    """Letters that two words one edit apart, the longer of ``longer`` letters, share at the beginning or else at the end."""
    return longer // 2


def one_edit_apart(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places (i, j), i < j, of all pairs of a sorted list of distinct words that differ by one inserted, deleted or replaced letter.

    ``rows[d]`` has the edits from the first d letters of the list's word to the first d - 1, d and d + 1 of the query.
    """
    common = [0] * (len(words) + 1)
    for j in range(1, len(words)):
        a, b = words[j - 1], words[j]
        n = min(len(a), len(b))
        common[j] = next((d for d in range(n) if a[d] != b[d]), n)
    for i, own in enumerate(words):
        query, size = own + "\0\0", len(own)
        rows = [(2, 0, 1)]
        j = i + 1
        while j < len(words):
            word = words[j]
            behind = j + 1
            for d in range(len(rows) - 1, len(word)):
                letter, (x, y, z) = word[d], rows[d]
                if d > size:  # two letters more than the query
                    behind = bisect_left(words, word[: d + 1] + _LAST, j + 1)
                    break
                x = min(x + (letter != query[d - 1]), y + 1)
                y = min(y + (letter != query[d]), z + 1, x + 1)
                z = min(z + (letter != query[d + 1]), y + 1)
                if x > 1 and y > 1 and z > 1:
                    behind = bisect_left(words, word[: d + 1] + _LAST, j + 1)
                    break
                rows.append((x, y, z))
            else:
                if abs(size - len(word)) < 2 and rows[len(word)][size - len(word) + 1] == 1:
                    yield i, j
            j = behind
            del rows[common[j] + 1 :]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "other", "other_n"]
    for table in whole_groups(batches, "cell"):
        spelling, counts, own, longer, back, cross = (table[c].to_pylist() for c in ("spelling", "n", "own", "longer", "back", "cross"))
        found: list[tuple[str, str, int]] = []
        for a, b in zip(edge := bounds(table["cell"]).tolist(), edge[1:]):
            if b - a == 1:
                continue
            for i, j in one_edit_apart(spelling[a:b]):
                u, v = spelling[a + i], spelling[a + j]
                if max(len(u), len(v)) != longer[a] or cross[a] and own[a + i] == own[a + j]:
                    continue
                if back[a]:
                    u, v = u[::-1], v[::-1]
                    shared = shared_letters(longer[a])
                    if u[:shared] == v[:shared]:  # they met by their beginning
                        continue
                found += (u, v, counts[a + j]), (v, u, counts[a + i])
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n) of all pairs of distinct ``words`` (word, n) one edit apart, both ways, each once.

    Words of less than two letters are near only by what they share, and that is nothing: they have no pairs.
    """
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1))
    met = words.select("word", "n", longer.alias("longer"), F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    met = met.withColumn("spelling", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")))
    met = met.withColumn("beginning", F.substring("spelling", F.lit(1), (F.col("longer") / 2).cast("int"))).filter("beginning <> ''")
    group = ["back", "longer", "beginning"]
    large = met.groupBy(*group).agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
    placed = in_cells(met.join(large, group, "left").withColumn("size", F.coalesce("size", F.lit(1))), "size", "word", BLOCK)
    cell = F.concat_ws("|", *[F.col(c).cast("string") for c in (*group, "a", "b")])
    placed = placed.select(cell.alias("cell"), "spelling", "n", "own", "longer", "back", (F.col("a") != F.col("b")).alias("cross"))
    return placed.repartition("cell").sortWithinPartitions("cell", "spelling").mapInArrow(_pairs, "word string, other string, other_n bigint")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of all ``forms`` (word, form): the last word that forms lead to. A form has to have more occurrences than its word, so there are no rings.

    Each round doubles the steps taken; as counts double with each step, seven rounds are the most.
    """
    now = scratch.write(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.write(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(now)
        now = after.drop("moved")
        if not after.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word with ``min_length`` letters and ``min_count`` occurrences.

    ``form`` is the near word with most occurrences (the smallest of equals), if it has ``factor`` times the word's own or more; ``root`` is
    where forms lead to at last, the word itself without a form. Null and empty texts have no words, repeated rows count each; an
    empty table gives an empty one. Other columns of ``docs`` are not read. The result reads staged tables.
    """
    if factor < 2:
        raise ValueError("a form needs more occurrences than its word, or forms lead in rings")
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(word_counts(docs, text, key, min_length, min_count))
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best")
    )
    judged = words.join(best, "word", "left").withColumn("top", -F.col("best.less"))
    good = F.col("top") >= factor * F.col("n")
    judged = scratch.write(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.form")).alias("form"), F.when(good, F.col("top")).alias("form_n")
    ))
    led = roots(judged.filter("form is not null"), scratch)
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
