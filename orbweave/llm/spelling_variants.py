"""Spelling variants: words that differ by one letter, found in tries.

1.  Runs of letters are counted over all documents; those that are long and frequent
    enough are the vocabulary, a table.
2.  Ranges of the sorted vocabulary become compact tries, each of a bounded number
    of words and letters, in a table as well.
3.  Tries are broadcast, a bounded number at once.  Every word's Levenshtein
    automaton of distance one goes depth-first through all of them together with
    their paths and emits the words it accepts.
4.  A word's neighbours are reduced to their number and the best of them, its form,
    before anything is shuffled.  Forms are followed to their roots, one step a join.

The automaton's state after t letters of a path says which places of the word they
may have brought it to: place t without a change, or t - 1, t, t + 1 with one.  So
four bits are enough for any word, and a step depends on the state and on
whether the next letter is the word's at t - 1, t or t + 1.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.common import ddl, discard, id_and_text, partitions, slices, tool, written

#: A trie has at most so many words, and so many letters or one word.
SHARD_WORDS, SHARD_LETTERS = 1 << 15, 1 << 20
#: Letters of the tries' words that are broadcast at once; a trie more at most.
BROADCAST_LETTERS = 6 << 20
#: Different words that a task counts before it gives the counts away.
COUNTED = 1 << 18
#: No path of forms is longer, as each is at least twice as frequent as the last.
LONGEST_PATH = 64

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
SHARDS = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("letters", pa.int64()), ("trie", pa.binary())])
PAIRS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def runs(text: str) -> list[str]:
    """The maximal runs of letters of a text, A-Z in lower case and all others as they are."""
    return _RUN.findall(text.encode().lower().decode())  # bytes have no other letters to lower


def without_letter(run: str, h: int) -> str:
    """The run without the letter that a number tells."""
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, noise: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (word, n): how often each word occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w, k) for w, k in n.items() if k]
            batch = pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.int64())], schema=COUNTS)
            n.clear()
            return batch

        letters = 0
        for whole in batches:
            for b in slices(whole):
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = runs(text or "")
                    n.update(found)
                    letters += len(text or "")
                    if noise:
                        own = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
                        for run in set(found):
                            if not (h := zlib.crc32(run.encode(), own)) % noise:
                                k = found.count(run)
                                n[run] -= k
                                n[without_letter(run, h)] += k
                    if len(n) >= COUNTED or letters >= COUNTED << 8:
                        yield flush()
                        letters = 0
        yield flush()

    found = id_and_text(docs, id_column, text_column).mapInArrow(count, ddl(COUNTS))
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A compact trie of sorted different words: an edge has a string of letters.

    Nodes are numbered as a depth-first walk first meets them; the root is 0.
    ``kids`` has, for each node, its children by first letter; ``label`` the letters
    on the edge to a node; ``n`` the count of the word that ends there, or 0.
    """

    def __init__(self, label: list[bytes], kids: list[dict[int, int]], n: list[int]):
        self.label, self.kids, self.n = label, kids, n


def encode_trie(words: list[bytes], counts: list[int]) -> bytes:
    """A trie's bytes: for each node in order its depth, the letters of its edge, and its count.

    ``words`` are sorted, different and not empty.
    """
    depth, label, n = [0], [b""], [0]
    path = [0]  # the nodes from the root to the last word
    at = [0]  # letters before the end of each of them
    last = b""
    for word, k in zip(words, counts, strict=True):
        common = 0
        for x, y in zip(last, word, strict=False):
            if x != y:
                break
            common += 1
        while len(path) > 1 and at[-2] >= common:
            path.pop()
            at.pop()
        if at[-1] > common:  # the edge to this node is cut in two
            node = path[-1]
            cut = len(label[node]) - (at[-1] - common)
            rest = label[node][cut:]
            # all below the cut come one deeper; they are the nodes from here to the end
            depth[node:] = [depth[node], *(d + 1 for d in depth[node:])]
            label[node:] = [label[node][:cut], rest, *label[node + 1 :]]
            n[node:] = [0, *n[node:]]
            at[-1] = common
        depth.append(len(path))
        label.append(word[common:])
        n.append(k)
        path.append(len(depth) - 1)
        at.append(len(word))
        last = word
    arrays = np.array([len(depth)], "<i8"), np.array(depth, "<i4"), np.array([len(x) for x in label], "<i4"), np.array(n, "<i8")
    return b"".join(x.tobytes() for x in arrays) + b"".join(label)


def decode_trie(data: bytes) -> Trie:
    size = int(np.frombuffer(data, "<i8", 1)[0])
    depth = np.frombuffer(data, "<i4", size, 8).tolist()
    lengths = np.frombuffer(data, "<i4", size, 8 + 4 * size)
    n = np.frombuffer(data, "<i8", size, 8 + 8 * size).tolist()
    ends = 8 + 16 * size + np.cumsum(lengths)
    label = [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
    kids: list[dict[int, int]] = [{} for _ in range(size)]
    path: list[int] = []
    for node in range(size):
        del path[depth[node] :]
        if path:
            kids[path[-1]][label[node][0]] = node
        path.append(node)
    return Trie(label, kids, n)


#: Bits of a state after t letters: at place t unchanged; at t - 1 (a letter more), t (another), t + 1 (one less).
SAME, MORE, OTHER, LESS = 1, 2, 4, 8


def _steps() -> list[list[int]]:
    """The next state by state and by which of the word's letters at t - 1, t, t + 1 (bits 1, 2, 4) the next one is."""
    table = []
    for state in range(16):
        row = []
        for equal in range(8):
            new = 0
            if state & SAME:
                new |= MORE | (SAME if equal & 2 else OTHER) | (LESS if equal & 4 else 0)
            new |= state & MORE if equal & 1 else 0
            new |= state & OTHER if equal & 2 else 0
            new |= state & LESS if equal & 4 else 0
            row.append(new)
        table.append(row)
    return table


_STEP = _steps()


def neighbours(trie: Trie, word: bytes) -> list[tuple[bytes, int]]:
    """The trie's words at distance one of a word, with their counts."""
    label, kids, n = trie.label, trie.kids, trie.n
    size, step = len(word), _STEP
    padded = b"\0" + word + b"\0\0\0"  # no letter is 0
    found = []
    stack = [(0, 0, SAME, b"")]
    while stack:
        node, t, state, path = stack.pop()
        if n[node] and ((state & OTHER and t == size) or (state & MORE and t == size + 1) or (state & (LESS | SAME) and t == size - 1)):
            found.append((path, n[node]))
        below = kids[node]
        if not state & SAME:  # what is left of the word, from each place that is alive
            for bit, place in ((MORE, t - 1), (OTHER, t), (LESS, t + 1)):
                if state & bit and place < size and (kid := below.get(word[place])) is not None and word.startswith(label[kid], place):
                    stack.append((kid, t + len(label[kid]), bit, path + label[kid]))
            continue
        for c, kid in below.items():
            letters, i, q = label[kid], t, state
            if c == padded[t + 1]:
                for c in letters:
                    if i > size:
                        q = 0
                        break
                    q = step[q][(padded[i] == c) | (padded[i + 1] == c) << 1 | (padded[i + 2] == c) << 2]
                    if not q:
                        break
                    i += 1
            else:  # a change here, whatever was alive; then the edge's other letters as they are
                rest = letters[1:]
                q = (MORE if word.startswith(rest, t) else 0) | (OTHER if word.startswith(rest, t + 1) else 0) | (LESS if c == padded[t + 2] and word.startswith(rest, t + 2) else 0)
                i += len(letters)
            if q:
                stack.append((kid, i, q, path + letters))
    return found


def trie_shards(words: DataFrame) -> DataFrame:
    """Compact tries (part, number, letters, trie) of a table of words (word, n); a row a trie."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, letters = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        counts: list[int] = []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([letters]), pa.array([encode_trie(held, counts)], pa.binary())], schema=SHARDS)

        for whole in batches:
            for b in slices(whole):
                for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if held and (len(held) >= SHARD_WORDS or letters + len(word) > SHARD_LETTERS):
                        yield close()
                        number, letters = number + 1, 0
                        held.clear()
                        counts.clear()
                    held.append(word.encode("latin-1"))
                    counts.append(n)
                    letters += len(word)
        if held:
            yield close()

    ordered = words.select("word", "n").repartitionByRange(partitions(words.sparkSession), "word").sortWithinPartitions("word")
    return written(ordered.mapInArrow(build, ddl(SHARDS)), "tries")


def near_words(words: DataFrame, tries: DataFrame | None = None) -> DataFrame:
    """Rows (word, n, near, near_n): all ordered pairs of words at distance one.

    ``words`` (word, n) are different, of letters of one byte in Latin-1, none 0.
    """
    spark = words.sparkSession
    tries = trie_shards(words) if tries is None else tries
    groups: list[list[tuple[int, int]]] = []
    held = 0
    for r in tries.select("part", "number", "letters").orderBy("part", "number").toLocalIterator():
        if not groups or held >= BROADCAST_LETTERS:
            groups.append([])
            held = 0
        groups[-1].append((r["part"], r["number"]))
        held += r["letters"]
    rows = words.select("word", "n").repartition(partitions(spark))
    found = [rows.mapInArrow(_search(spark, tries, group[0], group[-1]), ddl(PAIRS)) for group in groups]
    if not found:
        return spark.createDataFrame([], ddl(PAIRS))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def _search(spark: SparkSession, tries: DataFrame, first: tuple[int, int], last: tuple[int, int]):
    """A function that finds all its words' neighbours in a group of tries, from the first to the last of them."""
    at = F.struct("part", "number")
    some = tries.where((at >= F.struct(F.lit(first[0]), F.lit(first[1]))) & (at <= F.struct(F.lit(last[0]), F.lit(last[1]))))
    shared = spark.sparkContext.broadcast([bytes(r["trie"]) for r in some.select("trie").collect()])
    key = "tries", uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tool(key, lambda: [decode_trie(x) for x in shared.value])
        for whole in batches:
            for b in slices(whole):
                rows: list[tuple[str, int, str, int]] = []
                for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    letters = word.encode("latin-1")
                    for trie in own:
                        rows += [(word, n, near.decode("latin-1"), k) for near, k in neighbours(trie, letters)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, PAIRS.types, strict=True)], schema=PAIRS)

    return run


def with_roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of a table (word, form) of the words that have a form: where forms end.

    Words whose root is found leave the table that is joined on.  A word is the form
    of the words near it only, and so of a bounded number.
    """
    step = written(forms.select("word", "form"), "forms")
    next_ = step.select(F.col("word").alias("at"), F.col("form").alias("next"))
    going, done = step.select("word", F.col("form").alias("at")), None
    for _ in range(LONGEST_PATH):
        moved = written(going.join(next_, "at", "left"), "paths")
        ended = moved.where("next is null").select("word", F.col("at").alias("root"))
        done = ended if done is None else done.union(ended)
        going = moved.where("next is not null").select("word", F.col("next").alias("at"))
        if going.isEmpty():
            return done
    raise ValueError("forms that do not end")


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, factor: int = 5, noise: int = 199, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one a word of the vocabulary.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case;
    where crc32 of ``<doc_id>:<run>`` is a multiple of ``noise``, a letter is left out
    (0: never).  Words have ``least_letters`` at least and ``least_count``
    occurrences.  ``n_near`` counts the words at distance one.  The form is the most
    frequent of them, the least in code-point order of several, if it has ``factor``
    (2 or more) times the word's n; else null, as is ``form_n``.  The root is where
    forms, followed from the word, end.  A null text has no words; a null id is an
    empty one; rows with one id, or without, are documents of their own; other
    columns are ignored; an empty table has no words.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    counts = word_counts(docs, noise, id_column, text_column)
    words = written(counts.where((F.col("n") >= least_count) & (F.length("word") >= least_letters)), "words")
    tries = trie_shards(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    near = written(near_words(words, tries).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")), "near")
    discard(tries)
    form = -F.col("best.less") >= factor * F.col("n")
    near = near.select("word", "n_near", F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n"))
    roots = with_roots(near.where("form is not null"))
    found = words.join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
