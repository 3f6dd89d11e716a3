"""Spelling variants: words one letter apart, each led to its most frequent neighbour.

1. Words are counted inside the tasks, one dictionary each, so only (word, count) is shuffled. Words of at least
   `MIN_LENGTH` code points that occur `MIN_TIMES` or more are the vocabulary.
2. A word's vector counts its letters by group (`LETTER_GROUPS`). If b is a with one letter inserted, its vector has one
   more in one group; if b is a with one letter replaced, one more in one group and one less in another, or none. The trie
   of vectors has a level for every group. It is walked depth first by pairs of nodes, with a budget of one surplus and one
   deficit; the surplus comes first, which finds every pair of words from one side only. Words of the leaves reached are
   compared letter by letter.
3. The trie is cut where a node holds at most `NODE_WORDS` words; the cut is found level by level with counts of nodes
   only. A word belongs to one node of the cut and asks at every node its budget reaches. Each node is walked by one task,
   its words against the askers in blocks of bounded size. Words of one full vector beyond that bound (letters in another
   order) are dealt to several tasks. No pair of words leaves a task: per word the number of neighbours and the best of them
   do, and these are added up.
4. Roots are found by doubling pointers: a form is at least five times as frequent, so a path of forms is short.

Null texts have no words; a null id counts as an empty one. Very long words are compared one pair at a time; texts are
never cut. Rows that repeat are counted as often as they stand there. Ties go to the word that is smallest in code-point
order. No words give an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import bounded_batches
from tenderloom.session import frozen

RUN = "[A-Za-zÀ-ÿ]+"
DAMAGE = 199
MIN_LENGTH = 6
MIN_TIMES = 5
TIMES_MORE = 5
NODE_WORDS = 8192
HELD_WORDS = 300_000
PAIRS_AT_ONCE = 1 << 20
WIDE = 64  # longer words are compared one by one
# Fixed: letters by frequency, then marked letters by the letter they come from; all others are the last group.
LETTER_GROUPS = [*"etaoinsrhldcumpfgywbvkxjqz", "èéêë", "àáâãäåæ", "ìíîï", "òóôõöø", "ùúûü", "ñ", "ç", "ß", "ýþÿð"]
GROUPS = len(LETTER_GROUPS) + 1
_GROUP_OF = np.full(256, GROUPS - 1, dtype=np.uint8)
for _group, _letters in enumerate(LETTER_GROUPS):
    _GROUP_OF[list(_letters.encode("latin-1"))] = _group
_GROUP_OF[0] = 255
# Groups in which one letter can stand for another without a change of the vector.
_MIXED = np.array([len(letters) > 1 for letters in LETTER_GROUPS] + [True])
MOST = 200  # counts beyond this look alike, which only lets more pairs through to the comparison


def word_counts(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", damage: int | None = DAMAGE) -> DataFrame:
    """word, n for all runs of letters, A-Z in lower case. One in `damage` runs of a document has lost a letter (None: none)."""
    bounded_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        runs, found = re.compile(RUN), {}

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                # bytes.lower() changes A-Z only
                words = Counter(runs.findall(text.lower().decode("utf-8")))
                if damage is None:
                    for word, n in words.items():
                        found[word] = found.get(word, 0) + n
                    continue
                head = zlib.crc32(f"{doc_id}:".encode())
                for word, n in words.items():
                    key = zlib.crc32(word.encode(), head)
                    if key % damage == 0:
                        at = key % len(word)
                        word = word[:at] + word[at + 1:]
                    found[word] = found.get(word, 0) + n
                if len(found) > HELD_WORDS:
                    yield rows()
        if found:
            yield rows()

    texts = documents.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
                             F.col(text_column).cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: list[bytes]) -> np.ndarray:
    width = -(-max(1, *map(len, words)) // 8) * 8
    return np.array(words, dtype=f"S{width}").view(np.uint8).reshape(len(words), width)


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts by letter group, one row a word."""
    found = np.zeros((len(words), GROUPS), dtype=np.uint8)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    short = np.flatnonzero(sizes <= WIDE)
    if len(short):
        groups = _GROUP_OF[_letters([words[i] for i in short])]
        for g in range(GROUPS):
            found[short, g] = (groups == g).sum(axis=1)
    for i in np.flatnonzero(sizes > WIDE):
        found[i] = np.minimum(np.bincount(_GROUP_OF[np.frombuffer(words[i], dtype=np.uint8)], minlength=GROUPS), MOST)
    return found


def _with_vectors(words: DataFrame) -> DataFrame:
    """word, n, vector: one character for the count of every group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()]) + ord("0")
            keys = [row.tobytes().decode("latin-1") for row in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string())], names=["word", "n", "vector"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, vector string")


def _cut(counted: DataFrame, node_words: int) -> DataFrame:
    """node (beginning of a vector), parts: the cut of the trie through nodes of at most `node_words` words."""
    cut, depth, open_nodes = None, 0, None
    while True:
        node = F.substring("vector", 1, depth)
        rows = counted if open_nodes is None else counted.join(open_nodes, F.substring("vector", 1, depth - 1) == F.col("open"), "left_semi")
        sizes = frozen(rows.groupBy(node.alias("node")).agg(F.sum("words").alias("words")))
        ended = sizes if depth == GROUPS else sizes.where(F.col("words") <= node_words)
        cut = ended if cut is None else cut.unionByName(ended)
        open_nodes = sizes.where(F.col("words") > node_words).select(F.col("node").alias("open"))
        if depth == GROUPS or open_nodes.isEmpty():
            return frozen(cut.select("node", F.ceil(F.col("words") / node_words).cast("long").alias("parts")))
        depth += 1


def reached(vector: str, depths: list[int]) -> list[str]:
    """The nodes of the given depths that a walk from this vector can pass: no difference, a surplus, a surplus and then a deficit."""
    found = []
    for depth in depths:
        begin = vector[:depth]
        found.append(begin)
        for i in range(depth):
            more = begin[:i] + chr(ord(begin[i]) + 1) + begin[i + 1:]
            found.append(more)
            found.extend(more[:j] + chr(ord(more[j]) - 1) + more[j + 1:] for j in range(i + 1, depth) if more[j] > "0")
    return found


class Trie:
    """Words by their vectors. Level d has a node for every different beginning of d counts; leaves are the vectors themselves."""

    def __init__(self, words: list[bytes], n: np.ndarray) -> None:
        counts = vectors(words)
        order = np.lexsort(counts.T[::-1])
        self.words, self.n = [words[i] for i in order], n[order]
        counts = counts[order]
        changes = counts[1:] != counts[:-1]
        # a row opens a node of level d if it differs from the row before in one of the first d counts
        opens = np.logical_or.accumulate(changes, axis=1)
        self.children, self.counts, below = [], [], None
        for d in range(GROUPS, -1, -1):
            first = np.flatnonzero(np.r_[True, opens[:, d - 1] if d else np.zeros(len(opens), dtype=bool)]) if len(words) else np.zeros(0, dtype=int)
            ends = np.r_[first, len(words)]
            # where the children of each node begin; below the last level children are words
            self.children.append(ends if below is None else np.searchsorted(below, ends))
            self.counts.append(counts[first, d - 1].astype(np.int16) if d else np.zeros(len(first), dtype=np.int16))
            below = first
        self.children.reverse()
        self.counts.reverse()
        leaves = counts[self.children[GROUPS][:-1]]
        self.mixed = leaves[:, _MIXED].any(axis=1) | (leaves >= MOST).any(axis=1)
        short = [w if len(w) <= WIDE else b"" for w in self.words]
        self.letters = _letters(short)
        self.sizes = np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))


def _crossed(a: Trie, b: Trie, level: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of children of the paired nodes, and the number of the pair they come from."""
    a_first, a_end = a.children[level][left], a.children[level][left + 1]
    b_first, b_end = b.children[level][right], b.children[level][right + 1]
    wide = b_end - b_first
    each = (a_end - a_first) * wide
    pair = np.repeat(np.arange(len(left)), each)
    inside = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
    return a_first[pair] + inside // wide[pair], b_first[pair] + inside % wide[pair], pair


def _members(a: Trie, b: Trie, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of words of the paired leaves; those of two very large leaves in parts."""
    if len(left) > 1:
        yield _crossed(a, b, GROUPS, left, right)
        return
    first, end = (int(v) for v in a.children[GROUPS][left[0]:left[0] + 2])
    others = np.arange(*b.children[GROUPS][right[0]:right[0] + 2])
    step = max(1, PAIRS_AT_ONCE // max(1, len(others)))
    for start in range(first, end, step):
        some = np.arange(start, min(start + step, end))
        yield np.repeat(some, len(others)), np.tile(others, len(some)), np.zeros(len(some) * len(others), dtype=np.int64)


def walked(a: Trie, b: Trie) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of word pairs in leaves that one surplus and one deficit lead to, with what was spent: 0, 1 (surplus) or 2 (both)."""
    root = np.zeros(1, dtype=np.int64)
    todo = [(0, root, root, root)] if a.words and b.words else []
    while todo:
        level, left, right, spent = todo.pop()
        if len(left) > 1:
            grows = (a.children[level][left + 1] - a.children[level][left]) * (b.children[level][right + 1] - b.children[level][right])
            if grows.sum() > PAIRS_AT_ONCE:
                half = min(max(int(np.searchsorted(np.cumsum(grows), grows.sum() / 2)), 1), len(left) - 1)
                todo += [(level, left[half:], right[half:], spent[half:]), (level, left[:half], right[:half], spent[:half])]
                continue
        if level == GROUPS:
            for one, two, pair in _members(a, b, left, right):
                yield one, two, spent[pair]
            continue
        left, right, pair = _crossed(a, b, level, left, right)
        spent = spent[pair]
        more = b.counts[level + 1][right] - a.counts[level + 1][left]
        keep = (more == 0) | ((more == 1) & (spent == 0)) | ((more == -1) & (spent == 1))
        left, right, spent = left[keep], right[keep], (spent + (more != 0))[keep]
        if level + 1 == GROUPS:
            # equal vectors can only be one letter apart where a group has several letters
            keep = (spent > 0) | a.mixed[left]
            left, right, spent = left[keep], right[keep], spent[keep]
        if len(left):
            todo.append((level + 1, left, right, spent))


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced between the words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def verified(a: Trie, b: Trie, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs of places are one letter apart."""
    found = np.zeros(len(left), dtype=bool)
    longer = b.sizes[right] - a.sizes[left]
    short = (a.sizes[left] <= WIDE) & (b.sizes[right] <= WIDE)
    width = max(a.letters.shape[1], b.letters.shape[1])
    x, y = (np.pad(t.letters, ((0, 0), (0, width - t.letters.shape[1]))) for t in (a, b))
    same = np.flatnonzero(short & (longer == 0))
    if len(same):
        # eight letters at a time first: at most one such lane may differ
        lanes = x.view(np.uint64)[left[same]] != y.view(np.uint64)[right[same]]
        same = same[lanes.sum(axis=1) == 1]
        found[same] = (x[left[same]] != y[right[same]]).sum(axis=1) == 1
    more = np.flatnonzero(short & (longer == 1))
    if len(more):
        one, two = x[left[more]], y[right[more]]
        begin = (one != two).argmax(axis=1)
        shifted = one != np.pad(two[:, 1:], ((0, 0), (0, 1)))
        end = np.where(shifted.any(axis=1), width - 1 - shifted[:, ::-1].argmax(axis=1), -1)
        found[more] = end < begin
    for i in np.flatnonzero(~short):
        found[i] = one_apart(a.words[left[i]], b.words[right[i]])
    return found


def _neighbours(asking: Trie, there: Trie) -> Iterator[tuple[bytes, int, int, bytes]]:
    """word, number of neighbours, occurrences and letters of the best one, for the words of both sides that have any."""
    everyone = list(zip((-there.n).tolist() + (-asking.n).tolist(), there.words + asking.words))
    order = sorted(range(len(everyone)), key=everyone.__getitem__)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    size, shift = len(order), len(there.words)
    near, best = np.zeros(size, dtype=np.int64), np.full(size, size, dtype=np.int64)
    for left, right, spent in walked(asking, there):
        for start in range(0, len(left), PAIRS_AT_ONCE):
            part = slice(start, start + PAIRS_AT_ONCE)
            good = verified(asking, there, left[part], right[part])
            one, two, twice = left[part][good] + shift, right[part][good], spent[part][good] == 0
            near += np.bincount(one, minlength=size)
            np.minimum.at(best, one, rank[two])
            # equal vectors meet from both sides, all other pairs from one
            one, two = one[~twice], two[~twice]
            near += np.bincount(two, minlength=size)
            np.minimum.at(best, two, rank[one])
    for i in np.flatnonzero(near).tolist():
        minus_n, form = everyone[order[best[i]]]
        yield everyone[i][1], int(near[i]), -minus_n, form


ASKED_AT_ONCE = 4 * NODE_WORDS


def _walk_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, part, asks, word, n) sorted so that a node's own words come before those that ask there."""
    node, there, asking = None, [], []
    index = None

    def trie(rows: list[tuple[str, int]]) -> Trie:
        return Trie([w.encode("latin-1") for w, _ in rows], np.array([n for _, n in rows], dtype=np.int64))

    def answer() -> Iterator[pa.RecordBatch]:
        nonlocal index
        if not there or not asking:
            asking.clear()
            return
        index = index or trie(there)
        rows = list(_neighbours(trie(asking), index))
        asking.clear()
        if rows:
            word, near, n, form = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in word], pa.string()), pa.array(near, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([w.decode("latin-1") for w in form], pa.string())], names=["word", "near", "best_n", "best"])

    for batch in batches:
        for at, part, asks, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if node != (at, part):
                yield from answer()
                node, index = (at, part), None
                there.clear()
            if not asks:
                there.append((word, n))
            else:
                asking.append((word, n))
                if len(asking) >= ASKED_AT_ONCE:
                    yield from answer()
    yield from answer()


def near_words(words: DataFrame, node_words: int = NODE_WORDS) -> DataFrame:
    """word, n_near, best_n, best: for every word of (word, n) with neighbours their number and the most frequent one. Words differ."""
    placed = frozen(_with_vectors(words))
    classes = frozen(placed.groupBy("vector").agg(F.count(F.lit(1)).alias("words")))
    cut = _cut(classes, node_words)
    depths = sorted(r[0] for r in cut.select(F.length("node")).distinct().collect())

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                keys = batch.column(0).slice(start, 2000).to_pylist()
                found = [reached(k, depths) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, f in zip(keys, found) for _ in f], pa.string()),
                                                  pa.array([v for f in found for v in f], pa.string())], names=["vector", "node"])

    # every vector begins with exactly one node of the cut, its own; the others are those its budget reaches
    asked = classes.select("vector").mapInArrow(reach, "vector string, node string").join(cut, "node")
    asked = frozen(asked.select("vector", "node", "parts"))
    routed = placed.join(asked, "vector")
    own = routed.where(F.col("vector").startswith(F.col("node"))).select(
        "node", F.pmod(F.xxhash64("word"), F.col("parts")).alias("part"), F.lit(False).alias("asks"), "word", "n")
    asking = routed.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "word", "n")
    dealt = own.unionByName(asking).repartition("node", "part").sortWithinPartitions("node", "part", "asks")
    met = dealt.mapInArrow(_walk_nodes, "word string, near long, best_n long, best string")
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct(-F.col("best_n"), "best")).alias("best")).select(
        "word", "n_near", (-F.col("best.col1")).alias("best_n"), F.col("best.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root from (word, form) without cycles: the last word that forms lead to, by doubling pointers."""
    found = frozen(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = found.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        further = frozen(found.join(ahead, found["root"] == ahead["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        found = further.drop("moved")


def variants(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", damage: int | None = DAMAGE, min_length: int = MIN_LENGTH,
             min_times: int = MIN_TIMES, node_words: int = NODE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for the vocabulary of the texts."""
    counts = word_counts(documents, id_column, text_column, damage)
    words = frozen(counts.where((F.length("word") >= min_length) & (F.col("n") >= min_times)))
    near = near_words(words, node_words)
    enough = F.col("best_n") >= TIMES_MORE * F.col("n")
    formed = frozen(words.join(near, "word", "left").select("word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                          F.when(enough, F.col("best_n")).alias("form_n")))
    last = roots(formed.where("form IS NOT NULL"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
