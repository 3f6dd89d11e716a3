"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the first four and five characters of longer words, in lower case (see `terms`). Examples are labelled rows,
one of each group of near copies (`near_copies`), and of these at most `EXAMPLES` of each label, those with the smallest hash of
their id. Every term of every example is in the index. Inverse document frequencies are counted over all documents. A
document's vector is (1 + ln tf) * idf * w with unit length, taken from its whole text; w is 1 for terms that depend on the label
(in `MIN_ROWS` examples and a chi-squared statistic of `MIN_CHI2` or more) and `OTHERS` for all others, so that these
decide only where a text has none of the first kind.

The index keeps the examples in blocks of `BLOCK` and, per term and block, the postings and their largest weight. For a
text the block maxima give every block an upper bound; blocks are opened from the highest bound down until no bound reaches
the k-th best cosine found. That is the exact result of a full scan. The k neighbours vote with their cosine, each label
weighted back to its share of all labelled rows, and a logistic curve turns the vote into a probability. It is fitted on a
fifth of the examples asked against the other four; the index that judges holds all of them, so a copy of any example finds
it with cosine 1. A text without a term of any example gets the smoothed share of toxic rows among such examples. The nearest
examples with their labels and cosines are the evidence.

Null and empty texts have no terms and are scored by that share. Rows that repeat an id get a score each. An id that is
labelled more than once counts as toxic if any label says so; null labels and labels without a document count for
nothing. Without labelled examples every score is 0. Equal cosines go to the smaller id. Very long texts are read whole, in
memory that grows with one text. Empty tables give no rows. Extra columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import bounded_batches, parted
from tenderloom.llm.near_copies import near_groups
from tenderloom.session import frozen

EXAMPLES = 4000
MIN_ROWS = 4
MIN_CHI2 = 22.0
OTHERS = 0.003
NEIGHBOURS = 15
EVIDENCE = 3
PRIOR_VOTES = 1.0
STARTS = (4, 5)
LEVELS = (2, 3)
BLOCK = 256
SLICE = 16_384
FREQUENT = 16
ROWS, ENTRIES, POSTINGS = 256, 1 << 18, 1 << 20
CHARACTERS = 1 << 17
KNOWN_WORDS = 1 << 18
COSINE_STEPS = 1e12
_LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> dict[str, int]:
    """term -> occurrences: "=" and a whole word, or the beginning of longer words.

    A beginning that several words of the text share is also a term of its own for each of `LEVELS` that the number of
    these words reaches ("+3 abcd"), as a cosine alone does not see how often a text of few terms has them.
    """
    found: dict[str, int] = {}
    starts: dict[str, int] = {}
    for word, n in Counter(_LETTERS.findall((text or "").lower())).items():
        found["=" + word] = n
        for size in STARTS:
            if len(word) > size:
                start = word[:size]
                starts[start] = starts.get(start, 0) + n
    found.update(starts)
    for start, n in starts.items():
        if n >= LEVELS[0]:
            found.update((f"+{level} {start}", n) for level in LEVELS if n >= level)
    return found


class TermCounter:
    """Counts the terms of a vocabulary in many texts at once; words already met cost one look-up."""

    def __init__(self, vocabulary: list[str] | pa.StringArray):
        self.places = {t: k for k, t in enumerate(vocabulary.to_pylist() if isinstance(vocabulary, pa.Array) else vocabulary)}
        self.levels = [(level, np.full(len(vocabulary), -1, np.int64)) for level in LEVELS]
        for t, k in self.places.items():
            if t[0] == "+":
                level, start = t[1:].split(" ")
                self.levels[LEVELS.index(int(level))][1][self.places[start]] = k
        self.known: dict[str, int] = {}
        self.table = np.full((KNOWN_WORDS, 1 + len(STARTS)), -1, np.int64)

    def _number(self, word: str) -> int:
        k = self.known[word] = len(self.known)
        self.table[k] = [self.places.get("=" + word, -1), *(self.places.get(word[:size], -1) if len(word) > size else -1 for size in STARTS)]
        return k

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The terms of every word, one row a word, -1 for none."""
        found = []
        for at in range(0, len(words), KNOWN_WORDS // 2):
            if len(self.known) > KNOWN_WORDS // 2:
                self.known.clear()
            get, number = self.known.get, self._number
            codes = [number(w) if (k := get(w)) is None else k for w in words[at:at + KNOWN_WORDS // 2]]
            found.append(self.table[codes])
        return np.concatenate(found) if found else self.table[:0]

    def counted(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's entries begin (and the last end), and the entries: terms in ascending order, occurrences."""
        parts, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHARACTERS):
                size += len(texts[end] or "")
                end += 1
            parts.append(self._counted(texts[at:end]))
            at = end
        if len(parts) == 1:
            return parts[0]
        begins = np.cumsum([0] + [len(t) for _, t, _ in parts])
        starts = [s[:-1] + b for (s, _, _), b in zip(parts, begins)] + [begins[-1:]]
        return np.concatenate(starts), *(np.concatenate([np.zeros(0, np.int64), *(p[c] for p in parts)]) for c in (1, 2))

    def _counted(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, words, lengths = max(len(self.places), 1), [], []
        for text in texts:
            own = _LETTERS.findall((text or "").lower())
            words += own
            lengths.append(len(own))
        numbers = self._numbers(words)
        row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
        keys = np.concatenate([row[(has := numbers[:, c] >= 0)] * size + numbers[has, c] for c in range(numbers.shape[1])])
        keys, counts = np.unique(keys, return_counts=True)
        more = [(keys, counts)]
        for level, terms_of in self.levels:
            up = terms_of[keys % size] if len(keys) else keys
            has = (counts >= level) & (up >= 0)
            more.append((keys[has] // size * size + up[has], counts[has]))
        keys, counts = np.concatenate([k for k, _ in more]), np.concatenate([n for _, n in more])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        return np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) * size), keys % size, counts


def _ranges(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges low .. low + size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Postings of unit vectors in blocks, with the largest weight of every term in every block.

    Terms in at least one of `FREQUENT` rows are rows of a matrix a block, which takes at most `FREQUENT` times the room of
    their postings, and have their maxima in one of terms and blocks. Nearly all other terms are in few blocks: the postings of
    a term lie in runs, one for every block that has it. `first` has where the runs of a term begin; a run has its block, its
    largest weight and where its postings begin. So memory grows with the postings, not with terms times blocks.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], vocabulary: int, block: int = BLOCK):
        self.block, self.size = block, len(rows)
        frequency = np.zeros(vocabulary, np.int64)
        for t, _ in rows:
            frequency[t] += 1  # a term is at most once in a row
        # rows that share a heavy and frequent term stand together, so that few blocks have high maxima for a query
        leading = [int(t[np.argmax(x * frequency[t])]) if len(t) else -1 for t, x in rows]
        self.order = np.array(sorted(range(len(rows)), key=lambda k: (leading[k], k)), dtype=np.int64)
        blocks = -(-len(rows) // block)
        frequent = np.flatnonzero((frequency > 1) & (frequency * FREQUENT >= len(rows)))
        self.column = np.full(vocabulary, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        self.frequent = len(frequent)
        self.maxima = np.zeros((len(frequent), blocks))
        self.matrices = np.zeros((blocks, len(frequent), block))
        postings, filled = int(frequency.sum() - frequency[frequent].sum()), 0
        self.places, self.values = np.zeros(postings, np.int16 if block < 1 << 15 else np.int32), np.zeros(postings)
        run_terms, run_blocks, run_sizes, run_maxima = ([] for _ in range(4))
        for b in range(blocks):
            own = self.order[b * block:(b + 1) * block]
            term = np.concatenate([rows[k][0] for k in own]).astype(np.int64)
            weight = np.concatenate([rows[k][1] for k in own])
            place = np.repeat(np.arange(len(own)), [len(rows[k][0]) for k in own])
            column = self.column[term]
            matrix = self.matrices[b]
            matrix[column[column >= 0], place[column >= 0]] = weight[column >= 0]
            self.maxima[:, b] = matrix.max(axis=1)
            rest = np.flatnonzero(column < 0)
            rest = rest[np.argsort(term[rest], kind="stable")]
            begins = np.flatnonzero(np.diff(term[rest], prepend=-1))
            run_terms.append(term[rest][begins].astype(np.int32))
            run_blocks.append(np.full(len(begins), b, np.int16 if blocks < 1 << 15 else np.int32))
            run_sizes.append(np.diff(begins, append=len(rest)).astype(np.int32))
            # rounded up, as the maxima are bounds
            largest = np.maximum.reduceat(weight[rest], begins) if len(rest) else weight[rest]
            run_maxima.append(np.nextafter(largest.astype(np.float32), np.float32(2)))
            self.places[filled:filled + len(rest)], self.values[filled:filled + len(rest)] = place[rest], weight[rest]
            filled += len(rest)
        run_terms, run_blocks, run_sizes, run_maxima = (
            np.concatenate(parts) if parts else np.zeros(0, kind) for kind, parts in
            ((np.int32, run_terms), (np.int32, run_blocks), (np.int32, run_sizes), (np.float32, run_maxima)))
        # the postings stay where they are, block by block; the runs are put in order of their terms
        by_term = np.argsort(run_terms, kind="stable")
        self.first = np.searchsorted(run_terms[by_term], np.arange(vocabulary + 1)).astype(np.int32)
        self.run_blocks, self.run_sizes, self.run_maxima = run_blocks[by_term], run_sizes[by_term], run_maxima[by_term]
        self.run_starts = (np.cumsum(run_sizes, dtype=np.int64) - run_sizes)[by_term].astype(np.int32 if postings < 1 << 31 else np.int64)

    def _opened(self, b: int, row: np.ndarray, runs: np.ndarray, weights: np.ndarray, frequent: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
        """A sortable number for every query row and example of a block: cosine first, then the smaller example; -1 below any cosine.

        It is -1 also for the examples marked in `without`. `frequent` has a row per query with its weights of the frequent terms, the runs of this block are those of all others.
        """
        rows = len(frequent)
        low, sizes = self.run_starts[runs].astype(np.int64), self.run_sizes[runs].astype(np.int64)
        total, ends = (frequent @ self.matrices[b]).ravel(), np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POSTINGS)))
            n, p = sizes[at:end], _ranges(low[at:end], sizes[at:end])
            total += np.bincount(np.repeat(row[at:end] * self.block, n) + self.places[p], weights=self.values[p] * np.repeat(weights[at:end], n), minlength=len(total))
            at = end
        steps = np.rint(total.reshape(rows, self.block) * COSINE_STEPS).astype(np.int64)
        own = np.zeros(self.block, np.int64)
        own[:len(self.order[b * self.block:(b + 1) * self.block])] = self.order[b * self.block:(b + 1) * self.block]
        if without is not None:
            steps[:, without[own]] = 0
        return np.where(steps > 0, steps * self.size + (self.size - 1 - own), -1)

    def _group(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None) -> np.ndarray:
        """Every row first opens its most promising block, then, block by block, all rows whose k-th best a block may still beat.

        So a block is opened for many rows at once.
        """
        rows, blocks, column = len(starts) - 1, len(self.matrices), self.column[terms]
        row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(starts))
        frequent = np.zeros((rows, self.frequent))
        frequent[row[column >= 0], column[column >= 0]] = weights[column >= 0]
        row, terms, weights = row[column < 0], terms[column < 0], weights[column < 0]
        sizes = (self.first[terms + 1] - self.first[terms]).astype(np.int64)
        runs, row, weights = _ranges(self.first[terms].astype(np.int64), sizes).astype(np.int32), np.repeat(row, sizes), np.repeat(weights, sizes)
        block = self.run_blocks[runs]
        bounds = frequent @ self.maxima
        bounds += np.bincount(row * np.int64(blocks) + block, weights=weights * self.run_maxima[runs], minlength=rows * blocks).reshape(rows, blocks)
        # the runs met, block by block, in each by row and term
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(blocks + 1))
        row, runs, weights = row[order], runs[order], weights[order]
        best, leading = np.full((rows, k), -1, np.int64), bounds.argmax(axis=1)
        for turn in (0, 1):
            for b in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
                if turn == 0:
                    more = leading == b
                else:
                    least = best.min(axis=1)
                    # the small allowance keeps rounding from closing a block that holds a tie
                    more = (leading != b) & ((least < 0) | (bounds[:, b] >= least // self.size / COSINE_STEPS - 1e-9))
                own = np.flatnonzero(more & (bounds[:, b] > 0))
                if not len(own):
                    continue
                number = np.full(rows, -1, np.int64)
                number[own] = np.arange(len(own))
                low, high = edges[b], edges[b + 1]
                asked = number[row[low:high]]
                met = np.flatnonzero(asked >= 0)
                found = self._opened(b, asked[met], runs[low:high][met], weights[low:high][met], frequent[own], without)
                best[own] = np.partition(np.concatenate((best[own], found), axis=1), -k, axis=1)[:, -k:]
        return -np.sort(-best, axis=1)

    def nearest_of(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For every query row the k largest cosines above zero and their row numbers, ties by row number; 0 and -1 behind the last.

        `without` marks rows that are passed over, as if the index had only the others.
        """
        found, at = [np.full((0, k), -1, np.int64)], 0
        while at < len(starts) - 1:
            end = min(at + ROWS, max(at + 1, int(np.searchsorted(starts, starts[at] + ENTRIES, side="right")) - 1))
            low, high = starts[at], starts[end]
            found.append(self._group(starts[at:end + 1] - low, terms[low:high], weights[low:high], k, without) if self.size else np.full((end - at, k), -1, np.int64))
            at = end
        keys = np.concatenate(found)
        size = max(self.size, 1)
        return np.where(keys < 0, 0.0, keys // size / COSINE_STEPS), np.where(keys < 0, -1, size - 1 - keys % size)

    def nearest(self, found: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The same for one query."""
        scores, ids = self.nearest_of(np.array([0, len(found)]), found, weights, k)
        return [(s, n) for s, n in zip(scores[0].tolist(), ids[0].tolist()) if n >= 0]


def _packed(terms: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Terms as 32-bit integers, occurrences as the smallest unsigned ones that hold the largest."""
    return terms.astype(np.int32).tobytes(), counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _told(terms: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What was packed."""
    found = np.frombuffer(terms, np.int32)
    return found, np.frombuffer(counts, f"u{len(counts) // max(len(found), 1) or 1}").astype(np.int64)


@dataclass
class Judge:
    """All that is needed to score a text; of bounded size. The index is built where it is first used.

    The examples are pairs of terms and unit weights, or `counted`: a table of their terms and occurrences as bytes, which
    takes less than half the room and passes through the driver as it came.
    """

    vocabulary: list[str] | pa.StringArray = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    examples: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    ids: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    label_weights: np.ndarray = field(default_factory=lambda: np.ones(2))
    slope: float = 8.0
    offset: float = -4.0
    base: float = 0.0
    without_terms: float = 0.0
    neighbours: int = NEIGHBOURS
    counted: pa.Table | None = None

    def __getstate__(self) -> dict:
        """Without what is built where it is used; the examples as three long arrays, which a worker can give back as a whole."""
        state = {k: v for k, v in self.__dict__.items() if k not in ("index", "counter", "examples")}
        sizes = np.array([len(t) for t, _ in self.examples], np.int64)
        long = (np.concatenate([np.zeros(0, kind), *(e[c] for e in self.examples)]) for c, kind in enumerate((np.int32, np.float64)))
        return state | {"long": (np.concatenate(([0], np.cumsum(sizes))), *long)}

    def __setstate__(self, state: dict) -> None:
        starts, told, units = state.pop("long")
        self.__dict__.update(state)
        self.examples = [(told[a:b], units[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]

    @cached_property
    def index(self) -> BlockMaxIndex:
        rows = self.examples if self.counted is None else self._unpacked(self.counted)
        self.examples, self.counted = [], None  # they are in the index now
        return BlockMaxIndex(rows, len(self.weights))

    def _unpacked(self, counted: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """The counted examples as pairs of terms and unit weights, in two long arrays, which a worker can give back as a whole."""
        starts = np.concatenate(([0], np.cumsum(pc.binary_length(counted["terms"]).to_numpy() // 4, dtype=np.int64)))
        terms, units = np.empty(starts[-1], np.int32), np.empty(starts[-1])
        for at in range(0, counted.num_rows, BLOCK):
            part, edges = counted.slice(at, BLOCK), starts[at:at + BLOCK + 1]
            told = [_told(t.as_buffer(), n.as_buffer()) for t, n in zip(part["terms"], part["counts"])]
            own = slice(edges[0], edges[-1])
            terms[own] = np.concatenate([t for t, _ in told])
            units[own] = self.units(edges - edges[0], terms[own], np.concatenate([n for _, n in told]))
        return [(terms[a:b], units[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]

    @cached_property
    def counter(self) -> TermCounter:
        return TermCounter(self.vocabulary)

    def units(self, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The weights of the entries; those of a text have unit length."""
        x = (1 + np.log(counts)) * self.weights[terms]
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        return x / np.sqrt(np.bincount(row, weights=x * x, minlength=len(starts) - 1))[row]

    def votes(self, cosines: np.ndarray, near: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The toxic share of the neighbours' cosines, drawn to the base rate where the neighbours are few or far."""
        own = np.where(near < 0, 0, labels[near]) if len(labels) else np.zeros(near.shape, np.int64)
        parts = cosines * self.label_weights[own]
        return ((parts * own).sum(axis=1) + PRIOR_VOTES * self.base) / (parts.sum(axis=1) + PRIOR_VOTES)

    def judged(self, texts: list, counter: TermCounter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the texts, and their nearest examples as cosines and row numbers."""
        starts, terms_of, counts = (counter or self.counter).counted(texts)
        cosines, near = self.index.nearest_of(starts, terms_of, self.units(starts, terms_of, counts), self.neighbours)
        curve = 1 / (1 + np.exp(-(self.slope * self.votes(cosines, near, self.labels) + self.offset)))
        return np.where(near[:, 0] < 0, self.without_terms, curve), cosines, near


def fitted_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps; targets are smoothed so that clean splits stay finite."""
    positive, negative = weights[labels == 1].sum(), weights[labels == 0].sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x, beta, penalty = np.stack([votes, np.ones_like(votes)], 1), np.array([8.0, -4.0]), 1e-2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (p - target)) + penalty * (beta - [8.0, -4.0])
        beta = beta - np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + penalty * np.eye(2), gradient)
        beta = np.clip(beta, -60, 60)
    return float(max(beta[0], 0.0)), float(beta[1])


def _unlike(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_hash, toxic, h: of known labels (doc_id, toxic, h) one text for each label of every group of near copies.

    Groups are those of `near_copies`: nothing goes that is not alike in shingle Jaccard. Otherwise the words of one text
    that stands in the examples many times would look as if they depended on the label.
    """
    _, touched = parted(docs, "doc_id", known.select("doc_id"))
    row = F.struct(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    groups = near_groups(touched.select(row.alias("row"), "text"), id_column="row").select("doc_id.*", F.col("component_id").alias("group"))
    met = groups.join(known.select("doc_id", "toxic"), "doc_id")
    kept = met.groupBy("toxic", "group").agg(F.min(F.struct("h", "doc_id", "text_hash")).alias("row"))
    return kept.select("row.doc_id", "row.text_hash", "toxic", "row.h")


def _vocabulary(sample: DataFrame, rows: dict[int, int]) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of the examples in order, and what each weighs by its chi-squared statistic between term and label.

    They stay in Arrow: on the driver a string object for each would take ten times the room.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[toxic].update(terms(text).keys())
        own = sorted(found[0] | found[1])
        columns = [pa.array(own, pa.string()), *(pa.array([found[y][t] for t in own], pa.int64()) for y in (1, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "a", "b"])

    counted = sample.select("text", "toxic").mapInArrow(each, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    counted = counted.take(pc.sort_indices(counted.column("term")))
    a, b = (counted.column(c).to_numpy().astype(np.float64) for c in "ab")
    n1, n0 = float(rows.get(1, 0)), float(rows.get(0, 0))
    c, d = n1 - a, n0 - b
    chi2 = (a * d - b * c) ** 2 * (n1 + n0) / (np.maximum(a + b, 1.0) * np.maximum(c + d, 1.0) * max(n1 * n0, 1.0))
    return pa.concat_arrays([pa.array([], pa.string()), *counted.column("term").cast(pa.string()).chunks]), np.where((a + b >= MIN_ROWS) & (chi2 >= MIN_CHI2), 1.0, OTHERS)


def _frequencies(docs: DataFrame, words: Broadcast) -> tuple[int, np.ndarray]:
    """The number of rows, and of rows with each term.

    Every task counts in one array and sends it in slices of `SLICE` terms, which are added up slice by slice: what is
    shuffled is a few bytes a term and task, whatever the number of documents.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, rows = words.value, 0
        total = np.zeros(len(judge.vocabulary), np.int64)
        for batch in batches:
            rows += batch.num_rows
            total += np.bincount(judge.counter.counted(batch.column(0).to_pylist())[1], minlength=len(total))
        parts = [np.array([rows])] + [total[at:at + SLICE] for at in range(0, len(total), SLICE)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype(np.int64).tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[k] = found.get(k, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["slice", "counts"])

    kind = "slice int, counts binary"
    summed = docs.select("text").mapInArrow(count, kind).repartition("slice").mapInArrow(added, kind).orderBy("slice").collect()  # vocabulary / SLICE rows
    parts = [np.frombuffer(r["counts"], np.int64) for r in summed]
    return (int(parts[0][0]) if parts else 0), np.concatenate([np.zeros(0, np.int64), *parts[1:]])


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, examples: int = EXAMPLES, id_column: str = "doc_id", text_column: str = "text",
           label_column: str = "toxic") -> DataFrame:
    """doc_id, score, predicted, evidence. `held_out` is an expression over doc_id; such labels are never learned from."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    known = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).alias("toxic"))
    known = known.where(~F.coalesce(held_out, F.lit(True)) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = frozen(known.join(docs.select("doc_id"), "doc_id", "left_semi"))
    of_label = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashed = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    unlike, order = frozen(_unlike(docs, hashed)), ("h", "doc_id", "text_hash")
    chosen = frozen(unlike.where("toxic = 0").orderBy(*order).limit(examples).unionByName(unlike.where("toxic = 1").orderBy(*order).limit(examples)))
    # at most 2 * examples rows
    sample = docs.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "text_hash"])
    sample = frozen(sample.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text", "toxic", "h"))
    rows = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    vocabulary, weights = _vocabulary(sample, rows)
    # the vocabulary travels once; all three passes count with it
    words = docs.sparkSession.sparkContext.broadcast(Judge(vocabulary))
    del vocabulary
    everything, frequency = _frequencies(docs, words)
    if len(frequency):
        weights = weights * (np.log((1 + everything) / (1 + frequency)) + 1)
    shared, curve = _taught(sample, of_label, words, weights)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, examples = shared.value, pa.array([str(i) for i in shared.value.ids], pa.string())
        judge.slope, judge.offset = curve
        for batch in batches:
            scores, cosines, near = judge.judged(batch.column(1).to_pylist(), words.value.counter)
            told = near[:, :EVIDENCE] >= 0
            own = near[:, :EVIDENCE][told]
            each = pa.StructArray.from_arrays([examples.take(pa.array(own)), pa.array(judge.labels[own], pa.int32()), pa.array(cosines[:, :EVIDENCE][told])], names=["example_id", "toxic", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(told.sum(axis=1)))), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), evidence], names=["doc_id", "score", "predicted", "evidence"])

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, score double, predicted int, evidence array<struct<example_id: string, toxic: int, cosine: double>>")


def _taught(sample: DataFrame, of_label: dict[int, int], words: Broadcast, weights: np.ndarray) -> tuple[Broadcast, tuple[float, float]]:
    """A judge with all examples, and slope and offset of the curve fitted on a fifth of them asked against the others.

    The driver sees the examples' ids, labels and numbers of terms. Their terms and occurrences pass through it as packed
    bytes; weights and index exist in the tasks only, and one index serves the fifth that asks (passed over in the answers)
    and the documents.
    """
    spark = sample.sparkSession
    kind = sample.schema["doc_id"].dataType.simpleString()

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, found, counts = words.value.counter.counted(batch.column(3).to_pylist())
            packed = [_packed(found[a:b], counts[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            blobs = [pa.array([p[c] for p in packed], pa.binary()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *blobs], names=["doc_id", "toxic", "h", "terms", "counts"])

    judge = Judge(weights=weights)
    curve = judge.slope, judge.offset
    # at most 2 * examples rows
    found = sample.select("doc_id", "toxic", "h", "text").mapInArrow(counts_of, f"doc_id {kind}, toxic int, h long, terms binary, counts binary").toArrow()
    if not found.num_rows:
        return spark.sparkContext.broadcast(judge), curve
    ids, toxic = found.column("doc_id").to_pylist(), found.column("toxic").to_numpy()
    hashes = found.column("h").to_pylist()
    sizes = pc.binary_length(found.column("terms")).to_numpy()
    found = found.select(["terms", "counts"])
    rank = sorted(range(len(ids)), key=dict(enumerate(zip(hashes, ids, toxic.tolist()))).get)
    n = np.bincount(toxic, minlength=2)
    judge.label_weights = np.array([of_label.get(y, 0) / max(n[y], 1) for y in (0, 1)]) * len(ids) / sum(of_label.values())
    shares = [sum(judge.label_weights[y] for k in rank if toxic[k] == y and not sizes[k]) for y in (0, 1)]
    judge.base = (of_label.get(1, 0) + 1) / (sum(of_label.values()) + 2)
    judge.without_terms = float((shares[1] + judge.base) / (sum(shares) + 1))
    rank = [k for k in rank if sizes[k]]
    asked = rank[::5] if len(rank) >= 25 else []
    inside = sorted(rank, key=lambda k: (ids[k], k))
    judge.ids, judge.labels = [ids[k] for k in inside], toxic[inside].astype(np.int64)
    questions = found.take(pa.array(asked, pa.int64())).append_column("toxic", pa.array(toxic[asked], pa.int32()))
    judge.counted = found.take(pa.array(inside, pa.int64()))
    del found
    shared = spark.sparkContext.broadcast(judge)
    judge.counted = None
    if asked:
        without = np.isin(inside, asked)

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = shared.value
            for batch in batches:
                told = [_told(t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                starts = np.concatenate(([0], np.cumsum([len(t) for t, _ in told], dtype=np.int64)))
                terms_of, counts = (np.concatenate([np.zeros(0, np.int32), *(x[c] for x in told)]).astype(np.int64) for c in (0, 1))
                cosines, near = judge.index.nearest_of(starts, terms_of, judge.units(starts, terms_of, counts), judge.neighbours, without)
                met = near[:, 0] >= 0
                yield pa.RecordBatch.from_arrays([pa.array(judge.votes(cosines, near, judge.labels)[met]), batch.column(2).filter(pa.array(met))], names=["vote", "toxic"])

        votes = spark.createDataFrame(questions).mapInArrow(answer, "vote double, toxic int").toArrow()
        if votes.num_rows:
            y = votes.column("toxic").to_numpy()
            curve = fitted_curve(votes.column("vote").to_numpy(), y, judge.label_weights[y])
    return shared, curve
