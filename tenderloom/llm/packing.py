"""Packing by shortest-pack-first over the length histogram.

A document is its token ids and an end id. It is cut into pieces of the sequence length and a rest; only the rests need
packing. The histogram of piece lengths has at most `capacity` entries, whatever the number of documents. Lengths are
placed longest first; all pieces of a length go to the packs with the most room that can take them, by whole groups of
equal packs ("patterns" with counts), and what fits nowhere opens new packs. Each step splits at most one group, so there
are at most two patterns per length and the plan is bounded by the capacity. The pattern slots are then joined back to
the pieces: pieces of one length are ranked, and rank ranges belong to slots.

Ranks are taken in two steps, within hash buckets of a length and then over the bucket sizes, so that a length that a
third of all pieces have is not gathered in one task.

Null and empty texts consist of the end id alone. Repeated rows are packed once each, ties between pieces of one length
are broken by their place in the stored pieces, an empty table gives no pieces, and extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderloom.llm.common import bounded_batches, worker_store
from tenderloom.session import frozen

CAPACITY = 2048
END_ID = 1
RANK_ROWS = 2_000
MAX_CHUNKS, MAX_JOINED = 300_000, 200_000
# A blank in the widest sense; a cut before a space is safe only after something that is certainly no blank.
_DOUBTFUL = re.compile(r"\s ")
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[,.;:!?|#$%&*]"
_WORD = re.compile(f" ?{_LETTERS}")
_PLAIN = re.compile(f" ?{_LETTERS}{_MARKS}*(?:\n{_LETTERS}{_MARKS}*)*")
_PARTS = re.compile(f" ?{_LETTERS}|{_MARKS}+|\n")


class ChunkIds(dict):
    """Text between two spaces -> its token ids as little-endian unsigned 32-bit numbers.

    The tokenizer never joins a space to what stands before it, so a text may be cut before every space that follows
    something other than a blank, and the ids of the parts, one after the other, are the ids of the text. Parts of plain
    words, punctuation and line breaks are looked up piece by piece. New plain words go through tiktoken's byte-pair
    merge over the same vocabulary, which takes a third of the time; the first words of every worker are compared with
    the tokenizer, and if one differs, the tokenizer does them all. Parts of several pieces are
    seldom met again and stand apart, so that they do not displace the pieces. `MAX_CHUNKS` and `MAX_JOINED` bound both,
    but for what one call brings.
    """

    def __init__(self, tokenizer_file: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        shown = _shown_bytes()
        ranks = {bytes(shown[c] for c in token): n for token, n in vocabulary.items() if all(c in shown for c in token)}
        self.merges = tiktoken.Encoding("words", pat_str=r"\n| ?\p{L}+", mergeable_ranks=ranks, special_tokens={})
        self.line, self.checked = ranks[b"\n"], False
        self.joined: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        return self.joined[chunk]

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _learn_words(self, words: list[str]) -> None:
        if not words:
            return
        if not self.checked:
            first = words[:300]
            if self._merged(first) != self.whole(first):
                self.merges = None
            self.checked = True
        if self.merges is None:
            self.update(zip(words, self.whole(words)))
        for at in range(0, len(words) if self.merges else 0, 2000):
            block = words[at:at + 2000]
            self.update(zip(block, self._merged(block)))

    def _merged(self, words: list[str]) -> list[bytes]:
        """One to a line: a line break is a token of its own between words."""
        ids = np.array(self.merges.encode_ordinary("\n".join(words)), dtype="<u4")
        ends = [*(4 * np.flatnonzero(ids == self.line)).tolist(), 4 * len(ids)]
        ids, start, found = ids.tobytes(), 0, []
        for end in ends:
            found.append(ids[start:end])
            start = end + 4
        return found

    def learn(self, texts: list[list[str]]) -> None:
        """All chunks of the texts that are not known yet."""
        if len(self) > MAX_CHUNKS:
            self.clear()
        if len(self.joined) > MAX_JOINED:
            self.joined = {}
        new = set(itertools.filterfalse(self.__contains__, itertools.chain.from_iterable(texts)))
        new = set(itertools.filterfalse(self.joined.__contains__, new))
        words = {chunk for chunk in new if _WORD.fullmatch(chunk)}
        new -= words
        plain = [(chunk, _PARTS.findall(chunk)) for chunk in new if _PLAIN.fullmatch(chunk)]
        parts = set(itertools.filterfalse(self.__contains__, itertools.chain.from_iterable(found for _, found in plain)))
        marks = {part for part in parts if not part[-1].isalpha()}
        self._learn_words([*words, *(parts - marks - words)])
        other = [*marks, *new.difference([chunk for chunk, _ in plain])]
        self.update(zip(other, self.whole(other)))
        known = self.__getitem__
        self.joined.update([(chunk, b"".join(map(known, found))) for chunk, found in plain])

    def release(self) -> None:
        """Forgets what was learned. The worker may serve other stages for as long as it lives, and they need the memory."""
        self.clear()
        self.joined = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            if " " not in text or text[0] == " " or _DOUBTFUL.search(text):
                cut.append(None)
            else:
                cut.append(text.replace(" ", "\0 ").split("\0") if "\0" not in text else None)
        self.learn([c for c in cut if c])
        whole = iter(self.whole([t for t, c in zip(texts, cut) if c is None]))
        return [next(whole) if c is None else b"".join(map(self.__getitem__, c)) for c in cut]


def _shown_bytes() -> dict[str, int]:
    """The characters that byte-level vocabularies show bytes as: printable ones as themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def chunk_ids(tokenizer_file: str) -> ChunkIds:
    store = worker_store("packing_ids")
    if tokenizer_file not in store:
        store[tokenizer_file] = ChunkIds(tokenizer_file)
    return store[tokenizer_file]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document cut into pieces of at most `capacity` ids."""
    kind = docs.schema[id_column].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunk_ids(tokenizer_file)
        try:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                rows, out = [], []
                for at in range(0, len(texts), 500):
                    for i, ids in enumerate(known.ids([t or "" for t in texts[at:at + 500]]), start=at):
                        ids += end
                        total = len(ids) // 4
                        for start in range(0, total, capacity):
                            part = ids[4 * start:4 * (start + capacity)]
                            rows.append(i)
                            out.append((start, len(part) // 4, zlib.crc32(part), total))
                columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            known.release()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (number of packs, ((length, pieces of that length in a pack), ...)), the lengths in falling order.

    Packs wait in a heap by their fill, the shortest first; equal packs are one group and are filled together.
    """
    heap: list = []
    made = 0

    def stand(fill: int, packs: int, parts: tuple) -> None:
        nonlocal made
        made += 1
        heapq.heappush(heap, (fill, made, packs, parts))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and heap[0][0] + length <= capacity:
            fill, _, packs, parts = heapq.heappop(heap)
            used, rounds = min(packs, left), 1
            if used == packs:
                # as many rounds at once as the group stays among the shortest
                level = min(heap[0][0], capacity) if heap else capacity
                rounds = max(1, min(left // packs, (level - fill) // length))
            else:
                stand(fill, packs - used, parts)
            if parts[-1][0] == length:
                parts, rounds_before = parts[:-1], parts[-1][1]
            else:
                rounds_before = 0
            stand(fill + rounds * length, used, (*parts, (length, rounds_before + rounds)))
            left -= used * rounds
        # nothing has room: new packs, each filled before the next one is opened, as it is then the only one with room
        times = capacity // length
        for packs, pieces_each in ((left // times, times), (1, left % times)):
            if packs and pieces_each:
                stand(pieces_each * length, packs, ((length, pieces_each),))
    found: dict = {}
    for _, _, packs, parts in heap:
        found[parts] = found.get(parts, 0) + packs
    return [(packs, parts) for parts, packs in sorted(found.items())]


def slots(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank of each slot, first sequence of its pattern, offset in the sequence)."""
    found: dict[int, list] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for packs, parts in patterns:
        offset = 0
        for length, times in parts:
            for _ in range(times):
                rank = next_rank.get(length, 0)
                found.setdefault(length, []).append((rank, sequence, offset))
                next_rank[length] = rank + packs
                offset += length
        sequence += packs
    return {length: tuple(np.array(x, dtype=np.int64).T) for length, x in found.items()}


def packed(cut: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """The pieces with sequence_id and offset. `cut` has the columns of `pieces`."""
    cut = frozen(cut.withColumn("place", F.monotonically_increasing_id()))
    buckets = max(1, -(-cut.count() // rank_rows))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    sizes = frozen(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = cut.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("place")) - 1
    ranked = cut.withColumn("local", local).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("local"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first, base, at = plan.value[int(length)]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = base[k] + ranks[rows] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select(*kept, F.col("rank").cast("long")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return packed(pieces(docs, tokenizer_file, capacity, id_column, text_column), capacity)
