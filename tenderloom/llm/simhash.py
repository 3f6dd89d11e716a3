"""Near-duplicate documents by SimHash: pigeonhole blocks, a join on blocks, and a check of the Hamming distance.

A fingerprint has 64 bits; a bit is set if it is set in over half of the 64-bit hashes of the document's word shingles.
Documents whose fingerprints differ in at most three bits are linked, and a group is all that is reachable by links.

Equal fingerprints are collapsed first, so a group of copies is one row from there on. The bits are cut into six blocks.
Three differing bits touch at most three blocks, so a close pair agrees on at least three: every fingerprint is dealt
under each of the twenty choices of three blocks (32 bits or so), and only fingerprints under one key are compared. That
keeps chance meetings rare even for billions of documents. Inside a key only the links of a spanning forest are given
out, never all pairs.

A key with more than `BUCKET_ROWS` fingerprints is dealt again: the bits outside its three blocks are cut into six and
dealt under twenty choices of three, which leaves 16 or 17 bits free. So no key holds more than about 2**17
fingerprints, whatever the data; within a key of many fingerprints, neighbours are looked up by flipping the free bits
instead of comparing pairs. The result is exact in every case.

Null and empty texts have the fingerprint zero and are linked like any other; texts of fewer words than a shingle have
one shingle, their whole word sequence. Repeated rows and ties have equal fingerprints and so one group. A null id has
a fingerprint like any other row and the group of that fingerprint, but does not name a group unless all its ids are
null; where one document per group stays, rows without an id cannot be told apart and stay if one of them does. Extra
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import bounded_batches, parted
from tenderloom.llm.components import Forest, components
from tenderloom.session import frozen

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 3
BLOCKS = 6
BUCKET_ROWS = 4096
PAIRWISE_ROWS = 512
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A-Z in lower case, words between ASCII blanks, shingles with repeats, bitwise majority of their XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1:].tolist())
    hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, len(words) - shingle_words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 100_000):
        counts += np.unpackbits(hashes[at:at + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    kind = docs.schema[id_column].dataType.simpleString()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _cuts(bits: list[int], blocks: int = BLOCKS) -> list[list[int]]:
    """The bit numbers in `blocks` runs of nearly equal length."""
    edge = [round(k * len(bits) / blocks) for k in range(blocks + 1)]
    return [bits[a:b] for a, b in itertools.pairwise(edge)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _choices(bits: list[int], distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks of every choice of blocks - distance blocks: a close pair agrees on one of them."""
    return [_mask(sum(chosen, [])) for chosen in itertools.combinations(_cuts(bits, blocks), blocks - distance)]


MASKS = _choices(list(range(64)))


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _dealt(fps: DataFrame) -> DataFrame:
    """fp once under each mask: way (number of the mask), fixed (its bits of the fingerprint)."""
    ways = F.array(*[F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("fixed")) for k, m in enumerate(MASKS)])
    return fps.select("fp", F.explode(ways).alias("w")).select("fp", "w.way", "w.fixed")


def _dealt_again(hot: DataFrame) -> DataFrame:
    """Rows of large keys once more under each choice of blocks of the bits that their key leaves free."""
    def again(mask: int):
        free = [b for b in range(64) if not mask >> b & 1]
        return F.array(*[F.struct(F.lit(k + 1).alias("again"), F.col("fp").bitwiseAND(F.lit(_signed(m | mask))).alias("fixed")) for k, m in enumerate(_choices(free))])

    ways = F.when(F.col("way") == 0, again(MASKS[0]))
    for k, mask in enumerate(MASKS[1:], start=1):
        ways = ways.when(F.col("way") == k, again(mask))
    return hot.select("fp", "way", F.explode(ways).alias("w")).select("fp", (F.col("way") + F.col("w.again") * len(MASKS)).alias("way"), "w.fixed")


def _free_bits(way: int) -> list[int]:
    mask = MASKS[way % len(MASKS)]
    if way >= len(MASKS):
        mask |= _choices([b for b in range(64) if not mask >> b & 1])[way // len(MASKS) - 1]
    return [b for b in range(64) if not mask >> b & 1]


def close_links(fps: np.ndarray, way: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links among the different fingerprints of one key."""
    fps = np.unique(fps)
    forest, found, n = Forest(), [], len(fps)
    if n <= PAIRWISE_ROWS:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance, 1))
        pairs = zip(a.tolist(), b.tolist())
    else:
        flips = (np.uint64(_mask(list(c))) for size in range(1, distance + 1) for c in itertools.combinations(_free_bits(way), size))
        pairs = itertools.chain.from_iterable(_matches(fps, flip) for flip in flips)
    for i, j in pairs:
        if forest.join(i, j):
            found.append((int(fps[i]), int(fps[j])))
            if len(found) == n - 1:
                break
    return found


def _matches(fps: np.ndarray, flip: np.uint64) -> Iterator[tuple[int, int]]:
    """Places of sorted fingerprints that are each other's flip."""
    other = fps ^ flip
    at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
    rows = np.flatnonzero((fps[at] == other) & (at > np.arange(len(fps))))
    return zip(rows.tolist(), at[rows].tolist())


def links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that connect whatever different fingerprints are linked. `fps` has one row per fingerprint."""
    dealt = _dealt(fps)
    large = frozen(dealt.groupBy("way", "fixed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("way", "fixed"))
    if not large.isEmpty():
        key = ["way", "fixed"]
        dealt = dealt.join(large, key, "left_anti").unionByName(_dealt_again(dealt.join(large, key, "left_semi")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows, done = (np.concatenate(held, axis=1) if held else np.zeros((3, 0), np.int64)), True
            else:
                held.append(np.array([batch.column(k).to_numpy().astype(np.int64) for k in range(3)]))
                rows, done = np.concatenate(held, axis=1), False
            ways, fixed, own = rows
            edge = np.flatnonzero((np.diff(ways) != 0) | (np.diff(fixed) != 0)) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(ways)]))
            if not done:  # the last key may go on in the next batch
                held = [rows[:, starts[-1]:]] if rows.shape[1] else []
                starts, ends = starts[:-1], ends[:-1]
            found = []
            for i in np.flatnonzero(ends - starts > 1).tolist():
                found += close_links(own[starts[i]:ends[i]].view(np.uint64), int(ways[starts[i]]))
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    together = dealt.select("way", "fixed", "fp").repartition("way", "fixed").sortWithinPartitions("way", "fixed")
    return together.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    prints = frozen(fingerprints(docs, id_column, text_column))
    different = frozen(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = frozen(components(links(different.select("fp"), bucket_rows)))
    named = different.join(found, different["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    named = frozen(named)
    first = frozen(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    by_print = frozen(named.join(first, "component").select("fp", "component_id"))
    return prints.join(by_print, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                groups_of: Callable[[DataFrame, str, str], DataFrame] = near_groups) -> DataFrame:
    """The documents that stay, with all their columns: of every group the one with the smallest id, repeated rows once.

    `groups_of` gives the doc_id and component_id of every row.
    Only rows with an id that goes, or that several rows have, are joined; the others pass as they are.
    """
    groups = frozen(groups_of(docs, id_column, text_column).select("doc_id", "component_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    by_id = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(stays).alias("stays")).where("rows > 1 OR NOT stays")
    marked = frozen(by_id.select(F.col("doc_id").alias("_marked_id"), "stays"))
    clear, touched = parted(docs, id_column, marked.select("_marked_id"))

    def of(which: str, how: str) -> DataFrame:
        ids = marked.where(which).select("_marked_id")
        return touched.join(ids, touched[id_column].eqNullSafe(ids["_marked_id"]), how)

    passed = clear.unionByName(of("true", "left_anti"))
    if marked.where("stays").isEmpty():
        return passed
    return passed.unionByName(of("stays", "left_semi").dropDuplicates([id_column, text_column]))
