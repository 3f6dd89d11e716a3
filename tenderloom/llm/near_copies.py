"""Near copies by shingle Jaccard: MinHash bands propose, the shingle sets themselves decide.

Words are those of `simhash`: A-Z in lower case, between ASCII blanks. A document is the set of its `SHINGLE_WORDS`-word
shingles; two documents are linked if the Jaccard similarity of their sets is at least `SIMILARITY`, and a group is all
that is reachable by links. Equal sets are collapsed first. Texts of fewer words than a shingle have one shingle, their
whole word sequence; null and empty texts have the empty set and form one group.

Fingerprints compared by Hamming distance cannot do this: at similarity 0.8 about 15 percent of the bits differ, so 64
bits differ in 10 or more and pigeonhole blocks become too short to join on. `BANDS` bands of `BAND_ROWS` minima each
bring a pair of similarity s into a common bucket with probability 1 - (1 - s**BAND_ROWS)**BANDS: all but three in a
million at 0.8, and more above. What shares a bucket is checked exactly, in two steps. First every member is compared
with the smallest of its bucket, which settles nearly all of a large group of copies in linear work. Then the buckets
whose other members are still in several groups are compared pair by pair across groups; a bucket of more than
`BLOCK_ROWS` members is dealt out as pairs of blocks. No bucket is capped or skipped. Shingles and sets are told apart
by 64-bit hashes.

With `fingerprints` (the pipeline's stage) operator 7 proposes as well: every row gets its 64-bit fingerprint in the same
pass, and what its blocks and its three bits link is a candidate like what shares a band. The sets decide on both.

Ids may be null or repeated; a group is named by its smallest id, as in `simhash`. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import bounded_batches, parted
from tenderloom.llm.components import Forest, components
from tenderloom.llm.simhash import _LOWER, SEED, fingerprint
from tenderloom.llm.simhash import links as print_links
from tenderloom.session import frozen

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 32
BAND_ROWS = 5
BLOCK_ROWS = 512
_DRAWN = np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_FLIP, _FACTOR = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingle_set(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The different 64-bit shingle hashes of a text, sorted."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n, line = max(len(words) - shingle_words + 1, 1), b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle_words, len(words)) - 1:]
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n))


def set_number(hashes: np.ndarray) -> int:
    """A signed long for a set, zero for the empty one."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed long for every band, none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_FLIP), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at:at + 512, None] ^ _FLIP) * _FACTOR).min(axis=0), out=least)
    return np.array([xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= similarity


def _sketches(docs: DataFrame, shingle_words: int, fingerprints: bool) -> DataFrame:
    """doc_id, text_hash, set_id, bands of every row, and fp (operator 7's fingerprint) if asked for, else null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets = [shingle_set(t, shingle_words) for t in texts]
            fps = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)) if fingerprints else pa.nulls(len(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([set_number(s) for s in sets], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), fps],
                names=["doc_id", "text_hash", "set_id", "bands", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, set_id long, bands array<long>, fp long")


def _pairs_by_print(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that operator 7 links: of one fingerprint, or of two within three bits."""
    placed = frozen(prints.select("set_id", "fp").distinct())
    first = frozen(placed.groupBy("fp").agg(F.min("set_id").alias("a")))
    same = placed.join(first, "fp").select("a", F.col("set_id").alias("b"))
    close = print_links(first.select("fp")).toDF("fp", "other").join(first, "fp")
    close = close.join(first.select(F.col("fp").alias("other"), F.col("a").alias("b")), "other")
    return same.unionByName(close.select("a", "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """set_id, hashes of the wanted sets. Only texts that a bitmap of the wanted text hashes does not clear are read again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle_words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_number(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "hashes"])

    _, touched = parted(docs.select("text", F.xxhash64("text").alias("text_hash")), "text_hash", wanted.select("text_hash"))
    found = touched.select("text").mapInArrow(run, "set_id long, hashes binary")
    return found.groupBy("set_id").agg(F.any_value("hashes").alias("hashes"))


def _with_first(dealt: DataFrame) -> DataFrame:
    """key, first, other: every bucket's members but the smallest, beside the smallest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, None
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            begins = np.concatenate(([key is None or keys[0] != key], np.diff(keys) != 0))
            run_of = np.cumsum(begins) - 1
            heads = ids[begins]
            firsts = np.where(run_of < 0, first if first is not None else 0, heads[np.maximum(run_of, 0)] if len(heads) else 0)
            rest = ~begins
            yield pa.RecordBatch.from_arrays([pa.array(keys[rest]), pa.array(firsts[rest].astype(np.int64)), pa.array(ids[rest])], names=["key", "first", "other"])
            key, first = keys[-1], firsts[-1]

    together = dealt.select("key", "set_id").repartition("key").sortWithinPartitions("key", "set_id")
    return together.mapInArrow(run, "key long, first long, other long")


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    met = pairs.join(sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("hb")), "b")
    met = met.join(sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("ha")), "a")
    return met.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, sets: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """Links (a, b) among the members of a bucket (key, n, set_id, component) that are in different components."""
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = members.withColumn("blocks", F.ceil(F.col("n") / block_rows)).withColumn("block", block).withColumn("facing", each)
    placed = placed.select("key", F.least("block", "facing").alias("low"), F.greatest("block", "facing").alias("high"), "block", "set_id", "component")

    def links_of(rows: list[tuple]) -> list[tuple[int, int]]:
        forest, found = Forest(), []
        low, high = rows[0][1], rows[0][2]
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        for (i, x), (j, y) in itertools.combinations(enumerate(rows), 2):
            if (low == high or x[3] != y[3]) and forest.root(x[5]) != forest.root(y[5]) and alike(sets[i], sets[j], similarity):
                forest.join(x[5], y[5])
                found.append((x[4], y[4]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for _, bucket in itertools.groupby(rows, key=lambda r: r[:3]):
            found = links_of(list(bucket))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    met = placed.join(sets, "set_id").select("key", "low", "high", "block", "set_id", "component", "hashes")
    return met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "set_id").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = SHINGLE_WORDS,
                similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS, fingerprints: bool = False) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable); with `fingerprints` operator 7 proposes pairs as well."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    prints = frozen(_sketches(texts, shingle_words, fingerprints))
    different = frozen(prints.groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash"), F.any_value("bands").alias("bands")))
    others = frozen(_with_first(different.select("set_id", F.explode("bands").alias("key"))))
    pairs = others.select(F.col("first").alias("a"), F.col("other").alias("b"))
    pairs = frozen((pairs.unionByName(_pairs_by_print(prints)) if fingerprints else pairs).distinct())
    wanted = frozen(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    sets = frozen(_sets(texts, different.join(wanted, "set_id", "left_semi"), shingle_words))
    links = frozen(_checked(pairs, sets, similarity))
    found = frozen(components(links))

    # of buckets with the same members one is enough
    known = others.join(found, others["other"] == found["node"], "left").select("key", "other", F.coalesce("component", "other").alias("component"))
    open_keys = known.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("other").cast("decimal(38,0)")).alias("members"))
    open_keys = frozen(open_keys.where("low < high").groupBy("members", "n").agg(F.min("key").alias("key")).select("key", "n"))
    if not open_keys.isEmpty():
        members = known.join(open_keys, "key").select("key", "n", F.col("other").alias("set_id"), "component")
        more = frozen(_across(members, sets, similarity, block_rows))
        if not more.isEmpty():
            found = frozen(components(links.unionByName(more)))

    named = frozen(different.join(found, different["set_id"] == found["node"], "left").select("set_id", "first_id", F.coalesce("component", "set_id").alias("component")))
    first = frozen(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    by_set = frozen(named.join(first, "component").select("set_id", "component_id"))
    return prints.select("doc_id", "set_id").join(by_set, "set_id", "left").select("doc_id", "component_id")
