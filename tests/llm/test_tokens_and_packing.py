import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tenderloom.llm import packing, token_counts
from tenderloom.llm.queries import tokenizer_file
from tests.conftest import FOLDER
from tests.llm.helpers import AWKWARD, documents

WORDS, BYTES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
ODD = AWKWARD + ["I'LL'S don't 're", "a<|endoftext|>b  <|startoftext|>", "Σας ΑΣ aж", "x́.y", "9a9,, ...a", "a  b", "a \n b", "\n a", "<|endoftext|> a", " a b",
                 "a b ", "a\x1c b", "a,\nb c.\nd", "a?!\nb it.|\n|b", "x" * 5000]


def tokenizer(file):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


def texts(spark):
    return ODD + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def test_counts_are_those_of_the_tokenizer(spark):
    known, library = texts(spark), tokenizer(WORDS)
    got = token_counts.counted(documents(spark, list(enumerate(known))), WORDS, 500, store_prefixes=True).collect()
    assert len(got) == len(known)
    for r in got:
        text = known[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 500)
        assert (r["prefix_tokens"] or [0])[-1] == n
        assert r["words_within"] == sum(c <= 500 for c in r["prefix_tokens"])


def test_every_prefix_is_exact(spark):
    library = tokenizer(WORDS)
    for text in [t for t in ODD if t and len(t) < 100] + [t[:150] for t in texts(spark)[-5:]]:
        table = token_counts.PrefixTable(text, WORDS)
        for chars in range(len(text) + 1):
            assert table.tokens_in(chars) == len(library.encode(text[:chars], add_special_tokens=False).ids), (text, chars)


def test_pieces_cover_the_ids_of_the_tokenizer(spark):
    known, library = texts(spark), tokenizer(BYTES)
    rows = [*enumerate(known), (0, "a repeated id"), (None, "no id")]
    cut = packing.pieces(documents(spark, rows), BYTES, 256)
    found = defaultdict(list)
    for r in cut.collect():
        found[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        expected = [(a, len(ids[a:a + 256]), zlib.crc32(ids[a:a + 256].tobytes())) for a in range(0, len(ids), 256)]
        assert sorted(found[doc_id, len(ids)]) == expected


@pytest.mark.parametrize("rank_rows", [10, 100_000])
def test_sequences_are_full_and_without_gaps(spark, rank_rows):
    docs = documents(spark, [*enumerate(texts(spark)), *[(1000 + i, "the same short text") for i in range(60)], (5, "twice"), (5, "twice")])
    cut = packing.pieces(docs, BYTES, 256)
    got = packing.packed(cut, 256, rank_rows).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, (tuple(r) for r in cut.collect())))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r["length"] for r in got) > 0.97 * 256 * len(sequences)


def test_plan_places_every_piece_once():
    rng = random.Random(5)
    for histogram in ({}, {1: 10**9, 2: 5}, {64: 3}, {33: 10, 32: 3}, {n: rng.randrange(1, 10**6) for n in range(1, 65)}, {n: rng.randrange(1, 4) for n in range(1, 65, 3)}):
        plan, placed = packing.shortest_pack_first(dict(histogram), 64), Counter()
        for packs, parts in plan:
            assert packs > 0 and sum(n * k for n, k in parts) <= 64
            for length, times in parts:
                placed[length] += packs * times
        assert placed == Counter(histogram)
        assert len(plan) <= 3 * 64


def test_empty_table(spark):
    docs = documents(spark, [(1, "x")]).where("false")
    assert token_counts.counted(docs, WORDS, 5).count() == 0
    assert packing.pack(docs, BYTES).count() == 0


def test_worker_forgets_its_chunks_after_a_task(spark):
    from tenderloom.llm.common import worker_store

    docs = documents(spark, list(enumerate(texts(spark)))).coalesce(1)
    packing.pieces(docs, BYTES).collect()

    def kept(batches):
        for batch in batches:
            sizes = [len(known) + len(getattr(known, "joined", ())) for known in worker_store("packing_ids").values()]
            yield batch.from_arrays([[sum(sizes)]], names=["n"])

    # the worker of the task before serves this one as well
    assert [r["n"] for r in spark.range(1).coalesce(1).mapInArrow(kept, "n long").collect()] == [0]


def test_few_chunks_are_kept(monkeypatch):
    monkeypatch.setattr(packing, "MAX_CHUNKS", 20)
    monkeypatch.setattr(packing, "MAX_JOINED", 10, raising=False)
    known, library = packing.ChunkIds(BYTES), tokenizer(BYTES)
    for n in range(40):
        # lines in the middle of a part: such parts do not take the room of words
        lines = " ".join(f"alpha\nbeta{chr(97 + n % 26)}\ngamma{chr(97 + n // 26)}x{'y' * k}" for k in range(5))
        for text in (lines, "some words come again, and again", *filter(None, ODD)):
            ids = np.frombuffer(known.ids([text])[0], "<u4").tolist()
            assert ids == library.encode(text, add_special_tokens=False).ids
        assert len(known) <= 20 + 60
