"""Exact token counts at every prefix of a text, by prefix dynamic programming over its words.

The tokenizer drops blanks, so no token crosses one, and the count obeys

    count[0] = 0,    count[i] = count[i - 1] + tokens(word i)

A text is cut at ASCII blanks, each word's tokens are counted once per Python worker, and the running sum is the exact
count at every word boundary. A prefix that ends inside a word adds the count of that part of the word. Truncation and
budget questions are then binary searches in the stored sums; the text is not encoded again.

Words of Latin letters, with ASCII punctuation after them, are one run of letters and one of punctuation for the
tokenizer, so their parts are counted on their own; everything else goes to the tokenizer as a whole word. Special
strings in a text are treated as the tokenizer does by default.

Null and empty texts have no tokens. Rows are independent of each other: repeated rows, ties and extra columns have no
influence, and an empty table gives an empty result. Memory per task: one Arrow batch and the word counts, which start
anew at `MAX_WORDS`.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import bounded_batches, worker_store

MAX_WORDS = 600_000
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
_BLANKS = re.compile(r"[ \t-\r]+")


class WordCounts(dict):
    """word -> number of tokens; missing words are counted in one call per batch."""

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # the same model for runs of lower-case letters or of punctuation, which need no normal form and no pattern
        self.plain = Tokenizer.from_file(tokenizer_file)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.parts: dict[str, int] = {"": 0}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True

    def _count_parts(self, parts: list[str]) -> None:
        """Counts of texts that are one run of letters or punctuation each: the last token of a run carries its end mark."""
        for at in range(0, len(parts), 1000):
            block = parts[at:at + 1000]
            ids = np.array(self.plain.encode(" ".join(block), add_special_tokens=False).ids, dtype=np.int64)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(block):
                self.parts.update(zip(block, np.diff(ends, prepend=-1).tolist()))
            else:
                self.parts.update(zip(block, self.whole(block)))

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        new = set(itertools.filterfalse(self.__contains__, words))
        if len(self) + len(new) > MAX_WORDS:
            self.clear()
            self.parts = {"": 0}
            new = words
        # the special strings of the tokenizer start with "<|", which the pattern does not match
        found = [(word, _SIMPLE.fullmatch(word)) for word in new]
        simple = [(word, m[1].lower(), m[2]) for word, m in found if m]
        other = [word for word, m in found if not m]
        parts = self.parts
        self._count_parts(list(set(itertools.filterfalse(parts.__contains__, (part for _, a, b in simple for part in (a, b))))))
        self.update([(word, parts[a] + parts[b]) for word, a, b in simple])
        self.update(zip(other, self.whole(other)))


def word_counts(tokenizer_file: str) -> WordCounts:
    store = worker_store("token_counts")
    if tokenizer_file not in store:
        store[tokenizer_file] = WordCounts(tokenizer_file)
    return store[tokenizer_file]


def prefix_sums(words: list[str], counts: WordCounts) -> np.ndarray:
    """Tokens of the first 0, 1, 2, ... words."""
    sums = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(counts.__getitem__, words), dtype=np.int64, count=len(words)), out=sums[1:])
    return sums


class PrefixTable:
    """Answers about one text from its stored sums."""

    def __init__(self, text: str, tokenizer_file: str):
        self.counts = word_counts(tokenizer_file)
        self.text, spans = text, [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]
        self.starts, self.ends = ([s[k] for s in spans] for k in (0, 1))
        words = [text[a:b] for a, b in spans]
        self.counts.learn(set(words))
        self.sums = prefix_sums(words, self.counts)

    def tokens_in(self, chars: int) -> int:
        """Exact tokens of the first `chars` code points."""
        whole = int(np.searchsorted(self.ends, chars, side="right"))
        count = int(self.sums[whole])
        if whole < len(self.starts) and self.starts[whole] < chars:
            count += self.counts.whole([self.text[self.starts[whole]:chars]])[0]
        return count

    def words_within(self, budget: int) -> int:
        """The most whole leading words that need no more than `budget` tokens."""
        return int(np.searchsorted(self.sums, budget, side="right")) - 1


def counted(docs: DataFrame, tokenizer_file: str, budget: int, id_column: str = "doc_id", text_column: str = "text",
            store_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `budget` tokens), words_within (whole words inside the budget).

    With `store_prefixes` also prefix_tokens: the count after each word, for later questions about other budgets.
    """
    schema = "doc_id {}, n_bytes long, n_tokens long, over_limit boolean, words_within long".format(docs.schema[id_column].dataType.simpleString())
    bounded_batches(docs.sparkSession)
    schema += ", prefix_tokens array<int>" if store_prefixes else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(tokenizer_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tables, sizes = [], []
            for at in range(0, len(texts), 500):
                split = [_BLANKS.split(t.strip(" \t\n\x0b\x0c\r")) if t else [] for t in texts[at:at + 500]]
                split = [[] if words == [""] else words for words in split]
                counts.learn(set().union(*split))
                for words in split:
                    sums = prefix_sums(words, counts)
                    sizes.append((int(sums[-1]), int(np.searchsorted(sums, budget, side="right")) - 1))
                    if store_prefixes:
                        tables.append(sums[1:].astype(np.int32))
            columns = [
                batch.column(0), batch.column(2), pa.array([n for n, _ in sizes], pa.int64()),
                pa.array([n > budget for n, _ in sizes], pa.bool_()), pa.array([w for _, w in sizes], pa.int64()),
            ] + ([pa.array(tables, pa.list_(pa.int32()))] if store_prefixes else [])
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "words_within"] + (["prefix_tokens"] if store_prefixes else [])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, schema)


def tokens_within(prefix_tokens: Column, budget: int) -> Column:
    """Whole words inside a budget, from stored prefixes."""
    return F.size(F.filter(prefix_tokens, lambda n: n <= budget))
