"""Token counts by a two-tier map-side lookup.

A word between ASCII white space is tokenised alone: the vocabulary's pattern never spans white space,
so a text's count is the sum over its words.  Tier one is a broadcast table of the lengths of frequent
words, of a fixed number of entries; tier two is a cache in each Python worker, filled from the library
for the words that tier one lacks.  No word is ever shuffled beyond each task's few frequent ones.

Defined results: null and empty texts have no bytes and no tokens; repeated rows each get a row; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common

#: Entries of the broadcast table, and of each task's list of candidates for it.
FREQUENT, CANDIDATES = 1 << 15, 1 << 13
#: Entries of each of the two generations of a worker's cache.
CACHED = 3 << 18
LIMIT = 2048


class Lengths:
    """Tokens of each word of the batch at hand, in ``now``; ``now`` holds the frequent words always.

    What was learned before moves to ``old`` once ``now`` is full, and comes back when it is met again.
    """

    def __init__(self, name: str, frequent: dict[bytes, int]):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.frequent, self.now, self.old = frequent, dict(frequent), {}
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, words: list[bytes]) -> list[int]:
        got = self.tokenizer.encode_batch_fast([x.decode() for x in words], add_special_tokens=False)
        return [len(e.ids) for e in got]

    @staticmethod
    def core(word: bytes) -> tuple[bytes, int]:
        """The word that the library is asked for, and the tokens beyond it.

        A comma or full stop after an ASCII letter is a token of its own, and letters count alike in
        either case; a word that may hold a special string is left as it is.
        """
        if b"<|" in word:
            return word, 0
        word = word.lower()
        return (word[:-1], 1) if word[-1] in b",." and word[-2:-1].isalpha() else (word, 0)

    def learn(self, words: set[bytes]) -> None:
        if len(self.now) + len(words) > CACHED:
            self.old, self.now = self.now, dict(self.frequent)
        now, old = self.now, self.old
        parts = {w: self.core(w) for w in words if w not in now}
        asked = []
        for core in {c for c, _ in parts.values()}:
            if core not in now:
                if core in old:
                    now[core] = old[core]
                else:
                    asked.append(core)
        for at in range(0, len(asked), 4096):
            now.update(zip(asked[at : at + 4096], self.encode(asked[at : at + 4096]), strict=True))
        for w, (core, more) in parts.items():
            now[w] = now[core] + more


def frequent_words(docs: DataFrame, text: str) -> list[bytes]:
    """Words for tier one.  Every task counts its own words and offers the most frequent; the sums decide.

    This only chooses what is looked up first: counts of tokens do not depend on it.
    """

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in common.text_slices(batches, text):
            for data in common.text_bytes(batch, text):
                counts.update(data.split())
            if len(counts) > 8 * CANDIDATES:  # what is rare so far makes room
                counts = Counter(dict(counts.most_common(4 * CANDIDATES)))
        top = [(w, n) for w, n in counts.most_common(CANDIDATES) if len(w) <= 64]
        yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})

    sums = docs.select(text).mapInArrow(offer, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in sums.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


def count_tokens(docs: DataFrame, name: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of each row's text: ``key``, n_bytes, n_tokens, over_limit.

    ``name``: a vocabulary file whose pattern never spans white space and whose normaliser drops it.
    """
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    lengths = Lengths(name, {})
    lengths.learn(set(frequent_words(rows, "text")))
    table = docs.sparkSession.sparkContext.broadcast(lengths.now)  # FREQUENT words of 64 bytes at most, and their cores
    mark = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.held(mark, lambda: Lengths(name, table.value))
        for batch in common.text_slices(batches, "text", 2 << 20):
            texts = common.text_bytes(batch, "text")
            words = [t.split() for t in texts]
            known.learn(set().union(*words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([sum(map(known.now.__getitem__, w)) for w in words], pa.int64())],
                names=[key, "n_bytes", "n_tokens"],
            )

    kind = rows.schema[key].dataType.simpleString()
    out = rows.mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
