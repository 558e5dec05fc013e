"""Phrases of two or three words, mined from a weighted de Bruijn graph.

Nodes are pairs of neighbouring words, edges the three-word grams that join two overlapping pairs; a pair that ends its
piece has an edge to nowhere.  Only edges are counted over the corpus.  A pair's frequency is the flow out of its node, a
word's that of the nodes that begin with it, and what ends a piece is added as the edge to nowhere.

Edges of a task are summed before they move, and travel packed: a row for each bucket of nodes, with sorted texts that
compress well.  Partitions hold buckets in order and handle one after another, so a task's memory is that of one bucket;
buckets grow in number with the corpus, partitions up to MOST_PARTITIONS.  A node's edges share a bucket: a hot node has
one row for each task and following word, not for each occurrence.

Of the graph only what occurs ``least`` times or more stays; the frequency of a part is never smaller than the whole's, so
nothing that a candidate needs is lost.  Then unary paths are compacted by pointer doubling: a node with one way in and one
way out, both with all of its flow, lies inside a path whose grams all have one count.  Inside paths no part needs a
lookup, and a pair there is never a result of its own, as the gram around it has the same count.

Defined results: null and empty texts hold no words; a null language is ``und``; repeated rows count each; other columns are
ignored; no rows give none.  Counts are exact; scores are whole numbers by decimal arithmetic of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import common

#: Least occurrences, per cent of a phrase's occurrences that a longer one must hold to displace it, and phrases for each language.
LEAST, HELD, TOP = 10, 50, 2000
#: Text of a bucket, and the most partitions that buckets are dealt to.
BUCKET_BYTES, MOST_PARTITIONS = 8 << 20, 8192
#: Bytes of text cut at once, and grams that a task sums before it sends them.
BLOCK_BYTES, HELD_GRAMS = 4 << 20, 3_000_000
#: Words of up to so many rows are broadcast to the candidates (a word and a count each).
BROADCAST_WORDS = 500_000

_END = b"\xff"  # in no UTF-8 text
_TO = bytes(_END[0] if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD_BITS = 21


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """Words and piece ends of a text, in blocks that share two words with the one before."""
    data = data.translate(_TO)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + BLOCK_BYTES)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].replace(_END, b" \xff ").split()
        at = stop


class Grams:
    """Three-word grams of one language within a task, summed by numbers that words get here."""

    def __init__(self):
        self.words: dict[bytes, int] = {_END: 0}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, texts: list[bytes]) -> None:
        """All grams of texts, none across a piece's end."""
        last: list[bytes] = []
        for block in words_of(b"\n".join(texts) + b"\n\n\n"):
            block = last + block
            number = self.words
            ids = np.array([number.setdefault(w, len(number)) for w in block], np.int64)
            last = block[-2:]
            if len(ids) < 3:
                last = block
                continue
            a, b, c = ids[:-2], ids[1:-1], ids[2:]
            c = np.where(b == 0, 0, c)
            keys = ((a << (2 * _WORD_BITS)) | (b << _WORD_BITS) | c)[a != 0]
            keys, counts = self._sum(keys, np.ones(len(keys), np.int64))
            self.keys.append(keys)
            self.counts.append(counts)
            self.held += len(keys)
        if self.held > 2 * HELD_GRAMS and len(self.keys) > 1:
            self.keys, self.counts = ([x] for x in self._sum(np.concatenate(self.keys), np.concatenate(self.counts)))
            self.held = len(self.keys[0])

    @staticmethod
    def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts

    @property
    def full(self) -> bool:
        return self.held > HELD_GRAMS or len(self.words) > 1 << (_WORD_BITS - 2)

    def packed(self, buckets: int) -> Iterator[tuple[int, bool, bytes, bytes]]:
        """(bucket, whether grams, texts, counts): grams by their node's bucket, and the words' sums of flow by their own."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        if not self.keys:
            return
        keys, counts = self._sum(np.concatenate(self.keys), np.concatenate(self.counts))
        names = pa.array(list(self.words), pa.binary())
        order = np.argsort(np.array(pc.rank(names, sort_keys="ascending", tiebreaker="first")))  # texts in order
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        mask = (1 << _WORD_BITS) - 1
        a, b, c = keys >> (2 * _WORD_BITS), keys >> _WORD_BITS & mask, keys & mask
        hashes = self._hashes()
        flow = np.bincount(a, counts, len(names)).astype(np.int64)  # below 2^53
        single = np.flatnonzero(flow)
        single = single[np.argsort(place[single])]
        yield from self._rows(False, (hashes[single] % buckets).astype(np.int64), names.take(pa.array(single)), flow[single], squeeze)
        gram = b != 0
        a, b, c, counts = a[gram], b[gram], c[gram], counts[gram]
        by = np.lexsort((place[c], place[b], place[a]))
        a, b, c, counts = a[by], b[by], c[by], counts[by]
        bucket = ((hashes[a] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[b] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(11)) % np.uint64(buckets)
        ends = pa.array(np.where(c == 0, 0, c))
        tails = pc.if_else(pa.array(c == 0), pa.scalar(b"", pa.binary()), names.take(ends))
        text = pc.binary_join_element_wise(names.take(pa.array(a)), names.take(pa.array(b)), tails, pa.scalar(b" ", pa.binary()))
        yield from self._rows(True, bucket.astype(np.int64), text, counts, squeeze)

    def _hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))

    @staticmethod
    def _rows(grams: bool, bucket: np.ndarray, texts: pa.Array, counts: np.ndarray, squeeze) -> Iterator[tuple[int, bool, bytes, bytes]]:
        order = np.argsort(bucket, kind="stable")
        texts, counts, bucket = texts.take(pa.array(order)), counts[order], bucket[order]
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)) if len(bucket) else []
        start = 0
        for end in np.asarray(ends, np.int64).tolist():
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), texts.slice(start, end - start)), pa.scalar(b"\n", pa.binary()))[0]
            yield int(bucket[start]), grams, squeeze(joined.as_py()), squeeze(counts[start:end].astype("<u8").tobytes())
            start = end


_PACKED = "bucket int, lang string, grams boolean, texts binary, counts binary"
_COUNTED = "lang string, size int, first string, last string, n long"


def _unpack(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sum the packed rows of one bucket after another; what occurs ``least`` times, and each bucket's words in all (size 0)."""
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    now, parts = None, {}

    def rows(lang: str, size: int, first: pa.Array, last: pa.Array | None, n: pa.Array) -> pa.RecordBatch:
        k = len(n)
        text = lambda x: pa.nulls(k, pa.string()) if x is None else x.cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([size] * k, pa.int32()), text(first), text(last), n], names=["lang", "size", "first", "last", "n"])

    def summed(columns: dict[str, pa.Array], by: list[str]) -> pa.Table:
        return pa.table(columns).group_by(by, use_threads=False).aggregate([("n", "sum")])

    def finish() -> Iterator[pa.RecordBatch]:
        for (lang, grams), found in parts.items():
            texts = pa.concat_arrays([pc.list_flatten(pc.split_pattern(pa.array([t], pa.large_binary()), b"\n")) for t, _ in found])
            n = pa.array(np.concatenate([np.frombuffer(c, "<u8").astype(np.int64) for _, c in found]))
            table = summed({"t": texts, "n": n}, ["t"])
            texts, n = table["t"].combine_chunks(), table["n_sum"].combine_chunks()
            often = pc.greater_equal(n, least)
            if not grams:
                yield rows(lang, 0, pa.array([b""]), None, pa.array([pc.sum(n).as_py()], pa.int64()))
                yield rows(lang, 1, texts.filter(often), None, n.filter(often))
                continue
            words = pc.split_pattern(texts, b" ").flatten()  # three for each, the last may be empty
            a, b, c = (words.take(pa.array(np.arange(k, len(words), 3))) for k in range(3))
            node = pc.binary_join_element_wise(a, b, pa.scalar(b" ", words.type))
            nodes = summed({"t": node, "n": n}, ["t"])
            nodes = nodes.filter(pc.greater_equal(nodes["n_sum"], least))
            yield rows(lang, 2, nodes["t"].combine_chunks(), None, nodes["n_sum"].combine_chunks())
            edges = pc.and_(often, pc.greater(pc.binary_length(c), 0))
            yield rows(lang, 3, node.filter(edges), c.filter(edges), n.filter(edges))

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                yield from finish()
                now, parts = row["bucket"], {}
            parts.setdefault((row["lang"], row["grams"]), []).append((unzip(row["texts"]), unzip(row["counts"])))
    yield from finish()


def count_graph(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, size, first, last, n, written: words in all (size 0, by buckets), frequent words (1), nodes (2) and edges (3: node and word)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min((1 << 31) - 1, -(-int(total) // bucket_bytes)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Grams] = {}

        def send(name: str) -> Iterator[pa.RecordBatch]:
            part = []
            for b, g, t, c in held.pop(name).packed(buckets):
                part.append((b, name, g, t, c))
                if len(part) == 64:
                    yield _batch(part)
                    part = []
            if part:
                yield _batch(part)

        for batch in common.text_slices(batches, "text", BLOCK_BYTES):
            by: dict[str, list[bytes]] = {}
            for name, data in zip(batch.column(0).to_pylist(), common.text_bytes(batch, "text"), strict=True):
                by.setdefault(name, []).append(data)
            for name, texts in by.items():
                held.setdefault(name, Grams()).add(texts)
            while held and (sum(g.held for g in held.values()) > HELD_GRAMS or any(g.full for g in held.values())):
                yield from send(max(held, key=lambda x: (held[x].full, held[x].held)))
        for name in list(held):
            yield from send(name)

    packed = rows.mapInArrow(pack, _PACKED).repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    return common.materialize(packed.mapInArrow(lambda batches: _unpack(batches, least), _COUNTED), "graph")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])


def _word(node: Column, k: int) -> Column:
    return F.element_at(F.split(node, " "), k)


def compact(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, nodes) of a table of :func:`count_graph`, both written.

    paths: lang, words, n: each unary path's words, of which every three are an edge of count ``n``.
    nodes: lang, node, n, most (the count of the heaviest edge at the node), inner (whether a path runs through it).
    """
    edges = graph.where("size = 3").select("lang", F.col("first").alias("tail"), F.col("last").alias("word"), "n")
    edges = edges.withColumn("head", F.concat_ws(" ", _word(F.col("tail"), 2), "word"))
    out = edges.groupBy("lang", F.col("tail").alias("node")).agg(F.max("n").alias("most_out"))
    into = edges.groupBy("lang", F.col("head").alias("node")).agg(F.max("n").alias("most_in"), F.max_by("tail", "n").alias("before"))
    nodes = graph.where("size = 2").select("lang", F.col("first").alias("node"), "n").join(out, ["lang", "node"], "left").join(into, ["lang", "node"], "left")
    inner = (F.col("most_in") == F.col("n")) & (F.col("most_out") == F.col("n"))
    nodes = nodes.select("lang", "node", "n", F.greatest(F.coalesce("most_in", F.lit(0)), F.coalesce("most_out", F.lit(0))).alias("most"), F.coalesce(inner, F.lit(False)).alias("inner"), "before")
    nodes = common.materialize(nodes, "nodes")
    jumps = common.materialize(nodes.where("inner").select("lang", "node", F.col("before").alias("at"), _word(F.col("node"), 2).alias("start"), F.lit(1).cast("long").alias("steps")), "jumps")
    while True:
        b = jumps.select("lang", F.col("node").alias("at"), F.col("at").alias("_at"), F.col("start").alias("_start"), F.col("steps").alias("_steps"))
        met = jumps.join(b, ["lang", "at"], "left")
        found = common.materialize(met.select("lang", "node", F.coalesce("_at", "at").alias("at"), F.coalesce("_start", "start").alias("start"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_at").isNotNull().alias("_more")), "jumps")
        common.discard(jumps)
        jumps = found
        if not found.where("_more").limit(1).count():
            break
    on = jumps.select("lang", F.col("node").alias("tail"), "at", "start", "steps")
    placed = edges.join(on, ["lang", "tail"], "left").select("lang", F.coalesce("at", "tail").alias("at"), F.coalesce("start", "word").alias("start"), F.coalesce("steps", F.lit(0)).alias("step"), "word", "n")
    # A path lies inside one piece of one text, so its words are no more than what a task held before.
    paths = placed.groupBy("lang", "at", "start").agg(F.sort_array(F.collect_list(F.struct("step", "word"))).alias("w"), F.first("n").alias("n"))
    paths = common.materialize(paths.select("lang", F.concat(F.split("at", " "), F.col("w.word")).alias("words"), "n"), "paths")
    common.discard(jumps)
    return paths, nodes


def _score(a: str, left: Column, right: Column) -> Column:
    whole = lambda c: c.cast("decimal(15,0)")
    product = (whole(left) * whole(right)).cast("decimal(30,0)")
    square = (F.lit(1_000_000).cast("decimal(7,0)") * (whole(F.col(a)) * whole(F.col(a))).cast("decimal(30,0)")).cast("decimal(38,0)")
    return F.call_function("div", square, product).cast("long")


def _with_words(rows: DataFrame, words: DataFrame, few: bool, word: str, to: str) -> DataFrame:
    table = words.select("lang", F.col("word").alias(word), F.col("n").alias(to))
    return rows.join(F.broadcast(table) if few else table, ["lang", word])


def scored(graph: DataFrame, paths: DataFrame, nodes: DataFrame, held: int = HELD) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate that no longer one displaces."""
    words = graph.where("size = 1").select("lang", F.col("first").alias("word"), "n")
    few = words.count() <= BROADCAST_WORDS
    flow = nodes.select("lang", "node", "n")
    grams = paths.select("lang", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("i"))
    w = lambda k: F.element_at("words", F.col("i") + k)
    grams = grams.select("lang", F.col("n").alias("a"), w(0).alias("w1"), w(1).alias("w2"), w(2).alias("w3"), (F.col("i") > 1).alias("in1"), (F.col("i") < F.size("words") - 2).alias("in2"))
    grams = _with_words(_with_words(grams, words, few, "w1", "f1"), words, few, "w3", "f3")
    # Only the ends of paths ask for their node's flow; inside it is the path's.  A null key meets nothing and shuffles apart.
    for k, inside in (("1", "in1"), ("2", "in2")):
        pair = F.concat_ws(" ", "w1", "w2") if k == "1" else F.concat_ws(" ", "w2", "w3")
        ends = grams.where(~F.col(inside)).withColumn("node", pair).join(flow.withColumnRenamed("n", f"p{k}"), ["lang", "node"]).drop("node")
        grams = ends.unionByName(grams.where(inside).withColumn(f"p{k}", F.col("a")))
    one, two = _score("a", F.col("f1"), F.col("p2")), _score("a", F.col("p1"), F.col("f3"))
    cut = F.when(one <= two, F.struct(F.col("f1").alias("l"), F.col("p2").alias("r"), one.alias("score"))).otherwise(F.struct(F.col("p1").alias("l"), F.col("f3").alias("r"), two.alias("score")))
    three = grams.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut.alias("c")).select("lang", "phrase", "a", "c.*")
    pairs = nodes.where(~F.col("inner") & (100 * F.col("most") < held * F.col("n"))).select("lang", F.col("node").alias("phrase"), F.col("n").alias("a"), _word(F.col("node"), 1).alias("w1"), _word(F.col("node"), 2).alias("w2"))
    pairs = _with_words(_with_words(pairs, words, few, "w1", "l"), words, few, "w2", "r")
    return pairs.select("lang", "phrase", "a", "l", "r", _score("a", F.col("l"), F.col("r")).alias("score")).unionByName(three)


def mine(docs: DataFrame, least: int = LEAST, held: int = HELD, top: int = TOP, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    graph = count_graph(docs, least, bucket_bytes=bucket_bytes)
    paths, nodes = compact(graph)
    found = scored(graph, paths, nodes, held)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each of 64 parts first, so that one language's candidates never meet in one task.
    found = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    found = found.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = graph.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of every whole text of ``documents``."""
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, unnest([1, 2, 3]) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS cnt FROM g GROUP BY ALL),
n AS (SELECT lang, sum(cnt)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, cnt AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND cnt >= 10),
held AS (SELECT lang, array_to_string(w[j:j + 1], ' ') AS phrase, max(a) AS most FROM cand, unnest([1, 2]) AS t(j) WHERE k = 3 GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.a, j, l.cnt AS l, r.cnt AS r, (1000000::HUGEINT * c.a * c.a) // (l.cnt * r.cnt) AS score
  FROM cand c LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase AND c.k = 2, unnest(range(1, c.k)) AS t(j)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')
  WHERE h.most IS NULL OR 100 * h.most < 50 * c.a),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
