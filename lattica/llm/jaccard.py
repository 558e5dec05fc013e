"""Exact Jaccard join of documents on word shingles, with PartEnum signatures.

Two sets link when 100 * |both| >= percent * |either|.  Sets fall into size bands such that linked sets are in
the same or the next band.  For each band a hash deals all features to first-level partitions, and each of those
to three second-level ones; there are so many first-level partitions that linked sets differ by one feature at
most in one of them, so they agree on two of its three parts.  A signature is the hash of a set's features in
two parts: linked sets share one for certain.  As there are some spare partitions, linked sets agree in so many more: a
set that has no feature in some two parts, in no more partitions than that, leaves such signatures out, on which unlike
sets would meet.

1.  Every slice of documents makes its sets, and signatures of each distinct set, and sends these in a packed row for each
    bucket of signatures.  A bucket names for every signature the smallest document as leader: pairs (leader, document),
    never pairs of all.  As similar documents share signatures in many buckets, the same pair comes from many: pairs
    travel packed to a bucket of their leader, and become rows once.  A document is in no more pairs than it has signatures.
2.  Pairs that may link by their parity sketches are verified on their whole sets, and components are taken over
    the links.  The sketches of two sets differ in no more bits than the sets in features, so a pair is left out
    only if it can't link.
3.  What a leader can't settle is settled in blocks: documents around one leader that links do not join are compared by
    their sketches, in bands of size.  Pairs that may link travel packed in tiles, to which their documents come as rows, and
    are verified there; a tile gives fewer links than it has documents.

Documents with equal sets are joined first and stand for one in steps 2 and 3; an id with several sets stays itself.

Defined results: a set is empty without words or text, and links with nothing; with fewer words than a shingle
the whole sequence is the one shingle; rows that repeat a document id are one vertex and keep a row each; rows
with a null id link with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common

WORDS, PERCENT = 4, 85
#: Documents of one signature that a slice of :mod:`lines` sends by themselves; beyond, its smallest stands for them.
TOGETHER = 3
#: Buckets of signatures for each bucket of pairs.
PAIRS_FROM = 16
#: Bytes of text for each bucket of signatures; of sketches in a block of step 3; of differences of one numpy step there;
#: pairs of a hub in one task; ids that a filter may broadcast (beyond, it shuffles); of sets on a side of a tile of step 3.
BUCKET_BYTES, BLOCK_BYTES, STEP_BYTES, HUB_PAIRS, BROADCAST_IDS, TILE_BYTES = 8 << 20, 1 << 18, 8 << 20, 1024, 1 << 20, 4 << 20
#: Documents of a cluster of step 3 that are compared in one place, if their sketches fit a block.
SMALL = 64
#: Second-level partitions; first-level ones beyond those that linked sets need to agree on one, and one more for 64 allowed
#: differences: few sets have empty parts in more.
PARTS, SPARE = 3, 3
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser: every bit of the result hangs on every bit of ``x``."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    every = np.fromiter((h for w in split for h in map(xxhash.xxh64_intdigest, w)), U, int(counts.sum()))
    rolled = every[: max(0, len(every) - words + 1)]
    for k in range(1, words):
        rolled = mix(rolled) + every[k : len(every) - words + 1 + k]
    rolled = mix(rolled + U(words))
    out, at = [], 0
    for w, n in zip(split, counts.tolist(), strict=True):
        if n >= words:
            out.append(common.distinct(rolled[at : at + n - words + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(w), n)] if n else [], U))
        at += n
    return out


def allowed(total: int, percent: int) -> int:
    """Features in which linked sets of ``total`` features together differ at most."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(None)
def bands(percent: int) -> list[int]:
    """First sizes of the bands, up to a size beyond any text."""
    firsts = [1]
    while firsts[-1] < 1 << 40:
        firsts.append(firsts[-1] * 100 // percent + 1)
    return firsts


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set: for its own band, and for the next, where its larger partners may be."""
    n = len(features)
    firsts = bands(percent)
    band = int(np.searchsorted(firsts, n, side="right")) - 1
    spread = mix(features + U(0x9E3779B97F4A7C15))
    value = mix(spread ^ U(0xD1B54A32D192ED03))
    out = []
    for tag in (band, band + 1):
        k = allowed(2 * (firsts[tag + 1] - 1), percent)
        if not k or allowed(n + firsts[tag + 1] - 1, percent) == 0:
            continue  # equal sets alone could link
        spare = SPARE + k // 64
        first = k // 2 + 1 + spare
        cell = (spread >> U(32)) % U(first) * U(PARTS) + (spread & U(0xFFFFFFFF)) % U(PARTS)
        sums = np.zeros(first * PARTS, U)
        np.add.at(sums, cell.astype(np.int64), value)
        sums = sums.reshape(first, PARTS)
        without = sums.sum(axis=1, dtype=U)[:, None] - sums
        place = np.arange(first * PARTS, dtype=U).reshape(first, PARTS) + U(tag << 40)
        found = mix(without + mix(place))
        filled = np.bincount(cell.astype(np.int64), minlength=first * PARTS).reshape(first, PARTS)
        none = filled.sum(axis=1)[:, None] == filled
        out.append(found[~none] if none.any(axis=1).sum() <= spare else found.reshape(-1))
    return np.concatenate(out) if out else np.zeros(0, U)


def sketch_width(n: int, percent: int) -> int:
    """Classes of a sketch of ``n`` features: a power of two, 3 to 6 for each allowed difference."""
    return 1 << max(6, (3 * allowed(2 * n, percent)).bit_length())


def sketch(features: np.ndarray, percent: int) -> bytes:
    """Parities of the numbers of features in each of some classes."""
    width = sketch_width(len(features), percent)
    place = (mix(features + U(0xA0761D6478BD642F)) & U(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8)).tobytes()


def fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Parities over fewer classes, a power of two of bytes."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def pairs_of(signs: np.ndarray, docs: np.ndarray, most: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures and their documents, and distinct pairs (smallest document of a signature, another).

    A signature of more than ``most`` documents keeps its smallest one alone; the pairs are those of such signatures.
    """
    order = np.lexsort((docs, signs))
    signs, docs = signs[order], docs[order]
    head = np.concatenate(([True], signs[1:] != signs[:-1])) if len(signs) else np.zeros(0, bool)
    group = np.cumsum(head) - 1
    large = (np.bincount(group) > most)[group] if len(signs) else head
    leader = docs[head][group]
    other = large & (leader != docs)
    pairs = np.unique(np.stack((leader[other], docs[other]), axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    kept = head | ~large
    return signs[kept], docs[kept], pairs


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct rows (a, b), ascending."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return np.stack((a[first], b[first]), axis=1)


PACKED = "kind int, bucket int, doc long, n long, h1 long, h2 long, blob binary"
PACKED_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("doc", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("blob", pa.binary())])


def _sets_and_pairs(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """A row per document with its set's size, hash and sketch, and the distinct candidate pairs a (leader), b."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    targets = -(-buckets // PAIRS_FROM)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text", 2 << 20):
            ids = batch.column("doc").to_pylist()
            sets = shingle_sets(common.text_bytes(batch, "text"), words)
            rows, first = [], {}
            for k, (doc, s) in enumerate(zip(ids, sets, strict=True)):
                h1, h2 = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()
                rows.append({"kind": 0, "bucket": h1 % buckets, "doc": doc, "n": len(s), "h1": h1, "h2": h2, "blob": sketch(s, percent)})
                # Equal sets are joined by their hashes, so one of them is enough here.
                if len(s) and doc is not None and ((h1, h2) not in first or doc < ids[first[h1, h2]]):
                    first[h1, h2] = k
            signs = [signatures(sets[k], percent) for k in first.values()]
            if signs:
                owners = np.repeat(np.array([ids[k] for k in first.values()], np.int64), [len(x) for x in signs])
                signs = np.concatenate(signs)
                for b, some in common.by_value(((signs >> U(20)) % U(buckets)).astype(np.int64)):
                    rows.append({"kind": 1, "bucket": b, "n": len(some), "blob": signs[some].tobytes() + owners[some].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=PACKED_ARROW)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, owners = [], []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            plain = batch.filter(pa.array(kinds == 0))
            if plain.num_rows:
                yield plain
            for k in np.flatnonzero(kinds == 1).tolist():
                data = np.frombuffer(batch.column("blob")[k].as_buffer(), np.int64)
                signs.append(data[: len(data) // 2].view(U).copy())
                owners.append(data[len(data) // 2 :].copy())
        if signs:
            whole, owner = np.concatenate(signs), np.concatenate(owners)
            signs, owners = [], []
            pairs = pairs_of(whole, owner)[2]
            for b, some in common.by_value((mix(pairs[:, 0].astype(U)) % U(targets)).astype(np.int64)):
                yield pa.RecordBatch.from_pylist([{"kind": 2, "bucket": b, "n": len(some), "blob": pairs[some].tobytes()}], schema=PACKED_ARROW)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0, 2), np.int64)]
        for batch in batches:
            held += [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2).copy() for x in batch.column("blob")]
            if sum(map(len, held[1:])) > len(held[0]):
                held = [distinct_pairs(*np.concatenate(held).T)]
        pairs = distinct_pairs(*np.concatenate(held).T)
        for at in range(0, len(pairs), common.BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + common.BATCH_ROWS, c]) for c in (0, 1)], names=["a", "b"])

    packed = docs.mapInArrow(common.releasing(sign), PACKED).repartitionById(buckets, "bucket")
    found = common.materialize(packed.mapInArrow(common.releasing(lead), PACKED), "part-enum")
    pairs = found.where("kind = 2").select("bucket", "blob").repartitionById(targets, "bucket").select("blob")
    return found.where("kind = 0").select("doc", "n", "h1", "h2", F.col("blob").alias("sketch")), common.materialize(pairs.mapInArrow(common.releasing(once), "a long, b long"), "once")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc`` is in ``ids``: by broadcast if these are few enough, else by a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc", "left_semi")


def may_link(a: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (a, b, na, nb, x, y) that their sketches x and y don't rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            fine = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            most = (na + nb) * (100 - percent) // (100 + percent)
            rows = np.flatnonzero(fine)
            some = batch.take(pa.array(rows))
            keep = []
            for row, x, y in zip(rows.tolist(), some.column("x").to_pylist(), some.column("y").to_pylist(), strict=True):
                u, v = (fold(np.frombuffer(z, np.uint8)[None, :], min(len(x), len(y))) for z in (x, y))
                if int(np.bitwise_count(u ^ v).sum()) <= most[row]:
                    keep.append(row)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return a.mapInArrow(common.releasing(check), "a long, b long")


def verify(docs: DataFrame, pairs: DataFrame, sets_of: Callable, percent: int) -> DataFrame:
    """Those of the written ``pairs`` (a, b: a is the hub) whose whole sets link; ``sets_of`` gives texts' sets."""
    # A hub with many partners is copied to several tasks, each with some of them.
    loads = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("copies"))
    hubs = loads.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("a").alias("doc"), F.lit(0).alias("kind"))
    members = pairs.join(loads, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"), F.col("b").alias("doc"), F.lit(1).alias("kind"))
    asked = common.materialize(hubs.unionAll(members), "asked")
    texts = _only(docs.where("doc IS NOT NULL"), asked.select("doc").distinct())
    rows = asked.join(texts, "doc").repartition("hub", "copy").sortWithinPartitions("hub", "copy", "kind", "doc")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mains = None, []
        for batch in common.text_slices(batches, "text", 2 << 20):
            out = []
            sets = sets_of(common.text_bytes(batch, "text"))
            for hub, copy, doc, kind, s in zip(*(batch.column(c).to_pylist() for c in ("hub", "copy", "doc", "kind")), sets, strict=True):
                if (hub, copy) != held:
                    held, mains = (hub, copy), []
                if kind == 0:
                    mains.append(s)
                    continue
                for m in mains:
                    both = int(np.isin(s, m, assume_unique=True).sum())
                    if both and 100 * both >= percent * (len(s) + len(m) - both):
                        out.append((hub, doc))
                        break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return common.materialize(rows.select("hub", "copy", "doc", "kind", "text").mapInArrow(common.releasing(check), "a long, b long"), "links")


BLOCKS = "cluster long, band int, block int, owner long, blob binary"
BLOCKS_ARROW = pa.schema([("cluster", pa.int64()), ("band", pa.int32()), ("block", pa.int32()), ("owner", pa.int64()), ("blob", pa.binary())])


def _around_leaders(pairs: DataFrame) -> DataFrame:
    """(cluster, doc): for each leader of ``pairs`` (a, b, own) itself, the documents it leads, and those that these lead in
    their slices (``own`` pairs) in turn.

    Slices send all documents of a signature but where these are many; then the slice's leader stands for the others.  So
    any two documents that share a signature are in the cluster of its leader.
    """
    near = pairs.select(F.col("a").alias("cluster"), F.col("b").alias("doc"))
    own = pairs.where("own").select(F.col("a").alias("m"), F.col("b").alias("doc"))
    further = pairs.where("NOT own").select(F.col("a").alias("cluster"), F.col("b").alias("m")).join(own, "m").select("cluster", "doc")
    return near.unionAll(further).unionAll(pairs.select(F.col("a").alias("cluster"), F.col("a").alias("doc"))).distinct()


def unsettled(pairs: DataFrame, sets: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs that may link though no leader joined them: from the documents around each leader of ``pairs`` (a, b, own).

    Clusters of a few documents are compared many at a time.  Documents of a larger one are dealt to blocks by size band and component.  Blocks of the same and of neighbouring bands
    meet, one pair of blocks to a row; a block holds ``BLOCK_BYTES`` of sketches at most, whatever the cluster's size.  The
    result is packed in tiles (tile, pairs, docs), as there may be many pairs beside the documents.
    """
    most = TILE_BYTES
    docs = sets.select("doc", "n", "sketch").join(components.select(F.col("v").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    docs = common.materialize(docs, "sketches")
    rows = _around_leaders(pairs).join(docs.select("doc", "n", "component", F.octet_length("sketch").cast("long").alias("w")), "doc")
    rows = common.materialize(rows, "clusters")
    # Two documents, or a cluster that links join already, leave nothing to settle.
    open_ = rows.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum(F.col("w") + 24).alias("load"), F.min("component").alias("low"), F.max("component").alias("high")).where("docs > 2 AND low < high")
    open_ = common.materialize(open_.select("cluster", ((F.col("docs") <= SMALL) & (F.col("load") <= BLOCK_BYTES)).alias("small")), "open")
    few = rows.join(open_.where("small"), "cluster").select("cluster", "doc").join(docs, "doc").select("cluster", "doc", "n", "component", "sketch")
    few = few.repartition("cluster").sortWithinPartitions("cluster", "doc").mapInArrow(common.releasing(lambda batches: _within(batches, percent, most)), TILES)
    edges = F.array(*(F.lit(x) for x in bands(percent)))
    rows = rows.join(open_.where("NOT small"), "cluster").withColumn("band", F.size(F.filter(edges, lambda x: x <= F.col("n"))))
    # A component that fills blocks of its own needs no comparison inside; the others are dealt together.
    load = rows.groupBy("cluster", "band", "component").agg(F.sum(F.col("w") + 24).alias("load"))
    load = load.withColumn("owner", F.when(F.col("load") > BLOCK_BYTES, F.col("component")))
    per = load.groupBy("cluster", "band", "owner").agg(F.ceil(F.sum("load") / BLOCK_BYTES).cast("int").alias("blocks"))
    load = load.join(per.withColumnRenamed("owner", "of"), ["cluster", "band"]).where(F.col("owner").eqNullSafe(F.col("of"))).select("cluster", "band", "component", "owner", "blocks")
    placed = rows.join(load, ["cluster", "band", "component"]).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    placed = placed.select("cluster", "band", "block", "owner", "doc", "component").join(docs.select("doc", "n", "sketch"), "doc")
    placed = placed.repartition("cluster", "band", "owner", "block").sortWithinPartitions("cluster", "band", "owner", "block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block as one blob: number, then ids, sizes, components, widths, and the sketches."""
        key, held = None, []

        def close() -> pa.RecordBatch:
            doc, n, component, sketch = zip(*held, strict=True)
            numbers = np.array([doc, n, component, [len(x) for x in sketch]], np.int64)
            return pa.RecordBatch.from_pylist([dict(zip(("cluster", "band", "owner", "block"), key, strict=True), blob=np.int64(len(doc)).tobytes() + numbers.tobytes() + b"".join(sketch))], schema=BLOCKS_ARROW)

        for batch in batches:
            for *now, doc, n, component, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key and held:
                    yield close()
                    held = []
                key = now
                held.append((doc, n, component, sketch))
        if held:
            yield close()

    blocks = common.materialize(placed.select("cluster", "band", "owner", "block", "doc", "n", "component", "sketch").mapInArrow(common.releasing(pack), BLOCKS), "blocks")
    number = blocks.withColumn("at", F.struct(F.coalesce("owner", F.lit(-1)).alias("owner"), F.col("block").alias("block")))
    left = number.select("cluster", F.explode(F.array("band", F.col("band") + 1)).alias("to"), F.col("band").alias("i"), F.col("at").alias("x_at"), F.col("owner").alias("x_owner"), F.col("blob").alias("x"))
    right = number.select("cluster", F.col("band").alias("to"), F.col("at").alias("y_at"), F.col("owner").alias("y_owner"), F.col("blob").alias("y"))
    both = left.join(right, ["cluster", "to"]).where(((F.col("i") < F.col("to")) | (F.col("x_at") <= F.col("y_at"))) & ~F.coalesce(F.col("x_owner") == F.col("y_owner"), F.lit(False)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x, y = (_by_width(batch.column(c)[at].as_buffer()) for c in ("x", "y"))
                yield from _named([pairs.tobytes() for pairs in _tiles(_near(x, y, percent), x, y, most)])

    found = both.select("x", "y").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(common.releasing(compare), TILES).unionAll(few)
    # Leaders that lead the same documents make the same tiles.
    return common.materialize(found.dropDuplicates(["tile"]), "tiles")


TILES = "tile binary, pairs binary, docs array<bigint>"


def _named(tiles: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Packed pairs as tiles of :func:`unsettled`."""
    if tiles:
        docs = [np.unique(np.frombuffer(t, np.int64)) for t in tiles]
        names = [hashlib.blake2b(t, digest_size=16).digest() for t in tiles]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(tiles, pa.binary()), pa.array(docs, pa.list_(pa.int64()))], names=["tile", "pairs", "docs"])


def _within(batches: Iterator[pa.RecordBatch], percent: int, most: int) -> Iterator[pa.RecordBatch]:
    """Tiles of whole clusters from rows (cluster, doc, n, component, sketch) in order, a batch of rows at a time."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        clusters = batch.column("cluster").to_numpy()
        cut = int(np.searchsorted(clusters, clusters[-1]))
        yield from _named(_near_within(batch.slice(0, cut), percent, most))
        rest = batch.slice(cut)
    if rest is not None:
        yield from _named(_near_within(rest, percent, most))


def _near_within(batch: pa.RecordBatch, percent: int, most: int) -> list[bytes]:
    """As :func:`_near` and :func:`_tiles`, for the pairs inside each of the clusters of a batch."""
    cluster, doc, n, component = (batch.column(k).to_numpy() for k in range(4))
    rows = np.arange(len(doc))
    after = np.searchsorted(cluster, cluster, side="right") - rows - 1
    i = np.repeat(rows, after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    both, least = n[i] + n[j], np.minimum(n[i], n[j])
    fine = (component[i] != component[j]) & (doc[i] != doc[j]) & (100 * least >= percent * (both - least))
    i, j, both = i[fine], j[fine], both[fine]
    sketches = batch.column(4).to_pylist()
    widths = np.array([len(x) for x in sketches], np.int64)
    near = np.zeros(len(i), bool)
    for code, some in common.by_value(widths[i] << 32 | widths[j]):
        width = min(code >> 32, code & 0xFFFFFFFF)
        x, y = (fold(np.frombuffer(b"".join([sketches[k] for k in side[some].tolist()]), np.uint8).reshape(len(some), -1), width).view(U) for side in (i, j))
        near[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= both[some] * (100 - percent) // (100 + percent)
    i, j = i[near], j[near]
    tiles = []
    for start, some in common.by_value(np.searchsorted(cluster, cluster[i])):
        pairs = np.unique(np.stack((doc[i[some]], doc[j[some]]), axis=1), axis=0)
        stop = start + 1 + after[start]
        tiles += [t.tobytes() for t in _tiles(pairs, {0: (doc[start:stop], n[start:stop])}, {}, most)]
    return tiles


def _tiles(pairs: np.ndarray, x: dict, y: dict, most: int) -> Iterator[np.ndarray]:
    """``pairs`` of two blocks in parts whose documents have about ``most`` bytes of sets on each side at most."""
    if not len(pairs):
        return
    docs, sizes = (np.concatenate([block[k] for side in (x, y) for block in side.values()]) for k in (0, 1))
    order = np.argsort(docs, kind="stable")
    docs, sizes = docs[order], sizes[order]
    part = []
    for side in (0, 1):
        own, at = np.unique(pairs[:, side], return_inverse=True)
        part.append((np.cumsum(sizes[np.searchsorted(docs, own)] * 8) // most)[at])
    for _, rows in common.by_value(part[0] * (int(part[1].max()) + 1) + part[1]):
        yield pairs[rows]


def links_of_tiles(tiles: DataFrame, texts_of: Callable, sets_of: Callable, percent: int) -> DataFrame:
    """Links (a, b) among the packed pairs of ``tiles`` (tile, pairs, docs), enough to join in each tile what links there.

    A tile's documents are rows, its pairs are not: they are verified on whole sets where the tile's documents meet.
    ``texts_of`` gives the texts (doc, text) of a table of ids (doc), ``sets_of`` texts' sets.
    """
    asked = tiles.select("tile", F.explode("docs").alias("doc"))
    texts = texts_of(asked.select("doc").distinct())
    rows = asked.join(texts, "doc").select("tile", F.lit(1).alias("kind"), "doc", "text", F.lit(None).cast("binary").alias("pairs"))
    rows = tiles.select("tile", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("string").alias("text"), "pairs").unionAll(rows)
    rows = rows.repartition("tile").sortWithinPartitions("tile", "kind", "doc")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, sets = None, None, {}
        for batch in common.text_slices(batches, "text", 2 << 20):
            found = []
            for tile, doc, blob, s in zip(*(batch.column(c).to_pylist() for c in ("tile", "doc", "pairs")), sets_of(common.text_bytes(batch, "text")), strict=True):
                if tile != now:
                    found += _joined(pairs, sets, percent)
                    now, pairs, sets = tile, None, {}
                if blob is not None:
                    pairs = np.frombuffer(blob, np.int64).reshape(-1, 2)
                elif len(s):
                    sets.setdefault(doc, []).append(s)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
        found = _joined(pairs, sets, percent)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return common.materialize(rows.mapInArrow(common.releasing(check), "a long, b long"), "links")


def _joined(pairs: np.ndarray | None, sets: dict[int, list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links among ``pairs``; a pair that links before it join already is left out, so there are fewer than documents."""
    if pairs is None:
        return []
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (w := up.get(v, v)) != v:
            up[v] = v = up.get(w, w)
        return v

    out = []
    for a, rows in common.by_value(pairs[:, 0]):
        for mine in sets.get(a, []):
            others = [(b, s) for b in pairs[rows, 1].tolist() if root(a) != root(b) for s in sets.get(b, [])]
            if not others:
                continue
            sizes = np.array([len(s) for _, s in others])
            every = np.concatenate([s for _, s in others])
            equal = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            both = np.add.reduceat(equal, np.cumsum(sizes) - sizes, dtype=np.int64)
            for k in np.flatnonzero((both > 0) & (100 * both >= percent * (sizes + len(mine) - both))).tolist():
                u, v = root(a), root(others[k][0])
                if u != v:
                    up[u] = v
                    out.append((a, others[k][0]))
    return out


def _near(x: dict, y: dict, percent: int) -> np.ndarray:
    """Pairs of documents of two blocks, of different components, that sizes and sketches don't rule out."""
    found = [np.zeros((0, 2), np.int64)]
    for wx, (dx, nx, cx, sx) in x.items():
        for wy, (dy, ny, cy, sy) in y.items():
            width = min(wx, wy)
            u, v = (fold(z, width).view(np.uint64) for z in (sx, sy))
            rows = max(1, STEP_BYTES // (len(v) * width))
            for k in range(0, len(u), rows):  # the differences of a step take STEP_BYTES, or one row's
                some = slice(k, k + rows)
                both, least = nx[some, None] + ny[None, :], np.minimum(nx[some, None], ny[None, :])
                near = (cx[some, None] != cy[None, :]) & (dx[some, None] != dy[None, :]) & (100 * least >= percent * (both - least))
                if not near.any():
                    continue
                bits = np.bitwise_count(u[some, None, :] ^ v[None, :, :]).sum(axis=2, dtype=np.int64)
                i, j = np.nonzero(near & (bits <= both * (100 - percent) // (100 + percent)))
                found.append(np.stack((np.minimum(dx[i + k], dy[j]), np.maximum(dx[i + k], dy[j])), axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _by_width(blob: pa.Buffer) -> dict[int, tuple[np.ndarray, ...]]:
    """A block's ids, sizes, components and sketches, by the sketches' width in bytes."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    docs, sizes, components, widths = np.frombuffer(blob, np.int64, 4 * n, 8).reshape(4, n)
    data, ends = np.frombuffer(blob, np.uint8, -1, 8 + 32 * n), np.cumsum(widths)
    out = {}
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        out[w] = (docs[rows], sizes[rows], components[rows], data[(ends[rows] - w)[:, None] + np.arange(w)])
    return out


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of linked documents: ``key``, n_shingles, component_id; a row per row of ``docs``."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sets, pairs = _sets_and_pairs(rows, words, percent)
    whole = sets.where("n > 0 AND doc IS NOT NULL")
    groups = whole.groupBy("n", "h1", "h2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copies = common.materialize(whole.join(groups, ["n", "h1", "h2"]).where("doc <> rep").select("doc", "rep").distinct(), "copies")
    # A document id of several sets is linked with each one's copies, but stays in pairs for the sets of its own.
    several = whole.join(copies.select("doc").distinct(), "doc", "left_semi").select("doc", "n", "h1", "h2").distinct().groupBy("doc").count().where("count > 1")
    stood_for = common.materialize(copies.join(several, "doc", "left_anti"), "stood-for")
    for c in ("a", "b"):
        pairs = pairs.join(stood_for.select(F.col("doc").alias(c), "rep"), c, "left").withColumn(c, F.coalesce("rep", c)).drop("rep")
    led = common.materialize(pairs.where("a <> b").select("a", "b", F.lit(False).alias("own")).distinct(), "pairs")
    pairs = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    once = whole.join(stood_for.select("doc"), "doc", "left_anti").select("doc", "n", "sketch") if stood_for.limit(1).count() else whole.select("doc", "n", "sketch")
    side = lambda c, n, s: once.select(F.col("doc").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    sets_of = partial(shingle_sets, words=words)
    likely = common.materialize(may_link(pairs.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b"), percent).distinct(), "likely")
    links = verify(rows, likely, sets_of, percent)
    texts_of = partial(_only, rows.where("doc IS NOT NULL"))
    tiles = unsettled(led, once, common.connected_components(links), percent)
    links = links.unionAll(links_of_tiles(tiles, texts_of, sets_of, percent))
    links = links.unionAll(copies.select(F.col("rep").alias("a"), F.col("doc").alias("b")))
    joined = common.connected_components(links).withColumnRenamed("v", "doc")
    out = sets.join(joined, "doc", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over all of ``documents``."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
