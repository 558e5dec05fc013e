"""Cross-tokenizer alignment over anchors at white space.

Every text, after a space, is tokenised by a byte-level vocabulary (A) and by a piece vocabulary (B).  Texts are cut at
anchors before spaces, where tokens of both end; this is verified on the tokens' bytes.  Between anchors stand pieces; how
these fall into groups (cut wherever both end) is worked out for many pieces at once, and kept by the worker.

Tokenising is exact for whole texts and remembers pieces: a piece ends before a space that follows a character that isn't
white space.  A's pattern always ends a token there, and B has no piece with a space after another character (checked
when the model is loaded), so pieces give the tokens of the whole text.  A piece that isn't known is put together from parts:
both end a token before a newline between visible characters, and before marks that follow a letter, if B has no piece of
letters and other characters.  Only pieces of up to KEPT_BYTES are kept.

Counts of id pairs over the corpus are sums by Spark of each task's sums.  Their number is bounded by the product of the
vocabularies, not by the corpus; they come to the documents in broadcast shards of SHARD_PAIRS pairs, a pass for each.

Defined results: null and empty texts, and those whose tokens' bytes differ from space+text, have no tokens: zeros and an
empty digest.  Repeated rows each get a row and count each; other columns are ignored; no rows give none.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common

#: Longest piece that a worker keeps, and pieces of each of the two generations it keeps.
KEPT_BYTES, KEPT = 64, 200_000
#: Id pairs of a broadcast: 17 bytes each.
SHARD_PAIRS = 2_000_000
#: A piece ends before a space after a character that is no white space; a last space belongs to the piece before it.
_PIECE_END = re.compile(r"(?<=\S) (?!\Z)")
#: Inside a piece: before a newline between visible characters, and before marks after a last letter.
_PART_END = re.compile(r"(?<=[!-~À-ɏ])(?=\n[!-~À-ɏ])|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[!-/:-@\[-`{-~]+(?:\Z|\n[!-~À-ɏ]))")


def byte_level() -> dict[str, int]:
    """Characters of byte-level vocabularies and their bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both libraries, and each id's bytes."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(a))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        of = byte_level()
        words = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.bytes_a = [bytes(of[c] for c in w) if all(c in of for c in w) else w.encode() for w, _ in words]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in every], np.int64) for every in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = len(words), len(pieces)
        plain = [p.lstrip("▁") for k, p in enumerate(pieces) if not self.b.is_byte(k) and not self.b.is_control(k) and not self.b.is_unknown(k)]
        self.apart = not any("\n" in p or p and p[0] != p and not p.isalpha() and any(map(str.isalpha, p)) for p in plain)
        self.led = len(self.b.encode("a"))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space after another character, so texts can't be cut there")

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each piece; one that doesn't begin with a space stands after a letter."""
        a = [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.b.encode([p[1:] if p[0] == " " else "a" + p for p in pieces], num_threads=1)
        return a, [x if p[0] == " " else x[self.led :] for p, x in zip(pieces, b, strict=True)]


class Pieces:
    """What is known of pieces: (n_a and n_b in one number, text of the groups, codes of the linked pairs), or None."""

    def __init__(self, tokenizers: Tokenizers):
        self.of = of = tokenizers
        self.now: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        marks = [f"{k}{mark}" for size, both in ((of.size_a, ",|"), (of.size_b, ",;")) for mark in both for k in range(size)]
        self.marks = np.array(marks, object)

    def cut(self, pieces: list[str]) -> list[tuple | None]:
        """Alignments of pieces; None where the tokens' bytes differ from the piece."""
        if not pieces:
            return []
        of, (a, b) = self.of, self.of.encode(pieces)
        data = [p.encode() for p in pieces]
        sizes = np.cumsum([len(d) for d in data])
        (n_a, n_b), flat = ([len(x) for x in ids] for ids in (a, b)), [np.array([t for x in ids for t in x], np.int64) for ids in (a, b)]
        ends_a, ends_b = np.cumsum(of.length_a[flat[0]]), np.cumsum(of.length_b[flat[1]])
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        whole = min(n_a) and min(n_b) and (ends_a[last_a - 1] == sizes).all() and (ends_b[last_b - 1] == sizes).all()
        joined = b"".join(data)
        if not whole or any(b"".join([words[t] for t in ids.tolist()]) != joined for words, ids in zip((of.bytes_a, of.bytes_b), flat, strict=True)):
            fine = [b"".join([of.bytes_a[t] for t in x]) == d == b"".join([of.bytes_b[t] for t in y]) for x, y, d in zip(a, b, data, strict=True)]
            got = iter(self.cut([p for p, f in zip(pieces, fine, strict=True) if f]))
            return [next(got) if f else None for f in fine]
        # A group ends where tokens of both end; its tokens of A come first, then those of B.
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
        shut_a, shut_b = ends_b[at] == ends_a, np.zeros(len(ends_b), bool)
        shut_b[at[shut_a]] = True
        codes = (flat[0][shut_a] * of.size_b + flat[1][shut_b]).astype("<i8").tobytes()
        group_a, group_b = np.cumsum(shut_a), np.cumsum(shut_b)
        order = np.argsort(np.concatenate((2 * (group_a - shut_a), 2 * (group_b - shut_b) + 1)), kind="stable")
        shown = np.concatenate((flat[0] + of.size_a * shut_a, flat[1] + 2 * of.size_a + of.size_b * shut_b))
        parts = self.marks[shown[order]].tolist()
        stops, links = (last_a + last_b).tolist(), (8 * group_a[last_a - 1]).tolist()
        out, start, low = [], 0, 0
        for x, y, stop, high in zip(n_a, n_b, stops, links, strict=True):
            out.append((x << 40 | y, "".join(parts[start:stop]), codes[low:high]))
            start, low = stop, high
        return out

    def learn(self, wanted: set[str]) -> dict[str, tuple | None]:
        """Alignments of pieces; those too long to keep come back, the others are kept."""
        if len(self.now) + len(wanted) > KEPT:
            self.old, self.now = self.now, {}
        now, old, ask, composed = self.now, self.old, [], []
        for p in wanted:
            if p in now:
                continue
            if p in old:
                now[p] = old[p]
            elif self.of.apart and len(parts := _PART_END.split(p)) > 1:
                composed.append((p, parts))
            else:
                ask.append(p)
        more = {part for _, parts in composed for part in parts if part not in now}
        for part in more:
            if part in old:
                now[part] = old[part]
        ask = list({*ask, *(part for part in more if part not in now)})
        for at in range(0, len(ask), 4096):
            some = ask[at : at + 4096]
            now.update(zip(some, self.cut(some), strict=True))
        for p, parts in composed:
            met = [now[part] for part in parts]
            now[p] = None if None in met else (sum(x[0] for x in met), "".join([x[1] for x in met]), b"".join([x[2] for x in met]))
        long = {p: now[p] for p in (*ask, *(p for p, _ in composed)) if len(p) > KEPT_BYTES}
        for p in long:
            del now[p]
        return long


def split(text: str) -> list[str]:
    """The pieces of space+text, each of which begins with a space."""
    if not text:
        return []
    first, *rest = _PIECE_END.split(" " + text)
    return [first, *(" " + p for p in rest)]


_OUT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def tokenise(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs with their times, packed.

    A code is a's id times the size of B's vocabulary, plus b's id, as 8 bytes; times have 4.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))

    def slices(batches: Iterator[pa.RecordBatch], known: Pieces) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text", 1 << 20):
            pieces = [split(t or "") for t in batch.column(1).to_pylist()]
            long = known.learn(set().union(*pieces))
            kept, out = known.now, []
            for parts in pieces:
                met = [kept[p] if p in kept else long[p] for p in parts]
                if not met or None in met:
                    out.append((0, 0, 0, 0, "", b"", b""))
                    continue
                both, groups, codes = zip(*met, strict=True)
                links = np.sort(np.frombuffer(b"".join(codes), "<i8"))
                first = np.flatnonzero(np.append(True, links[1:] != links[:-1]))
                times = np.diff(np.append(first, len(links))).astype("<u4")
                na, nb = divmod(sum(both), 1 << 40)
                out.append((na, nb, len(links), len(links), hashlib.sha256("".join(groups)[:-1].encode()).hexdigest(), links[first].tobytes(), times.tobytes()))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, *(x.split()[0] for x in _OUT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.held(("align", a, b), lambda: Pieces(Tokenizers(a, b)))
        gc.disable()  # what is kept has no cycles, and looking for them takes longer than the work
        try:
            yield from slices(batches, known)
        finally:
            gc.enable()

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {_OUT}")


def _summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(codes), np.concatenate(times)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(tokenised: DataFrame, size_b: int) -> DataFrame:
    """code, n, best: each linked id pair's count over a table of :func:`tokenise`, and whether it is its B id's highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        flush = lambda c, t: pa.RecordBatch.from_arrays([pa.array(c), pa.array(t)], names=["code", "n"])
        for batch in batches:
            for c, t in zip(batch.column(0), batch.column(1), strict=True):
                codes.append(np.frombuffer(c.as_buffer(), "<i8"))
                times.append(np.frombuffer(t.as_buffer(), "<u4").astype(np.int64))
                held += len(codes[-1])
                if held > 4_000_000:
                    c, t = _summed(codes, times)
                    codes, times, held = [c], [t], 0
                    if len(c) > 2_000_000:  # what a task holds stays bounded
                        yield flush(c, t)
                        codes, times = [c[:0]], [t[:0]]
        yield flush(*_summed(codes, times))

    counts = tokenised.select("codes", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = common.materialize(counts, "pairs").withColumn("b", F.col("code") % size_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return common.materialize(counts.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def count_links(tokenised: DataFrame, pairs: DataFrame, key: str = "doc_id", shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """A written table of :func:`tokenise` with n_best and count_sum, from the table of :func:`pair_counts`.

    Pairs are broadcast in shards of their codes' remainders, one after another; each pass is written before its broadcast is dropped.
    """
    spark = tokenised.sparkSession
    shards = max(1, -(-pairs.count() // shard_pairs))
    plain = [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = tokenised.schema[key].dataType.simpleString()
    done = tokenised.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(shards):
        part = pairs.where(F.col("code") % shards == k).toArrow().sort_by("code")
        table = spark.sparkContext.broadcast(tuple(part[c].to_numpy() for c in ("code", "n", "best")))

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            codes, counts, best = table.value
            for batch in batches:
                n_best, total = [], []
                for c, t in zip(batch.column("codes"), batch.column("times"), strict=True):
                    own, times = np.frombuffer(c.as_buffer(), "<i8"), np.frombuffer(t.as_buffer(), "<u4").astype(np.int64)
                    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1) if len(codes) else np.empty(0, np.int64)
                    here = codes[at] == own if len(codes) else np.empty(0, bool)
                    at, times = at[here], times[here] if len(codes) else times[:0]
                    n_best.append(int(times[best[at]].sum()))
                    total.append(int((times * counts[at]).sum()))
                more = {"n_best": n_best, "count_sum": total}
                yield pa.RecordBatch.from_arrays([pa.array(np.array(more[c], np.int64) + batch.column(c).to_numpy()) if c in more else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema.fields)
        found = done.mapInArrow(run, schema)
        done = common.materialize(found.drop("codes", "times") if k == shards - 1 else found, "links")
        table.unpersist()
    return done.selectExpr(f"CAST(`{key}` AS {kind}) AS `{key}`", *plain[1:5], "n_best", "count_sum", "groups_sha256")


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text", shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """Groups and links of each row's text, and how common its links are."""
    tokenised = common.materialize(tokenise(docs, a, b, key, text), "tokens")
    pairs = pair_counts(tokenised, Tokenizers(a, b).size_b)
    return count_links(tokenised, pairs, key, shard_pairs)


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every whole text of ``documents``."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
