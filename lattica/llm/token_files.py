"""Token ids in binary files, a wavelet matrix per block of tokens.

A file holds the ids of consecutive documents: a JSON header, the documents' ids and ends, and for each block
of tokens one bit-plane per bit of an id, most significant first, and the planes' rank directories, each compressed
on its own.  A block's
planes are a wavelet matrix: tokens are stably dealt by the bit at hand before the next plane is written, so
with ranks over the planes any token is read, any id counted in any range, and any occurrence found without
decoding the rest.

Documents are dealt to ascending ranges of their ids by a deterministic histogram, files roll by tokens, and
are committed through temporary names and a manifest.

Defined results: a null text is the empty text and has the end id alone; null ids come first; rows that
repeat a document id are documents of their own, in the order of their texts (of a hash of these where one id
fills several shards); an empty table gives no file
and no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import common

VOCABULARY, END = "byte_bpe_50k.json", 0
MAGIC = b"LWM2"
BLOCK = 1 << 18
#: Tokens at which a file closes, bytes of text of a range shard.
ROLL_TOKENS, SHARD_BYTES = 1 << 22, 16 << 20
#: Pieces that stay in a worker's cache, and that it saw once; packed generations of older ones (about 35 bytes a piece);
#: runs of marks in it; words that the library gets as one text.
CACHED, GENERATIONS, MARKS, TOGETHER = 3 << 15, 8, 1 << 12, 1000
#: Marks that end a token before them if a letter is there: all of ASCII but the apostrophe, which begins tokens with letters.
MARKED = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: The vocabulary spells bytes as visible characters: those that are visible as themselves, the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
VISIBLE = {b: b for b in _PLAIN} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}

#: A no-break space, which is no letter, as the vocabulary spells it.
NO_BREAK = "".join(chr(VISIBLE[b]) for b in b"\xc2\xa0")


class Generation:
    """Pieces and their ids in a few buffers, for a fifth of the memory of a dictionary; asked for many at a time."""

    def __init__(self, known: dict[bytes, bytes]):
        self.hashes = np.fromiter(map(hash, known), np.int64, len(known))
        order = np.argsort(self.hashes)
        self.hashes = self.hashes[order]
        self.pieces, self.ids = (pa.array(list(x), pa.binary()).take(pa.array(order)) for x in (known, known.values()))

    def find(self, pieces: list[bytes], hashes: np.ndarray) -> dict[bytes, bytes]:
        """Ids of those of the pieces that are here (of pieces of one hash, one may not be found)."""
        if not len(self.hashes):
            return {}
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes[at] == hashes)
        here, ids = (x.take(pa.array(at[rows])).to_pylist() for x in (self.pieces, self.ids))
        return {p: x for k, p, x in zip(rows.tolist(), here, ids, strict=True) if p == pieces[k]}


class Tokens:
    """Ids of texts, from the library; pieces that a text may safely be cut into are remembered.

    A text may be cut before a space or newline that a visible character follows: the vocabulary's pattern
    ends a token there, whatever stands before.  Texts with other white space in a row, with white space
    that is not a plain space or newline, or with a special string go to the library whole.
    """

    ends = frozenset(bytes([c]) for c in MARKED)
    ODD = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"<|")
    ODD_BEYOND_ASCII = (*ODD, b" \xc2", b"\n\xc2", b" \xe1", b"\n\xe1", b" \xe2", b"\n\xe2", b" \xe3", b"\n\xe3")

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.now: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}
        self.older: list[Generation] = []
        self.marks: dict[bytes, bytes] = {}
        (self.newline,) = self.ask([b"\n"])
        #: The library's model alone, without the pattern.
        self.plain = Tokenizer(self.tokenizer.model)
        #: Ids of tokens that begin with a space or a newline; whether no token goes from letters over a space.
        self.leads, self.apart = np.zeros(1 << self.bits, bool), True
        space, newline = chr(VISIBLE[32]), chr(VISIBLE[10])
        for token, number in self.tokenizer.get_vocab().items():
            self.leads[number] = token[:1] in (space, newline)
            before = token.rpartition(space)[0]
            if before.strip(space) and not before.startswith(space + NO_BREAK):
                self.apart = False

    def ask(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in got]

    def ask_words(self, words: list[bytes]) -> list[bytes]:
        """As :meth:`ask`, for spaces or newlines with what follows, many of them as one text in which each begins with
        the next space or newline: plain words need no search for the pattern."""
        plain, others, out = [], [], [b""] * len(words)
        for k, w in enumerate(words):
            # The pattern takes a space and letters as one.
            (plain if self.apart and w[0] == 32 and w[1:].decode().isalpha() else others).append(k)
        for places, ask in ((plain, self.ask_plain), (others, self.ask)):
            for low in range(0, len(places), TOGETHER):
                some = places[low : low + TOGETHER]
                for k, ids in zip(some, self.ask_together([words[k] for k in some], ask), strict=True):
                    out[k] = ids
        return out

    def ask_plain(self, texts: list[bytes]) -> list[bytes]:
        """As :meth:`ask`, for spaces and letters."""
        got = self.plain.encode_batch_fast([x.decode("latin-1").translate(VISIBLE) for x in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in got]

    def ask_together(self, words: list[bytes], ask: Callable) -> list[bytes]:
        """As ``ask``, from the ids of all words in a row."""
        (joined,) = ask([b"".join(words)])
        starts = np.flatnonzero(self.leads[np.frombuffer(joined, self.kind)])
        if len(starts) != len(words):
            return ask(words)
        ends = (np.append(starts, len(joined) // self.kind.itemsize) * self.kind.itemsize).tolist()
        return [joined[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def mark(self, run: bytes) -> bytes:
        """Ids of a run of marks after a letter."""
        if run not in self.marks:
            if len(self.marks) >= MARKS:
                self.marks.clear()
            (self.marks[run],) = self.ask([run])
        return self.marks[run]

    def age(self, known: dict[bytes, bytes]) -> None:
        """Pack what leaves the dictionaries; pieces that end in marks come from their cores."""
        self.older = [Generation({p: x for p, x in known.items() if p[-1:] not in self.ends}), *self.older[: GENERATIONS - 1]]

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces that are not among those that stay; what was seen before stays from now on."""
        if len(self.now) > CACHED:
            self.age(self.once)
            self.once, self.now = self.now, {}
        elif len(self.once) > CACHED:
            self.age(self.once)
            self.once = {}
        now, once, ends, asked, ended, cores, fresh = self.now, self.once, self.ends, {}, [], [], []
        out = list(map(once.pop, pieces, repeat(None)))
        again = [k for k, got in enumerate(out) if got is not None]
        now.update(zip([pieces[k] for k in again], [out[k] for k in again], strict=True))
        for k in [k for k, got in enumerate(out) if got is None]:
            p = pieces[k]
            if p[-1:] in ends and (core := p.rstrip(MARKED))[-1:].isalpha():  # marks after a letter are tokens of their own
                out[k] = now.get(core) or once.get(core)
                if out[k] is None:
                    asked[core] = None
                ended.append(k)
                cores.append(core)
            else:
                asked[p] = None
                fresh.append(k)
        names, found = list(asked), {}
        for generation in self.older if names else []:
            known = generation.find(names, np.fromiter(map(hash, names), np.int64, len(names)))
            found |= known
            names = [p for p in names if p not in known]
        now |= found
        asked = dict(zip(names, self.ask_words([p if p[:1] == b"\n" else b" " + p for p in names]), strict=True))
        once |= asked
        asked |= found
        for k, core in zip(ended, cores, strict=True):
            p = pieces[k]
            out[k] = once[p] = (out[k] or asked[core]) + self.mark(p[len(core) :])
        for k in fresh:
            out[k] = asked[pieces[k]]
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes."""
        cut, led_texts, whole, out = [], [], [], [b""] * len(texts)
        for k, t in enumerate(texts):
            if not t:
                continue
            led = b"\n" + t  # the first piece counts as one after a newline, whose id is dropped below
            if t[0] <= 32 or t[-1] <= 32 or any(x in led for x in (self.ODD if led.isascii() else self.ODD_BEYOND_ASCII)):
                whole.append(k)
            else:
                cut.append(k)
                led_texts.append(b"\n" + t.replace(b"\n", b" \n"))
        if cut:
            # Each distinct piece is looked up once; Arrow puts the ids of all occurrences in a row.
            split = pc.split_pattern(pa.array(led_texts, pa.large_binary()), b" ")
            pieces = split.values.dictionary_encode()
            _, offsets, data = pieces.dictionary.buffers()
            starts, data = np.frombuffer(offsets, np.int64, len(pieces.dictionary) + 1).tolist(), data.to_pybytes()
            names = [data[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            ids = list(map(self.now.get, names))
            gaps = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(gaps, self.learn([names[i] for i in gaps]), strict=True):
                ids[i] = x
            row = pa.array(ids, pa.large_binary()).take(pieces.indices)
            _, offsets, data = row.buffers()
            ends = np.frombuffer(offsets, np.int64, len(row) + 1)[split.offsets.to_numpy()].tolist()
            data, skip = data.to_pybytes(), len(self.newline)
            for k, start, end in zip(cut, ends, ends[1:], strict=False):
                out[k] = data[start + skip : end]
        for k, ids in zip(whole, self.ask([texts[k] for k in whole]) if whole else [], strict=True):
            out[k] = ids
        return out


class Ranks:
    """Rank and select over the bits of one plane."""

    STEP = 512

    def __init__(self, packed: np.ndarray, n: int, before: np.ndarray | None = None):
        self.packed, self.n = packed, n
        self.before = self.directory(packed) if before is None else before

    @classmethod
    def directory(cls, packed: np.ndarray) -> np.ndarray:
        """Set bits before each step, and in all."""
        words = np.pad(packed, (0, -len(packed) % (cls.STEP // 8))).view(np.uint64).reshape(-1, cls.STEP // 64)
        return np.concatenate(([0], np.cumsum(np.bitwise_count(words).sum(axis=1, dtype=np.int64)))).astype("<u4")

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3] >> (7 - (i & 7))) & 1

    def ones(self, i: int) -> int:
        """Set bits among the first ``i``."""
        step = i // self.STEP
        low = step * self.STEP // 8
        part = self.packed[low : (i + 7) // 8]
        count = int(np.bitwise_count(part).sum())
        if i & 7:
            count -= int(np.bitwise_count(np.uint8(part[-1] & (0xFF >> (i & 7)))))
        return int(self.before[step]) + count

    def rank(self, bit: int, i: int) -> int:
        return self.ones(i) if bit else i - self.ones(i)

    def select(self, bit: int, k: int) -> int:
        """Where the ``k``-th (from 0) such bit stands."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.rank(bit, middle + 1) > k:
                high = middle
            else:
                low = middle + 1
        return low


class WaveletMatrix:
    """Access, counting and occurrence lookup in a block of ids, from its bit-planes."""

    def __init__(self, planes: list[np.ndarray], n: int, directories: Callable[[], np.ndarray] | None = None):
        self.n, self.bits = n, len(planes)
        self.raw = planes
        self._directories = directories
        self._ranks: list[Ranks] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, now = [], ids
        for b in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << b)) != 0
            planes.append(np.packbits(ones))
            if b:
                now = np.concatenate((now[~ones], now[ones]))
        return cls(planes, len(ids))

    @property
    def ranks(self) -> list[Ranks]:
        if self._ranks is None:
            known = [None] * self.bits if self._directories is None else self._directories().reshape(self.bits, -1)
            self._ranks = [Ranks(p, self.n, d) for p, d in zip(self.raw, known, strict=True)]
        return self._ranks

    def access(self, i: int) -> int:
        value = 0
        for r in self.ranks:
            bit = r.bit(i)
            value = value << 1 | bit
            i = r.n - r.ones(r.n) + r.ones(i) if bit else i - r.ones(i)
        return value

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        for k, r in enumerate(self.ranks):
            if symbol >> (self.bits - 1 - k) & 1:
                zeros = r.n - r.ones(r.n)
                low, high = zeros + r.ones(low), zeros + r.ones(high)
            else:
                low, high = low - r.ones(low), high - r.ones(high)
        return low, high

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        """How often ``symbol`` occurs at positions ``low`` to ``high`` (not included)."""
        if symbol >> self.bits:
            return 0
        low, high = self._range(symbol, low, self.n if high is None else high)
        return high - low

    def occurrence(self, symbol: int, k: int) -> int | None:
        """Position of the ``k``-th (from 0) occurrence of ``symbol``, or None."""
        if symbol >> self.bits:
            return None
        low, high = self._range(symbol, 0, self.n)
        if k >= high - low:
            return None
        i = low + k
        for level in range(self.bits - 1, -1, -1):
            r = self.ranks[level]
            if symbol >> (self.bits - 1 - level) & 1:
                i = r.select(1, i - (r.n - r.ones(r.n)))
            else:
                i = r.select(0, i)
        return i

    def decode(self, kind: np.dtype) -> np.ndarray:
        """All ids: the planes are undone from the last to the first."""
        now = None
        for b, plane in enumerate(reversed(self.raw)):
            ones = np.unpackbits(plane, count=self.n).view(bool)
            back = np.zeros(self.n, kind)
            if now is not None:
                zeros = self.n - int(np.count_nonzero(ones))
                back[~ones], back[ones] = now[:zeros], now[zeros:]
            back |= ones.astype(kind) << kind.type(b)
            now = back
        return np.zeros(self.n, kind) if now is None else now


def pack(shard: int, part: int, doc_ids: list[int | None], ends: list[int], ids: np.ndarray, bits: int) -> bytes:
    """The bytes of a file."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = [squeeze(x.tobytes()) for x in (known, np.array([x or 0 for x in doc_ids], np.int64), np.array(ends, np.int64))]
    for at in range(0, len(ids), BLOCK):
        planes = WaveletMatrix.build(ids[at : at + BLOCK], bits).raw
        parts += [squeeze(p.tobytes()) for p in planes]
        parts.append(squeeze(b"".join(Ranks.directory(p).tobytes() for p in planes)))
    head = json.dumps({"shard": shard, "part": part, "docs": len(doc_ids), "tokens": len(ids), "bits": bits, "block": BLOCK, "sizes": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class TokenFile:
    """A file's documents and ids; blocks are unpacked when they are asked for."""

    def __init__(self, data):
        import zstandard

        view = memoryview(data)
        if bytes(view[:4]) != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack("<I", view[4:8])
        self.head = json.loads(bytes(view[8 : 8 + n]))
        ends = np.cumsum([8 + n, *self.head["sizes"]])
        if ends[-1] != len(view):
            raise ValueError("a token file is cut off")
        unzip = zstandard.ZstdDecompressor()
        self.part = lambda k: unzip.decompress(view[ends[k] : ends[k + 1]])
        known, ids = np.frombuffer(self.part(0), np.uint8), np.frombuffer(self.part(1), np.int64)
        self.doc_ids = [i if k else None for k, i in zip(known.tolist(), ids.tolist(), strict=True)]
        self.ends = np.frombuffer(self.part(2), np.int64)
        self.kind = np.dtype("<u2" if self.head["bits"] <= 16 else "<u4")
        self._held: tuple[int | None, WaveletMatrix | None] = (None, None)

    def block(self, k: int) -> WaveletMatrix:
        if self._held[0] != k:
            bits, n = self.head["bits"], min(self.head["block"], self.head["tokens"] - k * self.head["block"])
            first = 3 + k * (bits + 1)
            planes = [np.frombuffer(self.part(first + b), np.uint8) for b in range(bits)]
            self._held = (k, WaveletMatrix(planes, n, lambda: np.frombuffer(self.part(first + bits), "<u4")))
        return self._held[1]

    @property
    def blocks(self) -> int:
        return -(-self.head["tokens"] // self.head["block"])

    def token(self, i: int) -> int:
        return self.block(i // self.head["block"]).access(i % self.head["block"])

    def count(self, symbol: int) -> int:
        return sum(self.block(k).count(symbol) for k in range(self.blocks))

    def occurrence(self, symbol: int, k: int) -> int | None:
        for b in range(self.blocks):
            block = self.block(b)
            if k < (here := block.count(symbol)):
                return b * self.head["block"] + block.occurrence(symbol, k)
            k -= here
        return None

    def tokens(self) -> np.ndarray:
        return np.concatenate([self.block(k).decode(self.kind) for k in range(self.blocks)] or [np.zeros(0, self.kind)])


MANIFEST = common.MANIFEST + ", tokens long"
MANIFEST_ARROW = pa.schema([("name", pa.string()), ("temp", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("rows", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("tokens", pa.int64())])


def write(docs: DataFrame, uri: str, name: str = VOCABULARY, end: int = END, roll_tokens: int = ROLL_TOKENS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) as ``.lwm`` files below ``uri``; gives the written manifest."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = common.materialize(rows.select("doc_id", (F.octet_length("text") + 8).alias("w")), "token-sizes")
    shards = common.range_shards(sizes, "doc_id", "w", shard_bytes)
    sharded = shards.add(rows, "doc_id", F.crc32("text"))
    ordered = sharded.repartitionById(shards.count, "_shard").sortWithinPartitions("doc_id", "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = common.held(("tokens", name), lambda: Tokens(name))
        closing = np.array([end], tokens.kind).tobytes()
        files, doc_ids, ends, held, n, shard, part = [], [], [], [], 0, None, 0

        def close() -> None:
            nonlocal doc_ids, ends, held, n, part
            data = pack(shard, part, doc_ids, ends, np.frombuffer(b"".join(held), tokens.kind), tokens.bits)
            temp, final = common.write_file(uri, f"part-{shard:06d}-{part:05d}.lwm", data)
            files.append({"name": final, "temp": temp, "shard": shard, "part": part, "rows": len(doc_ids), "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "tokens": n})
            doc_ids, ends, held, n, part = [], [], [], 0, part + 1

        for batch in common.text_slices(batches, "text"):
            numbers = batch.column("_shard").to_pylist()
            for doc, number, ids in zip(batch.column("doc_id").to_pylist(), numbers, tokens.encode(common.text_bytes(batch, "text")), strict=True):
                if number != shard:
                    if doc_ids:
                        close()
                    shard, part = number, 0
                held.append(ids + closing)
                n += (len(ids) + len(closing)) // tokens.kind.itemsize
                doc_ids.append(doc)
                ends.append(n)
                if n >= roll_tokens:
                    close()
        if doc_ids:
            close()
        if files:
            yield pa.RecordBatch.from_pylist(files, schema=MANIFEST_ARROW)

    ordered.mapInArrow(store, MANIFEST).write.parquet(f"{uri}/_manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest")
    common.commit_files(manifest)
    common.drop_path(spark, f"{uri}/_temporary")
    return manifest


READ = "shard int, part int, doc_id long, first long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, uri: str) -> DataFrame:
    """A row per document of the files below ``uri``: doc_id, start, n_tokens, ids_crc32."""

    def rows(buffer: pa.Buffer) -> Iterator[pa.RecordBatch]:
        file = TokenFile(buffer)
        ids = file.tokens().astype("<u4")
        starts = np.concatenate(([0], file.ends[:-1])).astype(np.int64)
        n = len(starts)
        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), file.ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([file.head["shard"]] * n, pa.int32()), pa.array([file.head["part"]] * n, pa.int32()), pa.array(file.doc_ids, pa.int64()), pa.array(starts), pa.array(file.ends - starts), pa.array(crcs, pa.int64())],
            names=["shard", "part", "doc_id", "first", "n_tokens", "ids_crc32"],
        )

    docs = common.binary_files(spark, uri, READ, rows, "*.lwm")
    files = spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest").select("shard", "part", "tokens")
    # Tokens before each shard (one row for each of the range shards), then before each file of it.
    shards = files.groupBy("shard").agg(F.sum("tokens").alias("all"))
    before = shards.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("ahead"))
    inside = F.sum("tokens").over(Window.partitionBy("shard").orderBy("part")) - F.col("tokens")
    offsets = files.select("shard", "part", inside.alias("inside")).join(before, "shard").select("shard", "part", (F.col("inside") + F.col("ahead")).alias("offset"))
    return docs.join(offsets, ["shard", "part"]).select("doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all of ``documents`` and read them back."""
    uri = common.scratch_dir(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), uri)
    return read(spark, uri)
