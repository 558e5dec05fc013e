"""Each operator on a small table with nulls, empty and long texts, repeated rows, clashing columns, and an empty table; results from brute force."""

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import common, decontaminate, jaccard, lines, mixing, substrings, token_counts, token_files, topk, toxicity, warc

PROSE = "the cat sat on a mat while nine grey birds sang under old trees near our quiet house by the wide river"
LONG = " ".join(f"w{k} x{k % 7}" for k in range(3000))


@pytest.fixture(scope="module")
def docs(spark):
    near = PROSE.replace("quiet", "loud")
    rows = [(1, PROSE), (2, PROSE), (3, near), (4, None), (5, ""), (6, "  \n\t "), (7, "a b"), (8, "A  B"), (9, LONG), (10, "é" * 30 + "\n" + PROSE), (10, "again"), (None, PROSE), (None, None), (11, "x" * 120), (12, "x" * 70), (13, "solo")]
    return spark.createDataFrame([(i, t, "n", 1, 2) for i, t in rows], "doc_id long, text string, n string, a int, bucket int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_warc(spark):
    rows = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u\r\nx", ""), (5, "u5", "é\r\n\r\nb"), (5, "u5", "é\r\n\r\nb"), (None, "u", "z"), (6, "u6", "q" * 300_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, kind string").repartition(3)
    out = []
    for _ in range(2):
        uri = common.scratch_dir(spark, "warc")
        manifest = warc.write(pages, uri, roll_bytes=200, shard_bytes=2000)
        out.append([(r["name"].rsplit("/", 1)[1], r["sha256"]) for r in manifest.orderBy("name").collect()])
        got = [tuple(r) for r in warc.read(spark, uri).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    assert out[0] == out[1] and len(out[0]) > 1  # the files are a function of the rows
    want = [(1, 8, "revisit", 2), (2, 8, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 7, "response", None), (5, 7, "revisit", 5), (None, 1, "response", None), (6, 300_000, "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    uri = common.scratch_dir(spark, "warc")
    warc.write(pages.limit(0), uri)
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", None, False, 0).replace(b"abc", b"abd"))


def test_warc_without_small_revisits(spark):
    uri = common.scratch_dir(spark, "warc")
    warc.write(spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], "page_id long, url string, html string"), uri, revisit_from=10)
    assert {r["record_type"] for r in warc.read(spark, uri).collect()} == {"response"}


def components_of(rows, words, percent):
    sets = defaultdict(list)
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    ids, up = [i for i in sets if i is not None], {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for i in ids:
        for j in ids:
            if i < j and any(x and 100 * len(x & y) >= percent * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (find(i) if i is not None else None) for i in sets}, sets


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (2, 60)])
def test_jaccard_join(spark, docs, words, percent):
    want, sets = components_of(texts(docs), words, percent)
    got = jaccard.components(docs, words, percent).collect()
    assert len(got) == docs.count()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, c) for i, c in want.items()}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == {(i, len(s)) for i, x in sets.items() for s in x}


def test_jaccard_repeated_id_of_which_one_text_is_a_copy(spark):
    words = [[f"{c}{k}" for k in range(60)] for c in "abc"]
    a, b, c = (" ".join(w) for w in words)
    near_b, near_c = (" ".join([*w[:-1], "other"]) for w in words[1:])
    # 7 repeats 3 and is near 9; 12 repeats 5, and is the first with the text of 14, near 15.
    rows = [(3, a), (7, a), (7, b), (9, near_b), (5, "five of these words"), (12, "five of these words"), (12, c), (14, c), (15, near_c)]
    for n in (1, 5):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        want, _ = components_of(texts(table), 4, 85)
        assert want[9] == 3 and want[15] == 5
        assert {r["doc_id"]: r["component_id"] for r in jaccard.components(table, 4, 85).collect()} == want


def test_jaccard_empty(empty):
    assert jaccard.components(empty).count() == 0


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for n in (7, 12, 40, 150, 900):
        for _ in range(20):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            k = jaccard.allowed(2 * n, 85) // 2
            b = np.unique(np.concatenate((a[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64))))
            a = np.unique(a)
            if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) and k:
                assert set(jaccard.signatures(a, 85).tolist()) & set(jaccard.signatures(b, 85).tolist())
                x, y = (np.frombuffer(jaccard.sketch(s, 85), np.uint8)[None, :] for s in (a, b))
                w = min(x.shape[1], y.shape[1])
                assert int(np.bitwise_count(jaccard.fold(x, w) ^ jaccard.fold(y, w)).sum()) <= jaccard.allowed(len(a) + len(b), 85)


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200, rows[50][1]), (201, rows[50][1]), (202, None), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (205, [1.0, 2.0]), (250, [1.0, 3.0]), (None, [0.0] * 6), (206, [70000.0, -1e9, 0.5, 1e12, 0.0, 1.0]), (300, [1e9, 1.0, 2e5, 0.0, -3.0, 0.25])]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, embedding array<float>, id string, x int").repartition(3)
    got = defaultdict(list)
    for r in topk.search(topk.build(table, block_rows=32), table.where("vec_id % 50 = 0"), 5, query_bytes=300).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in [i for i in ints if i % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert set(got) == {i for i in ints if i % 50 == 0}
    assert topk.search(topk.build(table.limit(0)), table.limit(0), 5).count() == 0


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_decontaminate(spark, docs, shard_bytes):
    items = [(1, "SAT on a mat, while nine grey birds sang under old trees"), (2, "a b"), (3, "nothing here at all but more words than ten of them"), (4, None), (5, ""), (2, "a b"), (None, "solo"), (6, PROSE)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.digest(decontaminate.find(docs, bench, shard_bytes=shard_bytes)).collect()}
    norm = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t).lower().split()
    for doc, text in texts(docs):
        w, hit, found = norm(text), set(), set()
        for item, t in items:
            p = norm(t or "")
            k = min(len(p), 10)
            wins = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if p else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found.add("" if item is None else str(item))
        assert got[doc, len(w)] == (len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()), doc
    assert decontaminate.digest(decontaminate.find(docs, bench.limit(0))).where("contaminated").count() == 0


def test_toxicity_learns_and_handles_odd_rows(spark, docs, sf_dir):
    rows = [(k, ("you are an idiot and scum " if k % 3 == 0 else "a nice day by the river ") * (1 + k % 4)) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select((docs.doc_id + 1000).alias("doc_id"), "text"))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = model.score(table).withColumn("held", toxicity.held_out()).collect()
    assert len(got) == table.count() and all(0 <= r["score"] <= 1 for r in got)
    test = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["held"]]
    assert test and all((r["score"] >= 0.3) == (r["doc_id"] % 3 == 0) for r in test)
    assert {r["held"] for r in got if r["doc_id"] == 6} == {zlib.crc32(b"6") % 4 == 2}
    none = toxicity.fit(table, labels.limit(0)).score(table)
    assert {r["score"] for r in none.select("score").distinct().collect()} == {0.0}
    assert model.score(table.limit(0)).count() == 0


def test_toxicity_lexicon_does_not_depend_on_partitions(spark):
    rows = [(f"idiot filler{k} {'table' if k % 4 == 0 else 'chair'}", 1.0) for k in range(80)] + [(f"nice filler{k} {'table' if k % 4 == 0 else 'chair'}", 0.0) for k in range(80, 400)]
    table = spark.createDataFrame(rows, "text string, label double")
    one = toxicity.learn_lexicon(table.coalesce(1))
    assert "idiot" in "".join(one) and not any("table" in t for t in one)
    assert toxicity.learn_lexicon(spark.createDataFrame(spark.sparkContext.parallelize(rows, 200), table.schema)) == one


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.fit(table, labels).score(table).join(labels, "doc_id").where(toxicity.held_out()).collect()
    hit = [(r["score"] >= 0.3, r["toxic"]) for r in got]
    assert sum(p == bool(y) for p, y in hit) / len(hit) > 0.95
    assert sum(p for p, y in hit if y) / sum(y for _, y in hit) > 0.8


def test_substrings(docs, empty):
    rows = texts(docs)
    first = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    got = sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.find(docs).collect()], key=str)
    want = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        want.append((i, len(b), int(gone.sum()), int((edge > 0).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert got == sorted(want, key=str)
    assert substrings.find(empty).count() == 0


def test_substring_pieces_hold_every_window_once(monkeypatch):
    import zstandard

    monkeypatch.setattr(substrings, "PIECE_BYTES", 100)
    monkeypatch.setattr(substrings, "SLICE_BYTES", 300)
    rng = np.random.default_rng(2)
    text = rng.integers(97, 101, 1700, dtype=np.uint8).tobytes()
    ends = np.array([40, 700, 749, 799, 1700], np.int64)
    part = substrings.Slice(np.arange(5).tobytes(), ends.tobytes(), zstandard.ZstdCompressor().compress(text))
    seen = []
    for units, owners, offsets in part.chunks(50):
        starts = np.cumsum(units.sizes) - units.sizes
        for k in range(len(units.start)):
            at = int(units.start[k] - starts[units.piece[k]] + offsets[units.piece[k]])
            seen += range(at, at + int(units.count[k]))
            assert units.content(k) == text[at : at + int(units.count[k]) + 49] and units.count[k] <= 35
    begin = [0, *ends[:-1].tolist()]
    assert sorted(seen) == [p for b, e in zip(begin, ends.tolist(), strict=True) for p in range(b, e - 49)]


def test_fuzzy_lines(spark, docs, empty):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, f"{a}\n\nunrelated words stand in this longer line here"), (2, a.replace("seven", "sevem") + "\n" + a), (3, a.upper()), (4, None), (5, "ab\nab\n ab "), (6, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc"], r["line_no"]): (r["class_doc"], r["class_line"], r["kept"]) for r in lines.components(table).collect()}
    assert got == {(1, 0): (1, 0, True), (1, 2): (1, 2, True), (2, 0): (1, 0, False), (2, 1): (1, 0, False), (3, 0): (3, 0, True), (5, 0): (5, 0, True), (5, 1): (5, 0, False), (5, 2): (5, 0, False)}
    assert lines.components(docs).count() > 0
    assert lines.components(empty).count() == 0


def line_links(table):
    """Lines in order, and by brute force the pairs that link."""
    rows = [(r["doc_id"], r["text"]) for r in table.orderBy("doc_id").collect()]
    sets = [{t[k : k + lines.SHINGLE] for k in range(len(t) - lines.SHINGLE + 1)} for _, t in rows]
    return rows, {(i, j) for j in range(len(rows)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= lines.PERCENT * len(sets[i] | sets[j])}


def firsts(rows, linked):
    up = list(range(len(rows)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, j in sorted(linked):
        a, b = sorted((find(i), find(j)))
        up[b] = a
    return {rows[k][0]: rows[find(k)][0] for k in range(len(rows))}


def test_fuzzy_lines_without_spaces_and_with_early_edits(spark):
    rng = np.random.default_rng(5)
    kinds = ["".join(map(chr, range(0x4E00, 0x4E00 + 900))), "abcdefghijklmnopqrstuvwxyz0123456789/=&", "abcdefgh\t,;(){}"]
    rows = []
    for k in range(60):
        t = "".join(rng.choice(list(kinds[k % 3]), 90))
        rows += [t, "#" + t[1:], t[:2] + "#" + t[3:]]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want, linked = line_links(table)
    assert len(linked) >= 180
    assert {r["doc"]: r["class_doc"] for r in lines.components(table).collect()} == firsts(want, linked)


def test_fuzzy_lines_in_large_buckets(spark):
    rng = np.random.default_rng(6)
    letters, rows = list("abcdefghijklmnopqrstuvwxyz "), []
    base = "".join(rng.choice(letters, 240))
    for _ in range(300):  # about 0.7 to each other; every line has one near copy
        t = base + "".join(rng.choice(letters, 50))
        rows += [t, t[:270] + "".join(rng.choice(letters, 8)) + t[278:]]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    want, linked = line_links(table)
    first = firsts(want, linked)
    assert sum(k != v for k, v in first.items()) == 300
    got = {r["doc"]: r["class_doc"] for r in lines.components(table).collect()}
    assert got == first


def test_token_files(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a<|endoftext|>b c", "x  y \n z\n\nw.", "don't I'll, '. '.", "\x1c a\x85b\xa0c　d", "é, É.\nÉ b,\nc", "a ́b"]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    uri = common.scratch_dir(spark, "tokens")
    token_files.write(table, uri, roll_tokens=2000, shard_bytes=4000)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in token_files.read(spark, uri).collect())
    want, start = [], 0
    for i, t in sorted(texts(table), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((start, len(ids), zlib.crc32(ids.tobytes()), i))
        start += len(ids)
    assert got == want
    uri = common.scratch_dir(spark, "tokens")
    token_files.write(empty, uri)


def test_wavelet_matrix_answers_without_decoding():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 5000) % 50257).astype("<u2")
    file = token_files.TokenFile(token_files.pack(3, 4, [7, None], [2000, 5000], ids, 16))
    assert (file.tokens() == ids).all() and file.doc_ids == [7, None]
    for i in range(0, 5000, 331):
        assert file.token(i) == ids[i]
    for s in [1, 2, 3, int(ids[4999]), 50256]:
        places = np.flatnonzero(ids == s)
        assert file.count(s) == len(places) and file.block(0).count(s, 100, 900) == int(((places >= 100) & (places < 900)).sum())
        assert [file.occurrence(s, k) for k in range(min(5, len(places)))] == places[:5].tolist()
        assert file.occurrence(s, len(places)) is None
    with pytest.raises(ValueError):
        token_files.TokenFile(token_files.pack(0, 0, [1], [5000], ids, 16)[:-3])


def test_mixing_meets_its_targets(spark, empty):
    rows = [(k, "w " * (1 + k % 5), f"s{k % 3}", "en" if k % 4 else None) for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out, names = mixing.mixed(table, keep=0.5)
    got = out.collect()
    tokens, weight, chance, kept = (names[n] for n in ("tokens", "weight", "probability", "kept"))
    assert len(got) == 600
    total = sum(r[tokens] for r in got)
    for column in ("source", "lang"):
        have, goal = defaultdict(float), defaultdict(float)
        for r in got:
            have[r[column]] += r[tokens] * r[weight]
            goal[r[column]] += r[tokens]
        goal = {k: v**mixing.TEMPER for k, v in goal.items()}
        for k, v in goal.items():
            assert have[k] / total == pytest.approx(v / sum(goal.values()), rel=1e-3)
    assert sum(r[tokens] * r[chance] for r in got) == pytest.approx(0.5 * total, rel=1e-6)
    assert all(r[kept] <= (r[chance] > 0) for r in got)
    assert mixing.sample(table.limit(0)).columns == table.columns


def test_token_counts(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["<|endoftext|>x <|ENDOFTEXT|>, y", "Σ. ΑΣ, ΑΣ.", "İ, ß.", "漢字 漢字, ℡"]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    got = sorted([tuple(r) for r in token_counts.count_tokens(table, limit=100).collect()], key=str)
    want = []
    for i, t in texts(table):
        n = len(own.encode(t, add_special_tokens=False).ids)
        want.append((i, len(t.encode()), n, n > 100))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(empty).count() == 0


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        if x != y:
            up[y] = x
    got = {r["v"]: r["component"] for r in common.connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)} | {v: find(v) for v in got}


def test_jaccard_pairs_that_no_leader_settles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 200)
    monkeypatch.setattr(jaccard, "STEP_BYTES", 64)
    seen = []
    unsettled = jaccard.unsettled
    monkeypatch.setattr(jaccard, "unsettled", lambda *a: seen.append(unsettled(*a)) or seen[-1])
    # Small sets that share most of their shingles with the smallest one, and all but a few with one another.
    base = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        rows.append((2 * k, " ".join([*base[:40], *(f"x{k}y{j}" for j in range(20))])))
        rows.append((2 * k + 1, " ".join([*base[:40], *(f"x{k}y{j}" for j in range(19)), "z"])))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want, _ = components_of(texts(table), 2, 80)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(table, 2, 80).collect()} == want
    assert seen[0].count() > 0


def test_jaccard_pairs_are_rows_once_whatever_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 2000)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base[:k] + ["x"] + base[k:]) for k in range(0, 120, 4)]
    table = spark.createDataFrame([*enumerate(texts), (90, texts[3]), (91, texts[3])], "doc long, text string").coalesce(1)
    _, pairs = jaccard._sets_and_pairs(table, 4, 85)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) <= 32 * 31 / 2
    assert not [p for p in got if {90, 91} & set(p)]  # equal sets stand for one in a slice
    assert {r["component_id"] for r in jaccard.components(table.withColumnRenamed("doc", "doc_id"), 4, 85).collect()} == {0}


def test_ranks_are_those_of_tuples_and_no_place_is_sorted_twice(monkeypatch):
    rng = np.random.default_rng(5)
    for ends in ((-1, 256), (0, 1 << 40), (-(1 << 62), 1 << 62)):
        columns = [rng.integers(*ends, 300)[rng.integers(0, 40, 300)], rng.integers(0, 3, 300), rng.integers(0, 1 << 16, 300) % 5]
        number = {x: k for k, x in enumerate(sorted(set(zip(*(c.tolist() for c in columns), strict=True))))}
        assert substrings.rank(*columns).tolist() == [number[x] for x in zip(*(c.tolist() for c in columns), strict=True)]
    seen, rank = [], substrings.rank
    monkeypatch.setattr(substrings, "rank", lambda *c: seen.append(len(c)) or rank(*c))
    text = b"abc" * 40
    names = substrings.prefix_names(np.frombuffer(text + bytes(40), np.uint8), np.arange(71), np.arange(71) % 3, 50)
    assert seen == [3, 2, 3]
    assert all(names[i] == names[j] for i in range(71) for j in range(i % 3, 71, 3))


def test_pairs_of_leaves_small_groups_alone():
    signs, docs = np.array([5, 5, 5, 7, 7, 9], np.uint64), np.array([3, 1, 2, 4, 6, 8])
    s, d, p = jaccard.pairs_of(signs, docs, 2)
    assert s.tolist() == [5, 7, 7, 9] and d.tolist() == [1, 4, 6, 8] and p.tolist() == [[1, 2], [1, 3]]


def test_range_shards_with_a_far_id_and_a_hot_one(spark):
    rows = [(k, 10) for k in range(20_000)] + [(1 << 62, 10), (-(1 << 63), 10)] + [(30_000, 10)] * 5000
    keys = spark.createDataFrame(rows, "id long, w int").withColumn("sub", (F.rand(1) * (1 << 32)).cast("long"))
    keys = common.materialize(keys.unionAll(spark.createDataFrame([(None, 1, 0)], keys.schema)), "keys")
    shards = common.range_shards(keys.select("id", "w"), "id", "w", 2000)
    got = shards.add(keys, "id", F.col("sub")).groupBy("_shard").agg(F.sum("w").alias("w"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("_shard").collect()
    assert [r["_shard"] for r in got] == list(range(shards.count)) and 120 <= shards.count <= 260
    assert max(r["w"] for r in got) <= 4000
    assert all(a["high"] <= b["low"] for a, b in zip(got, got[1:], strict=False))
    assert common.range_shards(keys.select("id", "w").limit(0), "id", "w", 2000).count == 1


def test_mixing_weights_are_those_of_plain_fitting(spark):
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 500, (4, 3, 5))
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", int(tokens[a, b, c])) for a in range(4) for b in range(3) for c in range(5)], "source string, lang string, topic string, tokens long")
    goals = [rng.random(4), rng.random(3), rng.random(5)]
    goals[0][2] = 0  # nothing of one source
    want = tokens.astype(float)
    for _ in range(300):
        for axis, g in enumerate(goals):
            now = want.sum(axis=tuple(x for x in range(3) if x != axis))
            want = want * np.expand_dims(g / g.sum() * tokens.sum() / np.maximum(now, 1e-300) * (now > 0), [x for x in range(3) if x != axis])
    targets = {d: spark.createDataFrame([(f"{d[0]}{k}", float(x)) for k, x in enumerate(g)] + [("no such value", 1.0)][: int(d != "source")], "value string, share double") for d, g in zip(("source", "lang", "topic"), goals, strict=True)}
    for r in mixing.rake(cells, targets, tolerance=1e-9, sweeps=300).collect():
        a, b, c = (int(r[d][1:]) for d in ("source", "lang", "topic"))
        assert r["tokens"] * r["weight"] == pytest.approx(want[a, b, c], rel=1e-4, abs=1e-6) if r["tokens"] else r["weight"] == 1.0


def test_mixing_odd_rows(spark):
    rows = [(1, None, "a", "x", 1), (1, "one two", "a", None, 2), (2, "", None, "x", 3), (None, "three", "b", "x", 4), (1, "one two", "a", None, 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    out, names = mixing.mixed(table, keep=1.0)
    got = out.collect()
    assert len(got) == 5 and sorted(r[names["tokens"]] for r in got) == [0, 0, 1, 2, 2] and out.columns[:5] == table.columns
    assert mixing.sample(table, keep=1.0, temper=1.0).count() == 5


def test_covered_bytes_of_masks():
    rng = np.random.default_rng(3)
    at, count = np.arange(0, 4000, 40), rng.integers(1, 36, 100)
    masks = rng.integers(0, 1 << 35, 100).astype(np.uint64) * rng.integers(0, 2, 100).astype(np.uint64)
    masks[::7] = substrings.ALL
    want = np.zeros(4200, bool)
    for a, c, m in zip(at.tolist(), count.tolist(), masks.tolist(), strict=True):
        for k in range(c):
            if m >> k & 1:
                want[a + k : a + k + 50] = True
    assert (substrings.cover(4200, at, count, masks, 50) == want).all() and not want.all()


def test_token_cache_keeps_what_comes_again(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 2000)
    tokens, library, calls = token_files.Tokens(token_files.VOCABULARY), token_files.Tokens(token_files.VOCABULARY), []
    for name in ("ask", "ask_plain"):
        monkeypatch.setattr(tokens, name, lambda texts, ask=getattr(tokens, name): calls.append(len(texts)) or ask(texts))
    marks = ["", ",", ".", "...", "%%%", "&'", "-_-", ");", "'s"]
    for k in range(20):
        words = [f"{'' if n % 3 else chr(233)}zq{'abcdefghij'[k % 10]}{chr(97 + k)}{chr(97 + n % 26)}{chr(97 + n // 26)}{marks[n % len(marks)]}" for n in range(400)]
        texts = ["always here, " + " ".join(words), f"\u00e0 {k}.{k}\nalways there. It's {k}x"]
        calls.clear()
        assert tokens.encode([t.encode() for t in texts]) == library.ask([t.encode() for t in texts])
        assert len(calls) < 20 and sum(calls) < 20  # words are asked for together
        assert len(tokens.once) <= 2000 + 900 and len(tokens.now) <= 2000
    assert b"here," in tokens.now


def test_token_files_of_odd_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(8)
    parts = ["\xa0", "　", " ", "\x85", " ", "\x1c", " ", "\n", "a", "Bc", "é", "漢", ".", ",", "'s", "1", "\t", "\r\n", "…"]
    texts_ = ["".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(6000)] + parts
    tokens = token_files.Tokens(token_files.VOCABULARY)
    for text, ids in zip(texts_, tokens.encode([t.encode() for t in texts_]), strict=True):
        assert np.frombuffer(ids, tokens.kind).tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_line_signatures_keep_their_recall():
    rng = np.random.default_rng(9)
    kinds = ["abcdefghijklmnopqrstuvwxyz     ", "".join(map(chr, range(0x4E00, 0x5200))), "abcdefghij0123456789/=&?", "(){};= \tabcdef"]
    hit = total = 0
    for k in range(800):
        n = int(rng.integers(30, 200))
        t = list(rng.choice(list(kinds[k % 4]), n))
        near = list(t)
        for _ in range(max(1, n // 60)):
            near[int(rng.integers(0, n))] = "#"
        a, b = "".join(t).strip(" ").encode(), "".join(near).strip(" ").encode()
        x, y = (set(s.tolist()) for s in lines.line_sets([a, b], lines.SHINGLE))
        if 100 * len(x & y) >= lines.PERCENT * len(x | y):
            place, sizes, keys, sketches = lines.sign([a, b], lines.SHINGLE, lines.BANDS, lines.PERCENT)
            assert sizes.tolist() == [len(x), len(y)]
            total, hit = total + 1, hit + bool((keys[0] == keys[1]).any())
            u, v = (np.frombuffer(s, np.uint8)[None, :] for s in sketches)
            w = min(u.shape[1], v.shape[1])
            assert int(np.bitwise_count(jaccard.fold(u, w) ^ jaccard.fold(v, w)).sum()) <= jaccard.allowed(len(x) + len(y), lines.PERCENT)
    assert total > 300 and hit / total > 0.98


def test_fuzzy_lines_of_odd_rows(spark):
    long = "x" * 50 + "abcdefghij " * 20_000
    rows = [(None, "same line here\nother"), (1, "same line here"), (2, long), (3, long[:-5]), (1, "same line here"), (4, None)]
    table = spark.createDataFrame([(*r, "k", 7) for r in rows], "doc_id long, text string, kind string, h1 int").repartition(2)
    got = {(r["doc"], r["line_no"]): (r["class_doc"], r["kept"]) for r in lines.components(table).collect()}
    assert got == {(None, 0): (None, True), (None, 1): (None, True), (1, 0): (None, False), (2, 0): (2, True), (3, 0): (2, False)}


def test_patterns_are_small_beside_their_text():
    import pickle

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(5000)]
    items = [(str(k), " ".join(rng.choice(words, 400)).encode()) for k in range(500)]
    size = sum(len(t) for _, t in items)
    made = decontaminate.Patterns(items)
    assert len(pickle.dumps(made)) < 20 * size + (21 << 20)
    assert sorted(x for _, _, found in made.search([items[7][1], b"nothing " * 30]) for x in found) == ["7"]


def test_jaccard_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_BYTES", 4000)
    made = {}
    materialize = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: made.setdefault(name, []).append(materialize(df, name)) or made[name][-1])
    # Most of each set is that of the smallest one, so sketches of 64 classes leave many pairs; some texts link in twos.
    base = [f"w{k}" for k in range(41)]
    rows = [(0, " ".join(base))]
    for k in range(1, 80):
        own = [*base[:36], *(f"x{k}y{j}" for j in range(5))]
        rows += [(2 * k, " ".join(own)), *([(2 * k + 1, " ".join([*own[:-1], "z"]))] if k % 4 == 0 else [])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _ = components_of(texts(table), 2, 80)
    assert len(set(want.values())) > 70
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(table, 2, 80).collect()} == want
    (tiles,) = made["tiles"]
    packed = sum(len(r["pairs"]) // 16 for r in tiles.collect())
    assert packed > 10 * len(rows)
    assert max(t.count() for tables in made.values() for t in tables) < packed
    assert all(8 * 41 * len(r["docs"]) <= 2 * 4000 + 2 * 8 * 41 for r in tiles.collect())


def test_links_of_a_tile_join_what_all_links_join():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = {k: [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 1 << 62, 60, dtype=np.uint64), base)) for _ in range(1 + k % 2)] for k in range(40)}
    pairs = np.array([(a, b) for a in range(40) for b in range(a + 1, 40)])
    links = [(a, b) for a, b in pairs.tolist() if any(100 * len(np.intersect1d(x, y)) >= 70 * len(np.union1d(x, y)) for x in sets[a] for y in sets[b])]
    got = jaccard._joined(pairs, sets, 70)
    assert set(got) <= set(links) and len(got) < 40 < len(links)

    def groups(edges):
        up = list(range(40))
        for _ in up:
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert groups(got) == groups(links)


def test_fuzzy_lines_leave_no_tables_behind(spark, monkeypatch):
    made, materialize = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name, *by: made.append((name, materialize(df, name, *by))) or made[-1][1])
    base = [f"some words of line {k} and then {k * k} more of them" for k in range(40)]
    table = spark.createDataFrame([(k, "\n".join([base[k % 40], base[k // 2] + " x"])) for k in range(80)], "doc_id long, text string")
    assert lines.components(table).where("NOT kept").count() > 0
    left = [name for name, t in made if os.path.exists(t.scratch_path.removeprefix("file://"))]
    assert len(made) > 10 and left == ["line-classes"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_small_clusters_have_the_pairs_of_blocks():
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for cluster in range(30):
        base = rng.integers(0, 1 << 62, int(rng.integers(20, 90)), dtype=np.uint64)
        sets = [np.unique(np.where(rng.random(len(base)) < 0.08, rng.integers(0, 1 << 62, len(base), dtype=np.uint64), base)) for _ in range(12)]
        held = [(cluster, 100 * cluster + k, len(x), k % 5, jaccard.sketch(x, 80)) for k, x in enumerate(sets)]
        rows += held
        blob = np.int64(12).tobytes() + np.array([[r[1] for r in held], [r[2] for r in held], [r[3] for r in held], [len(r[4]) for r in held]], np.int64).tobytes() + b"".join(r[4] for r in held)
        block = jaccard._by_width(pa.py_buffer(blob))
        want |= set(map(tuple, jaccard._near(block, block, 80).tolist()))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["cluster", "doc", "n", "component", "sketch"])
    got = list(jaccard._within(iter([batch.slice(k, 7) for k in range(0, len(rows), 7)]), 80, 1 << 20))
    pairs = [tuple(p) for b in got for x in b.column("pairs").to_pylist() for p in np.frombuffer(x, np.int64).reshape(-1, 2).tolist()]
    assert 0 < len(pairs) == len(set(pairs)) and set(pairs) == want


def test_token_pieces_that_left_the_cache_are_not_asked_for_again(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 300)
    tokens, library, calls = token_files.Tokens(token_files.VOCABULARY), token_files.Tokens(token_files.VOCABULARY), []
    monkeypatch.setattr(tokens, "ask_words", lambda words, ask=tokens.ask_words: calls.extend(words) or ask(words))
    texts = [" ".join(f"zq{chr(97 + k)}{chr(97 + n % 26)}{chr(97 + n // 26)}{',' if n % 3 else ''}" for n in range(400)).encode() for k in range(6)]
    want = library.ask(texts)
    assert [tokens.encode([t])[0] for t in texts] == want
    calls.clear()
    assert [tokens.encode([t])[0] for t in texts] == want and not calls
    assert len(tokens.older) <= token_files.GENERATIONS
