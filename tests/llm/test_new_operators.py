"""Phrases, alignment and host rules against brute force, on odd rows, without rows, and with clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import align, common, host_rules, phrases, token_files

ODD = [None, "", "  \n\t ", "a b", "<|endoftext|> and </s>, <s>x", "low ▁ mark", "été déjà  vu\n\n  漢字 かな", " x 　 y\x1c z\x85 w", "tab\tand\r\nlines \n end ", "n\x00ul ok"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(30)] + ["New", "York", "city", "the", "a.", "b,", "é;"]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(1, 120)), p=None)) + " New York City hall the" * (k % 3), "en" if k % 2 else "de", f"h{k % 4}") for k in range(80)]
    rows += [(100 + k, "one two three four five six seven! " * 2 + "ends here now", None, "copies") for k in range(12)]
    rows += [(200 + k, t, "en", None) for k, t in enumerate(ODD)] + [(200, "again again " * 40, None, "h1"), (None, "no id " * 30, "en", "h1")]
    table = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, lang string, source string, n long, code int")
    return table.repartition(5)


def plain_phrases(rows, least, held, top):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r["lang"] or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found, cand = [], {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            if len(p) == 2 and any(100 * b >= held * a for q, b in cand.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            s, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "bucket"), [(10, 2000, 1 << 20), (2, 15, 300)])
def test_phrases(spark, docs, least, top, bucket, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 64)  # blocks share words with the one before
    got = sorted(tuple(r) for r in phrases.mine(docs, least, top=top, bucket_bytes=bucket).collect())
    assert got == plain_phrases(docs.collect(), least, 50, top)
    assert {r[0] for r in got} == {"de", "en", "und"}


def test_paths_hold_every_frequent_gram_once(spark, docs):
    graph = phrases.count_graph(docs, 2)
    paths, nodes = phrases.compact(graph)
    edges = Counter({(r["lang"], *r["first"].split(" "), r["last"]): r["n"] for r in graph.where("size = 3").collect()})
    again = Counter()
    for r in paths.collect():
        again.update({(r["lang"], *r["words"][i : i + 3]): r["n"] for i in range(len(r["words"]) - 2)})
    assert again == edges and nodes.where("inner").count() and max(len(r["words"]) for r in paths.collect()) > 3


def test_phrases_empty(docs):
    assert phrases.mine(docs.limit(0)).count() == 0


def plain_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = align.byte_level()
    docs, counts = [], Counter()
    for r in rows:
        text, links, groups = r["text"], [], []
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        xa = [bytes(back[c] for c in ta.id_to_token(i)) for i in a]
        xb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and b"".join(xa) == b"".join(xb) == (" " + text).encode():
            ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
            both, pa, pb = sorted(set(ea) & set(eb)), 0, 0
            for e in both:
                ia, ib = ea.index(e) + 1, eb.index(e) + 1
                groups.append(",".join(map(str, a[pa:ia])) + "|" + ",".join(map(str, b[pb:ib])))
                links.append((a[ia - 1], b[ib - 1]))
                pa, pb = ia, ib
        else:
            a = b = []
        counts.update(links)
        docs.append((r["doc_id"], len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    return sorted(((i, na, nb, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), h) for i, na, nb, g, x, h in docs), key=str)


@pytest.mark.parametrize("shard_pairs", [align.SHARD_PAIRS, 40])
def test_align(docs, shard_pairs, monkeypatch):
    monkeypatch.setattr(align, "KEPT_BYTES", 6)
    got = sorted((tuple(r) for r in align.align(docs, shard_pairs=shard_pairs).collect()), key=str)
    assert got == plain_alignment(docs.collect())
    assert any(r[1] for r in got) and align.align(docs.limit(0)).count() == 0


def test_align_pieces_are_whole_texts(sf_dir, spark):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in align.align(table).collect()), key=str)
    assert got == plain_alignment(table.collect())


def plain_measures(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {p for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measures():
    rng = np.random.default_rng(2)
    texts = [t or "" for t in ODD] + ["a " * 8, "a " * 9, "a b\na b\n\n \na b #$", "x " * 400]
    texts += [" ".join(rng.choice(["a", "b", "é"], int(n))) for n in rng.integers(0, 60, 60)] + [" ".join(f"w{k % 31}" for k in range(5000))]
    for t in texts:
        assert host_rules.measures(t.encode()) == plain_measures(t), t


@pytest.mark.parametrize("broadcast", [host_rules.BROADCAST_HOSTS, 0])
def test_host_verdicts(spark, docs, broadcast, monkeypatch):
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", broadcast)
    good, bad = "a clean sentence with quite enough different words so that no rule of the first kind can ever say no to it at all", "too short"
    rows = [(k, good, "fine") for k in range(60)] + [(100 + k, bad if k % 10 else good, "spam") for k in range(100)] + [(300, bad, "small"), (301, good, "small"), (302, good, None), (303, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    measured = common.materialize(host_rules.measure(table), "measured")
    kept = {r["doc_id"]: r["kept"] for r in host_rules.judge(measured).collect()}
    assert len(kept) == len(rows) and all(kept[k] for k in range(60)) and not any(kept[k] for k in range(100, 200)) and not kept[300] and not kept[303]
    rates = {r["host"]: r for r in host_rules.host_rates(measured).collect()}
    assert rates["spam"]["failed"] / 100 > rates["spam"]["shrunk"] > 0.8 and 0 < rates["fine"]["shrunk"] < 0.1
    alone = common.materialize(host_rules.measure(table.where("source = 'fine'")), "measured")  # no variance at all
    assert [r["shrunk"] for r in host_rules.host_rates(alone).collect()] == [0.0]
    nothing = common.materialize(host_rules.measure(table.limit(0)), "measured")
    assert host_rules.judge(nothing).count() == 0


def test_range_shards_over_the_whole_range_of_ids(spark):
    step = (1 << 62) // 801
    rows = [(k * step + d, 10) for k in range(802) for d in ((0, -1) if k else (0,))]
    slim = common.materialize(spark.createDataFrame(rows, "doc_id long, w long"), "slim")
    for target in (500, 40):
        shards = common.range_shards(slim, "doc_id", "w", target)
        got = [(r["doc_id"], r["_shard"]) for r in shards.add(slim, "doc_id", slim.w * 0).collect()]
        assert [s for _, s in sorted(got)] == sorted(s for _, s in got) and max(s for _, s in got) > 10


def test_token_file_starts_on_widely_spread_ids(spark, monkeypatch):
    ids = [k * ((1 << 62) // 801) for k in range(802)]
    table = spark.createDataFrame([(i, "some words here " * (1 + k % 3)) for k, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    uri = common.scratch_dir(spark, "tokens")
    token_files.write(table, uri, shard_bytes=2000)
    got, at = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.read(spark, uri).collect()), 0
    assert len(got) == len(ids)
    for _, start, n in got:
        assert start == at
        at += n


def test_align_puts_pieces_together_from_known_parts(monkeypatch):
    known = align.Pieces(align.Tokenizers("byte_bpe_50k.json", "piece_bpe_32k.model"))
    asked, encode = [], known.of.encode
    monkeypatch.setattr(known.of, "encode", lambda pieces: asked.extend(pieces) or encode(pieces))
    known.learn({" river", " mill", " été"})
    texts = ["river,", "river.", "mill\nriver...", "été***\nÉté,", "the mill'"]
    pieces = [align.split(t) for t in texts]
    known.learn(set().union(*pieces))
    assert sorted(asked) == sorted([" river", " mill", " été", ",", ".", "\nriver", "...", "***", "\nÉté", " the", "'"])
    for t, parts in zip(texts, pieces, strict=True):
        (n_a,), (n_b,) = ([len(x) for x in ids] for ids in encode([" " + t]))
        assert divmod(sum(known.now[p][0] for p in parts), 1 << 40) == (n_a, n_b)
        assert "".join(known.now[p][1] for p in parts) == known.cut([" " + t])[0][1]
