"""Quality rules with a verdict for each host.

Every document is measured by itself first (:func:`measure`): words, symbols, repeated lines, words in repeated
windows, and whether it fails the base rules.  Then the failures are summed by host, and each host's failure rate is
shrunk by a beta prior that is fitted to the rates of all hosts by their moments.  Documents of a host whose shrunk
rate is above ``most_failed`` go, also those that pass by themselves; documents that fail by themselves always go.

Sums by host are partial aggregates, so a hot host costs a row for each task.  The table of hosts may be as long as
the web: Spark broadcasts it below BROADCAST_HOSTS counted hosts, else both sides are shuffled, and the documents'
side is salted, so a host with a third of all rows fills no task.

Defined results: null and empty texts have no words and fail; a null host is a host of its own; repeated rows count
each; other columns are ignored; no rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import common

#: Base rules: fewest words, words of a repeated window, most per cent of words in such windows.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: A host whose shrunk failure rate is above this is rejected.
MOST_FAILED = 0.5
#: The prior weighs as much as so many documents at least, so a host of one document is never judged by that alone.
LEAST_WEIGHT = 2.0
#: Hosts of up to so many rows are broadcast (a name and a rate each); beyond, documents are salted by SALTS.
BROADCAST_HOSTS, SALTS = 200_000, 32

_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_COUNTED = _WHITE + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a character
_SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of ``size`` words that are found twice or more, the first place included.

    Windows are named exactly: a name of 2k words is that of its two halves, and the last step overlaps.
    """
    if len(words) <= size:
        return 0
    known: dict[bytes, int] = {}
    names = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    width = 1
    while width < size:
        step = min(width, size - width)
        pairs = names[: len(names) - step] * np.int64(len(words)) + names[step:]
        order = np.argsort(pairs, kind="stable")
        first = np.append(True, pairs[order][1:] != pairs[order][:-1])
        names = np.empty(len(pairs), np.int64)
        names[order] = np.cumsum(first) - 1
        width += step
    hits = np.flatnonzero(np.bincount(names)[names] > 1)
    if not len(hits):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def measures(text: bytes, window: int = WINDOW) -> tuple[int, int, int, int, int]:
    """The five MEASURES of a text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words, window)


def measure(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, window: int = WINDOW) -> DataFrame:
    """``key``, ``host``, the MEASURES of each row's whole text, and ``base_failed``."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text"):
            found = np.array([measures(t, window) for t in common.text_bytes(batch, "text")], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=[key, "host", *(m.split()[0] for m in MEASURES.split(", "))])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"`{key}` {kind}, host string, {MEASURES}")
    return out.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n, failed, alpha, beta, shrunk: each host's failures, and its rate under the prior of all hosts.

    The prior's mean is that of all documents.  Its weight, alpha + beta, comes from the variance of the hosts' rates
    beyond what drawing alone explains, each host counted by its documents; where there is no such variance, all hosts
    get the common rate.  Its weight is LEAST_WEIGHT at least.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("base_failed"), 1)).alias("failed"))
    hosts = common.materialize(hosts, "hosts")
    rate = F.col("failed") / F.col("n")
    whole = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), (F.sum("failed") / F.sum("n")).alias("m"))
    spread = hosts.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * (rate - F.col("m")) * (rate - F.col("m"))).alias("s"))
    within = F.col("m") * (1 - F.col("m"))
    # E[s] = within * ((k - 1) * (1 - r) + r * (N - squares / N)), where r = 1 / (alpha + beta + 1)
    r = (F.col("s") / within - (F.col("k") - 1)) / (F.col("total") - F.col("squares") / F.col("total") - (F.col("k") - 1))
    prior = whole.crossJoin(F.broadcast(spread)).select("m", F.when((within > 0) & (F.col("k") > 1), F.least(F.lit(1 / (1 + LEAST_WEIGHT)), r)).alias("r"))
    out = hosts.crossJoin(F.broadcast(prior))  # one row
    weight = F.when(F.col("r") > 0, 1 / F.col("r") - 1)
    out = out.withColumns({"alpha": F.col("m") * weight, "beta": (1 - F.col("m")) * weight})
    shrunk = F.when(weight.isNull(), F.col("m")).otherwise((F.col("failed") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta")))
    return out.withColumn("shrunk", shrunk).select("host", "n", "failed", "alpha", "beta", "shrunk")


def judge(measured: DataFrame, most_failed: float = MOST_FAILED) -> DataFrame:
    """A written table of :func:`measure` with ``kept``: false for failed documents, else the verdict on their host."""
    rates = common.materialize(host_rates(measured).select(F.col("host").alias("_host"), (F.col("shrunk") <= most_failed).alias("_good")), "rates")
    if rates.count() <= BROADCAST_HOSTS:
        met = measured.join(F.broadcast(rates), F.col("host").eqNullSafe(F.col("_host")), "left")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = measured.withColumn("_salt", (F.rand() * SALTS).cast("int")).join(rates.withColumn("_s", salt), F.col("host").eqNullSafe(F.col("_host")) & (F.col("_salt") == F.col("_s")), "left").drop("_salt", "_s")
    return met.withColumn("kept", ~F.col("base_failed") & F.col("_good")).drop("_host", "_good")


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every whole text of ``documents``, and whether it is kept; its source is its host."""
    measured = common.materialize(measure(spark.read.parquet(f"{sf_dir}/documents.parquet")), "measured")
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT k, doc_id, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
spans AS (SELECT k, i, hash(w[i:i + 7]) AS h, w[i:i + 7] AS g FROM words, unnest(range(1, len(w) - 6)) AS t(i) WHERE len(w) >= 8),
twice AS (SELECT k, g FROM spans GROUP BY k, g HAVING count(*) > 1),
covered AS (SELECT DISTINCT s.k, u.p FROM spans s JOIN twice t ON s.k = t.k AND s.g = t.g, unnest(range(s.i, s.i + 8)) AS u(p)),
repeats AS (SELECT k, count(*) AS c FROM covered GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT l) AS c FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT k, doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.c, 0) AS n_dup_lines, coalesce(r.c, 0) AS n_repeat_words
  FROM words LEFT JOIN lines l USING (k) LEFT JOIN repeats r USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f FROM b GROUP BY source),
t AS (SELECT count(*) AS k, sum(n) AS total, sum(n * n) AS sq, sum(f) / sum(n) AS m FROM h),
v AS (SELECT t.*, (SELECT sum(h.n * (h.f / h.n - t.m) ** 2) FROM h) AS s FROM t),
p AS (SELECT m, CASE WHEN m * (1 - m) > 0 AND k > 1 THEN least(1.0 / 3.0, (s / (m * (1 - m)) - (k - 1)) / (total - sq / total - (k - 1))) END AS r FROM v),
good AS (SELECT source, CASE WHEN r > 0 THEN (f + m * (1 / r - 1)) / (n + 1 / r - 1) ELSE m END <= 0.5 AS ok FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM b JOIN good g ON b.source IS NOT DISTINCT FROM g.source
"""
