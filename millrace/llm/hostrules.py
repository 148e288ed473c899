"""Quality rules of documents and of the hosts that they come from. DataFrame operations only.

Each text is measured and fails or passes the base rules. Failures are counted per host; the hosts'
failure rates are shrunk towards a beta prior fitted to all hosts by moments, so that a host with few
documents isn't judged by chance; a host whose shrunk rate is above a limit is rejected, and with it
its documents.

Nulls: a null text has no words and fails; documents of a null host form a host of their own; a null
doc_id stays. Repeated rows are judged each by itself and all count for their host. Empty tables give
empty results. Columns of the input that are named like a measure are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import NOT_SPACE, SPACE, join_small, stored, table, words

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host is rejected if its shrunk failure rate is above this.
MAX_RATE = 0.5


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash comes twice or more. The windows are sorted by hash, those with an
    equal neighbour give their starts, and the lengths that sorted starts add are summed."""

    def repeated(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["at"])

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    starts = F.sort_array(F.transform(F.array(ordered), repeated)[0])
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["total"] + x + WINDOW - F.greatest(a["end"], x)).alias("total"), (x + WINDOW).alias("end")),
        lambda a: a["total"].cast("long"),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES and base_failed added."""
    own = [F.col(c) for c in docs.columns if c not in (*MEASURES, "base_failed")]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE))
    first = docs.select(
        *own,
        words(F.col(text)).alias("__words"),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    w = F.col("__words")
    hashes = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    second = first.withColumn("n_words", F.size(w).cast("long")).withColumn("__hashes", hashes).drop("__words")
    h = F.col("__hashes")
    third = second.withColumn("n_repeat_words", F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h))).drop("__hashes")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return third.withColumn("base_failed", failed)


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """Per host: documents, failures and the shrunk rate of failures, as a stored table."""
    hosts = stored(
        judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")),
        "hosts",
    )
    rate = F.col("n_failed") / F.col("n_docs")
    mean, spread, n = hosts.agg(F.avg(rate), F.var_samp(rate), F.count(F.lit(1))).first()  # one row
    # Moments of a beta distribution; without spread between hosts, a prior of one document.
    strength = max(1.0, mean * (1 - mean) / spread - 1) if n > 1 and spread else 1.0
    a = (mean or 0.0) * strength
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(strength)))


def judged(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """``docs`` with MEASURES, base_failed and kept. Every text is measured once, then stored."""
    measures = stored(measured(docs, text), "measured")
    bad = host_rates(measures, host).filter(F.col("rate") > max_rate).select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    with_host = join_small(measures, bad, F.col(host).eqNullSafe(F.col("__host")), "left", bad.count())
    return with_host.withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__host", "__bad")


def op8_hostrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # The text itself is not needed beside its measures.
    measures = stored(measured(docs).drop("text"), "measured")
    bad = host_rates(measures).filter(F.col("rate") > MAX_RATE).select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    out = join_small(measures, bad, F.col("source").eqNullSafe(F.col("__host")), "left", bad.count())
    return out.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.col("__bad").isNull()).alias("kept"))


QUERIES = {"op8_hostrules": op8_hostrules}
ORACLE = {
    "op8_hostrules": r"""
WITH cut AS (
    SELECT doc_id, source, coalesce(text, '') AS body,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
windows AS (
    SELECT d.doc_id, unnest(range(1, len(w) - 3)) AS pos, w FROM cut d WHERE len(w) >= 5),
grams AS (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ')) AS times FROM windows),
covered AS (
    SELECT doc_id, count(DISTINCT pos + k) AS n FROM grams, range(0, 5) r(k) WHERE times > 1 GROUP BY doc_id),
m AS (
    SELECT cut.doc_id, source, len(w)::BIGINT AS n_words,
        length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM cut LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source AS host, count(*) AS n, sum(base_failed::INT) AS bad FROM f GROUP BY source),
p AS (SELECT avg(bad / n) AS mean, var_samp(bad / n) AS spread FROM h),
s AS (SELECT mean, CASE WHEN spread > 0 THEN greatest(1.0, mean * (1 - mean) / spread - 1) ELSE 1.0 END AS strength FROM p),
v AS (SELECT host, (bad + mean * strength) / (n + strength) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.host"""
}
