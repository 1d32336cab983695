"""Quality rules: counts and base rules of each text, failures by host, and host verdicts from shrunken rates.

The base rules fail a text of under 50 words, or with over half of its words in 3-word windows that occur again. A host's
rate of failures is shrunk by a beta prior, whose moments are those of the hosts' rates, weighted by size and without the noise of
small hosts; a host over ``HOST_RATE`` fails, and its texts with it. Hosts are sums with partial aggregation; the join back has one row a host, so a hot host is split as
any skewed join side. The counts of each text are made once and written to the shared folder.

Only DataFrame functions are used. Defined results: null text has no words; null and empty hosts are one host; repeated
rows count and come out as often as they go in; an empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

MIN_WORDS, HOST_RATE = 50, 0.5
WHITE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(placed: Column) -> Column:
            again = F.filter(placed, lambda x, j: F.get(placed, j - 1)["h"].eqNullSafe(x["h"]) | F.get(placed, j + 1)["h"].eqNullSafe(x["h"]))
            at = F.array_sort(F.transform(again, lambda x: x["i"]))
            # each window adds its three words, less those that the next one has too
            return _let(at, lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(placed, of))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, covered))


def text_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, WHITE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    rows = docs.select(
        "doc_id", F.coalesce(host, F.lit("")).alias("host"), counts.alias("c"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    counted = rows.select("doc_id", "host", *(F.col(f"c.{c}").cast("long").alias(c) for c in ("n_words", "word_chars")), "n_symbols", "n_dup_lines", F.col("c.n_repeat_words").cast("long").alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(counts: DataFrame, most: float = HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, shrunken rate and host_failed."""
    hosts = counts.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    square = F.col("n_failed") * F.col("n_failed") / F.col("n_docs")
    k, n, f, nn, q = hosts.agg(F.count("*"), F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_docs") * F.col("n_docs")), F.sum(square)).first()
    mean, alike = beta_moments(k, n or 0, f or 0, nn or 0, q or 0.0)
    shrunk = (alike * F.col("n_failed") + (1 - alike) * mean) / (alike * F.col("n_docs") + (1 - alike))
    return hosts.withColumn("rate", shrunk).withColumn("host_failed", F.col("rate") > most)


def beta_moments(k: int, n: int, f: int, nn: int, q: float) -> tuple[float, float]:
    """Mean of the beta prior, and how alike documents of one host are (0 to 1), 1 / (1 + the prior's strength).

    Of k hosts with n documents, f failures; nn: the sum of squared host sizes, q: of n_failed**2 / n_docs. The variance of rates
    between hosts, weighted by their sizes, less what chance inside of hosts makes of it (analysis of variance). Where hosts
    differ no more than by chance, or none has two documents, documents of a host are not alike: all rates are the mean.
    """
    if not n:
        return 0.0, 0.0
    mean = f / n
    if k < 2 or n == k:
        return mean, 0.0
    between, within = (q - f * f / n) / (k - 1), (f - q) / (n - k)
    size = (n - nn / n) / (k - 1)
    whole = between + (size - 1) * within
    return mean, min(1.0, max(0.0, (between - within) / whole)) if whole > 0 else 0.0


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The counts of each text, host_failed and kept."""
    counts = stage(text_counts(docs, host), "counts")
    verdicts = host_verdicts(counts).select("host", "host_failed")
    return counts.join(verdicts, "host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("host")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS k FROM (SELECT r, regexp_split_to_array(text, '[\x20\x09-\x0D]+') AS words FROM d)),
w AS (SELECT r, word, row_number() OVER (PARTITION BY r ORDER BY k) AS i FROM split WHERE word <> ''),
t AS (SELECT r, i, word, lead(word, 1) OVER p AS w1, lead(word, 2) OVER p AS w2 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w1, w2) AS n FROM t WHERE w2 IS NOT NULL),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
words AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY r),
lines AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (
  SELECT doc_id, host, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
hosts AS (SELECT host, count(*) AS n, sum(base_failed::BIGINT) AS f FROM base GROUP BY host),
sums AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS q FROM hosts),
moments AS (SELECT f / n AS m, k, n, (q - f * f / n) / nullif(k - 1, 0) AS b, (f - q) / nullif(n - k, 0) AS w, (n - nn / n) / nullif(k - 1, 0) AS size FROM sums),
prior AS (SELECT m, CASE WHEN b + (size - 1) * w > 0 THEN least(1.0, greatest(0.0, (b - w) / (b + (size - 1) * w))) ELSE 0.0 END AS a FROM moments),
verdicts AS (SELECT host, (a * f + (1 - a) * m) / (a * n + (1 - a)) > 0.5 AS host_failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept
FROM base JOIN verdicts USING (host)
"""
