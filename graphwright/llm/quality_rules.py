"""Operator 6: quality rules with host verdicts. DataFrame functions only.

Each document is measured once (the measures are written, texts are not moved). A host's rule
failures are counted: a document fails if it fails a base rule, or has too many symbols or doubled
lines. The host's failure rate is shrunk by a beta prior fitted to all hosts by moments. A host is
rejected, with all its documents, if its rate is surely far above that of the corpus: if the
posterior mean less SURE posterior deviations lies beyond FAR of the way from the corpus rate to
one. So hosts that are all alike are all accepted, whatever their common rate, and a host of few
documents is not judged by them alone. A document of an accepted host is rejected only if it fails
a base rule. The host of a document is its ``source``.

Defined results: null or empty text has no words and fails; a null source is one host; ties and
repeated rows are measured row by row; a very long text is one row's arrays of words and hashes; no
rows give no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, save, text_or_empty

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Rules that count against a host beside the base rules, in percent.
SYMBOL_PERCENT, DUP_LINE_PERCENT = 10, 30
#: A host's bound: how many posterior deviations, and how far from the corpus rate to one.
SURE, FAR = 2.0, 0.25
#: Rejected hosts that are broadcast at most (a few MB); more are joined by salted host.
BROADCAST_HOSTS, SALTS = 100_000, 32


def _marked() -> Column:
    """Places, in order, of the windows found twice: equal neighbours among the sorted (hash, place)."""
    n = F.size("q_sorted")

    def same(i: Column, j: Column) -> Column:
        return F.get(F.col("q_sorted"), i)["h"] == F.coalesce(F.get(F.col("q_sorted"), j)["h"], F.bitwise_not(F.get(F.col("q_sorted"), i)["h"]))

    return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: same(i, i + 1) | same(i, i - 1)), lambda i: F.get(F.col("q_sorted"), i)["p"]))


def measures(docs: DataFrame) -> DataFrame:
    """docs' columns in struct q_row without text, and the six measures of every row."""
    t = text_or_empty()
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    rows = docs.select(F.struct(*keep).alias("q_row"), t.alias("q_text"))
    bare = F.translate("q_text", SPACES, "")
    lines = F.filter(F.split("q_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    rows = rows.select(
        "q_row", F.char_length(bare).cast("long").alias("word_chars"), (F.char_length("q_text") - F.char_length(F.translate("q_text", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("q_lines"),
        F.filter(F.split(F.translate("q_text", SPACES, " " * len(SPACES)), " +", -1), lambda w: w != "").alias("q_words"),
    )
    rows = rows.select("*", F.size("q_lines").cast("long").alias("n_lines"), (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"), F.size("q_words").cast("long").alias("n_words")).drop("q_lines")
    windows = F.transform(F.sequence(F.lit(0), F.size("q_words") - 3), lambda i: F.xxhash64(F.get("q_words", i), F.get("q_words", i + 1), F.get("q_words", i + 2)))
    rows = rows.withColumn("q_hashes", F.when(F.size("q_words") >= 4, windows)).drop("q_words")
    rows = rows.withColumn("q_sorted", F.when(F.size(F.array_distinct("q_hashes")) < F.size("q_hashes"), F.sort_array(F.transform("q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))).drop("q_hashes")
    rows = rows.withColumn("q_marks", F.when(F.col("q_sorted").isNotNull(), _marked())).drop("q_sorted")
    gaps = F.zip_with("q_marks", F.slice("q_marks", F.lit(2), F.size("q_marks")), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.when(F.col("q_marks").isNotNull(), F.aggregate(gaps, F.lit(0), lambda s, g: s + g)).otherwise(0)
    rows = rows.withColumn("n_repeat_words", covered.cast("long")).drop("q_marks")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars")
    doubled = 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines")
    return rows.withColumn("base_failed", base).withColumn("failed", base | symbols | doubled)


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, failures, rate, rejected): rates shrunk to a beta prior whose two moments are those
    of the hosts' rates, weighted by documents. The prior is one row, read as scalar subqueries."""
    hosts = rows.groupBy(F.col("q_row.source").alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    r = F.col("failures") / F.col("n")
    mean = F.sum("failures") / F.sum("n")
    moments = hosts.agg(mean.alias("mean"), (F.sum(F.col("n") * r * r) / F.sum("n") - mean * mean).alias("var"), (F.sum("n") / F.count("*")).alias("size"))
    between = F.greatest(F.col("var") - F.col("mean") * (1 - F.col("mean")) / F.col("size"), F.lit(1e-6))  # without sampling noise
    strength = F.greatest(F.col("mean") * (1 - F.col("mean")) / between - 1, F.lit(1e-3))
    prior = moments.select("mean", strength.alias("strength"))
    mean, total = prior.select("mean").scalar(), prior.select("strength").scalar()
    hosts = hosts.withColumn("rate", (F.col("failures") + mean * total) / (F.col("n") + total))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + total + 1))
    return hosts.withColumn("rejected", F.col("rate") - SURE * deviation > mean + FAR * (1 - mean))


def judge(docs: DataFrame) -> DataFrame:
    """measures() plus kept."""
    rows = save(measures(docs), "quality")
    bad = save(host_rates(rows).where("rejected").select("host", F.lit(True).alias("host_bad")), "hosts")
    same = F.col("q_row.source").eqNullSafe(F.col("host"))
    if bad.count() <= BROADCAST_HOSTS:  # rows, which may carry texts, stay where they are
        rows = rows.join(F.broadcast(bad), same, "left")
    else:
        rows = rows.withColumn("q_salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)).cast("int"))
        bad = bad.withColumn("q_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(bad, same & (F.col("q_salt") == F.col("q_copy")), "left").drop("q_salt", "q_copy")
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("host_bad").isNull()).drop("host", "host_bad")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs).select("q_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
m as (select *, regexp_extract_all(text, '{WORD}') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from d),
w as (select r, unnest(words) as w1, unnest(range(len(words))) as p, len(words) as n from m),
g as (select r, p, w1, lead(w1) over o as w2, lead(w1, 2) over o as w3, n from w window o as (partition by r order by p)),
f as (select r, p, p < n - 2 and count(*) over (partition by r, w1, w2, w3) >= 2 as twice from g),
t as (select r, count(*) filter (where near) as n_repeat_words from (select r, bool_or(twice) over (partition by r order by p rows between 2 preceding and current row) as near from f) group by r),
a as (select m.r, doc_id, source, len(words)::bigint as n_words, coalesce(length(array_to_string(words, '')), 0)::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines) as n_lines,
             (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from m left join t on m.r = t.r),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed, 100 * n_symbols > {SYMBOL_PERCENT} * word_chars as symbols_failed,
             100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines as lines_failed from a),
h as (select source, count(*)::double as n, (count(*) filter (where base_failed or symbols_failed or lines_failed))::double as k from b group by source),
p as (select sum(k) / sum(n) as mean, sum(n * (k / n) * (k / n)) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) as v, sum(n) / count(*) as size from h),
q as (select mean, greatest(mean * (1 - mean) / greatest(v - mean * (1 - mean) / size, 1e-6) - 1, 1e-3) as strength from p),
s as (select source, mean, strength, n, (k + mean * strength) / (n + strength) as rate from h, q),
bad as (select source from s where rate - {SURE} * sqrt(rate * (1 - rate) / (n + strength + 1)) > mean + {FAR} * (1 - mean))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not exists (select 1 from bad where bad.source is not distinct from b.source) as kept from b
"""
