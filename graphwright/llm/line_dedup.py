"""Operator 2: line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of (line hash, first document) sorted by hash. Documents come in batches of
rising doc_id; the distinct line hashes of a batch are merge-anti-joined with the runs and what
remains is written as a new run of level 0. ``fanout`` runs of a level are merged into one run of
the next level. A line stays iff the run of its own batch names its document as the first one, so
the second anti-join is keyed by hash and document together and no common line is a hot key.

Hashes are two 64-bit values with independent seeds, 128 bits in all.

Defined results: a null or empty text is one empty line; a key shorter than ``least`` code points
never drops; rows that share a doc_id are one document for the decisions; a null doc_id is one
document, after all others; no rows give no rows; other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, delete, save, scratch, text_or_empty

#: Stands for a null doc_id, after every other.
LAST_ID = 2**63 - 1


class LineRuns:
    """The levelled runs. State is a list of paths a level; each path is one sorted run."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, first long").parquet(path)

    def _write(self, rows: DataFrame) -> str:
        path = scratch(self.spark, "run")
        rows.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def add(self, lines: DataFrame) -> DataFrame:
        """lines (h1, h2, doc) of the next batch; returns the run it left: hash and first document."""
        new = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"))
        known = [self._read(p) for level in self.levels for p in level]
        if known:
            runs = known[0]
            for run in known[1:]:
                runs = runs.unionAll(run)
            new = new.join(runs.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        path = self._write(new)
        self.levels[0].append(path)
        return self._read(path)

    def compact(self) -> None:
        """Merges every level that holds ``fanout`` runs into one run of the next level. The merged
        runs are only deleted after the new one is complete."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                rows = self._read(self.levels[k][0])
                for path in self.levels[k][1:]:
                    rows = rows.unionAll(self._read(path))
                merged = self._write(rows.repartition("h1", "h2"))
                old, self.levels[k] = self.levels[k], []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)
                for path in old:
                    delete(self.spark, path)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def doc_order() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def dropped_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc, text_hash, gone): per document the places of the lines that go."""
    spark = docs.sparkSession
    rows = docs.select(doc_order().alias("doc"), text_or_empty().alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least)
    lines = save(rows.select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")), "lines")
    cuts = lines.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    runs, gone = LineRuns(spark, fanout), None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("doc") > low)
        if high is not None:
            batch = batch.where(F.col("doc") <= high)
        run = runs.add(batch.select("h1", "h2", "doc"))
        held = run.select("h1", "h2", F.col("first").alias("doc"))
        out = save(batch.join(held, ["h1", "h2", "doc"], "left_anti").select("doc", "text_hash", "pos"), "gone")
        gone = out if gone is None else gone.unionAll(out)
        runs.compact()
    return gone.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """All columns of docs, with text reduced to the lines that stay, plus n_lines and n_dropped."""
    gone = dropped_lines(docs, least, batches, fanout)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("l_row"), doc_order().alias("l_doc"), F.xxhash64(text_or_empty()).alias("l_hash"))
    rows = rows.join(gone, (F.col("l_doc") == F.col("doc")) & (F.col("l_hash") == F.col("text_hash")), "left")
    rows = rows.select("l_row", "gone", F.split(F.coalesce("l_row.text", F.lit("")), "\n", -1).alias("l_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("l_lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.coalesce("l_row.text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("l_lines"), i)), "\n"))
    others = [F.col(f"l_row.`{c}`") for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    return rows.select(*others, text.alias("text"), F.size("l_lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: per document the lines before, the lines dropped and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with l as (select coalesce(doc_id, 9223372036854775807) as doc, doc_id, row_id, unnest(parts) as line, unnest(range(len(parts))) as pos
           from (select doc_id, row_number() over () as row_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, min(doc) as first from k where length(key) >= 10 group by key),
m as (select k.*, f.first is not null and f.first < k.doc as gone from k left join f on k.key = f.key)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by row_id
"""
