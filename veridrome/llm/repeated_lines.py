"""Lines repeated across one source's documents (problem 5).

A pass over the texts turns every document into the 128-bit keys of its lines.
From there on only keys are read.  Batches of documents (new partitions) are
merged one after the other into a state of three tables: in how many distinct
documents of a source a line stands, with the number of its documents as the count
of no line; which documents were seen; and which lines are excessive at present.  Merging a batch
gives the lines whose standing changed; both ways count, for a line may also
fall under the share again as its source grows.  Only documents that hold such
a line, and the new ones, are rebuilt, each against all lines that are excessive
at that time.

The tables are written after every batch (see :class:`LineStore`), so a run
reads what the last one left and never counts the history again.

Rows delivered several times under one id count once; versions of one id with
different contents are one document that holds the lines of all of them.  Null
and empty contents count as documents without lines; blank lines are numbered
but never counted.  Null ids and documents without a source are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridrome.functions.keys import id_key, line_key
from veridrome.operators.skew import broadcast_if_small, salted_join
from veridrome.session import materialise, work_folder

MIN_DOCS, MIN_SHARE = 3, 0.08
KEY = "struct<a:bigint,b:bigint>"


def line_hashes(content: Column) -> Column:
    """The keys of a text's lines in order; null for blank lines, an empty array for null."""
    # two steps, so that the key of a line is made once
    keyed = F.transform(F.split(content, "\n", -1), line_key)
    hashed = F.transform(keyed, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.concat(F.lit("\u0001"), k)).alias("b"))))
    return F.coalesce(hashed, F.array().cast(f"array<{KEY}>"))


def hashed_documents(docs: DataFrame, *extra: str) -> DataFrame:
    """(source, id, content) as (source, id, hs): one row for each distinct version, with its line keys.

    ``extra`` columns stay.  Texts are read once and not shuffled.
    """
    slim = docs.where(F.col("source").isNotNull() & F.col("id").isNotNull())
    return slim.select("source", "id", *extra, line_hashes(F.col("content")).alias("hs")).distinct()


@dataclass
class LineState:
    """``counts`` (source, h, n), where a null ``h`` counts documents; ``ids`` (source, id) seen; ``standing`` (source, h) excessive now."""

    counts: DataFrame
    ids: DataFrame | None
    standing: DataFrame | None = None


def line_delta(hashed: DataFrame) -> DataFrame:
    """The counts of one batch of :func:`hashed_documents`: (source, h, n).

    Counts are combined before they are shuffled; a line that stands twice in a
    document, or in two versions of it, counts once.
    """
    one = hashed.groupBy("source", "id").agg(F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs"))
    # blank lines have no key either; the document itself takes the place of all of them
    keys = F.concat(F.array(F.lit(None).cast(KEY)), F.filter("hs", lambda h: h.isNotNull()))
    return one.select("source", F.explode(keys).alias("h")).groupBy("source", "h").agg(F.count(F.lit(1)).alias("n"))


def merge(counts: DataFrame | None, delta: DataFrame) -> DataFrame:
    """Counts after a delta whose ids the state has not seen."""
    return delta if counts is None else counts.unionByName(delta).groupBy("source", "h").agg(F.sum("n").alias("n"))


def excessive(counts: DataFrame, touched: DataFrame | None = None, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """Lines over the threshold, of the ``touched`` sources (source; default: all): (source, h).

    A source has at most 1 / ``min_share`` times the mean lines of a document
    of them, however many documents it has.
    """
    totals = counts.where("h is null").select("source", F.col("n").alias("total"))
    if touched is not None:
        totals = totals.join(touched, "source", "left_semi")
    often = counts.where((F.col("n") >= min_docs) & F.col("h").isNotNull())
    per_mille = round(min_share * 1000)  # integers keep the border exact
    kept = salted_join(often, totals, ["source"], "inner", spread=F.col("h.a"))
    return kept.where(F.col("n") * 1000 >= F.col("total") * per_mille).select("source", "h")


def standing(before: LineState | None, counts: DataFrame, touched: DataFrame, **kw) -> DataFrame:
    """Lines that are excessive after a delta: (source, h).

    Only the sources that the delta touched are judged again; the others keep
    what they had.
    """
    now = excessive(counts, touched, **kw)
    return now if before is None else now.unionByName(before.standing.join(touched, "source", "left_anti"))


def crossings(before: LineState | None, after: LineState) -> DataFrame:
    """Lines whose standing changed: (source, h, excessive)."""
    if before is None:
        return after.standing.withColumn("excessive", F.lit(True))
    then, now = before.standing.withColumn("then", F.lit(True)), after.standing.withColumn("now", F.lit(True))
    both = then.join(now, ["source", "h"], "full_outer")
    return both.where("now is null or then is null").select("source", "h", F.col("now").isNotNull().alias("excessive"))


class LineStore:
    """The state's tables in a folder: counts and standing of every version, and the ids of every batch."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or work_folder(spark, "repeated-lines")

    def _at(self, version: int, part: str) -> str:
        return f"{self.folder}/v{version}/{part}"

    def load(self, version: int) -> LineState | None:
        """The state after ``version`` batches; none at 0."""
        if not version:
            return None
        read = self.spark.read.parquet
        return LineState(read(self._at(version, "counts")), read(*(self._at(v, "ids") for v in range(1, version + 1))), read(self._at(version, "standing")))

    def advance(self, version: int, hashed: DataFrame, **kw) -> tuple[LineState, DataFrame]:
        """Merge one batch into a version; gives the new state and the crossings, both read from what was written.

        Documents that the state has seen are left out.
        """
        before = self.load(version)
        write = lambda df, part: materialise(df, self._at(version + 1, part))
        fresh = hashed if before is None else hashed.join(before.ids, ["source", "id"], "left_anti")
        write(fresh.select("source", "id").distinct(), "ids")
        delta = write(line_delta(fresh), "delta")
        counts = write(merge(before and before.counts, delta), "counts")
        state = LineState(counts, None, write(standing(before, counts, delta.where("h is null").select("source"), **kw), "standing"))
        state.ids = self.load(version + 1).ids
        return state, crossings(before, state)


def holding(hashed: DataFrame, lines: DataFrame) -> DataFrame:
    """Where the given lines (source, h) stand: distinct (id, line_no).

    The line table is broadcast when a count proves it small, else the join is
    salted: one line may stand in a third of all documents.
    """
    few, small = broadcast_if_small(lines.select("source", F.col("h.a").alias("ha"), F.col("h.b").alias("hb")), 64)
    spots = hashed.select("source", "id", F.posexplode("hs").alias("pos", "h")).where("h is not null")
    spots = spots.select("source", "id", (F.col("pos") + 1).alias("line_no"), F.col("h.a").alias("ha"), F.col("h.b").alias("hb"))
    keys = ["source", "ha", "hb"]
    hits = spots.join(few, keys, "left_semi") if small else salted_join(spots, few, keys, "left_semi", spread=F.xxhash64("id"))
    return hits.select("id", "line_no").distinct()


def to_rebuild(batch: DataFrame, known: DataFrame, state: LineState, crossed: DataFrame) -> DataFrame:
    """Ids of the documents that a batch changes: distinct (id).

    New documents (``batch``) with a line that is excessive now, and documents
    of earlier batches (``known``) with a line that crossed either way.  Both are
    :func:`hashed_documents`.
    """
    return holding(batch, state.standing).select("id").union(holding(known, crossed).select("id")).distinct()


def without_lines(docs: DataFrame, spots: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rebuild documents without their spots: distinct (id, content).

    ``ids`` names the documents to rebuild (default: those with a spot); one
    without a spot comes out as it was.  Null contents stay null.
    """
    drop = spots.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    if ids is not None:
        drop = ids.join(drop, "id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    hit = docs.select("id", "content").join(drop, "id")
    kept = F.filter(F.split("content", "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i + 1))
    return hit.select("id", F.array_join(kept, "\n").alias("content")).distinct()


def source_documents(updates: DataFrame, sources: DataFrame, *extra: str) -> DataFrame:
    """Updates whose source is registered under any period: (source, id, content) and ``extra`` columns."""
    known = sources.select(id_key(F.col("id")).alias("source")).where("source is not null").distinct()
    docs = updates.where(F.col("source_id").isNotNull()).select(id_key(F.col("source_id")).alias("source"), "id", "content", *extra).where("source is not null")
    few, small = broadcast_if_small(known, 64)
    return docs.join(few, "source", "left_semi") if small else salted_join(docs, few, ["source"], "left_semi", spread=F.xxhash64("id"))


def time_cuts(rows: DataFrame, column: str, batches: int) -> list:
    """Times that part the rows into so many batches of about equal size (approximate quantiles of one column)."""
    marks = [i / batches for i in range(1, batches)]
    found = rows.select(F.percentile_approx(column, [float(m) for m in marks], 1000).alias("q")).first().q
    return sorted(set(found or []))


def batch_number(column: str, cuts: list) -> Column:
    """The batch of a row: how many cuts lie before its time; 0 for rows without one."""
    n = F.lit(0)
    for c in cuts:
        n = n + F.coalesce((F.col(column) > F.lit(c)).cast("int"), F.lit(0))
    return n


def run_batches(spark: SparkSession, docs: DataFrame, at: str, batches: int) -> tuple[DataFrame, LineState]:
    """Feed (source, id, content, ``at``) in batches of time through a new store.

    Gives the hashed documents and the state after the last batch.  An id that
    is delivered again in a later batch counts in its first one.
    """
    store = LineStore(spark)
    cuts = time_cuts(docs, at, batches)
    hashed = hashed_documents(docs.withColumn("batch", batch_number(at, cuts)), "batch")
    folder = f"{store.folder}/documents"
    hashed.write.partitionBy("batch").parquet(folder)
    hashed = spark.read.schema(hashed.schema).parquet(folder)
    state = None
    for k in range(len(cuts) + 1):
        state, _ = store.advance(k, hashed.where(F.col("batch") == k))
    return hashed, state
