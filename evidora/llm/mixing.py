"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral is the source's share of all words (no source more
than `most` times its own words; what is over goes to the others by weight). A source's words are taken in one fixed random
order, again and again until the target is met. A word taken when `c` words of the source have been taken stands at the
training time at which the source's cumulative demand, the integrated schedule, reaches `c`: the inverse of a piecewise
quadratic. Documents are then range-sorted by that position.

Cumulative sizes come from two levels: sums of the buckets of a source, added up over a fixed number of buckets, and a
running sum inside each bucket; a source with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.llm import text as tx
from evidora.llm.components import stored

#: A source is repeated at most so often.
MOST = 3
#: Leading hexadecimal digits of a document's order key that make its bucket: 4,096 buckets for each source.
BUCKET_DIGITS = 3
#: A mix has a schedule for each source, which its author wrote; more distinct sources than this are refused.
MOST_SOURCES = 1_000_000

Schedule = list[tuple[float, float]]  # (time, weight): times rise from 0 to 1, weights are linear in between

#: Schedules of the registered query by the rank of the source, repeating: areas 1, 2 and 3, early, even and late.
EARLY: Schedule = [(0.0, 1.5), (1.0, 0.5)]
EVEN: Schedule = [(0.0, 2.0), (1.0, 2.0)]
LATE: Schedule = [(0.0, 1.5), (0.5, 3.0), (1.0, 4.5)]


def ranked_schedules(sources: list[str | None]) -> dict[str | None, Schedule]:
    """Sources by code point, null last, with the three schedules in turn."""
    ordered = sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]
    return {s: (EARLY, EVEN, LATE)[i % 3] for i, s in enumerate(ordered)}


def area(schedule: Schedule) -> float:
    return sum((t2 - t1) * (a + b) / 2 for (t1, a), (t2, b) in zip(schedule, schedule[1:], strict=False))


def _segments(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(share of the demand before it, time, weight, slope) of each segment with some demand; shares and weights over the area."""
    whole, before, out = area(schedule), 0.0, []
    for (t1, a), (t2, b) in zip(schedule, schedule[1:], strict=False):
        part = (t2 - t1) * (a + b) / 2 / whole
        if part > 0:
            out.append((before, t1, a / whole, (b - a) / (t2 - t1) / whole))
        before += part
    return out


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = MOST) -> dict[str | None, float]:
    """Words to take from each source: shares of all words by weight, at most `most` times its own."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if total <= 0 or left * weights[s] / total > most * sizes[s]]
        for s in over or open_:
            out[s] = float(most * sizes[s]) if over and total > 0 else left * weights[s] / total if total > 0 else 0.0
        open_ -= set(over or open_)
        left -= sum(out[s] for s in over)
    return out


def assigned(
    docs: DataFrame,
    schedules=ranked_schedules,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most: float = MOST,
) -> DataFrame:
    """One row per document: `doc_id`, `copy` (hash of the text), `source`, `size`, `source_size`, `target`, `before`
    (words of its source ahead of it), `segments` of its source's schedule.

    `schedules` gives a schedule for each of the list of sources. Null texts have size 0; a null source is a source of its
    own. Rows with the same id and text are taken one after the other. An empty table gives an empty result. Other columns
    are not looked at.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    narrow, _ = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.xxhash64(text).alias("copy"),
            F.col(source_col).cast("string").alias("source"),
            tx.word_count(text).alias("size"),
            # Rows without an id are spread by their text.
            F.md5(F.coalesce(F.col(id_col).cast("long").cast("string"), text, F.lit(""))).alias("key"),
        ),
        "sizes",
    )
    totals = narrow.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r.source: r["size"] for r in totals}
    plans = schedules(list(sizes))
    goal = targets(sizes, {s: area(plans[s]) for s in sizes}, most)
    table = spark.createDataFrame(
        [(s, sizes[s], goal[s], _segments(plans[s])) for s in sizes],
        "of string, source_size long, target double, "
        "segments array<struct<share: double, time: double, weight: double, slope: double>>",
    )
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    sums = narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("of"), "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "copy")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = narrow.withColumn("bucket", bucket)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("n.source").eqNullSafe(F.col("s.of"))
    rows = rows.alias("n").join(sums.alias("s"), same & (F.col("n.bucket") == F.col("s.bucket")))
    rows = rows.select("doc_id", "copy", "source", "size", (F.col("base") + F.col("within")).alias("before"))
    return rows.join(table, rows.source.eqNullSafe(table["of"])).drop("of")


def position(taken: Column, target: Column, segments: Column) -> Column:
    """Training time at which `taken` of `target` words of a source have been asked for; null where the target is 0."""
    share = F.try_divide(taken, target)
    at = F.try_element_at(F.filter(segments, lambda s: s["share"] <= share), F.lit(-1))
    rest = share - at["share"]
    root = F.sqrt(F.greatest(at["weight"] * at["weight"] + 2 * at["slope"] * rest, F.lit(0.0)))
    return at["time"] + F.when(rest > 0, F.try_divide(2 * rest, at["weight"] + root)).otherwise(0.0)


def taken_at(most: float = MOST) -> Column:
    """The takes of an `assigned` row in order: `epoch`, `words` (the last take may be a part) and `position`."""
    goal = F.round("target").cast("long")

    def take(epoch: Column) -> Column:
        start = epoch * F.col("source_size") + F.col("before")
        return F.struct(
            epoch.alias("epoch"),
            F.least(F.col("size"), goal - start).alias("words"),
            position(start, F.col("target"), F.col("segments")).alias("position"),
        )

    epochs = F.sequence(F.lit(0), F.lit(max(0, -int(-most // 1) - 1)))
    return F.filter(F.transform(epochs, take), lambda t: t["words"] > 0)


def takes(rows: DataFrame, most: float = MOST) -> DataFrame:
    """`assigned` rows, once for each time a document is taken: `epoch`, `words` (the last take may be a part) and `position`.

    Documents without words and those that the target doesn't reach have no row.
    """
    return rows.select("*", F.inline(taken_at(most)))


def curriculum(docs: DataFrame, schedules=ranked_schedules, *, most: float = MOST, **columns: str) -> DataFrame:
    """The training order: `doc_id`, `copy`, `source`, `size`, `before`, `epoch`, `words`, `position`, sorted by position."""
    rows = takes(assigned(docs, schedules, most=most, **columns), most)
    rows = rows.select("doc_id", "copy", "source", "size", "before", "epoch", "words", "position")
    return rows.orderBy("position", "source", "epoch", "before")


def mixed_documents(docs: DataFrame, schedules=ranked_schedules, *, most: float = MOST) -> DataFrame:
    """Whole rows of `docs` in training order with `mix_epoch`, `mix_words` and `mix_position` behind their columns (with an
    underscore more where `docs` has that name)."""
    # Both sides meet by a key without nulls; rows that repeat in whole are told apart by their number, each side its own.
    order = takes(assigned(docs, schedules, most=most), most).withColumn("mix_key", F.xxhash64("doc_id", "copy", "source"))
    order = order.select(
        "mix_key",
        F.col("copy").alias("mix_copy"),
        F.col("doc_id").alias("mix_id"),
        F.dense_rank().over(Window.partitionBy("mix_key", "copy").orderBy("doc_id", "source", "before")).alias("mix_of"),
        F.col("epoch").alias("mix_epoch"),
        F.col("words").alias("mix_words"),
        F.col("position").alias("mix_position"),
    )
    copy, key, of = (tx.fresh(name, docs.columns) for name in ("own_copy", "own_key", "own_of"))
    own = docs.withColumn(copy, F.xxhash64(F.col("text").cast("string")))
    own = own.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), copy, F.col("source").cast("string")))
    numbered = Window.partitionBy(key, copy).orderBy("doc_id", "source")
    own = own.withColumn(of, F.row_number().over(numbered))
    same = (
        (own[key] == order.mix_key)
        & (own[copy] == order.mix_copy)
        & own.doc_id.cast("long").eqNullSafe(order.mix_id)
        & (own[of] - order.mix_of == 0)
    )
    added = {name: tx.fresh(name, docs.columns) for name in ("mix_epoch", "mix_words", "mix_position")}
    joined = own.join(order, same).select(
        *(own[c] for c in docs.columns), *(order[name].alias(given) for name, given in added.items())
    )
    return joined.orderBy(added["mix_position"], "source", added["mix_epoch"], "doc_id")


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes from each, sorted by the position of the first take.

    `epochs` is the number of takes; documents that are never taken have no position and come last.
    """
    rows = assigned(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("takes", taken_at())
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda total, t: total + t["words"])
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 4).alias("target"),
        taken.alias("taken"),
        F.size("takes").cast("long").alias("epochs"),
        F.round(F.get("takes", F.lit(0))["position"], 9).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP5_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w FROM sized GROUP BY source
), shared AS (
  SELECT 0 AS round, source, source_size, w, CAST(NULL AS DOUBLE) AS target,
    (SELECT CAST(sum(source_size) AS DOUBLE) FROM sources) AS left_over, (SELECT CAST(sum(w) AS DOUBLE) FROM sources) AS total
  FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, w, target,
    left_over - coalesce(sum(CASE WHEN round_target THEN target END) OVER (), 0),
    sum(CASE WHEN target IS NULL THEN w END) OVER ()
  FROM (
    SELECT round, source, source_size, w, left_over, target IS NULL AND left_over * w / total > 3 * source_size AS round_target,
      CASE WHEN target IS NULL AND left_over * w / total > 3 * source_size THEN 3.0 * source_size ELSE target END AS target
    FROM shared WHERE round < 30
  )
), final AS (
  SELECT source, source_size, w, coalesce(target, left_over * w / total) AS target FROM shared WHERE round = 30
), rows AS (
  SELECT d.doc_id, d.size, f.source_size, f.w, f.target, CAST(round(f.target) AS BIGINT) AS goal,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN final f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, round(target, 4) AS target, CAST(
  greatest(0, least(size, goal - before)) + greatest(0, least(size, goal - before - source_size))
  + greatest(0, least(size, goal - before - 2 * source_size)) AS BIGINT) AS taken,
  CASE WHEN size = 0 THEN 0 ELSE CAST(goal > before AS BIGINT) + CAST(goal > before + source_size AS BIGINT)
    + CAST(goal > before + 2 * source_size AS BIGINT) END AS epochs,
  -- The inverse of each schedule's integral: falling from 1.5 to 0.5, even, and rising from 0.5 to 1.5 of the mean.
  CASE WHEN size > 0 AND goal > before THEN round(CASE w
    WHEN 1 THEN 2 * (before / target) / (1.5 + sqrt(2.25 - 2 * (before / target)))
    WHEN 2 THEN before / target
    WHEN 3 THEN 2 * (before / target) / (0.5 + sqrt(0.25 + 2 * (before / target))) END, 9) END AS position
FROM rows
"""
