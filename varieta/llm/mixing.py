"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import add_row_id
from .common import WORD_PATTERN, stage


def source_targets(per_source: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                   max_epochs: float = 2.0) -> DataFrame:
    """``per_source(source, source_size)`` -> the same with ``target``.

    Sources in code point order, null last, take the weights in turn and
    share ``share`` times all sizes.  A source whose part exceeds
    ``max_epochs`` times its size is clamped there and the excess goes to the
    others by weight, until none is above.  Two sums a round reach the
    driver; the table stays distributed."""
    named = per_source.withColumn("_key", F.struct(F.col("source").isNull(), F.col("source")))
    ranked = add_row_id(named, "_key", "_rank").drop("_key")
    by_turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    s = stage(ranked.select("source", "source_size", by_turn.alias("_w"),
                            (F.lit(float(max_epochs)) * F.col("source_size")).alias("_cap")), "sources")
    size, rest = s.agg(F.sum("source_size"), F.sum("_w")).first()
    if not size:
        return s.select("source", "source_size", F.lit(0.0).alias("target"))
    total, clamped = share * size, -1
    level = total / rest
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        n, capped, rest = s.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)),
                                F.sum(F.when(~full, F.col("_w")))).first()
        if n == clamped or rest is None:
            break
        clamped, level = n, (total - capped) / rest
    return s.select("source", "source_size", F.when(full, F.col("_cap")).otherwise(F.lit(level) * F.col("_w")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0,
                seed: str = "mix") -> DataFrame:
    """How many words a mix takes of every document of ``docs(doc_id, text, source)``.

    Returns doc_id, source, size, source_size, target, taken: one row per
    input row.  Each document is repeated ``floor(target / source_size)``
    times whole; the words that are left are filled by one further whole
    repetition of the documents with the lowest seeded hashes, and a
    fractional repetition of the document at the boundary, so a source's
    taken words are its target rounded.

    The hash line of a source is cut in 65,536 buckets whose sizes are summed
    before the shuffle; only the documents of the boundary bucket are put in
    order, so no window holds a whole source.

    Null text has size 0; a null source is one source; null or repeated
    doc_ids are ordered by (hash, doc_id, size); an empty table gives no rows;
    other columns are ignored."""
    u = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = stage(docs.select("doc_id", "source", size.alias("size"), u.alias("_u")), "sized")
    sized = sized.withColumn("_bucket", F.substring("_u", 1, 4))
    per_bucket = stage(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_n")), "buckets")
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = stage(targets.withColumn("_whole", whole)
                    .withColumn("_left", F.floor(F.col("target") + 0.5).cast("long") - F.col("_whole") * F.col("source_size")),
                    "targets")
    t = targets.select(F.col("source").alias("_s"), "_left")
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_n")
    cut = per_bucket.withColumn("_before", before).join(t, F.col("source").eqNullSafe(F.col("_s"))) \
        .where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_n") >= F.col("_left"))) \
        .select(F.col("source").alias("_s"), F.col("_bucket").alias("_cut"), (F.col("_left") - F.col("_before")).alias("_room"))
    plan = targets.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left") \
        .select(F.col("source").alias("_s"), "source_size", "target", "_whole", "_cut", "_room")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    out = ["doc_id", "source", "size", "source_size", "target"]
    clear = rows.where(~F.col("_bucket").eqNullSafe(F.col("_cut"))) \
        .select(*out, (F.col("_whole") * F.col("size") + F.when(F.col("_bucket") < F.col("_cut"), F.col("size")).otherwise(0)).alias("taken"))
    line = Window.partitionBy("source").orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(line), F.lit(0))
    edge = rows.where(F.col("_bucket") == F.col("_cut")) \
        .select(*out, (F.col("_whole") * F.col("size")
                       + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_room") - ahead))).alias("taken"))
    return clear.unionByName(edge)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u
  FROM {docs}),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
      FROM per),
tot AS (SELECT 1.5::DOUBLE * sum(source_size) AS total, sum(w) AS weight FROM w),
line AS (SELECT cap / w AS ratio, row_number() OVER o AS k, sum(cap) OVER o AS cap_sum, sum(w) OVER o AS w_sum
         FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT 0 AS k, total / weight AS level FROM tot
           UNION ALL SELECT k, (total - cap_sum) / nullif(weight - w_sum, 0) FROM line, tot),
lv AS (SELECT l.level FROM levels l LEFT JOIN line n ON n.k = l.k + 1
       WHERE n.ratio > l.level OR n.ratio IS NULL ORDER BY l.k LIMIT 1),
target AS (SELECT source, source_size,
             CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN lv.level IS NULL OR cap <= lv.level * w THEN cap ELSE lv.level * w END AS target
           FROM w, lv),
split AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM target),
room AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size AS room FROM split),
ordered AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS ahead
            FROM sized)
SELECT o.doc_id, o.size, r.source_size, r.target,
       CAST(r.whole * o.size + greatest(0, least(o.size, r.room - o.ahead)) AS BIGINT) AS taken
FROM ordered o JOIN room r ON o.source IS NOT DISTINCT FROM r.source
"""
