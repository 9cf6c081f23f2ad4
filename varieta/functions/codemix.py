"""Code-mixing detector as Spark jobs.

The detector needs, per eligible token, "is this word common English?" —
a lookup into a word-frequency table.  Spark map lookups are linear in the
map size, so the lookup is relational instead: tokens are exploded with
their position, matched against the common-word table with a broadcast hash
join, and folded back per document.  The fold is a ``collect_list`` whose
map-side partial aggregate already holds every token of a document (they
come from one input row), so the shuffle carries one small array per
document, never per-token rows, and never the text.

The common-word table is bounded by construction: a word with Zipf
frequency >= z occurs at least 10^z times per 10^9 tokens, so at most
10^(9-z) words qualify (316,228 for z = 3.5) whatever the corpus size.
That proven bound is what licenses the broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .text import eligible_tokens, remove_urls, tokenize_words


def detector_tokens(text) -> Column:
    """C1(" ") -> C10 -> C11 -> C12: lower-cased tokens of length >= 4.

    C10 (collapse whitespace, strip) is skipped: tokens never contain
    whitespace, so it cannot change the token list — one regex pass less."""
    return eligible_tokens(tokenize_words(remove_urls(text, " ")), P.MIN_ELIGIBLE_LEN)


# M5 -----------------------------------------------------------------------
def zipf_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word -> count, zipf = log10(count per 10^9 tokens) over ``docs``.

    Counting is a map-side combined aggregate.  The vocabulary counts are
    materialised once (reliable checkpoint in ``spark.checkpoint.dir``) so
    the corpus total — a scalar subquery — reads that small table instead
    of tokenising the corpus a second time."""
    from ..session import cut_lineage
    # explode_outer + null filter: a plain explode lets the optimizer infer
    # size(tokens) > 0 and push it to the scan, tokenising every text twice
    words = docs.select(F.explode_outer(F.transform(tokenize_words(F.col(text_col)), lambda t: F.lower(t)))
                        .alias("word")).where(F.col("word").isNotNull())
    counts = cut_lineage(words.groupBy("word").agg(F.count("*").alias("count")))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("word", "count", F.log10(F.col("count") * 1e9 / total).alias("zipf"))


def common_words(zipf: DataFrame, threshold: float = P.ZIPF_COMMON) -> DataFrame:
    """Words with ``zipf >= threshold``; at most ``10^(9 - threshold)`` rows."""
    return zipf.where(F.col("zipf") >= threshold).select("word")


def common_words_bound(threshold: float = P.ZIPF_COMMON) -> int:
    return int(math.floor(10 ** (9 - threshold)))


# M1 ---------------------------------------------------------------------------
def seed_member(token: Column, seeds=P.HINGLISH_SEEDS) -> Column:
    """Token in the fixed seed list (an ``In`` set, hashed)."""
    return token.isin(*seeds)


def romanised_cue(token: Column) -> Column:
    """``ROMANISED_CUE`` (a marker anywhere, or an ending at the end) as byte
    searches on the token instead of a regex per token.  Same result: tokens
    hold letters, apostrophes and hyphens only, so ``$`` can only match at
    the very end."""
    hit = F.lit(False)
    for m in P.ROMANISED_MARKERS:
        hit = hit | token.contains(m)
    for e in P.ROMANISED_ENDINGS:
        hit = hit | token.endswith(e)
    return hit


def token_flags(docs: DataFrame, id_col: str, text_col: str, common: DataFrame,
                outer: bool = False) -> DataFrame:
    """M1 + D5: one row per (id, pos, token, flag) for eligible tokens
    (``outer`` keeps one null-token row for a document without any)."""
    # always the outer generator: a plain posexplode lets the optimizer infer
    # size(tokens) > 0 and push it to the scan (tokenising every text twice)
    toks = docs.select(id_col, F.posexplode_outer(detector_tokens(F.col(text_col))).alias("pos", "token"))
    if not outer:
        toks = toks.where(F.col("token").isNotNull())
    lookup = F.broadcast(common.select(F.col("word").alias("token"), F.lit(True).alias("_common")))
    j = toks.join(lookup, "token", "left")
    flag = seed_member(F.col("token")) | (romanised_cue(F.col("token")) &
                                           ~F.coalesce(F.col("_common"), F.lit(False)))
    return j.select(id_col, "pos", "token", flag.alias("flag"))


# M2 ---------------------------------------------------------------------------
def switch_count(flags: Column) -> Column:
    """Adjacent changes in a boolean array (0 for fewer than two items)."""
    n = F.size(flags)
    diffs = F.zip_with(F.slice(flags, 1, F.greatest(n - 1, F.lit(0))),
                       F.slice(flags, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a != b)
    return F.when(n < 2, F.lit(0)).otherwise(F.size(F.filter(diffs, lambda x: x)))


# M3 ---------------------------------------------------------------------------
def code_mix_score(ratio: Column, switches: Column) -> Column:
    return (P.RATIO_WEIGHT * F.least(ratio / P.RATIO_SCALE, F.lit(1.0))
            + P.SWITCH_WEIGHT * F.least(switches / P.SWITCH_SCALE, F.lit(1.0)))


# M4 ---------------------------------------------------------------------------
def detect_code_mixing(docs: DataFrame, common: DataFrame, id_col: str = "id",
                       text_col: str = "text") -> DataFrame:
    """Per document: cm_ratio, cm_switches, cm_score, is_cm (no eligible
    tokens -> 0, 0, 0.0, false).  Returns (id, cm columns) — join it on the
    id where the text is not needed, so the text itself never shuffles.
    ``posexplode_outer`` keeps token-less documents in the same fold, so no
    second pass over the documents is needed."""
    f = token_flags(docs, id_col, text_col, common, outer=True)
    item = F.when(F.col("token").isNotNull(), F.struct("pos", "flag"))
    per_doc = (f.groupBy(id_col)
               .agg(F.array_sort(F.collect_list(item)).alias("_fl"))
               .select(id_col, F.transform("_fl", lambda s: s["flag"]).alias("_f")))
    n = F.size("_f")
    flagged = F.size(F.filter("_f", lambda x: x))
    ratio = F.when(n > 0, flagged / n).otherwise(F.lit(0.0))
    switches = switch_count(F.col("_f"))
    score = F.when(n > 0, code_mix_score(ratio, switches)).otherwise(F.lit(0.0))
    return per_doc.select(id_col, ratio.alias("cm_ratio"), switches.alias("cm_switches"),
                          score.alias("cm_score"), (score >= P.CM_THRESHOLD).alias("is_cm"))


# F3 ---------------------------------------------------------------------------
def adjacent_change(flags: DataFrame, id_col: str, pos: str = "pos", value: str = "flag") -> DataFrame:
    """Relational form of M2: ``lag`` over each document's token order."""
    from pyspark.sql import Window
    w = Window.partitionBy(id_col).orderBy(pos)
    prev = F.lag(value).over(w)
    return flags.withColumn("changed", F.coalesce(prev != F.col(value), F.lit(False)))
