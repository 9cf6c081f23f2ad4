"""Language probability as a character n-gram naive Bayes
trained and applied with DataFrame aggregations and joins.

Scoring uses only the (gram, language) pairs that occur in the model:

  score(d, l) = log prior(l) + G(d)·u(l) + Σ_{g∈d∩model(l)} k(d,g)·(log p(g|l) − u(l))

where u(l) = log 1/(N_l + V) is the add-one value of an unseen gram and
G(d) the number of grams in d.  So the join is an inner equi-join on the
gram, never a document × language × vocabulary product.  A model whose
counted rows stay below a limit is broadcast and only one partial sum per
document is shuffled; a larger one joins per-document gram counts, whose
hot grams AQE splits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import attach


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Overlapping character n-grams of ``" " + lower(text) + " "`` in one
    linear regex scan (a capturing look-ahead yields every window)."""
    t = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def explode_grams(text: Column, n: int = 3) -> Column:
    """Grams as rows.  ``explode_outer`` (with the null row of a gram-less
    text dropped by the caller): a plain ``explode`` makes the optimizer
    infer ``size(grams) > 0`` and push it to the scan, which runs the regex
    over the whole text twice — the first time below any repartition."""
    return F.explode_outer(char_ngrams(text, n))


def doc_grams(docs: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    return (docs.select(id_col, explode_grams(F.col(text_col), n).alias("gram"))
            .where(F.col("gram").isNotNull())
            .groupBy(id_col, "gram").agg(F.count("*").alias("k")))


PACKED = 3                    # grams of so many code points fit one long, 21 bits each
PIECE_CHARS = 1 << 20         # characters of a text counted at a time


def gram_key(gram: Column, n: int) -> Column:
    """A gram as a long; longer ones stay strings."""
    if n > PACKED:
        return gram
    key = F.lit(0).cast("long")
    for i in range(1, n + 1):
        key = F.shiftleft(key, 21).bitwiseOR(F.ascii(F.substring(gram, i, 1)).cast("long"))
    return key


def key_gram(key: Column, n: int) -> Column:
    """The gram that ``gram_key`` made a long of."""
    if n > PACKED:
        return key
    points = [F.lpad(F.hex(F.shiftright(key, 21 * i).bitwiseAND(F.lit(0x1FFFFF))), 8, "0") for i in range(n - 1, -1, -1)]
    return F.decode(F.unhex(F.concat(*points)), "UTF-32")


def gram_counts(docs: DataFrame, col: str, text_col: str, n: int = 3) -> DataFrame:
    """(``col``, G, key, k) for every row: each gram's count ``k`` in it, as a
    ``gram_key``, and the number ``G`` of all its grams.  Grams are sorted and
    counted where the text is read, so no row moves or is made per character;
    a text longer than PIECE_CHARS gives a gram once per piece."""
    if n > PACKED:
        grams = docs.select(col, char_ngrams(F.col(text_col), n).alias("_g")) \
            .select(col, F.size("_g").cast("long").alias("G"), F.explode_outer("_g").alias("key"), F.lit(1).cast("long").alias("k"))
        return grams.where(F.col("key").isNotNull())  # outer + filter: see explode_grams

    def run(batches):
        import pyarrow as pa

        def rows(column, at, sizes, keys, ks):
            i = np.array(at, np.int64)
            per = np.array([len(x) for x in keys], np.int64)
            return pa.RecordBatch.from_arrays([column.take(pa.array(np.repeat(i, per))), pa.array(np.repeat(np.array(sizes, np.int64), per)),
                                               pa.array(np.concatenate(keys)), pa.array(np.concatenate(ks))], [col, "G", "key", "k"])
        for b in batches:
            at, sizes, keys, ks, held = [], [], [], [], 0
            for row, text in enumerate(b.column(1)):
                t = text.as_py()
                if t is None or len(t) < n:
                    continue
                for start in range(0, len(t) - n + 1, PIECE_CHARS):
                    points = np.frombuffer(t[start: start + PIECE_CHARS + n - 1].encode("utf-32-le"), np.uint32).astype(np.int64)
                    last = len(points) - n + 1
                    packed = points[:last]
                    for k in range(1, n):
                        packed = packed << 21 | points[k: k + last]
                    key, many = np.unique(packed, return_counts=True)
                    at.append(row)
                    sizes.append(len(t) - n + 1)
                    keys.append(key)
                    ks.append(many.astype(np.int64))
                    held += len(key)
                if held >= 200_000:
                    yield rows(b.column(0), at, sizes, keys, ks)
                    at, sizes, keys, ks, held = [], [], [], [], 0
            if at:
                yield rows(b.column(0), at, sizes, keys, ks)
    padded = docs.select(col, F.concat(F.lit(" "), F.lower(F.col(text_col)), F.lit(" ")).alias("_t"))
    return padded.mapInArrow(run, f"`{col}` {docs.schema[col].dataType.simpleString()}, G long, key long, k long")


def train_nb(docs: DataFrame, text_col: str, label_col: str, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Returns (model: gram, lang, logp) and (langs: lang, prior, unseen)."""
    from ..session import cut_lineage
    g = gram_counts(docs.select(F.col(label_col).alias("lang"), text_col), "lang", text_col, n)
    # the trained counts are read three times (vocabulary, totals, model):
    # materialise them once instead of re-scanning the corpus
    counts = cut_lineage(g.groupBy("lang", "key").agg(F.sum("k").alias("c")).select("lang", key_gram(F.col("key"), n).alias("gram"), "c"))
    vocab = counts.select("gram").distinct().agg(F.count("*").alias("V"))
    tot = counts.groupBy("lang").agg(F.sum("c").alias("N"))
    ndocs = docs.groupBy(F.col(label_col).alias("lang")).agg(F.count("*").alias("nd"))
    alld = ndocs.agg(F.sum("nd").alias("D"))
    langs = (attach(attach(tot.join(ndocs, "lang"), vocab, ()), alld, ())
             .select("lang", F.log(F.col("nd") / F.col("D")).alias("prior"),
                     (-F.log(F.col("N") + F.col("V"))).alias("unseen"), "N", "V"))
    model = counts.join(F.broadcast(langs.select("lang", "N", "V")), "lang").select(
        "gram", "lang", (F.log(F.col("c") + 1) - F.log(F.col("N") + F.col("V"))).alias("logp"))
    return model, langs.select("lang", "prior", "unseen")


BROADCAST_GRAMS = 500_000     # model rows sent to every task at most


def language_scores(docs: DataFrame, id_col: str, text_col: str, model: DataFrame,
                    langs: DataFrame, n: int = 3, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(id, lang, score, prob) for every language, probabilities normalised
    per document.

    The model is pivoted to one row per gram, so a join emits one row per gram
    whatever the number of languages.  If its counted rows are at most
    ``broadcast_grams``, every gram of a text meets it where the text is read
    and one partial sum per document and language is all that is shuffled.
    A larger model joins the counts per (document, gram), whose hot grams AQE
    splits.  Both give the same scores.  The language set is the label set
    (one row per language, like a StringIndexer's labels) and is read to the
    driver once, so scores and probabilities are array expressions on the
    document's row."""
    rows = sorted(langs.select("lang", "prior", "unseen").collect(), key=lambda r: r["lang"])
    # weight log p(g|l) - u(l) per language (0 where the gram is unseen in l)
    wide = model.groupBy(gram_key(F.col("gram"), n).alias("key")).agg(*[
        F.max(F.when(F.col("lang") == F.lit(r["lang"]), F.col("logp") - F.lit(r["unseen"]))).alias(f"_w{i}")
        for i, r in enumerate(rows)])
    grams = gram_counts(docs, id_col, text_col, n)
    if wide.count() <= broadcast_grams:
        j = grams.join(F.broadcast(wide), "key", "left")
    else:
        counted = grams.groupBy(id_col, "key").agg(F.sum("k").alias("k"), F.max("G").alias("G"))
        j = counted.join(wide, "key", "left")
    per_lang = [F.sum(F.col("k") * F.coalesce(F.col(f"_w{i}"), F.lit(0.0))).alias(f"_m{i}")
                for i in range(len(rows))]
    per_doc = j.groupBy(id_col).agg(F.max("G").alias("G"), *per_lang)
    scores = F.array(*[(F.lit(r["prior"]) + F.col("G") * F.lit(r["unseen"])
                        + F.coalesce(F.col(f"_m{i}"), F.lit(0.0))) for i, r in enumerate(rows)])
    names = F.array(*[F.lit(r["lang"]) for r in rows])
    s = per_doc.select(id_col, names.alias("_l"), scores.alias("_s"))
    # per-row constants are paired with the elements (array_repeat) rather
    # than referenced inside a lambda, where they would be recomputed per element
    top = F.array_repeat(F.array_max("_s"), F.size("_s"))
    e = F.zip_with("_s", top, lambda v, m: F.exp(v - m))
    s = s.select(id_col, "_l", "_s", e.alias("_e"))
    total = F.array_repeat(F.aggregate("_e", F.lit(0.0), lambda acc, v: acc + v), F.size("_e"))
    out = F.arrays_zip(F.col("_l").alias("lang"), F.col("_s").alias("score"),
                       F.zip_with("_e", total, lambda v, t: v / t).alias("prob"))
    return s.select(id_col, F.explode(out).alias("_r")).select(id_col, "_r.lang", "_r.score", "_r.prob")
