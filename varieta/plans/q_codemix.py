"""Registered code-mixing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codemix as CM
from ..functions import patterns as P
from ..functions.patterns import sql_str as q
from ..operators import metrics as M
from ..session import read_table
from . import bindings as B
from . import sqltext as S
from .q_metrics import r6
from .registry import query


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def common(spark, sf):
    en = _docs(spark, sf).where(F.col("lang") == "en")
    return CM.common_words(CM.zipf_table(en))


def detected(spark, sf):
    d = _docs(spark, sf)
    return CM.detect_code_mixing(d, common(spark, sf), "doc_id", "text")


_SEEDS = ", ".join(q(s) for s in P.HINGLISH_SEEDS)
_ELIG = S.eligible_tokens(S.tokenize_words(S.normalize_ws(S.remove_urls("text", " "))))
ZIPF_CTE = f"""zw AS (SELECT lower(unnest(regexp_extract_all(text, {q(P.TOKEN)}))) AS word
       FROM documents WHERE lang = 'en'),
zc AS (SELECT word, count(*) AS cnt FROM zw GROUP BY word),
zipf AS (SELECT word, cnt, log10(cnt * 1e9 / (SELECT sum(cnt) FROM zc)) AS zipf FROM zc),
common AS (SELECT word FROM zipf WHERE zipf >= {P.ZIPF_COMMON})"""
def detector_cte(src: str = "documents") -> str:
    """The detector (M1-M4) as CTEs over a relation ``src(doc_id, text)``;
    needs ``common`` from ZIPF_CTE and defines ``cm``."""
    return f"""el AS (SELECT doc_id AS id, {_ELIG} AS elig FROM {src}),
tok AS (SELECT id, unnest(elig) AS token, unnest(range(0, len(elig))) AS pos FROM el),
flags AS (SELECT t.id, t.pos, t.token, c.word IS NOT NULL AS is_common,
                 (t.token IN ({_SEEDS}) OR (regexp_matches(t.token, {q(P.ROMANISED_CUE)}) AND c.word IS NULL)) AS flag
          FROM tok t LEFT JOIN common c ON t.token = c.word),
sw AS (SELECT id, flag, coalesce(flag <> lag(flag) OVER (PARTITION BY id ORDER BY pos), FALSE) AS changed FROM flags),
per AS (SELECT id, CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS ratio,
               sum(CASE WHEN changed THEN 1 ELSE 0 END) AS switches FROM sw GROUP BY id),
cm AS (SELECT d.doc_id AS id, coalesce(p.ratio, 0.0) AS cm_ratio, CAST(coalesce(p.switches, 0) AS INTEGER) AS cm_switches,
              CASE WHEN p.id IS NULL THEN 0.0 ELSE {P.RATIO_WEIGHT} * least(p.ratio / {P.RATIO_SCALE}, 1.0)
                       + {P.SWITCH_WEIGHT} * least(p.switches / {P.SWITCH_SCALE}, 1.0) END AS cm_score
       FROM {src} d LEFT JOIN per p ON d.doc_id = p.id)"""


TOK_CTE = ZIPF_CTE + ",\n" + detector_cte("documents")


# M5 ------------------------------------------------------------------------
def zipf_table_q(spark, sf):
    en = _docs(spark, sf).where(F.col("lang") == "en")
    return CM.zipf_table(en).select("word", F.col("count").cast("long").alias("count"), r6("zipf"))


query("zipf_table", f"""WITH {ZIPF_CTE}
SELECT word, CAST(cnt AS BIGINT) AS count, round(zipf, 6) AS zipf FROM zipf""")(zipf_table_q)


# D4 ------------------------------------------------------------------------
def seed_membership_q(spark, sf):
    d = _docs(spark, sf)
    el = CM.detector_tokens(F.col("text"))
    return d.select("doc_id", F.size(F.filter(el, lambda t: CM.seed_member(t))).cast("long").alias("n_seed"))


query("seed_membership", f"""WITH el AS (SELECT doc_id, {_ELIG} AS elig FROM documents)
SELECT doc_id, CAST(len(list_filter(elig, lambda t: t IN ({_SEEDS}))) AS BIGINT) AS n_seed FROM el""")(seed_membership_q)


# D5 / M1 -------------------------------------------------------------------
def freq_lookup_q(spark, sf):
    f = CM.token_flags(_docs(spark, sf), "doc_id", "text", common(spark, sf))
    lk = f.join(F.broadcast(common(spark, sf).select(F.col("word").alias("token"), F.lit(1).alias("c"))),
                "token", "left")
    return lk.groupBy("doc_id").agg(F.count("*").cast("long").alias("n_tokens"),
                                    F.count("c").cast("long").alias("n_common"),
                                    F.sum(F.col("flag").cast("long")).cast("long").alias("n_flagged"))


query("freq_lookup", f"""WITH {TOK_CTE}
SELECT id AS doc_id, CAST(count(*) AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN is_common THEN 1 ELSE 0 END) AS BIGINT) AS n_common,
       CAST(sum(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged FROM flags GROUP BY id""")(freq_lookup_q)


# M4 (with M1-M3) -----------------------------------------------------------
def detect_code_mixing_q(spark, sf):
    return detected(spark, sf).select("doc_id", r6("cm_ratio"),
                                      F.col("cm_switches").cast("int").alias("cm_switches"),
                                      r6("cm_score"), "is_cm")


query("detect_code_mixing", f"""WITH {TOK_CTE}
SELECT id AS doc_id, round(cm_ratio, 6) AS cm_ratio, cm_switches, round(cm_score, 6) AS cm_score,
       cm_score >= {P.CM_THRESHOLD} AS is_cm FROM cm""")(detect_code_mixing_q)


# F3 ------------------------------------------------------------------------
def adjacent_change_q(spark, sf):
    f = CM.token_flags(_docs(spark, sf), "doc_id", "text", common(spark, sf))
    ch = CM.adjacent_change(f, "doc_id")
    return ch.groupBy("doc_id").agg(F.sum(F.col("changed").cast("long")).cast("long").alias("n_changes"))


query("adjacent_change", f"""WITH {TOK_CTE}
SELECT id AS doc_id, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) AS BIGINT) AS n_changes FROM sw GROUP BY id""")(adjacent_change_q)


# G1 ------------------------------------------------------------------------
def top_scored_q(spark, sf):
    d = detected(spark, sf)
    return d.orderBy(F.desc("cm_score"), "doc_id").limit(10).select("doc_id", r6("cm_score"))


query("top_scored", f"""WITH {TOK_CTE}
SELECT id AS doc_id, round(cm_score, 6) AS cm_score FROM cm ORDER BY cm_score DESC, id LIMIT 10""")(top_scored_q)


# G2 ------------------------------------------------------------------------
def preview_q(spark, sf):
    return _docs(spark, sf).orderBy("doc_id").limit(5).select("doc_id", "lang", "source")


query("preview", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 5")(preview_q)


# H2 ------------------------------------------------------------------------
def bind_columns_q(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang")
    return d.join(detected(spark, sf), "doc_id").select(
        "doc_id", "lang", r6("cm_score"), "is_cm")


query("bind_columns", f"""WITH {TOK_CTE}
SELECT d.doc_id, d.lang, round(cm.cm_score, 6) AS cm_score, cm.cm_score >= {P.CM_THRESHOLD} AS is_cm
FROM documents d JOIN cm ON d.doc_id = cm.id""")(bind_columns_q)


# E13 -----------------------------------------------------------------------
def sliced_f1_q(spark, sf):
    p = B.preds(spark, sf)
    cm = detected(spark, sf).select(F.col("doc_id").alias("id"), "is_cm")
    j = p.join(cm, "id")
    out = M.sliced_f1(j, "is_cm", ["model", "task"])
    return out.select("model", "task", "slice", F.col("n").cast("long").alias("n"), r6("f1"), r6("drop"))


query("sliced_f1", f"""WITH {B.preds_cte()}, {TOK_CTE},
j AS (SELECT p.*, c.cm_score >= {P.CM_THRESHOLD} AS is_cm FROM preds p JOIN cm c ON p.id = c.id),
keys AS (SELECT DISTINCT model, task FROM j),
spine AS (SELECT model, task, s AS slice FROM keys, (VALUES (FALSE), (TRUE)) v(s)),
a AS (SELECT model, task, is_cm AS slice, count(*) AS n,
             sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) AS pp,
             sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS ap FROM j GROUP BY ALL),
m AS (SELECT s.model, s.task, s.slice, coalesce(a.n, 0) AS n,
             CASE WHEN coalesce(a.pp, 0) + coalesce(a.ap, 0) = 0 THEN 0.0
                  ELSE CAST(2 * coalesce(a.tp, 0) AS DOUBLE) / (coalesce(a.pp, 0) + coalesce(a.ap, 0)) END AS f1
      FROM spine s LEFT JOIN a ON s.model = a.model AND s.task = a.task AND s.slice = a.slice),
d AS (SELECT model, task, max(CASE WHEN NOT slice THEN f1 END) - max(CASE WHEN slice THEN f1 END) AS dr FROM m GROUP BY ALL)
SELECT m.model, m.task, m.slice, CAST(m.n AS BIGINT) AS n, round(m.f1, 6) AS f1, round(d.dr, 6) AS "drop"
FROM m JOIN d ON m.model = d.model AND m.task = d.task""")(sliced_f1_q)


# E17 per split on the detector score ---------------------------------------
def cm_histogram_q(spark, sf):
    from .q_dataset import splits
    from ..session import cut_lineage
    s = splits(spark, sf).select("id", "split").distinct()
    # the histogram reads its input twice (range, then bins): materialise the
    # small (id, split, score) table once in the shared checkpoint folder
    # instead of running the detector over every text twice
    j = cut_lineage(s.join(detected(spark, sf).select(F.col("doc_id").alias("id"), "cm_score"), "id"))
    return M.histogram(j, "cm_score", ["split"], bins=30).select(
        "split", F.col("bin").cast("long").alias("bin"), F.col("n").cast("long").alias("n"))


def _cm_hist_sql():
    from .q_dataset import SPLIT_CTE
    return f"""WITH {SPLIT_CTE}, {TOK_CTE},
j AS (SELECT DISTINCT s.id, s.split, c.cm_score FROM splits s JOIN cm c ON s.id = c.id),
rng AS (SELECT split, min(cm_score) AS lo, max(cm_score) AS hi FROM j GROUP BY split),
b AS (SELECT j.split, CASE WHEN rng.hi = rng.lo THEN 0 ELSE
             CAST(least(floor((j.cm_score - rng.lo) / ((rng.hi - rng.lo) / 30)), 29) AS INTEGER) END AS bin
      FROM j JOIN rng ON j.split = rng.split),
c AS (SELECT split, bin, count(*) AS n FROM b GROUP BY ALL),
sp AS (SELECT split, unnest(range(0, 30)) AS bin FROM rng)
SELECT sp.split, CAST(sp.bin AS BIGINT) AS bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM sp LEFT JOIN c ON sp.split = c.split AND sp.bin = c.bin"""


query("cm_histogram", _cm_hist_sql())(cm_histogram_q)


# Flagship ------------------------------------------------------------------
def flagship_q(spark, sf):
    from .flagship import flagship
    return flagship(spark, sf)


def _flagship_sql() -> str:
    from .sqlgen import class_counts_sql, per_class_sql
    models = ", ".join(f"({q(m)})" for m in B.MODELS)
    group = ["model", "split", "variety", "is_cm"]
    return f"""WITH {B.noisy_cte()},
cleaned AS (SELECT doc_id, {S.clean_text('text')} AS text FROM noisy),
{ZIPF_CTE},
{detector_cte('cleaned')},
ann AS (SELECT n.doc_id AS id, n.lang AS variety,
               CASE WHEN CAST(substr(n.source, 4) AS INT) % 2 = 0 THEN 'Google' ELSE 'Reddit' END AS domain,
               CASE WHEN n.n_chars < 200 THEN 2 ELSE l.quality END AS sentiment_label, l.toxic AS sarcasm_label
        FROM noisy n JOIN labels l ON n.doc_id = l.doc_id),
tasks AS (SELECT id, variety, domain, 'Sentiment' AS task, sentiment_label AS label FROM ann WHERE sentiment_label <> 2
          UNION ALL
          SELECT id, variety, domain, 'Sarcasm' AS task, sarcasm_label AS label FROM ann WHERE sarcasm_label <> 2),
r AS (SELECT *, row_number() OVER (PARTITION BY task, variety, domain, label
                                   ORDER BY md5(CAST(id AS VARCHAR) || '7'), id) - 1 AS rk,
             count(*) OVER (PARTITION BY task, variety, domain, label) AS n FROM tasks),
sp AS (SELECT id, task, variety, domain, label,
         CASE WHEN rk < floor(n * 0.7) THEN 'train'
              WHEN rk < floor(n * 0.7) + floor((n - floor(n * 0.7)) * 0.3) THEN 'valid'
              ELSE 'test' END AS split
       FROM r WHERE id IS NOT NULL AND variety IS NOT NULL AND domain IS NOT NULL),
models(model) AS (VALUES {models}),
preds AS (SELECT s.*, m.model, {B.flip_sql('s.id', 's.label', 'm.model')} AS prediction FROM sp s, models m),
scored AS (SELECT p.*, c.cm_score >= {P.CM_THRESHOLD} AS is_cm FROM preds p JOIN cm c ON p.id = c.id),
pc AS ({per_class_sql(class_counts_sql('scored', group))})
SELECT model, split, variety, is_cm, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1_score, CAST(sum(support) AS BIGINT) AS n
FROM pc GROUP BY model, split, variety, is_cm"""


query("flagship", _flagship_sql())(flagship_q)
