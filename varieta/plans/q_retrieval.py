"""Registered retrieval, prompt and vector queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import sql_str as q
from ..operators import knn as KN
from ..operators import metrics as M
from ..operators import prompts as PR
from ..operators import reports as RP
from ..operators import split as SP
from ..session import cut_lineage, read_table
from ..sources import files as FS
from . import bindings as B
from . import sqltext as S
from .q_metrics import r6
from .registry import query
from .sqlgen import class_counts_sql, per_class_sql

K = 4
EMB_V = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label AS class10, label % 2 AS label FROM embeddings)"
PAIRS = EMB_V + """,
s AS (SELECT a.vec_id AS qid, b.vec_id AS tid, b.label AS tlabel, list_dot_product(a.v, b.v) AS score FROM e a, e b
      WHERE a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0)"""


def folds(e):
    """Query rows (the validation fold) and train rows (the index): disjoint,
    so no query meets itself or its own label."""
    fold = F.col("vec_id") % 10 == 0
    return e.where(fold), e.where(~fold)


def closest(spark, sf, k=K):
    q, t = folds(B.emb(spark, sf))
    return KN.knn_topk(q, t, k, q_id="vec_id", q_vec="embedding", t_id="vec_id", t_vec="embedding",
                       t_label="label")


# D8 / F2 -------------------------------------------------------------------
def knn_closest_q(spark, sf):
    return closest(spark, sf).select("qid", "tid", F.col("rank").cast("long").alias("rank"), r6("score"))


query("knn_closest", f"""WITH {PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS rk FROM s)
SELECT qid, tid, CAST(rk AS BIGINT) AS rank, round(score, 6) AS score FROM r WHERE rk <= {K}""")(knn_closest_q)


# D9 / G4 -------------------------------------------------------------------
def contrastive(spark, sf, k=K):
    q, t = folds(B.emb(spark, sf))
    return KN.knn_contrastive(q, t, k, q_id="vec_id", q_vec="embedding", t_id="vec_id",
                              t_vec="embedding", t_label="label", seed=42)


def knn_contrastive_q(spark, sf):
    return contrastive(spark, sf).select("qid", "tid", "tlabel", F.col("rank").cast("long").alias("rank"),
                                         F.col("position").cast("long").alias("position"), r6("score"))


CONTRASTIVE_CTE = f"""{PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY qid, tlabel ORDER BY score DESC, tid) AS rk FROM s),
c AS (SELECT * FROM r WHERE rk <= {K // 2}),
cp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5(concat_ws('|', CAST(qid AS VARCHAR), CAST(tid AS VARCHAR), '42'))) AS pos FROM c)"""
query("knn_contrastive", f"""WITH {CONTRASTIVE_CTE}
SELECT qid, tid, CAST(tlabel AS BIGINT) AS tlabel, CAST(rk AS BIGINT) AS rank, CAST(pos AS BIGINT) AS position,
       round(score, 6) AS score FROM cp""")(knn_contrastive_q)


# F1 + K2 -------------------------------------------------------------------
def _prompts(spark, sf, technique="closest", prefix=PR.SENTIMENT_PROMPT):
    """Queries and examples are the embedded rows of the two folds that have a
    document text; ``technique`` is closest, contrastive or zero."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    e = B.emb(spark, sf).join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    q, t = folds(e)
    ids = dict(q_id="vec_id", q_vec="embedding", t_id="vec_id", t_vec="embedding", t_label="label")
    if technique == "contrastive":
        nn = KN.knn_contrastive(q, t, K, seed=42, **ids)
    elif technique == "closest":
        nn = KN.knn_topk(q, t, K, **ids).withColumn("position", F.col("rank"))
    else:
        nn = KN.knn_topk(q, t.where(F.lit(False)), K, **ids).withColumn("position", F.col("rank"))
    ex = nn.join(docs.withColumnRenamed("doc_id", "tid").withColumnRenamed("text", "ex_text"), "tid") \
        .select("qid", "position", "ex_text", F.col("tlabel").alias("ex_label"))
    qs = q.select(F.col("vec_id").alias("qid")) \
        .join(docs.select(F.col("doc_id").alias("qid"), F.col("text").alias("q_text")), "qid")
    return PR.few_shot_prompts(ex, qs, prefix).select(
        "qid", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("prompt_chars"))


def few_shot_prompt_q(spark, sf):
    return _prompts(spark, sf)


def contrastive_prompt_q(spark, sf):
    return _prompts(spark, sf, "contrastive")


def sarcasm_prompt_q(spark, sf):
    return _prompts(spark, sf, "closest", PR.SARCASM_PROMPT)


def zero_shot_prompt_q(spark, sf):
    return _prompts(spark, sf, "zero")


_block = ("'## Example ' || CAST(n AS VARCHAR) || chr(10) || 'Text: ' || ex_text || chr(10) || 'Label: ' "
          "|| CAST(ex_label AS VARCHAR) || chr(10) || chr(10)")
def _prompt_sql(chosen: str, prefix: str) -> str:
    return f"""WITH {EMB_V.replace("FROM embeddings", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")},
s AS (SELECT a.vec_id AS qid, b.vec_id AS tid, b.label AS tlabel, list_dot_product(a.v, b.v) AS score FROM e a, e b
      WHERE a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0),
{chosen},
ex AS (SELECT c.qid, c.n, d.text AS ex_text, c.tlabel AS ex_label FROM chosen c JOIN documents d ON d.doc_id = c.tid),
sh AS (SELECT qid, {q(PR.EXAMPLES_HEADER)} || string_agg({_block}, '' ORDER BY n) AS shots FROM ex GROUP BY qid),
p AS (SELECT e.vec_id AS qid, CASE WHEN sh.shots IS NULL
        THEN {q(prefix + chr(10) + "Text: ")} || d.text || {q(PR.LABEL_CUE)}
        ELSE {q(prefix + chr(10) + chr(10))} || sh.shots || {q(chr(10) + PR.TURN_INTRO)} || d.text || {q(PR.LABEL_CUE)} END AS prompt
      FROM e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN sh ON sh.qid = e.vec_id WHERE e.vec_id % 10 = 0)
SELECT qid, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_chars FROM p"""


_CLOSEST = f"""r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS n FROM s),
chosen AS (SELECT * FROM r WHERE n <= {K})"""
_BOTH = f"""r AS (SELECT *, row_number() OVER (PARTITION BY qid, tlabel ORDER BY score DESC, tid) AS rk FROM s),
chosen AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY md5(concat_ws('|', CAST(qid AS VARCHAR), CAST(tid AS VARCHAR), '42'))) AS n
           FROM r WHERE rk <= {K // 2})"""
_NONE = "chosen AS (SELECT *, 0 AS n FROM s WHERE FALSE)"
query("few_shot_prompt", _prompt_sql(_CLOSEST, PR.SENTIMENT_PROMPT))(few_shot_prompt_q)
query("contrastive_prompt", _prompt_sql(_BOTH, PR.SENTIMENT_PROMPT))(contrastive_prompt_q)
query("sarcasm_prompt", _prompt_sql(_CLOSEST, PR.SARCASM_PROMPT))(sarcasm_prompt_q)
query("zero_shot_prompt", _prompt_sql(_NONE, PR.SENTIMENT_PROMPT))(zero_shot_prompt_q)


def number_examples_q(spark, sf):
    c = contrastive(spark, sf)
    w = Window.partitionBy("qid").orderBy("position")
    return c.select("qid", "tid", F.row_number().over(w).cast("long").alias("example"))


query("number_examples", f"""WITH {CONTRASTIVE_CTE}
SELECT qid, tid, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos) AS BIGINT) AS example FROM cp""")(number_examples_q)


# K1 ------------------------------------------------------------------------
TEMPLATE = "Classify the turn below.\nRole: {}\nText: {}\nAnswer:"


def fill_prompt_q(spark, sf):
    c = read_table(spark, sf, "conversations")
    p = PR.fill_prompt(TEMPLATE, "role", "text")
    return c.select("conv_id", "turn", F.md5(p).alias("prompt_md5"), F.length(p).cast("long").alias("prompt_chars"))


_parts = TEMPLATE.split("{}")
_fill = f"{q(_parts[0])} || role || {q(_parts[1])} || text || {q(_parts[2])}"
query("fill_prompt", f"""SELECT conv_id, turn, md5({_fill}) AS prompt_md5,
  CAST(length({_fill}) AS BIGINT) AS prompt_chars FROM conversations""")(fill_prompt_q)


# K3 ------------------------------------------------------------------------
def _generations(spark, sf):
    p = B.preds(spark, sf).where(F.col("model") == "m1")
    h = F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("gen"))), 1, 1)
    raw = (F.when(h.isin("0", "1"), F.lit("Positive."))
           .when(h.isin("2", "3"), F.concat(F.lit("\t"), F.col("prediction").cast("string"), F.lit(" \n")))
           .otherwise(F.col("prediction").cast("string")))
    return p.select("id", "task", "variety", "domain", "label", raw.alias("raw"))


GEN_CTE = B.preds_cte() + """,
gen AS (SELECT id, task, variety, domain, label,
  CASE WHEN substr(md5(CAST(id AS VARCHAR) || 'gen'), 1, 1) IN ('0', '1') THEN 'Positive.'
       WHEN substr(md5(CAST(id AS VARCHAR) || 'gen'), 1, 1) IN ('2', '3') THEN chr(9) || CAST(prediction AS VARCHAR) || ' ' || chr(10)
       ELSE CAST(prediction AS VARCHAR) END AS raw FROM preds WHERE model = 'm1'),
parsed AS (SELECT *, CASE WHEN regexp_full_match(raw, '\\s*1\\s*') THEN 1 WHEN regexp_full_match(raw, '\\s*0\\s*') THEN 0 ELSE -1 END AS prediction FROM gen)"""


def collect_results_q(spark, sf):
    r = PR.collect_results(_generations(spark, sf))
    return r.groupBy("task", "variety", "domain").agg(
        F.count_if("parsed").cast("long").alias("n_scored"),
        F.count_if(~F.col("parsed")).cast("long").alias("n_unparsed"),
        F.round(F.avg(F.when(F.col("parsed"), F.col("is_correct").cast("double"))), 6).alias("accuracy"))


query("collect_results", f"""WITH {GEN_CTE}
SELECT task, variety, domain, CAST(count_if(prediction <> -1) AS BIGINT) AS n_scored,
  CAST(count_if(prediction = -1) AS BIGINT) AS n_unparsed,
  round(avg(CASE WHEN prediction <> -1 THEN CAST(prediction = label AS DOUBLE) END), 6) AS accuracy
FROM parsed GROUP BY ALL""")(collect_results_q)


# K4 ------------------------------------------------------------------------
# --- fixed values: run grid of the few-shot study
TECHNIQUES = ("closest", "contrastive", "None")
KS = (4, 8, 16)


def run_key_q(spark, sf):
    t = B.task_rows(spark, sf).select("variety", "task", "domain").distinct()
    g = t.select("*", F.explode(F.array(*[F.lit(x) for x in TECHNIQUES])).alias("technique")) \
        .select("*", F.explode(F.array(*[F.lit(x) for x in KS])).alias("k"))
    key = PR.run_key(F.col("technique"), F.col("k"), F.concat(F.lit("en-"), F.upper("variety")),
                     F.col("task"), F.col("domain"))
    parsed = PR.parse_run_key(key)
    return g.select(key.alias("key"), parsed["technique"].alias("p_technique"),
                    parsed["k"].cast("long").alias("p_k"), parsed["variety"].alias("p_variety"),
                    parsed["task"].alias("p_task"), parsed["source"].alias("p_source"))


query("run_key", f"""WITH {B.TASKS_CTE},
g AS (SELECT DISTINCT variety, task, domain FROM tasks),
x AS (SELECT concat_ws('_', t.technique, CAST(k.k AS VARCHAR), 'en-' || upper(g.variety), g.task, g.domain,
                       'few_shots_results') AS key
      FROM g, (VALUES {', '.join(f"('{t}')" for t in TECHNIQUES)}) t(technique), (VALUES {', '.join(f'({k})' for k in KS)}) k(k))
SELECT key, regexp_extract(key, {q(PR.RUN_KEY_PATTERN)}, 1) AS p_technique,
  CAST(regexp_extract(key, {q(PR.RUN_KEY_PATTERN)}, 2) AS BIGINT) AS p_k,
  regexp_extract(key, {q(PR.RUN_KEY_PATTERN)}, 3) AS p_variety,
  regexp_extract(key, {q(PR.RUN_KEY_PATTERN)}, 4) AS p_task,
  regexp_extract(key, {q(PR.RUN_KEY_PATTERN)}, 5) AS p_source FROM x""")(run_key_q)


# K5 ------------------------------------------------------------------------
def _vote(nn):
    """Similarity-weighted label vote of the retrieved examples (a stand-in
    for the external generator's answer); ties go to the lower label."""
    w = nn.groupBy("qid", "tlabel").agg(F.sum("score").alias("w"))
    best = w.groupBy("qid").agg(F.max_by("tlabel", F.struct("w", -F.col("tlabel"))).alias("prediction"))
    return best


def run_comparison_q(spark, sf):
    """All techniques and K from one product: the 8 best of each label hold the
    8 best of all and the K/2 best of each.  The zero-shot answer, which sees
    no example, is stood in for by the commonest train label."""
    q, t = folds(B.emb(spark, sf))
    ranking = cut_lineage(KN.knn_topk(q, t, 8, q_id="vec_id", q_vec="embedding", t_id="vec_id", t_vec="embedding",
                                      t_label="label", per_label=True))
    best = ranking.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "tid")))
    truth = q.select(F.col("vec_id").alias("qid"), "label")
    prior = t.groupBy(F.col("label").alias("prediction")).count().orderBy(F.desc("count"), "prediction").limit(1).select("prediction")
    runs = []
    for k in (4, 8):
        for tech, nn in (("closest", KN.first_ranks(best, k)), ("contrastive", KN.first_ranks(ranking, k // 2))):
            runs.append(_vote(nn).join(truth, "qid").select("prediction", "label", F.lit(tech).alias("technique"), F.lit(k).alias("k")))
        runs.append(M.attach(truth, prior, []).select("prediction", "label", F.lit("None").alias("technique"), F.lit(k).alias("k")))
    allr = runs[0]
    for r in runs[1:]:
        allr = allr.unionByName(r)
    f1 = M.macro_prf(allr, ["technique", "k"])
    out = M.pivot_mean(f1, "technique", "k", "f1_score", [4, 8], digits=6)
    return out.select("technique", F.col("4").cast("double").alias("k4"), F.col("8").cast("double").alias("k8"))


def _vote_sql(k: int, per_label: bool, tag: str) -> str:
    part = "qid, tlabel" if per_label else "qid"
    lim = k // 2 if per_label else k
    return f"""SELECT '{tag}' AS technique, {k} AS k, qid, tlabel, score FROM (
      SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, tid) AS rk FROM s) WHERE rk <= {lim}"""


query("run_comparison", f"""WITH {PAIRS},
nn AS ({_vote_sql(4, False, 'closest')} UNION ALL {_vote_sql(4, True, 'contrastive')}
       UNION ALL {_vote_sql(8, False, 'closest')} UNION ALL {_vote_sql(8, True, 'contrastive')}),
w AS (SELECT technique, k, qid, tlabel, sum(score) AS w FROM nn GROUP BY ALL),
b AS (SELECT technique, k, qid, tlabel AS prediction FROM (
        SELECT *, row_number() OVER (PARTITION BY technique, k, qid ORDER BY w DESC, tlabel ASC) AS rr FROM w) WHERE rr = 1),
preds AS (SELECT b.technique, b.k, b.prediction, e.label FROM b JOIN e ON e.vec_id = b.qid
  UNION ALL SELECT 'None', z.k, (SELECT label FROM e WHERE vec_id % 10 <> 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), e.label
  FROM e, (VALUES (4), (8)) z(k) WHERE e.vec_id % 10 = 0),
pc AS (SELECT *,
    CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
    CASE WHEN support + predicted = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (support + predicted) END AS f1
  FROM (SELECT technique, k, cls, sum(t) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (
    SELECT technique, k, label AS cls, 1 AS t, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS tp FROM preds
    UNION ALL SELECT technique, k, prediction, 0, 1, 0 FROM preds) GROUP BY ALL)),
f AS (SELECT technique, k, avg(f1) AS f1 FROM pc GROUP BY ALL)
SELECT technique, round_even(max(CASE WHEN k = 4 THEN f1 END), 6) AS k4,
       round_even(max(CASE WHEN k = 8 THEN f1 END), 6) AS k8 FROM f GROUP BY technique""")(run_comparison_q)


# K5 from result files --------------------------------------------------------
RUN_MODELS = tuple(f"{t}_{k}" for t in ("closest", "contrastive", "None") for k in (4, 8))


def report_comparison_q(spark, sf):
    """Every run of the grid (three techniques, two K) lands its report as a
    text file; the files are read back and compared by macro F1."""
    p = B.preds(spark, sf, RUN_MODELS)
    parts = F.split("model", "_")
    key = PR.run_key(parts[0], parts[1], F.concat(F.lit("en-"), F.upper("variety")), F.col("task"), F.col("domain"))
    rep = M.classification_report(p.withColumn("run", key), ["run"])
    root = RP.write_reports(RP.report_documents(rep, ["run"], digits=6), FS.scratch_path(spark, "reports"))
    runs = RP.compare_runs(RP.parse_reports(RP.read_reports(spark, root)))
    return M.pivot_matrix(runs, ["technique", "variety", "task", "source"], "k", "f1_score") \
        .select("technique", "variety", "task", "source", F.col("4").alias("k4"), F.col("8").alias("k8"))


def _report_comparison_sql():
    group = ["model", "variety", "task", "domain"]
    return f"""WITH {B.preds_cte(RUN_MODELS)},
pc AS ({per_class_sql(class_counts_sql('preds', group))}),
f AS (SELECT {', '.join(group)}, CAST(printf('%.6f', avg(f1)) AS DOUBLE) AS f1 FROM pc GROUP BY ALL)
SELECT string_split(model, '_')[1] AS technique, 'en-' || upper(variety) AS variety, task, domain AS source,
  max(CASE WHEN string_split(model, '_')[2] = '4' THEN f1 END) AS k4, max(CASE WHEN string_split(model, '_')[2] = '8' THEN f1 END) AS k8
FROM f GROUP BY ALL"""


query("report_comparison", _report_comparison_sql())(report_comparison_q)


# M6 ------------------------------------------------------------------------
def softmax_argmax_q(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("z"))
    p = PR.softmax(F.col("z"))
    return e.select("vec_id", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"),
                    PR.argmax(F.col("z")).cast("long").alias("argmax"))


query("softmax_argmax", """WITH z AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z FROM embeddings),
p AS (SELECT vec_id, z, list_transform(z, lambda v: exp(v - list_max(z))) AS ex FROM z)
SELECT vec_id, round(ex[1] / list_sum(ex), 6) AS p0, round(ex[2] / list_sum(ex), 6) AS p1,
       CAST(list_position(z, list_max(z)) - 1 AS BIGINT) AS argmax FROM p""")(softmax_argmax_q)


# M7 ------------------------------------------------------------------------
def l2_dot_q(spark, sf):
    e = read_table(spark, sf, "embeddings")
    v = F.col("embedding")
    rot = F.concat(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
    n = KN.l2_normalize(v)
    return e.select("vec_id", F.round(F.sqrt(KN.dot(v, v)), 6).alias("norm"),
                    F.round(KN.dot(v, rot), 6).alias("dot_rotated"),
                    F.round(KN.dot(n, n), 6).alias("unit_norm_sq"))


query("l2_normalize_dot", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS nm FROM e)
SELECT vec_id, round(nm, 6) AS norm,
  round(list_dot_product(v, list_concat(v[2:], v[1:1])), 6) AS dot_rotated,
  round(list_dot_product(list_transform(v, lambda x: CASE WHEN nm = 0 THEN x ELSE x / nm END),
                         list_transform(v, lambda x: CASE WHEN nm = 0 THEN x ELSE x / nm END)), 6) AS unit_norm_sq
FROM n""")(l2_dot_q)


# M8 ------------------------------------------------------------------------
MAX_LEN = 256


def truncate_pad_q(spark, sf):
    d = read_table(spark, sf, "documents")
    toks = F.split(T.normalize_ws("text"), " ")
    tp = PR.truncate_pad(toks, MAX_LEN)
    return d.select("doc_id", F.size(tp["tokens"]).cast("long").alias("n"),
                    F.aggregate(tp["mask"], F.lit(0), lambda a, x: a + x).cast("long").alias("n_real"),
                    F.element_at(tp["tokens"], MAX_LEN).alias("last_token"))


_toks = f"string_split({S.normalize_ws('text')}, ' ')"
query("truncate_pad", f"""WITH t AS (SELECT doc_id, {_toks} AS toks FROM documents)
SELECT doc_id, CAST({MAX_LEN} AS BIGINT) AS n, CAST(least(len(toks), {MAX_LEN}) AS BIGINT) AS n_real,
  CASE WHEN len(toks) >= {MAX_LEN} THEN toks[{MAX_LEN}] ELSE '[PAD]' END AS last_token FROM t""")(truncate_pad_q)


# G4 ------------------------------------------------------------------------
def seeded_shuffle_q(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    r = SP.stratum_rank(d, ["lang"], "doc_id", seed=42)
    return r.select("doc_id", "lang", F.col("_rank").cast("long").alias("position"))


query("seeded_shuffle", """SELECT doc_id, lang,
  CAST(row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '42'), doc_id) - 1 AS BIGINT) AS position
FROM documents""")(seeded_shuffle_q)


# F2 ------------------------------------------------------------------------
def topk_per_group_q(spark, sf):
    d = read_table(spark, sf, "documents")
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return d.select("lang", "doc_id", "n_chars", F.row_number().over(w).alias("rk")) \
        .where(F.col("rk") <= 3).select("lang", "doc_id", "n_chars", F.col("rk").cast("long").alias("rk"))


query("topk_per_group", """SELECT lang, doc_id, n_chars, CAST(rk AS BIGINT) AS rk FROM (
  SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rk
  FROM documents) WHERE rk <= 3""")(topk_per_group_q)
