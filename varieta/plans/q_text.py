"""Registered text-function and row-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.patterns import sql_str as q
from ..session import read_table
from . import bindings as B
from . import sqltext as S
from .registry import query

NOISY_SQL = B.noisy_cte()


def _on_noisy(name: str, spark_fn, sql_fn):
    def run(spark, sf):
        return B.noisy(spark, sf).select("doc_id", spark_fn(F.col("text")).alias("out"))
    sql = f"WITH {NOISY_SQL} SELECT doc_id, {sql_fn('text')} AS out FROM noisy"
    query(name, sql)(run)


# C1 ------------------------------------------------------------------------
def remove_urls_q(spark, sf):
    n = B.noisy(spark, sf)
    return n.select("doc_id", T.remove_urls("text").alias("out"),
                    T.remove_urls("text", " ").alias("out_space"),
                    T.remove_urls("text", loose=True).alias("out_loose"))


query("remove_urls", f"""WITH {NOISY_SQL}
SELECT doc_id, {S.remove_urls('text')} AS out, {S.remove_urls('text', ' ')} AS out_space,
       {S.remove_urls('text', loose=True)} AS out_loose FROM noisy""")(remove_urls_q)

_on_noisy("remove_emoji", T.remove_emoji, S.remove_emoji)                          # C2
_on_noisy("fix_text", lambda c: T.fix_text_subset(T.fix_mojibake(T.unescape_html(c))),             # C3
          lambda x: S.fix_text_subset(S.fix_mojibake(S.unescape_html(x))))
_on_noisy("fix_contractions", T.fix_contractions, S.fix_contractions)              # C4
_on_noisy("strip_gifs", T.strip_gifs, S.strip_gifs)                                # C5
_on_noisy("unwrap_links", T.unwrap_links, S.unwrap_links)                          # C6
_on_noisy("collapse_newlines", T.collapse_newlines, S.collapse_newlines)           # C8
_on_noisy("normalize_ws", T.normalize_ws, S.normalize_ws)                          # C10
_on_noisy("ascii_only", T.ascii_only, S.ascii_only)                                # C16


# C7 ------------------------------------------------------------------------
def remove_unbalanced_q(spark, sf):
    n = B.noisy(spark, sf)
    return n.select("doc_id", *[T.remove_unbalanced("text", o, c).alias(f"out_{nm}")
                                for (o, c), nm in zip((("[", "]"), ("(", ")"), ("{", "}")),
                                                      ("square", "round", "curly"))])


query("remove_unbalanced", f"""WITH {NOISY_SQL}
SELECT doc_id, {S.remove_unbalanced('text', '[', ']')} AS out_square,
       {S.remove_unbalanced('text', '(', ')')} AS out_round,
       {S.remove_unbalanced('text', '{', '}')} AS out_curly FROM noisy""")(remove_unbalanced_q)


# C9 ------------------------------------------------------------------------
def clean_text_q(spark, sf):
    return T.clean_text(B.noisy(spark, sf), "text", "out").select("doc_id", "out")


query("clean_text", f"WITH {NOISY_SQL} SELECT doc_id, {S.clean_text('text')} AS out FROM noisy")(clean_text_q)


# C11 / C12 -----------------------------------------------------------------
def tokenize_words_q(spark, sf):
    d = read_table(spark, sf, "documents")
    words = T.tokenize_words("text")
    sym = T.tokenize_words("text", with_symbols=True)
    return d.select("doc_id", F.size(words).cast("long").alias("n_words"),
                    F.array_join(words, "|").alias("words"),
                    F.size(sym).cast("long").alias("n_with_symbols"))


query("tokenize_words", f"""SELECT doc_id, CAST(len({S.tokenize_words('text')}) AS BIGINT) AS n_words,
  array_to_string({S.tokenize_words('text')}, '|') AS words,
  CAST(len({S.tokenize_words('text', True)}) AS BIGINT) AS n_with_symbols FROM documents""")(tokenize_words_q)


def eligible_tokens_q(spark, sf):
    d = read_table(spark, sf, "documents")
    tok = T.tokenize_words("text")
    return d.select("doc_id", F.array_join(T.eligible_tokens(tok), "|").alias("detector"),
                    F.array_join(T.eligible_tokens(T.tokenize_words("text", True), 3, True), "|")
                    .alias("helper"))


query("eligible_tokens", f"""SELECT doc_id,
  array_to_string({S.eligible_tokens(S.tokenize_words('text'))}, '|') AS detector,
  array_to_string({S.eligible_tokens(S.tokenize_words('text', True), 3, True)}, '|') AS helper
FROM documents""")(eligible_tokens_q)


# Generated outputs built from conversation turns ----------
def _raw_outputs(spark, sf):
    c = read_table(spark, sf, "conversations")
    k = (F.col("turn") % 5).cast("int")
    raw = (F.when(k == 0, F.concat(F.lit("<s>[INST] classify [/INST] "), "text"))
           .when(k == 1, F.concat("text", F.lit("<end_of_turn>")))
           .when(k == 2, F.concat(F.lit("<end_of_turn>model "), "text", F.lit(" or neutral")))
           .when(k == 3, F.concat(F.lit("Label: "), F.col("role"), F.lit(". "), "text"))
           .otherwise(F.col("text")))
    return c.select("conv_id", "turn", raw.alias("raw"))


RAW_SQL = """raw AS (SELECT conv_id, turn, CASE CAST(turn % 5 AS INTEGER)
    WHEN 0 THEN '<s>[INST] classify [/INST] ' || text
    WHEN 1 THEN text || '<end_of_turn>'
    WHEN 2 THEN '<end_of_turn>model ' || text || ' or neutral'
    WHEN 3 THEN 'Label: ' || role || '. ' || text
    ELSE text END AS raw FROM conversations)"""


def post_process_q(spark, sf):
    return _raw_outputs(spark, sf).select("conv_id", "turn", T.post_process_output("raw").alias("out"))


query("post_process_output",
      f"WITH {RAW_SQL} SELECT conv_id, turn, {S.post_process_output('raw')} AS out FROM raw")(post_process_q)


def extract_answer_q(spark, sf):
    return _raw_outputs(spark, sf).select("conv_id", "turn", T.extract_answer("raw", "Label:").alias("out"))


query("extract_answer", f"""WITH {RAW_SQL}
SELECT conv_id, turn, {S.strip_ws("CASE WHEN contains(raw, 'Label:') THEN substr(raw, strpos(raw, 'Label:') + 6) ELSE raw END")} AS out
FROM raw""")(extract_answer_q)


def parse_binary_label_q(spark, sf):
    c = read_table(spark, sf, "conversations")
    k = (F.col("turn") % 4).cast("int")
    out = (F.when(k == 0, F.lit(" 1 ")).when(k == 1, F.lit("0"))
           .when(k == 2, F.lit("Positive.")).otherwise(F.col("text")))
    return c.select("conv_id", "turn", out.alias("raw")).select(
        "conv_id", "turn", "raw", T.parse_binary_label("raw").alias("label"))


query("parse_binary_label", f"""WITH r AS (SELECT conv_id, turn, CASE CAST(turn % 4 AS INTEGER)
    WHEN 0 THEN ' 1 ' WHEN 1 THEN '0' WHEN 2 THEN 'Positive.' ELSE text END AS raw
    FROM conversations)
SELECT conv_id, turn, raw, CASE {S.strip_ws('raw')} WHEN '1' THEN 1 WHEN '0' THEN 0 ELSE -1 END AS label
FROM r""")(parse_binary_label_q)


# C15 / C18 -----------------------------------------------------------------
def author_id_q(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", T.author_id("url").alias("author"),
                    T.path_part("url", 3).alias("host"), T.file_stem("url").alias("stem"),
                    T.model_short_name("url").alias("last_part"))


query("author_id", r"""SELECT page_id,
  CASE WHEN len(string_split(url, '/')) >= 2 THEN (string_split(url, '/'))[-2] END AS author,
  (string_split(url, '/'))[3] AS host,
  regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem,
  (string_split(url, '/'))[-1] AS last_part
FROM pages""")(author_id_q)


# M10 / C19 -----------------------------------------------------------------
def json_fields_q(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id",
                    T.default_to(F.get_json_object("props", "$.k"), "unknown").alias("k"),
                    T.default_to(F.get_json_object("props", "$.missing"), "N/A").alias("missing"),
                    F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)).cast("long")
                    .alias("k_num"))


query("json_fields", """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'unknown') AS k,
  coalesce(json_extract_string(props, '$.missing'), 'N/A') AS missing,
  CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS BIGINT) AS k_num
FROM events""")(json_fields_q)


# B1 ------------------------------------------------------------------------
def task_projection_q(spark, sf):
    return R.task_projection(B.ann(spark, sf)).select("id", "text", "task", "label")


query("task_projection", f"""WITH {B.ANN_CTE}
SELECT id, text, 'Sentiment' AS task, sentiment_label AS label FROM ann
UNION ALL SELECT id, text, 'Sarcasm', sarcasm_label FROM ann""")(task_projection_q)


# B2 / B3 / B4 --------------------------------------------------------------
def drop_discarded_q(spark, sf):
    return R.drop_discarded(B.ann(spark, sf)).select("id", "variety", "domain", "sentiment_label",
                                                    "sarcasm_label")


query("drop_discarded", f"""WITH {B.ANN_CTE}
SELECT id, variety, domain, sentiment_label, sarcasm_label FROM ann
WHERE sentiment_label <> 2 AND id IS NOT NULL AND text IS NOT NULL AND variety IS NOT NULL
  AND domain IS NOT NULL AND sarcasm_label IS NOT NULL AND quality IS NOT NULL AND n_chars IS NOT NULL""")(drop_discarded_q)


def _docs_left_labels(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return d.join(read_table(spark, sf, "labels"), "doc_id", "left")


def drop_any_null_q(spark, sf):
    return _docs_left_labels(spark, sf).na.drop("any").select("doc_id", "lang", "quality", "toxic")


query("drop_any_null", """SELECT d.doc_id, d.lang, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NOT NULL AND d.lang IS NOT NULL AND d.n_chars IS NOT NULL
  AND l.quality IS NOT NULL AND l.toxic IS NOT NULL""")(drop_any_null_q)


def drop_null_subset_q(spark, sf):
    return _docs_left_labels(spark, sf).na.drop(subset=["quality"]).select("doc_id", "quality")


query("drop_null_subset", """SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l
ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL""")(drop_null_subset_q)


# B5 ------------------------------------------------------------------------
def slice_dataset_q(spark, sf):
    t = B.task_rows(spark, sf)
    a = R.slice_dataset(t, "Sentiment", "en", "Reddit").withColumn("slice", F.lit("en/Reddit"))
    b = R.slice_dataset(t, "Sarcasm", "fr", "BOTH").withColumn("slice", F.lit("fr/BOTH"))
    return a.unionByName(b).select("slice", "id", "label")


query("slice_dataset", f"""WITH {B.TASKS_CTE}
SELECT 'en/Reddit' AS slice, id, label FROM tasks WHERE task = 'Sentiment' AND variety = 'en' AND domain = 'Reddit'
UNION ALL SELECT 'fr/BOTH', id, label FROM tasks WHERE task = 'Sarcasm' AND variety = 'fr'""")(slice_dataset_q)


# B6 / D7 -------------------------------------------------------------------
# --- fixed values: per-country minimum (strict) for the config theta join
CITY_THRESHOLDS = (("NATION_1", 1000.0), ("NATION_7", 5000.0), ("NATION_12", 2500.0))


def filter_cities_q(spark, sf):
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("country"), F.col("c_name").alias("city"),
        F.col("c_acctbal").alias("population"), ((F.col("c_custkey") % 179) - 89).alias("lat"),
        (F.col("c_nationkey") * 7 - 90).alias("lng"))
    cfg = spark.createDataFrame(list(CITY_THRESHOLDS), "country string, min_population double")
    return R.filter_cities(rows, cfg).select("country", "city", "location")


query("filter_cities", f"""WITH cfg(country, min_population) AS (VALUES {', '.join(f"({q(a)}, {b})" for a, b in CITY_THRESHOLDS)}),
rows AS (SELECT n.n_name AS country, c.c_name AS city, c.c_acctbal AS population,
                (c.c_custkey % 179) - 89 AS lat, c.c_nationkey * 7 - 90 AS lng
         FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT r.country, r.city, CAST(r.lat AS VARCHAR) || ',' || CAST(r.lng AS VARCHAR) AS location
FROM rows r JOIN cfg ON r.country = cfg.country AND r.population > cfg.min_population""")(filter_cities_q)


# B7 ------------------------------------------------------------------------
def binarize_rating_q(spark, sf):
    p = read_table(spark, sf, "part")
    rating = F.when(F.col("p_size") % 6 == 0, F.lit(float("nan"))) \
        .when(F.col("p_size") % 13 == 0, F.lit(None).cast("double")) \
        .otherwise((F.col("p_size") % 6).cast("double"))
    return p.select("p_partkey", R.binarize_rating(rating).alias("label"),
                    F.when(F.isnan(rating), F.lit("nan")).otherwise(rating.cast("string")).alias("rating"))


query("binarize_rating", """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN CAST('NaN' AS DOUBLE)
    WHEN p_size % 13 = 0 THEN NULL ELSE CAST(p_size % 6 AS DOUBLE) END AS rating FROM part)
SELECT p_partkey, CASE WHEN rating IS NULL OR isnan(rating) THEN 0 WHEN rating > 2 THEN 1 ELSE 0 END AS label,
       CASE WHEN isnan(rating) THEN 'nan' ELSE CAST(rating AS VARCHAR) END AS rating FROM r""")(binarize_rating_q)


# B8 ------------------------------------------------------------------------
# --- fixed values: display names for language codes (es left unmapped)
LANG_NAMES = (("en", "English"), ("fr", "French"), ("de", "German"))


def relabel_q(spark, sf):
    d = read_table(spark, sf, "documents")
    m = dict(LANG_NAMES)
    return d.select("doc_id", "lang", R.relabel("lang", m).alias("name_or_null"),
                    R.relabel("lang", m, keep_unmapped=True).alias("name_or_code"))


_case = " ".join(f"WHEN lang = {q(a)} THEN {q(b)}" for a, b in LANG_NAMES)
query("relabel", f"""SELECT doc_id, lang, CASE {_case} END AS name_or_null,
  CASE {_case} ELSE lang END AS name_or_code FROM documents""")(relabel_q)


# B9 ------------------------------------------------------------------------
LINE_RULES = (
    ("quantity_range", "l_quantity BETWEEN 1 AND 50"),
    ("discount_ratio", "l_discount BETWEEN 0 AND 0.1"),
    ("tax_nonneg", "l_tax >= 0"),
    ("price_positive", "l_extendedprice > 0"),
    ("flag_known", "l_returnflag IN ('A', 'N', 'R')"),
)


def quality_gate_q(spark, sf):
    li = read_table(spark, sf, "lineitem")
    rules = [(nm, F.expr(cond)) for nm, cond in LINE_RULES]
    gated = R.quality_gate(li, rules)
    return R.gate_report(gated).select("rule", F.col("n").cast("long").alias("n"))


_errs = ", ".join(f"CASE WHEN NOT coalesce({c}, FALSE) THEN {q(n)} END" for n, c in LINE_RULES)
query("quality_gate", f"""WITH g AS (SELECT list_filter([{_errs}], lambda e: e IS NOT NULL) AS errors FROM lineitem)
SELECT rule, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(errors) AS rule FROM g
  UNION ALL SELECT 'valid' AS rule FROM g WHERE len(errors) = 0) GROUP BY rule""")(quality_gate_q)


# B9 (requests and weights) ---------------------------------------------------
def request_gate_q(spark, sf):
    """Customers as search requests with class weights: the failed rules of each."""
    c = read_table(spark, sf, "customer").select(
        "c_custkey", ((F.col("c_custkey") % 241) - 120).alias("lat"), ((F.col("c_custkey") % 481) - 240).alias("lng"),
        F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal").cast("double")).alias("radius"), (F.col("c_custkey") % 25).alias("k"),
        (F.col("c_custkey") % 3).alias("w0"), (F.col("c_custkey") % 4).alias("w1"))
    gated = R.quality_gate(c, [*R.request_rules("lat", "lng", "radius", "k"), *R.weight_rules("w0", "w1")])
    return gated.select("c_custkey", F.array_join("errors", ",").alias("errors"))


query("request_gate", """SELECT c_custkey, array_to_string(list_filter([
  CASE WHEN NOT (c_custkey % 241) - 120 BETWEEN -90 AND 90 THEN 'lat_range' END,
  CASE WHEN NOT (c_custkey % 481) - 240 BETWEEN -180 AND 180 THEN 'lng_range' END,
  CASE WHEN c_custkey % 50 = 0 OR NOT coalesce(CAST(c_acctbal AS DOUBLE) > 0, FALSE) THEN 'radius_positive' END,
  CASE WHEN NOT c_custkey % 25 BETWEEN 1 AND 20 THEN 'max_results_range' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'weight_0_positive' END, CASE WHEN c_custkey % 4 = 0 THEN 'weight_1_positive' END],
  lambda e: e IS NOT NULL), ',') AS errors FROM customer""")(request_gate_q)


# B10 -----------------------------------------------------------------------
def soft_check_q(spark, sf):
    li = read_table(spark, sf, "lineitem")
    flag = R.soft_check((F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "N"))
    return li.select("l_returnflag", flag.alias("f")).groupBy("l_returnflag").agg(
        F.count("*").cast("long").alias("n"), F.sum(F.col("f").cast("long")).cast("long").alias("n_flagged"))


query("soft_check", """SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN coalesce(l_linestatus = 'O' AND l_returnflag <> 'N', FALSE) THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged
FROM lineitem GROUP BY l_returnflag""")(soft_check_q)


# B11 -----------------------------------------------------------------------
def _loc_strings(spark, sf):
    c = read_table(spark, sf, "customer")
    frac = F.lpad((F.floor(F.abs("c_acctbal")).cast("long") % 100).cast("string"), 2, "0")
    good = F.concat(((F.col("c_custkey") % 179) - 89).cast("string"), F.lit("."), frac, F.lit(","),
                    F.col("c_nationkey").cast("string"))
    loc = (F.when(F.col("c_custkey") % 7 == 0, F.lit("x,1"))
           .when(F.col("c_custkey") % 11 == 0, F.concat(good, F.lit(",3")))
           .otherwise(good))
    return c.select("c_custkey", loc.alias("location"))


LOC_SQL = """g AS (SELECT c_custkey, CAST((c_custkey % 179) - 89 AS VARCHAR) || '.'
    || lpad(CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ','
    || CAST(c_nationkey AS VARCHAR) AS good FROM customer),
locs AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'x,1'
    WHEN c_custkey % 11 = 0 THEN good || ',3' ELSE good END AS location FROM g)"""


def parse_location_q(spark, sf):
    p = R.parse_location("location")
    return _loc_strings(spark, sf).select("c_custkey", p["lat"].alias("lat"), p["lng"].alias("lng"),
                                          p["valid"].alias("valid"))


query("parse_location", f"""WITH {LOC_SQL},
p AS (SELECT c_custkey, string_split(location, ',') AS parts FROM locs)
SELECT c_custkey,
  CASE WHEN len(parts) = 2 AND TRY_CAST(parts[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(parts[2] AS DOUBLE) IS NOT NULL
       THEN TRY_CAST(parts[1] AS DOUBLE) END AS lat,
  CASE WHEN len(parts) = 2 AND TRY_CAST(parts[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(parts[2] AS DOUBLE) IS NOT NULL
       THEN TRY_CAST(parts[2] AS DOUBLE) END AS lng,
  coalesce(len(parts) = 2 AND TRY_CAST(parts[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(parts[2] AS DOUBLE) IS NOT NULL, FALSE) AS valid
FROM p""")(parse_location_q)


# B12 -----------------------------------------------------------------------
# --- fixed values: place types sent with every search request
PLACE_TYPES = ("restaurant", "cafe", "bar")


def build_requests_q(spark, sf):
    p = R.parse_location("location")
    locs = _loc_strings(spark, sf).select("c_custkey", p.alias("p")).where("p.valid")
    return locs.select("c_custkey", R.build_request(F.col("p.lat"), F.col("p.lng"), PLACE_TYPES)
                       .alias("request"))


_types = ", ".join(q(t) for t in PLACE_TYPES)
query("build_requests", f"""WITH {LOC_SQL},
p AS (SELECT c_custkey, string_split(location, ',') AS parts FROM locs),
v AS (SELECT c_custkey, TRY_CAST(parts[1] AS DOUBLE) AS lat, TRY_CAST(parts[2] AS DOUBLE) AS lng FROM p
      WHERE len(parts) = 2 AND TRY_CAST(parts[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(parts[2] AS DOUBLE) IS NOT NULL)
SELECT c_custkey, CAST(to_json({{'includedTypes': [{_types}], 'maxResultCount': 20,
  'locationRestriction': {{'circle': {{'center': {{'latitude': lat, 'longitude': lng}}, 'radius': 500.0}}}}}}) AS VARCHAR) AS request
FROM v""")(build_requests_q)


# B13 -----------------------------------------------------------------------
def add_row_id_q(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    return R.add_row_id(d, "doc_id", "row_id").select("doc_id", "lang", "row_id")


query("add_row_id", """SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_id
FROM documents""")(add_row_id_q)


# B14 -----------------------------------------------------------------------
def add_key_columns_q(spark, sf):
    t = B.task_rows(spark, sf)
    return t.select("id", F.lit("m1").alias("model"), F.initcap(F.lower("task")).alias("task"),
                    F.concat(F.lit("en-"), F.upper("variety")).alias("locale"),
                    F.concat_ws("->", "domain", F.lit("Reddit")).alias("domain_pair"),
                    (B.flip_prediction("id", "label", F.lit("m1")) == F.col("label")).alias("is_correct"))


query("add_key_columns", f"""WITH {B.TASKS_CTE}
SELECT id, 'm1' AS model, upper(substr(lower(task), 1, 1)) || substr(lower(task), 2) AS task,
       'en-' || upper(variety) AS locale, domain || '->' || 'Reddit' AS domain_pair,
       ({B.flip_sql('id', 'label', "'m1'")}) = label AS is_correct FROM tasks""")(add_key_columns_q)
