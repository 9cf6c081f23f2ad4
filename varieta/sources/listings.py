"""Landed API payloads -> flat rows.

The collectors themselves (HTTP, OAuth) are outside Spark; their JSON
responses land as files or a string column and are flattened here with
``from_json`` + ``explode`` against explicit schemas.  Bad rows are not
dropped silently: the gate returns them with the names of the failed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import quality_gate
from ..functions.text import author_id

POST_FIELDS = T.StructType([
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("upvote_ratio", T.DoubleType()),
    T.StructField("ups", T.IntegerType()),
    T.StructField("downs", T.IntegerType()),
    T.StructField("score", T.IntegerType()),
])
LISTING_SCHEMA = T.StructType([T.StructField("data", T.StructType([
    T.StructField("children", T.ArrayType(T.StructType([T.StructField("data", POST_FIELDS)]))),
]))])

REVIEW_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("authorAttribution", T.StructType([
        T.StructField("uri", T.StringType()), T.StructField("displayName", T.StringType())])),
    T.StructField("rating", T.IntegerType()),
    T.StructField("originalText", T.StructType([
        T.StructField("text", T.StringType()), T.StructField("languageCode", T.StringType())])),
    T.StructField("publishTime", T.StringType()),
]))

CONFIG_SCHEMA = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

# --- fixed values: defaults for missing post fields
POST_DEFAULTS = {"subreddit": "unknown", "title": "", "selftext": "", "upvote_ratio": 0.0,
                 "ups": 0, "downs": 0, "score": 0}


def flatten_posts(listings: DataFrame, json_col: str = "listing",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """A3: one row per post; missing fields get defaults; a listing without
    ``data.children`` yields no rows.  Adds ``errors`` (B9) and
    ``score_mismatch`` (B10)."""
    parsed = listings.select(*keep, F.from_json(F.col(json_col), LISTING_SCHEMA).alias("_l"))
    posts = parsed.select(*keep, F.explode(F.coalesce(F.col("_l.data.children"),
                                                     F.array().cast(LISTING_SCHEMA["data"].dataType["children"].dataType)))
                          .alias("_c"))
    flat = posts.select(*keep, *[F.coalesce(F.col(f"_c.data.{k}"), F.lit(v)).alias(k)
                                 for k, v in POST_DEFAULTS.items()])
    return gate_posts(flat)


def flatten_reviews(places: DataFrame, reviews_col: str = "reviews",
                    keep: tuple[str, ...] = ("place_id", "city")) -> DataFrame:
    """A4: reviews array -> (id, rating, review, city); author id is the
    second-last URI segment; rating must be 1..5 and the URI a URL."""
    rows = places.select(*keep, F.explode(F.col(reviews_col)).alias("_r"))
    uri = F.col("_r.authorAttribution.uri")
    flat = rows.select(*keep,
                       author_id(uri).alias("id"),
                       F.col("_r.rating").alias("rating"),
                       F.coalesce(F.col("_r.originalText.text"), F.lit("N/A")).alias("review"),
                       F.coalesce(F.col("_r.publishTime"), F.lit("")).alias("publish_time"),
                       uri.alias("uri"))
    rules = [("rating_range", F.col("rating").between(1, 5)),
             ("uri_is_url", F.col("uri").rlike("^https?://[^/]+/.+")),
             ("author_present", F.col("id").isNotNull() & (F.col("id") != ""))]
    return quality_gate(flat, rules)


POST_ID_FIELDS = T.StructType([T.StructField("id", T.StringType()), T.StructField("created_utc", T.DoubleType())])
LANDED_SCHEMA = T.StructType([
    T.StructField("data", T.StructType([
        # each child's post stays text here, so that one bad post does not spoil its listing
        T.StructField("children", T.ArrayType(T.StructType([T.StructField("data", T.StringType())])))])),
    T.StructField("_bad", T.StringType())])


def landed_posts(lines: DataFrame, value: str = "value") -> DataFrame:
    """A3 for landed polls: one JSON listing a line -> one row a post, or one
    row with a ``reject`` reason for what holds none.

    Columns: reject (null for posts), raw (rejected text alone), post_id,
    created (timestamp, null if missing) and the fields of ``POST_DEFAULTS``
    with their defaults.  Reasons: ``malformed`` (no JSON object),
    ``no_children`` (JSON without ``data.children``), ``bad_post`` (a field
    that does not fit its type; the other posts of the listing stay).  A post
    without id gets a hash of its texts.  Blank lines give no rows."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    at = lines.where(F.trim(value) != "").select(F.col(value).alias("_raw"), F.from_json(value, LANDED_SCHEMA, options).alias("_l"))
    reason = F.when(F.col("_l").isNull() | F.col("_l._bad").isNotNull(), F.lit("malformed")) \
        .when(F.col("_l.data.children").isNull(), F.lit("no_children"))
    posts = at.select("_raw", reason.alias("_why"), F.explode_outer(F.when(reason.isNull(), F.col("_l.data.children"))).alias("_c")) \
        .where(F.col("_why").isNotNull() | F.col("_c").isNotNull())
    fields = T.StructType([*POST_ID_FIELDS, *POST_FIELDS, T.StructField("_bad", T.StringType())])
    read = posts.select("_raw", "_why", F.col("_c.data").alias("_text"),
                        F.from_json(F.coalesce(F.col("_c.data"), F.lit("{}")), fields, options).alias("_p"))
    why = F.coalesce("_why", F.when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), F.lit("bad_post")))
    flat = read.select(why.alias("reject"), F.when(F.col("_why").isNotNull(), F.col("_raw")).when(why.isNotNull(), F.col("_text")).alias("raw"),
                       F.col("_p.id").alias("_id"), F.timestamp_millis((F.col("_p.created_utc") * 1000).cast("long")).alias("created"),
                       *[F.coalesce(F.col(f"_p.{k}"), F.lit(v)).alias(k) for k, v in POST_DEFAULTS.items()])
    own = F.concat(F.lit("h"), F.md5(F.concat_ws("\u0000", "subreddit", "title", "selftext")))
    return flat.select("reject", "raw", F.coalesce("_id", own).alias("post_id"), "created", *POST_DEFAULTS)


def gate_posts(posts: DataFrame) -> DataFrame:
    """B9 and B10 of posts: ``errors`` and ``score_mismatch``."""
    gated = quality_gate(posts, [("upvote_ratio_range", F.col("upvote_ratio").between(0.0, 1.0))])
    return gated.withColumn("score_mismatch", F.coalesce((F.col("downs") == 0) & (F.col("score") != F.col("ups")), F.lit(False)))


def tag_locale(posts: DataFrame, config: DataFrame) -> DataFrame:
    """Locale of each post by the (locale, subreddit) rows of ``config``: one
    row for each locale that lists the post's subreddit, null if none does."""
    return posts.join(config.select("locale", "subreddit").distinct(), "subreddit", "left")


def explode_config(df: DataFrame, json_col: str = "config") -> DataFrame:
    """A5: ``{locale: [subreddit, …]}`` -> (locale, subreddit) rows."""
    m = df.select(F.from_json(F.col(json_col), CONFIG_SCHEMA).alias("_m"))
    return m.select(F.explode("_m").alias("locale", "_subs")) \
        .select("locale", F.explode("_subs").alias("subreddit"))


def pack_listing(rows: DataFrame, key: Column, post: Column, page_size: int = 100) -> DataFrame:
    """Inverse of ``flatten_posts`` for landing/testing: groups posts into
    listing pages of at most ``page_size`` children (bounded groups)."""
    return (rows.groupBy(key.alias("_key"), F.floor(F.col("_ord") / page_size).alias("_page"))
            .agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(post.alias("data"))).alias("children"))
                                    .alias("data"))).alias("listing")))
