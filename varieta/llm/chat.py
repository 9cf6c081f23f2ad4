"""Chat formatting with typed content parts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of this and of common other templates.  A text
# may hold them; a backslash after the first sign marks it as plain text.
_CONTROL = r"\|[A-Za-z0-9_:/]{1,64}\|>|/?s>|/?SYS>|/?INST\]"
_ESCAPE = rf"([<\[])(\\*)({_CONTROL})"
_UNESCAPE = rf"([<\[])\\(\\*)({_CONTROL})"

PART_TYPE = ("array<struct<kind:string,text:string,uri:string,width:int,height:int,"
             "seconds:double,pages:int>>")


def escape(col) -> Column:
    """Add one backslash inside every control string, escaped or not."""
    return F.regexp_replace(col, F.lit(_ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(col) -> Column:
    """Take that one backslash away again."""
    return F.regexp_replace(col, F.lit(_UNESCAPE), F.lit("$1$2$3"))


def text_parts(text) -> Column:
    """A plain text as an array of one text part; null is the empty text."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("width"),
                            F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"),
                            F.lit(None).cast("int").alias("pages")))


def part_tokens(p: Column, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 256) -> Column:
    """Tokens that a placeholder expands to: image patches, audio frames, pages."""
    def up(x):
        return F.ceil(F.coalesce(x, F.lit(0)))
    return F.when(p["kind"] == "image", up(p["width"] / patch) * up(p["height"] / patch)) \
        .when(p["kind"] == "audio", up(p["seconds"] * audio_rate)) \
        .when(p["kind"] == "document", up(p["pages"]) * page_tokens).otherwise(0).cast("long")


def visit_part(p: Column) -> Column:
    """A text part as escaped text, any other part as its placeholder."""
    known = p["kind"].isin("image", "audio", "document")
    return F.when(known, F.concat(F.lit("<|"), p["kind"], F.lit("|>"))) \
        .otherwise(escape(F.coalesce(p["text"], F.lit(""))))


def format_chats(turns: DataFrame, **token_options) -> DataFrame:
    """``turns(conv_id, turn, role, parts)`` -> one formatted row per conversation.

    Returns conv_id, n_turns, formatted, loss_spans (array of start, length in
    code points of the assistant contents), attachments (array of turn, kind,
    uri, tokens, in the order of their placeholders) and expanded_tokens.

    Offsets are running sums over a conversation's turns; the grouping uses
    the window's partitioning, so the turns are shuffled once.  One output row
    holds one conversation, as the output format needs.

    Null roles and texts are empty, null parts or an empty array give an empty
    content, a part of unknown kind counts as text; turns are ordered by
    (turn, role, content), a null turn first, so ties and repeated rows are
    kept and have one order; null conv_ids are one conversation; other columns
    are ignored; no rows give no rows."""
    parts = F.coalesce(F.col("parts"), F.from_json(F.lit("[]"), PART_TYPE))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.array_join(F.transform(parts, visit_part), "").alias("_body"),
                     F.transform(F.filter(parts, lambda p: p["kind"].isin("image", "audio", "document")),
                                 lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"),
                                                    part_tokens(p, **token_options).alias("tokens"))).alias("_refs"))
    head = F.concat(F.lit(TURN), escape("role"), F.lit(TEXT))
    t = t.withColumn("_head", head).withColumn("_segment", F.concat("_head", "_body", F.lit(END)))
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "_body")
    t = t.withColumn("_rank", F.row_number().over(line)) \
        .withColumn("_start", F.sum(F.length("_segment").cast("long")).over(
            line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("_segment"))
    one = F.struct(F.col("_rank").alias("rank"), F.col("turn"), F.col("_segment").alias("segment"), F.col("_refs").alias("refs"),
                   (F.col("role") == "assistant").alias("loss"),
                   (F.col("_start") + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length"))
    g = t.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(one)).alias("_turns"))
    refs = F.flatten(F.transform("_turns", lambda x: F.transform(x["refs"], lambda r: F.struct(
        x["turn"].alias("turn"), r["kind"].alias("kind"), r["uri"].alias("uri"), r["tokens"].alias("tokens")))))
    spans = F.transform(F.filter("_turns", lambda x: x["loss"]),
                        lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return g.select("conv_id", "n_turns",
                    F.array_join(F.transform("_turns", lambda x: x["segment"]), "").alias("formatted"),
                    spans.alias("loss_spans"), refs.alias("attachments")) \
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, r: a + r["tokens"]))


def read_turns(formatted) -> Column:
    """Turns (role, text) read back from a formatted conversation of text parts."""
    def turn(s):
        cut = F.split(F.substring_index(s, END, 1), r"<\|text\|>", 2)
        return F.struct(unescape(cut[0]).alias("role"), unescape(cut[1]).alias("text"))
    return F.transform(F.slice(F.split(formatted, r"<\|turn\|>"), F.lit(2), F.greatest(
        F.lit(0), F.size(F.split(formatted, r"<\|turn\|>")) - 1)), turn)


def read_loss(formatted, spans) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chat_digest(formatted: DataFrame) -> DataFrame:
    """The digest row of each formatted conversation, read back from it."""
    turns = read_turns(F.col("formatted"))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    d = formatted.withColumn("_loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    return d.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
                    F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))


# The digest for DuckDB: the contract's columns from the table; the formatted
# length from the same escape rule.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *,
  regexp_replace(role, '([<\[])(\\*)(\|[A-Za-z0-9_:/]{1,64}\|>|/?s>|/?SYS>|/?INST\])', '\1\\\2\3', 'g') AS erole,
  regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_:/]{1,64}\|>|/?s>|/?SYS>|/?INST\])', '\1\\\2\3', 'g') AS etext FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, etext)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, etext) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(erole) + length(etext) + 8 + 8 + 7) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
