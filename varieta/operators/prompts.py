"""Prompt building and generation-log operators.

Prompts are assembled with ``concat``/``array_join`` over at most K example
rows per query (a bound set by K), never with Python string formatting per
row.  Templates are split on their ``{}`` slots once, on the driver, so the
text itself is never interpreted as a pattern.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_binary_label

# --- fixed values: task instructions and prompt scaffolding of the few-shot study
SENTIMENT_PROMPT = """Generate the sentiment of the given text.
1 for positive sentiment, and 0 for negative sentiment. Do not give an explanation.
"""
SARCASM_PROMPT = """Predict if the given text is sarcastic.
1 if the text is sarcastic, and 0 if the text is not sarcastic. Do not give an explanation."""
EXAMPLES_HEADER = "Here is examples of sentences and their labels : \n"
TURN_INTRO = "Now it is your turn.\nText: "
LABEL_CUE = "\nLabel:"


def fill_prompt(template: str, *cols) -> Column:
    """K1: ``{}`` slots filled in order; other brace forms are rejected."""
    if "{{" in template or "}}" in template:
        raise ValueError("only bare {} slots are supported")
    parts = template.split("{}")
    if len(parts) - 1 != len(cols):
        raise ValueError(f"template has {len(parts) - 1} slots, got {len(cols)} columns")
    pieces = [F.lit(parts[0])]
    for c, lit in zip(cols, parts[1:]):
        pieces += [F.col(c) if isinstance(c, str) else c, F.lit(lit)]
    return F.concat(*pieces)


def few_shot_prompts(examples: DataFrame, queries: DataFrame, prefix: str, *, q_id: str = "qid",
                     position: str = "position", ex_text: str = "ex_text", ex_label: str = "ex_label",
                     q_text: str = "q_text") -> DataFrame:
    """K2 (+F1): prefix, ``## Example i`` blocks in ``position`` order, then
    the turn for the query.  ``examples`` has at most K rows per query."""
    block = F.concat(F.lit("## Example "), F.col("n").cast("string"), F.lit("\nText: "),
                     F.col(ex_text), F.lit("\nLabel: "), F.col(ex_label).cast("string"), F.lit("\n\n"))
    numbered = examples.withColumn(
        "n", F.row_number().over(Window.partitionBy(q_id).orderBy(position)))
    per_q = numbered.groupBy(q_id).agg(
        F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("_bs"))
    shots = per_q.select(q_id, F.concat(F.lit(EXAMPLES_HEADER),
                                        F.array_join(F.transform("_bs", lambda s: s["b"]), "")).alias("_ex"))
    j = queries.join(shots, q_id, "left")
    prompt = F.when(F.col("_ex").isNull(),
                    F.concat(F.lit(prefix + "\nText: "), F.col(q_text), F.lit(LABEL_CUE))) \
        .otherwise(F.concat(F.lit(prefix + "\n\n"), F.col("_ex"), F.lit("\n" + TURN_INTRO),
                            F.col(q_text), F.lit(LABEL_CUE)))
    return j.select("*", prompt.alias("prompt")).drop("_ex")


def collect_results(df: DataFrame, raw: str = "raw", label: str = "label",
                    keep: Sequence[str] = ("variety", "domain")) -> DataFrame:
    """K3: parse outputs; unparsed (-1) rows are removed from scoring but
    counted (``n_unparsed``) so coverage is visible."""
    p = df.withColumn("prediction", parse_binary_label(raw))
    return p.withColumn("is_correct", F.col("prediction") == F.col(label)) \
        .withColumn("parsed", F.col("prediction") != -1)


def run_key(technique, k, variety, task, source) -> Column:
    """K4: ``{technique}_{K}_{variety}_{task}_{source}_few_shots_results``."""
    return F.concat_ws("_", technique, k.cast("string") if isinstance(k, Column) else F.lit(str(k)),
                       variety, task, source, F.lit("few_shots_results"))


RUN_KEY_PATTERN = r"^([^_]+)_(\d+)_([^_]+)_([^_]+)_([^_]+)_few_shots_results$"


def parse_run_key(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    names = ("technique", "k", "variety", "task", "source")
    return F.struct(*[F.regexp_extract(c, RUN_KEY_PATTERN, i + 1).alias(n) for i, n in enumerate(names)])


def softmax(logits) -> Column:
    """M6: probabilities from logits (stable: subtract the max)."""
    z = F.transform(F.col(logits) if isinstance(logits, str) else logits, lambda v: v.cast("double"))
    # row constants (max, sum) paired with the elements, not re-evaluated
    # inside a lambda once per element
    mx = F.array_repeat(F.array_max(z), F.size(z))
    e = F.zip_with(z, mx, lambda v, m: F.exp(v - m))
    s = F.array_repeat(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), F.size(z))
    return F.zip_with(e, s, lambda v, t: v / t)


def argmax(arr) -> Column:
    """First index (0-based) of the maximum, as numpy's argmax."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.array_position(a, F.array_max(a)) - 1


def truncate_pad(tokens, n: int, pad: str = "[PAD]") -> Column:
    """M8: tokens cut or padded to exactly ``n``; returns struct(ids, mask)."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    cut = F.slice(t, 1, n)
    padded = F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(cut), F.lit(0))))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(cut)),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(n) - F.size(cut), F.lit(0))))
    return F.struct(padded.alias("tokens"), mask.alias("mask"))
