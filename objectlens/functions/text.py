"""Parsing of model output and conversation texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTE_KEYS = ("category", "color", "material", "shape", "texture")


def fenced_json(raw: Column) -> Column:
    """The text inside a json fence, else inside a plain fence, else the text itself."""
    inner = F.when(raw.contains("```json"), F.split(F.split(raw, "```json", 2)[1], "```", 2)[0]).when(raw.contains("```"), F.split(raw, "```", 3)[1]).otherwise(raw)
    return F.trim(inner)


def attributes(raw: Column) -> Column:
    """Parsed attributes, or the raw output and an error."""
    fields = ", ".join(f"{k} string" for k in ATTRIBUTE_KEYS)
    parsed = F.from_json(fenced_json(raw), fields)
    good = F.try_parse_json(fenced_json(raw)).isNotNull()
    return F.struct(*[F.when(good, parsed[k]).alias(k) for k in ATTRIBUTE_KEYS], F.when(~good, raw).alias("raw_output"), F.when(~good, F.lit("json_parse_failed")).alias("error"))


def attribute_text(*values: Column) -> Column:
    """Known values in order, one space between; empty and "unknown" ones are skipped."""
    return F.array_join(F.filter(F.array(*values), lambda v: v.isNotNull() & (v != "") & (v != "unknown")), " ")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _between(text: Column, tag: str) -> Column:
    """Behind the last opening tag (or from the beginning) up to the closing one (or the end), stripped."""
    return _stripped(F.substring_index(F.substring_index(text, f"<{tag}>", -1), f"</{tag}>", 1))


def tool_call(text: Column) -> Column:
    """The call in what stands before the first closing tool tag, from the last opening one on; a doubled closing brace is mended."""
    return F.replace(_between(F.substring_index(text, "</tool>", 1), "tool"), F.lit("}}}"), F.lit("}}"))


def verdict(text: Column, strict: bool = False) -> Column:
    """Accept or Reject, whichever the last verdict tag (or the whole text) holds.

    With both or neither the result is null; strict raises then.
    """
    inner = _between(text, "verdict")
    yes, no = inner.contains("Accept"), inner.contains("Reject")
    other = F.raise_error(F.concat(F.lit("verdict is neither Accept nor Reject: "), text)) if strict else F.lit(None)
    return F.when(yes & ~no, "Accept").when(no & ~yes, "Reject").otherwise(other.cast("string"))


def segment_call(role: Column, text: Column) -> Column:
    """Whether a turn is the assistant's and calls the segmentation tool."""
    return (role == "assistant") & text.contains("<tool>") & text.contains("segment_phrase")


def count_images(kinds: Column) -> Column:
    """Images among the kinds of a message's content items; other than a list counts as none."""
    return F.coalesce(F.size(F.filter(kinds, lambda k: k == "image")), F.lit(0))


def used_before(prompts: Column, latest: Column) -> Column:
    """Prompts used before, without the latest one."""
    return F.when(F.coalesce(latest, F.lit("")) != "", F.filter(prompts, lambda p: p != latest)).otherwise(prompts)


# The wording of the second turn where prompts were used before.
_ASKED = "The above image is the raw input image. The initial user input query is: '%s'."
_WARNING = (
    'Note that we have previously called the segment_phrase tool with each "text_prompt" in this list: [%s], but none of the generated results were satisfactory. '
    'So make sure that you do not use any of these phrases as the "text_prompt" to call the segment_phrase tool again.'
)


def warned(query: Column, used: Column) -> Column:
    """The second turn's text that warns of prompts used before."""
    listed = F.array_join(F.transform(used, lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", ")
    return F.concat_ws(" ", F.format_string(_ASKED, query), F.format_string(_WARNING, listed))


def canonical(text: Column) -> Column:
    """Lower case, no punctuation but inner spaces, white space collapsed."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, "_", " ")), r"[^a-z0-9 \n\t]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def prune_messages(turns: DataFrame, marker: Column) -> DataFrame:
    """The first two turns, and everything from the last marked later turn on; without one, the first two alone."""
    w = Window.partitionBy("conv_id")
    ranked = turns.withColumn("_rank", F.row_number().over(w.orderBy("turn"))).withColumn("_mark", marker)
    last = F.max(F.when(F.col("_mark") & (F.col("_rank") > 2), F.col("_rank"))).over(w)
    return ranked.withColumn("_last", last).where("_rank <= 2 OR _rank >= _last").drop("_last", "_rank", "_mark")
