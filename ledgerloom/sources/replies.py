"""Replies of model services: flattening of message parts, and objects that must fit a schema exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

#: Names of the reply format that are read; anything else in a reply is ignored.
REPLY = "struct<output:array<struct<type:string,content:array<struct<type:string,text:string,annotations:array<map<string,string>>>>>>>"


def flatten(reply: Column) -> Column:
    """``struct(text, annotations, problem)`` of a JSON reply.

    The texts of all output parts of all messages are joined in order; their annotations are kept.
    ``problem`` is ``no output``, ``refusal`` (some part refuses) or ``no text``; text and annotations
    are null then.
    """
    output = F.from_json(reply, REPLY)["output"]
    messages = F.filter(output, lambda m: (m["type"] == "message") & m["content"].isNotNull())
    parts = F.filter(F.flatten(F.transform(messages, lambda m: m["content"])), lambda p: p.isNotNull())
    spoken = F.filter(parts, lambda p: p["type"] == "output_text")
    text = strip(F.concat_ws("", F.transform(spoken, lambda p: F.coalesce(p["text"], F.lit("")))))
    notes = F.flatten(F.transform(spoken, lambda p: F.coalesce(p["annotations"], F.array().cast("array<map<string,string>>"))))
    problem = F.when(output.isNull(), "no output").when(F.exists(parts, lambda p: p["type"] == "refusal"), "refusal").when(text == "", "no text")
    return F.struct(F.when(problem.isNull(), text).alias("text"), F.when(problem.isNull(), notes).alias("annotations"), problem.alias("problem"))


def structured(text: Column, ddl: str) -> Column:
    """``struct(value, problem)`` of a JSON text that must be an object with exactly the fields of ``ddl``, none null.

    ``problem`` is ``no object``, ``fields`` (some are missing or unknown) or ``types``.
    """
    schema = T.StructType.fromDDL(ddl)
    names = F.array(*(F.lit(n) for n in sorted(schema.names)))
    keys = F.array_sort(F.json_object_keys(text))
    value = F.from_json(text, schema)
    wrong = F.lit(False)
    for f in schema.fields:
        wrong = wrong | value[f.name].isNull()
    problem = F.when(keys.isNull(), "no object").when(keys != names, "fields").when(wrong, "types")
    return F.struct(F.when(problem.isNull(), value).alias("value"), problem.alias("problem"))


def retry_hint(status: Column, retry_after: Column) -> Column:
    """Seconds that a rate-limited service asks to wait; null without such a status or a number."""
    return F.when(status == 429, retry_after.try_cast("double"))
