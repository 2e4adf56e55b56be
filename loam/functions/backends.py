"""Pluggable model backends, and deterministic ones that run offline."""

from __future__ import annotations

import json
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


class Teacher(Protocol):
    """Answers a prompt with a JSON list of pairs, fenced or bare."""

    def generate(self, system: str, user: str) -> str: ...


class OfflineTeacher:
    """Makes one pair from the first line of its prompt, without a model."""

    def generate(self, system: str, user: str) -> str:
        line = next((x.strip() for x in user.splitlines() if x.strip()), "")
        return "```json\n" + json.dumps([{"instruction": f"What follows from: {line[:80]}", "output": line}]) + "\n```"


TEACHERS = {"offline": OfflineTeacher}


def ask(tasks: DataFrame, teacher: str | type = "offline", system: str = "") -> DataFrame:
    """tasks (..., prompt) with ``reply``; the teacher is made once a partition. A failing call has a null reply."""
    make = TEACHERS[teacher] if isinstance(teacher, str) else teacher
    from pyspark.sql import types as T

    schema = T.StructType([*tasks.schema.fields, T.StructField("reply", T.StringType())])

    def run(frames):
        model = make()

        def one(prompt):
            try:
                return model.generate(system, prompt)
            except Exception:  # one call's failure is that row's, and shows as a null reply
                return None

        for frame in frames:
            yield frame.assign(reply=[one(p) for p in frame["prompt"]])

    return tasks.mapInPandas(run, schema)


def parse_replies(replies: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, quarantine): the objects of each reply's JSON list, and the replies that hold none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim("reply"), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    parsed = replies.select("*", F.from_json(bare, "array<struct<instruction:string,context:string,constraints:string,output:string>>").alias("_p"))
    good = parsed.where("_p is not null").select(*keep, F.inline("_p")).where("instruction is not null and output is not null")
    return good, parsed.where("_p is null").select(*keep, "reply")


def hook(registry: dict, name: str):
    """Register a plugin under a name: linters, embedders, prompt prefixes and tools alike."""

    def keep(f):
        registry[name] = f
        return f

    return keep


@F.pandas_udf(IntegerType())
def token_estimate(texts: pd.Series) -> pd.Series:
    return (texts.fillna("").str.len() / 4).astype("int32")


def evaluate(answers: DataFrame, words: Column) -> DataFrame:
    """answers (query_id, category, response, elapsed) with passed, coverage, tokens_per_sec and a preview."""
    passed = F.filter(words, lambda w: F.contains(F.lower("response"), F.lower(w)))
    rows = answers.withColumn("passed", passed).withColumn("coverage", F.round(F.try_divide(100.0 * F.size("passed"), F.size(words)), 1))
    return rows.withColumn("tokens_per_sec", F.try_divide(F.length("response") / 4.0, F.col("elapsed"))).withColumn("preview", F.replace(F.substring("response", 1, 60), F.lit("\n"), F.lit(" ")))
