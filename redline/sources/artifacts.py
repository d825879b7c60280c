"""Artifacts of the offline jobs: routing models, few-shot examples, statistics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.functions import modeltext as M
from redline.operators.routing import MODEL_SCHEMA
from redline.sources import storage

_NESTED = "map<string,map<string,double>>"
_ARTIFACT = f"by_modality_bodypart {_NESTED}, by_term {_NESTED}"


def save_model(model: DataFrame, path: str) -> None:
    """The long table as Parquet: the form for models of any size."""
    storage.replace(model.sparkSession, path, lambda fresh: model.write.parquet(fresh))


def export_model(model: DataFrame, path: str) -> None:
    """One JSON document with sorted keys; its signals pass the driver one at a time."""
    entries = model.groupBy("kind", "signal").agg(
        F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "weight")))).alias("labels")
    )

    def pieces():
        yield "{"
        for n, (kind, name) in enumerate((("group", "by_modality_bodypart"), ("term", "by_term"))):
            yield f"{',' if n else ''}\n  {json.dumps(name)}: {{"
            first = True
            for row in entries.where(F.col("kind") == kind).orderBy("signal").toLocalIterator():
                entry = json.dumps({x["label"]: x["weight"] for x in row["labels"]}, indent=2, sort_keys=True)
                yield ("" if first else ",") + "\n    " + json.dumps(row["signal"]) + ": " + entry.replace("\n", "\n    ")
                first = False
            yield "}" if first else "\n  }"
        yield "\n}"

    storage.write_text(model.sparkSession, path, pieces())


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """A model from Parquet or JSON; a missing or unreadable one is empty."""
    empty = spark.createDataFrame([], MODEL_SCHEMA)
    if not storage.exists(spark, path):
        return empty
    if not str(path).endswith(".json"):
        return spark.read.schema(MODEL_SCHEMA).parquet(str(path))
    text = spark.read.text(str(path), wholetext=True)
    good = text.where(M.is_json(F.col("value"))).select(F.from_json("value", _ARTIFACT).alias("m"))
    parts = [
        good.select(F.lit(kind).alias("kind"), F.explode(f"m.{name}").alias("signal", "weights"))
        for kind, name in (("group", "by_modality_bodypart"), ("term", "by_term"))
    ]
    long = parts[0].unionAll(parts[1])
    return long.select("kind", "signal", F.explode_outer("weights").alias("label", "weight"))


def load_examples(spark: SparkSession, path: str) -> list[dict]:
    """Static examples; a missing file gives none, a malformed one is an error."""
    if not storage.exists(spark, path):
        return []
    data = json.loads(storage.read_text(spark, path, "examples"))
    examples = data.get("examples") if isinstance(data, dict) else None
    if not isinstance(examples, list):
        raise ValueError("the examples file needs a list under 'examples'")
    for place, example in enumerate(examples):
        absent = [k for k in ("template", "dictation", "output") if k not in dict(example)]
        if absent or not isinstance(example["output"], dict):
            raise ValueError(f"example {place} lacks {absent or 'an output object'}")
        template = example["template"]
        if not template.startswith("FINDINGS:") or template.count("IMPRESSION:") != 1:
            raise ValueError(f"example {place} has a malformed template")
    return examples
