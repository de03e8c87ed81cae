"""Loosely typed metadata: bags of values as variants, with getters that take a value only if it has the type asked for."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = "^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def bag(text: Column) -> Column:
    """The variant of a JSON text; null if it is none."""
    return F.try_parse_json(text)


def value(held: Column, *path: str) -> Column:
    """The value at a path of keys, of any type."""
    steps = "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in path)
    return F.try_variant_get(held, f"${steps}", "variant")


def kind(found: Column) -> Column:
    """Name of the type of a variant: STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, ARRAY<..>, OBJECT<..> or VOID."""
    return F.schema_of_variant(found)


def string(found: Column) -> Column:
    """F32: a text, else the empty text."""
    return F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string")).otherwise("")


def integer(found: Column) -> Column:
    """F32: a number without its fraction, else 0."""
    number = F.try_variant_get(found, "$", "double")
    exact = F.when(kind(found) == "BIGINT", F.try_variant_get(found, "$", "long"))
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.coalesce(exact, F.when(kind(found).rlike(NUMBERS), cut), F.lit(0)).cast("long")


def boolean(found: Column, default: bool = False) -> Column:
    return F.coalesce(F.when(kind(found) == "BOOLEAN", F.try_variant_get(found, "$", "boolean")), F.lit(default))


def strings(found: Column) -> Column:
    """F32: the texts of a list that are not empty; null if there is none or it is no list."""
    items = F.when(kind(found).startswith("ARRAY"), F.try_variant_get(found, "$", "array<variant>"))
    texts = F.filter(F.transform(items, string), lambda s: s != "")
    return F.when(F.size(texts) > 0, texts)


def keys(held: Column) -> Column:
    """All keys of an object in their order."""
    return F.when(kind(held).startswith("OBJECT"), F.array_sort(F.map_keys(F.try_variant_get(held, "$", "map<string, variant>"))))


def front_matter(files: DataFrame, content: str = "content") -> DataFrame:
    """files with a column `bag`: all of a page's front matter, keys that no field stands for too; null without a
    block or if it cannot be parsed. Blocks are cut off in the JVM and parsed in Arrow batches."""
    import yaml

    from docweave.sources import markdown

    def plain(block: str | None) -> str | None:
        if block is None:
            return None
        try:
            found = markdown.load_yaml(block)
            return json.dumps(found, default=str) if isinstance(found, dict) else None
        except (yaml.YAMLError, ValueError, TypeError):
            return None

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("__block")
            blocks = pa.array([plain(b) for b in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns) if k != at), blocks], [*(n for n in batch.schema.names if n != "__block"), "__json"])

    cut = files.withColumn("__block", F.when(F.col(content).rlike(markdown.FENCE), F.regexp_extract(content, markdown.FENCE, 1)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return cut.mapInArrow(run, f"{schema}, __json string").withColumn("bag", bag(F.col("__json"))).drop("__json")
