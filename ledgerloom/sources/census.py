"""What keys a corpus of JSON lines has: each path with the types of its values, how often and in how many files.

Keys are data and never columns. A value without arrays has all its keys and types in its schema's text, its shape, so lines are
counted by file and shape before anything is opened or moved, and keys are read from shapes. Values with arrays in them, whose
elements a shape does not count, are opened one level, and again what has no arrays is counted by shape. Elements of arrays share
one path.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ledger import cut

#: How types of variants are called.
NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
#: Of a shape: a key, the begin or end of an object, or the word of a type.
_PART = re.compile(r"(`(?:[^`]|``)*`|\w+): |(OBJECT<)|(>)|([A-Z]+)")


def _keys_of(shape: str) -> list[tuple[str, str]]:
    """(key, type) of a value of this shape, whose own key is empty, and of all below it."""
    found, within, at = [], [], ""
    for key, begin, end, word in _PART.findall(shape):
        if key:
            at = f"{within[-1]}.{key[1:-1].replace('``', '`') if key[0] == '`' else key}"
        elif end:
            within.pop()
        else:
            found.append((at, "null" if word == "VOID" else "number" if word in NUMBERS else (word or "object").lower()))
            if begin:
                within.append(at)
    return found


def key_census(rows: DataFrame, file: str = "path", line: str = "line") -> DataFrame:
    """(key, type, n, files) of (path, line): $ is the line, .k a key, [] an element. type is object, array, string, number,
    boolean or null. Lines that are no JSON have no keys."""
    spark = rows.sparkSession
    level = rows.select(F.col(file).alias("file"), F.lit("$").alias("key"), F.lit(1).cast("long").alias("n"), F.explode(F.array(F.try_parse_json(F.col(line)))).alias("value"))
    bare = F.regexp_replace(F.schema_of_variant("value"), r"(`(?:[^`]|``)*+`)|\(\d+,\d+\)", "$1")  # decimals of any precision have one shape
    mixed = F.col("shape").contains("ARRAY<")
    found = None
    while True:
        shaped = level.select("file", "key", "n", "value", F.explode(F.array(bare)).alias("shape")).where("shape is not null")  # generators: read once
        shape, rest = F.when(mixed, F.substring_index("shape", "<", 1)).otherwise(F.col("shape")), F.when(mixed, F.to_json("value"))
        counts = cut(shaped.groupBy("file", "key", shape.alias("shape"), rest.alias("rest")).agg(F.sum("n").alias("n")))
        found = counts.drop("rest") if found is None else found.unionByName(counts.drop("rest"))
        nested = counts.where("rest is not null")
        if nested.isEmpty():
            break
        level = spark.sql("SELECT t.file, CASE WHEN t.shape = 'ARRAY' THEN concat(t.key, '[]') ELSE concat(t.key, '.', x.key) END AS key, t.n, x.value FROM {t} t, LATERAL variant_explode(parse_json(t.rest)) AS x", t=nested)
    keys = F.udf(_keys_of, "array<struct<key: string, type: string>>")
    each = found.select("file", "key", "n", F.explode(keys("shape")).alias("x")).groupBy(F.concat("key", "x.key").alias("key"), F.col("x.type").alias("type"), "file").agg(F.sum("n").alias("n"))
    return each.groupBy("key", "type").agg(F.sum("n").alias("n"), F.count("*").alias("files"))
