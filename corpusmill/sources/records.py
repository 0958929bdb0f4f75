"""Records in JSON and CSV: fields, keys and lines, with variant and SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that name a record, in order of preference; deepest level flattened.
KEY_FIELDS = ("id", "key", "slug", "code", "sku", "name", "title")
DEEPEST = 6


def first_filled(values: list[Column], otherwise: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values], otherwise)


def record_key(json: Column, number: Column) -> Column:
    """What a JSON record is called: its first key field, or its number from 1."""
    return first_filled([F.get_json_object(json, f"$.{k}") for k in KEY_FIELDS], F.concat(F.lit("record "), (number + 1).cast("string")))


def fields_of(df: DataFrame, id_col: str, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """id, field, value (text) of the top level of each JSON object; broken JSON gives none."""
    keep = keep or []
    pairs = F.from_json(F.col(json_col), "map<string,string>")
    return df.select(id_col, *keep, F.explode(pairs).alias("field", "value"))


def flatten_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, lines: ``path.to.leaf: value`` for every leaf, by name; null leaves say nothing.

    Each pass explodes one level of the variant, so nesting up to DEEPEST needs no
    Python; what is deeper stays as JSON.  Array elements are numbered from 1.
    """
    nodes = df.select(F.col(id_col).alias("_id"), F.lit("").alias("path"), F.try_parse_json(json_col).alias("v"))
    leaves = None
    kind = F.schema_of_variant("v")
    for depth in range(DEEPEST):
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        done = nodes.where(F.col("v").isNotNull() & ~nested)
        leaves = done if leaves is None else leaves.unionByName(done)
        inner = nodes.where(F.col("v").isNotNull() & nested).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        name = F.coalesce(F.col("key"), (F.col("pos") + 1).cast("string"))
        nodes = inner.select("_id", F.when(F.col("path") == "", name).otherwise(F.concat("path", F.lit("."), name)).alias("path"), F.col("value").alias("v"))
        if depth == 0:
            nodes = nodes.select("_id", "path", "v")
    leaves = leaves.unionByName(nodes.where(F.col("v").isNotNull()))
    text = leaves.select("_id", "path", F.col("v").cast("string").alias("value")).where("value is not null")
    line = F.concat(F.when(F.col("path") == "", "value").otherwise(F.col("path")), F.lit(": "), F.col("value"))
    lines = F.sort_array(F.collect_list(F.struct("path", line.alias("line"))))
    return text.groupBy("_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines")).withColumnRenamed("_id", id_col)


def csv_lines(df: DataFrame, keep: list[str], header_col: str, line_col: str, delimiter: str = ";") -> DataFrame:
    """Kept columns, lines (``name: value`` of filled cells) and record_key of each CSV row.

    Nameless columns are called by their number; rows of another width are read as
    far as both go; cells may be quoted.
    """
    # a cell is quoted (quotes doubled inside) or free of delimiters
    cell = rf'(?:^|{delimiter})("(?:[^"]|"")*"|[^{delimiter}]*)'
    cells = lambda c: F.transform(F.regexp_extract_all(F.col(c), F.lit(cell), F.lit(1)), lambda x: F.trim(F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.char_length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)))
    names = F.transform(cells(header_col), lambda x, i: F.when(x == "", F.concat(F.lit("column "), (i + 1).cast("string"))).otherwise(x))
    pairs = F.filter(F.arrays_zip(names.alias("name"), cells(line_col).alias("value")), lambda p: p["name"].isNotNull() & p["value"].isNotNull() & (p["value"] != ""))
    rows = df.withColumn("_pairs", pairs)
    named = lambda k: F.try_element_at(F.filter("_pairs", lambda p: F.lower(p["name"]) == k), F.lit(1))["value"]
    key = [named(k) for k in KEY_FIELDS]
    return rows.select(*keep, F.array_join(F.transform("_pairs", lambda p: F.concat(p["name"], F.lit(": "), p["value"])), "\n").alias("lines"), first_filled(key, F.lit("row")).alias("record_key"))
