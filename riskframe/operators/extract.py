"""First JSON object in free text, as column expressions over whole texts.

A fenced block is taken with a built-in regex; otherwise the text from the first '{' is cut
into tokens (single braces, quotes and backslashes, and the runs between them) and one fold
over the tokens keeps the depth, whether it is inside a string literal and whether the
next character is escaped, until the depth is zero again. Texts without a brace cost one search.
Validity is checked by parsing the candidate with ``try_parse_json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern of a fenced block.
FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
TOKENS = r'[\\"{}]|[^\\"{}]+'

_STATE = "struct<depth:int,quoted:boolean,escaped:boolean,size:int,end:int>"


def balanced_object(text: Column) -> Column:
    """Text of the first balanced {...} that starts at the first '{' (NULL if unmatched)."""
    start = F.instr(text, "{")
    rest = F.substring(text, start, F.length(text))

    def step(s, t):
        special = ~s["escaped"]
        brace = special & ~s["quoted"]
        depth = s["depth"] + F.when(brace & (t == "{"), 1).when(brace & (t == "}"), -1).otherwise(0)
        quoted = F.when(special & (t == '"'), ~s["quoted"]).otherwise(s["quoted"])
        escaped = special & s["quoted"] & (t == "\\")
        size = s["size"] + F.length(t)
        return F.when(s["end"] > 0, s).otherwise(F.struct(
            depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), size.alias("size"),
            F.when(depth == 0, size).otherwise(F.lit(0)).alias("end"))).cast(_STATE)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"),
                    F.lit(0).alias("size"), F.lit(0).alias("end")).cast(_STATE)
    end = F.aggregate(F.regexp_extract_all(rest, F.lit(TOKENS), F.lit(0)), zero, step, lambda s: s["end"])
    return F.when(start > 0, F.when(end > 0, F.substring(rest, F.lit(1), end)))


def extract_json_frame(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep..., method, json_text, is_valid, n_keys for every row's whole text: the fenced block
    where there is one, else the balanced object."""
    x = df.select(*keep, F.col(text).alias("_t"), F.regexp_extract(text, FENCE, 1).alias("_fenced"))
    # the walk is not evaluated for fenced rows
    x = x.withColumn("_walked", F.when(F.col("_fenced") == "", balanced_object(F.col("_t"))))
    method = F.when(F.col("_fenced") != "", F.lit("fence")).when(F.col("_walked").isNotNull(), F.lit("walk"))
    x = x.select(*keep, method.alias("method"), F.when(F.col("_fenced") != "", F.col("_fenced")).otherwise(F.col("_walked")).alias("json_text"))
    parsed = F.try_parse_json(F.col("json_text"))
    return x.select(*keep, "method", "json_text", parsed.isNotNull().alias("is_valid"),
                    F.when(parsed.isNotNull(), F.size(F.json_object_keys("json_text"))).alias("n_keys"))
