"""Shapes of records: media parts, exam questions, swapped truths, paths into nested values, column choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

#: Names of a text column, the first that is there wins.
TEXT_NAMES = ("text", "document", "content", "prompt")


def text_column(df: DataFrame) -> str:
    """The text column by priority of names, else the first string column; a ValueError if there is none."""
    for name in (*TEXT_NAMES, *[f.name for f in df.schema if isinstance(f.dataType, K.StringType)]):
        if name in df.columns:
            return name
    raise ValueError("no text column")


def reshaped(df: DataFrame, keep: list[str] | None = None, drop: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """``df`` with some of its columns, under new names; names that aren't there are an error."""
    rename = rename or {}
    missing = [c for c in (*(keep or []), *drop, *rename) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in (keep or df.columns) if c not in drop])


def media_parts(content: Column) -> Column:
    """``array<struct<type, text>>``: a text cut at its <image> and <video> markers; empty pieces are left out."""
    cut = F.split(F.regexp_replace(content, "(<image>|<video>)", "\x01$1\x01"), "\x01")
    kind = lambda s: F.when(s == "<image>", "image").when(s == "<video>", "video").otherwise("text")
    return F.transform(F.filter(cut, lambda s: s != ""), lambda s: F.struct(kind(s).alias("type"), F.when(kind(s) == "text", s).alias("text")))


def options_with(wrong: Column, right: Column, at: Column) -> Column:
    """The wrong answers with the right one put in at place ``at`` (from 0)."""
    return F.concat(F.slice(wrong, F.lit(1), at), F.array(right), F.slice(wrong, at + 1, F.size(wrong)))


def exam_question(question: Column, options: Column) -> Column:
    lines = [F.concat(F.lit(f"{letter}) "), options[i]) for i, letter in enumerate("ABCD")]
    return F.concat_ws("\n", F.concat(question, F.lit("\n")), *lines)


def swapped(record: Column, *pairs: tuple[str, str]) -> Column:
    """``record`` with the fields of each pair changing places."""
    out = record
    for a, b in pairs:
        out = out.withField(a, record[b]).withField(b, record[a])
    return out


def flattened(df: DataFrame, key: str, columns: dict[str, int]) -> DataFrame:
    """``key, key, value``: the leaves of nested ``columns`` by path, as text.

    The number says how many elements of a list get paths of their own; every list gets one for its length.
    """

    def leaves(path: str, column: Column, kind: K.DataType, most: int):
        if isinstance(kind, K.StructType):
            for f in kind:
                yield from leaves(f"{path}/{f.name}", column[f.name], f.dataType, most)
        elif isinstance(kind, K.ArrayType):
            yield f"{path}/list_len", F.size(column).cast("string")
            for i in range(most):
                yield from leaves(f"{path}/{i}", F.get(column, i), kind.elementType, most)
        else:
            yield path, column.cast("string")

    pairs = [p for c, most in columns.items() for p in leaves(c, F.col(c), df.schema[c].dataType, most)]
    return df.select(F.col(key), F.inline(F.array(*[F.struct(F.lit(p).alias("key"), v.alias("value")) for p, v in pairs])))


def repeated(df: DataFrame, times: Column, out: str) -> DataFrame:
    """Every row ``times`` times, numbered from 0 in ``out``; rows of 0, negative or null times are gone."""
    return df.withColumn("__times", times).where("__times > 0").withColumn(out, F.explode(F.sequence(F.lit(0), F.col("__times") - 1))).drop("__times")


def scoring_windows(n: Column, length: int, stride: int | None = None) -> Column:
    """``array<struct<start, begin_at, end_at, n_scored>>``: windows over ``n`` tokens in which every token is scored once."""
    stride = stride or max(1, length // 2)
    window = lambda i: F.struct(i.alias("start"), F.greatest(i + stride - length, F.lit(0)).alias("begin_at"), F.least(i + stride, n).alias("end_at"), (F.least(i + stride, n) - i).alias("n_scored"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(stride)), window))


def setting(settings: Column, path: str, default: str | None = None) -> Column:
    """The value at a dotted ``path`` of a JSON text, else ``default``; also where the text is no JSON."""
    return F.coalesce(F.get_json_object(settings, "$." + path), F.lit(default))


def fitted(values: Column, length: int, fill: Column, left_pad: bool = True, cut: str = "error") -> Column:
    """An array of just ``length`` elements: filled up on one side, or cut on the left, the right or in the middle; ``error`` fails on a longer one."""
    n = F.size(values)
    missing = F.array_repeat(fill, F.greatest(F.lit(0), F.lit(length) - n))
    padded = F.concat(missing, values) if left_pad else F.concat(values, missing)
    half = length // 2
    if cut == "left":
        shorter = F.slice(values, -length, length)
    elif cut == "right":
        shorter = F.slice(values, 1, length)
    elif cut == "middle":
        shorter = F.concat(F.slice(values, 1, half), F.slice(values, half - length, length - half)) if half else F.slice(values, -length, length)
    elif cut == "error":
        shorter = F.transform(values, lambda v: F.when(F.lit(True), F.raise_error(F.lit(f"a sequence is longer than {length}"))).otherwise(v))
    else:
        raise ValueError(f"unknown way to cut: {cut}")
    return F.when(n > length, shorter).otherwise(padded)

