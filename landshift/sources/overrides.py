"""Settings: a file of ``KEY=value`` lines, layered over environment and defaults."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.functions.text import resolved, without_credentials

_LINE = re.compile(r"^[^\S\n]*(?!#)([^=\n]*?)[^\S\n]*=[^\S\n]*(.*?)[^\S\n]*$", re.MULTILINE)


def parsed(text: str) -> dict[str, str]:
    """Every line of the form ``key=value`` that is no comment; of a key told twice, the last."""
    return dict(_LINE.findall(text.replace("\r\n", "\n")))


def settings(spark: SparkSession, text: str) -> DataFrame:
    """(name, override) of a settings file."""
    return spark.createDataFrame(list(parsed(text).items()), "name string, override string")


def catalogue(known: DataFrame, given: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row per known setting (name, default_value, environment): its value without credentials, the layer that
    decided, and what the latest methodology recorded. Blank values decide nothing."""
    rows = known.join(given, "name", "left").join(recorded, "name", "left")
    layer = lambda c: F.nullif(F.trim(c), F.lit(""))
    value = resolved(("override", layer("override")), ("environment", layer("environment")), ("default", F.col("default_value")))
    return rows.select("name", without_credentials(value["value"]).alias("value"), value["source"].alias("source"), "recorded")


def chosen(value: Column, *choices: str) -> Column:
    """The value if it is one of the choices, else null."""
    return F.when(value.isin(*choices), value)


def within(value: Column, least: int, most: int) -> Column:
    """The whole number that a text tells, if it lies within the bounds, else null."""
    number = F.when(value.rlike(r"^-?[0-9]{1,18}\z"), value).cast("long")
    return F.when(number.between(least, most), number)


def in_order(values: dict[str, str], low: str, high: str) -> None:
    """Two settings of which one may not be above the other; an error if it is."""
    if low in values and high in values and float(values[low]) > float(values[high]):
        raise ValueError(f"{low} must not be above {high}")


def resolve(key: str, overrides: dict[str, str], environment: dict[str, str], default: str | None) -> tuple[str | None, str]:
    """Value and the layer it comes from."""
    for name, layer in (("override", overrides), ("environment", environment)):
        if layer.get(key) not in (None, ""):
            return layer[key], name
    return default, "default"


def validated(value: str, kind: str = "text", least: float | None = None, most: float | None = None, choices: tuple[str, ...] = (), pattern: str | None = None) -> str:
    """The value, or an error that says what is wrong with it."""
    if choices and value not in choices:
        raise ValueError(f"{value!r} is none of {', '.join(choices)}")
    if kind in ("int", "float"):
        try:
            number = int(value) if kind == "int" else float(value)
        except ValueError as e:
            raise ValueError(f"{value!r} is no {kind}") from e
        if (least is not None and number < least) or (most is not None and number > most) or number != number:
            raise ValueError(f"{value!r} is out of range")
    if pattern and not re.fullmatch(pattern, value):
        raise ValueError(f"{value!r} is not of the form {pattern}")
    return value
