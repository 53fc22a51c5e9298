"""Operators declared as SQL over named inputs: Catalyst plans them, DuckDB can run the same text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: name -> (Spark, DuckDB) where the dialects differ.
DIALECT = {
    "DAY_NUMBER": (r"unix_date(CAST(\1 AS DATE))", r"date_diff('day', DATE '1970-01-01', CAST(\1 AS DATE))"),
    "TEXT_LIST": (r"array_join(array_sort(collect_list(\1)), ',')", r"array_to_string(list_sort(list(\1)), ',')"),
    "SERIES": (r"explode(sequence(\1))", r"unnest(generate_series(\1))"),
    "VALUES_OF": (r"LATERAL VIEW posexplode(\1) x AS lag, value", r", LATERAL (SELECT unnest(range(0, len(\1))) AS lag, unnest(\1) AS value) x"),
}


def plain_numbers(text: str) -> str:
    """Numbers with a point are doubles in either engine, and rounding never gives a negative zero."""
    text = re.sub(r"(?<![\w'.])(\d+\.\d+)(?![\w'.])", r"\1e0", text)
    at = 0
    while (at := text.find("round(", at)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}(round({text[at + 6 : end]} + 0e0){text[end:]}"
        at += 7
    return text


def dialect(text: str, duck: bool) -> str:
    text = plain_numbers(text)
    for name, forms in DIALECT.items():
        text = re.sub(rf"\b{name}\(([^()]*)\)", forms[duck], text)
    return text


@dataclass(frozen=True)
class SqlOperator:
    """``op(edges=df, ...)`` runs ``body``, in which {edges} and the like are its inputs."""

    name: str
    body: str
    inputs: tuple[str, ...]

    def __call__(self, **frames: DataFrame) -> DataFrame:
        spark = next(iter(frames.values())).sparkSession
        return spark.sql(dialect(self.body, False), **{k: frames[k] for k in self.inputs})

    def duckdb(self) -> str:
        return dialect(self.body.format(**{k: k for k in self.inputs}), True)


def operator(name: str, body: str) -> SqlOperator:
    return SqlOperator(name, body, tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", body))))
