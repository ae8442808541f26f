"""Rows that break a rule leave by a way of their own, with the reason, in the same pass as the rows that keep all rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..scratch import scratch_path


@dataclass(frozen=True)
class Cast:
    """The column as another type; a value that doesn't convert is a fault, a null stays null."""

    column: str
    kind: str

    def apply(self) -> tuple[Column, Column]:
        value = F.col(f"`{self.column}`").try_cast(self.kind)
        return value, F.when(F.col(f"`{self.column}`").isNotNull() & value.isNull(), F.lit(f"{self.column}: not {self.kind}"))


@dataclass(frozen=True)
class Json:
    """A JSON text as a value of a schema; a text that doesn't parse is a fault."""

    column: str
    schema: str

    def apply(self) -> tuple[Column, Column]:
        text = F.col(f"`{self.column}`")
        bad = text.isNotNull() & F.call_function("try_parse_json", text).isNull()
        return F.when(~bad, F.from_json(text, self.schema)), F.when(bad, F.lit(f"{self.column}: malformed JSON"))


@dataclass(frozen=True)
class Required:
    """A null or empty text is a fault."""

    column: str

    def apply(self) -> tuple[Column, Column]:
        c = F.col(f"`{self.column}`")
        return c, F.when(c.isNull() | (c.cast("string") == ""), F.lit(f"{self.column}: missing"))


@dataclass(frozen=True)
class Call:
    """A Python function of the column's values; what it raises for a value is a fault of that row alone. Nulls stay null."""

    column: str
    fn: Callable
    kind: str | DataType

    def apply(self) -> tuple[Column, Column]:
        kind = self.kind if isinstance(self.kind, str) else self.kind.simpleString()

        def run(values: pd.Series) -> pd.DataFrame:
            out, errors = [], []
            for v in values:
                try:
                    out.append(None if v is None or v != v else self.fn(v))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  the row's fault, not the job's
                    out.append(None)
                    errors.append(f"{self.column}: {type(e).__name__}")
            return pd.DataFrame({"value": pd.Series(out, dtype=object), "error": pd.Series(errors, dtype=object)})

        both = F.pandas_udf(run, f"value {kind}, error string")(F.col(f"`{self.column}`"))
        return both["value"], both["error"]


def checked(df: DataFrame, rules: list[Cast | Json | Required | Call]) -> DataFrame:
    """df with each rule's column as the rule makes it, and _reasons: the faults of the row in order of the rules (empty: none).

    Rules of one column each see the column as it came; the last of them that changes it gives its value.
    """
    made: dict[str, Column] = {}
    reasons = []
    for r in rules:
        value, fault = r.apply()
        if not isinstance(r, Required):
            made[r.column] = value
        reasons.append(fault)
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns], F.array_compact(F.array(*reasons)).alias("_reasons"), raw.alias("_raw"))


def divert(df: DataFrame, rules: list[Cast | Json | Required | Call], path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows as the rules make them, dead letters: reasons and the row as it came, as JSON).

    Both are written in one pass over df, to a folder each (path, or the shared scratch folder), so that no row is judged twice.
    An empty table gives two empty tables; rows that repeat each other are judged each.
    """
    path = path or scratch_path(df.sparkSession, "checked")
    own = checked(df, rules)
    kept = F.size("_reasons") == 0
    split = own.select(
        F.when(kept, F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"), F.when(~kept, F.col("_reasons")).alias("reasons"), F.when(~kept, F.col("_raw")).alias("raw"), kept.alias("accepted")
    )
    split.write.mode("overwrite").partitionBy("accepted").parquet(path)
    back = df.sparkSession.read.schema(split.schema).parquet(path)
    return back.filter("accepted").select("row.*"), back.filter("not accepted").select("reasons", "raw")
