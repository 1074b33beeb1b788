"""Redaction of table columns: cells one by one, whole columns, and the header as context of its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..plans.policy import Policy
from ..plans.redactor import Redactor, Resources

FULL = "{{{REDACTED}}}"


def redact_columns(df: DataFrame, policy: Policy, columns: list[str], full_columns: list[str] = (), use_header: bool = True, resources: Resources | None = None, seed: int = 0, secret: str | bytes | None = None) -> DataFrame:
    """df with the cells of `columns` redacted and those of `full_columns` replaced whole (nulls stay).

    use_header: a cell is read as `header: cell`, so that its header counts as context; only spans that lie within the cell are
    kept. A row's cells are an array that one expression searches, so the plan doesn't grow with the columns, and nothing is joined.
    """
    out = df.select(*[F.when(F.col(c).isNotNull(), F.lit(FULL)).alias(c) if c in full_columns else F.col(c) for c in df.columns])
    wanted = [c for c in columns if c not in full_columns]
    if not wanted:
        return out
    leads = [f"{c}: " if use_header else "" for c in wanted]
    cells = F.array(*[F.struct(F.concat(F.lit(lead), F.col(c).cast("string")).alias("text")) for c, lead in zip(wanted, leads, strict=True)])
    found = Redactor(policy, resources, seed, secret=secret).redact_each(S.settled(out.withColumn("__cells", cells), "__cells"), "__cells")

    def value(k: int) -> Column:
        within = F.filter(F.get("__found", F.lit(k)), lambda x: x["character_start"] >= len(leads[k]))
        return S.replaced(F.col(wanted[k]).cast("string"), S.shifted(within, F.lit(-len(leads[k]))))

    return found.select(*[value(wanted.index(c)).alias(c) if c in wanted else F.col(c) for c in df.columns])


def cell_spans(df: DataFrame, policy: Policy, column: str, header: str | None = None, resources: Resources | None = None, seed: int = 0, secret: str | bytes | None = None) -> DataFrame:
    """df with `spans` of one column, at their places in the cell."""
    lead = f"{header}: " if header else ""
    found = Redactor(policy, resources, seed, secret=secret).redact(df.withColumn("__read", F.concat(F.lit(lead), F.col(column))), "__read")
    within: Column = F.filter("spans", lambda x: x["character_start"] >= len(lead))
    return found.withColumn("spans", S.shifted(within, F.lit(-len(lead)))).drop("__read", "filtered_text", "tokens", "regex_timeouts")
