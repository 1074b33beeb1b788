"""Redaction of streams. Detection is a projection, so the batch plan runs as it is; consistent replacements keep state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import anonymize, keyed
from ..plans.redactor import Redactor


def redact_stream(source: DataFrame, redactor: Redactor, text: str = "text", context: str = "none") -> DataFrame:
    """A streaming DataFrame with filtered_text, spans, tokens and regex_timeouts."""
    return redactor.redact(source, text, context)


def consistent_stream(spans: DataFrame, seed: int = 0, method: str = "realistic", ttl_ms: int | None = None, lists=None, secret: str | bytes | None = None) -> DataFrame:
    """Streaming spans (context, text, filter_type) to (context, token, replacement, seen): one value for each (context, token).

    The value is kept as state of the key and counted; ttl_ms: keys not seen for so long are forgotten (processing time).
    New values are drawn with the secret, or with one drawn now; known ones are state, and outlive a restart either way.
    """
    own = keyed.given(secret) if secret else keyed.fresh()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        context, token = key
        value, seen = state.get if state.exists else (None, 0)
        for rows in batches:
            if value is None:
                value = anonymize.anonymize(min(rows["filter_type"]), token, f"{seed}|{context}|{token}", method, None, lists, own)
            seen += len(rows)
        state.update((value, seen))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"context": [context], "token": [token], "replacement": [value], "seen": [seen]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    tokens = spans.selectExpr("context", "text AS token", "filter_type")
    return tokens.groupBy("context", "token").applyInPandasWithState(step, "context string, token string, replacement string, seen long", "replacement string, seen long", "update", timeout)
