"""Chat request validation and the conversation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions import findings as fx

# Question limit, history lifetime and the messages of rejected requests.
MAX_QUESTION = 4000
HISTORY_DAYS = 30
NOT_JSON = "Request body must be valid JSON."
NOT_OBJECT = "Request body must be a JSON object."
NO_QUESTION = "Field 'question' is required."
TOO_LONG = "Field 'question' is too long (max 4000 chars)."
BLANKS = " \t\n\r\x0b\x0c"


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def validate_requests(requests: DataFrame, *, request_key: str = "request_id") -> DataFrame:
    """Adds error, question, session_id and user_id to logged requests (body, sub, username).

    `error` is null for valid rows. A missing session id is derived from the
    request key, so a replay yields the same one.
    """
    body = F.coalesce(fx.non_empty(F.col("body")), F.lit("{}"))
    parsed = requests.withColumn("_v", F.try_parse_json(body))
    is_object = F.col("_kind").startswith("OBJECT")
    field = lambda name: F.when(is_object, F.try_variant_get(F.col("_v"), f"$.{name}", "string"))
    generated = F.concat(F.lit("sess-"), F.substring(F.md5(F.col(request_key).cast("string")), 1, 16))
    fields = parsed.withColumn("_kind", F.schema_of_variant("_v")).withColumns(
        {
            "question": _stripped(F.coalesce(field("question"), F.lit(""))),
            "session_id": _stripped(F.coalesce(fx.non_empty(field("session_id")), generated)),
            "user_id": F.coalesce(fx.non_empty(F.col("sub")), fx.non_empty(F.col("username")), F.lit("unknown")),
        }
    )
    error = (
        F.when(F.col("_v").isNull(), NOT_JSON)
        .when(~is_object, NOT_OBJECT)
        .when(F.col("question") == "", NO_QUESTION)
        .when(F.length("question") > MAX_QUESTION, TOO_LONG)
    )
    return fields.withColumn("error", error).drop("_v", "_kind")


def store_turn(turns: DataFrame, *, ts: Column, days: int = HISTORY_DAYS) -> DataFrame:
    """Conversation rows as stored: timestamp text and the epoch second they expire."""
    return turns.select(
        "session_id",
        fx.iso_utc(ts).alias("timestamp"),
        "user_id",
        "question",
        "answer",
        (F.unix_timestamp(ts) + days * 86400).alias("expires_at"),
    )


def session_history(turns: DataFrame, session_id: str | None = None) -> DataFrame:
    """Turns in time order, of one session or of all. The sort is by range, so a long session spreads out."""
    if session_id is not None:
        turns = turns.filter(F.col("session_id") == session_id)
    return turns.orderBy("session_id", "timestamp")
