"""Mail messages as columns: MIME headers, plain text and attachments' names of raw messages, parsed without a server."""

from __future__ import annotations

from email import message_from_string, policy

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([*(T.StructField(x, T.StringType()) for x in ("sender", "recipient", "subject", "date", "body")), T.StructField("attachments", T.ArrayType(T.StringType()))])


@F.pandas_udf(MESSAGE)
def parse(raw: pd.Series) -> pd.DataFrame:
    def one(text) -> dict:
        m = message_from_string(text or "", policy=policy.default)
        body = m.get_body(("plain", "html"))
        return {
            "sender": str(m["from"] or ""), "recipient": str(m["to"] or ""), "subject": str(m["subject"] or ""), "date": str(m["date"] or ""),
            "body": body.get_content().strip() if body is not None else "", "attachments": [p.get_filename() or "" for p in m.iter_attachments()],
        }

    return pd.DataFrame([one(x) for x in raw], columns=[f.name for f in MESSAGE])


def search(messages: DataFrame, q: str, field: str = "sender", date: str = "date") -> DataFrame:
    """Parsed messages whose field holds q, in any case, latest first."""
    return messages.where(F.contains(F.lower(field), F.lit(q.lower()))).orderBy(F.desc(date))
