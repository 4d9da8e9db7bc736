"""From retrieved passages to cited answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.models import DEGRADED, Chat, safe
from lorespark.functions.text import citations, renumber, strip_marks

#: Fixed value: the instruction that comes before the passages.
SYSTEM = "请根据资料回答问题，并用[来源n]标明出处。"


def ask(contexts: DataFrame, chat: Chat, system: str = SYSTEM) -> DataFrame:
    """(query_id, answer, sources) from contexts (query_id, question, context, sources).

    The chat model is called once for each question, in the tasks; where it fails the answer is a fixed message without
    sources. Marks are renumbered from 1 and only cited sources stay, in their new order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reply = safe(chat)
        for batch in batches:
            answers = [reply(system, f"{c or ''}\n\n{q or ''}") for q, c in zip(batch["question"], batch["context"])]
            yield pd.DataFrame({"query_id": batch["query_id"], "raw": answers})

    replies = contexts.select(F.col("query_id").cast("long"), "question", "context").mapInPandas(run, "query_id long, raw string")
    made = contexts.join(replies, "query_id").withColumn("raw", strip_marks(F.col("raw")))
    cited = F.when(F.col("raw") == DEGRADED, F.array().cast("array<int>")).otherwise(citations(F.col("raw"), F.size("sources")))
    made = made.withColumn("cited", cited)
    kept = F.transform("cited", lambda n: F.get("sources", n - 1))
    return made.select("query_id", renumber(F.col("raw"), F.col("cited")).alias("answer"), kept.alias("sources"))
