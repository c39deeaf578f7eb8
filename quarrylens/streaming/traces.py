"""Question traces and failover events arrive over time; these write them as a stream.

The rules are stateless columns, so a stream needs no watermark and keeps no
state: the checkpoint holds only source offsets and the sink's commit log.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylens.functions import questions, text
from quarrylens.plans.catalog import CatalogStore


def released_traces(answered: DataFrame) -> DataFrame:
    """Scrub, judge and label (question, answer) rows, batch or streaming."""
    scrubbed = answered.withColumn("answer", text.scrubbed(F.col("answer")))
    question, answer = F.col("question"), F.col("answer")
    return scrubbed.withColumns(
        {
            "intent": questions.question_intent(question),
            "validation_status": questions.answer_verdict(question, answer),
            "response": questions.released_answer(question, answer),
        }
    )


def append_stream(
    store: CatalogStore, table: str, rows: DataFrame, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append a stream to one of the logs; `once` drains what is there and stops.

    Every micro-batch is one folder, named by the checkpoint and its number, that
    a restart writes anew: no row is lost or repeated, and batch appends to the
    same log stay visible.
    """
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    writer = (
        rows.writeStream.foreachBatch(lambda batch, n: store.append_batch(table, batch, stream, n))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
