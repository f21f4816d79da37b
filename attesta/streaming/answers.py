"""Questions as a stream: each micro-batch goes through the session's batch plan, so both give the same answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.session import RagSession
from ..sources.scratch import owned


def answer_stream(questions: DataFrame, session: RagSession, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the answers of a streaming DataFrame (question_id, question) to ``path``, one folder a batch.

    A batch that is run again after a failure overwrites its own folder, so every question is answered once.  What a
    batch writes to the shared folder on its way goes when the batch is stored.
    """

    def batch(df: DataFrame, number: int) -> None:
        with owned(df.sparkSession):
            session.answer(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
