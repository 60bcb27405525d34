"""Features of recordings as they arrive, going on where an interrupted run ended."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.files import digest, finished, unfinished, write_recording
from tidemark.sources.storage import written


def make_arriving(arriving: DataFrame, make: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, settings: dict, **trigger) -> StreamingQuery:
    """Makes features and manifest, by ``make``, of the recordings of a stream (clip,
    feature_key, …) and writes them to ``path`` with their markers; all that is there now,
    unless ``trigger`` says otherwise.

    What has been read is remembered for each digest of the settings: a run under the same
    ones goes on, and one under others reads all arrivals anew. A recording that has a
    marker of these settings isn't made again, also where a batch is repeated because a
    run ended between its writes; one that has none is. With ``force`` all are made again.
    """
    made_by = digest(settings)
    seen = f"{made_by}-{uuid.uuid4().hex}" if settings["force"] else made_by
    keys = ("clip", "feature_key")

    def batch(rows: DataFrame, number: int) -> None:
        work = rows if settings["force"] else unfinished(rows, finished(rows.sparkSession, path, made_by), *keys)
        work = written(work.dropDuplicates(list(keys)), "arrived")  # markers that it depends on are about to change
        if not work.isEmpty():
            write_recording(*make(work), path, made_by)

    how = trigger or {"availableNow": True}
    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/seen/{seen}").trigger(**how).start()
