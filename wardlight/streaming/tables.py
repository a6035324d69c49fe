"""The security views over streams of the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wardlight.sources.views import RAW, Tables


class StreamTables(Tables):
    """Like :class:`Tables`, but the tables named in ``streamed`` are read as
    they arrive, ``files`` at most in a micro-batch; the others stay static."""

    def __init__(self, spark, directory, streamed: tuple[str, ...], files: int = 64):
        super().__init__(spark, directory)
        self.streamed = streamed
        self.files = files

    def raw(self, name: str) -> DataFrame:
        if name not in RAW:
            raise KeyError(name)
        if name not in self.streamed:
            return super().raw(name)
        schema = super().raw(name).schema
        return (
            self.spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", self.files)
            .option("pathGlobFilter", f"{name}.parquet")
            .parquet(self.directory)
        )


def finish(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query and raise what stopped it."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
