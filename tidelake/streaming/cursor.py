"""Results as they come: an Arrow IPC stream in bounded chunks, a preview, pages.

Executors encode Arrow batches; partitions reach the driver one at a time, and
a chunk is made when it is asked for, so a result never has to fit there.
"""

from __future__ import annotations

import io
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelake.contract import ErrorCode, QueryError, Resource, ResultPage, RuntimeLimits

CHUNK_BYTES = 1 << 20


@dataclass(frozen=True)
class Chunk:
    phase: str  # schema, data or end
    data: bytes
    rows: int = 0


class ArrowCursor:
    """Chunks of an Arrow IPC stream: one schema, data, and one end.

    ``cancel`` stops the jobs that the cursor started; afterwards, as after
    ``close``, it gives no more chunks.
    """

    def __init__(self, df: DataFrame, limits: RuntimeLimits = RuntimeLimits(), chunk_bytes: int = CHUNK_BYTES, deadline: float | None = None):
        self.df, self.limits, self.chunk_bytes = df, limits, chunk_bytes
        self.tag = f"cursor-{uuid.uuid4().hex}"
        self.rows = self.bytes = 0
        self.cancelled = self.closed = False
        self._timer = threading.Timer(deadline, self.cancel) if deadline else None

    def cancel(self) -> None:
        self.cancelled = True
        self.df.sparkSession.sparkContext.cancelJobsWithTag(self.tag)

    def close(self) -> None:
        self.closed = True
        if self._timer:
            self._timer.cancel()

    def _count(self, chunk: Chunk) -> Chunk:
        self.rows += chunk.rows
        self.bytes += len(chunk.data)
        for used, most, what in ((self.rows, self.limits.max_result_rows, "rows"), (self.bytes, self.limits.max_arrow_ipc_bytes, "Arrow bytes")):
            if most is not None and used > most:
                self.close()
                raise QueryError(ErrorCode.RESOURCE_EXHAUSTED, f"the result has more than {most} {what}", resource=Resource.RESULT_OUTPUT)
        return chunk

    def _batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        context = self.df.sparkSession.sparkContext

        def encoded(batches):
            import pyarrow

            for batch in batches:
                yield pyarrow.RecordBatch.from_arrays([pyarrow.array([batch.serialize().to_pybytes()], pyarrow.binary())], ["data"])

        context.addJobTag(self.tag)
        try:
            for row in self.df.mapInArrow(encoded, "data binary").toLocalIterator(prefetchPartitions=False):
                if self.cancelled or self.closed:
                    return
                yield pa.ipc.read_record_batch(pa.py_buffer(row["data"]), schema)
        finally:
            context.removeJobTag(self.tag)

    def __iter__(self) -> Iterator[Chunk]:
        schema = self.df.limit(0).toArrow().schema
        sink = io.BytesIO()
        writer = pa.ipc.new_stream(sink, schema)

        def taken() -> bytes:
            data = sink.getvalue()
            sink.seek(0)
            sink.truncate()
            return data

        if self._timer:
            self._timer.start()
        try:
            yield self._count(Chunk("schema", taken()))
            for batch in self._batches(schema):
                step = max(1, int(batch.num_rows * self.chunk_bytes / max(batch.nbytes, 1)))
                for at in range(0, batch.num_rows, step):
                    writer.write_batch(piece := batch.slice(at, step))
                    yield self._count(Chunk("data", taken(), piece.num_rows))
            if self.cancelled:
                raise QueryError(ErrorCode.EXECUTION_FAILED, "the query was cancelled")
            writer.close()
            yield self._count(Chunk("end", taken()))
        finally:
            self.close()


def arrow_bytes(df: DataFrame, limits: RuntimeLimits = RuntimeLimits()) -> bytes:
    return b"".join(chunk.data for chunk in ArrowCursor(df, limits))


@dataclass(frozen=True)
class Preview:
    columns: list[str]
    rows: list[list[str | None]]
    truncated: bool


def preview(df: DataFrame, rows: int = 100, string_bytes: int = 65536, limits: RuntimeLimits = RuntimeLimits()) -> Preview:
    """The first rows as text, within a row and a byte budget; the limits can only tighten the latter."""
    if limits.max_preview_string_bytes is not None:
        string_bytes = min(string_bytes, limits.max_preview_string_bytes)
    got, used, cut = [], 0, False
    first = df.limit(rows + 1).collect()
    for row in first[:rows]:
        texts = [None if v is None else str(v) for v in row]
        used += sum(len(t.encode()) for t in texts if t is not None)
        if used > string_bytes:
            cut = True
            break
        got.append(texts)
    return Preview(df.columns, got, cut or len(first) > rows)


def pages(df: DataFrame, size: int = 500) -> Iterator[tuple[list, bool]]:
    """(rows, whether more follow) page by page; one row more than a page is asked for to tell."""
    from tidelake.operators.session import page

    offset = 0
    while True:
        rows = page(df, ResultPage(size + 1, offset)).collect()
        yield rows[:size], len(rows) > size
        if len(rows) <= size:
            return
        offset += size
