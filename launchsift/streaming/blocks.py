"""Launch logs by block ranges, with a stored cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from launchsift.functions.schemas import CANDIDATE, LONG, struct
from launchsift.operators.envelope import build_envelopes
from launchsift.operators.ingest import decode_launch_logs, normalize_candidates
from launchsift.sources.files import exists, listed, remove
from launchsift.sources.readers import read_logs_since
from launchsift.sources.sinks import store_findings
from launchsift.streaming.jobs import named

STEP = struct(first=LONG, last=LONG)


class BlockCursor:
    """The block range of the newest batch, and whether that batch is finished.

    A batch's range is written before its work begins and stays as it is, so a batch that was
    broken off is repeated over the very same blocks under the same number, whatever the chain's
    head is by then.  With work that replaces what an earlier attempt of the batch left, cursor
    and output move together: no block is left out and none counts twice.
    """

    def __init__(self, spark: SparkSession, path: str, start: int = 0) -> None:
        """Blocks after ``start`` are new to a cursor that does not exist yet."""
        self.spark, self.path, self.start = spark, path, start

    def _newest(self) -> tuple[int, int, int] | None:
        """(batch, first block, last block) of the batch begun last."""
        begun = [path for path, _ in listed(self.spark, self.path) if exists(self.spark, f"{path}/_SUCCESS")]
        if not begun:
            return None
        path = max(begun, key=lambda p: int(p.rsplit("=", 1)[1]))
        return int(path.rsplit("=", 1)[1]), *self.spark.read.schema(STEP).parquet(path).first()

    def _done(self, batch: int) -> str:
        return f"{self.path}_done/batch={batch}"

    def last_block(self) -> int:
        """The last block of the last finished batch."""
        newest = self._newest()
        if newest is None:
            return self.start
        batch, first, last = newest
        return last if exists(self.spark, self._done(batch)) else first - 1

    def advance(self, latest: int, blocks: int, work: Callable[[int, int, int], None]) -> int:
        """Calls ``work(batch, first, last)`` for ranges of up to ``blocks`` blocks up to ``latest``.

        An unfinished batch comes first.  Returns the last block done.
        """
        newest = self._newest()
        batch, first, last = newest or (-1, 0, self.start)
        if newest is not None and not exists(self.spark, self._done(batch)):
            self._finish(batch, first, last, work)
        while last < latest:
            batch, first, last = batch + 1, last + 1, min(last + blocks, latest)
            step = self.spark.createDataFrame([(first, last)], STEP).coalesce(1)
            step.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/batch={batch}")
            self._finish(batch, first, last, work)
        return last

    def _finish(self, batch: int, first: int, last: int, work: Callable[[int, int, int], None]) -> None:
        work(batch, first, last)
        self.spark.createDataFrame([(first, last)], STEP).coalesce(1).write.mode("overwrite").parquet(self._done(batch))
        if batch > 0:  # Two batches tell where the cursor stands.
            remove(self.spark, f"{self.path}/batch={batch - 2}")
            remove(self.spark, self._done(batch - 2))


def hunt_logs(
    spark: SparkSession, logs: str, table: str, cursor: str, latest_block: int, address: str, topic: str,
    now: Callable[[int], str], start: int = 0, blocks: int = 5_000, width: int | None = None,
    store: Callable[[DataFrame, str, str], None] = store_findings,
) -> int:
    """Stores a candidate message for every launch logged after the cursor, up to ``latest_block``.

    ``logs`` are stored by ``write_logs`` with ``width``, if given; a batch then reads only its
    own ranges.  ``now`` gives a batch's time, which a repeated batch must be given again.
    Returns the last block done.
    """

    def work(batch: int, first: int, last: int) -> None:
        found = decode_launch_logs(read_logs_since(spark, logs, first - 1, last, address, topic, width))
        at = now(batch)
        made = build_envelopes(normalize_candidates(found, at), "hunter", CANDIDATE, at)
        store(made, table, named(cursor, batch))

    return BlockCursor(spark, cursor, start).advance(latest_block, blocks, work)
