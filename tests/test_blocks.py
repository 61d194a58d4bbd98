"""Logs by block ranges: the stored cursor over restarts, and what a range reads."""

import pytest
from pyspark.sql import functions as F

from launchsift.sources import readers, sinks
from launchsift.streaming import blocks

SCHEMA = "block bigint, address string, topics array<string>, data string, transactionHash string"
PAD = "0x" + "0" * 24


def logged(numbers):
    return [
        (n, "0xf" if n % 5 else "0xother", ["sig", PAD + f"{n:040x}", PAD + f"{n + 1:040x}"], "", f"0x{n:x}")
        for n in numbers
    ]


def test_a_range_reads_its_folders_alone(spark, table, rows, tmp_path):
    path = str(tmp_path / "logs")
    readers.write_logs(table([*logged(range(0, 60)), (None, "0xf", ["sig"], "", None)], SCHEMA), path, width=10)
    found = readers.read_logs_since(spark, path, 17, 31, "0xf", "sig", width=10)
    assert rows(found, "block") == [(n,) for n in range(18, 32) if n % 5]
    read = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("block_range=")[1][:1] for r in read} == {"1", "2", "3"}
    assert rows(readers.read_logs_since(spark, path, 17, 17, "0xf", "sig", width=10)) == []


def test_a_broken_batch_is_repeated_over_the_same_blocks(spark, tmp_path):
    cursor, seen, broken = str(tmp_path / "cursor"), [], {1}

    def work(batch, first, last):
        seen.append((batch, first, last))
        if batch in broken:
            broken.remove(batch)
            raise RuntimeError("lost")

    assert blocks.BlockCursor(spark, cursor, start=4).last_block() == 4
    with pytest.raises(RuntimeError):
        blocks.BlockCursor(spark, cursor, start=4).advance(17, 10, work)
    assert blocks.BlockCursor(spark, cursor, start=4).last_block() == 14
    # The head has moved on, the broken batch keeps its range.
    assert blocks.BlockCursor(spark, cursor, start=4).advance(30, 10, work) == 30
    assert blocks.BlockCursor(spark, cursor).advance(30, 10, work) == 30
    assert blocks.BlockCursor(spark, cursor).advance(12, 10, work) == 30
    assert seen == [(0, 5, 14), (1, 15, 17), (1, 15, 17), (2, 18, 27), (3, 28, 30)]


def test_launches_are_stored_once_over_restarts(spark, table, rows, tmp_path):
    logs, store, cursor = (str(tmp_path / n) for n in ("logs", "findings", "cursor"))
    readers.write_logs(table(logged(range(1, 26)), SCHEMA), logs, width=10)
    broken = [True]

    def loses_the_first(made, path, name):
        sinks.store_findings(made, path, name)
        if broken:
            broken.pop()
            raise RuntimeError("lost after storing")

    def hunt(latest):
        return blocks.hunt_logs(
            spark, logs, store, cursor, latest, "0xf", "sig", lambda batch: f"2024-02-01T00:00:{batch:02d}Z",
            blocks=15, width=10, store=loses_the_first,
        )

    with pytest.raises(RuntimeError):
        hunt(20)
    assert hunt(20) == 20
    readers.write_logs(table(logged(range(26, 31)), SCHEMA), logs, width=10)
    assert hunt(30) == 30
    found = spark.read.parquet(store).select(F.get_json_object("payload", "$.token_address").alias("token_address"))
    assert rows(found) == sorted((f"0x{n:040x}",) for n in range(1, 31) if n % 5)
