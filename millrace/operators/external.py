"""Lines through an external command, such as a tagger that reads and writes lines."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterable, Iterator
from queue import SimpleQueue
from threading import Thread

import pyarrow as pa
from pyspark.sql import DataFrame

_ROWS = 2_000


def pipe(lines: DataFrame, command: list[str], column: str = "value", out: str = "value") -> DataFrame:
    """lines with the command's output line for each line, in the column ``out``.

    A command runs once for each partition, and must write one line for each line that it reads, in
    order. A thread feeds it, as far ahead as the command itself buffers. Null counts as an empty line;
    line ends within a line become blanks, since they would be lines of their own. A command that fails, or
    that writes more or fewer lines, stops the query with the end of its messages. An empty partition
    starts no command.
    """
    rest = [c for c in lines.columns if c != out]

    def piped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (whole.slice(k, _ROWS) for whole in batches for k in range(0, whole.num_rows, _ROWS))
        first = next(small, None)
        if first is not None:
            with tempfile.TemporaryFile() as messages:
                yield from _through(command, messages, first, small)

    def _through(command, messages, first, others) -> Iterator[pa.RecordBatch]:
        process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=messages)
        fed: SimpleQueue = SimpleQueue()

        def feed() -> None:
            """Puts each batch on the queue and its lines into the command; None or an error comes last."""
            end = None
            try:
                batch = first
                while batch is not None:
                    fed.put(batch)
                    process.stdin.write("".join(" ".join((v or "").splitlines()) + "\n" for v in batch.column(column).to_pylist()).encode())
                    batch = next(others, None)
                process.stdin.close()
            except BrokenPipeError:
                pass  # the command's exit or its missing lines tell
            except BaseException as error:  # noqa: BLE001 - raised again by the reader
                end = error
                process.kill()
            fed.put(end)

        def check(right: bool, what: str) -> None:
            if not right:
                size = messages.seek(0, 2)
                messages.seek(max(0, size - 2000))
                raise RuntimeError(f"{command[0]} {what}: {messages.read().decode(errors='replace')}")

        feeder = Thread(target=feed, daemon=True)
        feeder.start()
        try:
            while isinstance(batch := fed.get(), pa.RecordBatch):
                got = [line for _ in range(batch.num_rows) if (line := process.stdout.readline())]
                if len(got) < batch.num_rows:
                    check(False, f"wrote too few lines (exit {process.wait()})")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([line.decode().rstrip("\r\n") for line in got], pa.string())], [*rest, out])
            if batch is not None:
                raise batch
            check(not process.stdout.readline(), "wrote too many lines")
            check(process.wait() == 0, f"ended with exit {process.returncode}")
        finally:
            process.kill()
            process.wait()

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name != out), f"`{out}` string"]
    return lines.mapInArrow(piped, ", ".join(fields))
