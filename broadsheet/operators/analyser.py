"""An external analyser behind a pipe: texts are cut into chunks, a process of each task reads them, samples are put together again."""

from __future__ import annotations

import queue
import re
import subprocess
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters of a chunk, white space to cut at, and the word that ends a chunk on its way.
LIMIT, SPACES, MARK = 40_000, (" ", " ", "\n", "\t"), "partSeparator"
#: Pieces of an analyser's output that may wait, bytes of one at most, and seconds without any after which it counts as stuck.
WAITING, PIECE, PATIENCE = 64, 1 << 18, 600


def chunks(text: str, limit: int = LIMIT) -> Iterator[tuple[int, str]]:
    """(part, chunk): pieces of at most limit characters, cut after the last white space of each window."""
    at, part = 0, 0
    while len(text) - at > limit:
        cut = max(text.rfind(c, at, at + limit) for c in SPACES)
        if cut < at:
            raise ValueError("no white space to cut at")
        yield part, text[at : cut + 1]
        at, part = cut + 1, part + 1
    yield part, text[at:]


def register(spark: SparkSession, name: str = "text_chunks") -> None:
    """The chunks as a table function for SQL: SELECT d.id, c.* FROM docs d, LATERAL text_chunks(d.text, 40000) c; null gives none."""

    class Chunks:
        def eval(self, text: str, limit: int):
            if text is not None:
                yield from chunks(text, limit)

    spark.udtf.register(name, F.udtf(Chunks, returnType="part int, chunk string"))


class Pipe:
    """A process that reads lines and writes lines; one thread feeds it while another takes what it says, so neither waits for the other."""

    def __init__(self, command: list[str], mark: str) -> None:
        self.mark = mark
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self.rest = b""
        self.said: queue.Queue = queue.Queue(WAITING)
        self.fed: queue.Queue = queue.Queue(8)
        self.over = threading.Event()
        for work in (self.feed, self.take):
            threading.Thread(target=work, daemon=True).start()

    def feed(self) -> None:
        try:
            while (text := self.fed.get()) is not None:
                # a chunk's lines stand before a line with the mark alone
                self.process.stdin.write(f"{text}\n{self.mark}\n".encode())
                self.process.stdin.flush()
            self.process.stdin.close()
        except OSError:  # it has ended; take() tells
            pass

    def take(self) -> None:
        while piece := self.process.stdout.read1(PIECE):
            self.said.put(piece)
        self.said.put(b"")

    def send(self, text: str) -> None:
        while True:
            try:
                return self.fed.put(text, timeout=1)
            except queue.Full:
                if self.process.poll() is not None:
                    raise RuntimeError(f"the analyser ended with {self.process.returncode}") from None

    def lines(self) -> list[str]:
        """What is said up to the next mark: the token lines of a chunk. It is looked for in pieces of output, not line by line."""
        end = re.compile(rb"(?:^|\n)" + re.escape(self.mark.encode()) + rb"(?:\{[^\n]*)?\r?\n")
        parts = [self.rest]
        while True:
            # a line is whole when its end has come, so all but the last one of the pieces are looked through
            if b"\n" in parts[-1]:
                said = b"".join(parts)
                looked = sum(map(len, parts[:-1]))
                if found := end.search(said, max(0, said.rfind(b"\n", 0, max(0, said.rfind(b"\n", 0, looked))))):
                    self.rest = said[found.end() :]
                    return [x for x in said[: found.start()].decode().replace("\r\n", "\n").replace("\r", "\n").split("\n") if x]
            try:
                piece = self.said.get(timeout=PATIENCE)
            except queue.Empty:
                raise RuntimeError("the analyser says nothing any more") from None
            if not piece:
                raise RuntimeError(f"the analyser ended with {self.process.wait()} before the end of a chunk")
            parts.append(piece)

    def close(self) -> None:
        self.process.kill()
        self.process.wait()


#: Chunks that are on their way to the process at once.
AHEAD = 4


def piped(samples: DataFrame, key: str, text: str, command: list[str], limit: int = LIMIT, mark: str = MARK) -> DataFrame:
    """key, lines: what an analyser says about each sample, a token a line, as samples.analysed() reads it.

    command: a program that every executor has; it reads text lines and writes a line for each token, form{analysis}, and has
    to write out what it has when a line with the mark alone comes, in whose place it says one of that form. Each task
    runs one process and holds one sample's lines. Null and empty texts have no lines; row order and repeated rows stay. A text
    that has the mark in it is an error.
    """
    rows = samples.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = samples.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pipe = None
        try:
            for b in batches:
                for i, t in enumerate(b.column("text").to_pylist()):
                    if mark in (t or ""):
                        raise ValueError("a text has the mark that ends chunks")
                    said: list[str] = []
                    if t and t.strip():
                        pipe = pipe or Pipe(command, mark)
                        waiting = 0
                        for _, chunk in chunks(t, limit):
                            pipe.send(chunk)
                            waiting += 1
                            if waiting == AHEAD:
                                said += pipe.lines()
                                waiting -= 1
                        for _ in range(waiting):
                            said += pipe.lines()
                    yield pa.RecordBatch.from_arrays([b.column("key").slice(i, 1), pa.array(["\n".join(said)], pa.string())], names=["key", "lines"])
        finally:
            if pipe is not None:
                pipe.close()

    return rows.mapInArrow(run, f"key {kind}, lines string").withColumnRenamed("key", key)
