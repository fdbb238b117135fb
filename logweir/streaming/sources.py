"""Streaming sources and sinks: growing files and UDP datagrams, read by executors as byte ranges, and UDP forwarding.

The driver only knows offsets. A file that grows is cut into ranges at each trigger, and tasks read the lines that begin in theirs.
Datagrams are appended to a journal, a folder that driver and executors share, before they get an offset; so what was received outlives
the process that received it, and is read again until its batch is committed.
"""

from __future__ import annotations

import os
import socket
import struct
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "source string, line_no long, raw_bytes binary"
#: Bytes of a range of a file, of what is looked through for a line's end at once, and of a batch of records.
RANGE, LOOK, HELD = 8 << 20, 1 << 16, 1 << 22
#: Bytes of a journal's segment before the next one begins.
SEGMENT = 8 << 20


def batches(rows: Iterator[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["source", "line_no", "raw_bytes"])

    for row in rows:
        held.append(row)
        size += len(row[2]) + 64
        if size >= HELD:
            yield made()
            held, size = [], 0
    if held:
        yield made()


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file; generation counts the files that stood under the path before."""

    path: str
    start: int
    end: int
    generation: int = 0

    def __post_init__(self):
        super().__init__(None)


def last_line_end(path: str, start: int) -> int:
    """The byte behind the last complete line of a file, at least start; looked for from the end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > start:
            step = min(LOOK, at - start)
            f.seek(at - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                return at - step + found + 1
            at -= step
    return start


class TailReader(DataSourceStreamReader):
    """Complete lines of a growing file under a path that driver and executors share.

    An offset is the file's identity, a generation and the byte behind the last line. If another file stands under the path (the log was
    rotated by renaming), what the old one still holds is read from where it lies now in the folder; a file that got shorter (rotated by
    copying) begins again. line_no is the place of the line: generation and byte.
    """

    def __init__(self, path: str, from_end: bool):
        self.path, self.from_end, self.known = path, from_end, None

    def now(self, at: int, generation: int) -> dict:
        there = os.path.exists(self.path)
        return {"file": os.stat(self.path).st_ino if there else 0, "generation": generation, "at": at if there else 0}

    def initialOffset(self) -> dict:
        return self.now(last_line_end(self.path, 0) if self.from_end and os.path.exists(self.path) else 0, 0)

    def latestOffset(self) -> dict:
        before = self.known or self.initialOffset()
        if not os.path.exists(self.path):
            return before
        same = os.stat(self.path).st_ino == before["file"] and os.path.getsize(self.path) >= before["at"]
        first = before["file"] == 0
        generation = before["generation"] + (not same and not first)
        self.known = self.now(last_line_end(self.path, before["at"] if same else 0), generation)
        return self.known

    def moved(self, file: int) -> str | None:
        """Where a file lies now."""
        folder = os.path.dirname(self.path) or "."
        return next((e.path for e in os.scandir(folder) if e.is_file() and e.inode() == file), None)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = end  # after a restart, what was planned before
        parts, begin = [], start["at"]
        if start["generation"] != end["generation"]:
            old = self.moved(start["file"]) if start["file"] != end["file"] else None
            if old:  # closed: its last line counts even without an end
                parts += self.cut(old, start["at"], os.path.getsize(old), start["generation"])
            begin = 0
        return parts + self.cut(self.path, begin, end["at"], end["generation"])

    @staticmethod
    def cut(path: str, start: int, end: int, generation: int) -> list[Range]:
        return [Range(path, a, min(a + RANGE, end), generation) for a in range(start, end, RANGE)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple[str, int, bytes]]:
            with open(part.path, "rb") as f:
                at = part.start
                if at:  # a line that began before belongs to the range before
                    f.seek(at - 1)
                    at += len(f.readline()) - 1
                while at < part.end:
                    raw = f.readline()
                    if not raw:
                        return
                    yield self.path, part.generation << 48 | at, raw.rstrip(b"\r\n")
                    at += len(raw)

        return batches(lines())

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """spark.readStream.format("tail").option("path", ...).option("from", "end" or "start")"""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("from", "end") == "end")


class Journal:
    """Datagrams in segments of a folder: each with its length before it, forced to disk before position() tells of it."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)
        self.lock = threading.Lock()
        # a crash may have cut the last datagram of the last segment: writing goes on in a new one
        self.segment = max(self.segments(folder), default=-1) + 1
        self.out = open(self.at(folder, self.segment), "xb")
        self.size = 0

    @staticmethod
    def at(folder: str, segment: int) -> str:
        return f"{folder}/{segment:012d}.journal"

    @staticmethod
    def segments(folder: str) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in os.listdir(folder) if n.endswith(".journal")) if os.path.isdir(folder) else []

    def append(self, datagrams: list[bytes]) -> None:
        data = b"".join(struct.pack("<I", len(d)) + d for d in datagrams)
        with self.lock:
            self.out.write(data)
            self.out.flush()
            os.fsync(self.out.fileno())
            self.size += len(data)
            if self.size >= SEGMENT:
                self.out.close()
                self.segment, self.size = self.segment + 1, 0
                self.out = open(self.at(self.folder, self.segment), "xb")

    def position(self) -> dict:
        with self.lock:
            return {"segment": self.segment, "at": self.size}

    def close(self) -> None:
        with self.lock:
            self.out.close()

    @staticmethod
    def datagrams(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(place, datagram) of the whole datagrams in [start, end)."""
        with open(path, "rb") as f:
            f.seek(start)
            at = start
            while at < end:
                head = f.read(4)
                data = f.read(struct.unpack("<I", head)[0]) if len(head) == 4 else b""
                if len(head) < 4 or len(data) < struct.unpack("<I", head)[0]:
                    return  # cut by a crash: it was never told of
                yield at, data
                at += 4 + len(data)


class Receiver:
    """A thread that takes datagrams of up to 65,535 bytes from a port into a journal; all that wait are forced to disk together."""

    def __init__(self, host: str, port: int, journal: Journal):
        self.journal, self.stopped = journal, False
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 1 << 24)
        self.socket.bind((host, port))
        self.socket.settimeout(0.2)
        self.thread = threading.Thread(target=self.receive, daemon=True)
        self.thread.start()

    def receive(self) -> None:
        while not self.stopped:
            try:
                held = [self.socket.recv(65_535)]
            except TimeoutError:
                continue
            except OSError:
                return
            self.socket.setblocking(False)
            try:
                while len(held) < 10_000:
                    held.append(self.socket.recv(65_535))
            except BlockingIOError:
                pass
            self.socket.settimeout(0.2)
            self.journal.append(held)

    def stop(self) -> None:
        self.stopped = True
        self.thread.join()
        self.socket.close()
        self.journal.close()


class UdpReader(DataSourceStreamReader):
    """Datagrams of a journal, which this reader's process fills from a port. Segments before a committed offset are removed."""

    receivers: dict[tuple[str, int, str], Receiver] = {}

    def __init__(self, host: str, port: int, folder: str):
        self.host, self.port, self.folder = host, port, folder

    def receiver(self) -> Receiver:
        key = (self.host, self.port, self.folder)
        if key not in self.receivers or self.receivers[key].stopped:
            self.receivers[key] = Receiver(self.host, self.port, Journal(self.folder))
        return self.receivers[key]

    def initialOffset(self) -> dict:
        return {"segment": min(Journal.segments(self.folder), default=0), "at": 0}

    def latestOffset(self) -> dict:
        return self.receiver().journal.position()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for s in Journal.segments(self.folder):
            if start["segment"] <= s <= end["segment"]:
                path = Journal.at(self.folder, s)
                first, last = start["at"] if s == start["segment"] else 0, end["at"] if s == end["segment"] else os.path.getsize(path)
                out += [Range(path, first, last, s)] if first < last else []
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        source = f"udp:{self.host}:{self.port}"
        return batches((source, part.generation << 32 | at, data) for at, data in Journal.datagrams(part.path, part.start, part.end))

    def commit(self, end: dict) -> None:
        for s in Journal.segments(self.folder):
            if s < end["segment"]:
                os.remove(Journal.at(self.folder, s))

    def stop(self) -> None:
        if found := self.receivers.pop((self.host, self.port, self.folder), None):
            found.stop()


class UdpSource(DataSource):
    """spark.readStream.format("udp").option("host", ...).option("port", 5140).option("journal", folder)"""

    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return SCHEMA

    def place(self) -> tuple[str, int]:
        return self.options.get("host", "127.0.0.1"), int(self.options.get("port", 5140))

    def streamReader(self, schema) -> UdpReader:
        return UdpReader(*self.place(), self.options["journal"])

    def writer(self, schema, overwrite: bool) -> UdpWriter:
        return UdpWriter(*self.place())

    def streamWriter(self, schema, overwrite: bool) -> UdpStreamWriter:
        return UdpStreamWriter(*self.place())


class UdpWriter(DataSourceWriter):
    """Sends the first column of each row as a datagram, without waiting for an answer."""

    def __init__(self, host: str, port: int):
        self.address = (host, port)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for row in rows:
                data = row[0] if isinstance(row[0], (bytes, bytearray)) else str(row[0]).encode()
                out.sendto(bytes(data)[:65_507], self.address)
        return WriterCommitMessage()


class UdpStreamWriter(UdpWriter, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        pass

    def abort(self, messages, batchId: int) -> None:
        pass


def register(spark) -> None:
    for kind in (TailSource, UdpSource):
        spark.dataSource.register(kind)
