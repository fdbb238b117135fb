"""Growing files and datagrams: what is read, by whom, after rotations and crashes."""

import os
import socket
import struct
import time

import pytest

from logweir.client import Client
from logweir.streaming import ingest, sources


def rows_of(reader, start, end):
    out = []
    for part in reader.partitions(start, end):
        for b in reader.read(part):
            out += zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines_are_read_once_whatever_the_ranges(tmp_path, monkeypatch, size):
    monkeypatch.setattr(sources, "RANGE", size)
    monkeypatch.setattr(sources, "LOOK", 3)
    log = tmp_path / "a.log"
    text = [b"x" * (i % 11) for i in range(60)]
    log.write_bytes(b"\n".join(text[:40]) + b"\nhalf")
    reader = sources.TailReader(str(log), False)
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert [raw for _, raw in rows_of(reader, start, first)] == text[:40]
    with log.open("ab") as f:
        f.write(b" a line\n" + b"\r\n".join(text[40:]) + b"\n")
    second = reader.latestOffset()
    got = rows_of(reader, first, second)
    assert [raw for _, raw in got] == [b"half a line", *text[40:]]
    assert len({at for at, _ in got}) == len(got) and rows_of(reader, first, second) == got
    assert rows_of(reader, second, reader.latestOffset()) == []


def test_rotation_by_renaming_and_by_copying(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntwo\n")
    reader = sources.TailReader(str(log), True)
    start = reader.initialOffset()
    reader.known = start
    with log.open("ab") as f:
        f.write(b"three\nlast of the old")
    os.rename(log, tmp_path / "a.log.1")
    log.write_bytes(b"new\n")
    end = reader.latestOffset()
    assert [raw for _, raw in rows_of(reader, start, end)] == [b"three", b"last of the old", b"new"]
    log.write_bytes(b"x\n")  # shorter, the same file
    again = reader.latestOffset()
    assert [raw for _, raw in rows_of(reader, end, again)] == [b"x"] and again["generation"] == 2
    absent = sources.TailReader(str(tmp_path / "later.log"), False)
    start = absent.initialOffset()
    assert absent.latestOffset() == start
    (tmp_path / "later.log").write_bytes(b"here\n")
    assert [raw for _, raw in rows_of(absent, start, absent.latestOffset())] == [b"here"]


def test_no_record_passes_the_driver(spark, tmp_path, monkeypatch):
    """Lines are read in tasks: the reader's own process only plans ranges."""
    sources.register(spark)
    monkeypatch.setattr(sources, "RANGE", 1000)
    (tmp_path / "big.log").write_text("".join(f"line {i} of a log\n" for i in range(500)))
    stream = spark.readStream.format("tail").option("path", str(tmp_path / "big.log")).option("from", "start").load()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("raw_bytes").distinct().count() == 500


def sent(port, texts):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
        for t in texts:
            out.sendto(t, ("127.0.0.1", port))


def free_port():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def waited(test):
    end = time.time() + 20
    while not test() and time.time() < end:
        time.sleep(0.05)
    assert test()


def test_datagrams_outlive_a_reader_that_dies_before_the_commit(tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "SEGMENT", 40)
    port, folder = free_port(), str(tmp_path / "journal")
    reader = sources.UdpReader("127.0.0.1", port, folder)
    start = reader.initialOffset()
    reader.latestOffset()
    texts = [b"datagram %d" % i for i in range(9)] + [b"", b"with\nline ends\n"]
    sent(port, texts)
    end = {}
    waited(lambda: (end.update(reader.latestOffset()) or len(rows_of(reader, start, end))) == len(texts))
    reader.stop()  # the process goes; nothing was committed
    with open(sources.Journal.at(folder, max(sources.Journal.segments(folder))), "ab") as f:
        f.write(struct.pack("<I", 50) + b"cut")  # by a crash while it was written
    again = sources.UdpReader("127.0.0.1", port, folder)
    assert [raw for _, raw in rows_of(again, again.initialOffset(), again.latestOffset())] == texts
    sent(port, [b"later"])
    more = {}
    waited(lambda: (more.update(again.latestOffset()) or [raw for _, raw in rows_of(again, end, more)]) == [b"later"])
    again.commit(more)
    assert min(sources.Journal.segments(folder)) == more["segment"] > start["segment"]
    again.stop()


def test_records_are_forwarded(spark, tmp_path):
    sources.register(spark)
    port = free_port()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as taker:
        taker.bind(("127.0.0.1", port))
        taker.settimeout(10)
        spark.createDataFrame([("one",), ("two",)], "t string").write.format("udp").mode("append").option("port", port).save()
        assert sorted(taker.recv(100) for _ in range(2)) == [b"one", b"two"]


def test_windows_of_a_stream(spark, tmp_path):
    rows = [(1_000 * i, f"10.0.0.{i % 2}", "Failed" if i % 3 == 0 else "Accepted") for i in range(600)]
    spark.createDataFrame(rows, "timestamp long, src_ip string, activity_name string").write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("timestamp long, src_ip string, activity_name string").parquet(str(tmp_path / "rows"))
    query = ingest.windowed(stream, "5 minutes").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["start"].minute, r["src_ip"]): (r["events"], r["failed"]) for r in spark.table("windowed").collect()}
    assert got == {(m, f"10.0.0.{k}"): (150, 50) for m in (0, 5) for k in (0, 1)}


def test_a_collector_writes_a_lake(spark, tmp_path):
    sources.register(spark)
    port, into = free_port(), str(tmp_path / "lake")
    query = ingest.collect(spark, "127.0.0.1", port, into, str(tmp_path / "journal"), str(tmp_path / "cp"), every="1 second")
    try:
        waited(lambda: os.path.isdir(tmp_path / "journal"))
        end = time.time() + 90
        while time.time() < end:
            sent(port, [b"temp=1 status=ok", b"Feb  3 08:09:10 bastion sshd[31]: Failed publickey for deploy from 10.5.5.5 port 2200 ssh2"])
            time.sleep(3)
            if os.path.isdir(f"{into}/_manifest"):
                break
        query.processAllAvailable()
    finally:
        query.stop()
    client = Client(spark, into)
    assert client.verify().first()["ok"] and client.query("src_ip = '10.5.5.5'").count() >= 1
    assert {r["raw_payload"] for r in client.query().collect()} == {"temp=1 status=ok", "Feb  3 08:09:10 bastion sshd[31]: Failed publickey for deploy from 10.5.5.5 port 2200 ssh2"}
