"""Minute files as a stream: due ones alone, oldest first, five a batch, each once over restarts."""

import gzip
from datetime import datetime, timedelta

from ferrule.sources import minutes

NOW = datetime(2026, 7, 12, 16, 30, 40)


def land(folder, *ages):
    folder.mkdir(exist_ok=True)
    for age in ages:
        name = (NOW - timedelta(minutes=age)).strftime("%Y%m%d%H%M")
        with gzip.open(folder / f"{name}00.grams.gz", "wt") as out:
            out.write(f"{name}\tone two\t1\n{name}\tthree\t2")


def step(spark, tmp_path, now):
    """What one more run adds: (batch, minute) in order."""
    got = []
    stream = minutes.minute_stream(spark, str(tmp_path / "in"), now=now.isoformat())
    query = stream.writeStream.foreachBatch(lambda df, n: got.append((n, [r.minute for r in df.orderBy("minute").collect()]))).option("checkpointLocation", str(tmp_path / "c"))
    query = query.trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return [batch for _, batch in got if batch]


def ages(*values, now=NOW):
    return [(now - timedelta(minutes=a)).strftime("%Y%m%d%H%M") for a in values]


def test_due_files_oldest_first_five_a_batch_each_once(spark, tmp_path):
    land(tmp_path / "in", *range(1, 26))
    (tmp_path / "in" / "_202607121620").write_text("being written")
    (tmp_path / "in" / "notes.txt").write_text("no minute")
    assert step(spark, tmp_path, NOW) == [ages(20, 19, 18, 17, 16)]
    assert step(spark, tmp_path, NOW) == [ages(15, 14, 13, 12, 11)]
    later = NOW + timedelta(minutes=9)
    assert step(spark, tmp_path, later) == [ages(10, 9, 8, 7, 6)]
    assert step(spark, tmp_path, later) == [ages(5, 4, 3, 2, 1)]
    assert step(spark, tmp_path, later) == []


def test_what_got_too_old_is_passed_over(spark, tmp_path):
    land(tmp_path / "in", 20, 6)
    assert step(spark, tmp_path, NOW + timedelta(minutes=3)) == [ages(6)]


def test_a_batch_that_failed_comes_again_with_the_same_files(spark, tmp_path):
    land(tmp_path / "in", *range(5, 21))
    stream = minutes.minute_stream(spark, str(tmp_path / "in"), now=NOW.isoformat())

    def fail(df, n):
        raise ValueError("lost")

    query = stream.writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
    except Exception as error:
        assert "lost" in str(error)
    assert step(spark, tmp_path, NOW + timedelta(hours=1))[0] == ages(20, 19, 18, 17, 16)


def test_no_folder_yet(spark, tmp_path):
    assert step(spark, tmp_path, NOW) == []


def test_lines_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minutes, "LINES", 1)
    land(tmp_path / "in", 5, 6)
    (tmp_path / "in" / "202607121600.txt").write_bytes(b"a\r\n\n\xff\n")
    files = spark.createDataFrame(minutes.landed(str(tmp_path / "in")), "minute string, path string")
    found = sorted((r.minute, r.line, r.value) for r in minutes.lines_of(files).collect())
    five, six = ages(5), ages(6)
    assert found == sorted([("202607121600", 0, "a"), ("202607121600", 1, ""), ("202607121600", 2, "�")] + [(m, n, v) for (m,) in (five, six) for n, v in ((0, f"{m}\tone two\t1"), (1, f"{m}\tthree\t2"))])
