"""Archives as files, the package source, streams of uploads, sessions of a cache: against zipfile and plain Python."""

import datetime
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith

from leafmill.sinks import archives
from leafmill.sources import packages, scan
from leafmill.streaming import cache, uploads


def zipped(files: dict[str, bytes], how=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, body in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, how)
    return out.getvalue()


def submodels(*ids: str) -> bytes:
    return ('{"submodels":[' + ",".join(f'{{"modelType":"Submodel","id":"{i}"}}' for i in ids) + "]}").encode()


def test_archives_hold_their_rows(spark, tmp_path):
    rows = [("a", "x/1", b"one"), ("a", "x/0", None), ("b/../ü", "f", b"2"), (None, "n", b"3"), ("a", "x/1", b"again"), ("", "e", b"4"), (".h", "h", b"5"), ("_s", "s", b"6"), ("l" * 400, "l", b"7")]
    path = str(tmp_path / "out")
    archives.write(spark.createDataFrame(rows, "batch string, filename string, content binary"), "file://" + path)
    want: dict = {}
    for batch, name, body in rows:
        want.setdefault(archives.file_name(batch), []).append((name, body or b""))
    made = {p.name: p for p in (tmp_path / "out").iterdir()}
    assert set(made) == {*want, "_SUCCESS"}
    for name, entries in want.items():
        with zipfile.ZipFile(made[name]) as z:
            assert [(i.filename, z.read(i)) for i in z.infolist()] == sorted(entries)
            assert z.testzip() is None
    again = {n: p.read_bytes() for n, p in made.items()}
    archives.write(spark.createDataFrame(rows[::-1], "batch string, filename string, content binary"), "file://" + path)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == again  # replaced by equal bytes
    assert scan.parts(spark, path).where("error is null").count() == len(rows)


def test_a_failed_attempt_leaves_nothing(tmp_path):
    writer = archives.ArchiveWriter({"path": "file://" + str(tmp_path)})
    batch = pa.RecordBatch.from_pydict({"batch": ["a", "b"], "filename": ["1", "1"], "content": [b"x", b"y"]})

    def lost():
        yield batch
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    assert not (tmp_path / "b.zip").exists()
    done = writer.write(iter([batch]))  # the next attempt
    writer.commit([done])
    assert (done.archives, done.files) == (2, 2) and sorted(p.name for p in tmp_path.iterdir()) == ["_SUCCESS", "a.zip", "b.zip"]
    assert zipfile.ZipFile(tmp_path / "a.zip").read("1") == b"x"


def test_no_rows_and_no_names(spark, tmp_path):
    schema = "batch string, filename string, content binary"
    archives.write(spark.createDataFrame([], schema), f"file://{tmp_path}/none")
    assert [p.name for p in (tmp_path / "none").iterdir()] == ["_SUCCESS"] and scan.parts(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="without a name"):
        archives.write(spark.createDataFrame([("a", None, b"")], schema), f"file://{tmp_path}/bad")
    assert not [p for p in (tmp_path / "bad").rglob("*.zip")] if (tmp_path / "bad").exists() else True


class Counted(scan.PackageReader):
    """Counts the bytes that are read of files."""

    count = 0

    def opened(self, address):
        inner = super().opened(address)
        me = self

        class File(io.RawIOBase):
            def readable(self):
                return True

            def seekable(self):
                return True

            def seek(self, at, whence=0):
                return inner.seek(at, whence)

            def tell(self):
                return inner.tell()

            def read(self, n=-1):
                out = inner.read() if n is None or n < 0 else inner.read(n)
                me.count += len(out)
                return out

        return File()


def test_scan_reads_the_parts_asked_for(tmp_path):
    big = bytes(range(256)) * 4000
    (tmp_path / "a.aasx").write_bytes(zipped({"big.bin": big, "aasx/data.json": submodels("urn:1"), "more.bin": big}, zipfile.ZIP_STORED))
    reader = Counted({"path": str(tmp_path)})
    assert len(list(reader.pushFilters([EqualTo(("ext",), "json"), StringStartsWith(("part",), "/aasx/")]))) == 2  # Spark tests them too
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[1], r[4]) for r in rows] == [("/aasx/data.json", submodels("urn:1"))]
    assert reader.count < 5_000 < 2 * len(big)
    whole = Counted({"path": str(tmp_path)})
    assert [r[1] for p in whole.partitions() for r in whole.read(p)] == ["/big.bin", "/aasx/data.json", "/more.bin"] and whole.count > 2 * len(big)


@pytest.mark.parametrize("split", [1_000, 30_000, 1 << 27])
def test_splits_give_each_part_once(spark, tmp_path, split):
    files = {f"p/{i}.json": submodels(f"urn:{i}") * (i % 7) for i in range(40)}
    (tmp_path / "sub").mkdir()
    for name in ("a.aasx", "sub/b c.aasx"):
        (tmp_path / name).write_bytes(zipped(files, zipfile.ZIP_STORED))
    (tmp_path / "bad.aasx").write_bytes(b"no archive" * 1000)
    (tmp_path / "empty.aasx").write_bytes(b"")
    got = scan.parts(spark, f"file://{tmp_path}", split=split)
    rows = got.select(F.substring_index("package", "/", -1).alias("p"), "part", "content", "error").collect()
    want = sorted((p, "/" + n, b) for p in ("a.aasx", "b c.aasx") for n, b in files.items())
    assert sorted((r.p, r.part, bytes(r.content)) for r in rows if not r.error) == want
    assert sorted(r.p for r in rows if r.error) == ["bad.aasx", "empty.aasx"]
    assert got.where("part = '/p/3.json'").count() == 2 and got.where("part in ('/p/3.json', '/p/4.json') and ext = 'json'").count() == 4
    assert sorted(packages.objects(got).where("kind = 'submodel'").groupBy("id").count().select("count").distinct().collect()) == [(2,)]


def test_scan_and_parts_agree_on_bounds_and_broken_parts(spark, tmp_path):
    body = zipped({"a": b"x" * 50, "b": b"y" * 500, "c": b"z" * 80, "d": b"w" * 5}, zipfile.ZIP_STORED)
    (tmp_path / "a.aasx").write_bytes(body.replace(b"z" * 80, b"z" * 79 + b"!"))
    asked = dict(max_part=100, max_package=233)
    one = lambda rows: sorted((r.part, r.error, None if r.content is None else len(r.content)) for r in rows.collect())
    want = one(packages.parts(packages.read(spark, f"file://{tmp_path}"), **asked))
    assert want == one(scan.parts(spark, f"{tmp_path}", maxPart=100, maxPackage=233)) == one(scan.parts(spark, f"{tmp_path}", maxPart=100, maxPackage=233, split=64))
    assert [(p, (e or "").split(":")[0], n) for p, e, n in want] == [("/a", "", 50), ("/b", "ValueError", None), ("/c", "BadZipFile", None), ("/d", "ValueError", None)]
    assert scan.parts(spark, f"{tmp_path}", bodies=False).where("content is null and part is not null").count() == 4


def test_uploads_are_read_once_over_a_restart(spark, tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    put = lambda name, data: (at / name).write_bytes(data)
    put("a.aasx", zipped({"d.json": submodels("urn:1", "urn:2")}))
    put("b.aasx", zipped({"d.json": submodels("urn:1", "urn:2")}))
    put("c.AASX", zipped({"d.json": submodels("urn:3")}))
    put("big.aasx", b"x" * 5000)
    put("broken one+%.aasx", b"no archive")
    run = lambda: uploads.ingest(spark, str(at), f"{tmp_path}/tables", f"{tmp_path}/stream", limit=4000, per_batch=2).awaitTermination()
    run()
    first = {(r.name, r.status, r.error) for r in uploads.log(spark, f"{tmp_path}/tables").collect()}
    assert {x[:2] for x in first if x[0] not in ("a.aasx", "b.aasx")} == {("c.AASX", "rejected"), ("big.aasx", "rejected"), ("broken one+%.aasx", "accepted")}
    assert sorted(s for n, s, _ in first if n in ("a.aasx", "b.aasx")) == ["accepted", "duplicate"]
    put("d.aasx", zipped({"d.json": submodels("urn:1", "urn:2")}))  # seen before the restart
    put("e.aasx", zipped({"d.json": submodels("urn:4"), "x.json": b"{"}))
    run()
    run()  # nothing new
    log = {(r.name, r.status) for r in uploads.log(spark, f"{tmp_path}/tables").collect()}
    assert log == {x[:2] for x in first} | {("d.aasx", "duplicate"), ("e.aasx", "accepted")}
    held = uploads.objects(spark, f"{tmp_path}/tables")
    assert sorted(r.id for r in held.where("kind is not null").collect()) == ["urn:1", "urn:2", "urn:4"]
    assert sorted((r.package.rsplit("/", 1)[-1], r.part) for r in held.where("error is not null").collect()) == [("broken one+%.aasx", None), ("e.aasx", "/x.json")]


def test_a_batch_run_again_writes_the_same(spark, tmp_path):
    schema = "path string, length bigint, content binary"
    one, two = zipped({"d.json": submodels("urn:1")}), zipped({"d.json": submodels("urn:2")})
    batch = lambda *rows: spark.createDataFrame([(p, len(c), c) for p, c in rows], schema)
    tables = f"{tmp_path}/t"
    for _ in range(2):
        uploads.add(batch(("/a.aasx", one), ("/b.aasx", one)), 0, tables)
    for _ in range(2):
        uploads.add(batch(("/c.aasx", one), ("/d.aasx", two)), 1, tables)
    uploads.add(spark.createDataFrame([], schema), 2, tables)
    assert sorted((r.name, r.status, r.batch_id) for r in uploads.log(spark, tables).collect()) == [("a.aasx", "accepted", 0), ("b.aasx", "duplicate", 0), ("c.aasx", "duplicate", 1), ("d.aasx", "accepted", 1)]
    assert sorted(r.id for r in uploads.objects(spark, tables).collect()) == ["urn:1", "urn:2"]


HOUR = datetime.timedelta(hours=1)
START = datetime.datetime(2024, 1, 1)


def sessions(rows, hours=24):
    out = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key and t is not None)
        for t in times:
            if out and out[-1][0] == key and t - out[-1][2] < hours * HOUR:
                out[-1] = (key, out[-1][1], t, t + hours * HOUR, out[-1][4] + 1)
            else:
                out.append((key, t, t, t + hours * HOUR, 1))
    return sorted(out, key=str)


def test_cache_sessions_end_at_exactly_the_time_to_live(spark):
    us = datetime.timedelta(microseconds=1)
    rows = [("a", START), ("a", START + 24 * HOUR), ("b", START), ("b", START + 24 * HOUR - us), ("b", START), (None, START), ("c", None), ("d", START), ("d", START + 24 * HOUR + us)]
    utc = [(k, t and t.replace(tzinfo=datetime.timezone.utc)) for k, t in rows]
    plain = lambda df: sorted((tuple(r) for r in df.select("key", *[F.col(c).cast("timestamp_ntz") for c in ("since", "last", "until")], "writes").collect()), key=str)
    assert plain(cache.held(spark.createDataFrame(utc, "key string, at timestamp"), "key", "at")) == sessions(rows)
    assert plain(cache.held(spark.createDataFrame([], "key string, at timestamp"), "key", "at")) == []


def test_cache_stream_tells_what_ended_over_a_restart(spark, tmp_path):
    rows = [(f"k{i % 5}", START + (i * i % 400) * HOUR) for i in range(60)]
    parts = sorted(rows, key=lambda r: r[1])
    (tmp_path / "in").mkdir()

    def run(some):
        spark.createDataFrame([(k, t.replace(tzinfo=datetime.timezone.utc)) for k, t in some], "key string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        held = cache.held(spark.readStream.schema("key string, at timestamp").parquet(f"{tmp_path}/in"), "key", "at", late="1 hour")
        held.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    run(parts[:30])
    run(parts[30:])
    ended = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("key", *[F.col(c).cast("timestamp_ntz") for c in ("since", "last", "until")], "writes").collect()), key=str)
    mark = max(t for _, t in rows) - HOUR
    assert ended == [s for s in sessions(rows) if s[3] <= mark]


def test_a_batch_of_many_uploads_is_few_tasks(spark, tmp_path):
    """Files are listed and read by some tasks, not by one each, and every archive is read once."""
    at = tmp_path / "in"
    at.mkdir()
    for i in range(70):
        (at / f"{i}.aasx").write_bytes(b"no zip" if i % 2 else zipped({"a.json": submodels(f"urn:{i}")}))
    before, tracker = spark.conf.get(uploads.LISTING), spark.sparkContext.statusTracker()
    query = uploads.ingest(spark, str(at), f"{tmp_path}/tables", f"{tmp_path}/stream")
    query.awaitTermination()
    jobs = tracker.getJobIdsForGroup(str(query.runId))
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism * 2 and spark.conf.get(uploads.LISTING) == before
    held = uploads.objects(spark, f"{tmp_path}/tables")
    assert held.where("kind = 'submodel'").count() == 35 and held.where("error is not null").count() == 1  # equal bytes are read once
