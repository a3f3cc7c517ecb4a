import gzip

from mailsift.sources import files


def test_written_reports_are_compressed_and_read_back_whole(spark, tmp_path):
    rows = [(i, "high" if i % 2 else "low", f'{{"score":{i},"why":"{"the same reason again " * 50}"}}') for i in range(200)]
    made = spark.createDataFrame(rows, "msg_id long, band string, report string").coalesce(2)
    files.write_reports(made, str(tmp_path / "out"))
    stored = [p for p in (tmp_path / "out").rglob("part-*")]
    assert stored and all(gzip.open(p, "rt").readline().startswith('{"msg_id":') for p in stored)
    assert sum(p.stat().st_size for p in stored) * 10 < sum(len(r[2]) for r in rows)
    back = files.read_reports(spark, str(tmp_path / "out")).collect()
    assert sorted((r.msg_id, r.band, r.report) for r in back) == [(i, b, f'{{"msg_id":{i},{t[1:]}') for i, b, t in rows]
