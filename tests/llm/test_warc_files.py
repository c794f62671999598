"""Archive files are cut by bytes as well as by records."""

from colloquy.llm import warc


def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    data = [(k, f"http://a.com/{k}", f"{k} " + "x" * 9000) for k in range(20)] + [(20, None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    assert max(x.stat().st_size for x in (tmp_path / "a").glob("part-*")) <= 40_000
    found = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert all(x.reason is None for x in found) and len(found) == 21
    monkeypatch.setattr(warc, "FILE_BYTES", 5000)
    warc.write_archives(pages, str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).where("reason is null").count() == 21
