"""Large pages are written apart from the others."""

from colloquy.llm import warc


def test_one_large_page_leaves_the_files_of_others(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    data = [(k, f"http://a.com/{k}", f"{k} " + "x" * 100) for k in range(200)] + [(900 + k, "http://b.com/", "y" * 150_000) for k in range(2)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"), file_records=50)
    assert len(list((tmp_path / "a").glob("part-*"))) < 12
    found = {warc_id(x.record_id): (x.record_type, x.payload_bytes, x.reason) for x in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert len(found) == 202 and found["900"] == ("revisit", 150_000, None) and found["901"] == ("response", 150_000, None)
    assert all(found[str(k)] == ("response", len(f"{k} ") + 100, None) for k in range(200))


def warc_id(name):
    return name[len("<urn:x-page:"):-1]
