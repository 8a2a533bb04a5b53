import json
import os
import time

import pytest

from hirelake.operators import boards as normalizers
from hirelake.sources import board_source, boards

GREENHOUSE = {"jobs": [{"id": 7, "title": "Engineer", "location": {"name": "Remote"}, "absolute_url": "http://g/7", "content": "&lt;p&gt;Hi&lt;/p&gt;", "updated_at": "2024-01-01"}], "companyName": "G", "board": "g"}


@pytest.fixture
def folder(tmp_path):
    listed = [("greenhouse", "http://g", "g.json"), ("lever", "http://l", "l.json"), ("ashby", "http://a", "a.json"), ("ashby", "http://n", "nowhere.json")]
    (tmp_path / "boards.json").write_text("\n".join(json.dumps(dict(zip(("provider", "url", "file"), x, strict=True))) for x in listed))
    (tmp_path / "g.json").write_text(json.dumps(GREENHOUSE))
    (tmp_path / "l.json").write_text("[]")
    (tmp_path / "a.json").write_text("<html>")
    return tmp_path


def rows(df):
    return sorted((r["url"], r["payload"], r["error"]) for r in df.select("url", "payload", "error").collect())


def test_batch(spark, folder):
    board_source.register(spark)
    df = spark.read.format("boards").load(str(folder))
    assert df.rdd.getNumPartitions() == 4
    listed = spark.read.schema("provider string, url string, file string").json(str(folder / "boards.json"))
    assert rows(df) == rows(boards.fetch(spark, listed, str(folder)))  # the same as by a join with whole files
    assert [r["title"] for r in normalizers.normalize(df.filter("error IS NULL")).select("title").collect()] == ["Engineer"]


def test_boards_left_out_are_not_opened(spark, folder):
    board_source.register(spark)
    df = spark.read.format("boards").option("providers", "ashby").option("urls", "http://a,http://g,http://x").load(str(folder))
    assert df.rdd.getNumPartitions() == 1
    assert rows(df) == [("http://a", "<html>", "invalid")]
    assert rows(spark.read.format("boards").option("providers", "none").load(str(folder))) == []


def test_a_stream_goes_on_from_its_offset(spark, folder, tmp_path_factory):
    board_source.register(spark)
    out, cp = str(tmp_path_factory.mktemp("out")), str(tmp_path_factory.mktemp("cp"))

    def run():
        stream = spark.readStream.format("boards").load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(out))

    first = run()
    assert [r[0] for r in first] == ["http://a", "http://g", "http://l"]
    assert run() == first  # nothing has changed
    (folder / "l.json").write_text('[{"id": "1"}]')
    later = time.time_ns() + 5_000_000_000
    os.utime(folder / "l.json", ns=(later, later))
    assert [r for r in run() if r not in first] == [("http://l", '[{"id": "1"}]', None)]
    (folder / "nowhere.json").write_text("[]")
    os.utime(folder / "nowhere.json", ns=(later + 1, later + 1))
    assert len(run()) == 5
