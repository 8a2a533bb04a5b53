from pyspark.sql import functions as F

from hirelake.operators import incremental
from hirelake.sources import boards, text
from hirelake.streaming import polling


def test_board_files(spark, tmp_path):
    (tmp_path / "lever-a.json").write_text("[]")
    (tmp_path / "ashby-b.json").write_text("<html>")
    assert sorted(r[0] for r in boards.read_payloads(spark, str(tmp_path)).select("provider").collect()) == ["ashby", "lever"]
    listed = spark.createDataFrame([("lever", "http://x", "lever-a.json"), ("ashby", "http://y", "ashby-b.json"), ("ashby", "http://z", "nowhere.json")], "provider string, url string, file string")
    got = {r["url"]: (r["payload"], r["error"]) for r in boards.fetch(spark, listed, str(tmp_path)).collect()}
    assert got == {"http://x": ("[]", None), "http://y": ("<html>", "invalid"), "http://z": (None, "not_found")}


def test_text_sources(spark):
    d = spark.createDataFrame([(1, "a\r\n\r\n b ")], "id int, t string")
    assert [tuple(r) for r in text.text_lines(d, "id", "t").collect()] == [(1, 0, "a"), (1, 2, "b")]
    s = spark.createDataFrame([('["a","b"]',), ('{"slugs":["c"]}',), ("oops",)], "p string")
    assert [r[0] for r in s.select(text.slug_list(F.col("p"))).collect()] == [["a", "b"], ["c"], []]
    f = spark.createDataFrame([(b"%PDF-1", "a.pdf"), (b"PK\x03", "a.txt"), (b"hello\n", "a.txt"), (b"\x00\x01", "a.bin")], "c binary, n string")
    got = f.select(text.file_type(F.col("c")).alias("k"), "n", F.length("c").alias("s")).withColumn("w", text.file_warnings(F.col("n"), F.col("s"), F.col("k"))).collect()
    assert [r["k"] for r in got] == ["pdf", "docx", "text", "unknown"]
    assert [r["w"] for r in got] == [[], ["extension_mismatch"], [], ["unsupported"]]


def test_polls_keep_one_row_per_posting(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "id string, description string, seen int"
    first = [("a", "one", 1), ("b", "two", 1), ("a", "one again", 2)]
    spark.createDataFrame(first, schema).coalesce(1).write.json(str(src / "1"))
    read = lambda: spark.readStream.schema(schema).json(str(src / "*"))
    polling.poll(read(), out, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("a", "one again", 3), ("b", "changed", 3), ("c", "new", 3)], schema).coalesce(1).write.json(str(src / "2"))
    polling.poll(read(), out, str(tmp_path / "cp")).awaitTermination()
    got = {r["id"]: (r["description"], r["action"], r["batch"]) for r in polling.stored(spark, out, schema).collect()}
    assert got == {"a": ("one again", "insert", 0), "b": ("changed", "update", 1), "c": ("new", "insert", 1)}


def test_a_poll_that_runs_again_gives_the_same_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(polling, "COMPACT", 2)
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), tmp_path / "cp"
    schema = "id string, description string, seen int"
    read = lambda: spark.readStream.schema(schema).json(str(src / "*"))
    table = lambda: {tuple(r) for r in polling.stored(spark, out, schema).select("id", "description", "action", "batch").collect()}
    for n in range(5):
        rows = [(f"p{n}", "new", n), ("p0", f"text {n}", n), (f"p{n - 1}", "new", n)]
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(src / str(n)))
        polling.poll(read(), out, str(cp)).awaitTermination()
        before = table()
        (cp / "commits" / str(n)).unlink()  # as after a crash between the write and the commit of the stream
        (cp / "commits" / f".{n}.crc").unlink(missing_ok=True)
        polling.poll(read(), out, str(cp)).awaitTermination()
        assert table() == before
        # and after one before the batch was made part of the table
        commits = polling.Commits(spark, out)
        last = commits.listed()[-1][2]
        for f in (tmp_path / "out" / "_commits").glob(f"*{last.split('.')[0]}*"):
            f.unlink()
        (cp / "commits" / str(n)).unlink()
        (cp / "commits" / f".{n}.crc").unlink(missing_ok=True)
        polling.poll(read(), out, str(cp)).awaitTermination()
        assert table() == before
    assert ("p0", "text 4", "update", 4) in table() and len(table()) == 6
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("changes-000000000000")]  # replaced by the base of batch 1


def test_a_shared_budget(spark):
    d = spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "n int, new boolean").repartition(4)
    got = lambda k: sorted(r["n"] for r in incremental.capped(d, F.col("new"), k, ["n"]).collect())
    assert got(2) == [0, 1, 2, 3] and got(100) == list(range(20)) and got(0) == []
