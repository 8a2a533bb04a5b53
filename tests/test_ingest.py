import json

from pyspark.sql import functions as F

from hirelake.operators import approval, ingest
from hirelake.operators.parse_cache import ParseCache
from hirelake.sources.versions import Versions

RESUME = b"Ada Byron\nada@example.com\n\nSKILLS\nLanguages: Go, React\n\nEXPERIENCE\nWeb Developer\nAcme Inc\nJan 2020 - Present\n- Built dashboards used by 40 clients\n"
FILE = "user_id string, file_name string, content binary"


def test_files_to_parsed_versions(spark, tmp_path):
    store, cache = Versions(spark, str(tmp_path / "v"), 4), ParseCache(spark, "parses_of_ingest", str(tmp_path / "c"), 2)
    make = lambda *rows: spark.createDataFrame([(u, n, bytearray(c)) for u, n, c in rows], FILE)
    bad = make(("u", "a.txt", b""), ("u", "b.bin", b"\x00\x01"), ("u", "c.pdf", b"%PDF-1"), ("u", "d.txt", RESUME))
    assert {r["file_name"]: r["error"] for r in ingest.checked_files(bad).collect()} == {"a.txt": "empty", "b.bin": "unsupported", "c.pdf": "layout_not_read", "d.txt": None}
    seen = lambda: sorted((r["user_id"], r["status"], r["from_cache"]) for r in store.read("parsed_versions").collect())
    assert ingest.ingest(store, cache, bad.unionByName(make(("v", "blank.txt", b" \n\n "))), "p1", "2024-01-01 00:00:00") == 1
    assert seen() == [("u", "processing", False), ("v", "processing", False)]
    assert ingest.complete(store, cache, "2024-01-01 00:01:00") == 2
    assert seen() == [("u", "pending_review", False), ("v", "failed", False)]
    parsed = json.loads(store.read("parsed_versions").filter("user_id = 'u'").first()["parsed"])
    assert parsed["contact"]["email"] == "ada@example.com" and parsed["skill_groups"][0]["skills"] == ["Go", "React"]
    # the same text again, under another name and by another user, and by another version of the parser
    ingest.ingest(store, cache, make(("u", "again.txt", RESUME.replace(b"\n", b"\r\n")), ("w", "d.txt", RESUME)), "p1", "2024-01-02 00:00:00")
    ingest.ingest(store, cache, make(("u", "later.txt", RESUME)), "p2", "2024-01-03 00:00:00")
    assert seen() == [("u", "pending_review", False), ("u", "pending_review", True), ("u", "processing", False), ("v", "failed", False), ("w", "processing", False)]
    assert store.read("documents").count() == store.read("extractions").count() == 5 and store.read("parse_runs").count() == 2
    ingest.complete(store, cache, "2024-01-03 00:01:00")
    assert [s for _, s, _ in seen()].count("pending_review") == 4 and store.read("parse_runs").count() == 4
    states = approval.checked(store.read("parsed_versions"), store.read("parsed_versions").select("version_id", "user_id"))
    assert states.filter("error IS NOT NULL").count() == 0
    spark.sql("DROP TABLE parses_of_ingest")


def test_answers(spark, tmp_path):
    store = Versions(spark, str(tmp_path), 4)
    kind = "application_id string, question string, answer string, evidence_ids array<string>, claims array<string>"
    save = lambda at, *rows: ingest.save_answers(store, spark.createDataFrame(list(rows), kind), at)
    save("t1", ("a", "Why?", "Because", ["e1"], None), ("b", "Why?", "So", None, ["c"]))
    save("t2", ("a", "Why?", "Better", None, ["x"]), ("a", "Where?", "Here", None, None))
    got = {(r["application_id"], r["question"]): (r["answer"], r["evidence_ids"], r["claims"], r["updated"]) for r in store.read("answers").collect()}
    assert got == {("a", "Why?"): ("Better", ["e1"], ["x"], "t2"), ("b", "Why?"): ("So", [], ["c"], "t1"), ("a", "Where?"): ("Here", [], [], "t2")}


def test_rows_that_are_only_added_are_no_conflict(spark, tmp_path):
    store = Versions(spark, str(tmp_path), 2)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"))
    one, two = store.add("t", rows(0, 20), F.col("k")), store.add("t", rows(20, 30), F.col("k"))
    assert store.publish(0, [one]) == 1 and store.publish(0, [two]) == 2
    assert sorted(r["k"] for r in store.read("t").collect()) == list(range(30))
