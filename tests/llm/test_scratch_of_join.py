"""The n-gram join drops scratch tables as soon as nothing reads them."""

from hirelake.llm import ngram_join


def test_tables_that_nothing_reads_are_dropped(spark, monkeypatch):
    seen, write = {}, ngram_join.materialise

    def watched(df, tag, batch_rows=None):
        out = write(df, tag, batch_rows)
        seen[tag] = {p.rsplit("/", 1)[1][:-33] for p in ngram_join.made()}
        return out

    monkeypatch.setattr(ngram_join, "materialise", watched)
    text = [f"w{i}" for i in range(60)]
    docs = [(k, " ".join(text[:50] + [f"x{k}"] + text[50:])) for k in range(6)] + [(9, "some other words")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 9: 9}
    assert not {"join-entries", "join-again", "join-hubs", "join-near", "join-left"} & seen["join-met"]
    assert "join-rows" in seen["join-met"] and not {"join-sets", "join-centres"} & seen["join-least"]
