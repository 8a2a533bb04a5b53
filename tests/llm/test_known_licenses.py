"""Whole licence texts that the scan knows."""

from hirelake.llm import licenses

WHOLE = ["0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "MIT", "MPL-2.0", "Unlicense", "Zlib"]


def test_whole_texts(spark):
    texts = [(k, licenses.TEXTS.get(k, k).upper().replace("\n", "\n  ")) for k in WHOLE]
    got = licenses.scan(spark.createDataFrame(texts, "doc_id string, text string"), licenses.known_licenses(spark)).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {k: k for k in WHOLE}
