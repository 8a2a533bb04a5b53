"""The stages of the pipeline one by one, each against plain Python on its own input, and whole runs."""

import random
from collections import Counter, defaultdict

import pytest
from test_operators import decontaminated, words

import corpus_pipeline
from hirelake.llm import mixing, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(21)
    vocabulary = ["".join(rnd.choices("abcdefghijkl", k=rnd.randint(2, 8))) for _ in range(600)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = [make(rnd.randint(25, 120)) for _ in range(60)]
    for base in texts[:12]:  # near copies on both sides of the threshold, chains of them, and short ones
        last = base
        for _ in range(4):
            last = list(last)
            for _ in range(rnd.randint(1, 4)):
                last[rnd.randrange(len(last))] = rnd.choice(vocabulary)
            texts.append(last)
    for n in range(5, 31):
        t = make(n)
        texts += [t, [*t, "more"], t[1:]]
    items = [make(rnd.randint(15, 40)) for _ in range(6)]
    texts += [make(40) + i + make(20) for i in items] + [make(30) + i[: len(i) * 9 // 10] + make(20) for i in items]
    texts += [["word"] * 200, []]
    rows = [(i, " ".join(t) + ("." if i % 2 else ""), "en", f"s{i % 3}", 0) for i, t in enumerate(texts)] + [(900, None, "en", None, 0), (None, " ".join(texts[3]), "en", "s1", 0)]
    rows += [rows[5]] * 3
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def first_of_groups(rows, n=5, percent=80):
    """The ids that stay when of each group of linked texts the least id does."""
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))) for w in (words((r[1] or "").lower()) for r in rows)]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i) if sets[i] else ("none", i)].append((r[0] is None, r[0]))
    return Counter(min(g)[1] for g in groups.values())


@pytest.mark.parametrize("hot", [(64, 1024), (2, 4)])
def test_prefix_join_on_all_texts(spark, tables, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert Counter(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == first_of_groups([tuple(r) for r in docs.collect()])


def test_stages_one_by_one(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    given = [tuple(r) for r in docs.collect()]
    out = stages["quality_rules"](spark, docs, tables)
    kept = [tuple(r) for r in out.collect()]
    assert out.columns == columns and not Counter(kept) - Counter(given)
    assert all(len(words(r[1])) >= 20 for r in kept) and len(kept) >= 0.9 * sum(len(words(r[1])) >= 20 for r in given) - 1
    docs = spark.createDataFrame(kept, SCHEMA)
    out = stages["ngram_jaccard"](spark, docs, tables)
    single = [tuple(r) for r in out.collect()]
    assert out.columns == columns and Counter(r[0] for r in single) == first_of_groups(kept)
    docs = spark.createDataFrame(single, SCHEMA)
    out = stages["decontamination"](spark, docs, tables)
    clean = [tuple(r) for r in out.collect()]
    hit = {d for d, _ in decontaminated([(i, r[1]) for i, r in enumerate(single)], items)}
    assert out.columns == columns and Counter(clean) == Counter(r for i, r in enumerate(single) if i not in hit) and hit
    docs = spark.createDataFrame(clean, SCHEMA)
    out = stages["mixing"](spark, docs, tables)
    mixed = [tuple(r) for r in out.collect()]
    total, largest, taken = Counter(), Counter(), Counter()
    for r in clean:
        total[r[3]] += len(words(r[1]))
        largest[r[3]] = max(largest[r[3]], len(words(r[1])))
    for r in mixed:
        taken[r[3]] += len(words(r[1]))
    target = mixing.allot(list(total.items()))
    assert out.columns == columns and set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 2 * max(Counter(clean).values())
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)
    out = stages["sharding"](spark, spark.createDataFrame(mixed, SCHEMA), tables)
    placed = out.collect()
    assert out.columns == [*columns, "size", "shard", "slot"] and Counter(tuple(r)[:5] for r in placed) == Counter(mixed)
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_runs_do_not_disturb_one_another(spark, tables):
    first, second = corpus_pipeline.run(spark, tables), corpus_pipeline.run(spark, tables)
    rows = lambda df: Counter((r["doc_id"], r["shard"]) for r in df.collect())
    assert rows(first) == rows(second) and sum(rows(first).values())


def test_stages_on_empty_tables_and_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).count() == 0, name
    more = docs.selectExpr("*", "1 as size", "2 as copies", "3 as shard", "4 as component", "5 as _row", "6 as kept", "7 as n_words", "8 as text_id")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, tables)
        assert out.columns[: len(more.columns)] == more.columns and out.filter("size = 1 and copies = 2 and shard = 3 and kept = 6").count() == out.count() > 0, name
