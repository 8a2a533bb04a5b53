"""Personal data whose names, wordings and formats are in none of the module's lists: recall by kind, and look-alikes."""

import random

import pytest
from pyspark.sql import functions as F

from hirelake.llm import pii

FIRST = "Kofi Ingrid Linh Aoife Bjorn Chidi Dalia Emeka Farhad Gudrun Hiba Ikaika Jomo Kalani Lubna Makoa Nkechi Oisin Parisa Quyen Rurik Saoirse Tariq Ulla Vusi Wanjiru Xiomara Yaw Zainab Tevita".split()
LAST = "Mensah Thorvald Nguyen Byrne Dahl Okafor Haddad Eze Rahimi Holm Sabbagh Kealoha Kamau Akana Qureshi Pham Vidal Khumalo Mwangi Baptiste Owusu Latu Walsh Lindgren Obi Tran Boateng Moana Zhou Kruger".split()
assert not set(FIRST) & set(pii.GIVEN_NAMES)

SAID = {
    "name": ["Patient: {}, seen on Tuesday", "interviewed {} about it", "the invoice went to {} last week", "{} lives nearby", "cc {} please"],
    "local_phone": ["ring me on {} after six", "whatsapp {} is best", "reach us: {}", "hotline {} (free)"],
    "ssn": ["my social is {} since birth", "tax id {} on file", "insured under {}"],
    "spelled_email": ["write to {} for more", "ping {} any time", "or else {}"],
    "secret": ["aws_secret = {}", "curl -H 'X-Key: {}'", "export TOKEN_VALUE={}", 'put "{}" into the vault'],
}
LOOK_ALIKE = ["release 2024-10-11 build 123-45", "isbn 978-3-16-148410-0 of 1999", "see /usr/lib/python3.13/site-packages/x", "Central Station and Green Park", "sku 000-00-0000 or 123.456", "use a [at] sign", "deadbeef and 1234567890"]


def planted(rnd):
    made = {
        "name": lambda: f"{rnd.choice(FIRST)} {rnd.choice(LAST)}",
        "local_phone": lambda: f"{rnd.choice(['415', '212', '303'])}{(s := rnd.choice('-. '))}{rnd.randint(222, 999)}{s}{rnd.randint(1000, 9999)}",
        "ssn": lambda: f"{rnd.randint(100, 599)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}",
        "spelled_email": lambda: f"{rnd.choice(['info', 'jo.x', 'team'])} [at] {rnd.choice(['acme', 'beta-co'])} [dot] {rnd.choice(['com', 'org'])}",
        "secret": lambda: "".join(rnd.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=rnd.choice([20, 32, 40, 700]))),
    }
    for kind, texts in SAID.items():
        for _ in range(80):
            value, around = made[kind](), rnd.choice(texts)
            start = around.index("{}")
            yield kind, around.replace("{}", value), start, start + len(value)


@pytest.fixture(scope="module")
def found(spark):
    rows = list(planted(random.Random(9)))
    texts = [(i, t) for i, (_, t, *_) in enumerate(rows)] + [(10_000 + i, t) for i, t in enumerate(LOOK_ALIKE * 20)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    return rows, {r["doc_id"]: r["spans"] for r in pii.find(d).select("doc_id", "spans").collect()}


def test_recall_by_kind(found):
    rows, spans = found
    hits = {k: 0 for k in SAID}
    for i, (kind, _, a, b) in enumerate(rows):
        hits[kind] += f"{kind}:{a}:{b}" in spans[i].split(",")
    recall = {k: n / 80 for k, n in hits.items()}
    print(recall)
    least = {"name": 0.0, "local_phone": 0.9, "ssn": 0.9, "spelled_email": 0.9, "secret": 0.5}
    assert all(recall[k] >= v for k, v in least.items()), recall


def test_look_alikes(found):
    wrong = [s for i, s in found[1].items() if i >= 10_000 and s]
    print(set(wrong))
    assert len(wrong) <= 0.15 * 20 * len(LOOK_ALIKE)


def test_no_greatest_length(spark):
    key = "aB3" * 400
    d = spark.createDataFrame([(1, f'api_key = "{key}"'), (2, "x" * 80 + " [at] " + "y" * 90 + " [dot] com")] + [(3 + i, f'token = "{i}kQ9z{i}XvB7w{i}Lm3"') for i in range(40)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(d).collect()}
    assert spans[1] == f"secret:11:{11 + len(key)}"
    seen = pii.candidates(d).filter("doc_id = 2").select(F.explode("_candidates").alias("c")).select("c.*").filter(F.col("kind") == pii.KINDS.index("spelled_email")).first()
    assert (seen["start"], seen["end"], seen["valid"]) == (0, 186, True)


def test_a_text_of_very_many_matches(spark):
    n = 20_000
    text = "".join(f"ü a{i}@b.co 10.0.0.{i % 250} " for i in range(n))
    r = pii.find(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").first()
    assert (r["n_email"], r["n_ip"]) == (n, n)
    at, want = 0, []
    for i in range(n):
        mail, ip = f"a{i}@b.co", f"10.0.0.{i % 250}"
        want += [f"email:{at + 2}:{at + 2 + len(mail)}", f"ip:{at + 3 + len(mail)}:{at + 3 + len(mail) + len(ip)}"]
        at += 4 + len(mail) + len(ip)
    assert r["spans"] == ",".join(want)
