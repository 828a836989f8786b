"""License search against a scan of word lists, and planted variants."""

import re

from shopspark.llm.licenses import PHRASES, Notice, license_matches, license_report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIDDLE = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, n_words int, base string"


def base_of(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(df):
    docs = {r.doc_id: r.text for r in df.collect()}
    rows = license_report(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(docs[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    return {r.doc_id: r for r in rows}


def test_the_table(spark):
    check(spark.read.parquet(f"{MIDDLE}/documents.parquet"))


def test_planted(spark):
    filler = "lorem ipsum dolor " * 200
    texts = [
        "MIT License", "mit-license, MIT\n\nLICENSE mit  license", "admit license", "the mit licence of", "Apache  License, Version 2",
        "GNU General Public License", "general publik license", "emit licenses", filler + "appache license " + filler, None, "", "licenseé mit licenseé",
        "mit license " * 3, "x" * 300_000 + " mit license", "general public general public license", "é mit\x00license é", "mitlicense", "mit license ",
    ]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA)
    rows = check(df)
    assert rows[3].labels == "mit" and rows[3].base_labels == "" and 0 < rows[3].score < 1
    assert rows[6].labels == "gpl" and rows[8].labels == "apache"
    assert rows[2].labels == "" and rows[16].score <= 1
    found = {r.id: r.matches for r in license_matches(df).collect()}
    m = found[8][0]
    assert (m.first_word, m.last_word, m.edits, m.matched) == (600, 601, 1, "appache license")
    assert license_report(df.limit(0)).collect() == []


def test_clean_texts_get_no_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("not lower(text) rlike 'licen|general|permission|copyright'")
    assert {r.labels for r in license_report(docs).collect()} == {""}


def test_places_next_to_exact_ones():
    notice = Notice("mit license", "mit", 11)

    def spans(words):
        text = f" {words} ".encode()
        return sorted((text[a:b].decode(), edits) for a, b, edits in notice.places(text))

    assert spans("mit license mt license") == [("mit license", 0), ("mt license", 1)]
    assert spans("mt license mit license") == [("mit license", 0), ("mt license", 1)]
    assert spans("mit license mitt license mit license mit licens") == [("mit licens", 1), ("mit license", 0), ("mit license", 0), ("mitt license", 1)]
    assert spans("mit license mit license") == [("mit license", 0)] * 2
    assert spans("mit licens mt license") == [("mit licens", 1), ("mt license", 1)]
