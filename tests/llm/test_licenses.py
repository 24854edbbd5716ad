from pyspark.sql import functions as F
from sql import same_as_sql, write

from chirpmill.llm import licenses

SCHEMA = "doc_id long, text string"
MIT = next(t for t, label in licenses.TEXTS.items() if label == "mit")
GPL = next(t for t, label in licenses.TEXTS.items() if label == "gpl")
MPL = next(t for t, label in licenses.TEXTS.items() if label == "mpl-2")


def spread(text, n):
    """Every run of the text, with other words between the runs."""
    w = text.split()
    return (" x" * n + " ").join(" ".join(w[i:i + licenses.K]) for i in range(len(w) - licenses.K + 1))


def shuffled(text):
    """Every run of the text, the last one first."""
    w = text.split()
    return " ".join(" ".join(w[i:i + licenses.K]) for i in reversed(range(len(w) - licenses.K + 1)))


def rows():
    near = GPL.replace("you can", "you surely can").replace("modify it", "change it")
    return [
        (1, "Released under the MIT License. cc-by NC; CC BY-NC"), (2, "apache license, version 2.0 " * 3), (3, None), (4, ""),
        (5, "under the mit"), (6, "x " * 30000 + MIT.upper() + " y" * 20), (7, near), (8, MIT[:60]),
        (9, "under the under the mit license license"), (10, "é under the mit license2"), (11, "no words here"),
        (12, MIT + " z " * 40 + MIT + " under the mit license"),
        (13, spread(MPL, 4)), (14, shuffled(MPL)), (15, shuffled(GPL)), (16, MPL.replace("subject", "also subject")),
        (17, "mozilla public license " * 2000 + MPL),
    ]


def test_equals_sql(spark, tmp_path):
    folder = write(spark, tmp_path, documents=(rows(), SCHEMA))
    assert same_as_sql(spark, folder, "op3_license_scan", "documents") == "ok"


def test_values(spark):
    docs = spark.createDataFrame(rows() + [(None, "under the mit license"), (1, "cc by nc")], SCHEMA)
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs.withColumn("row", F.lit("r")).withColumn("label", F.lit("l"))).collect()}
    assert len(got) == 19
    one = got[1, 11]
    assert (one["n_base"], one["first_word"], one["last_word"], one["base_labels"]) == (3, 1, 8, "cc-by-nc,mit")
    assert got[2, 15]["n_base"] == 3 and got[2, 15]["labels"] == "apache-2"
    by = {k[0]: r for k, r in got.items()}
    assert by[6]["labels"] == "mit" and by[6]["base_labels"] == "" and by[6]["n_base"] == 0 and by[6]["first_word"] is None
    assert by[7]["labels"] == "gpl" and 0.75 <= by[7]["score"] < 1
    assert by[8]["labels"] == "" and 0 < by[8]["score"] < 0.75
    assert by[5]["labels"] == "" and by[5]["score"] == 0.5
    # all words of a licence, but not as its text
    for i in (13, 14, 15):
        assert by[i]["labels"] == "" and by[i]["score"] < 0.5
    assert by[16]["labels"] == "mpl-2" and by[16]["score"] < 1 and by[17]["labels"] == "mpl-2" and by[17]["score"] == 1
    assert by[3]["score"] == 0 and by[3]["n_words"] == 0
    assert got[None, 4]["base_labels"] == "mit"


def test_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []
