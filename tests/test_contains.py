"""The contains index against the collation itself."""

import pytest
from pyspark.sql import functions as F

from lorespark.operators import contains
from lorespark.operators.contains import ContainsIndex
from lorespark.operators.lists import contains_text

TEXTS = [
    "Rapport d'Été", "RAPPORT D'ETE", "été fini", "Straße 12", "STRASSE 12", "naïve café", "caféteria", "smørrebrød", "smorrebrod", "要約 été", "été", "ab", "", None,
    "İstanbul", "istanbul", "ſtraſse", "ﬁnance", "finance", "x\u0000yz", "100% of_it", "it's \"quoted\" \\ back", "Ελλάδα", "ελλαδα", "tab\tand\nline", "KKelvin",
]
KEYWORDS = ["été", "ETE", "strasse", "straße", "café", "smorre", "smørre", "要約", "e", "ab", "istan", "İSTAN", "finance", "xyz", "100%", "f_i", "it's", "\\ b", "\"quo", "ελλά", "b\ta", "none of these", "kkelvin", "", None]


@pytest.fixture
def names(spark, tmp_path):
    index = ContainsIndex(spark, str(tmp_path / "i"))
    index.create()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, name string").cache()
    index.add(rows.where("id % 2 = 0"), "id", "name")
    index.add(rows.where("id % 2 = 1"), "id", "name")
    index.add(rows.limit(0), "id", "name")
    return rows, index


def test_same_as_the_collation(names):
    rows, index = names
    for keyword in KEYWORDS:
        want = {r.id for r in rows.where(contains_text(F.col("name"), keyword)).collect()}
        assert {r.id for r in index.narrowed(rows, "id", "name", keyword).collect()} == want, keyword


def test_few_rows_are_looked_at(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(contains, "BLOCK", 64)
    index = ContainsIndex(spark, str(tmp_path / "i"))
    index.create()
    rows = spark.range(3000).select("id", F.concat(F.lit("Document numéro "), F.col("id") % 100, F.when(F.col("id") % 500 == 1, " spécial").otherwise("")).alias("name"))
    index.add(rows, "id", "name")
    assert sorted(r.id for r in index.candidates("SPECIAL").collect()) == [1 + 500 * i for i in range(6)]
    assert index.candidates("numero 77").count() <= 60 and index.candidates("nu") is None
    monkeypatch.setattr(contains, "LISTED", 2)
    assert index.narrowed(rows, "id", "name", "spécial").count() == 6
