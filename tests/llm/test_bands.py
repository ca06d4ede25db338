"""Fertility bands reach every document, whatever the size of its group."""

import pytest

from fidelis.llm import quality_rules as Q

DOCS = "doc_id bigint, text string, lang string"


def clean(n, lang="en"):
    return [(i, " ".join(f"word{(i * 7 + j) % 97} and something else here" for j in range(20)), lang) for i in range(n)]


def cyrillic(i):
    return " ".join("ЖЖ☃☃ŦŦ" + chr(0x4E00 + (i + j) % 2000) for j in range(90))


def verdicts(spark, rows, **parameters):
    return {r["doc_id"]: r["kept"] for r in Q.quality_rules(spark.createDataFrame(rows, DOCS), **parameters).collect()}


@pytest.mark.parametrize(("n", "lang"), [(300, "en"), (60, "en"), (60, None)])
def test_bands_do_not_depend_on_the_number_of_documents(spark, n, lang):
    odd = [(1000, cyrillic(0), lang), (1001, " ".join(f"#{chr(97 + j % 26)}%{j}$" for j in range(90)), lang)]
    got = verdicts(spark, clean(n, lang) + odd)
    assert all(got[i] for i in range(n)) and not got[1000] and not got[1001]


def test_a_script_unusual_for_its_language_has_no_band_of_its_own(spark):
    got = verdicts(spark, clean(600) + [(1000 + i, cyrillic(37 * i), "en") for i in range(8)], least_docs=5)
    assert all(got[i] for i in range(600)) and not any(got[1000 + i] for i in range(8))


def test_a_small_language_keeps_its_own_documents(spark):
    got = verdicts(spark, clean(300) + [(1000 + i, cyrillic(37 * i), "xx") for i in range(40)])
    assert all(got.values())


def test_short_documents_are_measured(spark):
    short = [(1000, "this is a short line of plain words and nothing else here", "en"), (1001, "ŦŦ ĦĦ ☃☃ ŁŁ ☃ ŦĦ ☃ Ŧ Ħ ☃", "en")]
    rows = Q.quality_rules(spark.createDataFrame(clean(60) + short, DOCS)).where("doc_id >= 1000").collect()
    assert all(r["n_tokens"] < 50 and not r["base_failed"] for r in rows)
    assert {r["doc_id"]: r["kept"] for r in rows} == {1000: True, 1001: False}
    assert not any(r["kept"] is None for r in Q.quality_rules(spark.createDataFrame(short, DOCS)).collect())
