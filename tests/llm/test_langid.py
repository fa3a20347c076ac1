"""Language identification: held-out accuracy, and each kind of evidence."""

import pytest
from pyspark.sql import functions as F

from trustweave.llm import langid

SF = "/root/testdata/sf0.1"


def test_visible_text():
    assert langid.visible("a<b>c</b><script>x<y</script>d<!-- e > f -->g<style>h").split() == ["a", "c", "d", "g"]
    assert langid.visible("İ<SCRIPT>x</Script >y < z").split() == ["İ", "y", "<", "z"]
    assert langid.visible("x < y das ist <3 gut").split() == ["x", "<", "y", "das", "ist", "<3", "gut"]
    assert langid.visible("if a < b then <b>und</b> <!-- x").split() == ["if", "a", "<", "b", "then", "und"]
    assert langid.visible("a <b c d").split() == ["a", "<b", "c", "d"] and langid.visible("a<") == "a<"
    assert len(langid.visible("<a" * 200_000)) == 400_000 and len(langid.visible("< " * 200_000)) == 400_000
    assert langid.visible("") == "" and langid.trigrams("").size == 0


def test_held_out_accuracy(spark):
    """Pages were not in the training texts; their path names the language."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = langid.identify(pages, spark.read.parquet(f"{SF}/documents.parquet"))
    truth = F.regexp_extract("url", "//[^/]*/([a-z]{2})/", 1)
    n, right, by_text = found.where(truth != "").agg(
        F.count(F.lit(1)), F.sum((F.col("lang") == truth).cast("int")), F.sum((F.col("text_lang") == truth).cast("int"))).first()
    assert n > 2000 and right / n >= 0.98 and right >= by_text
    assert found.count() == pages.count() and found.where("posterior < 0.2 OR posterior > 1.000001").count() == 0


def test_evidence_is_fused(spark):
    english = "the cat and the dog with that house from there and this one which they have seen " * 3
    german = "der hund und die katze mit dem haus von dort und dieses welches sie gesehen haben nicht " * 3
    labelled = spark.createDataFrame([(english, "en"), (german, "de"), (None, "en"), (english, None)], "text string, lang string")
    page = lambda i, url, lang, text: (i, url, f"<html{lang}><body>{text}</body></html>", "clash")
    rows = [page(i, f"http://www.host.de/{i}", ' lang="de"', german) for i in range(20)]
    rows += [page(100 + i, f"https://other.com:80/{i}?q", " LANG='en-GB'", english) for i in range(20)]
    rows += [page(200, "http://host.de/short", "", "123"), page(201, "http://other.com", "", "123"), page(202, "http://new.de/", ' lang="de"', ""),
             page(203, "http://host.de/x", "", english), (204, None, None, None), (205, "", "", "x"), page(206, "http://sub.other.com/a", "", "")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lang string")
    found = {r.page_id: r for r in langid.identify(df, labelled).collect()}
    assert all(found[i].lang == "de" for i in range(20)) and all(found[100 + i].lang == "en" for i in range(20))
    assert [found[i].lang for i in (200, 201, 202, 203, 206)] == ["de", "en", "de", "en", "en"]
    assert found[200].text_lang is None and found[203].text_lang == "en" and found[203].host == "host.de" and found[101].declared == "en"
    assert found[204].lang in ("de", "en") and found[204].posterior < 0.9
    assert langid.identify(df, labelled).count() == len(rows) and langid.identify(df.limit(0), labelled).count() == 0
    assert {r.lang for r in langid.identify(df, labelled.limit(0)).collect()} == {None}


def test_too_many_languages_are_refused(spark):
    labelled = spark.createDataFrame([("some words", "a"), ("other words", "b"), ("more words", "c")], "text string, lang string")
    assert langid.train(labelled, 3)[0] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        langid.train(labelled, 2)
