"""Personal data, secrets and quality counts against plain Python."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trustweave.llm import pii, quality, secrets, spans

SCHEMA = "doc_id long, text string, lang string, source string, spans string, kept int, _doc string"


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(i, t, None, "s", "x", 1, "y") for i, t in enumerate(brute.ODD)]
    odd += [odd[5], (None, "a@b.co", "en", None, None, None, None)]
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id") + 1000, "text", "lang", "source", F.lit("x"), F.lit(1), F.lit("y"))
    return spark.createDataFrame(odd, SCHEMA).union(real).cache()


def test_pii_equals_plain_python(docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    found = pii.digest(pii.find_pii(docs)).collect()
    assert len(found) == len(texts)
    expected = {}
    for i, t in texts:
        s = brute.spans(t, brute.PII)
        expected[i] = (*[sum(x[0] == k for x in s) for k in brute.PII], brute.sha(s))
    for r in found:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == expected[r.doc_id], r.doc_id


def test_pii_adds_confirmed_kinds(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, not DE88370400440532013000; ssn 123-45-6789, room 223-45-6789. amex card 378282246310005"
    df = spark.createDataFrame([(1, text), (2, "x" * 60 + " 223-45-6789 " + "y" * 60)], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert [(s["kind"], s["text"]) for s in found[1].pii][:2] == [("iban", "DE89 3704 0044 0532 0130 00"), ("card_short", "378282246310005")]
    assert "123-45-6789" in [s["text"] for s in found[1].pii]
    assert found[2].pii == []
    s = found[1].pii[0]
    assert text[s["start"]:s["end"]] == s["text"]


def test_secrets_equal_plain_python(docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    found = secrets.digest(secrets.find_secrets(docs)).collect()
    assert len(found) == len(texts)
    order = list(brute.SECRETS)
    expected = {}
    for i, t in texts:
        s = sorted(brute.spans(t, brute.SECRETS), key=lambda x: (x[1], order.index(x[0])))
        expected[i] = (*[sum(x[0] == k for x in s) for k in order], brute.sha(s))
    for r in found:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == expected[r.doc_id], r.doc_id


def test_ledger_scans_only_what_it_has_not_seen(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([("a", 1, "token=abcdefg"), ("b", 1, "clean")], "path string, version int, text string")
    first, later = secrets.RULES[:2], secrets.RULES[:3]
    assert [len(r.secrets) for r in secrets.find_secrets(one, path, first).orderBy("path").collect()] == [1, 0]
    two = one.union(spark.createDataFrame([("c", 2, "token=abcdefg"), ("a", 2, "f" * 24)], one.schema))
    assert [len(r.secrets) for r in secrets.find_secrets(two, path, first).orderBy("path", "version").collect()] == [1, 0, 0, 1]
    seen = spark.read.parquet(path)
    assert seen.count() == 3  # one row for each text
    assert [len(r.secrets) for r in secrets.find_secrets(two, path, later).orderBy("path", "version").collect()] == [1, 1, 0, 1]
    again = spark.read.parquet(path)
    assert again.count() == 6 and again.where("scanned = array('hex@1')").count() == 3
    secrets.find_secrets(two, path, later).collect()
    assert spark.read.parquet(path).count() == 6


def test_redaction_replaces_whole_spans(spark):
    df = spark.createDataFrame([("x token=" + "a" * 30 + " y",), ("clean",), (None,)], "text string")
    out = [r[0] for r in secrets.find_secrets(df).select(secrets.redacted(F.col("text"), F.col("secrets"))).collect()]
    assert set(out) == {"x [assign] y", "clean", None}


def test_quality_counts_equal_plain_python(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = quality.judge(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        if len(texts[r.doc_id] or "") < 20000:
            c = brute.quality(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c, r.doc_id
            assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
            assert not (r.kept and r.base_failed)
        assert r.text == texts[r.doc_id] and r.spans == ("x" if r.doc_id is not None else None)


def test_sketch_buckets_and_fences(spark):
    values = [*range(300), 1000, 123456, 10**9]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.low_end(quality.bucket(F.col("v"))).alias("low"))
    for v, low in df.collect():
        assert low <= v and (low == v or v - low <= v / 32)
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", "a") for i in range(150)]
    junk = [(900, "### $$$ %%% " * 5 + " ".join(f"# w{j}" for j in range(60)), "en", "a"), (901, "### && ** " + " ".join(f"## v{j}" for j in range(80)), "en", "small")]
    got = quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in got.where("not kept").collect()} == {900, 901}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pii.find_pii(none).count() == quality.judge(none).count() == secrets.find_secrets(none).count() == 0


def test_running_and_between(spark):
    draw = random.Random(3)
    arrays = [[draw.randrange(50) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000, 70_000)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    found = {r.i: r for r in df.select("i", spans.running(F.col("a")).alias("s"), spans.running(F.col("a"), F.greatest).alias("m")).collect()}
    for i, a in enumerate(arrays):
        assert found[i].s == list(itertools.accumulate(a)) and found[i].m == list(itertools.accumulate(a, max))
    text = "".join(draw.choice("ab\n é\U0001f600") for _ in range(20_000))
    places = [(0, 0), (0, 1), (4095, 4097), (4096, 4096), (8192, 20_000), (0, 20_000), (19_999, 20_000), (20_000, 20_000)]
    df = spark.createDataFrame([(text, x, y) for x, y in places], "text string, x int, y int")
    got = df.select("x", "y", spans.between(spans.blocks(F.col("text")), F.col("x"), F.col("y")).alias("t")).collect()
    assert all(r.t == text[r.x:r.y] for r in got)


def test_texts_with_very_many_spans(spark):
    """Time grows with the text, not with its square."""
    def text(n):
        return "".join(f"é write a{i}@b.co token=abc{i}defgh " for i in range(n))

    seconds = []
    for n in (3_000, 30_000):
        df = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        start = time.time()
        found = pii.digest(pii.find_pii(df)).first()
        hidden = secrets.without_secrets(df).first().text
        seconds.append(time.time() - start)
        expected = brute.spans(text(n), brute.PII)
        assert found.n_email == n and found.base_sha256 == brute.sha(expected)
        assert hidden == "".join(f"é write a{i}@b.co [assign] " for i in range(n))
    assert seconds[1] < 12 * seconds[0] + 5
