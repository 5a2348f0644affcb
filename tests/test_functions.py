import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from larkstead.functions import scalars as fn
from larkstead.functions import text as tx
from larkstead.sources import content as files


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or ["id"]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("n,delay", [(-5, 5000), (0, 5000), (1, 5000), (2, 10000), (6, 160000), (7, 320000), (8, 600000), (100, 600000), (2**20, 600000)])
def test_backoff(spark, n, delay):
    assert value(spark, fn.backoff_ms("n"), n=n) == delay


def test_hmac_matches_the_standard_library(spark):
    for key in (b"k", b"x" * 64, b"y" * 100):
        assert value(spark, fn.hmac_index("s", key), s="SN-4815162342") == hmac.new(key, b"SN-4815162342", hashlib.sha256).hexdigest()


def test_subkeys_differ_by_purpose():
    assert fn.subkey(b"m" * 32, "index") != fn.subkey(b"m" * 32, "data") and len(fn.subkey(b"m" * 32, "a", 80)) == 80


def test_tampered_ciphertext_is_null(spark):
    key = b"0" * 32
    sealed = spark.range(1).select(fn.encrypt(F.lit("serial"), key).alias("x")).first()[0]
    assert value(spark, fn.decrypt("x", key), x=bytes(sealed)) == "serial"
    for bad in (bytes([sealed[0] ^ 1]) + sealed[1:], sealed[:-1] + bytes([sealed[-1] ^ 1]), sealed[:10]):
        assert value(spark, fn.decrypt("x", key), x=bytes(bad)) is None


def test_ids(spark):
    for ms in (0, 1, 1_700_000_000_123, 2**48 - 1):
        made = value(spark, F.concat(F.lit("job_"), fn.encode_time("m"), F.lit("0" * 16)), m=ms)
        assert value(spark, fn.id_time("i"), i=made) == ms and value(spark, fn.valid_id("i", "job"), i=made) and not value(spark, fn.valid_id("i", "doc"), i=made)
    ulid = "01HZZZZZZZ" + "0" * 16
    assert value(spark, fn.valid_id("i", "doc"), i="doc_" + ulid.lower()) and not value(spark, fn.valid_id("i", "doc"), i="DOC_" + ulid)
    for bad in ("job", "job_1", "job_" + "U" * 26, "job_8" + "0" * 25):
        assert not value(spark, fn.valid_id("i"), i=bad) and value(spark, fn.id_time("i"), i=bad) is None


def test_text_scalars(spark):
    assert value(spark, fn.fold_email("e"), e=" Owner@Example.COM ") == "owner@example.com"
    assert value(spark, fn.valid_email("e"), e="a@b") and not value(spark, fn.valid_email("e"), e="a b@c")
    assert bytes(value(spark, fn.truncate_bytes("s", 3), s="aéé")) == "aéé".encode()[:3]
    assert value(spark, fn.long_enough("s"), s="é" * 10) and not value(spark, fn.long_enough("s"), s="é" * 9)
    assert value(spark, fn.blob_path("d"), d="ab" * 32).startswith("ab/ab/") and value(spark, fn.blob_path("d"), d="AB" * 32) is None
    assert value(spark, fn.cost_string("c"), c=5000) == "0.005000"
    assert value(spark, fn.first_version("s"), s="tool v24.02.0 (x)") == "24.02.0"
    assert value(spark, fn.page_count("s"), s="Title: x\nPages:          560\n") == 560 and value(spark, fn.page_count("s"), s="x") is None
    assert value(spark, fn.client_ip("f", "r"), f="1.1.1.1, 2.2.2.2", r="3") == "2.2.2.2" and value(spark, fn.client_ip("f", "r"), f="", r="3") == "3"
    assert value(spark, fn.redact_home("p", "/home/a.b"), p="/home/a.b/x") == "~/x" and value(spark, fn.redact_home("p", "/home/a.b"), p="/home/aXb/x") == "/home/aXb/x"
    assert value(spark, fn.redact("s"), s="") == "" and value(spark, fn.redact("s"), s="x") == "********"
    assert value(spark, fn.same_origin("o", "h"), o="http://H.example:7745", h="h.example:7745") and not value(spark, fn.same_origin("o", "h"), o="http://h.example", h="h.example:1")
    assert value(spark, fn.ordered_set(F.split("s", ",")), s="de,de,en, uk ,") == ["de", "en", "uk"]
    assert value(spark, fn.ocr_codes(F.split("s", ",")), s="de-AT,zh-Hant,xx-nonsense,hu,ro,en,bogus-tag,de-,gsw-CH,deu") == ["deu", "chi_sim", "hun", "ron", "eng"]
    assert value(spark, fn.data_route("k", "w"), k="receipt", w="cloud") == "local" and value(spark, fn.data_route("k", "w"), k="manual", w="cloud") == "cloud"
    assert value(spark, fn.problems(a=(F.lit(False), "bad"), b=(F.lit(True), "x"), c=(F.lit(None).cast("boolean"), "odd"))) == ["a: bad", "c: odd"]
    assert value(spark, fn.payload(None)) == "{}"
    assert 0 <= value(spark, fn.jitter_ms("d", "s"), d=5000, s=3) < 1250
    delays = {value(spark, fn.retry_delay_ms("n", "s"), n=2, s=i) for i in range(8)}
    assert all(7500 < d <= 10000 for d in delays) and len(delays) > 4


def test_search(spark):
    docs = spark.createDataFrame([(1, "Das Gerät monatlich entkalken."), (2, None), (3, "")], "id int, t string")
    for term, prefix in (("entkalken", "monat"), ("Gerät", "ger")):
        assert [r[0] for r in tx.search_term(docs, "id", "t", term).collect()] == [1]
        assert [r[0] for r in tx.search_prefix(docs, "id", "t", prefix).collect()] == [1]
    assert tx.document_frequency(docs, "t").count() == 4


def test_scripts_and_index(spark):
    for s, name in (("Привет", "Cyrillic"), ("γειά", "Greek"), ("שלום", "Hebrew"), ("مرحبا", "Arabic"), ("สวัสดี", "Thai"), ("ひらがな", "Hiragana"), ("漢字", "Han"), ("123", None)):
        assert value(spark, tx.main_script("s"), s=s) == name
    assert value(spark, tx.index_codes("s"), s="EN \nDE\nDe\nPT-BR\nEN\nxEN") == ["EN", "DE", "PT-BR"]
    assert [tuple(r) for r in value(spark, tx.index_entries("s"), s="DE  Deutsch .... 17\nno\nEN English 2")] == [("DE", "Deutsch", 17), ("EN", "English", 2)]


def test_blob_files_and_manifests(spark, tmp_path):
    data = b"%PDF-like" * 10
    name = hashlib.sha256(data).hexdigest()
    for place, content in ((name, data), ("f" * 64, b"other"), ("upload-1", b"")):
        (tmp_path / place[:2]).mkdir(exist_ok=True)
        (tmp_path / place[:2] / place).write_bytes(content)
    found = files.blob_files(spark, str(tmp_path))
    assert found.count() == 2 and [r["digest"] for r in files.corrupt(found).collect()] == ["f" * 64]
    assert bytes(files.read_range(found.where(F.col("digest") == name), 1, 3).first()["part"]) == data[1:4]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"name": "x", "pages": 9, "extra": 1,\n "sections": [{"code": "EN", "pdf_start": 1, "pdf_end": 4, "pages": 4, "odd": 2}]}')
    assert files.manifest_sections(files.manifests(spark, str(tmp_path / "m"))).first()["code"] == "EN"
