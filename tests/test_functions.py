"""Column expressions against the fixtures of the survey, in plain values."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanloom.functions import budget as B
from spanloom.functions import layout as L
from spanloom.functions import patterns as P
from spanloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "kind"), [("加厚防水面料", "chinese"), ("Premium Quality", "english"), ("适合 daily use", "mixed"), ("", "english"), ("12345", "english")])
def test_lang_kind(spark, text, kind):
    assert one(spark, T.lang_kind(F.lit(text))) == kind


@pytest.mark.parametrize(("text", "kinds"), [
    ("看 https://example.com/x?q=1 这里", ["url"]), ("联系 abc.def@mail.com 我们", ["email"]), ("型号 ABC-12345 可用", ["product_code"]), ("支持 USB-C 接口", ["interface"]),
    ("兼容 Windows 11 系统", ["version"]), ("重量 1.5kg 功率 100W", ["measurement", "measurement"]), ("v 10.2.3", ["version_num"]), ("www.a.org/b", ["www"]), ("AB 1234", ["model_no"]), ("50% ok", []), ("", []),
])
def test_identifiers(spark, text, kinds):
    found = one(spark, T.protected_spans(F.lit(text)))
    assert [s["kind"] for s in found] == kinds
    assert all(text[s["start"] : s["stop"]] == s["content"] for s in found)


@pytest.mark.parametrize("text", ["mail a.b@c.org or www.x.org ABC-123 then 15 mm", "no identifier", "", "10.2.3"])
def test_protect_then_restore(spark, text):
    spans = T.protected_spans(F.lit(text))
    tokens = F.transform(spans, lambda s, i: T.token("span", i + 1))
    back = T.restored(T.protected(F.lit(text), spans), tokens, F.transform(spans, lambda s: s["content"]))
    assert one(spark, back) == text


@pytest.mark.parametrize(("output", "ok"), [("a {0} b {1}", True), ("{1} {0}", False), ("{0}", False), ("{0} {1} {1}", False), ("{0} {1} __ITQ_S0001_", False), ("{0} {1} __ITRANSLATE_S0009_", False)])
def test_placeholder_check(spark, output, ok):
    tokens = ["__ITRANSLATE_S0001_", "__ITRANSLATE_T0002_"]
    check = one(spark, T.placeholder_check(F.lit(output.format(*tokens)), F.array(*map(F.lit, tokens))))
    assert check["ok"] is ok


@pytest.mark.parametrize(("text", "action", "reason"), [
    ("加厚升级", "translate", "default_action"), ("UL Certified Premium Quality", "preserve", "already_target_language"), ("华为 HUAWEI 手机手机手机手机手机", "preserve", "preserve_term_match"),
    ("型号甲", "preserve", "preserve_pattern_match"), ("   ", "remove", "empty_text"), (None, "remove", "empty_text"),
])
def test_region_action(spark, text, action, reason):
    got = one(spark, T.region_action(F.lit(text).cast("string"), ["Huawei"], ["型号."]))
    assert (got["action"], got["reason"]) == (action, reason)


@pytest.mark.parametrize(("text", "clean", "error"), [("a\r\nb\rc", "a\nb\nc", None), ("a\n\n\n\n\nb", "a\n\nb", None), (" 　x ", "x", None), ("", None, "empty_input"), (None, None, "null_input"), ("x" * 4001, None, "input_too_long"), ("x" * 4000, "x" * 4000, None)])
def test_preprocess(spark, text, clean, error):
    got = one(spark, T.preprocessed(F.lit(text).cast("string")))
    assert (got["text"], got["error"]) == (clean, error)


@pytest.mark.parametrize(("text", "answer"), [("Bright Bright Bright Bright", True), ("alpha beta alpha beta alpha beta", True), ("A compact translation with useful meaning", False), ("", True), ("   ", True), ("...", False)])
def test_degenerate(spark, text, answer):
    assert one(spark, B.degenerate(F.lit(text), F.lit(4))) is answer


def test_budgets_and_classes(spark):
    budgets = [one(spark, B.target_budget(F.lit(t), F.lit("sentence"))) for t in (10, 33, 300)]
    assert budgets == [64, 82, 400]
    assert [one(spark, B.bucket(F.lit(b))) for b in (1, 64, 65, 82, 321, 400, 401)] == [64, 64, 128, 128, 400, 400, 401]


def test_phrase_check(spark):
    long = one(spark, B.phrase_check(F.lit("防水"), F.lit("a b c d e f g")))
    assert (long["reasons"], long["accepted"]) == (["output_expansion_exceeded"], False)
    told = one(spark, B.phrase_check(F.lit("加厚防水面料"), F.lit("This is waterproof")))
    assert told["reasons"] == ["sentence_scaffolding_detected"]


@pytest.mark.parametrize(("source", "piece", "out"), [("  a\n", " x ", "  x\n"), ("a", "x", "x"), ("   ", "y", "   y"), ("　a", "x", "　x")])
def test_edges(spark, source, piece, out):
    assert one(spark, T.edges_kept(F.lit(source), F.lit(piece))) == out


def test_layout(spark):
    got = one(spark, L.rect(F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (100, 0), (100, 40), (0, 40))])))
    assert (got["cx"], got["cy"], got["width"], got["height"]) == (50, 20, 100, 40)
    assert one(spark, L.font_size(F.lit(100.0), F.lit("abcd"))) == 41
    assert one(spark, L.font_size(F.lit(0.0), F.lit("abcd"))) == 48
    assert one(spark, L.wrapped(F.lit("the quick brown fox"), F.lit(10))) == ["the quick", "brown fox"]
    assert one(spark, L.wrapped(F.lit(""), F.lit(10))) == [""]


def test_natural_order(spark):
    names = ["10.jpg", "2.jpg", "1.jpg", "20.jpg", "a2.jpg", "A10.jpg"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").orderBy(L.natural_key(F.col("name"))).collect()
    assert [r["name"] for r in rows] == ["1.jpg", "2.jpg", "10.jpg", "20.jpg", "a2.jpg", "A10.jpg"]


def test_ranges_hold_the_compatibility_ideographs():
    assert "豈" in P.CJK_PY and unicodedata.normalize("NFC", "豈") not in P.CJK_PY
    assert re.match(f"[{P.CJK_PY}]", "﫿") and not re.match(f"[{P.CJK_PY}]", "퟿")
