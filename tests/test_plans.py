"""Plans over tables: structured and plain translation with models that fail, batches, the service, settings, sources."""

import json
import re

import pytest
from pyspark.sql import functions as F

from spanloom.operators import batching
from spanloom.plans import structured
from spanloom.plans.plain import translate
from spanloom.sources import config, images, snapshot
from spanloom.streaming import service

PAGES = [("a", "<p>前 <strong>中</strong> 后</p><p>English</p>"), ("b", "<p>型号 ABC-123 &nbsp; 好<b>中</p>"), ("c", None), ("d", "x" * 100_001), ("e", "__ITRANSLATE_S0001_"), ("f", ""), ("g", '<p translate="no">不</p><p>译 A</p>')]


def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id string, html string")


def test_structured_with_the_test_model(spark):
    rows = {r["doc_id"]: r for r in structured.translate_html(pages(spark)).collect()}
    assert rows["a"]["html"] == "<p>EN:前 <strong>EN:中</strong> EN:后</p><p>English</p>" and rows["a"]["segment_count"] == 1
    assert rows["b"]["html"] == "<p>EN:型号 ABC-123 &nbsp; EN:好<b>EN:中</b></p>"
    assert [rows[k]["error"] for k in "cdef"] == ["not_a_string", "document_too_long", "structured", None]
    assert rows["f"]["html"] == "" and rows["g"]["html"] == '<p translate="no">不</p><p>EN:译 A</p>'


def losing():
    """Loses the first placeholder of every first answer, answers right under another prefix."""
    return lambda texts: [re.sub("__ITRANSLATE_[A-Z]\\d+_", "", re.sub("([一-鿿]+)", r"EN:\1", t), count=1) for t in texts]


def never():
    return lambda texts: [None for _ in texts]


def marks_only():
    """Right only without placeholders."""
    return lambda texts: ["" if "__IT" in t else re.sub("([一-鿿]+)", r"EN:\1", t) for t in texts]


@pytest.mark.parametrize(("model", "retries", "fallbacks"), [(losing, 1, 0), (marks_only, 1, 1)])
def test_failed_segments_recover(spark, model, retries, fallbacks):
    row = structured.translate_html(pages(spark).filter("doc_id = 'a'"), model).first()
    assert row["html"] == "<p>EN:前 <strong>EN:中</strong> EN:后</p><p>English</p>"
    assert (row["retry_count"], row["fallback_count"]) == (retries, fallbacks)


def test_documents_fail_alone_and_whole(spark):
    rows = {r["doc_id"]: (r["html"], r["error"]) for r in structured.translate_html(pages(spark).filter("doc_id IN ('a', 'f')"), never).collect()}
    assert rows == {"a": (None, "structured"), "f": ("", None)}


def test_pages_that_share_an_id_or_have_none(spark):
    """Equal and different pages under one id, and pages without one, are documents of their own."""
    rows = [("a", "<p>前</p>"), ("a", "<p>前</p>"), ("a", "<p>中 x</p>"), (None, "<p>后</p>"), (None, "<p>好</p>"), (None, None)]
    done = structured.translate_html(spark.createDataFrame(rows, "doc_id string, html string")).collect()
    got = sorted((str(r["doc_id"]), str(r["html"]), str(r["error"])) for r in done)
    assert got == [("None", "<p>EN:后</p>", "None"), ("None", "<p>EN:好</p>", "None"), ("None", "None", "not_a_string"), ("a", "<p>EN:中 x</p>", "None"), ("a", "<p>EN:前</p>", "None"), ("a", "<p>EN:前</p>", "None")]


def raising():
    def translate(texts):
        raise RuntimeError("CUDA out of memory" if "好" in texts[0] else "no")

    return translate


def unloadable():
    raise OSError("no such model")


def test_what_a_model_raises_fails_its_rows_alone(spark):
    rows = [("a", "<p>前</p>"), ("b", "<p>好</p>"), ("c", "<p>English</p>")]
    table = spark.createDataFrame(rows, "doc_id string, html string")
    got = {r["doc_id"]: r["error"] for r in structured.translate_html(table, raising).collect()}
    assert got == {"a": "structured", "b": "device", "c": None}
    assert {r["doc_id"]: r["error"] for r in structured.translate_html(table, unloadable).collect()} == {"a": "model_load", "b": "model_load", "c": None}
    plain = spark.createDataFrame([(1, "前"), (2, None)], "id long, text string")
    assert {r["id"]: r["error"] for r in translate(plain, "text", raising).collect()} == {1: "model_call", 2: "null_input"}


def test_calls_are_those_of_the_plan(spark, tmp_path):
    """A recording model sees one call a batch, with its budget, languages and style, as many as the plan reports."""
    log = f"{tmp_path}/calls"

    def recording():
        def answer(texts, call):
            with open(log, "a") as f:
                f.write(json.dumps([call.budget, len(texts), call.source_language, call.target_language, call.style]) + "\n")
            return [re.sub("([一-鿿]+)", r"EN:\1", t) for t in texts]

        return answer

    letters = "".join(chr(0x4E00 + i) for i in range(600))
    html = "".join(f"<p>{letters[:n]}</p>" for n in (20, 66, 600, 20, 66, 600))
    page = spark.createDataFrame([("d", html, "zho_Hans", "fra_Latn")], "doc_id string, html string, source_language string, target_language string")
    row = structured.translate_html(page, recording).first()
    calls = [json.loads(x) for x in open(log)]
    assert sorted(c[0] for c in calls) == sorted([64, 128, 400, 128, 400]) and sum(c[1] for c in calls) == 6
    assert all(c[2:] == ["zho_Hans", "fra_Latn", "sentence"] for c in calls)
    assert (row["batch_count"], row["sum_requested_target_tokens"], row["batch_generation_budget"], row["error"]) == (5, 1092, 1184, None)


def test_outputs_in_circles_are_asked_for_once_more(spark):
    """The second time with one beam and at most 64 tokens; one that goes on fails its document."""

    def circling():
        def answer(texts, call):
            simple = call.beams == 1 and call.budget <= 64
            return [t if simple and "后" not in t else "go go go go go" for t in texts]

        return answer

    table = spark.createDataFrame([("a", "<p>前</p>"), ("b", "<p>后</p>")], "doc_id string, html string")
    got = {r["doc_id"]: (r["html"], r["error"]) for r in structured.translate_html(table, circling).collect()}
    assert got == {"a": ("<p>前</p>", None), "b": (None, "quality")}


def test_stream_goes_on_after_requests_that_share_an_id(spark, tmp_path):
    (tmp_path / "in").mkdir()
    twice = [{"request_id": "1", "text": "<p>中</p>", "format": "html"}, {"request_id": "1", "text": "<p>好</p>", "format": "html"}, {"text": "<p>前</p>", "format": "html"}]
    for n, some in enumerate((twice, [{"request_id": "2", "text": "<p>后</p>", "format": "html"}])):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in some))
        service.serve(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination(120)
    rows = sorted((str(r["request_id"]), r["translation"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows == [("1", "<p>EN:中</p>", 200), ("1", "<p>EN:好</p>", 200), ("2", "<p>EN:后</p>", 200), ("None", "<p>EN:前</p>", 200)]


def test_attributes(spark):
    page = spark.createDataFrame([("a", '<img alt="加厚 ABC-123 面料" src="s.png">')], "doc_id string, html string")
    settings = config.Structured(translatable_attributes=("alt",))
    assert structured.translate_html(page, settings=settings).first()["html"] == '<img alt="EN:加厚 ABC-123 EN:面料" src="s.png">'


def test_batches_number_calls_in_first_seen_order(spark):
    tokens = [10, 40, 300, 300, 40, 10, 10]
    rows = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(tokens)], "doc_id string, seq long, tokens long")
    plan = batching.planned(rows)
    assert [r["batch_index"] for r in plan.orderBy("seq").collect()] == [1, 2, 3, 3, 4, 5, 5]
    totals = batching.metrics(plan).agg(F.sum("items"), F.count("*")).first()
    assert tuple(totals) == (7, 5)


def test_budget_plan(spark):
    """Six segments, four a chunk: five calls, 1092 tokens asked for, 1184 generated."""
    rows = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate((10, 33, 300, 10, 33, 300))], "doc_id string, seq long, tokens long")
    calls = batching.metrics(batching.planned(rows)).orderBy("batch_index").collect()
    assert [c["max_target_budget"] for c in calls] == [64, 128, 400, 128, 400]
    assert sum(sum(c["budgets"]) for c in calls) == 1092 and sum(sum(c["buckets"]) for c in calls) == 1184


def test_plain_translation_guards_and_retries(spark):
    rows = spark.createDataFrame([(1, "中文"), (2, ""), (3, None), (4, "x" * 4001), (5, "重复")], "id long, text string")
    done = {r["id"]: (r["translation"], r["error"]) for r in translate(rows, "text").collect()}
    assert done == {1: ("EN:中文", None), 2: (None, "empty_input"), 3: (None, "null_input"), 4: (None, "input_too_long"), 5: ("EN:重复", None)}

    def stuck():
        return lambda texts: ["go go go go go" if t == "重复" else "fine" for t in texts]

    done = {r["id"]: (r["translation"], r["error"]) for r in translate(rows, "text", stuck, retry=True).collect()}
    assert done[1] == ("fine", None) and done[5] == (None, "degenerate_output")


REQUESTS = [
    {"request_id": "1", "text": "中文"}, {"request_id": "2", "text": "<p>中</p>", "format": "html"}, {"request_id": "3"}, {"request_id": "4", "text": "x", "style": "loud"}, {"request_id": "5", "text": " "},
    {"request_id": "6", "text": "x", "format": "pdf"}, {"request_id": "7", "text": "y" * 100_001, "format": "html"},
]
STATUS = {"1": 200, "2": 200, "3": 422, "4": 400, "5": 400, "6": 422, "7": 422}


def test_service_answers_each_request(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in REQUESTS))
    batch = service.answers(spark.read.schema(service.REQUEST).json(f"{tmp_path}/in"))
    rows = {r["request_id"]: r for r in batch.collect()}
    assert {k: r["status"] for k, r in rows.items()} == STATUS
    assert (rows["1"]["translation"], rows["2"]["translation"]) == ("EN:中文", "<p>EN:中</p>")
    query = service.serve(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", once=True)
    query.awaitTermination(120)
    streamed = {r["request_id"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert streamed == STATUS


def test_last_records_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("u", f"{i:03d}", i) for i in range(20)] + [("v", "001", 5)], "user string, at string, record long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user string, at string, record long").parquet(f"{tmp_path}/in")
    query = service.last_records(stream, "user", "at", "record").writeStream.outputMode("update").format("memory").queryName("last").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["user"]: r["records"] for r in spark.table("last").collect()} == {"u": list(range(12, 20)), "v": [5]}


def test_health_and_cache(spark, tmp_path):
    assert service.health(spark).first()["status"] == "ok"
    assert service.cache_status(spark, str(tmp_path)).first()["complete"] is False
    for name in ("config.json", "model.safetensors", "tokenizer.json"):
        (tmp_path / name).write_text("x")
    assert snapshot.missing(str(tmp_path)) == [] and service.cache_status(spark, str(tmp_path)).first()["complete"] is True


def test_settings(tmp_path):
    assert config.load(root=str(tmp_path)) == config.Settings()
    (tmp_path / "config.json").write_text(json.dumps({"images": {"extensions": [" JPG", ".Png"]}, "structured": {"max_segment_tokens": 30}}))
    got = config.load(root=str(tmp_path))
    assert got.images.extensions == (".jpg", ".png") and got.structured.max_segment_tokens == 30
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "bad.json"))


@pytest.mark.parametrize("make", [
    lambda: config.Images(min_confidence=2), lambda: config.Images(default_action="x"), lambda: config.Images(preserve_patterns=("(",)), lambda: config.Images(log_level="LOUD"), lambda: config.Translation(local_files_only=True, allow_model_download=True),
    lambda: config.Translation(commercial_use=True), lambda: config.Generation(min_new_tokens=600), lambda: config.Generation(phrase_scaffolding="x"), lambda: config.Structured(batch_size=0), lambda: config.built(config.Settings, {"nothing": {}}),
])
def test_bad_settings(make):
    with pytest.raises(config.ConfigError):
        make()


def test_image_scan(spark, tmp_path):
    for name in ("10.jpg", "2.JPG", "1.png", "x.txt", "sub/3.jpg", "a_processed/4.jpg"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    names = lambda rows: [r["path"].rsplit("/", 1)[1] for r in rows.select("path").collect()]
    assert names(images.scan(spark, f"{tmp_path}/in")) == ["1.png", "2.JPG", "10.jpg"]
    found = images.scan(spark, f"{tmp_path}/in", config.Images(recursive=True))
    assert names(found) == ["1.png", "2.JPG", "3.jpg", "10.jpg"]
    done = found.limit(1).select("target")
    assert images.pending(found, done).count() == 3 and images.pending(found, done, overwrite=True).count() == 4
