"""Queries against their SQL on rows that the small test tables lack."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from spanloom.functions import budget
from spanloom.plans import structured


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query's rows on a table are those of its SQL."""

    def check(name, table, rows, shape):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        got = sorted(map(str, (tuple(r) for r in e.queries()[name](spark, str(tmp_path)).collect())))
        with duckdb.connect() as con:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
            assert got == sorted(map(str, con.execute(e.oracle_sql()[name]).fetchall()))
        return got

    return check


def test_font_size_divides_by_the_decimal(agrees):
    """81 / (9 * 0.6) is 15 with a product of doubles, 14 with the double next to 5.4."""
    rows = [(61 + 150 * k, "x" * n) for k in range(2) for n in (0, 1, 9, 11)]
    assert any(r.endswith(" 14)") for r in agrees("layout_rect", "documents", rows, "doc_id long, text string"))


def test_long_names_are_cut_as_the_sql_cuts_them(agrees):
    rows = [(0, f"<p>&amp{'x' * 40} &copy; &#1234567890 R&D</p>")]
    assert len(agrees("entity_inventory", "pages", rows, "page_id long, html string")) == 4


def test_ampersands_in_titles_come_back(agrees):
    rows = [(k, f"<title>R & D &amp{'x' * 40} &am</title><p>a & b</p>") for k in (1, 2)]
    agrees("html_roundtrip", "pages", rows, "page_id long, html string")


LONG = [(2, "<script>x()</script>" + "<p>another line of words.</p>" * 4000), (4, "<style>p{}</style><p>short one</p>"), (5, "<p>odd</p>")]


@pytest.mark.parametrize("name", ["coverage_check", "excluded_unchanged", "html_translate_text", "recovery_complete", "fingerprint_kept"])
def test_long_pages_are_done_whole(agrees, name):
    """The bound of 100,000 characters is the service's; these queries answer for every page."""
    agrees(name, "pages", LONG, "page_id long, html string")


#: The room of a segment ends inside the reference, and the white space before it is one run with what it follows only as long as the reference is cut.
GAPS = [(k, "<p>" + "a" * 15 + "art" * 40 + " " * 8 + "&amp;" + "art" * 30 + "</p>") for k in (2, 4)]


@pytest.mark.parametrize("name", ["attr_segments", "coverage_check", "fingerprint_kept", "html_translate_text", "excluded_unchanged"])
def test_room_that_ends_behind_white_space(agrees, name):
    agrees(name, "pages", GAPS, "page_id long, html string")


def test_sources_that_repeat_may_have_outputs_that_do(agrees, spark):
    rows = [(2, "<p>e e</p><p>Dr ea ea ea ea ea ea</p>"), (4, "<p>th" + " eaeoiou" * 60 + "</p><p>x i i i i i 7 mm</p>")]
    agrees("recovery_complete", "pages", rows, "page_id long, html string")
    rows = [("一 一", "EN:一 EN:一", 2, False), ("加厚防水" * 4, "thick waterproof " * 4, 8, False), ("好 好", "good " * 80, 2, True), ("中文说明书在这里", "a b a b a b a b", 4, True)]
    shape = "source string, output string, tokens long, circles boolean"
    assert not spark.createDataFrame(rows, shape).filter(budget.degenerate(F.col("output"), F.col("tokens"), source=F.col("source")) != F.col("circles")).count()


def test_a_page_without_a_translation_has_not_kept_its_structure(spark, tmp_path):
    spark.createDataFrame([(1, "<p>a</p>"), (3, "<p>__ITRANSLATE_</p>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    told = e.queries()["fingerprint_kept"](spark, str(tmp_path))
    assert sorted(map(tuple, told.collect())) == [("1", True), ("3", False)]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 6  # one translation, not two


def test_segments_are_handed_on_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(structured, "HANDED", (10**9, 50))
    page = "<p>" + "字a" * 3000 + "</p>"
    pages = pa.RecordBatch.from_pydict({"html": [page, page], "page_key": ["a", "b"], "doc_id": ["a", "b"], "source_language": pa.nulls(2, pa.string()), "target_language": pa.nulls(2, pa.string())})
    some = list(structured.handed(iter([pages]), structured.Structured(), ("page_key", "sequence_index", "runs"), ("raw",)))
    assert max(sum(len(r) for r in b.column(2).to_pylist()) for b in some) < 150
    assert "".join(r["raw"] for b in some for runs in b.column(2).to_pylist() for r in runs) == "字a" * 6000


def test_runs_travel_only_where_they_are_sent_one_by_one(spark, sf, monkeypatch):
    """A model that spoils every text with a placeholder: outputs are equal whether segments have runs or get them at the end."""

    def spoiling():
        return lambda texts: [None if "__IT" in t else t.replace("中", "EN:中") for t in texts]

    pages = spark.createDataFrame([("a", "<p>中文 AB-1234 中<b>粗 USB-C</b></p><p>中</p>"), ("b", "<p>中</p>"), ("a", "<p>文 AB-1234</p>")], "doc_id string, html string")
    of = [c for c in structured.NEEDED if c != "runs"]
    without, asked = structured.segmented(pages, None, of), []
    runs_of = lambda left: asked.append(left) or structured.segmented(pages, None, ("page_key", "sequence_index", "runs"), ("raw", "placeholder", "translate"), left)
    told = [structured.translated(structured.segmented(pages, None, structured.NEEDED, structured.NEEDED_RUN), spoiling), structured.translated(without, spoiling, runs_of=runs_of)]
    some = [sorted(map(tuple, t.select("page_key", "sequence_index", "output", "retries", "fallbacks").collect())) for t in told]
    assert some[0] == some[1] and len(some[0]) == 4 and sum(r[-1] for r in some[0]) == 2 and all(r[2] for r in some[0])
    assert asked[0].select("page_key").distinct().count() == 2
    seen, whole = [], structured.segmented
    monkeypatch.setattr(structured, "segmented", lambda *a: seen.append(a[2]) or whole(*a))
    e.queries()["recovery"](spark, sf)
    assert ["runs" in of for of in seen] == [False, True]


def test_run_stats_counts_inside_the_rows(spark, sf):
    told = e.queries()["run_stats"](spark, sf)
    assert "Generate" not in told._jdf.queryExecution().optimizedPlan().toString()
    counts = e.queries()["text_runs"](spark, sf).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in counts}.items() <= {k: sum(r[k] for r in told.collect()) for k in told.columns[1:]}.items()


def test_the_test_model_asks_again_inside_the_row(spark):
    """Texts with what looks like a placeholder fail at first; each page is still segmented in one place of the plan."""
    rows = [("a", "<p>中文 __ITAB_A0001_ 文字 AB-1234 中<b>粗 USB-C</b></p>"), ("b", "<p title='中 __ITX_S0001_ AB-123'>文</p>"), ("c", "<p>一 word</p>")]
    done = structured.translate_html(spark.createDataFrame(rows, "doc_id string, html string"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # segments, rebuilt pages
    assert {r["doc_id"]: (r["html"], r["error"]) for r in done.collect()}["c"] == ("<p>EN:一 word</p>", None)
