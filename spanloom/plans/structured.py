"""HTML translation over tables: parse, segment, batch, model, check, recover, rebuild.

Documents that a guard stops never reach the parser. Segments are planned into batches and sent through the
model map; outputs are checked in the JVM; only segments that failed are sent again, first under other
placeholders, then run by run; a document is rebuilt only if all of its segments are right, and fails alone.
One call of the model for each batch of the plan, with its budget, languages and style; outputs that run in
circles, though their source doesn't, are asked for once more, with fewer beams and tokens, before they count as failed.

Rows are known by a hash of their id and html (``page_key``): rows that share an id, or have none, are documents
of their own; equal rows are segmented and translated once. Shuffles, by page_key: the pages, to find equal ones; their
segments, to plan batches; the outputs, with the pages that they go back to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import budget as B
from ..functions import patterns as P
from ..functions import text as T
from ..operators import batching
from ..operators import segmenting as S
from ..operators.html_tree import Tree
from ..operators.model import Guard, call_map, marked, model_map
from ..sources.config import Structured, Translation

RUN = dict(node_id="string", kind="string", raw="string", placeholder="string", offset_start="int", offset_end="int", sequence_index="int", slot_index="int", translate="boolean")
#: A page's own languages; null: the settings'.
PAIR = ["source_language", "target_language"]
SEGMENT = dict(page_key="string", doc_id="string", source_language="string", target_language="string", segment_id="string", sequence_index="int", block_key="string", block_text="string", source_text="string", token_count="long", placeholder_order="array<string>", contents="array<string>", runs="array", error="string")
#: What a segment keeps of its page.
KEPT = ("page_key", "doc_id", *PAIR)
#: What translating and rebuilding need of a segment, and of its runs.
NEEDED = ("page_key", *PAIR, "segment_id", "sequence_index", "source_text", "token_count", "placeholder_order", "runs", "error")
NEEDED_RUN = ("node_id", "raw", "placeholder", "slot_index", "translate")
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
#: Characters and runs that a worker gathers before it hands them on: a page may have thousands of runs.
HANDED = 2_000_000, 20_000


def guarded(pages: DataFrame, settings: Structured) -> DataFrame:
    """pages (doc_id, html; source_language, target_language if there) with page_key and error: what the native guards stop."""
    error = F.when(F.col("html").isNull(), "not_a_string").when(F.length("html") > settings.max_characters, "document_too_long").when(F.contains("html", F.lit(P.PREFIX)), "structured")
    name, none = F.col("doc_id").cast("string"), F.lit(None).cast("string")
    pair = [F.col(c) if c in pages.columns else none for c in PAIR]
    parts = [F.coalesce(F.concat(F.lit("+"), c), F.lit("-")) for c in (name, *pair, F.col("html"))]
    key = F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)
    return pages.select(key.alias("page_key"), name.alias("doc_id"), "html", *[c.alias(k) for c, k in zip(pair, PAIR, strict=True)], error.alias("error"))


def read(html: str, doc: str, settings: Structured) -> tuple[Tree, list[S.Segment], list[S.Segment]]:
    tree = Tree(html, settings.excluded_tags, settings.excluded_classes)
    text = S.segments(tree, doc, settings.max_segment_tokens, preserve=settings.preserve_patterns, translatable=settings.translatable_attributes)
    return tree, text, S.attribute_segments(tree, doc, settings.translatable_attributes, settings.max_segment_tokens)


def listed(rows: list[dict], of: tuple[str, ...], of_runs: tuple[str, ...]) -> pa.RecordBatch:
    """Rows of SEGMENT in its columns ``of``, their runs (S.Run) with the fields ``of_runs``; a row without runs has null."""
    columns = []
    for c in of:
        values = [r.get(c) for r in rows]
        if c != "runs":
            columns.append(pa.array(values, ARROW[SEGMENT[c]]))
            continue
        places, at = [], 0
        for v in values:
            places.append(None if v is None else at)
            at += len(v or ())
        flat = [r for v in values for r in v or ()]
        fields = [pa.array([getattr(r, f) for r in flat], ARROW[RUN[f]]) for f in of_runs]
        columns.append(pa.ListArray.from_arrays(pa.array([*places, at], pa.int32()), pa.StructArray.from_arrays(fields, list(of_runs))))
    return pa.RecordBatch.from_arrays(columns, list(of))


def handed(batches: Iterator[pa.RecordBatch], settings: Structured, of: tuple[str, ...], of_runs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Segments of pages (html and what KEPT names) in bounded batches, however many a batch of pages or a page has."""
    for batch in batches:
        rows, chars, count = [], 0, 0
        for i in range(batch.num_rows):
            html, *told = (c[i].as_py() for c in batch.columns)
            page = dict(zip(KEPT, told, strict=True))
            try:
                _, text, attrs = read(html, page["doc_id"] or "", settings)
            except ValueError:
                rows.append(page | {"sequence_index": 0, "error": "structured"})
                continue
            for n, s in enumerate([*text, *attrs]):
                rows.append(page | s.row() | {"sequence_index": n})
                chars += len(s.source_text) + len(s.block_text) * ("block_text" in of)
                count += len(s.runs)
                if chars > HANDED[0] or count > HANDED[1]:
                    yield listed(rows, of, of_runs)
                    rows, chars, count = [], 0, 0
        yield listed(rows, of, of_runs)


def segmented(pages: DataFrame, settings: Structured | None = None, of: tuple[str, ...] = tuple(SEGMENT), of_runs: tuple[str, ...] = tuple(RUN), only: DataFrame | None = None) -> DataFrame:
    """The segments of each document, attributes' last; a document that can't be segmented is one row with error.

    ``of`` and ``of_runs`` name the columns and the runs' fields that are wanted: a block's text stands in each of its segments.
    ``only``: a table with the page_key of the documents wanted.
    """
    settings = settings or Structured()
    good = guarded(pages, settings).filter(F.col("error").isNull())
    if only is not None:
        good = good.join(only.select("page_key").distinct(), "page_key", "left_semi")
    good = good.dropDuplicates(["page_key"])
    types = SEGMENT | {"runs": f"array<struct<{','.join(f'{f}:{RUN[f]}' for f in of_runs)}>>"}
    return good.select("html", *KEPT).mapInArrow(lambda batches: handed(batches, settings, of, of_runs), ", ".join(f"{c} {types[c]}" for c in of))


def renamed(c: Column, tokens: Column, prefix: str) -> Column:
    """Placeholders under another prefix."""
    return F.aggregate(tokens, c, lambda s, t: F.replace(s, t, F.replace(t, F.lit(P.PREFIX), F.lit(prefix))))


def run_by_run(rows: DataFrame, model: Callable | None, pair: tuple[Column, Column], guard: Guard, circles: Callable[[str, Column, Column], Column]) -> DataFrame:
    """Every translated run sent alone, its identifiers protected, and put between its segment's placeholders."""
    key = ["page_key", "sequence_index"]
    runs = rows.select(*key, *PAIR, F.posexplode("runs").alias("at", "run"))
    sent = runs.withColumn("spans", T.protected_spans(F.col("run.raw"))).withColumn("tokens", F.transform("spans", lambda s, i: T.token("span", i + 1)))
    asked = F.when(F.col("run.translate") & ~F.col("run.raw").rlike(r"(?U)^\s*\z"), T.protected(F.col("run.raw"), F.col("spans")))
    budget = B.target_budget(B.measure(F.col("run.raw")), F.lit("sentence"))
    out = model_map(sent.withColumn("asked", asked), "asked", "got", model, budget=budget, pair=pair, style=F.lit("sentence"), guard=guard)
    fine = F.col("asked").isNull() | F.coalesce(T.placeholder_check(F.col("got"), F.col("tokens"))["ok"] & ~circles("got", B.measure(F.col("run.raw")), F.col("run.raw")), F.lit(False))
    back = T.restored(F.col("got"), F.col("tokens"), F.transform("spans", lambda s: s["content"]))
    piece = F.when(~F.col("run.translate"), F.col("run.placeholder")).when(F.col("asked").isNull(), F.col("run.raw")).otherwise(back)
    pieces = F.array_sort(F.collect_list(F.struct("at", piece.alias("piece"))))
    sums = out.groupBy(*key).agg(F.bool_and(fine).alias("fine"), pieces.alias("pieces"))
    text = F.when(F.col("fine"), F.array_join(F.transform("pieces", lambda p: p["piece"]), ""))
    return rows.join(sums.select(*key, text.alias("output")), key)


def renaming(k: int) -> tuple[Column, Column]:
    """A segment's text under the k-th fresh prefix, from its text, so that a repeated task asks the same; its placeholders."""
    other = F.concat(F.lit("__IT"), F.upper(F.substring(F.md5(F.concat("source_text", F.lit(str(k))).cast("binary")), 1, 4)), F.lit("_"))
    name = lambda t: F.concat(other, F.substring(t, len(P.PREFIX) + 1, 20))
    return F.aggregate("placeholder_order", F.col("source_text"), lambda s, t: F.replace(s, t, name(t))), F.transform("placeholder_order", name)


def marked_in_row(plan: DataFrame, retries: int) -> DataFrame:
    """What translated gives with the test model, a Column expression: what fails is asked again inside its row, so that no page is segmented again."""

    def told(output: Column, k: int, fallen: int) -> Column:
        return F.struct(output.alias("output"), F.lit(k).alias("retries"), F.lit(fallen).alias("fallbacks"))

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        """use(value), whose expression stands in the plan once however often it is used."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def restored(spans: Column, tokens: Column, got: Column) -> Column:
        return F.when(T.matches(got, P.ANY_PLACEHOLDER) == tokens, T.restored(got, tokens, F.transform(spans, lambda s: s["content"])))

    def piece(r: Column) -> Column:
        with_tokens = lambda spans: F.struct(spans.alias("spans"), F.transform(spans, lambda s, i: T.token("span", i + 1)).alias("tokens"), marked(T.protected(r["raw"], spans)).alias("got"))
        back = once(once(T.protected_spans(r["raw"]), with_tokens), lambda x: restored(x["spans"], x["tokens"], x["got"]))
        return F.when(~r["translate"], r["placeholder"]).when(r["raw"].rlike(r"(?U)^\s*\z"), r["raw"]).otherwise(back)

    first = marked(F.col("source_text"))
    tries = [F.when(T.matches(first, P.ANY_PLACEHOLDER) == F.col("placeholder_order"), told(first, 0, 0))]
    for k in range(retries):
        asked, names = renaming(k)
        tries.append(F.when(T.matches(marked(asked), P.ANY_PLACEHOLDER) == names, told(T.restored(marked(asked), names, F.col("placeholder_order")), k + 1, 0)))
    whole = once(F.transform("runs", piece), lambda pieces: F.when(F.forall(pieces, lambda p: p.isNotNull()), F.array_join(pieces, "")))
    fallen = told(whole, retries, 1)
    rows = plan.withColumn("__told", F.coalesce(*tries, fallen))
    return rows.select(*plan.columns, "__told.output", F.lit(None).cast("string").alias("fault"), "__told.retries", "__told.fallbacks")


def translated(segments: DataFrame, model: Callable | None = None, settings: Structured | None = None, held: list[DataFrame] | None = None, translation: Translation | None = None, runs_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """segments with output (null if none is right), fault (the class of what the model did wrong last), retries and fallbacks.

    What the model gave is persisted, so that it is asked once; ``held`` gets the persisted tables, for a caller
    that lives on to release. The test model runs inside the rows, so that nothing need be kept. Runs take up far more room
    than texts: with a model, segments may come without, and ``runs_of`` gives those (page_key, sequence_index, runs) of the
    pages of rows that are sent run by run.
    """
    held = [] if held is None else held
    settings, translation = settings or Structured(), translation or Translation()
    generation = translation.generation
    pair = tuple(F.coalesce(F.col(c), F.lit(default)) for c, default in zip(PAIR, (translation.source_language, translation.target_language), strict=True))
    guard, style = Guard(settings.max_total_seconds, settings.segment_warning_seconds), F.lit("sentence")

    def circles(c: str, tokens: Column, source: Column) -> Column:
        return F.coalesce(B.degenerate(F.col(c), tokens, generation.max_repeated_token_run, generation.max_repeated_ngram_ratio, source), F.lit(False))

    def kept(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    plan = batching.planned(segments.filter(F.col("error").isNull()).withColumn("seq", F.col("sequence_index") + 1), doc="page_key", tokens="token_count", size=settings.batch_size)
    if model is None:
        return marked_in_row(plan, settings.max_retries)
    first = call_map(plan, ["page_key", "batch_index"], "seq", "source_text", "output", "fault", model, "bucket", pair, style, guard)
    # What runs in circles is asked for once more, alone, in a simpler way.
    stuck = circles("output", F.col("token_count"), F.col("source_text"))
    # The source's placeholders, each once, in their order, and no others: what placeholder_check calls ok, in one pass.
    fine = F.coalesce(T.matches(F.col("output"), P.ANY_PLACEHOLDER) == F.col("placeholder_order"), F.lit(False))
    first = kept(first.withColumns({"stuck": stuck, "ok": fine}))
    simpler = Guard(guard.seconds, guard.slow, generation.retry_num_beams)
    again = model_map(first.filter("stuck").drop("output", "fault", "ok"), "source_text", "output", model, 1, F.least("bucket", F.lit(generation.retry_max_new_tokens)), pair, style, simpler, "fault")
    again = again.withColumn("fault", F.when(stuck, "quality").otherwise(F.col("fault"))).withColumn("output", F.when(~stuck, F.col("output")))
    first = first.filter("NOT stuck").unionByName(kept(again.withColumn("ok", fine))).drop("stuck")
    done = first.filter("ok").withColumns({"retries": F.lit(0), "fallbacks": F.lit(0)}).drop("ok")
    left = first.filter("NOT ok").drop("ok", "output")
    for k in range(settings.max_retries):
        asked, names = renaming(k)
        rows = model_map(left.withColumn("asked", asked).withColumn("names", names), "asked", "got", model, 1, F.col("bucket"), pair, style, guard, "last")
        rows = rows.withColumn("fault", F.coalesce("last", "fault")).drop("last")
        again = F.coalesce(T.matches(F.col("got"), P.ANY_PLACEHOLDER) == F.col("names"), F.lit(False)) & ~circles("got", F.col("token_count"), F.col("source_text"))
        back = T.restored(F.col("got"), F.col("names"), F.col("placeholder_order"))
        rows = kept(rows.withColumn("output", F.when(again, back)).drop("asked", "names", "got"))
        done = done.unionByName(rows.filter(F.col("output").isNotNull()).withColumns({"retries": F.lit(k + 1), "fallbacks": F.lit(0)}))
        left = rows.filter(F.col("output").isNull()).drop("output")
    if runs_of is not None:
        left = kept(left.join(runs_of(left), ["page_key", "sequence_index"]))
    fallen = run_by_run(left, model, pair, guard, circles).withColumns({"retries": F.lit(settings.max_retries), "fallbacks": F.lit(1)})
    return done.unionByName(fallen.select(done.columns))


RESULT = "doc_id string, html string, error string, segment_count long, total_source_tokens long, sum_requested_target_tokens long, batch_generation_budget long, batch_count long, retry_count long, fallback_count long, protected_run_count long, fingerprint string"


#: Faults of the model that are a document's own error class; any other is a structured one.
SHOWN = ("quality", "device", "model_load", "deadline")


def segment_of(x: dict) -> S.Segment:
    """What rebuilding needs of a segment."""
    runs = [S.Run(r["node_id"], "", r["raw"], r["placeholder"], slot_index=None if r["slot_index"] is None else int(r["slot_index"])) for r in x["runs"]]
    return S.Segment(x["segment_id"], int(x["sequence_index"]), "", "", "", 0, runs)


def translate_html(pages: DataFrame, model: Callable | None = None, settings: Structured | None = None, held: list[DataFrame] | None = None, translation: Translation | None = None) -> DataFrame:
    """RESULT for each page (doc_id, html; source_language, target_language if there): the translated document, or the class of what stopped it."""
    settings = settings or Structured()
    told = guarded(pages, settings)
    done = translated(segmented(pages, settings, NEEDED, NEEDED_RUN), model, settings, held, translation)
    runs = F.size(F.filter("runs", lambda r: ~r["translate"]))
    less = F.transform("runs", lambda r: F.struct(r["node_id"].alias("node_id"), r["raw"].alias("raw"), r["placeholder"].alias("placeholder"), r["slot_index"].alias("slot_index")))
    fault = F.when(F.col("output").isNull(), F.when(F.col("fault").isin(*SHOWN), F.col("fault")).otherwise("structured"))
    sums = done.groupBy("page_key").agg(
        F.array_sort(F.collect_list(F.struct("sequence_index", "segment_id", "output", less.alias("runs")))).alias("sent"), F.min(fault).alias("fault"), F.count("*").alias("segment_count"), F.sum("token_count").alias("total_source_tokens"), F.sum("budget").alias("sum_requested_target_tokens"),
        F.sum("bucket").alias("batch_generation_budget"), F.max("batch_index").alias("batch_count"), F.sum("retries").alias("retry_count"), F.sum("fallbacks").alias("fallback_count"), F.sum(runs).alias("protected_run_count"),
    )
    counts = ["segment_count", "total_source_tokens", "sum_requested_target_tokens", "batch_generation_budget", "batch_count", "retry_count", "fallback_count", "protected_run_count"]
    rows = told.filter(F.col("error").isNull()).join(sums, "page_key", "left").select("doc_id", "html", "sent", "fault", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])

    names = [x.split()[0] for x in RESULT.split(", ")]

    def whole(doc: str | None, source: str, sent: list[dict] | None, fault: str | None) -> tuple[str | None, str | None, str | None]:
        """html, error, fingerprint."""
        text, mark = None, None
        try:
            if sent is None:  # nothing was sent: there is nothing to send, or the page can't be segmented
                tree, *some = read(source, doc or "", settings)
                if any(some):
                    raise S.Rejected("segments without an output")
                sent = []
            else:
                tree = Tree(source, settings.excluded_tags, settings.excluded_classes)
            mark = tree.fingerprint(frozenset(settings.translatable_attributes))
            if fault is None:
                each = [segment_of(x) for x in sent]
                attrs = [x for x in each if x.segment_id.startswith("attr:")]
                text = S.rebuilt(tree, each[: len(each) - len(attrs)], {x["segment_id"]: x["output"] for x in sent}, attrs, settings.translatable_attributes)
            return text, fault, mark
        except ValueError:
            return text, "structured", mark

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, done, chars = 0, [], 0
            for i in range(batch.num_rows):
                page = batch.slice(i, 1).select(["doc_id", "html", "sent", "fault"]).to_pylist()[0]
                done.append(whole(*page.values()))
                chars += len(done[-1][0] or "")
                if chars > HANDED[0] or i == batch.num_rows - 1:
                    html, errors, prints = (pa.array(x, pa.string()) for x in zip(*done, strict=True))
                    now = {"html": html, "error": errors, "fingerprint": prints}
                    yield pa.RecordBatch.from_arrays([now[c] if c in now else batch.column(c).slice(at, len(done)) for c in names], names)
                    at, done, chars = i + 1, [], 0

    stopped = told.filter(F.col("error").isNotNull()).select("doc_id", F.lit(None).cast("string").alias("html"), "error", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit(None).cast("string").alias("fingerprint"))
    return rows.mapInArrow(rebuild, RESULT).unionByName(stopped)
