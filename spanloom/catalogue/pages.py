"""Queries on whole HTML pages. Pages with an even id get Han characters in place of vowels outside of tags."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..operators import segmenting as S
from ..operators.html_tree import Tree, compare
from ..plans import structured
from ..sources.config import Structured
from .base import HAN_FOR_VOWELS, query, spread, table

ATTRS = ("title", "alt")
#: The queries answer for every page, however long: the bound on a document's characters is the service's.
SETTINGS = Structured(translatable_attributes=ATTRS, max_characters=2**31 - 1)
#: Rows that a worker gathers before it hands them on.
HANDED = 20_000
MORE = '<p>型号 ABC-12345 支持 USB-C 接口</p><img alt="加厚防水" src="a.png"><div class="notranslate">不译 <b>这里</b></div><p translate="no">保留</p><pre>代码 x=1</pre>'
PARTS = r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[A-Za-z0-9#]+;|[^<&]+|[<&]"
#: The same pages in DuckDB, and what stands outside of their tags, scripts and styles, without blanks.
PAGES_SQL = f"""h AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN array_to_string(list_transform(regexp_extract_all(html, '{PARTS}'), lambda p: CASE WHEN starts_with(p, '<') OR starts_with(p, '&') THEN p ELSE translate(p, '{HAN_FOR_VOWELS[0]}', '{HAN_FOR_VOWELS[1]}') END), '') ELSE html END AS x FROM pages),
 g AS (SELECT page_id, CAST(page_id AS VARCHAR) AS doc_id, CASE WHEN page_id % 4 = 0 THEN x || '{MORE}' ELSE x END AS html FROM h)"""
BARE = r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>|\s+"
BARE_SQL = f"regexp_replace(html, '{BARE}', '', 'g')"


def bare(html):
    """A page's text outside of tags, scripts and styles, without blanks."""
    return F.regexp_replace(html, BARE, "")


def _pages(spark, sf_dir):
    """doc_id, html; every fourth page holds an image and a link with attributes to translate, and a part that isn't."""
    rows = spread(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), "page_id", "html"))
    more = F.lit(MORE)
    parts = F.regexp_extract_all("html", F.lit(PARTS), F.lit(0))
    han = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[<&]"), p).otherwise(F.translate(p, *HAN_FOR_VOWELS))), "")
    html = F.when(F.col("page_id") % 2 == 0, han).otherwise(F.col("html"))
    return rows.select("doc_id", F.when(F.col("page_id") % 4 == 0, F.concat(html, more)).otherwise(html).alias("html"))


def _per_page(spark, sf_dir, shape, each):
    """Rows that each(doc_id, html, tree) gives for every page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in shape.split(", ")]
        for part in parts:
            rows = []
            for doc, html in zip(part["doc_id"], part["html"], strict=True):
                rows += each(doc, html, Tree(html))
                if len(rows) > HANDED:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return _pages(spark, sf_dir).mapInPandas(run, shape)


@query()
def html_nodes(spark, sf_dir):
    """The nodes of each page in document order."""

    def each(doc, html, tree):
        depth = {id(tree.root): 0}
        for i, n in enumerate(tree.walk()):
            depth[id(n)] = depth[id(n.parent)] + 1
            yield doc, i, n.id, n.parent.id, depth[id(n)], n.kind, n.tag, "|".join(f"{k}={v}" for k, v in n.attrs), n.text, n.raw

    return _per_page(spark, sf_dir, "doc_id string, ord int, node_id string, parent_id string, depth int, kind string, tag string, attrs string, text string, raw boolean", each)


TAGS = ["title", "style", "script", "nav", "ul", "li", "a", "div", "article", "h1", "br", "footer", "img", "pre"]


@query(f"WITH {PAGES_SQL} SELECT doc_id, true AS ordered, true AS nested, " + ", ".join(f"CAST(len(regexp_extract_all(html, '<{t}[ >]')) AS BIGINT) AS n_{t}" for t in TAGS) + " FROM g")
def tree_shape(spark, sf_dir):
    """Per page: whether the walk visits parents before their children, each a level below its own, and how many elements of a name there are."""

    def each(doc, html, tree):
        depth, ordered, nested, found = {id(tree.root): 0}, True, True, dict.fromkeys(TAGS, 0)
        for n in tree.walk():
            ordered &= id(n.parent) in depth
            depth[id(n)] = depth.get(id(n.parent), 0) + 1
            nested &= n in n.parent.children
            if n.tag in found:
                found[n.tag] += 1
        return [(doc, ordered, nested, *found.values())]

    return _per_page(spark, sf_dir, "doc_id string, ordered boolean, nested boolean, " + ", ".join(f"n_{t} long" for t in TAGS), each)


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, false AS spelt, true AS spelt_after FROM pages")
def raw_pairing(spark, sf_dir):
    """Whether a page's tags all pair with nodes; bodies without head and html tags, made whole, do."""

    def each(doc, html, tree):
        return [(doc, tree.spelt, Tree(tree.serialized()).spelt)]

    return _per_page(spark, sf_dir, "doc_id string, spelt boolean, spelt_after boolean", each)


@query(f"WITH {PAGES_SQL} SELECT doc_id, true AS stable, md5({BARE_SQL}) AS text_md5 FROM g")
def html_roundtrip(spark, sf_dir):
    """Serialized pages: serializing what was serialized changes nothing more, and their text is the page's."""

    def each(doc, html, tree):
        once = tree.serialized()
        return [(doc, once, Tree(once).serialized() == once)]

    rows = _per_page(spark, sf_dir, "doc_id string, html string, stable boolean", each)
    return rows.select("doc_id", "stable", F.md5(bare("html").cast("binary")).alias("text_md5"))


def fingerprint_of(pages):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(fingerprint=[Tree(h).fingerprint(frozenset(ATTRS)) for h in part["html"]])[["doc_id", "fingerprint"]]

    return pages.mapInPandas(run, "doc_id string, fingerprint string")


@query()
def fingerprint(spark, sf_dir):
    return fingerprint_of(_pages(spark, sf_dir))


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, true AS same, false AS same_with_more FROM pages")
def structure_equal(spark, sf_dir):
    """Each page against its serialized form, and against one with a node more."""

    def each(doc, html, tree):
        out = tree.serialized()
        return [(doc, compare(tree, Tree(out)), compare(tree, Tree(out + "<p>x</p>")))]

    return _per_page(spark, sf_dir, "doc_id string, same boolean, same_with_more boolean", each)


_EXCLUDED_SQL = f"""{PAGES_SQL},
 k AS (SELECT doc_id, page_id, list_concat(list_transform(regexp_extract_all(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>'), lambda x: regexp_replace(regexp_replace(x, '^<[^>]*>', ''), '</[a-z]*>$', '')),
   CASE WHEN page_id % 4 = 0 THEN ['不译 ', '这里', '保留', '代码 x=1'] ELSE CAST([] AS VARCHAR[]) END) AS texts FROM g),
 e AS (SELECT doc_id, unnest(texts) AS text FROM k)"""


@query(f"WITH {_EXCLUDED_SQL} SELECT doc_id, text FROM e WHERE text <> ''")
def excluded_nodes(spark, sf_dir):
    """The texts that are never translated: scripts, styles, code, and what is marked so."""
    return _per_page(spark, sf_dir, "doc_id string, text string", lambda doc, html, tree: [(doc, n.text) for n in tree.walk() if n.kind == "text" and n.excluded])


@query()
def block_text(spark, sf_dir):
    """The text of each block that is sent, inline tags included."""

    def each(doc, html, tree):
        seen = {}
        for s in S.segments(tree, doc):
            seen[s.block_key] = s.block_text
        return [(doc, k, t) for k, t in seen.items()]

    return _per_page(spark, sf_dir, "doc_id string, block_key string, block_text string", each)


def _segments(spark, sf_dir, of, of_runs=()):
    return structured.segmented(_pages(spark, sf_dir), SETTINGS, of, of_runs)


@query()
def segments(spark, sf_dir):
    rows = _segments(spark, sf_dir, ("doc_id", "segment_id", "sequence_index", "block_key", "source_text", "token_count", "placeholder_order", "error"))
    return rows.select("doc_id", "segment_id", "sequence_index", "block_key", "source_text", "token_count", F.array_join("placeholder_order", ",").alias("placeholder_order"), "error")


@query()
def text_runs(spark, sf_dir):
    return _segments(spark, sf_dir, ("doc_id", "segment_id", "runs"), tuple(structured.RUN)).select("doc_id", "segment_id", F.explode("runs").alias("r")).select("doc_id", "segment_id", "r.*")


KINDS = ["chinese", "tag", "attribute", "entity_protected", "identifier_protected", "model_number_protected", "english_protected"]


@query()
def run_stats(spark, sf_dir):
    """Runs of each kind, for every page."""
    rows = _segments(spark, sf_dir, ("doc_id", "runs"), ("kind",)).filter("runs IS NOT NULL")
    of = lambda kind: F.sum(F.size(F.filter("runs.kind", lambda k: k == kind)).cast("long")).alias(kind)
    counts = rows.groupBy("doc_id").agg(*map(of, KINDS))
    return _pages(spark, sf_dir).select("doc_id").join(counts, "doc_id", "left").na.fill(0, KINDS)


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, true AS covered, true AS gapless FROM pages WHERE page_id % 2 = 0")
def coverage_check(spark, sf_dir):
    """Per page with anything to translate: whether each block's runs, in order, are its text without gap or overlap. Computed from the rows, in the JVM."""
    of = ("page_key", "doc_id", "block_key", "block_text", "sequence_index", "runs", "error")
    rows = _segments(spark, sf_dir, of, ("raw", "offset_start", "offset_end")).filter("error IS NULL")
    each = F.array_sort(F.collect_list(F.struct("sequence_index", "runs")))
    sums = rows.groupBy("page_key", "doc_id", "block_key").agg(F.first("block_text").alias("block_text"), F.flatten(F.transform(each, lambda s: s["runs"])).alias("runs"))
    joined = F.array_join(F.transform("runs", lambda r: r["raw"]), "") == F.col("block_text")
    starts, ends = F.transform("runs", lambda r: r["offset_start"]), F.transform("runs", lambda r: r["offset_end"])
    gapless = starts == F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
    return sums.groupBy("page_key", "doc_id").agg(F.bool_and(joined).alias("covered"), F.bool_and(gapless).alias("gapless")).drop("page_key")


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, 'attr:' || page_id || ':0000' AS segment_id, '加厚防水' AS block_text, '加厚防水' AS source_text, CAST(2 AS BIGINT) AS token_count FROM pages WHERE page_id % 4 = 0")
def attr_segments(spark, sf_dir):
    return _segments(spark, sf_dir, ("doc_id", "segment_id", "block_text", "source_text", "token_count")).filter("startswith(segment_id, 'attr:')").select("doc_id", "segment_id", "block_text", "source_text", "token_count")


def _translated(spark, sf_dir):
    return structured.translate_html(_pages(spark, sf_dir), settings=SETTINGS)


@query()
def html_translate(spark, sf_dir):
    """Whole pages through the test model."""
    return _translated(spark, sf_dir)


@query(f"""WITH {PAGES_SQL}, m AS (SELECT doc_id, page_id, html FROM g)
SELECT doc_id, true AS translated, md5(replace(regexp_replace({BARE_SQL}, '[A-Za-z]', '', 'g'), ':', '')) AS text_md5, CAST(CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS alt_marked FROM m""")
def html_translate_text(spark, sf_dir):
    """What the translated pages hold outside of tags, but for Latin letters and colons, which the test model adds: the
    pages' own text, all of it, in order; and how many attributes were translated."""
    done = _translated(spark, sf_dir)
    text = F.replace(F.regexp_replace(bare("html"), "[A-Za-z]", ""), F.lit(":"), F.lit(""))
    marked = F.size(F.split("html", ' alt="EN:加厚防水"')) - 1
    return done.select("doc_id", F.col("error").isNull().alias("translated"), F.md5(text.cast("binary")).alias("text_md5"), marked.cast("long").alias("alt_marked"))


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, true AS same FROM pages")
def fingerprint_kept(spark, sf_dir):
    """Whether a translated page, read again, has its source's structure."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            same = [h is not None and Tree(h).fingerprint(frozenset(ATTRS)) == mark for h, mark in zip(part["html"], part["fingerprint"], strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "same": same})

    return _translated(spark, sf_dir).select("doc_id", "html", "fingerprint").mapInPandas(run, "doc_id string, same boolean")


@query(f"WITH {_EXCLUDED_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS nodes, true AS same FROM e WHERE text <> '' GROUP BY doc_id")
def excluded_unchanged(spark, sf_dir):
    """Per page: texts that are never translated, before and after, joined by node: equal in every row."""
    done = _translated(spark, sf_dir).filter("error IS NULL").select("doc_id", F.col("html").alias("done"))
    both = _pages(spark, sf_dir).join(done, "doc_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = lambda html: {n.id: n.text for n in Tree(html).walk() if n.kind == "text" and n.excluded}
        for part in parts:
            rows = []
            for doc, a, b in zip(part["doc_id"], part["html"], part["done"], strict=True):
                left, right = texts(a), texts(b)
                rows += [(doc, k, S.MARKER.sub("&", left[k]) == S.MARKER.sub("&", right.get(k, ""))) for k in left]
            yield pd.DataFrame(rows, columns=["doc_id", "node_id", "same"])

    return both.mapInPandas(run, "doc_id string, node_id string, same boolean").groupBy("doc_id").agg(F.count("*").alias("nodes"), F.bool_and("same").alias("same"))


def _faulty():
    """A test model that spoils some first answers: it drops, doubles or swaps placeholders by a rule on the text."""
    import re
    import zlib

    def translate(texts):
        out = []
        for t in texts:
            done, tokens = re.sub("([一-鿿]+)", r"EN:\1", t), S.TOKEN.findall(t)
            way = zlib.crc32(t.encode()) % 5 if tokens else 4
            if way == 0:
                done = done.replace(tokens[0], "")
            elif way == 1:
                done += tokens[-1]
            elif way == 2:
                done = None
            out.append(done)
        return out

    return translate


@query()
def recovery(spark, sf_dir):
    """How many segments of each page needed a second prefix or the run-by-run way with a model that spoils outputs."""
    pages = _pages(spark, sf_dir)
    sent = structured.segmented(pages, SETTINGS, ("doc_id", *(c for c in structured.NEEDED if c != "runs")))
    runs_of = lambda left: structured.segmented(pages, SETTINGS, ("page_key", "sequence_index", "runs"), ("raw", "placeholder", "translate"), left)
    done = structured.translated(sent, _faulty, SETTINGS, runs_of=runs_of)
    counts = done.groupBy("doc_id").agg(F.count("*").alias("segments"), F.count("output").alias("right"), F.sum("retries").alias("retries"), F.sum("fallbacks").alias("fallbacks"))
    return pages.select("doc_id").join(counts, "doc_id", "left").na.fill(0)


@query("SELECT CAST(page_id AS VARCHAR) AS doc_id, true AS complete FROM pages")
def recovery_complete(spark, sf_dir):
    """Whether, with the model that spoils outputs, every segment of a page has a right translation in the end."""
    return recovery(spark, sf_dir).select("doc_id", (F.col("segments") == F.col("right")).alias("complete"))
