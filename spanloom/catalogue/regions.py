"""Queries on image regions, files, jobs and the service's answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import layout as L
from .base import DOCS_SQL, LINES_SQL, docs, lines, query, table

WIDTH, HEIGHT = 300, 200
_BOX_SQL = """b AS (SELECT doc_id, text, CAST(doc_id * 13 % 320 - 10 AS INTEGER) AS x, CAST(doc_id * 7 % 210 - 5 AS INTEGER) AS y, CAST(20 + doc_id % 150 AS INTEGER) AS w, CAST(8 + doc_id % 40 AS INTEGER) AS h FROM documents)"""


def _boxes(spark, sf_dir):
    """A four-cornered region for each document; some reach over the image's edges."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (i * 13 % 320 - 10).cast("double").alias("x"), (i * 7 % 210 - 5).cast("double").alias("y"), (20 + i % 150).cast("double").alias("w"), (8 + i % 40).cast("double").alias("h"))
    corners = [("x", "y"), (F.col("x") + F.col("w"), "y"), (F.col("x") + F.col("w"), F.col("y") + F.col("h")), ("x", F.col("y") + F.col("h"))]
    return rows.withColumn("polygon", F.array(*[F.array(*c) for c in corners]))


@query(f"""WITH {_BOX_SQL}, c AS (SELECT doc_id, least(299, greatest(0, x)) AS a0, least(199, greatest(0, y)) AS b0, least(299, greatest(0, x + w)) AS a1, least(199, greatest(0, y + h)) AS b1 FROM b),
 g AS (SELECT doc_id, CAST(greatest(0, a0 - 3) AS BIGINT) AS x0, CAST(greatest(0, b0 - 3) AS BIGINT) AS y0, CAST(least(299, a1 + 3) AS BIGINT) AS x1, CAST(least(199, b1 + 3) AS BIGINT) AS y1 FROM c) SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) AS area FROM g""")
def mask_bbox(spark, sf_dir):
    return _boxes(spark, sf_dir).select("doc_id", L.mask_box(F.col("polygon"), F.lit(WIDTH), F.lit(HEIGHT)).alias("m")).select("doc_id", "m.*")


@query(f"WITH {_BOX_SQL} SELECT doc_id, CAST(x + w / 2 AS DOUBLE) AS cx, CAST(y + h / 2 AS DOUBLE) AS cy, CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height, 0.0::DOUBLE AS angle, CAST(CASE WHEN length(text) = 0 THEN 48 ELSE greatest(12, least(48, floor(w / (length(text) * 0.6)))) END AS BIGINT) AS font_size FROM b")
def layout_rect(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumn("r", L.rect(F.col("polygon")))
    return rows.select("doc_id", "r.*", L.font_size(F.col("r.width"), F.col("text"), decimal=True).alias("font_size"))


@query(f"WITH {LINES_SQL} SELECT doc_id, seq, CAST(greatest(12, least(48, floor((40 + seq % 900)::DOUBLE / (length(line) * 0.6::DOUBLE)))) AS BIGINT) AS font_size FROM l")
def font_fit(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "seq", L.font_size((40 + F.col("seq") % 900).cast("double"), F.col("line")).alias("font_size"))


@query(f"""WITH RECURSIVE {LINES_SQL}, s AS (SELECT doc_id, seq, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS ws FROM l),
 w AS (SELECT doc_id, seq, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM s),
 c AS (SELECT doc_id, seq, x, i, CAST(0 AS BIGINT) AS n, length(x) AS used FROM w WHERE i = 1
  UNION ALL SELECT w.doc_id, w.seq, w.x, w.i, CASE WHEN c.used + length(w.x) + 1 <= 32 THEN c.n ELSE c.n + 1 END, CASE WHEN c.used + length(w.x) + 1 <= 32 THEN c.used + length(w.x) + 1 ELSE length(w.x) END
   FROM c JOIN w ON w.doc_id = c.doc_id AND w.seq = c.seq AND w.i = c.i + 1)
SELECT doc_id, seq, n, string_agg(x, ' ' ORDER BY i) AS text FROM c GROUP BY doc_id, seq, n""")
def wrap_text(spark, sf_dir):
    """Each line wrapped to 32 characters."""
    rows = lines(spark, sf_dir).select("doc_id", "seq", F.posexplode(L.wrapped(F.col("line"), F.lit(32))).alias("n", "text"))
    return rows.withColumn("n", F.col("n").cast("long"))


@query(f"WITH {LINES_SQL}, c AS (SELECT doc_id, printf('text_%03d', seq - 1) AS region_id, ((doc_id * 31 + seq * 17) % 100) / 100 AS confidence FROM l) SELECT * FROM c WHERE confidence >= 0.65")
def confidence_filter(spark, sf_dir):
    """Regions keep the number that they were detected under, so ids may have gaps."""
    rows = lines(spark, sf_dir).select("doc_id", F.format_string("text_%03d", F.col("seq") - 1).alias("region_id"), ((F.col("doc_id") * 31 + F.col("seq") * 17) % 100 / 100).alias("confidence"))
    return rows.filter("confidence >= 0.65D")


def _job_sql() -> str:
    return "j AS (SELECT doc_id, source, 'in/' || source || '/' || doc_id || '.jpg' AS path, 'in/' || source || '_processed/' || doc_id || '.jpg' AS target, doc_id % 3 = 0 AS there, length(text) < 200 AS bad FROM documents)"


def _jobs(spark, sf_dir):
    path = F.concat(F.lit("in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text", path.alias("path"), L.output_path(path).alias("target"))


@query(f"WITH {_job_sql()} SELECT path, target FROM j")
def derive_path(spark, sf_dir):
    return _jobs(spark, sf_dir).select("path", "target")


@query(f"WITH {_job_sql()} SELECT path, CASE WHEN there THEN 'completed' ELSE 'pending' END AS status, there AS skipped FROM j")
def skip_existing(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    listing = jobs.filter("doc_id % 3 = 0").select("target", F.lit(True).alias("there"))
    done = jobs.join(listing, "target", "left")
    return done.select("path", F.when(F.col("there"), "completed").otherwise("pending").alias("status"), F.coalesce("there", F.lit(False)).alias("skipped"))


@query(f"""WITH {_job_sql()} SELECT source, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (there OR NOT bad) AS BIGINT) AS succeeded, CAST(count(*) FILTER (NOT there AND bad) AS BIGINT) AS failed,
 CAST(count(*) FILTER (there) AS BIGINT) AS skipped, bool_or(NOT there AND bad) AS has_failures FROM j GROUP BY source""")
def job_summary(spark, sf_dir):
    """A folder's jobs: those whose output is there are skipped and count as succeeded, those that meet an error fail."""
    there, bad = F.col("doc_id") % 3 == 0, F.length("text") < 200
    return _jobs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"), F.count_if(there | ~bad).alias("succeeded"), F.count_if(~there & bad).alias("failed"), F.count_if(there).alias("skipped"), F.bool_or(~there & bad).alias("has_failures"))


@query("""WITH f AS (SELECT doc_id, source || '-' || (doc_id % 25) || '.jpg' AS name FROM documents), k AS (SELECT *, list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END) AS key FROM f)
SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id % 50 ORDER BY array_to_string(key, ''), doc_id) AS BIGINT) AS place FROM k""")
def natural_sort(spark, sf_dir):
    """Fifty folders of files, each in the order in which numbers count as numbers."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("-"), (F.col("doc_id") % 25).cast("string"), F.lit(".jpg")).alias("name"))
    order = W.partitionBy(F.col("doc_id") % 50).orderBy(L.natural_key(F.col("name")), "doc_id")
    return rows.select("doc_id", "name", F.row_number().over(order).cast("long").alias("place"))


_EXT = [".JPG", ".png", ".txt", ".webp", ".html"]


@query(f"""WITH p AS (SELECT page_id, url || CASE WHEN page_id % 7 = 0 THEN '/a_processed/' ELSE '/a/' END || page_id || {_EXT!r}[1 + page_id % 5] AS path FROM pages)
SELECT page_id, path FROM p WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp|bmp|tif|tiff)$') AND NOT regexp_matches(path, '_processed/')""")
def scan_filter(spark, sf_dir):
    from ..sources.images import is_image

    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat("url", F.when(F.col("page_id") % 7 == 0, "/a_processed/").otherwise("/a/"), F.col("page_id").cast("string"), ext)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).filter(is_image(F.col("path")))


@query("SELECT doc_id, doc_id % 11 <> 0 AND n_chars > 0 AS readable, doc_id % 11 <> 0 AND n_chars > 0 AND doc_id % 4 <> 0 AS preserved FROM documents")
def dims_preserved(spark, sf_dir):
    """Readable images whose size is the same after processing."""
    readable = (F.col("doc_id") % 11 != 0) & (F.col("n_chars") > 0)
    before = F.when(readable, F.struct((F.col("n_chars") % 640).alias("w"), (F.col("n_chars") % 480).alias("h")))
    after = F.when(readable, F.struct((F.col("n_chars") % 640 + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("w"), (F.col("n_chars") % 480).alias("h")))
    return table(spark, sf_dir, "documents").select("doc_id", before.isNotNull().alias("readable"), F.coalesce((before["w"] == after["w"]) & (before["h"] == after["h"]), F.lit(False)).alias("preserved"))


@query(f"WITH {DOCS_SQL}, c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE t || '!' END AS compact, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE t END AS translated, 'lit' AS literal FROM d) SELECT doc_id, coalesce(nullif(CASE WHEN trim(compact) = '' THEN NULL ELSE compact END, ''), translated, literal) AS text FROM c")
def pick_text(spark, sf_dir):
    """The first of the compact, the translated and the literal text that isn't blank."""
    options = [F.when(F.col("doc_id") % 2 == 0, "  ").otherwise(F.concat("t", F.lit("!"))), F.when(F.col("doc_id") % 3 != 0, F.col("t")), F.lit("lit")]
    return docs(spark, sf_dir).select("doc_id", F.coalesce(*[F.when(~o.rlike(r"^\s*\z"), o) for o in options]).alias("text"))


@query("WITH s AS (SELECT doc_id, [NULL, 'phrase', 'sentence', 'loud', ''][1 + doc_id % 5] AS asked FROM documents) SELECT doc_id, CASE WHEN asked IS NULL THEN 'sentence' WHEN asked IN ('phrase', 'sentence') THEN asked END AS style, CASE WHEN asked NOT IN ('phrase', 'sentence') THEN 'invalid_style' END AS error FROM s")
def resolve_style(spark, sf_dir):
    from ..sources.config import style

    asked = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("phrase", "sentence", "loud", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", style(asked).alias("s")).select("doc_id", "s.style", "s.error")


@query("SELECT doc_id, a AS asked, CASE lower(a) WHEN 'zh' THEN 'zho_Hans' WHEN 'zh-cn' THEN 'zho_Hans' WHEN 'zh_cn' THEN 'zho_Hans' WHEN 'en' THEN 'eng_Latn' WHEN 'en-us' THEN 'eng_Latn' WHEN 'en_us' THEN 'eng_Latn' ELSE a END AS code FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN 'zh-CN' WHEN 2 THEN 'en-US' ELSE 'zho_Hans' END AS a FROM documents)")
def lang_alias(spark, sf_dir):
    from ..sources.config import language

    asked = F.when(F.col("doc_id") % 4 == 0, F.col("lang")).when(F.col("doc_id") % 4 == 1, "zh-CN").when(F.col("doc_id") % 4 == 2, "en-US").otherwise("zho_Hans")
    return table(spark, sf_dir, "documents").select("doc_id", asked.alias("asked"), language(asked).alias("code"))


@query("""SELECT doc_id, d AS device, CASE WHEN d = 'cpu' THEN 'cpu' WHEN n > i THEN d WHEN fall THEN 'cpu' END AS resolved, CASE WHEN d <> 'cpu' AND n <= i AND NOT fall THEN 'device_unavailable' END AS error,
 CASE WHEN p = 'float16' AND d <> 'cpu' AND n > i THEN 'float16' ELSE 'float32' END AS precision
FROM (SELECT doc_id, ['cpu', 'cuda:0', 'cuda:1'][1 + doc_id % 3] AS d, doc_id % 3 - 1 AS i, doc_id % 2 AS n, doc_id % 5 = 0 AS fall, CASE WHEN doc_id % 4 = 0 THEN 'float16' ELSE 'auto' END AS p FROM documents)""")
def device_resolve(spark, sf_dir):
    from ..sources.config import device

    i = F.col("doc_id")
    asked = F.element_at(F.array(*map(F.lit, ("cpu", "cuda:0", "cuda:1"))), (i % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", asked.alias("device"), device(asked, i % 2, i % 5 == 0, F.when(i % 4 == 0, "float16").otherwise("auto")).alias("r"))
    return rows.select("doc_id", "device", "r.resolved", "r.error", "r.precision")


_ERRORS = ["input", "quality", "device", "model_load", "document_too_long", "not_a_string", "structured", "request_invalid", "other"]


@query(f"SELECT doc_id, e AS error_class, CAST(CASE e WHEN 'input' THEN 400 WHEN 'quality' THEN 422 WHEN 'device' THEN 503 WHEN 'model_load' THEN 503 WHEN 'document_too_long' THEN 422 WHEN 'not_a_string' THEN 422 WHEN 'request_invalid' THEN 422 ELSE 500 END AS BIGINT) AS status FROM (SELECT doc_id, {_ERRORS!r}[1 + doc_id % 9] AS e FROM documents)")
def error_status(spark, sf_dir):
    from ..streaming.service import status_of

    e = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("doc_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", e.alias("error_class"), status_of(e).alias("status"))


@query("SELECT doc_id, '{\"id\":\"text_' || printf('%03d', doc_id % 1000) || '\",\"action\":\"' || CASE WHEN doc_id % 2 = 0 THEN 'translate' ELSE 'review' END || '\",\"action_reason\":\"\"}' AS region, CASE WHEN doc_id % 2 = 0 THEN 'translate' ELSE 'review' END AS action FROM documents")
def region_json(spark, sf_dir):
    """Regions parsed, with defaults for what is missing, and written again."""
    name = F.format_string("text_%03d", F.col("doc_id") % 1000)
    source = F.concat(F.lit('{"id":"'), name, F.lit('"'), F.when(F.col("doc_id") % 2 == 0, ',"action":"translate"').otherwise(""), F.lit("}"))
    parsed = F.from_json(source, "id string, action string, action_reason string")
    whole = F.struct(parsed["id"].alias("id"), F.coalesce(parsed["action"], F.lit("review")).alias("action"), F.coalesce(parsed["action_reason"], F.lit("")).alias("action_reason"))
    return table(spark, sf_dir, "documents").withColumn("r", whole).select("doc_id", F.to_json("r").alias("region"), "r.action")


@query(f"WITH {LINES_SQL} SELECT doc_id, seq, 'zh' AS source_language, 'en' AS target_language, regexp_replace(line, '([\\x{{4e00}}-\\x{{9fff}}]+)', 'EN:\\1', 'g') AS translated FROM l WHERE regexp_matches(line, '[\\x{{4e00}}-\\x{{9fff}}]')")
def region_translate(spark, sf_dir):
    """Regions to be translated, with the language tags cut to their base."""
    from ..functions.text import lang_kind
    from ..operators.model import marked

    base = lambda tag: F.substring_index(F.lit(tag), "-", 1)
    rows = lines(spark, sf_dir).filter(lang_kind(F.col("line")) != "english")
    return rows.select("doc_id", "seq", base("zh-CN").alias("source_language"), base("en-US").alias("target_language"), marked(F.col("line")).alias("translated"))


@query(f"""WITH {LINES_SQL}, s AS (SELECT doc_id, seq, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS x FROM l),
 k AS (SELECT *, length(regexp_replace(x, '[^A-Za-z0-9\\s]', '', 'g')) / length(x) > 0.8 AS english FROM s),
 j AS (SELECT doc_id, list({{'id': printf('text_%03d', seq - 1), 'source_text': line, 'action': CASE WHEN english THEN 'preserve' ELSE 'translate' END, 'action_reason': CASE WHEN english THEN 'already_target_language' ELSE 'default_action' END}} ORDER BY seq) AS regions FROM k GROUP BY doc_id)
SELECT doc_id, CAST(to_json({{'source_path': 'in/' || doc_id || '.jpg', 'status': 'completed', 'regions': regions}}) AS VARCHAR) AS record FROM j""")
def job_metadata_json(spark, sf_dir):
    """A job's record as JSON, its regions in order."""
    from ..functions.text import region_action

    rows = lines(spark, sf_dir).withColumn("rule", region_action(F.col("line"), [], [])).withColumn("id", F.format_string("text_%03d", F.col("seq") - 1))
    regions = F.array_sort(F.collect_list(F.struct("seq", "id", F.col("line").alias("source_text"), "rule.action", F.col("rule.reason").alias("action_reason"))))
    jobs = rows.groupBy("doc_id").agg(regions.alias("regions"))
    record = F.struct(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("source_path"), F.lit("completed").alias("status"), F.transform("regions", lambda r: r.dropFields("seq")).alias("regions"))
    return jobs.select("doc_id", F.to_json(record).alias("record"))


@query(f"""WITH {_BOX_SQL}, c AS (SELECT doc_id, least(299, greatest(0, x)) AS a0, least(199, greatest(0, y)) AS b0, least(299, greatest(0, x + w)) AS a1, least(199, greatest(0, y + h)) AS b1 FROM b)
SELECT doc_id, CAST((least(299, a1 + 3) - greatest(0, a0 - 3) + 1) * (least(199, b1 + 3) - greatest(0, b0 - 3) + 1) AS BIGINT) AS pixels FROM c""")
def mask_pixels(spark, sf_dir):
    """The masked pixels of each region, counted in the mask itself."""
    from ..operators.imaging import text_mask

    @F.pandas_udf("long")
    def count(polygons: pd.Series) -> pd.Series:
        return polygons.map(lambda p: int((text_mask((HEIGHT, WIDTH), [{"action": "remove", "polygon": [list(x) for x in p]}]) > 0).sum()))

    return _boxes(spark, sf_dir).select("doc_id", count("polygon").alias("pixels"))


@query()
def diagnostics(spark, sf_dir):
    """A record of each document's segments, bounded and fitted."""
    from ..streaming.diagnostics import record

    rows = lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("line").alias("source_text")))).alias("segments"), F.count("*").alias("segment_count"))
    return rows.select("doc_id", record(F.to_json(F.struct("segment_count", "segments"))).alias("record"))
