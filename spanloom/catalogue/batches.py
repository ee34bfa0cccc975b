"""Queries on segments and batches: measures, budgets, windows, plans, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import budget as B
from ..functions import text as T
from ..operators import batching
from .base import DOCS_SQL, LINES_SQL, by_doc, docs, lines, query, table

_STYLE_SQL = "CASE WHEN seq % 3 = 0 THEN 'phrase' ELSE 'sentence' END"
_BUDGET_SQL = f"CAST(least(400, CASE WHEN {_STYLE_SQL} = 'phrase' THEN greatest(1, floor(tokens * 1.5)) ELSE greatest(64, floor(tokens * 2.5)) END) AS BIGINT)"


def _bucket_sql(b: str) -> str:
    return f"CASE WHEN {b} <= 64 THEN 64 WHEN {b} <= 128 THEN 128 WHEN {b} <= 192 THEN 192 WHEN {b} <= 256 THEN 256 WHEN {b} <= 320 THEN 320 WHEN {b} <= 400 THEN 400 ELSE {b} END"


_PLAN_SQL = LINES_SQL + f""",
 b AS (SELECT *, CAST(least(400, greatest(64, floor(tokens * 2.5))) AS BIGINT) AS budget FROM l),
 k AS (SELECT *, CAST({_bucket_sql('budget')} AS BIGINT) AS bucket, (seq - 1) // 4 AS chunk FROM b),
 f AS (SELECT *, min(seq) OVER (PARTITION BY doc_id, chunk, bucket) AS first FROM k),
 plan AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS batch_index FROM f)"""


def _style():
    return F.when(F.col("seq") % 3 == 0, "phrase").otherwise("sentence")


def _plan(spark, sf_dir):
    return batching.planned(lines(spark, sf_dir))


@query(f"WITH {LINES_SQL} SELECT doc_id, seq, tokens FROM l")
def token_measure(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "seq", "tokens")


@query(f"WITH {LINES_SQL} SELECT doc_id, seq, {_BUDGET_SQL} AS budget FROM l")
def target_budget(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "seq", B.target_budget(F.col("tokens"), _style()).alias("budget"))


@query(f"WITH {DOCS_SQL}, n AS (SELECT doc_id, length(t) % 500 AS b FROM d) SELECT doc_id, CAST({_bucket_sql('b')} AS BIGINT) AS bucket FROM n")
def budget_bucket(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", B.bucket(F.length("t") % 500).alias("bucket"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, seq, {_STYLE_SQL} AS style, CAST(CASE WHEN {_STYLE_SQL} = 'phrase' AND tokens <= 32 THEN 32 ELSE 512 END AS BIGINT) AS max_new_tokens,
 CASE WHEN {_STYLE_SQL} = 'phrase' THEN 1.5::DOUBLE ELSE 2.5::DOUBLE END AS multiplier, CASE WHEN {_STYLE_SQL} = 'phrase' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS length_penalty,
 CASE WHEN {_STYLE_SQL} = 'phrase' THEN 3.0::DOUBLE END AS max_expansion, CASE WHEN {_STYLE_SQL} = 'phrase' THEN 'warn' ELSE 'off' END AS scaffolding FROM l""")
def gen_policy(spark, sf_dir):
    return lines(spark, sf_dir).withColumn("style", _style()).select("doc_id", "seq", "style", B.policy(F.col("tokens"), F.col("style")).alias("p")).select("doc_id", "seq", "style", "p.*")


@query(f"""WITH {LINES_SQL}, e AS (SELECT *, {_STYLE_SQL} AS style, CASE WHEN seq % 4 = 0 THEN 700 END AS explicit FROM l)
SELECT doc_id, seq, CAST(least(CASE WHEN style = 'phrase' AND tokens <= 32 THEN 32 ELSE 512 END, greatest(1, coalesce(explicit, ceil(tokens * CASE WHEN style = 'phrase' THEN 1.5 ELSE 2.5 END)))) AS BIGINT) AS budget FROM e""")
def engine_budget(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "seq", B.engine_budget(F.col("tokens"), _style(), F.when(F.col("seq") % 4 == 0, 700)).alias("budget"))


@query(f"WITH {DOCS_SQL}, n AS (SELECT doc_id, CAST(greatest(1, (length(t) + 1) // 2) AS BIGINT) AS tokens FROM d) SELECT doc_id, tokens, CASE WHEN tokens > 1024 THEN 'over_token_budget' END AS error FROM n")
def token_budget_guard(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", B.measure(F.col("t")).alias("tokens")).select("doc_id", "tokens", F.when(F.col("tokens") > 1024, "over_token_budget").alias("error"))


_PHRASE_SQL = LINES_SQL + """,
 o AS (SELECT doc_id, seq, regexp_replace(line, '__IT[A-Za-z0-9]{0,16}_[A-Z]\\d{4,}_', ' ', 'g') AS a, CASE seq % 4 WHEN 0 THEN line WHEN 1 THEN 'This is ' || line WHEN 2 THEN line || ' ' || line || ' ' || line || ' ' || line ELSE line || ' __ITRANSLATE_S0001_' END AS z FROM l),
 p AS (SELECT doc_id, seq, a, regexp_replace(z, '__IT[A-Za-z0-9]{0,16}_[A-Z]\\d{4,}_', ' ', 'g') AS b FROM o),
 q AS (SELECT doc_id, seq, b, CAST(greatest(1, len(regexp_extract_all(a, '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9''_-]+'))) AS BIGINT) AS n, CAST(len(regexp_extract_all(b, '[\\x{4e00}-\\x{9fff}]|[A-Za-z0-9''_-]+')) AS BIGINT) AS m FROM p),
 c AS (SELECT doc_id, seq, n AS source_tokens, m AS output_tokens, concat_ws(',', CASE WHEN m / n > 3.0 THEN 'output_expansion_exceeded' END, CASE WHEN regexp_matches(b, '(?i)^\\s*(this (is|product)|it is)\\b') THEN 'sentence_scaffolding_detected' END) AS reasons FROM q)"""


def _phrases(spark, sf_dir):
    four = F.concat_ws(" ", *["line"] * 4)
    out = F.when(F.col("seq") % 4 == 0, F.col("line")).when(F.col("seq") % 4 == 1, F.concat(F.lit("This is "), "line")).when(F.col("seq") % 4 == 2, four).otherwise(F.concat("line", F.lit(" __ITRANSLATE_S0001_")))
    rows = lines(spark, sf_dir).withColumn("c", B.phrase_check(F.col("line"), out))
    return rows.select("doc_id", "seq", "c.source_tokens", "c.output_tokens", F.array_join("c.reasons", ",").alias("reasons"))


@query(f"WITH {_PHRASE_SQL} SELECT doc_id, seq, source_tokens, output_tokens, reasons, reasons = '' AS accepted FROM c")
def phrase_check(spark, sf_dir):
    return _phrases(spark, sf_dir).withColumn("accepted", F.col("reasons") == "")


@query(f"""WITH {_PHRASE_SQL}, y AS (SELECT *, ['off', 'warn', 'retry', 'reject'][1 + (doc_id + seq) % 4] AS policy, seq % 8 >= 4 AS retried FROM c)
SELECT doc_id, seq, policy, CASE WHEN reasons = '' OR policy = 'off' THEN 'accept' WHEN policy = 'warn' THEN 'warn' WHEN policy = 'retry' AND NOT retried THEN 'retry' ELSE 'quality_error' END AS action FROM y""")
def phrase_action(spark, sf_dir):
    """What the configured policy does about a phrase that fails its check; a retry that fails is an error."""
    rows = _phrases(spark, sf_dir).withColumn("policy", F.element_at(F.array(*map(F.lit, ("off", "warn", "retry", "reject"))), ((F.col("doc_id") + F.col("seq")) % 4 + 1).cast("int")))
    action = B.phrase_action(F.filter(F.split("reasons", ","), lambda x: x != ""), F.col("policy"), F.col("seq") % 8 >= 4)
    return rows.select("doc_id", "seq", "policy", action.alias("action"))


_WORDS_SQL = DOCS_SQL + """,
 w AS (SELECT doc_id, t, regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+(?:[-''][\\p{L}\\p{N}_]+)*') AS ws FROM d),
 e AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
 b AS (SELECT doc_id, x, i, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS island FROM e),
 g AS (SELECT doc_id, max(n) AS best FROM (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id, x, island) GROUP BY doc_id),
 a AS (SELECT doc_id, x = lead(x, 2) OVER o AND lead(x, 1) OVER o = lead(x, 3) OVER o AS again FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 p AS (SELECT doc_id, count(*) FILTER (again) AS pairs FROM a GROUP BY doc_id)"""


@query(f"WITH {_WORDS_SQL} SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS words, CAST(coalesce(best, 0) AS BIGINT) AS max_run FROM w LEFT JOIN g USING (doc_id)")
def max_word_run(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("w", T.words(F.col("t")))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), B.max_run(F.col("w")).alias("max_run"))


@query(f"""WITH {_WORDS_SQL} SELECT w.doc_id, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, CASE WHEN len(ws) = 0 THEN trim(t) = ''
 ELSE best > 3 OR (len(ws) >= 4 AND pairs / greatest(1, len(ws) - 3) > 0.35) OR (w.doc_id % 40 <= 32 AND len(ws) > greatest(32, (w.doc_id % 40) * 8)) END AS degenerate
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN p USING (doc_id)""")
def degenerate(spark, sf_dir):
    """The documents taken as outputs of sources of doc_id % 40 tokens."""
    rows = docs(spark, sf_dir)
    return rows.select("doc_id", B.repeated_pairs(T.words(F.col("t"))).alias("pairs"), B.degenerate(F.col("t"), F.col("doc_id") % 40).alias("degenerate"))


@query(f"WITH {_PLAN_SQL} SELECT doc_id, seq, budget, bucket, chunk, batch_index FROM plan")
def batch_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("doc_id", "seq", "budget", "bucket", "chunk", "batch_index")


@query(f"""WITH {_PLAN_SQL} SELECT doc_id, batch_index, CAST(count(*) AS BIGINT) AS items, max(bucket) AS max_target_budget, CAST(sum(tokens) AS BIGINT) AS source_tokens,
 string_agg(CAST(budget AS VARCHAR), ',' ORDER BY seq) AS budgets, string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY seq) AS buckets FROM plan GROUP BY doc_id, batch_index""")
def batch_metrics(spark, sf_dir):
    rows = batching.metrics(_plan(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("doc_id", "batch_index", "items", "max_target_budget", "source_tokens", text("budgets"), text("buckets"))


@query(f"""WITH {_PLAN_SQL} SELECT doc_id, CAST(count(DISTINCT batch_index) AS BIGINT) AS batches, CAST(sum(tokens) AS BIGINT) AS source_tokens, CAST(sum(budget) AS BIGINT) AS requested,
 CAST(sum(bucket) AS BIGINT) AS generated FROM plan GROUP BY doc_id""")
def budget_totals(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("doc_id").agg(F.max("batch_index").alias("batches"), F.sum("tokens").alias("source_tokens"), F.sum("budget").alias("requested"), F.sum("bucket").alias("generated"))


@query(f"""WITH RECURSIVE {LINES_SQL}, c AS (SELECT doc_id, seq, tokens, CAST(0 AS BIGINT) AS chunk, tokens AS used FROM l WHERE seq = 1
 UNION ALL SELECT l.doc_id, l.seq, l.tokens, CASE WHEN c.used + l.tokens <= 450 THEN c.chunk ELSE c.chunk + 1 END, CASE WHEN c.used + l.tokens <= 450 THEN c.used + l.tokens ELSE l.tokens END FROM c JOIN l ON l.doc_id = c.doc_id AND l.seq = c.seq + 1)
SELECT doc_id, chunk, CAST(count(*) AS BIGINT) AS sentences, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY doc_id, chunk""")
def chunk_sentences(spark, sf_dir):
    """Lines packed in order into chunks of 450 tokens; a longer line has a chunk of its own."""
    units = F.array_sort(F.collect_list(F.struct("seq", "tokens")))
    rows = lines(spark, sf_dir).groupBy("doc_id").agg(units.alias("units")).withColumn("chunks", batching.packed(F.col("units"), 450))
    each = rows.select("doc_id", F.explode(F.arrays_zip("units", "chunks")).alias("x"))
    return each.groupBy("doc_id", F.col("x.chunks").alias("chunk")).agg(F.count("*").alias("sentences"), F.sum("x.units.tokens").alias("tokens"))


@query(f"WITH {LINES_SQL}, s AS (SELECT doc_id, seq, printf('%d:%04d', doc_id, seq - 1) AS segment_id FROM l) SELECT doc_id, segment_id, lag(segment_id) OVER w AS before, lead(segment_id) OVER w AS after FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")
def segment_context(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("segment_id", F.format_string("%d:%04d", "doc_id", F.col("seq") - 1))
    return rows.select("doc_id", "segment_id", F.lag("segment_id").over(by_doc("seq")).alias("before"), F.lead("segment_id").over(by_doc("seq")).alias("after"))


@query(f"WITH {LINES_SQL} SELECT doc_id, printf('%d:%04d', doc_id, seq - 1) AS segment_id, printf('t%05d', pos) AS node_id FROM l")
def segment_ids(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", F.format_string("%d:%04d", "doc_id", F.col("seq") - 1).alias("segment_id"), F.format_string("t%05d", "pos").alias("node_id"))


@query(f"WITH {LINES_SQL}, o AS (SELECT doc_id, seq, length(line) AS n, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY seq) AS stop FROM l) SELECT doc_id, seq, CAST(stop - n AS BIGINT) AS offset_start, CAST(stop AS BIGINT) AS offset_end FROM o")
def run_offsets(spark, sf_dir):
    stop = F.sum(F.length("line")).over(by_doc("seq"))
    return lines(spark, sf_dir).select("doc_id", "seq", (stop - F.length("line")).alias("offset_start"), stop.alias("offset_end"))


@query(f"WITH {LINES_SQL}, p AS (SELECT doc_id, seq, NOT regexp_matches(line, '[\\x{{4e00}}-\\x{{9fff}}]') AS held FROM l) SELECT doc_id, seq, CAST(coalesce(sum(CASE WHEN held THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS slot_index FROM p QUALIFY NOT held")
def slot_index(spark, sf_dir):
    """Lines as runs: one with Han characters is translated and takes the slot after the placeholders before it."""
    held = T.lang_kind(F.col("line")) == "english"
    rows = lines(spark, sf_dir).withColumn("held", held)
    before = F.coalesce(F.sum(F.col("held").cast("long")).over(by_doc("seq").rowsBetween(-(2**31), -1)), F.lit(0))
    return rows.withColumn("slot_index", before).filter(~F.col("held")).select("doc_id", "seq", "slot_index")


@query(f"WITH {LINES_SQL}, k AS (SELECT doc_id, (pos - 1) // 3 AS block, regexp_matches(line, '[\\x{{4e00}}-\\x{{9fff}}]') AS han FROM l) SELECT doc_id, printf('b%04d', block) AS block_key, CAST(count(*) AS BIGINT) AS items FROM k GROUP BY doc_id, block HAVING bool_or(han)")
def translatable_blocks(spark, sf_dir):
    """Three lines as a block; a block is sent if any of its text isn't English."""
    rows = lines(spark, sf_dir).withColumn("block", F.floor((F.col("pos") - 1) / 3))
    blocks = rows.groupBy("doc_id", "block").agg(F.count("*").alias("items"), F.bool_or(T.lang_kind(F.col("line")) != "english").alias("sent"))
    return blocks.filter("sent").select("doc_id", F.format_string("b%04d", "block").alias("block_key"), "items")


@query(f"WITH {LINES_SQL}, o AS (SELECT doc_id, seq, regexp_replace(line, '([\\x{{4e00}}-\\x{{9fff}}]+)', 'EN:\\1', 'g') AS new FROM l WHERE regexp_matches(line, '[\\x{{4e00}}-\\x{{9fff}}]')) SELECT l.doc_id, l.seq, coalesce(o.new, l.line) AS text FROM l LEFT JOIN o ON l.doc_id = o.doc_id AND l.seq = o.seq")
def apply_node_text(spark, sf_dir):
    """Nodes get their rebuilt text; those without one keep theirs."""
    from ..operators.model import marked

    nodes = lines(spark, sf_dir)
    rebuilt = nodes.filter(T.lang_kind(F.col("line")) != "english").select("doc_id", "seq", marked(F.col("line")).alias("new"))
    return nodes.join(rebuilt, ["doc_id", "seq"], "left").select("doc_id", "seq", F.coalesce("new", "line").alias("text"))


@query(f"""WITH {_PLAN_SQL}, res AS (SELECT doc_id, batch_index, seq, CASE WHEN seq % 7 = 0 THEN NULL ELSE line END AS out FROM plan WHERE seq % 5 <> 0),
 n AS (SELECT doc_id, batch_index, count(*) AS items FROM plan GROUP BY doc_id, batch_index), g AS (SELECT doc_id, batch_index, count(*) AS got FROM res GROUP BY doc_id, batch_index)
SELECT plan.doc_id, plan.batch_index, plan.seq, CASE WHEN coalesce(got, 0) <> items THEN 'batch_count_mismatch' WHEN out IS NULL THEN 'bad_item' ELSE 'ok' END AS status
FROM plan JOIN n USING (doc_id, batch_index) LEFT JOIN g USING (doc_id, batch_index) LEFT JOIN res ON plan.doc_id = res.doc_id AND plan.seq = res.seq""")
def batch_result_join(spark, sf_dir):
    """Inputs met with results, of which some are missing or null: a call with the wrong number fails whole, a null item alone."""
    from pyspark.sql import Window as W

    plan = _plan(spark, sf_dir)
    results = plan.filter("seq % 5 <> 0").select("doc_id", "seq", F.when(F.col("seq") % 7 != 0, F.col("line")).alias("out"), F.lit(1).alias("got"))
    call = W.partitionBy("doc_id", "batch_index")
    rows = plan.join(results, ["doc_id", "seq"], "left").withColumn("n", F.count("*").over(call)).withColumn("m", F.count("got").over(call))
    return rows.select("doc_id", "batch_index", "seq", F.when(F.col("n") != F.col("m"), "batch_count_mismatch").when(F.col("out").isNull(), "bad_item").otherwise("ok").alias("status"))


@query(f"""WITH {LINES_SQL}, a AS (SELECT doc_id, seq, line FROM l), b AS (SELECT doc_id, seq, CASE WHEN doc_id % 3 = 0 AND seq = 2 THEN line || '!' ELSE line END AS line FROM l WHERE NOT (doc_id % 5 = 0 AND seq > 3)),
 x AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.seq AS s, b.seq AS t, coalesce(a.seq, b.seq) AS seq, a.line AS p, b.line AS q FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.seq = b.seq),
 y AS (SELECT doc_id, count(s) AS left_n, count(t) AS right_n, min(CASE WHEN p IS DISTINCT FROM q THEN seq END) AS first FROM x GROUP BY doc_id)
SELECT doc_id, CASE WHEN left_n <> right_n THEN 'segment_count' WHEN first IS NOT NULL THEN 'segment_plan' ELSE 'equal' END AS layer, coalesce(first, -1) AS first, substr((SELECT p FROM x WHERE x.doc_id = y.doc_id AND x.seq = first), 1, 120) AS left_excerpt FROM y""")
def plan_diff(spark, sf_dir):
    """The first divergence of two plans of each document, and the first 120 characters of the left side there."""
    a = lines(spark, sf_dir).select("doc_id", "seq", F.col("line").alias("p"))
    b = lines(spark, sf_dir).filter("NOT (doc_id % 5 = 0 AND seq > 3)").select("doc_id", "seq", F.when((F.col("doc_id") % 3 == 0) & (F.col("seq") == 2), F.concat("line", F.lit("!"))).otherwise(F.col("line")).alias("q"))
    both = a.join(b, ["doc_id", "seq"], "full")
    differs = F.min(F.when(~F.col("p").eqNullSafe(F.col("q")), F.struct("seq", F.substring("p", 1, 120).alias("p"))))
    sums = both.groupBy("doc_id").agg(F.count("p").alias("m"), F.count("q").alias("n"), differs.alias("d"))
    layer = F.when(F.col("m") != F.col("n"), "segment_count").when(F.col("d").isNotNull(), "segment_plan").otherwise("equal")
    return sums.select("doc_id", layer.alias("layer"), F.coalesce("d.seq", F.lit(-1)).alias("first"), F.col("d.p").alias("left_excerpt"))


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8")
def last_n(spark, sf_dir):
    """The service keeps a user's last 8 records (its limit); events are the carrier."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.row_number().over(order).alias("n")).filter("n <= 8").drop("n")
