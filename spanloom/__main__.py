"""Command line: translate tables of text or pages, process an image folder, serve requests, check a model's files."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    out.add_argument("-c", "--config", help="settings as JSON; without it config.json here, or the built-in ones")
    ways = out.add_subparsers(dest="way", required=True)
    for name, what in (("text", "texts"), ("html", "pages")):
        p = ways.add_parser(name, help=f"translate a Parquet table of {what}")
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--id", default="doc_id")
        p.add_argument("--column", default="text" if name == "text" else "html")
    p = ways.add_parser("images", help="process a folder of PNG images; regions come from a JSON table (sha256, regions)")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--regions", required=True)
    p = ways.add_parser("serve", help="answer JSON requests as their files arrive in a folder")
    p.add_argument("requests")
    p.add_argument("results")
    p.add_argument("checkpoint")
    p.add_argument("--once", action="store_true")
    p = ways.add_parser("check-cache", help="whether a model's files are all there: exit status 0 or 1")
    p.add_argument("folder")
    return out


def main(argv: list[str] | None = None) -> int:
    asked = parser().parse_args(argv)
    from .sources import config, snapshot

    try:
        settings = config.load(asked.config)
    except config.ConfigError as e:
        print(f"settings: {e}", file=sys.stderr)
        return 2
    if asked.way == "check-cache":
        gone = snapshot.missing(asked.folder)
        print("complete" if not gone else f"missing: {', '.join(gone)}")
        return int(bool(gone))
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    if asked.way == "serve":
        from .streaming.service import serve

        serve(spark, asked.requests, asked.results, asked.checkpoint, once=asked.once).awaitTermination()
        return 0
    if asked.way == "images":
        from .plans import images as plan
        from .sources import images as source

        rows = spark.read.json(asked.regions).collect()
        known = {r["sha256"]: [(x["text"], x["confidence"], x["polygon"]) for x in r["regions"]] for r in rows}
        done = plan.processed(source.scan(spark, asked.input, settings.images), plan.table_recognizer(known), settings.images).persist()
        done.write.mode("overwrite").parquet(asked.output)
        totals = plan.summary(done).first()
        print(totals.asDict())
        return int(totals["has_failures"])
    table = spark.read.parquet(asked.input).select(F.col(asked.id).alias("doc_id"), F.col(asked.column).alias(asked.way))
    if asked.way == "text":
        from .plans.plain import translate

        translate(table, "text", most_chars=settings.translation.max_input_characters, most_tokens=settings.translation.max_input_tokens).write.mode("overwrite").parquet(asked.output)
    else:
        from .plans.structured import translate_html

        translate_html(table, settings=settings.structured).write.mode("overwrite").parquet(asked.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
