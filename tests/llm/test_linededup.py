import re

import numpy as np
import pytest

from spanloom.llm import linededup

from .cases import ROWS, documents, empty


def brute(rows, least=10):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(linededup.NO_ID if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        mine = linededup.NO_ID if i is None else i
        stay = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == mine]
        out.append((str(i), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


MORE = [(30, "ein Überschriftstück Ä\nshort\nshared line number one"), (31, "EIN Überschriftstück Ä \nshared line number one\nshared line number one"), (32, "ein überschriftstück ä"), (None, "shared line number one"), (33, " shared line number one\n\n\n")]


@pytest.mark.parametrize("rows", [ROWS, ROWS + MORE, MORE * 3])
def test_against_brute_force(spark, rows):
    got = linededup.line_dedup(documents(spark, rows).repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"] or "") for r in got) == brute(rows)


def test_many_rows_without_an_id_have_lists_of_their_own(spark):
    """They are one document for the choice, but no row's list of lines is longer than its text."""
    rows = [(None, f"line {i} of a text without a name\nline {i % 7} that some of them share") for i in range(60)] + [(1, "\n".join(f"line {i} of a text without a name" for i in range(0, 60, 2)))]
    got = linededup.line_dedup(documents(spark, rows).repartition(4)).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"] or "") for r in got) == brute(rows)


def test_full_filter_only_makes_more_suspects(spark, monkeypatch):
    monkeypatch.setattr(linededup, "MIN_BITS", 64)
    monkeypatch.setattr(linededup, "MAX_BITS", 64)
    got = linededup.line_dedup(documents(spark, ROWS + MORE)).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"] or "") for r in got) == brute(ROWS + MORE)


def test_twice_filter_misses_no_repeat(spark):
    rows = [(i, f"line number {i % 500} of the corpus\nunique line {i} {i}") for i in range(1000)]
    bits, n = linededup.twice_filter(documents(spark, rows).select("text").repartition(5), 10)
    at = linededup.positions([f"line number {i} of the corpus".encode() for i in range(500)], n)
    hits = lambda at: (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
    assert hits(at).all()
    assert hits(linededup.positions([f"unique line {i} {i}".encode() for i in range(1000)], n)).mean() < 0.05


def test_columns_stay(spark):
    docs = documents(spark)
    done = linededup.deduplicated(docs)
    assert done.schema == docs.schema and done.count() == len(ROWS)
    assert next(r for r in done.collect() if r["doc_id"] == 2)["text"] is None


def test_empty_table(spark):
    assert linededup.line_dedup(empty(spark)).count() == 0
