import random

import pytest
from pyspark.sql import functions as F

from schemagate.functions.headers import header_row_score, looks_generic, normalize_header
from schemagate.operators import headers
from schemagate.profiles import load_profile

BUDGET = load_profile("budget_execution_v1")
ENGLISH = ["Period", "Department", "Budget Line", "Description", "Planned Amount", "Executed Amount", "Remaining", "Execution %", "Status", "Responsible", "Currency"]


def test_normal_forms(spark):
    cases = {
        " Planned  Amount ": "planned_amount", "Execution %": "execution_percent", "Сума": "amount", "Щъркел": "shtarkel",
        "неактивен": "neactive", "Qty.": "quantity", "état": "etat", "_x_": "x", None: "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string").select(normalize_header(F.col("h")).alias("n"))
    assert [r.n for r in df.collect()] == list(cases.values())


def test_english_budget_headers(spark):
    matches = headers.map_columns(spark, ENGLISH, BUDGET)
    assert set(BUDGET.targets) - set(matches) == {"notes"}
    assert matches["planned_amount"] == ("Planned Amount", 1.0)
    mapping = headers.column_mapping(matches)
    assert mapping["Execution %"] == "execution_percentage"


def _greedy(scores, targets, order, least):
    """Targets by best score take their best unused header."""
    best = {t: max((s for (_, u), s in scores.items() if u == t), default=0) for t in targets}
    used, out = set(), {}
    for t in sorted(targets, key=lambda t: -best[t]):
        free = [h for h in order if h not in used and scores[h, t] >= least]
        if free:
            out[t] = max(free, key=lambda h: scores[h, t])
            used.add(out[t])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["planned", "executed", "amount", "remaining", "status", "period", "budget", "line", "notes", "currency"]
    names = list(dict.fromkeys(" ".join(rng.sample(words, rng.choice((1, 2)))) for _ in range(40)))
    table = headers.header_table(spark, names, "f")
    targets = BUDGET.targets
    scores = {(r.header, r.target): r.similarity for r in headers.header_pairs(table, targets).collect()}
    got = {r.target: r.header for r in headers.greedy_matches(table, targets, 0.4).collect()}
    assert got == _greedy(scores, targets, names, 0.4)


def test_repeated_headers_match_once(spark):
    table = headers.header_table(spark, ["status", "status", "period"], "f")
    got = headers.greedy_matches(table, ["status", "state", "period"], 0.5).collect()
    assert sorted((r.target, r.header, r.position) for r in got) == [("period", "period", 2), ("status", "status", 0)]


def test_header_row(spark):
    rows = [("f", 0, ["1", "Report 2025", ""]), ("f", 1, ["Period", "Amount", "Row name"]), ("f", 2, ["2025", "10", "abc"]), ("g", 0, ["", None])]
    df = spark.createDataFrame(rows, "file_id string, row_id bigint, cells array<string>")
    got = headers.detect_header_rows(df).collect()
    assert [(r.file_id, r.header_row, r.headers) for r in got] == [("f", 1, ["Period", "Amount", "Row name"])]
    score = df.filter("row_id = 1").select(header_row_score(F.col("cells")).alias("s")).first().s
    assert score == pytest.approx((2.3 + 2.8 + 2.8 - 0.5) / 3)


def test_generic_names():
    assert looks_generic(["", "Unnamed: 1", "Column_2", "7"]) and not looks_generic(["7", "Name"])


def test_report_and_bootstrap(spark):
    table = headers.header_table(spark, ["Period", "Dept"], "f")
    matches = headers.alias_matches(table, BUDGET)
    r = headers.match_report(table, BUDGET.targets, matches).first()
    assert (r.headers, r.matched, r.unmatched_targets) == (2, 2, 10)
    proposed = headers.bootstrap_profile(table, ["period", "zzz"]).collect()
    assert sorted((p.target, p.source) for p in proposed) == [("period", "Period"), ("zzz", "zzz")]
