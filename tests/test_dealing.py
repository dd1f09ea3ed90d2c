"""Joins and windows on an episode shuffle events once, in parts that do not grow with the table."""

import re

import pytest

from tandem import catalog
from tandem.operators import contracts, features, interactions
from tandem.plans.relations import on_episodes
from tandem.sources import tables

FOLDER = "/root/testdata/sf0.001"


def test_joins_on_more_than_an_episode_are_ranges():
    assert on_episodes("ON c.lo = t.lo AND c.hi = t.hi AND c.episode = t.episode") == "ON c.lo BETWEEN t.lo AND t.lo AND c.hi BETWEEN t.hi AND t.hi AND c.episode = t.episode"
    assert on_episodes("ON f.episode = t.episode AND f.actor = t.lo JOIN b ON b.member = t.lo AND b.win = t.win") == "ON f.episode = t.episode AND f.actor BETWEEN t.lo AND t.lo JOIN b ON b.member = t.lo AND b.win = t.win"
    assert on_episodes("ON e.episode = q.episode AND ra.member = q.lo") == "ON e.episode = q.episode AND ra.member = q.lo"  # other tables


@pytest.mark.parametrize("name", ["kernel_view", "heads_up", "joint_features"])
def test_events_are_dealt_once_in_parts_of_some_size(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "TASK_EVENTS", 500)
    events = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    df = catalog.queries()[name](spark, FOLDER)
    rows = sorted(map(repr, df.collect()))
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = re.findall(r"Exchange (hashpartitioning\([^)]*\)), (\w+)", re.sub(r"#\d+L?", "", plan))
    assert set(dealt) == {(f"hashpartitioning(episode, {-(-events // 500)})", "REPARTITION_BY_NUM")}
    monkeypatch.setattr(tables, "TASK_EVENTS", 10**9)
    assert sorted(map(repr, catalog.queries()[name](spark, FOLDER).collect())) == rows


@pytest.mark.parametrize("name", ["role_features", "oriented_episode_features", "pair_rollup"])
def test_pairs_of_dealt_events_are_planned(spark, monkeypatch, name):
    # gathered lists are nondeterministic to Spark: in a WITH that is read twice they got no plan once the events were dealt
    monkeypatch.setattr(tables, "TASK_EVENTS", 500)
    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "RoundRobin" not in plan


@pytest.mark.parametrize("name", ["role_features", "oriented_episode_features"])
def test_events_of_pairs_are_not_sent_to_the_pairs(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = lambda line: re.search(r"[A-Za-z*(]", line).start()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(lo" in line:
            below = []
            for other in lines[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            grouped = any("max_by(" in other for other in below)  # one row for an episode of a pair by then
            assert grouped or not any(re.search(r"\b(pot|last_pusher)#", other) for other in below)


def test_citations_go_to_their_episodes_once(spark):
    episodes = spark.createDataFrame([(e, "evaluation" if e % 2 else "development") for e in range(1, 7)], "episode long, win string")
    participants = spark.createDataFrame([(1, 10), (1, 20), (2, 10), (2, 30), (3, 20), (4, 10), (4, 20)], "episode long, member long")
    scored = spark.createDataFrame([(0, 10, 20, e, e, "evaluation", float(e), 0.0) for e in (1, 2, 3, 4, 5, 6, 9)] + [(0, 10, 30, 2, 2, "evaluation", 1.0, 0.0)], "pool long, lo long, hi long, episode long, ts long, win string, score double, lean double")
    tables_ = {"episodes": episodes, "participants": participants, "scored": scored, "pair_scores": scored.selectExpr("pool", "lo", "hi", "1e0 AS score", "0 AS family").distinct()}
    relations = catalog.relations()
    found, plain = relations.frame(spark, contracts._MEMBERSHIP_ON_SPARK, tables_), relations.frame(spark, contracts.OPERATORS["validate_membership"], tables_)
    assert found.collect() == plain.collect() == [(6, 1, 3, 4)]
    query = catalog.queries()["validate_membership"](spark, FOLDER)
    assert "Union" not in query._jdf.queryExecution().optimizedPlan().toString()


def test_decisions_are_not_sent_to_their_members(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["decision_context"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"SortMergeJoin \[member#\d+L?, win#\d+", plan)


def test_only_partners_and_totals_are_sent_to_a_rollup(spark, monkeypatch):
    plans, keep = [], interactions.kept
    monkeypatch.setattr(interactions, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    rows = catalog.queries()["pair_rollup"](spark, FOLDER)
    plans.append(rows._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and not any(re.search(r"Exchange hashpartitioning\((actor|target)#\d+L?, (actor|target)#", p) for p in plans)
    assert sum("hashpartitioning(actor" in line for line in plans[0].split("Initial Plan")[0].splitlines()) == 1  # sums by actor and partner, or actor alone
    # other features, a mask, and labels of some pairs only
    tables_, relations = {**tables.Tables(spark, FOLDER)}, catalog.relations()
    tables_["pair_labels"] = relations.frame(spark, "SELECT * FROM {pair_labels} WHERE lo % 3 = 0", tables_)
    for features, mask in ((("faced", "max_matched"), "TRUE"), (("exit_to", "pushes_edge", "max_pot_at_exit"), "episode % 2 = 0 AND opportunities > 1")):
        got = interactions.roll_up(spark, tables_, features, mask=mask).collect()
        want = relations.frame(spark, interactions.rollup(features, mask=mask), tables_).collect()
        assert len(got) == 3 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_wide_rows_of_pairs_stay_with_their_episodes(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["pair_episode_features"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange hashpartitioning\((lo|hi)#\d+L?, win#", plan)
    sent = re.findall(r"hashpartitioning\(lo#\d+L?, hi#\d+L?, \d+\)", plan)
    assert len(sent) == 1  # what is ranked and averaged
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if sent[0] in line)
    assert "facing_lo" not in lines[at + 1] and "push_stage0_lo" not in lines[at + 1]


def test_features_of_episodes_that_come_more_than_once(spark, monkeypatch):
    given = {**tables.Tables(spark, FOLDER)}
    orders = given["orders"]
    later = orders.where("o_orderkey % 11 = 0").selectExpr(*("o_totalprice * 2 AS o_totalprice" if c == "o_totalprice" else "o_orderdate + INTERVAL 40 DAYS AS o_orderdate" if c == "o_orderdate" else c for c in orders.columns))
    given["orders"] = orders.where("o_orderkey % 7 <> 3").unionAll(orders.where("o_orderkey % 5 = 0")).unionAll(later)
    monkeypatch.setattr(catalog, "Tables", lambda spark, folder: given)
    open_ties = ("risk_before5", "risk_after5", "risk_near10", "risk_near25")  # of equal rows
    got = catalog.queries()["pair_episode_features"](spark, FOLDER).drop(*open_ties).collect()
    want = catalog.relations().frame(spark, features.OPERATORS["pair_episode_features"], {**given, "member_rates": catalog.relations().frame(spark, features.RELATIONS["member_rates"], given)}).drop(*open_ties).collect()
    assert len(got) > len(set(map(repr, got))) > 100 and sorted(map(repr, got)) == sorted(map(repr, want))
