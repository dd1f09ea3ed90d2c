"""Feature operators on one episode whose values were worked out by hand, and general operators on small frames."""

import pytest

from tandem import catalog
from tandem.functions import frames
from tandem.operators.features import OPERATORS

EV = "episode long, ordinal long, stage int, member long, action string, act string, amount double, to_call double, strength double, net_part double"
EVENTS = [
    (1, 0, 0, 1, "raise", "push", 20.0, 0.0, 0.5, -5.0),
    (1, 1, 0, 2, "call", "match", 20.0, 20.0, 0.25, 10.0),
    (1, 2, 0, 3, "fold", "exit", 0.0, 20.0, 0.125, -5.0),
    (1, 3, 1, 1, "check", "hold", 0.0, 0.0, 0.5, 0.0),
    (1, 4, 1, 2, "raise", "push", 30.0, 0.0, 0.25, 5.0),
    (1, 5, 1, 1, "fold", "exit", 0.0, 30.0, 0.75, -5.0),
]


@pytest.fixture(scope="module")
def row(spark):
    tables = {
        "members": spark.createDataFrame([(m, 0, 0, 100.0) for m in (1, 2, 3)], "member long, pool int, region int, balance double"),
        "episodes": spark.sql("SELECT 1L AS episode, TIMESTAMP '1998-01-01 00:00:00' AS ts, 10D AS unit, 'x' AS priority, 'development' AS win"),
        "events0": spark.createDataFrame(EVENTS, EV).drop("act", "stage"),
        "ev": spark.createDataFrame(EVENTS, EV),
    }

    def find(name, **where):
        sql = next(m.OPERATORS[name] for m in catalog._modules() if name in m.OPERATORS)
        found = [r for r in catalog.relations().frame(spark, sql, tables).collect() if all(r[k] == v for k, v in where.items())]
        assert len(found) == 1, found
        return found[0].asDict()

    return find


def has(got, **want):
    assert {k: got[k] for k in want} == {k: pytest.approx(v, abs=1e-6) if isinstance(v, float) else v for k, v in want.items()}


PAIR = {"lo": 1, "hi": 2}


def test_pair_episode_row(row):
    has(row("immediate_response", **PAIR), hi_match_at_once_after_lo=1, hi_exit_at_once_after_lo=0, lo_exit_at_once_after_hi=1, outsider_exit_at_once_after_lo=0)
    has(row("facing_cost", **PAIR), facing_lo=1, exit_facing_lo=1, facing_hi=1, match_facing_hi=1, push_facing_hi=0, all_in_push_lo=0)
    got = row("pair_episode_features", **PAIR)
    assert len(got) == 103
    has(got, net_units_lo=-1.0, net_units_hi=1.5, t_ab=1.0, t_ba=0.0, put_units_lo=2.0, put_units_hi=5.0, final_pot_units=7.0, players=3, stayed=1, both_stayed=0, mutual_pushes=1)
    has(got, n_lo=3, exit_lo=1, hold_lo=1, push_lo=1, mean_active_lo=7 / 3, response_hi_after_lo=2, response_lo_after_hi=1, outsider_exits_after_lo=1, outsider_exits_after_hi=0, lo_exit_after_push=1, hi_exit_after_push=0, first_push_hi=4)
    # all there is of a member is this episode, so rates are those of the background; 1 + 0.5 * 0 + 0.25 * 1 + 0.25 * 1
    has(got, push_delta_lo=0.0, risk_proxy=1.5, risk_before5=1.5, risk_peak10=1.5)
    has(row("pair_descriptors", **PAIR), opened_by_pair=1, pair_pushes=2, outsider_pushes=0, exits_after_pair=1, exits_to_partner=1, re_pushes=0, strength_given_up=0.75, sunk_given_up=2.0, pot_given_up=7.0, stage_given_up=1, holds_alone=1, pushes_alone=1, exits_alone=1, won_uncontested=1, outsider_entries=0)
    has(row("role_event_flags", **PAIR), conceded=1, conceded_after_outsider=0, both_pushed=0, outsider_exit_after_both=0, became_alone=1, pair_pushes=2, outsider_pushes=0, first_push_pair=1)
    has(row("heads_up", **PAIR), stages=1, quiet_stages=0, holds=1, pushes=1, exits=1)
    has(row("burst_concentration", **PAIR), abs_net=1.0, yielded=1, faced=2, alone=1, iso=0, top1_share=1.0, direction_share=1.0, longest_run=1, n=1, span=0)


def test_who_gains_when_a_member_leaves(row):
    # member 3 (0.125) leaves 0.75 and 0.25: shares of 1.125 become shares of 1; both members of its pool are there
    has(row("fold_beneficiary", leaver=3, partner=1), others=2, released=1 / 9, most=0.75 / 9, to_partner=0.75 / 9, to_outsiders=0.25 / 9, partner_share=0.75)
    has(row("fold_beneficiary", leaver=3, partner=2), to_partner=0.25 / 9, to_outsiders=0.75 / 9)
    # member 1 leaves 2 alone, which gets all
    has(row("fold_beneficiary", leaver=1, partner=2), others=1, released=0.75, to_partner=0.75, to_outsiders=0.0, partner_share=1.0)


def test_push_over_one_whose_matcher_is_there(spark):
    acts = [(1, "push"), (2, "match"), (3, "push"), (1, "exit"), (2, "push"), (3, "match"), (4, "push"), (3, "exit"), (2, "push")]
    events = [(1, i, 0, m, "raise" if a == "push" else "call", a, 1.0, 0.0, 0.5, 0.0) for i, (m, a) in enumerate(acts)]
    found = catalog.relations().frame(spark, "SELECT ordinal FROM {pushes_matched}", {"ev": spark.createDataFrame(events, EV), "participants": spark.sql("SELECT 1L AS episode, member, exit_ordinal FROM VALUES (1L, 3L), (2L, NULL), (3L, 7L), (4L, NULL) AS v(member, exit_ordinal)")})
    # 3 pushes over 1 while 2, who matched, is there; 2 pushes over 3 with no matcher; 4 pushes over 2 while 3, who matched, is there; 2 pushes over 4 with no matcher
    assert sorted(r["ordinal"] for r in found.collect()) == [2, 6]


def test_directed_and_member_rows(row):
    one = {"actor": 1, "target": 2}
    has(row("surprisal_interactions", **one), n_decisions=3, n_answers=1, exit_when_strong=1, exit_when_ahead=0, big_exit_when_strong=0, hold_when_strong=0, own_decisions=3)
    has(row("suppressed_forced", **one), n_passive=1, n_exit_to=1, n_push_many=1, n_match_to=0, n_after_opening=0)
    has(row("facing_responses", **one), n=1, n_exit=1, n_match=0, sunk_at_exit=2.0, pot_at_exit=7.0)
    has(row("multiway_partner_strength", **one), decisions=1, pushes=1, exits=0, pushes_weak=0, pushes_other_strong=0)
    has(row("member_episode_features", member=1), entered=1, pushed_first_stage=1, n_push=1, n_hold=1, exited=1, exit_stage=1, contribution_units=2.0, net_units=-1.0, n_decisions=3, last_stage=1, first_strength=0.5, last_strength=0.75, acts_first=1, position=0)
    has(row("decision_context", ordinal=5), pot=7.0, odds=0.3, active=2, position=0, pushes_this_stage=1, own_pushes=0, initiative=1, stage_put=0.0, strength=0.75, seen=0)
    has(row("decision_context_v2", ordinal=5), own_pushes=1, own_matches=0, pushed_first_stage=1, callers_since_push=0, own_acts_this_stage=1, cost_to_pot=30 / 70)
    for partner in (1, 2):  # a row for each partner that is still there
        has(row("fold_beneficiary", leaver=3, partner=partner), others=2, released=0.125 / (0.75 + 0.25 + 0.125))


def test_roles(row):
    has(row("orient_by", **PAIR), receiver_net=2, receiver_flow=2, receiver_candidates=2, flipped_net=1)
    has(row("role_features", **PAIR), receiver=2, net_r=1.5, net_s=-1.0, first_pusher=2, s_last_act="exit", r_last_act="push", s_exit_to_r=1, r_exit_to_s=0, s_stayed=0, r_stayed=1, direction=1, both_in=1, big=0)
    got = row("orient_roles", **PAIR)
    has(got, donor=1, flow_dr=1.0, flow_rd=0.0, d_exit_to=1, r_exit_to=0, d_exited=1, d_agrees=1, alone_stages=1)
    assert len(got) == 34
    has(row("oriented_episode_features", **PAIR), receiver=2, transfer=1.0, strength_exit_s=0.75, s_exit_facing=1, n_s=3, n_r=2, outsider_exits=1, s_match_first_stage=0, r_pushed=1)


def test_cross_role_and_large_ids(spark):
    scores = spark.createDataFrame([(0, 1, 2, 20, 0.5, 0.6, None, 0), (0, 100000, 100001, 20, 0.5, 0.6, None, 0), (0, 3, 4, 20, 0.5, 0.6, 1, 0)], "pool int, lo long, hi long, n long, score double, top double, label int, family int")
    labels = spark.createDataFrame([(0, 2, 9, 1, 0), (0, 1, 2, None, 0), (0, 100000, 100001, None, 0), (0, 1, 100001, None, 0)], "pool int, lo long, hi long, label int, family int")
    run = lambda name, tables: catalog.relations().frame(spark, next(m.OPERATORS[name] for m in catalog._modules() if name in m.OPERATORS), tables)
    # member 2 is lo in its positive pair and hi here
    assert {r["touch"]: r["pairs"] for r in run("universe_gap", {"pair_scores": scores, "pair_labels": labels}).collect()} == {0: 1, 1: 1}
    scored = spark.createDataFrame([(1, 200001, 1), (3, 1, 1)], "lo long, hi long, episode long")  # lo * 100000 + hi is the same for both
    got = run("id_set_compare", {"pair_labels": labels.select("lo", "hi"), "scored": scored}).first()
    assert (got["missing"], got["unexpected"], got["doubled"]) == (4, 2, 0)


def test_permutation_null_uses_all_draws(spark):
    from tandem.operators.mixtures import permutation_null

    scored = spark.createDataFrame([(1, 2, e, e) for e in range(30)], "lo long, hi long, episode long, ts long")
    listed = spark.createDataFrame([(1, 2, e) for e in (3, 4, 20)], "lo long, hi long, episode long")
    got = catalog.relations().frame(spark, permutation_null(n=100), {"scored": scored, "listed": listed}).first()
    assert (got["adjacent"], got["gap"]) == (1, 8.5)
    # two of the twenty before the last one at random: neighbours in 20 of 210 pairs of the 21, with the last one fixed in 1 + ... as counted here
    chances = [sum(b - a == 1 for a, b in ((i, j), (j, 20))) for j in range(20) for i in range(j)]
    assert got["by_chance"] == pytest.approx(sum(chances) / len(chances), abs=0.12)
    assert abs(got["by_chance"] * 100 - round(got["by_chance"] * 100)) < 1e-6


def test_frames(spark):
    rows = [("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 3.0), ("b", 4, None), ("b", 5, float("inf"))]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    assert [r["x"] for r in frames.impute_finite(df, ["x"]).orderBy("i").collect()] == [1.0, 3.0, 3.0, 3.0, 3.0]
    a = df.where("k = 'a'")
    assert [r["rank"] for r in frames.rank_within(a, ["k"], "x").orderBy("i").collect()] == [1.0, 2.5, 2.5]
    assert [r["rank"] for r in frames.rank_within(a, ["k"], "x", "first", ["i"]).orderBy("i").collect()] == [1, 2, 3]
    assert frames.profile(a, ["k"], ["x"]).first()["x_q90"] == pytest.approx(3.0)
    assert frames.top_k(a, ["k"], "i", "x", 2, ["i"], df).orderBy("k").collect() == [("a", 2, 3), ("b", None, None)]
    z = frames.standardize_clip(a, ["x"], -1.0, 1.0).orderBy("i").collect()
    assert [round(r["x"], 4) for r in z] == [-1.0, 0.7071, 0.7071]
    got = frames.frame_stats(a, ["k"], ["i"], "x", 1, (1,), 1).orderBy("i").collect()
    assert [(r["x_before"], r["x_after"], r["x_near1"], r["x_peak"]) for r in got] == [(1.0, 3.0, 2.0, 3.0), (1.0, 3.0, pytest.approx(7 / 3), 3.0), (3.0, 3.0, 3.0, 3.0)]
    assert [round(r["residual"], 4) for r in frames.context_residual(a, "x", ["k"]).orderBy("i").collect()] == [-0.5, 0.0, 0.0]
    assert [round(r["x_z"], 3) for r in frames.within_z(a, ["k"], ["x"]).orderBy("i").collect()] == [-1.414, 0.707, 0.707]
    assert [r["x_rank"] for r in frames.percent_ranks(a, ["k"], ["x"], "i").orderBy("i").collect()] == [0.0, 0.5, 1.0]


def test_equal_nets_are_taken_by_time(spark):
    """Nets of 0.1 + 0.2 and 0.3 are equal: the earlier episode is the first of them, whatever the order of summing."""
    series = spark.createDataFrame([(1, 2, 10, 1, 0.3), (1, 2, 11, 2, 0.1 + 0.2), (1, 2, 12, 3, 0.1)], "lo long, hi long, episode long, ts long, net double")
    full = series.selectExpr("*", "abs(net) AS gross", *(f"0L AS {n}" for n in ("faced", "yielded", "iso", "squeezed", "alone")))
    row = catalog.relations().frame(spark, OPERATORS["burst_concentration"], {"pair_series": full}).first()
    assert (row["at_max"], row["at_last_of_five"], row["longest_run"]) == (0.0, 1.0, 3)
