"""Feature rows of pair-episodes, members and ordered pairs (D5, D6, D8, D9, D24-D26, D45, D52, D61, D63), and the relations they share.

Every decision is looked at once: `steps` holds what was so before it, `decided` adds the policy's chances, `pair_steps` puts a pair beside
it and `aimed` a target. Features are conditional aggregates over these. Toward a target that has left nothing is counted, but for what is done in
answer to it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tandem.plans.ordered import OnSpark

ACTS = ("exit", "hold", "match", "push")
SIDES = (("lo", "hi"), ("hi", "lo"))


def cnt(cond: str, name: str) -> str:
    return f"count(CASE WHEN {cond} THEN 1 END) AS {name}"


def tot(expr: str, cond: str, name: str, digits: int = 6) -> str:
    return f"round(coalesce(sum(CASE WHEN {cond} THEN {expr} END), 0e0), {digits}) AS {name}"


def top(expr: str, cond: str, name: str, digits: int = 6) -> str:
    return f"round(max(CASE WHEN {cond} THEN {expr} END), {digits}) AS {name}"


def joined(parts) -> str:  # noqa: ANN001
    return ",\n  ".join(parts)


_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_STAGES = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

def _pair_steps(events: str) -> str:
    """All events of a pair's episode, with what both had done before."""
    return f"""
SELECT s.*, CASE WHEN exit_lo IS NULL OR exit_lo >= ordinal THEN 1 ELSE 0 END AS here_lo, CASE WHEN exit_hi IS NULL OR exit_hi >= ordinal THEN 1 ELSE 0 END AS here_hi,
  active - CASE WHEN exit_lo IS NULL OR exit_lo >= ordinal THEN 1 ELSE 0 END - CASE WHEN exit_hi IS NULL OR exit_hi >= ordinal THEN 1 ELSE 0 END AS outs,
  CASE WHEN member = lo THEN hi WHEN member = hi THEN lo END AS partner,
  min(CASE WHEN member = lo AND act = 'push' THEN ordinal END) OVER (PARTITION BY lo, hi, episode) AS push_lo, min(CASE WHEN member = hi AND act = 'push' THEN ordinal END) OVER (PARTITION BY lo, hi, episode) AS push_hi,
  coalesce(max(CASE WHEN member = lo AND act = 'push' THEN 1 ELSE 0 END) OVER (PARTITION BY lo, hi, episode, stage ORDER BY ordinal {_BEFORE}), 0) AS up_lo, coalesce(max(CASE WHEN member = hi AND act = 'push' THEN 1 ELSE 0 END) OVER (PARTITION BY lo, hi, episode, stage ORDER BY ordinal {_BEFORE}), 0) AS up_hi,
  coalesce(max(CASE WHEN member NOT IN (lo, hi) AND act = 'exit' THEN 1 ELSE 0 END) OVER (PARTITION BY lo, hi, episode, stage ORDER BY ordinal {_BEFORE}), 0) AS outsider_left
FROM (SELECT q.pool, q.lo, q.hi, q.exit_lo, q.exit_hi, q.s_lo, q.s_hi, q.players, q.stayed, v.* FROM {{pair_wide}} q JOIN {{{events}}} v ON v.episode = q.episode) s"""


def _aimed(events: str) -> str:
    """Each decision toward each other member that is still there (here), or pushed last (answered)."""
    return f"""
SELECT v.*, p.member AS target, p.strength AS target_strength, 5e-1 + (v.strength - p.strength) / 2e0 AS edge, CASE WHEN p.exit_ordinal IS NULL OR p.exit_ordinal >= v.ordinal THEN 1 ELSE 0 END AS here,
  CASE WHEN p.member = v.last_pusher THEN 1 ELSE 0 END AS answered,
  sum(CASE WHEN p.exit_ordinal IS NULL OR p.exit_ordinal >= v.ordinal THEN 1 ELSE 0 END) OVER (PARTITION BY v.episode, v.ordinal) AS others,
  max(CASE WHEN p.exit_ordinal IS NULL OR p.exit_ordinal >= v.ordinal THEN p.strength END) OVER (PARTITION BY v.episode, v.ordinal) AS best_other, sum(CASE WHEN (p.exit_ordinal IS NULL OR p.exit_ordinal >= v.ordinal) AND p.strength >= 5e-1 THEN 1 ELSE 0 END) OVER (PARTITION BY v.episode, v.ordinal) AS strong_others
FROM {{{events}}} v JOIN {{participants}} p ON p.episode = v.episode AND p.member <> v.member AND (p.exit_ordinal IS NULL OR p.exit_ordinal >= v.ordinal OR p.member = v.last_pusher)"""


#: On Spark read in two parts, so that the greater one shares the exchange of events with what is joined on episodes.
_POLICY = "SELECT stage, CAST(to_call > 0e0 AS INT) AS facing, " + ", ".join(f"(count(CASE WHEN act = '{a}' THEN 1 END) + 1) / CAST(count(*) + 4 AS DOUBLE) AS q_{a}" for a in ACTS) + " FROM {ev} GROUP BY stage, CAST(to_call > 0e0 AS INT)"

RELATIONS = {
    # each event with what was so before it: the last pusher of the stage, what its member and all have put in, who is left; and what comes next
    "steps": f"""
WITH f AS (SELECT v.*, row_number() OVER (PARTITION BY episode, member ORDER BY ordinal) AS own_no, count(CASE WHEN act = 'exit' THEN 1 END) OVER (PARTITION BY episode, member ORDER BY ordinal) AS own_exits FROM {{ev}} v)
SELECT f.*, last_value(CASE WHEN act = 'push' THEN member END) IGNORE NULLS OVER (PARTITION BY episode, stage ORDER BY ordinal {_BEFORE}) AS last_pusher,
  last_value(CASE WHEN act = 'push' THEN member END) IGNORE NULLS OVER (PARTITION BY episode ORDER BY ordinal {_BEFORE}) AS pusher_ever,
  first_value(CASE WHEN stage = 0 AND act = 'push' THEN member END) IGNORE NULLS OVER (PARTITION BY episode ORDER BY ordinal {_BEFORE}) AS opener,
  coalesce(sum(amount) OVER (PARTITION BY episode, member ORDER BY ordinal {_BEFORE}), 0e0) AS sunk, coalesce(sum(amount) OVER (PARTITION BY episode ORDER BY ordinal {_BEFORE}), 0e0) AS pot,
  coalesce(sum(amount) OVER (PARTITION BY episode, stage, member ORDER BY ordinal {_BEFORE}), 0e0) AS stage_sunk,
  sum(CASE WHEN own_no = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY episode) - coalesce(sum(CASE WHEN act = 'exit' AND own_exits = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY ordinal {_BEFORE}), 0) AS active,
  lead(member) OVER (PARTITION BY episode, stage ORDER BY ordinal) AS next_member, lead(act) OVER (PARTITION BY episode, stage ORDER BY ordinal) AS next_act,
  min(ordinal) OVER (PARTITION BY episode, stage) AS stage_start, count(CASE WHEN act = 'push' THEN 1 END) OVER (PARTITION BY episode, stage) AS stage_pushes,
  count(CASE WHEN act = 'push' THEN 1 END) OVER (PARTITION BY episode, stage ORDER BY ordinal {_BEFORE}) AS pushes_before,
  count(CASE WHEN act = 'push' THEN 1 END) OVER (PARTITION BY episode, stage, member ORDER BY ordinal {_BEFORE}) AS own_pushes_before,
  count(CASE WHEN act = 'push' THEN 1 END) OVER (PARTITION BY episode, member ORDER BY ordinal {_BEFORE}) AS own_pushes_ever, count(CASE WHEN act = 'match' THEN 1 END) OVER (PARTITION BY episode, member ORDER BY ordinal {_BEFORE}) AS own_matches_ever,
  count(CASE WHEN stage = 0 AND act = 'push' THEN 1 END) OVER (PARTITION BY episode, member ORDER BY ordinal {_BEFORE}) AS own_openings, count(*) OVER (PARTITION BY episode, stage, member ORDER BY ordinal {_BEFORE}) AS own_acts_before,
  max(CASE WHEN act = 'push' THEN ordinal END) OVER (PARTITION BY episode ORDER BY stage {_STAGES}) AS push_earlier_stage, max(CASE WHEN act = 'push' THEN ordinal END) OVER (PARTITION BY episode, member ORDER BY stage {_STAGES}) AS own_push_earlier_stage,
  max(CASE WHEN act = 'push' THEN stage END) OVER (PARTITION BY episode ORDER BY stage {_STAGES}) AS stage_of_push, max(stage) OVER (PARTITION BY episode ORDER BY stage {_STAGES}) AS stage_before,
  sum(CASE WHEN own_no = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY ordinal) AS members_seen
FROM f""",
    "pushed": "SELECT * FROM {steps}",
    "next_events": "SELECT * FROM {steps}",
    # K3 in its table form: smoothed shares of each class by stage and whether something is to be called; at most eight rows
    "policy": OnSpark(_POLICY, lambda frame: frame(_POLICY.replace("FROM {ev}", "FROM (SELECT * FROM {ev} WHERE episode IS NOT NULL UNION ALL SELECT * FROM {ev} WHERE episode IS NULL) v"))),
    "class_shares": " UNION ALL ".join(f"SELECT stage, facing, '{a}' AS act, q_{a} AS share FROM {{policy}}" for a in ACTS),
    "decided": """
SELECT /*+ BROADCAST(p) */ v.*, p.q_exit, p.q_hold, p.q_match, p.q_push, -ln(CASE v.act WHEN 'exit' THEN p.q_exit WHEN 'hold' THEN p.q_hold WHEN 'match' THEN p.q_match ELSE p.q_push END) AS sur
FROM {steps} v JOIN {policy} p ON p.stage = v.stage AND p.facing = CAST(v.to_call > 0e0 AS INT)""",
    # with the policy's chances, and without them for what needs none: then no count over all events goes before
    "pair_steps": _pair_steps("decided"),
    "pair_acts": _pair_steps("steps"),
    "aimed": _aimed("decided"),
    "aimed_acts": _aimed("steps"),
}

_PASSIVE, _IN = "act IN ('hold', 'match')", "member IN (lo, hi)"


def _pair_counts() -> str:
    """Counts and sums of a pair's episode, for lo and hi alike."""
    out = []
    for me, other in SIDES:
        own = f"member = {me}"
        out += [cnt(own, f"n_{me}"), *(cnt(f"{own} AND act = '{a}'", f"{a}_{me}") for a in ACTS)]
        out += [f"coalesce(sum(CASE WHEN {own} AND act = 'push' THEN amount END), 0e0) AS push_amount_{me}", f"coalesce(sum(CASE WHEN {own} THEN stage_sunk + amount END), 0e0) AS amount_to_{me}", f"coalesce(avg(CASE WHEN {own} THEN active END), 0e0) AS mean_active_{me}", f"avg(CASE WHEN {own} THEN pot END) AS mean_pot_{me}"]
        out += [f"min(push_{me}) AS push_at_{me}", f"min(exit_{me}) AS exit_at_{me}", cnt(f"member = {other} AND ordinal > push_{me}", f"response_{other}_after_{me}"), cnt(f"member NOT IN (lo, hi) AND act = 'exit' AND ordinal > push_{me}", f"outsider_exits_after_{me}")]
        out += [cnt(f"{own} AND act = 'push' AND next_member = {other} AND next_act = '{a}'", f"{other}_{a}_at_once_after_{me}") for a in ("exit", "match", "push")]
        out += [cnt(f"{own} AND act = 'push' AND next_member NOT IN (lo, hi) AND next_act = '{a}'", f"outsider_{a}_at_once_after_{me}") for a in ("exit", "push")]
        out += [cnt(f"{own} AND to_call > 0e0", f"facing_{me}"), *(cnt(f"{own} AND to_call > 0e0 AND act = '{a}'", f"{a}_facing_{me}") for a in ("exit", "match", "push"))]
        out += [cnt(f"{own} AND action = 'all_in' AND act = 'match'", f"all_in_match_{me}"), cnt(f"{own} AND action = 'all_in' AND act = 'push'", f"all_in_push_{me}")]
        out += [cnt(f"{own} AND act = 'push' AND stage = {s}", f"push_stage{s}_{me}") for s in range(4)]
    return f"SELECT lo, hi, episode, {joined(out)} FROM {{pair_acts}} GROUP BY lo, hi, episode"


RELATIONS["pair_counts"] = _pair_counts()
# pushes after which the last one who pushed, and somebody else who has matched that since and is still there, must answer: two ranges on the ordinal, equal episode and stage
RELATIONS["pushes_matched"] = f"""
WITH l AS (SELECT episode, stage, member, ordinal, act, max(CASE WHEN act = 'push' THEN ordinal END) OVER (PARTITION BY episode, stage ORDER BY ordinal {_BEFORE}) AS pushed_at, last_value(CASE WHEN act = 'push' THEN member END) IGNORE NULLS OVER (PARTITION BY episode, stage ORDER BY ordinal {_BEFORE}) AS pusher FROM {{ev}})
SELECT DISTINCT v.episode, v.ordinal FROM l v JOIN {{ev}} o ON o.episode = v.episode AND o.stage = v.stage AND o.act = 'match' AND o.ordinal > v.pushed_at AND o.ordinal < v.ordinal AND o.member <> v.member AND o.member <> v.pusher
JOIN {{participants}} p ON p.episode = o.episode AND p.member = o.member AND (p.exit_ordinal IS NULL OR p.exit_ordinal > v.ordinal) WHERE v.act = 'push' AND v.member <> v.pusher"""


def _feature_columns() -> list[str]:
    """D8 before its windows."""
    out = ["t.net_lo / t.unit AS net_units_lo", "t.net_hi / t.unit AS net_units_hi", "abs(t.net_lo - t.net_hi) / t.unit AS net_gap", "t.t_ab", "t.t_ba", "greatest(t.t_ab, t.t_ba) AS t_max", "t.t_ab + t.t_ba AS t_sum"]
    out += ["t.put_lo / t.unit AS put_units_lo", "t.put_hi / t.unit AS put_units_hi", "(t.put_lo + t.put_hi) / t.unit AS put_total", "abs(t.put_lo - t.put_hi) / t.unit AS put_gap", "(c.mean_pot_lo + c.mean_pot_hi) / 2e0 / t.unit AS mean_pot", "t.final_pot / t.unit AS final_pot_units"]
    out += ["t.players", "t.stayed", "CAST(t.exit_lo IS NULL AND t.exit_hi IS NULL AS INT) AS both_stayed", "CAST(c.response_hi_after_lo > 0 AND c.response_lo_after_hi > 0 AS INT) AS mutual_pushes"]
    for me, other in SIDES:
        out += [f"CAST(t.exit_{me} IS NOT NULL AS INT) AS exited_{me}", f"CAST(t.exit_{me} IS NULL AS INT) AS stayed_{me}", f"c.n_{me}", *(f"c.{a}_{me}" for a in ACTS), *(f"c.{a}_{me} / CAST(c.n_{me} AS DOUBLE) AS {a}_rate_{me}" for a in ACTS)]
        out += [f"c.push_amount_{me} / t.unit AS push_units_{me}", f"c.amount_to_{me} / t.unit AS amount_to_units_{me}", f"c.mean_active_{me}"]
        out += [f"c.{a}_{me} / CAST(c.n_{me} AS DOUBLE) - coalesce(b{me}.{a}_rate, 0e0) AS {a}_delta_{me}" for a in ("push", "exit", "match")]
        out += [f"c.response_{me}_after_{other}", f"c.outsider_exits_after_{me}", f"CAST(coalesce(c.push_at_{other} < c.exit_at_{me}, FALSE) AS INT) AS {me}_exit_after_push", f"coalesce(c.push_at_{me}, 0) AS first_push_{me}"]
        out += [f"c.{other}_{a}_at_once_after_{me}" for a in ("exit", "match", "push")] + [f"c.outsider_{a}_at_once_after_{me}" for a in ("exit", "push")]
        out += [f"c.facing_{me}", *(f"c.{a}_facing_{me}" for a in ("exit", "match", "push")), f"c.all_in_match_{me}", f"c.all_in_push_{me}", *(f"c.push_stage{s}_{me}" for s in range(4))]
    return out


_FEATURES = f"""
SELECT t.pool, t.lo, t.hi, t.episode, t.ts, t.win, {joined(_feature_columns())}
FROM {{transfers}} t JOIN {{pair_counts}} c ON c.lo = t.lo AND c.hi = t.hi AND c.episode = t.episode
LEFT JOIN {{background}} blo ON blo.member = t.lo AND blo.win = t.win LEFT JOIN {{background}} bhi ON bhi.member = t.hi AND bhi.win = t.win WHERE t.unit > 0e0"""
#: What a member does elsewhere in the window, at each of its episodes. On Spark these narrow rows go to the episodes; a pair's wide ones stay there.
RELATIONS["member_rates"] = "SELECT p.episode, p.member, e.win, b.push_rate, b.exit_rate, b.match_rate FROM {participants} p JOIN (SELECT episode, win FROM {episodes} GROUP BY episode, win) e ON e.episode = p.episode JOIN {background} b ON b.member = p.member AND b.win = e.win"
_RATED = ("push", "exit", "match")
_FEATURES_WHERE_THEY_LIE = f"""
SELECT t.pool, t.lo, t.hi, t.episode, t.ts, t.win, {re.sub(r"b(lo|hi)[.]", r"t.b\1_", joined(_feature_columns()))}
FROM (SELECT t.*, {", ".join(f"b{me}.{r}_rate AS b{me}_{r}_rate" for me, _ in SIDES for r in _RATED)} FROM {{transfers}} t {" ".join(f"LEFT JOIN {{member_rates}} b{me} ON b{me}.episode = t.episode AND b{me}.member = t.{me} AND b{me}.win = t.win" for me, _ in SIDES)} WHERE t.unit > 0e0) t
JOIN {{pair_counts}} c ON c.lo = t.lo AND c.hi = t.hi AND c.episode = t.episode"""
RELATIONS["pair_features0"] = OnSpark(_FEATURES, lambda frame: frame(_FEATURES_WHERE_THEY_LIE))
RELATIONS["pair_features1"] = """
SELECT f.*, t_max + 5e-1 * abs(push_delta_lo - push_delta_hi) + 25e-2 * (outsider_exits_after_lo + outsider_exits_after_hi) + 25e-2 * (lo_exit_after_push + hi_exit_after_push) AS risk_proxy FROM {pair_features0} f"""

_P, _T = "PARTITION BY lo, hi", "PARTITION BY lo, hi ORDER BY ts, episode"
_NAMES = [c.rsplit(" AS ", 1)[-1].rsplit(".", 1)[-1] for c in _feature_columns()]
_REAL = [n for n in _NAMES if "units" in n or "rate" in n or "delta" in n or n.startswith(("t_", "net_gap", "put_", "mean_", "final_pot"))]


def _ranks() -> list[str]:
    order = {"risk": "round(risk_proxy, 6)", "transfer": "round(t_max, 6)", "response": "response_lo_after_hi + response_hi_after_lo", "outsider": "outsider_exits_after_lo + outsider_exits_after_hi", "stayed": "both_stayed"}
    return [f"round(percent_rank() OVER ({_P} ORDER BY {by}, episode), 6) AS {n}_rank" for n, by in order.items()]


def _frames() -> list[str]:
    near = lambda n: f"({_T} ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)"
    return [
        f"round(coalesce(avg(risk_proxy) OVER ({_T} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), risk_proxy), 6) AS risk_before5",
        f"round(coalesce(avg(risk_proxy) OVER ({_T} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), risk_proxy), 6) AS risk_after5",
        f"round(avg(risk_proxy) OVER {near(10)}, 6) AS risk_near10",
        f"round(avg(risk_proxy) OVER {near(25)}, 6) AS risk_near25",
        f"round(max(risk_proxy) OVER {near(10)}, 6) AS risk_peak10",
    ]


def _episode_features(copies: bool) -> str:
    """pair_episode_features on Spark: only what is ranked and averaged goes to the pairs, and ranks and means come back to the episodes, where the wide rows stay.

    copies: whether the tables have an episode more than once, so that its rows must be told apart.
    """
    copy = "CAST(row_number() OVER (PARTITION BY episode, lo, hi ORDER BY ts, final_pot_units) AS INT) AS copy" if copies else "1 AS copy"
    ranks = {r.rsplit(" AS ", 1)[1]: r.removeprefix("round(percent_rank()").rsplit(", 6)", 1)[0] for r in _ranks()}
    frames = [f.rsplit(" AS ", 1)[1] for f in _frames()]
    needs = "risk_proxy, t_max, response_lo_after_hi, response_hi_after_lo, outsider_exits_after_lo, outsider_exits_after_hi, both_stayed"
    shown = [f"round(f.{n}, 6) AS {n}" if n in _REAL else f"f.{n}" for n in _NAMES] + ["round(f.risk_proxy, 6) AS risk_proxy"]
    # a rank and the number of rows are small numbers, which take less room than their quotient
    shown += [f"round(CASE WHEN r.n_pair > 1 THEN r.{n} / CAST(r.n_pair - 1 AS DOUBLE) ELSE 0e0 END, 6) AS {n}" for n in ranks] + [f"r.{n}" for n in frames]
    return f"""
SELECT f.lo, f.hi, f.episode, {joined(shown)} FROM (SELECT *, {copy} FROM {{pair_features1}} g) f
JOIN (SELECT lo, hi, episode, copy, count(*) OVER ({_P}) AS n_pair, {joined([*(f"rank(){over} - 1 AS {n}" for n, over in ranks.items()), *_frames()])} FROM (SELECT lo, hi, episode, ts, {copy}, {needs} FROM {{pair_features1}} g) h) r
  ON r.episode = f.episode AND r.lo = f.lo AND r.hi = f.hi{" AND r.copy = f.copy" if copies else ""}"""


def _pick(columns: list[str]) -> str:
    return f"SELECT lo, hi, episode, {', '.join(columns)} FROM {{pair_counts}}"


_PROFILED = ("t_max", "net_gap", "put_total", "push_delta_lo", "push_delta_hi", "outsider_exits_after_lo", "response_hi_after_lo", "both_stayed", "risk_proxy")


def profile_columns(columns: tuple[str, ...], digits: int = 6) -> list[str]:
    """Mean, standard deviation (0 for one row), maximum and 90 % quantile of each column.

    Means of rates are often half-way between two rounded values; the small step up makes every order of summing round them alike.
    """
    forms = (("mean", "avg({c})"), ("sd", "coalesce(stddev_samp({c}), 0e0)"), ("max", "max({c})"), ("q90", "percentile({c}, 9e-1)"))
    return [f"round({form.format(c=c)} + 1e-11, {digits}) AS {c}_{name}" for c in columns for name, form in forms]


_ANSWER, _HERE = "answered = 1", "here = 1"


def _surprisal_columns() -> list[str]:
    passive = f"{_HERE} AND others = 1 AND {_PASSIVE}"
    return [
        tot("sur", _HERE, "sur_sum"), top("sur", _HERE, "sur_max"), cnt(f"{_HERE} AND sur > 3e0", "n_sur3"), cnt(f"{_HERE} AND sur > 5e0", "n_sur5"),
        tot("sur", f"{_ANSWER} AND act = 'exit'", "sur_exit_to"), top("sur", f"{_ANSWER} AND act = 'exit'", "sur_exit_to_max"), tot("sur", passive, "sur_passive_alone"), top("sur", passive, "sur_passive_alone_max"),
        tot("sur", f"{_HERE} AND act = 'push'", "sur_push"), top("sur", f"{_HERE} AND act = 'push'", "sur_push_max"),
        cnt(f"{_ANSWER} AND act = 'exit' AND strength >= 75e-2", "exit_when_strong"), cnt(f"{_ANSWER} AND act = 'exit' AND edge >= 9e-1", "exit_when_ahead"),
        cnt(f"{_HERE} AND others = 1 AND act = 'hold' AND strength >= 8e-1", "hold_when_strong"), cnt(f"{_HERE} AND others = 1 AND act = 'hold' AND edge >= 9e-1", "hold_when_ahead"), cnt(f"{_HERE} AND act = 'push' AND strength < 35e-2", "push_when_weak"),
        tot("CASE WHEN act = 'exit' THEN 1e0 ELSE 0e0 END - q_exit", _ANSWER, "excess_exit_to"), tot("CASE WHEN act = 'push' THEN 1e0 ELSE 0e0 END - q_push", _HERE, "excess_push"),
        tot(f"CASE WHEN {_PASSIVE} THEN 1e0 ELSE 0e0 END - q_hold - q_match", f"{_HERE} AND others = 1", "excess_passive_alone"), cnt(_HERE, "n_decisions"), cnt(_ANSWER, "n_answers"),
        cnt(f"{_ANSWER} AND {_PASSIVE} AND edge <= 1e-1", "match_when_dead"), tot("1e0 - q_match", f"{_ANSWER} AND {_PASSIVE}", "excess_match_to"), tot("sur", f"{_ANSWER} AND {_PASSIVE}", "sur_match_to"),
        cnt(f"{_ANSWER} AND act = 'exit' AND strength >= 75e-2 AND pot / nullif(e.unit, 0e0) >= 10", "big_exit_when_strong"),
    ]


def _suppressed_columns() -> list[str]:
    out = []
    for cond, expr, name in (
        (f"{_HERE} AND {_PASSIVE}", "q_push", "push_not_made"), (f"{_HERE} AND others = 1 AND {_PASSIVE}", "q_push", "push_not_made_alone"), (f"{_ANSWER} AND act = 'exit'", "1e0 - q_exit", "forced_exit_to"),
        (f"{_HERE} AND others >= 2 AND act = 'push'", "1e0 - q_push", "forced_push_many"), (f"{_ANSWER} AND {_PASSIVE}", "1e0 - q_match", "forced_match_to"),
    ):
        out += [tot(expr, cond, name), top(expr, cond, f"{name}_max")]
    opened = f"{_HERE} AND stage = 0 AND opener = target AND {_PASSIVE}"
    return [
        *out, tot("q_push", f"{_HERE} AND others = 1 AND {_PASSIVE} AND edge >= 8e-1", "push_not_made_ahead"), tot("1e0 - q_exit", f"{_ANSWER} AND act = 'exit' AND edge >= 5e-1", "forced_exit_ahead"),
        tot("1e0 - q_push", f"{_HERE} AND others >= 2 AND act = 'push' AND strength < 45e-2", "forced_push_weak"), cnt(f"{_HERE} AND {_PASSIVE}", "n_passive"), cnt(f"{_ANSWER} AND act = 'exit'", "n_exit_to"),
        cnt(f"{_HERE} AND others >= 2 AND act = 'push'", "n_push_many"), cnt(f"{_ANSWER} AND {_PASSIVE}", "n_match_to"), tot("sur", _HERE, "sur_sum"), top("sur", _HERE, "sur_max"), top("sur", f"{_ANSWER} AND act = 'exit'", "sur_exit_to_max"),
        top("sur", f"{_HERE} AND others >= 2 AND act = 'push'", "sur_push_many_max"), top("sur", f"{_HERE} AND others = 1 AND {_PASSIVE}", "sur_passive_alone_max"), tot("q_push", opened, "push_not_made_after_opening"), cnt(opened, "n_after_opening"),
    ]


_MEMBER_SURPRISAL = [tot("sur", "TRUE", "own_sur_sum"), top("sur", "TRUE", "own_sur_max"), cnt("sur > 3e0", "own_sur3"), cnt("sur > 5e0", "own_sur5"), cnt("TRUE", "own_decisions"), tot("CASE WHEN act = 'exit' THEN 1e0 ELSE 0e0 END - q_exit", "to_call > 0e0", "own_excess_exit"), tot("CASE WHEN act = 'push' THEN 1e0 ELSE 0e0 END - q_push", "TRUE", "own_excess_push")]
_MEMBER_FORCED = [tot("sur", "TRUE", "own_sur_sum"), top("sur", "TRUE", "own_sur_max"), cnt("TRUE", "own_decisions"), tot("q_push", _PASSIVE, "own_push_not_made"), tot("1e0 - q_exit", "act = 'exit'", "own_forced_exit"), tot("1e0 - q_push", "act = 'push'", "own_forced_push")]


def _aimed_query(columns: list[str], own: list[str]) -> str:
    names = ", ".join(f"m.{c.rsplit(' AS ', 1)[-1]}" for c in own)
    return f"""
SELECT a.*, {names} FROM (SELECT v.episode, v.member AS actor, v.target, {joined(columns)} FROM {{aimed}} v JOIN {{episodes}} e ON e.episode = v.episode GROUP BY v.episode, v.member, v.target) a
JOIN (SELECT episode, member, {joined(own)} FROM {{decided}} GROUP BY episode, member) m ON m.episode = a.episode AND m.member = a.actor"""


# The series of a pair over time; iso: outsiders' exits after both pushed in the stage, squeeze: pushes over the partner while others are there
_FACED = "last_pusher = partner"
RELATIONS["pair_series"] = f"""
SELECT t.lo, t.hi, t.episode, t.ts, greatest(-t.net_lo, 0e0) * greatest(t.net_hi, 0e0) / nullif(t.won, 0e0) / t.unit - greatest(-t.net_hi, 0e0) * greatest(t.net_lo, 0e0) / nullif(t.won, 0e0) / t.unit AS net,
  greatest(-t.net_lo, 0e0) * greatest(t.net_hi, 0e0) / nullif(t.won, 0e0) / t.unit + greatest(-t.net_hi, 0e0) * greatest(t.net_lo, 0e0) / nullif(t.won, 0e0) / t.unit AS gross, k.faced, k.yielded, k.iso, k.squeezed, k.alone
FROM {{transfers}} t JOIN (SELECT lo, hi, episode, {cnt(_FACED, "faced")}, {cnt(f"act = 'exit' AND {_FACED}", "yielded")},
  {cnt("act = 'exit' AND partner IS NULL AND ((last_pusher = lo AND up_hi = 1) OR (last_pusher = hi AND up_lo = 1))", "iso")}, {cnt(f"act = 'push' AND {_FACED} AND outs > 0", "squeezed")},
  {cnt("ordinal = stage_start AND active = 2 AND here_lo = 1 AND here_hi = 1", "alone")} FROM {{pair_steps}} GROUP BY lo, hi, episode) k ON k.lo = t.lo AND k.hi = t.hi AND k.episode = t.episode WHERE t.unit > 0e0"""

#: Nets are sums, equal only up to the order of summing: they are rounded before they are ordered, so that equal ones are taken by time.
_BURST = f"""
WITH s AS (SELECT p.*, coalesce(abs(net), 0e0) AS x, row_number() OVER ({_P} ORDER BY coalesce(abs(net), 0e0) DESC, ts, episode) AS r, row_number() OVER ({_T}) AS i, count(*) OVER ({_P}) AS n, CAST(sign(coalesce(net, 0e0)) AS INT) AS direction
  FROM (SELECT lo, hi, episode, ts, round(net, 9) AS net, gross, yielded, iso, squeezed, alone, faced FROM {{pair_series}}) p),
u AS (SELECT s.*, CAST(least(floor((i - 1) * 8 / CAST(n AS DOUBLE)), 7e0) AS INT) AS bin, sum(x) OVER ({_T} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS roll10, sum(x) OVER ({_T} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS roll20,
  sum(iso) OVER ({_T} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS iso10, sum(iso) OVER ({_T} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS iso20,
  CASE WHEN direction = lag(direction) OVER ({_T}) THEN 0 ELSE 1 END AS turn FROM s),
q AS (SELECT lo, hi, percentile(x, 9e-1) AS q90, median(x) AS mid, sum(x) AS total FROM s GROUP BY lo, hi),
w AS (SELECT u.*, q.q90, q.mid, q.total, sum(x) OVER (PARTITION BY u.lo, u.hi, bin) AS in_bin, sum(turn) OVER (PARTITION BY u.lo, u.hi ORDER BY ts, episode) AS run FROM u JOIN q ON q.lo = u.lo AND q.hi = u.hi),
y AS (SELECT w.*, CASE WHEN direction <> 0 THEN count(*) OVER (PARTITION BY lo, hi, run) ELSE 0 END AS run_length FROM w)
SELECT lo, hi, round(sum(x), 5) AS abs_net, round(coalesce(sum(gross), 0e0), 5) AS gross, CAST(sum(yielded) AS BIGINT) AS yielded, CAST(sum(iso) AS BIGINT) AS iso, CAST(sum(squeezed) AS BIGINT) AS squeezed, CAST(sum(alone) AS BIGINT) AS alone, CAST(sum(faced) AS BIGINT) AS faced,
  {joined(f"round(sum(CASE WHEN r <= {k} THEN x ELSE 0e0 END) / (max(total) + 1e-9), 6) AS top{k}_share" for k in (1, 3, 5))}, round(sum(x * x) / ((max(total) + 1e-9) * (max(total) + 1e-9)), 6) AS hhi,
  round(max(roll10), 5) AS roll10, round(max(roll20), 5) AS roll20, CAST(max(iso10) AS BIGINT) AS iso_roll10, CAST(max(iso20) AS BIGINT) AS iso_roll20, round(max(in_bin), 5) AS bin_max, round(max(in_bin) / (max(total) + 1e-9), 6) AS burst_ratio,
  count(DISTINCT CASE WHEN in_bin > total / 4e0 + 1e-9 THEN bin END) AS hot_bins, {joined(cnt(f"x > {k}e0", f"n_over{k}") for k in (1, 2, 5))}, round(count(CASE WHEN x > 2e0 THEN 1 END) / CAST(max(n) AS DOUBLE), 6) AS share_over2,
  round(sum(x) / max(n), 6) AS abs_net_rate, round(sum(iso) / CAST(max(n) AS DOUBLE), 6) AS iso_rate, round(max(CASE WHEN r = 1 THEN i - 1 END) / CAST(greatest(max(n) - 1, 1) AS DOUBLE), 6) AS at_max,
  round(coalesce(min(CASE WHEN x > q90 + 1e-9 THEN i - 1 END) / CAST(greatest(max(n) - 1, 1) AS DOUBLE), 1e0), 6) AS at_first_q90, round(max(CASE WHEN r <= 5 THEN i - 1 END) / CAST(greatest(max(n) - 1, 1) AS DOUBLE), 6) AS at_last_of_five, round(max(x) / (max(mid) + 1e-6), 4) AS max_over_median,
  round(coalesce(sum(net), 0e0) / (max(total) + 1e-9), 6) AS direction_share, max(run_length) AS longest_run, round(count(CASE WHEN direction = 1 THEN 1 END) / CAST(max(n) AS DOUBLE), 6) AS share_toward_hi,
  round(coalesce(count(CASE WHEN iso > 0 AND direction = 1 THEN 1 END) / nullif(CAST(count(CASE WHEN iso > 0 THEN 1 END) AS DOUBLE), 0e0), 0e0), 6) AS iso_purity, CAST(coalesce(sum(CASE WHEN direction = 1 THEN iso END), 0) AS BIGINT) AS iso_gain,
  round(coalesce(sum(CASE WHEN direction = 1 THEN yielded END), 0) / (sum(yielded) + 1e-9), 6) AS yielded_gain_share, max(n) AS n, max(episode) - min(episode) AS span
FROM y GROUP BY lo, hi"""

# The same decision's values, for several kinds of event
MOMENTS = {
    "strength": "strength", "edge": "edge", "pot_odds": "to_call / nullif(to_call + pot, 0e0)", "size": "amount / nullif(greatest(unit, pot), 0e0)", "price": "to_call / unit", "put": "sunk / unit", "stage_put": "stage_sunk / unit", "pot": "pot / unit",
    "active": "CAST(active AS DOUBLE)", "outsiders": "CAST(outs AS DOUBLE)", "surprisal": "sur", "q_exit": "q_exit", "q_hold": "q_hold", "q_match": "q_match", "q_push": "q_push", "exit_residual": "CASE WHEN act = 'exit' THEN 1e0 ELSE 0e0 END - q_exit", "match_residual": "CASE WHEN act = 'match' THEN 1e0 ELSE 0e0 END - q_match",
    "push_residual": "CASE WHEN act = 'push' THEN 1e0 ELSE 0e0 END - q_push", "push_weakness": "CASE WHEN act = 'push' THEN (1e0 - strength) * amount / unit ELSE 0e0 END", "exit_value": "CASE WHEN act = 'exit' THEN strength * to_call / unit ELSE 0e0 END", "partner_strength": "partner_strength", "gap": "strength - partner_strength",
    "strength_surprisal": "strength * sur", "partner_strength_surprisal": "partner_strength * sur",
}
MORE_VALUES = {"log_price": "ln(1e0 + to_call / unit)", "log_size": "ln(1e0 + amount / unit)", "outsider_exits": "CAST(outsider_left AS DOUBLE)"}
EVENTS = {
    "exit_to_partner": "partner IS NOT NULL AND last_pusher = partner AND act = 'exit'", "match_partner": "partner IS NOT NULL AND last_pusher = partner AND act = 'match'", "hold_alone": f"partner IS NOT NULL AND act = 'hold' AND active = 2 AND here_lo = 1 AND here_hi = 1",
    "push_with_outsiders": "partner IS NOT NULL AND act = 'push' AND outs > 0", "outsider_exit_after_both": "partner IS NULL AND act = 'exit' AND up_lo = 1 AND up_hi = 1", "answer_after_outsider_exit": "partner IS NOT NULL AND last_pusher = partner AND act IN ('exit', 'match') AND outsider_left = 1",
}
WITNESSED = {
    "facing_partner": "partner IS NOT NULL AND last_pusher = partner", "facing_outsider": "last_pusher IS NOT NULL AND last_pusher <> member AND (partner IS NULL OR last_pusher <> partner)", "alone_with_partner": "partner IS NOT NULL AND active = 2 AND here_lo = 1 AND here_hi = 1",
    "push_with_outsiders": EVENTS["push_with_outsiders"], "outsider_exit_after_both": EVENTS["outsider_exit_after_both"], "answer_after_outsider_exit": "partner IS NOT NULL AND last_pusher = partner AND outsider_left = 1",
}
RELATIONS["valued_steps"] = """
SELECT s.*, e.unit, 5e-1 + (s.strength - CASE WHEN s.member = s.lo THEN s.s_hi WHEN s.member = s.hi THEN s.s_lo ELSE greatest(s.s_lo, s.s_hi) END) / 2e0 AS edge, CASE WHEN s.member = s.lo THEN s.s_hi WHEN s.member = s.hi THEN s.s_lo ELSE greatest(s.s_lo, s.s_hi) END AS partner_strength
FROM {pair_steps} s JOIN {episodes} e ON e.episode = s.episode AND e.unit > 0e0"""


def _kinds(events: dict[str, str]) -> str:
    """Steps with the kinds of event that each is, one row for each kind."""
    marks = " UNION ALL ".join(f"SELECT '{k}' AS kind" for k in events)
    which = " ".join(f"WHEN '{k}' THEN {c}" for k, c in events.items())
    return f"(SELECT k.kind, s.* FROM {{valued_steps}} s CROSS JOIN ({marks}) k WHERE CASE k.kind {which} END)"


def _moments() -> str:
    """One row for each kind of event that occurs: mean and maximum over a pair's events, averaged and maximised over the two orientations.

    An orientation's events are those of its first member and, where outsiders act, all; the kinds are symmetric, so means over the orientations are means of both members' means.
    """
    side = lambda me: f"member = {me} OR partner IS NULL"
    out = []
    for name, value in MOMENTS.items():
        lo, hi = (f"avg(CASE WHEN {side(m)} THEN {value} END)" for m in ("lo", "hi"))
        most_lo, most_hi = (f"max(CASE WHEN {side(m)} THEN {value} END)" for m in ("lo", "hi"))
        out += [f"round((coalesce({lo}, 0e0) + coalesce({hi}, 0e0)) / 2e0, 6) AS {name}_mean", f"round(greatest(coalesce({lo}, 0e0), coalesce({hi}, 0e0)), 6) AS {name}_mean_max", f"round((coalesce({most_lo}, 0e0) + coalesce({most_hi}, 0e0)) / 2e0, 6) AS {name}_max", f"round(greatest(coalesce({most_lo}, 0e0), coalesce({most_hi}, 0e0)), 6) AS {name}_max_max"]
    return f"SELECT lo, hi, episode, kind, count(*) AS n, {joined(out)} FROM {_kinds(EVENTS)} t GROUP BY lo, hi, episode, kind"


def _witness() -> str:
    """Long form, one row for each role, stage and kind that occurs, so a kind that doesn't is told from values of 0."""
    values = MOMENTS | MORE_VALUES
    out = [x for n, v in values.items() for x in (f"round(avg({v}), 6) AS {n}_mean", f"round(max({v}), 6) AS {n}_max", f"round(min({v}), 6) AS {n}_min")]
    role = "CASE WHEN member = lo THEN 'A' WHEN member = hi THEN 'B' ELSE 'O' END"
    return f"SELECT lo, hi, episode, {role} AS role, stage, kind, round(ln(1e0 + count(*)), 6) AS log_n, {joined(out)} FROM {_kinds(WITNESSED)} t GROUP BY lo, hi, episode, {role}, stage, kind"


OPERATORS = {
    # The next event of the stage after a push, by whom, for either member's push
    "immediate_response": _pick([f"{x}_at_once_after_{me}" for me, other in SIDES for x in (f"{other}_exit", f"{other}_match", f"{other}_push", "outsider_exit", "outsider_push")]),
    # What either does where something is to be called
    "facing_cost": _pick([f"{x}_{me}" for me, _ in SIDES for x in ("facing", "exit_facing", "match_facing", "push_facing", "all_in_match", "all_in_push")]),
    # The pair-episode row
    "pair_episode_features": f"SELECT lo, hi, episode, {', '.join(f'round({n}, 6) AS {n}' if n in _REAL else n for n in _NAMES)}, round(risk_proxy, 6) AS risk_proxy, {joined([*_ranks(), *_frames()])} FROM {{pair_features1}}",
    # The member's row of an episode
    "member_episode_features": f"""
SELECT v.episode, v.member, max(CASE WHEN stage = 0 AND act IN ('match', 'push') THEN 1 ELSE 0 END) AS entered, max(CASE WHEN stage = 0 AND act = 'push' THEN 1 ELSE 0 END) AS pushed_first_stage, {joined(cnt(f"act = '{a}'", f"n_{a}") for a in ("push", "match", "hold"))},
  max(CASE WHEN act = 'exit' THEN 1 ELSE 0 END) AS exited, min(CASE WHEN act = 'exit' THEN stage END) AS exit_stage, round(sum(amount) / nullif(max(e.unit), 0e0), 6) AS contribution_units, round(sum(net_part) / nullif(max(e.unit), 0e0), 6) AS net_units,
  min(CASE WHEN act = 'exit' THEN 0 ELSE 1 END) AS stayed, CAST(sum(net_part) > 0e0 AS INT) AS won, round(max(m.balance) / nullif(max(e.unit), 0e0), 6) AS stack_units, round(avg(strength), 6) AS mean_strength, count(*) AS n_decisions, max(stage) AS last_stage,
  min_by(strength, ordinal) AS first_strength, max_by(strength, ordinal) AS last_strength, CAST(min(ordinal) = 0 AS INT) AS acts_first, CAST(min(members_seen) = 2 AS INT) AS acts_second, CAST(min(members_seen) - 1 AS BIGINT) AS position
FROM {{steps}} v JOIN {{episodes}} e ON e.episode = v.episode LEFT JOIN {{members}} m ON m.member = v.member GROUP BY v.episode, v.member""",
    # D24 and D25, each with the actor's own totals
    "surprisal_interactions": _aimed_query(_surprisal_columns(), _MEMBER_SURPRISAL),
    "suppressed_forced": _aimed_query(_suppressed_columns(), _MEMBER_FORCED),
    # The members outside the pair, and what passes between them and the pair
    "outsider_context": f"""
WITH s AS (SELECT lo, hi, episode, {cnt("partner IS NULL AND stage = 0 AND act IN ('match', 'push')", "entries")}, {cnt("partner IS NULL AND act = 'push'", "pushes")}, {cnt("partner IS NULL AND act = 'exit' AND last_pusher IN (lo, hi)", "exits_toward_pair")},
  {tot("sur", "partner IS NULL", "surprisal")}, {top("sur", "partner IS NULL", "surprisal_max")}, round(coalesce(sum(CASE WHEN partner IS NOT NULL THEN sur END), 0e0) / sum(sur), 6) AS pair_share FROM {{pair_steps}} GROUP BY lo, hi, episode)
SELECT t.lo, t.hi, t.episode, t.players - 2 AS outsiders, round(t.final_pot - t.put_lo - t.put_hi, 3) AS contribution, t.players - t.stayed - CASE WHEN t.exit_lo IS NULL THEN 0 ELSE 1 END - CASE WHEN t.exit_hi IS NULL THEN 0 ELSE 1 END AS exits,
  s.entries, s.pushes, s.exits_toward_pair, round(o.net, 5) AS net, round(coalesce(o.lost * (greatest(t.net_lo, 0e0) + greatest(t.net_hi, 0e0)) / nullif(t.won, 0e0) / nullif(t.unit, 0e0), 0e0), 5) AS flow_to_pair,
  round(coalesce(o.won * (greatest(-t.net_lo, 0e0) + greatest(-t.net_hi, 0e0)) / nullif(t.won, 0e0) / nullif(t.unit, 0e0), 0e0), 5) AS flow_from_pair, s.surprisal, s.surprisal_max, s.pair_share
FROM {{transfers}} t JOIN s ON s.lo = t.lo AND s.hi = t.hi AND s.episode = t.episode
JOIN (SELECT q.lo, q.hi, q.episode, coalesce(sum(p.net), 0e0) AS net, coalesce(sum(greatest(-p.net, 0e0)), 0e0) AS lost, coalesce(sum(greatest(p.net, 0e0)), 0e0) AS won FROM {{pair_episodes}} q LEFT JOIN {{participants}} p ON p.episode = q.episode AND p.member NOT IN (q.lo, q.hi) GROUP BY q.lo, q.hi, q.episode) o
  ON o.lo = t.lo AND o.hi = t.hi AND o.episode = t.episode""",
    # D31 over the pair-episode row
    "pair_profile": f"SELECT lo, hi, count(*) AS n, {joined(profile_columns(_PROFILED))} FROM {{pair_features1}} GROUP BY lo, hi",
    # D32
    "pair_derived": """
SELECT lo, hi, round(ln(1e0 + count(*)), 6) AS log_exposure, round((max(risk_proxy) + percentile(risk_proxy, 9e-1)) / 2e0, 6) AS tail_score, round(avg(t_ab) - avg(t_ba), 6) AS directional_imbalance, round(abs(avg(t_ab) - avg(t_ba)), 6) AS imbalance,
  round(avg(push_delta_lo) - avg(push_delta_hi), 6) AS push_direction, round(abs(avg(push_delta_lo) - avg(push_delta_hi)), 6) AS push_gap, round(avg(outsider_exits_after_lo) + avg(outsider_exits_after_hi), 6) AS outsider_pressure,
  round(avg(lo_exit_after_push) + avg(hi_exit_after_push), 6) AS partner_exits, round(avg(response_hi_after_lo) + avg(response_lo_after_hi), 6) AS mutual_response, round(avg(both_stayed) / count(*), 8) AS joint_stay_rate
FROM {pair_features1} GROUP BY lo, hi""",
    "burst_concentration": _BURST,
    "event_moments": _moments(),
    # With two or more others left, what the actor does by the target's strength, and where another opponent is strong
    "multiway_partner_strength": f"""
SELECT episode, member AS actor, target, count(*) AS decisions, {cnt("act = 'exit'", "exits")}, {cnt("act = 'push'", "pushes")}, {cnt("target_strength >= 5e-1 AND act = 'exit'", "exits_strong")}, {cnt("target_strength >= 5e-1 AND act = 'push'", "pushes_strong")},
  {cnt("target_strength < 15e-2 AND act = 'exit'", "exits_weak")}, {cnt("target_strength < 15e-2 AND act = 'push'", "pushes_weak")}, {cnt("strong_others - CASE WHEN target_strength >= 5e-1 THEN 1 ELSE 0 END > 0 AND act = 'exit'", "exits_other_strong")},
  {cnt("strong_others - CASE WHEN target_strength >= 5e-1 THEN 1 ELSE 0 END > 0 AND act = 'push'", "pushes_other_strong")}, {tot("CASE WHEN act = 'exit' THEN 1e0 ELSE 0e0 END - q_exit", "target_strength >= 5e-1", "excess_exit_strong")}, {tot("CASE WHEN act = 'push' THEN 1e0 ELSE 0e0 END - q_push", "target_strength >= 5e-1", "excess_push_strong")},
  {tot("CASE WHEN act = 'push' THEN 1e0 ELSE 0e0 END - q_push", "target_strength < 15e-2", "excess_push_weak")}, round(avg(CASE WHEN act = 'exit' THEN target_strength END), 6) AS strength_at_exit, round(avg(CASE WHEN act = 'push' THEN target_strength END), 6) AS strength_at_push, {cnt("answered = 1 AND act = 'push'", "pushes_over")}, {cnt("answered = 1 AND act = 'push' AND matched = 1", "pushes_over_matched")}
FROM (SELECT a.*, CASE WHEN m.ordinal IS NULL THEN 0 ELSE 1 END AS matched FROM {{aimed}} a LEFT JOIN {{pushes_matched}} m ON m.episode = a.episode AND m.ordinal = a.ordinal) t WHERE here = 1 AND others >= 2 GROUP BY episode, member, target""",
    "role_stage_witness": _witness(),
}


def _pair_episode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem import catalog

    tables, frame = catalog.Tables(spark, sf_dir), catalog.relations().frame
    copies = not frame(spark, "SELECT episode FROM {episodes} GROUP BY episode HAVING count(*) > 1", tables).isEmpty()
    return frame(spark, _episode_features(copies), tables)


QUERIES = {"pair_episode_features": _pair_episode_features}
