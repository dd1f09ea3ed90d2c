"""Decisions in context, roles within a pair, and descriptors of a pair's episode."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tandem.operators.features import _PASSIVE, cnt, joined, top, tot
from tandem.plans.ordered import OnSpark

_P, _T = "PARTITION BY lo, hi", "PARTITION BY lo, hi ORDER BY ts, episode"


def swap(first: str, a: str, b: str, name: str, digits: int | None = 6) -> str:
    """a where the condition holds, else b."""
    found = f"CASE WHEN {first} THEN {a} ELSE {b} END"
    return f"{found} AS {name}" if digits is None else f"round({found}, {digits}) AS {name}"


_KERNEL = {
    "faced": "answered = 1", "exit_to": "answered = 1 AND act = 'exit'", "match_to": f"answered = 1 AND {_PASSIVE}", "push_over": "answered = 1 AND act = 'push'", "squeezed": "answered = 1 AND act = 'push' AND others - here > 0",
    "opportunities": "here = 1", "pushes": "here = 1 AND act = 'push'", "passives": f"here = 1 AND {_PASSIVE}", "hold_alone": "here = 1 AND others = 1 AND act = 'hold'", "push_alone": "here = 1 AND others = 1 AND act = 'push'", "exit_alone": "here = 1 AND answered = 1 AND others = 1 AND act = 'exit'",
}
_WEIGHTED = ("exit_to", "match_to", "push_over", "passives", "pushes", "hold_alone", "push_alone", "exit_alone")

_BOTH = [*_KERNEL, *(f"{w}_edge" for w in _WEIGHTED), "matched", "sunk_at_exit", "pot_at_exit"]
_FLOWS = "SELECT t.*, coalesce(greatest(-t.net_lo, 0e0) * greatest(t.net_hi, 0e0) / nullif(t.won, 0e0) / t.unit, 0e0) AS flow_lo, coalesce(greatest(-t.net_hi, 0e0) * greatest(t.net_lo, 0e0) / nullif(t.won, 0e0) / t.unit, 0e0) AS flow_hi, "
_BOTH_WAYS = f"""
{_FLOWS}{", ".join(f"coalesce({k}.{n}, 0) AS {n}_{me}" for k, me in (("f", "lo"), ("g", "hi")) for n in _BOTH)} FROM {{transfers}} t
LEFT JOIN {{kernel}} f ON f.episode = t.episode AND f.actor = t.lo AND f.target = t.hi LEFT JOIN {{kernel}} g ON g.episode = t.episode AND g.actor = t.hi AND g.target = t.lo WHERE t.unit > 0e0"""
#: On Spark both directions of a pair are put beside one another first, so what is done toward targets is found and joined once.
_BOTH_AT_ONCE = f"""
WITH k AS (SELECT episode, least(actor, target) AS lo, greatest(actor, target) AS hi, {", ".join(f"max(CASE WHEN actor {o} target THEN {n} END) AS {n}_{me}" for o, me in (("<", "lo"), (">", "hi")) for n in _BOTH)} FROM {{kernel}} GROUP BY episode, least(actor, target), greatest(actor, target))
{_FLOWS}{", ".join(f"coalesce(k.{n}_{me}, 0) AS {n}_{me}" for me in ("lo", "hi") for n in _BOTH)} FROM {{transfers}} t LEFT JOIN k ON k.episode = t.episode AND k.lo = t.lo AND k.hi = t.hi WHERE t.unit > 0e0"""

#: On Spark a pair's receiver goes to its episodes, as narrow rows, and from there to the events; these are many and wide, and stay where they lie.
_ROLE_STEPS_WHERE_THEY_LIE = """
SELECT s.*, r.unit, r.ts, CASE WHEN s.member = r.receiver_net THEN 'r' WHEN s.partner IS NOT NULL THEN 's' ELSE 'o' END AS role, r.receiver_net AS receiver, CASE WHEN r.receiver_net = s.lo THEN s.hi ELSE s.lo END AS sender, r.margin
FROM {pair_steps} s JOIN (SELECT q.lo, q.hi, q.episode, q.unit, q.ts, r.receiver_net, r.margin FROM {moved} q JOIN {receivers} r ON r.lo = q.lo AND r.hi = q.hi WHERE q.unit > 0e0) r ON r.lo = s.lo AND r.hi = s.hi AND r.episode = s.episode"""
_ROLE_STEPS = """
SELECT s.*, e.unit, e.ts, CASE WHEN s.member = r.receiver_net THEN 'r' WHEN s.partner IS NOT NULL THEN 's' ELSE 'o' END AS role, r.receiver_net AS receiver, CASE WHEN r.receiver_net = s.lo THEN s.hi ELSE s.lo END AS sender, r.margin
FROM {pair_steps} s JOIN {receivers} r ON r.lo = s.lo AND r.hi = s.hi JOIN {episodes} e ON e.episode = s.episode AND e.unit > 0e0"""

RELATIONS = {
    # what an actor does toward a target in an episode
    "kernel": f"""
SELECT episode, member AS actor, target, {joined(cnt(c, n) for n, c in _KERNEL.items())}, {joined(f"coalesce(sum(CASE WHEN {_KERNEL[n]} THEN edge END), 0e0) AS {n}_edge" for n in _WEIGHTED)},
  coalesce(sum(CASE WHEN {_KERNEL["match_to"]} THEN amount END), 0e0) AS matched, coalesce(sum(CASE WHEN {_KERNEL["exit_to"]} THEN sunk END), 0e0) AS sunk_at_exit, coalesce(sum(CASE WHEN {_KERNEL["exit_to"]} THEN pot END), 0e0) AS pot_at_exit
FROM {{aimed_acts}} GROUP BY episode, member, target""",
    "facing": "SELECT episode, actor, target, faced AS n, exit_to AS n_exit, match_to AS n_match, push_over AS n_push, matched, sunk_at_exit FROM {kernel} WHERE faced > 0",
    # both directions of a pair's episode; what didn't occur is 0
    "both_ways": OnSpark(_BOTH_WAYS, lambda frame: frame(_BOTH_AT_ONCE)),
    # Who receives, by three rules; where the candidates' flows are equal the rule of all flows decides
    "receivers": f"""
WITH r AS (SELECT t.*, row_number() OVER ({_P} ORDER BY round(greatest(t_ab, t_ba), 6) DESC, episode) AS r FROM {{transfers}} t WHERE unit > 0e0),
s AS (SELECT lo, hi, round(sum(net_hi / unit) - sum(net_lo / unit), 6) AS by_net, round(sum(t_ab - t_ba), 6) AS by_flow, round(coalesce(sum(CASE WHEN r <= 10 THEN t_ab - t_ba END), 0e0), 6) AS by_candidates, round(abs(sum(t_ab - t_ba)) / (sum(t_ab + t_ba) + 1e0), 6) AS margin FROM r GROUP BY lo, hi)
SELECT lo, hi, CASE WHEN by_net > 0e0 THEN hi ELSE lo END AS receiver_net, CASE WHEN by_flow >= 0e0 THEN hi ELSE lo END AS receiver_flow, CASE WHEN by_candidates > 0e0 OR (by_candidates = 0e0 AND by_flow >= 0e0) THEN hi ELSE lo END AS receiver_candidates, margin FROM s""",
    # E8 for members: the last ten episodes' nets before this one
    "member_runs": """
SELECT episode, member, coalesce(sum(net) OVER (PARTITION BY member ORDER BY ts, episode ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0e0) AS net10, coalesce(lag(net) OVER (PARTITION BY member ORDER BY ts, episode), 0e0) AS last_net, row_number() OVER (PARTITION BY member ORDER BY ts, episode) - 1 AS seen
FROM (SELECT p.episode, p.member, e.ts, p.net / nullif(e.unit, 0e0) AS net FROM {participants} p JOIN {episodes} e ON e.episode = p.episode) t""",
    "styles": """
SELECT v.member, e.win, count(CASE WHEN act = 'push' THEN 1 END) / CAST(count(*) AS DOUBLE) AS push_rate, count(CASE WHEN act = 'exit' AND to_call > 0e0 THEN 1 END) / CAST(greatest(count(CASE WHEN to_call > 0e0 THEN 1 END), 1) AS DOUBLE) AS exit_facing,
  count(CASE WHEN act = 'match' AND to_call > 0e0 THEN 1 END) / CAST(greatest(count(CASE WHEN to_call > 0e0 THEN 1 END), 1) AS DOUBLE) AS match_facing, count(CASE WHEN stage = 0 AND act IN ('match', 'push') THEN 1 END) / CAST(greatest(count(CASE WHEN stage = 0 THEN 1 END), 1) AS DOUBLE) AS entry_rate,
  count(CASE WHEN stage = 0 AND act = 'push' THEN 1 END) / CAST(greatest(count(CASE WHEN stage = 0 THEN 1 END), 1) AS DOUBLE) AS raise_rate
FROM {ev} v JOIN {episodes} e ON e.episode = v.episode GROUP BY v.member, e.win""",
    # a pair's events with the role of their member: r receives, s sends, o is outside
    "role_steps": OnSpark(_ROLE_STEPS, lambda frame: frame(_ROLE_STEPS_WHERE_THEY_LIE)),
}

_CELL = "PARTITION BY lo, hi ORDER BY ts, episode ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _last(role: str, what: str) -> str:
    return f"max_by({what}, CASE WHEN role = '{role}' THEN ordinal END)"


_ROLE_ROWS = f"""
SELECT lo, hi, episode, receiver, sender, max(ts) AS ts, max(margin) AS margin, min_by(role, CASE WHEN act = 'push' AND stage = 0 THEN ordinal END) AS first_pusher,
  {joined(f"max(CASE WHEN role = '{r}' AND act = 'push' AND stage {s} 0 THEN 1 ELSE 0 END) AS {r}_push_{n}" for r in "sr" for s, n in (("=", "first"), (">", "later")))},
  {joined(f"{_last(r, what)} AS {r}_last_{n}" for r in "sr" for what, n in (("act", "act"), ("stage", "stage"), ("strength", "strength"), ("pusher_ever", "faced")))},
  {joined(f"min_by(strength, CASE WHEN role = '{r}' THEN ordinal END) AS {r}_first_strength" for r in "sr")}, max(CASE WHEN role = 'o' AND stage > 0 THEN 1 ELSE 0 END) AS outsiders_later, max(stage) AS last_stage,
  {cnt("role = 's' AND act = 'match'", "s_matches")}, {cnt(f"role = 's' AND {_PASSIVE}", "s_passives")}, {cnt("role = 'r' AND act = 'push'", "r_pushes")}, {cnt("role = 's' AND act = 'push'", "s_pushes")}
FROM {{role_steps}} GROUP BY lo, hi, episode, receiver, sender"""

OPERATORS = {
    # The last pusher is the target
    "facing_responses": "SELECT k.episode, k.actor, k.target, k.faced AS n, k.exit_to AS n_exit, k.match_to AS n_match, k.push_over AS n_push, round(k.matched / nullif(e.unit, 0e0), 6) AS matched, round(k.sunk_at_exit / nullif(e.unit, 0e0), 6) AS sunk_at_exit, round(k.pot_at_exit / nullif(e.unit, 0e0), 6) AS pot_at_exit FROM {kernel} k JOIN {episodes} e ON e.episode = k.episode WHERE k.faced > 0",
    # D18
    "active_interactions": "SELECT episode, actor, target, opportunities, pushes, passives FROM {kernel} WHERE opportunities > 0",
    # Stages that begin with two members left, neither of them all in; and what they do when only the other is left
    "heads_up": """
WITH b AS (SELECT v.episode, v.stage, v.stage_start, max(v.stage_pushes) AS pushes FROM {steps} v WHERE v.ordinal = v.stage_start AND v.active = 2 GROUP BY v.episode, v.stage, v.stage_start),
a AS (SELECT b.episode, b.stage, b.pushes, min(p.member) AS lo, max(p.member) AS hi FROM b JOIN {participants} p ON p.episode = b.episode AND (p.exit_ordinal IS NULL OR p.exit_ordinal >= b.stage_start)
  WHERE NOT EXISTS (SELECT 1 FROM {ev} x WHERE x.episode = p.episode AND x.member = p.member AND x.action = 'all_in' AND x.ordinal < b.stage_start) GROUP BY b.episode, b.stage, b.pushes HAVING count(*) = 2),
s AS (SELECT episode, lo, hi, count(*) AS stages, count(CASE WHEN pushes = 0 THEN 1 END) AS quiet_stages FROM a GROUP BY episode, lo, hi),
k AS (SELECT episode, least(actor, target) AS lo, greatest(actor, target) AS hi, CAST(sum(hold_alone) AS BIGINT) AS holds, CAST(sum(push_alone) AS BIGINT) AS pushes, CAST(sum(exit_alone) AS BIGINT) AS exits FROM {kernel} GROUP BY episode, least(actor, target), greatest(actor, target))
SELECT k.episode, k.lo, k.hi, coalesce(s.stages, 0) AS stages, coalesce(s.quiet_stages, 0) AS quiet_stages, k.holds, k.pushes, k.exits FROM k LEFT JOIN s ON s.episode = k.episode AND s.lo = k.lo AND s.hi = k.hi WHERE s.stages > 0 OR k.holds + k.pushes + k.exits > 0""",
    # Counts weighted by the actor's strength against the target's
    "strength_weighted": f"SELECT episode, actor, target, {joined(f'round({w}_edge, 6) AS {w}' for w in _WEIGHTED)} FROM {{kernel}}",
    # What is known before a decision
    "decision_context": """
SELECT v.episode, v.ordinal, v.member, v.stage, CAST(v.to_call > 0e0 AS INT) AS facing, round(v.to_call / nullif(e.unit, 0e0), 6) AS cost, round(v.pot / nullif(e.unit, 0e0), 6) AS pot, round(CASE WHEN v.to_call > 0e0 THEN v.to_call / (v.pot + v.to_call) ELSE 0e0 END, 6) AS odds,
  round(m.balance / nullif(e.unit, 0e0), 6) AS stack, round(m.balance / greatest(v.pot, 1e0), 6) AS stack_to_pot, v.active, v.place AS position, CAST(v.stage = 0 AND v.ordinal < 2 AS INT) AS is_early,
  v.pushes_before AS pushes_this_stage, v.own_pushes_before AS own_pushes, CASE WHEN v.own_push_earlier_stage = v.push_earlier_stage AND v.stage_of_push = v.stage_before THEN 1 ELSE 0 END AS initiative, round(v.stage_sunk / nullif(e.unit, 0e0), 6) AS stage_put,
  v.strength, round(v.strength - avg(v.strength) OVER (PARTITION BY v.episode, v.stage), 6) AS strength_gap, s.entry_rate AS style_entry, s.raise_rate AS style_raise, round(s.push_rate, 6) AS style_push, round(s.exit_facing, 6) AS style_exit, round(s.match_facing, 6) AS style_match,
  round(r.net10, 5) AS net10, round(r.last_net, 6) AS last_net, r.seen
FROM (SELECT v.*, CAST(min(members_seen) OVER (PARTITION BY episode, member) - 1 AS BIGINT) AS place FROM {steps} v) v JOIN {episodes} e ON e.episode = v.episode LEFT JOIN {members} m ON m.member = v.member JOIN {styles} s ON s.member = v.member AND s.win = e.win JOIN {member_runs} r ON r.episode = v.episode AND r.member = v.member""",
    # The member's shares in such contexts, sizes against the pot, and what was done since the last push of the stage
    "decision_context_v2": """
WITH c AS (SELECT v.member, e.win, CAST(v.stage > 0 AS INT) AS late, CAST(v.to_call > 0e0 AS INT) AS facing, count(*) + 4 AS n, count(CASE WHEN act = 'exit' THEN 1 END) + 1 AS exits, count(CASE WHEN act = 'hold' THEN 1 END) + 1 AS holds, count(CASE WHEN act = 'match' THEN 1 END) + 1 AS matches, count(CASE WHEN act = 'push' THEN 1 END) + 1 AS pushes
  FROM {ev} v JOIN {episodes} e ON e.episode = v.episode GROUP BY v.member, e.win, CAST(v.stage > 0 AS INT), CAST(v.to_call > 0e0 AS INT)),
i AS (SELECT v.*, last_value(CASE WHEN act = 'push' THEN amount - to_call END) IGNORE NULLS OVER (PARTITION BY episode, stage ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_size FROM {steps} v),
j AS (SELECT i.*, count(CASE WHEN act = 'match' THEN 1 END) OVER (PARTITION BY episode, stage, pushes_before ORDER BY ordinal) - CASE WHEN act = 'match' THEN 1 ELSE 0 END AS callers FROM i)
SELECT v.episode, v.ordinal, round(c.exits / CAST(c.n AS DOUBLE), 6) AS q_exit, round(c.holds / CAST(c.n AS DOUBLE), 6) AS q_hold, round(c.matches / CAST(c.n AS DOUBLE), 6) AS q_match, round(c.pushes / CAST(c.n AS DOUBLE), 6) AS q_push, c.n AS context_n,
  round(v.to_call / greatest(v.pot, 1e0), 6) AS cost_to_pot, round(coalesce(v.last_size, 0e0) / greatest(v.pot, 1e0), 6) AS last_push_to_pot, v.own_pushes_ever AS own_pushes, v.own_matches_ever AS own_matches, CAST(v.own_openings > 0 AS INT) AS pushed_first_stage, v.callers AS callers_since_push, v.own_acts_before AS own_acts_this_stage
FROM j v JOIN {episodes} e ON e.episode = v.episode JOIN c ON c.member = v.member AND c.win = e.win AND c.late = CAST(v.stage > 0 AS INT) AND c.facing = CAST(v.to_call > 0e0 AS INT)""",
    # Who gives and who squeezes, by weighted signs over all of a pair's episodes, and the episode seen from them
    "orient_roles": f"""
WITH w AS (SELECT b.*, greatest(t_ab, t_ba) * greatest(t_ab, t_ba) AS w, (flow_lo - flow_hi) / (abs(flow_lo - flow_hi) + 1e0) + exit_to_lo - exit_to_hi AS toward, squeezed_lo - squeezed_hi AS over FROM {{both_ways}} b),
o AS (SELECT lo, hi, round(sum(w * toward), 6) AS d, round(sum(w * over), 6) AS s, sum(w) AS w FROM w GROUP BY lo, hi),
f AS (SELECT episode, member, min_by(strength, ordinal) AS first_strength, max_by(strength, ordinal) AS last_strength FROM {{ev}} GROUP BY episode, member),
i AS (SELECT lo, hi, episode, {cnt("partner IS NULL AND act = 'exit' AND last_pusher = lo AND up_hi = 1", "iso_lo")}, {cnt("partner IS NULL AND act = 'exit' AND last_pusher = hi AND up_lo = 1", "iso_hi")}, {cnt("ordinal = stage_start AND active = 2 AND here_lo = 1 AND here_hi = 1", "alone")} FROM {{pair_steps}} GROUP BY lo, hi, episode),
x AS (SELECT w.*, o.d > 0e0 AS gives, o.s > 0e0 AS squeezes, round(abs(o.d) / (o.w + 1e-3), 6) AS d_sure, round(abs(o.s) / (o.w + 1e-3), 6) AS s_sure, a.first_strength AS first_lo, a.last_strength AS last_lo, b.first_strength AS first_hi, b.last_strength AS last_hi, i.iso_lo, i.iso_hi, i.alone
  FROM w JOIN o ON o.lo = w.lo AND o.hi = w.hi JOIN i ON i.lo = w.lo AND i.hi = w.hi AND i.episode = w.episode JOIN f a ON a.episode = w.episode AND a.member = w.lo JOIN f b ON b.episode = w.episode AND b.member = w.hi)
SELECT lo, hi, episode, CASE WHEN gives THEN lo ELSE hi END AS donor, CASE WHEN squeezes THEN lo ELSE hi END AS squeezer, {swap("gives", "flow_lo", "flow_hi", "flow_dr")}, {swap("gives", "flow_hi", "flow_lo", "flow_rd")}, {swap("gives", "greatest(-net_lo, 0e0) / unit", "greatest(-net_hi, 0e0) / unit", "d_lost")},
  {joined(swap("gives", f"{n}_{a}", f"{n}_{b}", f"{p}_{n}", None) for n in ("exit_to", "push_over") for a, b, p in (("lo", "hi", "d"), ("hi", "lo", "r")))}, {swap("gives", "match_to_lo", "match_to_hi", "d_match_to", None)}, {swap("gives", "exit_to_edge_lo", "exit_to_edge_hi", "d_edge_exit")},
  {swap("gives", "match_to_edge_lo", "match_to_edge_hi", "d_edge_match")}, {swap("gives", "sunk_at_exit_lo / unit", "sunk_at_exit_hi / unit", "d_sunk_exit")}, {swap("gives", "CAST(exit_lo IS NULL AS INT)", "CAST(exit_hi IS NULL AS INT)", "d_stayed", None)}, {swap("gives", "CAST(exit_lo IS NOT NULL AS INT)", "CAST(exit_hi IS NOT NULL AS INT)", "d_exited", None)},
  {joined(swap("gives", f"{n}_{a}", f"{n}_{b}", f"{p}_{n}_strength", None) for n in ("first", "last") for a, b, p in (("lo", "hi", "d"), ("hi", "lo", "r")))}, {joined(swap("gives", f"net_{a} / unit", f"net_{b} / unit", f"{p}_net") for a, b, p in (("lo", "hi", "d"), ("hi", "lo", "r")))}, alone AS alone_stages,
  {joined(swap("squeezes", f"{n}_{a}", f"{n}_{b}", f"{p}_{n}", None) for n in ("squeezed", "exit_to") for a, b, p in (("lo", "hi", "sq"), ("hi", "lo", "p")))}, {swap("squeezes", "iso_lo", "iso_hi", "sq_iso", None)}, d_sure, s_sure,
  {swap("gives", "CAST(flow_lo > flow_hi AS INT)", "CAST(flow_hi > flow_lo AS INT)", "d_agrees", None)}, {swap("squeezes", "CAST(squeezed_lo > squeezed_hi AS INT)", "CAST(squeezed_hi > squeezed_lo AS INT)", "s_agrees", None)}
FROM x""",
    # E17, with the flipped receiver
    "orient_by": "SELECT lo, hi, receiver_net, receiver_flow, receiver_candidates, CASE WHEN receiver_net = lo THEN hi ELSE lo END AS flipped_net, margin FROM {receivers}",
    # The episode seen from receiver and sender, and the clock of the pair's cells
    "role_features": f"""
WITH a AS (SELECT x.*, t.unit, CASE WHEN x.receiver = t.lo THEN t.net_lo ELSE t.net_hi END / t.unit AS net_r, CASE WHEN x.receiver = t.lo THEN t.net_hi ELSE t.net_lo END / t.unit AS net_s, CASE WHEN x.receiver = t.lo THEN t.put_lo ELSE t.put_hi END / t.unit AS put_r, CASE WHEN x.receiver = t.lo THEN t.put_hi ELSE t.put_lo END / t.unit AS put_s,
  CASE WHEN x.receiver = t.lo THEN CAST(t.exit_lo IS NULL AS INT) ELSE CAST(t.exit_hi IS NULL AS INT) END AS r_stayed, CASE WHEN x.receiver = t.lo THEN CAST(t.exit_hi IS NULL AS INT) ELSE CAST(t.exit_lo IS NULL AS INT) END AS s_stayed FROM ({_ROLE_ROWS}) x JOIN {{transfers}} t ON t.lo = x.lo AND t.hi = x.hi AND t.episode = x.episode),
b AS (SELECT a.*, CAST(sign(net_r - net_s) AS INT) AS direction, CAST(put_r >= 20 AND put_s >= 20 AS INT) AS big, CAST(put_r > 1 AND put_s > 1 AS INT) AS both_in, CAST(coalesce(s_last_act = 'exit' AND s_last_faced = receiver, FALSE) AS INT) AS s_exit_to_r, CAST(coalesce(r_last_act = 'exit' AND r_last_faced = sender, FALSE) AS INT) AS r_exit_to_s FROM a),
c AS (SELECT b.*, CASE WHEN direction = 1 THEN big ELSE 0 END AS big_r, CASE WHEN direction = 1 THEN both_in ELSE 0 END AS cell FROM b)
SELECT lo, hi, episode, receiver, round(net_r, 6) AS net_r, round(net_s, 6) AS net_s, round(put_r, 6) AS put_r, round(put_s, 6) AS put_s, CASE first_pusher WHEN 'r' THEN 1 WHEN 's' THEN 2 ELSE 0 END AS first_pusher, s_push_first, s_push_later, r_push_first, r_push_later, s_last_act, r_last_act, s_last_stage, r_last_stage, outsiders_later, s_stayed, r_stayed, last_stage,
  s_first_strength, r_first_strength, s_last_strength, r_last_strength, s_exit_to_r, r_exit_to_s, s_matches, s_passives, r_pushes, s_pushes, direction, big, both_in, big_r, cell, row_number() OVER ({_T}) - 1 AS k, count(*) OVER ({_P}) AS n, round((row_number() OVER ({_T}) - 5e-1) / count(*) OVER ({_P}), 6) AS at, round(1e0 / count(*) OVER ({_P}), 6) AS step,
  CAST(sum(big_r) OVER ({_CELL}) - big_r AS BIGINT) AS big_before, CAST(sum(cell) OVER ({_CELL}) - cell AS BIGINT) AS cells_before, CAST(sum(cell) OVER ({_P}) AS BIGINT) AS cells, CAST(sum(big_r) OVER ({_P}) AS BIGINT) AS bigs,
  round((sum(cell) OVER ({_CELL}) - cell + 5e-1) / CAST(greatest(sum(cell) OVER ({_P}), 1) AS DOUBLE), 6) AS at_cell, CASE WHEN s_exit_to_r = 1 THEN s_last_strength ELSE 0e0 END AS exit_strength, margin
FROM c""",
    # Both directions of D17-D23, and what each member did
    "kernel_view": "SELECT b.lo, b.hi, b.episode, " + ", ".join(f"b.{n}_{me}" for me in ("lo", "hi") for n in _KERNEL) + ", " + ", ".join(f"round(b.{n}_{me}, 5) AS {n}_{me}" for me in ("lo", "hi") for n in (*(f"{w}_edge" for w in _WEIGHTED), "flow", "matched", "sunk_at_exit", "pot_at_exit"))
    + ", " + ", ".join(f"c.{n}_{me}" for me in ("lo", "hi") for n in ("n", "exit", "hold", "match", "push", "facing", "exit_facing")) + " FROM {both_ways} b JOIN {pair_counts} c ON c.lo = b.lo AND c.hi = b.hi AND c.episode = b.episode",
    # E20
    "pair_descriptors": f"""
WITH d AS (SELECT s.lo, s.hi, s.episode, min_by(CASE WHEN partner IS NULL THEN 0 ELSE 1 END, CASE WHEN act = 'push' THEN ordinal END) AS opened_by_pair, {cnt("act = 'push' AND partner IS NOT NULL", "pair_pushes")}, {cnt("act = 'push' AND partner IS NULL", "outsider_pushes")},
  {cnt("act = 'exit' AND partner IS NULL AND last_pusher IN (lo, hi)", "exits_after_pair")}, {cnt("act = 'exit' AND last_pusher = partner", "exits_to_partner")}, {cnt("act = 'push' AND last_pusher = partner", "re_pushes")}, {cnt("stage = 0 AND partner IS NULL AND act IN ('match', 'push')", "outsider_entries")}, max(stage) AS last_stage,
  {top("5e-1 + (strength - CASE WHEN member = lo THEN s_hi ELSE s_lo END) / 2e0", "act = 'exit' AND last_pusher = partner", "edge_given_up")}, max(CASE WHEN act = 'exit' AND last_pusher = partner THEN strength END) AS strength_given_up,
  round(max_by(pot / unit, CASE WHEN act = 'exit' AND last_pusher = partner THEN ordinal END), 6) AS pot_given_up, round(max_by(sunk / unit, CASE WHEN act = 'exit' AND last_pusher = partner THEN ordinal END), 6) AS sunk_given_up, max_by(stage, CASE WHEN act = 'exit' AND last_pusher = partner THEN ordinal END) AS stage_given_up,
  {cnt("act = 'hold' AND partner IS NOT NULL AND active = 2 AND here_lo = 1 AND here_hi = 1", "holds_alone")}, {cnt("act = 'push' AND partner IS NOT NULL AND active = 2 AND here_lo = 1 AND here_hi = 1", "pushes_alone")}, coalesce(max(CASE WHEN act = 'push' AND last_pusher = partner THEN outs END), 0) AS outsiders_at_re_push,
  {tot("q_push", "act = 'hold' AND partner IS NOT NULL AND active = 2 AND here_lo = 1 AND here_hi = 1", "push_not_made_alone")}, {cnt("act = 'push' AND partner IS NOT NULL AND q_push < 2e-1", "rare_pushes")}, {cnt("act = 'exit' AND last_pusher = partner AND outs = 0", "exits_alone")},
  {cnt("act = 'exit' AND partner IS NOT NULL AND outsider_left = 1", "exits_after_outsider")}, {cnt(f"{_PASSIVE} AND last_pusher = partner", "matches_partner")}, {cnt(f"{_PASSIVE} AND last_pusher = partner AND 5e-1 + (strength - CASE WHEN member = lo THEN s_hi ELSE s_lo END) / 2e0 < 1e-1", "matches_dead")},
  round(coalesce(min(CASE WHEN act = 'exit' AND last_pusher = partner THEN q_exit END), 1e0), 6) AS least_q_exit, round(min_by(q_push, CASE WHEN act = 'push' AND partner IS NOT NULL THEN ordinal END), 6) AS q_first_push, max(stayed) AS stayed
  FROM {{pair_steps}} s JOIN {{episodes}} e ON e.episode = s.episode AND e.unit > 0e0 GROUP BY s.lo, s.hi, s.episode)
SELECT d.lo, d.hi, d.episode, coalesce(opened_by_pair, 0) AS opened_by_pair, coalesce(1 - opened_by_pair, 0) AS opened_by_outsider, pair_pushes, outsider_pushes, exits_after_pair, exits_to_partner, re_pushes, outsider_entries, last_stage, edge_given_up, strength_given_up, pot_given_up, sunk_given_up, stage_given_up, holds_alone, pushes_alone,
  outsiders_at_re_push, push_not_made_alone, rare_pushes, exits_alone, CASE WHEN d.stayed = 1 AND (q.exit_lo IS NULL OR q.exit_hi IS NULL) THEN 1 ELSE 0 END AS won_uncontested, exits_after_outsider, matches_partner, matches_dead, CASE WHEN stage_given_up = 0 THEN 1 ELSE 0 END AS given_up_first_stage, least_q_exit, CASE WHEN opened_by_pair = 1 THEN q_first_push END AS q_first_push
FROM d JOIN {{pair_wide}} q ON q.lo = d.lo AND q.hi = d.hi AND q.episode = d.episode""",
    # Events of the pair's story, and how likely it is that an answer to the partner was rewritten from another class (E22's posterior)
    "role_event_flags": None,
    # Receiver and sender, by nets
    "oriented_episode_features": f"""
SELECT s.lo, s.hi, s.episode, s.receiver, round(max(CASE WHEN s.receiver = t.lo THEN t.net_lo ELSE t.net_hi END / t.unit), 6) AS net_r, round(max(CASE WHEN s.receiver = t.lo THEN t.net_hi ELSE t.net_lo END / t.unit), 6) AS net_s, round(max(CASE WHEN s.receiver = t.hi THEN t.t_ab ELSE t.t_ba END), 6) AS transfer, round(max((t.net_lo + t.net_hi) / t.unit), 6) AS pair_net,
  max(CASE WHEN t.put_lo > t.unit AND t.put_hi > t.unit THEN 1 ELSE 0 END) AS both_in, max(CASE WHEN t.exit_lo IS NULL AND t.exit_hi IS NULL THEN 1 ELSE 0 END) AS both_stayed, max(CASE WHEN s.receiver = t.lo THEN CAST(t.net_lo > 0e0 AS INT) ELSE CAST(t.net_hi > 0e0 AS INT) END) AS r_won, max(CASE WHEN s.receiver = t.lo THEN CAST(t.net_hi > 0e0 AS INT) ELSE CAST(t.net_lo > 0e0 AS INT) END) AS s_won,
  {joined(top("sur", f"role = '{r}' AND act <> 'push'", f"sur_passive_{r}_max") for r in "sr")}, {joined(top("sur", f"role = '{r}' AND act = 'push'", f"sur_push_{r}_max") for r in "sr")}, {top("sur", "role <> 'o' AND act <> 'push'", "sur_passive_max")}, {tot("sur", "role <> 'o'", "sur_sum")},
  {joined(f"max(CASE WHEN role = '{r}' AND {c} THEN strength END) AS strength_{n}_{r}" for n, c in (("exit", "act = 'exit'"), ("passive", "act <> 'push'")) for r in "sr")}, {joined(top("strength * sur", f"role = '{r}' AND act <> 'push'", f"mismatch_{r}_max") for r in "sr")}, {joined(f"max(CASE WHEN role = '{r}' AND act = 'exit' AND to_call > 0e0 THEN 1 ELSE 0 END) AS {r}_exit_facing" for r in "sr")},
  max(CASE WHEN role = 's' AND act = 'match' AND stage = 0 THEN 1 ELSE 0 END) AS s_match_first_stage, max(CASE WHEN role = 'r' AND act = 'push' THEN 1 ELSE 0 END) AS r_pushed, {joined(cnt(f"role = '{r}'", f"n_{r}") for r in "sr")}, {cnt("role <> 'o' AND act <> 'push'", "n_passive")}, {cnt("role <> 'o' AND act = 'push'", "n_push")},
  round(max_by(s.pot / s.unit, ordinal), 6) AS last_pot, max(stage) AS last_stage, max(CASE WHEN s.receiver = t.lo THEN t.s_lo - t.s_hi ELSE t.s_hi - t.s_lo END) AS strength_gap, {cnt("role = 'o' AND act = 'exit'", "outsider_exits")}
FROM {{role_steps}} s JOIN {{transfers}} t ON t.lo = s.lo AND t.hi = s.hi AND t.episode = s.episode GROUP BY s.lo, s.hi, s.episode, s.receiver""",
}


#: What decision_context knows of a member: found where the members lie, and sent to the episodes as narrow rows; the decisions, many and wide, stay where they lie.
_KNOWN = """
SELECT t.*, m.balance, s.entry_rate, s.raise_rate, s.push_rate, s.exit_facing, s.match_facing FROM (
  SELECT episode, member, win, unit, coalesce(sum(net) OVER (PARTITION BY member ORDER BY ts, episode ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0e0) AS net10, coalesce(lag(net) OVER (PARTITION BY member ORDER BY ts, episode), 0e0) AS last_net, row_number() OVER (PARTITION BY member ORDER BY ts, episode) - 1 AS seen
  FROM (SELECT p.episode, p.member, e.ts, e.win, e.unit, p.net / nullif(e.unit, 0e0) AS net FROM {participants} p JOIN {episodes} e ON e.episode = p.episode) n) t
LEFT JOIN {members} m ON m.member = t.member JOIN {styles} s ON s.member = t.member AND s.win BETWEEN t.win AND t.win"""
_DECISIONS, _KNOWERS = OPERATORS["decision_context"].split(" JOIN {episodes} e ON e.episode = v.episode LEFT JOIN {members}")
assert _KNOWERS.endswith("JOIN {member_runs} r ON r.episode = v.episode AND r.member = v.member")
CONTEXT_ON_SPARK = re.sub(r"\b[emrs]\.(?=\w)", "k.", _DECISIONS) + f" JOIN ({_KNOWN}) k ON k.episode = v.episode AND k.member = v.member"


def _decision_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem import catalog

    return catalog.relations().frame(spark, CONTEXT_ON_SPARK, catalog.Tables(spark, sf_dir))


QUERIES = {"decision_context": _decision_context}


def _flags(activation: float = 0.5, rate: float = 0.6) -> str:
    kinds = (("push_to_match", "push", "match"), ("push_to_hold", "push", "hold"), ("match_to_exit", "match", "exit"), ("exit_to_match", "exit", "match"))
    seen = []
    for name, source, shown in kinds:
        where = "active = 2 AND here_lo = 1 AND here_hi = 1 AND last_pusher IS NULL" if name == "push_to_hold" else "last_pusher = partner"
        # the shown class is the rewritten one; a decision of the source class lowers nothing, it is not a witness
        chance = f"{activation}e0 * {rate}e0 * q_{source} / ({activation}e0 * {rate}e0 * q_{source} + q_{shown})"
        cond = f"partner IS NOT NULL AND {where} AND act = '{shown}'"
        seen += [f"round(coalesce(max(CASE WHEN {cond} THEN {chance} END), 0e0), 6) AS {name}_max", tot(chance, cond, f"{name}_sum")]
    return f"""
SELECT lo, hi, episode, {cnt("act = 'exit' AND last_pusher = partner", "conceded")}, {cnt("act = 'exit' AND last_pusher = partner AND outsider_left = 1", "conceded_after_outsider")},
  {cnt("act = 'push' AND outs > 0 AND ((member = lo AND up_lo = 0 AND up_hi = 1) OR (member = hi AND up_hi = 0 AND up_lo = 1))", "both_pushed")}, {cnt("partner IS NULL AND act = 'exit' AND last_pusher IN (lo, hi) AND up_lo = 1 AND up_hi = 1", "outsider_exit_after_both")},
  {cnt("partner IS NOT NULL AND outs = 0 AND outs_before > 0", "became_alone")}, {joined(seen)}, {cnt("act = 'push' AND partner IS NOT NULL AND outs > 0", "pair_pushes_with_outsiders")}, {cnt(f"partner IS NOT NULL AND {_PASSIVE} AND last_pusher IN (lo, hi) AND up_lo + up_hi > 0", "passive_after_pair_push")},
  coalesce(min_by(CASE WHEN partner IS NULL THEN 0 ELSE 1 END, CASE WHEN act = 'push' THEN ordinal END), 0) AS first_push_pair, coalesce(min_by(CASE WHEN partner IS NULL THEN 1 ELSE 0 END, CASE WHEN act = 'push' THEN ordinal END), 0) AS first_push_outsider, {cnt("act = 'push' AND partner IS NOT NULL", "pair_pushes")}, {cnt("act = 'push' AND partner IS NULL", "outsider_pushes")}
FROM (SELECT s.*, lag(CASE WHEN partner IS NOT NULL THEN outs END) OVER (PARTITION BY lo, hi, episode, CASE WHEN partner IS NULL THEN 1 ELSE 0 END ORDER BY ordinal) AS outs_before FROM {{pair_steps}} s) t GROUP BY lo, hi, episode"""


OPERATORS["role_event_flags"] = _flags()
