"""Joins over episodes, events and pairs (C1-C14), and unions and comparisons of sets."""

from tandem.plans.ordered import ordered

OPERATORS = {
    # the flagship query: pairs by the lean of their transfers, each with five episodes
    "top_pairs": """
SELECT pool, lo, hi, n, imbalance, transfer_max, round((n_all - r + 1) / CAST(n_all AS DOUBLE), 6) AS risk_score, ep1, ep2, ep3, ep4, ep5 FROM {evaluated_pairs}""",
    # The pool of a member, and in how many it was seen
    "member_pool": """
SELECT p.member, min(e.priority) AS pool_first, count(DISTINCT e.priority) AS pools FROM {participants} p JOIN {episodes} e ON e.episode = p.episode GROUP BY p.member""",
    # Labelled pairs and those to be scored, of one pool, with the window each is for
    "target_pairs": """
SELECT l.lo, l.hi, a.pool, 'development' AS win, l.label FROM {pair_labels} l JOIN {members} a ON a.member = l.lo JOIN {members} b ON b.member = l.hi AND b.pool = a.pool WHERE l.label IS NOT NULL
UNION ALL
SELECT l.lo, l.hi, a.pool, 'evaluation' AS win, CAST(NULL AS INT) AS label FROM {pair_labels} l JOIN {members} a ON a.member = l.lo JOIN {members} b ON b.member = l.hi AND b.pool = a.pool WHERE l.label IS NULL""",
    # Episodes that both of a pair took part in, with what each does elsewhere
    "pair_episodes_background": "SELECT q.pool, q.lo, q.hi, q.episode, e.win, " + ", ".join(f"round(coalesce({k}.{r}_rate, 0e0), 6) AS {r}_rate_{me}" for k, me in (("a", "lo"), ("b", "hi")) for r in ("push", "exit", "match")) + " FROM {pair_episodes} q JOIN {episodes} e ON e.episode = q.episode LEFT JOIN {background} a ON a.member = q.lo AND a.win = e.win LEFT JOIN {background} b ON b.member = q.hi AND b.win = e.win",
    # C4: every unordered pair of members in an episode
    "enumerate_pairs": "SELECT a.episode, a.member AS lo, b.member AS hi FROM {participants} a JOIN {participants} b ON a.episode = b.episode AND a.member < b.member",
    # Every ordered pair
    "ordered_pairs": "SELECT a.episode, a.member AS actor, b.member AS target FROM {participants} a JOIN {participants} b ON a.episode = b.episode AND a.member <> b.member",
    # Rows whose parent is missing: events of members without a positive balance
    "anti_check": """
SELECT v.episode, v.ordinal FROM {ev} v WHERE NOT EXISTS (SELECT 1 FROM {members} m WHERE m.member = v.member AND m.balance > 0e0)""",
    # Only the events of target episodes
    "relevant_events": "SELECT v.episode, v.ordinal, v.member, v.act FROM {ev} v WHERE EXISTS (SELECT 1 FROM {pair_episodes} q WHERE q.episode = v.episode)",
    # For each event the other members that have not left before it
    "active_targets": """
SELECT v.episode, v.ordinal, v.member AS actor, p.member AS target
FROM {ev} v JOIN {participants} p ON p.episode = v.episode AND p.member <> v.member AND (p.exit_ordinal IS NULL OR p.exit_ordinal >= v.ordinal)""",
    # C11: who pushed last in this stage before the event
    "last_push_asof": "SELECT episode, ordinal, member, last_pusher FROM {pushed}",
    # A pair-episode against the others of the episode that share a member, and those that share none
    "alt_partner_contrast": """
SELECT f.lo, f.hi, f.episode, round(f.score - max(CASE WHEN o.lo IN (f.lo, f.hi) OR o.hi IN (f.lo, f.hi) THEN o.score END), 6) AS minus_max_sharing,
  round(f.score - avg(CASE WHEN o.lo IN (f.lo, f.hi) OR o.hi IN (f.lo, f.hi) THEN o.score END), 8) AS minus_mean_sharing,
  round(f.score - max(CASE WHEN NOT (o.lo IN (f.lo, f.hi) OR o.hi IN (f.lo, f.hi)) THEN o.score END), 6) AS minus_max_disjoint
FROM {scored} f JOIN {scored} o ON o.episode = f.episode AND NOT (o.lo = f.lo AND o.hi = f.hi) GROUP BY f.lo, f.hi, f.episode, f.score""",
    # Pairs and members of either window
    "window_overlap": """
WITH w AS (SELECT lo, hi, max(CASE WHEN win = 'development' THEN 1 ELSE 0 END) AS d, max(CASE WHEN win = 'evaluation' THEN 1 ELSE 0 END) AS e, count(*) AS n FROM {scored} GROUP BY lo, hi)
SELECT d AS in_development, e AS in_evaluation, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS episodes FROM w GROUP BY d, e""",
    # C14: pairs over an exposure floor without a label, by how many of their members have a positive pair
    "universe_gap": """
WITH m AS (SELECT lo AS member FROM {pair_labels} WHERE label = 1 UNION SELECT hi AS member FROM {pair_labels} WHERE label = 1)
SELECT touch, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS episodes, round(avg(score), 6) AS mean_score, min(n) AS least, max(n) AS most FROM (
  SELECT s.lo, s.hi, s.n, s.score, CASE WHEN s.lo IN (SELECT member FROM m) THEN 1 ELSE 0 END + CASE WHEN s.hi IN (SELECT member FROM m) THEN 1 ELSE 0 END AS touch FROM {pair_scores} s WHERE s.n >= 15 AND s.label IS NULL) t GROUP BY touch""",
    # G1
    "union_windows": "SELECT lo, hi, episode, round(score, 6) AS score, win FROM {scored} WHERE win = 'development' UNION ALL SELECT lo, hi, episode, round(score, 6) AS score, win FROM {scored} WHERE win = 'evaluation'",
    # Ids missing, unexpected or double in one set against another
    "id_set_compare": """
WITH a AS (SELECT lo, hi FROM {pair_labels}), b AS (SELECT lo, hi + CASE WHEN episode % 50 = 0 THEN 1 ELSE 0 END AS hi, count(*) AS n FROM {scored} GROUP BY lo, hi + CASE WHEN episode % 50 = 0 THEN 1 ELSE 0 END)
SELECT count(CASE WHEN b.lo IS NULL THEN 1 END) AS missing, count(CASE WHEN a.lo IS NULL THEN 1 END) AS unexpected, CAST(coalesce(sum(b.n - 1), 0) AS BIGINT) AS doubled FROM a FULL OUTER JOIN b ON a.lo = b.lo AND a.hi = b.hi""",
    # How many of a pair's five best are in its listed five
    "list_overlap": """
SELECT t.lo, t.hi, count(g.episode) AS n_common FROM (
  SELECT lo, hi, episode FROM (SELECT lo, hi, episode, row_number() OVER (PARTITION BY lo, hi ORDER BY score DESC, ts, episode) AS r FROM {scored} WHERE win = 'development') x WHERE r <= 5) t
LEFT JOIN {listed} g ON g.lo = t.lo AND g.hi = t.hi AND g.episode = t.episode GROUP BY t.lo, t.hi""",
}
RELATIONS = {
    "background": """
SELECT v.member, e.win, count(*) AS n, sum(CASE WHEN act = 'push' THEN 1e0 ELSE 0e0 END) / count(*) AS push_rate, sum(CASE WHEN act = 'exit' THEN 1e0 ELSE 0e0 END) / count(*) AS exit_rate,
  sum(CASE WHEN act = 'match' THEN 1e0 ELSE 0e0 END) / count(*) AS match_rate
FROM {ev} v JOIN {episodes} e ON e.episode = v.episode GROUP BY v.member, e.win""",
    # all pairs in order of their lean, with no task that sees all
    "evaluated_pairs": ordered("""
WITH r AS (SELECT t.*, row_number() OVER (PARTITION BY lo, hi ORDER BY round(greatest(t_ab, t_ba), 6) DESC, ts, episode) AS place FROM {moved} t WHERE win = 'evaluation')
SELECT pool, lo, hi, count(*) AS n, round(abs(avg(t_ab) - avg(t_ba)), 6) AS imbalance, round(max(greatest(t_ab, t_ba)), 6) AS transfer_max, max(CASE WHEN place = 1 THEN episode END) AS ep1, max(CASE WHEN place = 2 THEN episode END) AS ep2, max(CASE WHEN place = 3 THEN episode END) AS ep3,
  max(CASE WHEN place = 4 THEN episode END) AS ep4, max(CASE WHEN place = 5 THEN episode END) AS ep5 FROM r GROUP BY pool, lo, hi""", (), ("imbalance desc", "lo", "hi")),
}
