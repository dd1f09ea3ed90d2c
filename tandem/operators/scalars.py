"""Projections and scalar expressions over episodes, events and pairs."""

from tandem.plans.ordered import quantiles

OPERATORS = {
    # B1: 0-based index of members, numbered inside pools
    "dense_index": "SELECT pool, member, CAST(row_number() OVER (PARTITION BY pool ORDER BY member) - 1 AS BIGINT) AS idx FROM {members}",
    # B2: coding of enumerations; unknown values have none
    "encode_enum": """
SELECT episode, ordinal, CASE act WHEN 'exit' THEN 0 WHEN 'hold' THEN 1 WHEN 'match' THEN 2 WHEN 'push' THEN 3 END AS act_code, stage FROM {ev}""",
    # Tokens of a list in a string: how many, their letters, and the sum of their places times their lengths
    "parse_token_list": """
SELECT p_partkey, CAST(n AS BIGINT) AS n_tokens, CAST(length(clean) - n + 1 AS BIGINT) AS n_letters, CAST(aggregate(transform(split(clean, ' '), (x, i) -> (i + 1) * length(x)), 0, (a, x) -> a + x) AS BIGINT) AS place_sum, first_token FROM (
  SELECT p_partkey, clean, length(clean) - length(replace(clean, ' ', '')) + 1 AS n, split_part(clean, ' ', 1) AS first_token
  FROM (SELECT p_partkey, trim(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ')) AS clean FROM {part}) t) u""",
    # Spelling of actions
    "normalize_action": "SELECT event_id, replace(replace(lower(trim(event_type)), '-', '_'), ' ', '_') AS act FROM {events}",
    # Class of an action: all-in is a push only beyond what is to be called
    "action_class": """
SELECT episode, ordinal, action, CASE action WHEN 'fold' THEN 'exit' WHEN 'check' THEN 'hold' WHEN 'call' THEN 'match' WHEN 'raise' THEN 'push' WHEN 'all_in' THEN CASE WHEN amount > to_call THEN 'push' ELSE 'match' END END AS cls FROM {events0}""",
    # Amounts per unit of the episode; nothing where the unit is 0
    "per_unit": "SELECT v.episode, v.ordinal, round(v.amount / nullif(e.unit, 0e0), 6) AS amount_units FROM {ev} v JOIN {episodes} e ON e.episode = v.episode",
    # What moves from one of the pair to the other
    "directed_transfer": """
SELECT lo, hi, episode, round(t_ab, 6) AS t_ab, round(t_ba, 6) AS t_ba, round(greatest(t_ab, t_ba), 6) AS t_max, round(t_ab + t_ba, 6) AS t_sum,
  round(abs(t_ab - t_ba), 6) AS t_gap, round((net_lo + net_hi) / nullif(unit, 0e0), 6) AS pair_net FROM {transfers}""",
    # Gaps of numbers and equality of categories of two members
    "match_attributes": """
WITH a AS (SELECT m.*, n.n_regionkey AS continent, CAST(floor(m.balance / 1e3) AS INT) AS level FROM {members} m LEFT JOIN {nation} n ON n.n_nationkey = m.region)
SELECT l.pool, l.lo, l.hi, round(abs(a.balance - b.balance), 4) AS balance_gap, abs(a.level - b.level) AS level_gap, CAST(a.level = b.level AS INT) AS same_level, CAST(a.region = b.region AS INT) AS same_region, CAST(a.continent = b.continent AS INT) AS same_continent, CAST((a.balance < 0e0) = (b.balance < 0e0) AS INT) AS same_sign
FROM {pair_labels} l JOIN a ON a.member = l.lo JOIN a b ON b.member = l.hi""",
    # Infinite values and nulls become the median, or 0 where there is none
    "impute_finite": """
SELECT v.lo, v.hi, v.episode, round(coalesce(v.x, m.mid, 0e0), 6) AS x FROM (
  SELECT lo, hi, episode, CASE WHEN t_ba > 0e0 THEN t_ab / t_ba WHEN t_ab > 0e0 THEN NULL ELSE 0e0 END AS x FROM {transfers}) v
CROSS JOIN {middle_ratio} m""",
    # Standardised by the development window and clipped
    "standardize_clip": """
SELECT t.lo, t.hi, t.episode, round(least(greatest((t.score - s.mean) / (s.sd + 1e-6), -5e0), 5e0), 6) AS z
FROM {scored} t CROSS JOIN (SELECT avg(score) AS mean, stddev_pop(score) AS sd FROM {scored} WHERE win = 'development') s""",
    # Clipped transforms
    "transforms": """
SELECT lo, hi, episode, round(ln(p / (1e0 - p)), 6) AS logit, round(1e0 / (1e0 + exp(-p)), 6) AS expit, round(ln(1e0 + p), 6) AS log1p, round(sign(p - 1e-1) * ln(1e0 + abs(p - 1e-1)), 6) AS signed_log
FROM {chances}""",
    # Surprisal of the observed class under a table of class shares
    "surprisal": """
SELECT v.episode, v.ordinal, round(-ln(greatest(q.share, 1e-6)), 6) AS surprisal
FROM {ev} v JOIN {class_shares} q ON q.stage = v.stage AND q.facing = CAST(v.to_call > 0e0 AS INT) AND q.act = v.act""",
}

RELATIONS = {
    "middle_ratio": quantiles("SELECT CASE WHEN t_ba > 0e0 THEN t_ab / t_ba WHEN t_ab > 0e0 THEN NULL ELSE 0e0 END AS x FROM {transfers}", (), "x", {"mid": 0.5}),
}
ORACLES = {
    "parse_token_list": """
SELECT p_partkey, CAST(n AS BIGINT) AS n_tokens, CAST(length(clean) - n + 1 AS BIGINT) AS n_letters, (SELECT CAST(sum(i * length(split_part(clean, ' ', CAST(i AS INT)))) AS BIGINT) FROM range(1, CAST(n AS BIGINT) + 1) AS t(i)) AS place_sum, first_token FROM (
  SELECT p_partkey, clean, length(clean) - length(replace(clean, ' ', '')) + 1 AS n, split_part(clean, ' ', 1) AS first_token
  FROM (SELECT p_partkey, trim(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g')) AS clean FROM {part}) t) u""",
}
