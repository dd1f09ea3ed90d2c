"""Dependence between partners and mixtures of active and idle episodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.operators.decoders import SLOT, _among_first, over_slots, slots, totals, with_ends
from tandem.plans.ordered import OnSpark, quantiles, stored
from tandem.sources.sinks import kept

# Decisions toward a target by classes of both strengths, and their shares in the other folds: q given both classes, z given one's own. Twelve to sixty rows a fold.
_CLASSES = """t AS (SELECT actor, target, act, CAST(floor(strength * 3e0) AS INT) AS own, CAST(floor(target_strength * 3e0) AS INT) AS partner, count(*) AS n FROM {toward} GROUP BY actor, target, act, CAST(floor(strength * 3e0) AS INT), CAST(floor(target_strength * 3e0) AS INT)),
c AS (SELECT t.*, ascii(substr(md5(CAST(m.pool AS VARCHAR(20))), 1, 1)) % 3 AS fold FROM t JOIN {members} m ON m.member = t.actor), k AS (SELECT fold, own, partner, act, sum(n) AS n FROM c GROUP BY fold, own, partner, act), f AS (SELECT DISTINCT fold FROM k),
o AS (SELECT f.fold, g.own, g.partner, g.act, g.n - coalesce(k.n, 0) + 5e-1 AS n FROM f CROSS JOIN (SELECT own, partner, act, sum(n) AS n FROM k GROUP BY own, partner, act) g LEFT JOIN k ON k.fold = f.fold AND k.own = g.own AND k.partner = g.partner AND k.act = g.act),
q AS (SELECT o.*, n / sum(n) OVER (PARTITION BY fold, own, partner) AS q, sum(n) OVER (PARTITION BY fold, own, act) / sum(n) OVER (PARTITION BY fold, own) AS z FROM o)"""

_ROUNDS = 20
_STRONG = lambda c: f"CAST(greatest(least(floor({c} * 3e0), 3e0), 0e0) AS INT)"
_GRID = [f"(SELECT {n} FROM (VALUES {v}) AS v({n})) {n}_" for n, v in (("fold", "(0), (1), (2)"), ("own", "(0), (1), (2), (3)"), ("act", "('exit'), ('hold'), ('match'), ('push')"), ("partner", "(0), (1), (2), (3)"), ("family", "(0), (1), (2)"))]


def mixture_rounds(rounds: int = _ROUNDS, start: float = 0.3) -> str:
    """SQL for the part alpha and the shares q of class_fits by rounds of window sums over {class_cells}; fit_class_mixture() gives the same."""
    each = "SELECT fold, family, own, partner, act, n, z"
    text = f"WITH e0 AS ({each}, {start!r}e0 AS alpha, (sum(n) OVER (PARTITION BY fold, family, partner, act) + 5e-1) / (sum(n) OVER (PARTITION BY fold, family, partner) + 2e0) AS q FROM {{class_cells}})"
    for i in range(rounds):
        text += f""", g{i} AS (SELECT *, n * alpha * q / ((1e0 - alpha) * z + alpha * q) AS g FROM e{i}), e{i + 1} AS ({each}, (sum(g) OVER (PARTITION BY fold, family) + 5e-1) / (sum(n) OVER (PARTITION BY fold, family) + 1e0) AS alpha,
  (sum(g) OVER (PARTITION BY fold, family, partner, act) + 5e-1) / (sum(g) OVER (PARTITION BY fold, family, partner) + 2e0) AS q FROM g{i})"""
    return f"{text} SELECT fold, family, partner, act, alpha, q FROM e{rounds} WHERE own = 0"


def fit_class_mixture(cells: DataFrame, rounds: int = _ROUNDS, start: float = 0.3) -> DataFrame:
    """EM for decisions that follow q(act | partner's class) with chance alpha and z(act | own class) otherwise.

    cells: fold, family, own, partner, act, n, z, a whole grid of classes with 0 where nothing was seen, so a few dozen rows for each (fold, family), whatever the data's size;
    only these go into the array in which the rounds run. Half a count is added to every q and to both sides of alpha: without decisions q is even and alpha a half.
    Returns fold, family, partner, act, alpha, q.
    """
    cell = "'own', c.own, 'partner', c.partner, 'act', c.act, 'n', c.n, 'z', c.z"
    total = lambda what, where="": f"aggregate({f'filter(w, d -> {where})' if where else 'w'}, 0e0, (a, d) -> a + d.{what})"
    same, partner = "d.partner = c.partner AND d.act = c.act", "d.partner = c.partner"
    shares = lambda g: f"transform(w, c -> named_struct({cell}, 'q', ({total(g, same)} + 5e-1) / ({total(g, partner)} + 2e0)))"
    expected = f"transform(s.cells, c -> named_struct({cell}, 'g', c.n * s.alpha * c.q / ((1e0 - s.alpha) * c.z + s.alpha * c.q)))"
    step = f"transform(array({expected}), w -> named_struct('alpha', ({total('g')} + 5e-1) / ({total('n')} + 1e0), 'cells', {shares('g')}))[0]"
    rows = cells.groupBy("fold", "family").agg(F.array_sort(F.collect_list(F.struct("own", "partner", "act", F.col("n").cast("double").alias("n"), F.col("z").cast("double").alias("z")))).alias("w"))
    fitted = rows.withColumn("s", F.expr(f"aggregate(sequence(1, {rounds}), named_struct('alpha', {start!r}D, 'cells', {shares('n')}), (s, i) -> {step})"))
    return fitted.select("fold", "family", F.col("s.alpha").alias("alpha"), F.explode("s.cells").alias("c")).where("c.own = 0").select("fold", "family", "c.partner", "c.act", "alpha", "c.q")


_PAIR_CLASSES = f"""
WITH t AS (SELECT actor, target, act, {_STRONG("strength")} AS own, {_STRONG("target_strength")} AS partner, count(*) AS n FROM {{toward}} GROUP BY actor, target, act, {_STRONG("strength")}, {_STRONG("target_strength")})
SELECT t.*, ascii(substr(md5(CAST(m.pool AS VARCHAR(20))), 1, 1)) % 3 AS fold, l.label, l.family FROM t JOIN {{members}} m ON m.member = t.actor LEFT JOIN {{pair_labels}} l ON l.lo = least(t.actor, t.target) AND l.hi = greatest(t.actor, t.target)"""

#: On Spark a pair is one row: its counts of decisions by direction, act and both classes, 128 at the most. So decisions are sent once, as narrow rows, and nothing that is found of pairs from then on.
_BAG = f"""
SELECT least(actor, target) AS lo, greatest(actor, target) AS hi, CAST(CASE WHEN actor < target THEN 0 ELSE 64 END + CASE act WHEN 'exit' THEN 0 WHEN 'hold' THEN 1 WHEN 'match' THEN 2 ELSE 3 END * 16 + {_STRONG("strength")} * 4 + {_STRONG("target_strength")} AS TINYINT) AS code FROM {{toward}}"""
_CLASS_BAGS = f"""
WITH r AS (SELECT /*+ REPARTITION(lo, hi) */ * FROM ({_BAG}) t), c AS (SELECT lo, hi, code, count(*) AS n FROM r GROUP BY lo, hi, code), b AS (SELECT lo, hi, collect_list(struct(CAST(code AS INT) AS code, n)) AS codes FROM c GROUP BY lo, hi)
SELECT b.*, ascii(substr(md5(CAST(m.pool AS VARCHAR(20))), 1, 1)) % 3 AS fold_lo, ascii(substr(md5(CAST(n.pool AS VARCHAR(20))), 1, 1)) % 3 AS fold_hi, l.label, l.family FROM b LEFT JOIN {{members}} m ON m.member = b.lo LEFT JOIN {{members}} n ON n.member = b.hi LEFT JOIN {{pair_labels}} l ON l.lo = b.lo AND l.hi = b.hi"""
#: pair_classes from there; who is in no pool is in no fold and counts nowhere
_EACH_CLASS = """
SELECT CASE WHEN x.code < 64 THEN lo ELSE hi END AS actor, CASE WHEN x.code < 64 THEN hi ELSE lo END AS target, element_at(array('exit', 'hold', 'match', 'push'), CAST(x.code DIV 16 % 4 AS INT) + 1) AS act, CAST(x.code DIV 4 % 4 AS INT) AS own, x.code % 4 AS partner, x.n, CASE WHEN x.code < 64 THEN fold_lo ELSE fold_hi END AS fold, label, family
FROM (SELECT *, explode(codes) AS x FROM {class_bags}) t WHERE CASE WHEN x.code < 64 THEN fold_lo ELSE fold_hi END IS NOT NULL"""
_ACT = "CASE f.act WHEN 'exit' THEN 0 WHEN 'hold' THEN 1 WHEN 'match' THEN 2 ELSE 3 END"
_CLASS_LOGS = f"SELECT (f.fold * 3 + f.family) * 64 + {_ACT} * 16 + z.own * 4 + f.partner AS at, ln(1e0 - f.alpha + f.alpha * f.q / z.z) AS l FROM {{class_fits}} f JOIN {{class_controls}} z ON z.fold = f.fold AND z.act = f.act"


def _class_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem import catalog

    return catalog.relations().frame(spark, "SELECT * FROM {class_llrs}", catalog.Tables(spark, sf_dir))


def class_llrs(bags: DataFrame, logs: DataFrame) -> DataFrame:
    """What the SQL of class_mixture_llr gives, inside the rows of {class_bags}; logs (at, l): the logarithm of each fold, family, act and both classes, 576 by construction, which go into the expression as an array."""
    known = F.array(*(F.lit(r["l"]) for r in logs.orderBy("at").collect()))
    one = lambda mine, fold, family: F.aggregate(F.filter("codes", mine), F.lit(0.0), lambda s, x: s + x["n"] * F.element_at(known, (F.col(fold) * 3 + family) * 64 + x["code"] % 64 + 1))
    ways = ((lambda x: x["code"] < 64, "fold_lo"), (lambda x: x["code"] >= 64, "fold_hi"))
    seen = lambda mine, fold, value: F.when(F.col(fold).isNotNull() & (F.size(F.filter("codes", mine)) > 0), value)
    n = [seen(mine, fold, F.aggregate(F.filter("codes", mine), F.lit(0).cast("long"), lambda s, x: s + x["n"])) for mine, fold in ways]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("family"), *(seen(mine, fold, one(mine, fold, k)).alias(name) for name, (mine, fold) in zip("ab", ways, strict=True))) for k in range(3)))).alias("x")
    rows = bags.select("lo", "hi", (F.coalesce(n[0], F.lit(0)) + F.coalesce(n[1], F.lit(0))).alias("n"), each).where("n > 0")
    return rows.select("lo", "hi", "x.family", "n", F.expr("round(coalesce(x.a, 0e0) + coalesce(x.b, 0e0), 6) AS llr"), F.expr("round(least(x.a, x.b), 6) AS weaker"), F.expr("round(greatest(x.a, x.b), 6) AS stronger"))


OPERATORS = {
    # Residual of the first decision, made before the partner acts, times the partner's strength; either member as the first
    "score_test_partner_info": f"""
WITH r AS (SELECT lo, hi, o_lo < o_hi AS lo_first, x * (1e0 - x) AS v_exit, u * (1e0 - u) AS v_push, CASE WHEN o_lo < o_hi THEN s_hi ELSE s_lo END - m AS e, CASE WHEN CASE WHEN o_lo < o_hi THEN act_lo ELSE act_hi END = 'exit' THEN 1e0 ELSE 0e0 END - x AS r_exit, CASE WHEN CASE WHEN o_lo < o_hi THEN act_lo ELSE act_hi END = 'push' THEN 1e0 ELSE 0e0 END - u AS r_push FROM {{first_pairs}}),
d AS (SELECT lo, hi, count(*) AS n, {", ".join(f"coalesce(sum(CASE WHEN {c} THEN r_{a} * e END) / sqrt(sum(CASE WHEN {c} THEN v_{a} * e * e END) + 1e-9), 0e0) AS z_{a}_{s}" for a in ("exit", "push") for c, s in (("lo_first", "lo"), ("NOT lo_first", "hi")))} FROM r GROUP BY lo, hi)
SELECT lo, hi, n, round(z_exit_lo * z_exit_lo + z_push_lo * z_push_lo + z_exit_hi * z_exit_hi + z_push_hi * z_push_hi, 5) AS chi2, round(greatest(abs(z_exit_lo), abs(z_exit_hi)), 6) AS z_exit_max, round(greatest(z_push_lo, z_push_hi), 6) AS z_push_max,
  round(z_push_lo - z_exit_lo, 6) AS lo_leans, round(z_push_hi - z_exit_hi, 6) AS hi_leans FROM d""",
    # The one who acts second
    "responder_score_test": """
WITH t AS (SELECT lo, hi, o_lo < o_hi AS hi_answers, CASE WHEN CASE WHEN o_lo < o_hi THEN act_hi ELSE act_lo END = 'exit' THEN 1e0 ELSE 0e0 END - x AS r, x * (1e0 - x) AS v, CASE WHEN o_lo < o_hi THEN s_lo ELSE s_hi END - m AS e FROM {first_pairs})
SELECT lo, hi, count(*) AS n, round(sum(r * e) / sqrt(sum(v * e * e) + 1e-9), 6) AS z, round(coalesce(sum(CASE WHEN hi_answers THEN r * e END) / sqrt(sum(CASE WHEN hi_answers THEN v * e * e END) + 1e-9), 0e0), 6) AS z_hi, round(coalesce(sum(CASE WHEN NOT hi_answers THEN r * e END) / sqrt(sum(CASE WHEN NOT hi_answers THEN v * e * e END) + 1e-9), 0e0), 6) AS z_lo FROM t GROUP BY lo, hi""",
    # Decisions after the first, while the partner is there; summed by episode, then by pair
    "later_decision_stat": """
WITH h AS (SELECT member AS actor, target, episode, sum((CASE WHEN act = 'push' THEN 1e0 ELSE 0e0 END - q_push - (CASE WHEN act = 'exit' THEN 1e0 ELSE 0e0 END - q_exit)) * (target_strength - 5e-1)) AS s, sum((q_push * (1e0 - q_push) + q_exit * (1e0 - q_exit) + 2e0 * q_push * q_exit) * (target_strength - 5e-1) * (target_strength - 5e-1)) AS v, count(*) AS n
  FROM {aimed} WHERE here = 1 AND own_no > 1 GROUP BY member, target, episode)
SELECT actor, target, CAST(sum(n) AS BIGINT) AS n, count(*) AS episodes, round(sum(s) / sqrt(sum(v) + 1e-9), 6) AS z FROM h GROUP BY actor, target""",
    # Two statistics standardised on negatives and added, against the negatives' upper quantiles
    "null_calibrated_combine": """
SELECT c.lo, c.hi, round(z, 6) AS combined, CAST(z > q90 AS INT) AS over90, CAST(z > q99 AS INT) AS over99 FROM {combined_scores} c CROSS JOIN {combined_quantiles} q""",
    "tilt_llr": "SELECT episode, actor, target, round(sum(l), 6) AS llr FROM {tilts} GROUP BY episode, actor, target",
    # Log Bayes factor of a share of active episodes, and where it stands among pairs of like exposure that are not positive
    "pair_bayes_factor": """
WITH z AS (SELECT exposure, avg(lbf) AS mean, stddev_samp(lbf) AS sd FROM {pair_bayes} WHERE label = 0 OR label IS NULL GROUP BY exposure)
SELECT x.actor, x.target, x.n, round(x.lbf, 6) AS lbf, x.exposure, round((x.lbf - z.mean) / nullif(z.sd, 0e0), 5) AS z, CAST(x.lbf > q.q95 AS INT) AS over95 FROM {pair_bayes} x LEFT JOIN z ON z.exposure = x.exposure LEFT JOIN {bayes_quantiles} q ON q.exposure = x.exposure""",
    # Over a grid of sizes and activities, with the activity and the size to expect after it
    "sparse_activity_lbf": """
WITH h AS (SELECT actor, target, episode, delta, sum(l) AS l FROM {tilts_by_size} GROUP BY actor, target, episode, delta), g AS (SELECT rho FROM (VALUES (2e-2), (1e-1), (5e-1)) AS v(rho)),
b AS (SELECT actor, target, delta, rho, count(*) AS n, sum(ln(1e0 - rho + rho * exp(l))) AS lbf, avg(rho * exp(l) / (1e0 - rho + rho * exp(l))) AS active FROM h CROSS JOIN g GROUP BY actor, target, delta, rho), m AS (SELECT b.*, max(lbf) OVER (PARTITION BY actor, target) AS m FROM b)
SELECT actor, target, max(n) AS n, round(max(lbf), 6) AS best, round(max(m) + ln(sum(exp(lbf - m)) / 9e0), 6) AS averaged, round(sum(exp(lbf - m) * active) / sum(exp(lbf - m)), 6) AS active, round(sum(exp(lbf - m) * delta) / sum(exp(lbf - m)), 6) AS delta FROM m GROUP BY actor, target""",
    # For each family, decisions by classes of the partner's strength mixed with those by one's own, against one's own alone; all shares come from pairs of the other folds
    "class_mixture_llr": """
WITH l AS (SELECT c.actor, c.target, f.family, sum(c.n) AS n, sum(c.n * ln(1e0 - f.alpha + f.alpha * f.q / z.z)) AS llr FROM {pair_classes} c JOIN {class_fits} f ON f.fold = c.fold AND f.partner = c.partner AND f.act = c.act JOIN {class_controls} z ON z.fold = c.fold AND z.own = c.own AND z.act = c.act GROUP BY c.actor, c.target, f.family)
SELECT least(actor, target) AS lo, greatest(actor, target) AS hi, family, CAST(sum(n) AS BIGINT) AS n, round(sum(llr), 6) AS llr, round(min(llr), 6) AS weaker, round(max(llr), 6) AS stronger FROM l GROUP BY least(actor, target), greatest(actor, target), family""",
    "class_mixture_fit": "SELECT fold, family, partner, act, round(alpha, 8) AS alpha, round(q, 8) AS q FROM {class_fits}",
    # Would the decision be likelier with the partner's strength in place of one's own; the share of such decisions is taken for each stage from a grid
    "substitution_llr": """
WITH c AS (SELECT CAST(floor(strength * 4e0) AS INT) AS bin, act, count(*) AS n FROM {ev} GROUP BY CAST(floor(strength * 4e0) AS INT), act), q AS (SELECT bin, act, (n + 5e-1) / sum(n + 5e-1) OVER (PARTITION BY bin) AS q FROM c),
r AS (SELECT /*+ BROADCAST(o), BROADCAST(s) */ t.actor, t.target, t.stage, s.q / o.q AS ratio FROM {toward} t JOIN q o ON o.bin = CAST(floor(t.strength * 4e0) AS INT) AND o.act = t.act JOIN q s ON s.bin = CAST(floor(t.target_strength * 4e0) AS INT) AND s.act = t.act),
g AS (SELECT a FROM (VALUES (5e-2), (1e-1), (2e-1), (4e-1)) AS v(a)), l AS (SELECT actor, target, stage, a, count(*) AS n, sum(ln(1e0 - a + a * ratio)) AS llr, max(ratio) AS most FROM r CROSS JOIN g GROUP BY actor, target, stage, a),
b AS (SELECT stage, max_by(a, round(llr, 6)) AS a FROM (SELECT stage, a, sum(llr) AS llr FROM l GROUP BY stage, a) t GROUP BY stage)
SELECT l.actor, l.target, CAST(sum(l.n) AS BIGINT) AS n, round(sum(l.llr), 6) AS llr, round(max(l.a * most / (1e0 - l.a + l.a * most)), 6) AS most FROM l JOIN b ON b.stage = l.stage AND b.a = l.a GROUP BY l.actor, l.target""",
    # What the partner's strength adds to the log likelihood of decisions, by models of the other folds without and with it
    "conditional_gain": f"""
WITH {_CLASSES}
SELECT least(c.actor, c.target) AS lo, greatest(c.actor, c.target) AS hi, CAST(sum(c.n) AS BIGINT) AS n, round(sum(c.n * ln(q.q / q.z)), 6) AS gain, round(sum(c.n * ln(q.q / q.z)) / sum(c.n), 8) AS mean_gain FROM c JOIN q ON q.fold = c.fold AND q.own = c.own AND q.partner = c.partner AND q.act = c.act GROUP BY least(c.actor, c.target), greatest(c.actor, c.target)""",
}

RELATIONS = {
    "pair_classes": OnSpark(_PAIR_CLASSES, lambda frame: frame(_EACH_CLASS)),
    "class_bags": stored(_CLASS_BAGS),
    "class_llrs": OnSpark("", lambda frame: class_llrs(frame("SELECT * FROM {class_bags}"), frame(_CLASS_LOGS))),
    # shares of actions by one's own class in the other folds' pairs known not to be positive
    "class_controls": stored(f"""
WITH k AS (SELECT fold, own, act, sum(n) AS n FROM {{pair_classes}} WHERE label = 0 GROUP BY fold, own, act),
c AS (SELECT fold_.fold, own_.own, act_.act, coalesce(sum(k.n), 0) + 5e-1 AS n FROM {_GRID[0]} CROSS JOIN {_GRID[1]} CROSS JOIN {_GRID[2]} LEFT JOIN k ON k.own = own_.own AND k.act = act_.act AND k.fold <> fold_.fold GROUP BY fold_.fold, own_.own, act_.act)
SELECT fold, own, act, n / sum(n) OVER (PARTITION BY fold, own) AS z FROM c"""),
    # decisions of a family's positive pairs of the other folds, beside those shares: 64 rows for each fold and family
    "class_cells": f"""
WITH k AS (SELECT fold, family, own, partner, act, sum(n) AS n FROM {{pair_classes}} WHERE label = 1 GROUP BY fold, family, own, partner, act)
SELECT z.fold, family_.family, z.own, partner_.partner, z.act, CAST(coalesce(sum(k.n), 0) AS DOUBLE) AS n, max(z.z) AS z FROM {{class_controls}} z CROSS JOIN {_GRID[3]} CROSS JOIN {_GRID[4]}
LEFT JOIN k ON k.family = family_.family AND k.own = z.own AND k.partner = partner_.partner AND k.act = z.act AND k.fold <> z.fold GROUP BY z.fold, family_.family, z.own, partner_.partner, z.act""",
    "class_fits": OnSpark(mixture_rounds(), lambda frame: kept(fit_class_mixture(frame("SELECT * FROM {class_cells}")))),
    "combined_scores": stored("""
WITH s AS (SELECT p.lo, p.hi, p.score AS a, p.top AS b, p.label FROM {pair_scores} p), n AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM s WHERE label = 0)
SELECT s.lo, s.hi, s.label, ((a - ma) / nullif(sa, 0e0) + (b - mb) / nullif(sb, 0e0)) / sqrt(2e0) AS z FROM s CROSS JOIN n"""),
    "combined_quantiles": quantiles("SELECT z FROM {combined_scores} WHERE label = 0", (), "z", {"q90": 0.9, "q99": 0.99}),
    "pair_bayes": stored("""
WITH h AS (SELECT actor, target, episode, sum(l) AS l FROM {tilts} GROUP BY actor, target, episode), b AS (SELECT actor, target, count(*) AS n, sum(ln(9e-1 + 1e-1 * exp(l))) AS lbf FROM h GROUP BY actor, target)
SELECT b.*, CAST(floor(ln(n) / ln(2e0) + 1e-9) AS INT) AS exposure, l.label FROM b LEFT JOIN {pair_labels} l ON l.lo = least(b.actor, b.target) AND l.hi = greatest(b.actor, b.target)"""),
    "bayes_quantiles": quantiles("SELECT exposure, lbf FROM {pair_bayes} WHERE label = 0 OR label IS NULL", ("exposure",), "lbf", {"q95": 0.95}),
    "first_pairs": """
SELECT e.lo, e.hi, e.episode, e.act_lo, e.act_hi, e.s_lo, e.s_hi, e.o_lo, e.o_hi, r.x, r.u, r.m FROM {entries} e
CROSS JOIN (SELECT avg(CASE WHEN act = 'exit' THEN 1e0 ELSE 0e0 END) AS x, avg(CASE WHEN act = 'push' THEN 1e0 ELSE 0e0 END) AS u, avg(strength) AS m FROM {first_decisions}) r""",
    # log likelihood ratio of each decision if pushes and exits lean on the partner's strength
    "tilts": """
SELECT episode, member AS actor, target, (target_strength - 5e-1) * CASE act WHEN 'push' THEN 1e0 WHEN 'exit' THEN -1e0 ELSE 0e0 END - ln(q_push * exp(target_strength - 5e-1) + q_exit * exp(5e-1 - target_strength) + 1e0 - q_push - q_exit) AS l FROM {aimed} WHERE here = 1""",
    "tilts_by_size": """
SELECT episode, member AS actor, target, delta, delta * (target_strength - 5e-1) * CASE act WHEN 'push' THEN 1e0 WHEN 'exit' THEN -1e0 ELSE 0e0 END - ln(q_push * exp(delta * (target_strength - 5e-1)) + q_exit * exp(delta * (5e-1 - target_strength)) + 1e0 - q_push - q_exit) AS l
FROM {aimed} CROSS JOIN (SELECT delta FROM (VALUES (5e-1), (1e0), (2e0)) AS v(delta)) d WHERE here = 1""",
}


def em_mixture_rate(llrs: DataFrame, rounds: int = 10, start: float = 0.1) -> DataFrame:
    """By group the share of active episodes, from episode log likelihood ratios (actor, target, episode, l), after a fixed number of EM rounds.

    The rounds run inside the group's array of ratios, that is one pair's episodes.
    """
    rows = llrs.groupBy("actor", "target").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    step = lambda pi, _: F.aggregate("ls", F.lit(0.0), lambda a, x: a + pi * F.exp(x) / (1 - pi + pi * F.exp(x))) / F.size("ls")
    fitted = rows.withColumn("rate", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(start), step))
    return fitted.select("actor", "target", "rate", F.aggregate("ls", F.lit(0.0), lambda a, x: a + F.log(1 - F.col("rate") + F.col("rate") * F.exp(x))).alias("llr"))


def episodic_activity(llrs: DataFrame, stay: float = 0.9, share: float = 0.1, slot: int = SLOT) -> DataFrame:
    """A chain with an idle and an active state over a group's episodes: log Bayes factor against always idle, and for each episode the active state's smoothed chance.

    llrs: actor, target, episode, l; episodes are ordered by number; share is the chance to be active before the first, stay that to remain in a state. A slot of a group's
    episodes is one 2 x 2 matrix, from the state before it to that at its end, kept within range by its logarithm; the matrices of a group are walked in order from both sides. Inside a
    slot a fold forward keeps the chance of being active so far, one backward the ratio of what follows if active to what follows if idle.
    """
    keys = ("actor", "target")
    cut = slots(llrs.select(*keys, "episode", "l"), keys, ("episode",), slot)
    empty = F.array().cast("array<double>")
    names = ("ii", "ia", "ai", "aa")

    def further(m: Column, x: Column) -> Column:
        new = {}
        for s in "ia":
            new[s + "i"] = m[s + "i"] * stay + m[s + "a"] * (1 - stay)
            new[s + "a"] = (m[s + "i"] * (1 - stay) + m[s + "a"] * stay) * F.exp(x["l"])
        most = F.greatest(*new.values())
        return F.struct(*((new[n] / most).alias(n) for n in names), (m["log"] + F.log(most)).alias("log"))

    identity = F.struct(*(F.lit(float(n[0] == n[1])).alias(n) for n in names), F.lit(0.0).alias("log"))
    whole = F.struct("_slot", F.aggregate("r", identity, further).alias("m")).alias("_s")
    groups = cut.where("NOT _only").select(*keys, whole).groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("_s"))

    def on(a: Column, x: Column) -> Column:
        m, p = x["m"], a["p"]
        idle, active = (1 - p) * m["ii"] + p * m["ai"], (1 - p) * m["ia"] + p * m["aa"]
        return F.struct((active / (idle + active)).alias("p"), (a["lbf"] + F.log(idle + active) + m["log"]).alias("lbf"), F.concat(a["out"], F.array(p)).alias("out"))

    def back(a: Column, x: Column) -> Column:
        m, v = x["m"], a["v"]
        return F.struct(((m["ai"] + m["aa"] * v) / (m["ii"] + m["ia"] * v)).alias("v"), F.concat(a["out"], F.array(v)).alias("out"))

    start = F.struct(F.lit(share).alias("p"), F.lit(0.0).alias("lbf"), empty.alias("out"))
    walked = groups.select(
        *keys,
        F.col("_s._slot").alias("_slot"),
        F.aggregate("_s", start, on).alias("f"),
        F.reverse(F.aggregate(F.reverse("_s"), F.struct(F.lit(1.0).alias("v"), empty.alias("out")), back)["out"]).alias("v"),
    )
    alone = cut.where("_only").select(*keys, "_slot", "r", whole).select(*keys, "_slot", "r", on(start, F.col("_s"))["lbf"].alias("lbf"), F.lit(share).alias("p"), F.lit(1.0).alias("v"))
    ends = walked.select(*keys, F.col("f.lbf").alias("lbf"), F.explode(F.arrays_zip("_slot", F.col("f.out").alias("p"), "v")).alias("x")).select(*keys, "lbf", "x.*")
    ahead = lambda p: p * stay + (1 - p) * (1 - stay)
    active = lambda p, x: ahead(p) * F.exp(x["l"]) / (1 - ahead(p) + ahead(p) * F.exp(x["l"]))
    # v: chance of what follows given active now, over that given idle now
    step = lambda v, x: (stay * F.exp(x["l"]) * v + (1 - stay)) / ((1 - stay) * F.exp(x["l"]) * v + stay)
    forward = F.aggregate("r", F.struct(F.col("p").alias("p"), empty.alias("out")), lambda a, x: F.struct(active(a["p"], x).alias("p"), F.concat(a["out"], F.array(active(a["p"], x))).alias("out")))["out"]
    backward = F.aggregate(F.reverse("r"), F.struct(F.col("v").alias("v"), empty.alias("out")), lambda a, x: F.struct(step(a["v"], x).alias("v"), F.concat(a["out"], F.array(a["v"])).alias("out")))["out"]
    met = alone.unionByName(cut.where("NOT _only").drop("_only").join(ends, [*keys, "_slot"]))
    each = met.select(*keys, "lbf", F.explode(F.arrays_zip("r", forward.alias("p"), F.reverse(backward).alias("v"))).alias("x"))
    return each.select(*keys, "x.r.episode", "lbf", (F.col("x.p") * F.col("x.v") / (F.col("x.p") * F.col("x.v") + 1 - F.col("x.p"))).alias("active"))


def rate_nodes(mean: float = 0.1, strength: float = 10.0, nodes: int = 16) -> list[tuple[float, float]]:
    """(rate, weight) of evenly spaced rates under a Beta law of that mean and strength (the sum of its two parameters)."""
    rates = [(i + 0.5) / nodes for i in range(nodes)]
    raw = [r ** (mean * strength - 1) * (1 - r) ** ((1 - mean) * strength - 1) for r in rates]
    return [(r, w / sum(raw)) for r, w in zip(rates, raw, strict=True)]


def random_rate_marginal(llrs: DataFrame, mean: float = 0.1, strength: float = 10.0, nodes: int = 16) -> DataFrame:
    """Log marginal likelihood ratio of a group whose share of active episodes is drawn from a Beta law, and the share to expect after it.

    Each row meets all of the law's nodes at once, as sums beside one another, and these are combined by log-sum-exp.
    """
    law = rate_nodes(mean, strength, nodes)
    sums = totals(llrs.select("actor", "target", "l"), ("actor", "target"), [F.sum(F.log(1 - r + r * F.exp("l"))).alias(f"s{i}") for i, (r, _) in enumerate(law)])
    met = sums.withColumn("m", F.greatest(*(f"s{i}" for i in range(nodes))) if nodes > 1 else F.col("s0"))
    total = lambda f: reduce(lambda a, b: a + b, [F.exp(F.col(f"s{i}") - F.col("m")) * (w * f(r)) for i, (r, w) in enumerate(law)])
    return met.select("actor", "target", (F.col("m") + F.log(total(lambda _: 1.0))).alias("llr"), (total(lambda r: r) / total(lambda _: 1.0)).alias("rate"))


def random_rate_first_k(llrs: DataFrame, k: int = 5, mean: float = 0.1, strength: float = 10.0, nodes: int = 8, slot: int = SLOT) -> DataFrame:
    """first_k_marginal() (I3) for each node of the rate's law, averaged with the nodes' weights after the group's episodes.

    A group's rows are gathered once, and all nodes are folded over the same slots.
    """
    keys, law = ("actor", "target"), rate_nodes(mean, strength, nodes)
    active = lambda r: F.aggregate("r", F.lit(0.0), lambda a, x: a + F.log(1 - r + r * F.exp(x["l"])))
    listed = lambda i, p: F.transform(_among_first("r", p, F.col(f"before{i}"), k), lambda x: F.col(f"w{i}") * x)
    chance = [lambda x, r=r: r * F.exp(x["l"]) / (1 - r + r * F.exp(x["l"])) for r, _ in law]
    cut = slots(llrs.select(*keys, "episode", "l"), keys, ("episode",), slot)
    cut = over_slots(cut, keys, {f"s{i}": active(r) for i, (r, _) in enumerate(law)})
    cut = with_ends(cut, keys, {f"before{i}": (p, k) for i, p in enumerate(chance)})
    logs = [F.log(F.lit(w)) + F.col(f"s{i}") for i, (_, w) in enumerate(law)]
    cut = cut.withColumn("m", F.greatest(*logs) if nodes > 1 else logs[0]).withColumns({f"w{i}": F.exp(x - F.col("m")) for i, x in enumerate(logs)})
    found = {f"d{i}": listed(i, p) for i, p in enumerate(chance)}
    each = cut.withColumns(found).select(*keys, reduce(lambda a, b: a + b, [F.col(f"w{i}") for i in range(nodes)]).alias("w"), F.explode(F.arrays_zip("r", *found)).alias("x"))
    return each.select(*keys, "x.r.episode", (reduce(lambda a, b: a + b, [F.col(f"x.{d}") for d in found]) / F.col("w")).alias("decoded"))


def permutation_null(seed: int = 7, n: int = 40) -> str:
    """SQL for the number of listed episodes that directly follow another one, and the mean gap between them, against n random relabellings: the last listed episode stays, the others are drawn anew from those before it."""
    draws = ", ".join(f"({i})" for i in range(n))
    return f"""
WITH a AS (SELECT s.lo, s.hi, s.episode, row_number() OVER (PARTITION BY s.lo, s.hi ORDER BY s.ts, s.episode) AS i, CASE WHEN g.episode IS NOT NULL THEN 1 ELSE 0 END AS y
  FROM {{scored}} s JOIN (SELECT DISTINCT lo, hi FROM {{listed}}) k ON k.lo = s.lo AND k.hi = s.hi LEFT JOIN {{listed}} g ON g.lo = s.lo AND g.hi = s.hi AND g.episode = s.episode),
c AS (SELECT lo, hi, sum(y) AS m, max(CASE WHEN y = 1 THEN i END) AS last_i FROM a GROUP BY lo, hi), o AS (SELECT a.*, c.m, c.last_i FROM a JOIN c ON c.lo = a.lo AND c.hi = a.hi WHERE a.i <= c.last_i), k AS (SELECT id FROM (VALUES {draws}) AS v(id)),
d AS (SELECT o.lo, o.hi, o.i, o.m, k.id, row_number() OVER (PARTITION BY o.lo, o.hi, k.id ORDER BY CASE WHEN o.i = o.last_i THEN 0 ELSE 1 END, md5(concat(CAST(o.episode AS VARCHAR(20)), '-', CAST(k.id AS VARCHAR(20)), '-{seed}')), o.episode) AS r FROM o CROSS JOIN k),
p AS (SELECT lo, hi, id, i, lag(i) OVER (PARTITION BY lo, hi, id ORDER BY i) AS was FROM d WHERE r <= m), z AS (SELECT lo, hi, id, count(CASE WHEN i = was + 1 THEN 1 END) AS adjacent, avg(i - was) AS gap FROM p GROUP BY lo, hi, id),
s AS (SELECT lo, hi, count(CASE WHEN i = was + 1 THEN 1 END) AS adjacent, avg(i - was) AS gap FROM (SELECT lo, hi, i, lag(i) OVER (PARTITION BY lo, hi ORDER BY i) AS was FROM a WHERE y = 1) t GROUP BY lo, hi)
SELECT s.lo, s.hi, s.adjacent, round(s.gap, 6) AS gap, round(avg(z.adjacent), 6) AS by_chance, round(avg(z.gap), 6) AS gap_by_chance, round((count(CASE WHEN z.adjacent >= s.adjacent THEN 1 END) + 1) / CAST(count(*) + 1 AS DOUBLE), 6) AS p_value FROM s JOIN z ON z.lo = s.lo AND z.hi = s.hi GROUP BY s.lo, s.hi, s.adjacent, s.gap"""


OPERATORS["permutation_null"] = permutation_null()


def _llrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem import catalog

    return catalog.relations().frame(spark, "SELECT actor, target, episode, sum(l) AS l FROM {tilts} GROUP BY actor, target, episode", catalog.Tables(spark, sf_dir))


_SIZES, _SHARES = (0.5, 1.0, 2.0), (0.02, 0.1, 0.5)


def sparse_activity_lbf(llrs: DataFrame) -> DataFrame:
    """From episodes with a log likelihood ratio for each size (actor, target, l0, l1, ...), sums for all sizes and shares of active episodes side by side; returns what the SQL does."""
    grid = [(i, d, rho, F.exp(f"l{i}")) for i, d in enumerate(_SIZES) for rho in _SHARES]
    sums = [F.sum(F.log(1 - rho + rho * e)).alias(f"b{j}") for j, (_, _, rho, e) in enumerate(grid)] + [F.avg(rho * e / (1 - rho + rho * e)).alias(f"a{j}") for j, (_, _, rho, e) in enumerate(grid)]
    met = totals(llrs, ("actor", "target"), [F.count(F.lit(1)).alias("n"), *sums]).withColumn("m", F.greatest(*(f"b{j}" for j in range(len(grid)))))
    total = lambda f: reduce(lambda a, b: a + b, [F.exp(F.col(f"b{j}") - F.col("m")) * f(j, d) for j, (_, d, _, _) in enumerate(grid)])
    weight = total(lambda j, d: F.lit(1.0))
    found = {"best": F.col("m"), "averaged": F.col("m") + F.log(weight / float(len(grid))), "active": total(lambda j, d: F.col(f"a{j}")) / weight, "delta": total(lambda j, d: F.lit(d)) / weight}
    return met.select("actor", "target", "n", *(F.round(x, 6).alias(name) for name, x in found.items()))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log likelihood ratios of episodes as in {tilts_by_size}, the sizes side by side."""
    from tandem import catalog

    each = ", ".join(f"sum({d!r}D * (target_strength - 5e-1) * CASE act WHEN 'push' THEN 1e0 WHEN 'exit' THEN -1e0 ELSE 0e0 END - ln(q_push * exp({d!r}D * (target_strength - 5e-1)) + q_exit * exp({d!r}D * (5e-1 - target_strength)) + 1e0 - q_push - q_exit)) AS l{i}" for i, d in enumerate(_SIZES))
    return catalog.relations().frame(spark, f"SELECT actor, target, {', '.join(f'l{i}' for i in range(len(_SIZES)))} FROM (SELECT member AS actor, target, episode, {each} FROM {{aimed}} WHERE here = 1 GROUP BY episode, member, target) t", catalog.Tables(spark, sf_dir))


#: substitution_llr on Spark: the grid's sums are taken for stages alone, and only those of the share chosen go to the pairs. The posterior grows with the ratio, so the greatest is that of the greatest ratio.
_SUBSTITUTION = """
WITH c AS (SELECT CAST(floor(strength * 4e0) AS INT) AS bin, act, count(*) AS n FROM {ev} GROUP BY CAST(floor(strength * 4e0) AS INT), act), q AS (SELECT bin, act, (n + 5e-1) / sum(n + 5e-1) OVER (PARTITION BY bin) AS q FROM c),
r AS (SELECT /*+ BROADCAST(o), BROADCAST(s) */ t.actor, t.target, t.stage, s.q / o.q AS ratio FROM {toward} t JOIN q o ON o.bin = CAST(floor(t.strength * 4e0) AS INT) AND o.act = t.act JOIN q s ON s.bin = CAST(floor(t.target_strength * 4e0) AS INT) AND s.act = t.act),
g AS (SELECT stage, SUMS FROM r GROUP BY stage), l AS (SELECT stage, stack(4, ROWS) AS (a, llr) FROM g), b AS (SELECT stage, max_by(a, round(llr, 6)) AS a FROM l GROUP BY stage)
SELECT actor, target, count(*) AS n, round(sum(ln(1e0 - a + a * ratio)), 6) AS llr, round(max(a * ratio / (1e0 - a + a * ratio)), 6) AS most FROM (SELECT /*+ BROADCAST(b) */ r.actor, r.target, r.ratio, b.a FROM r JOIN b ON b.stage = r.stage) t GROUP BY actor, target"""
_GRID_A = ("5e-2", "1e-1", "2e-1", "4e-1")
_SUBSTITUTION = _SUBSTITUTION.replace("SUMS", ", ".join(f"sum(ln(1e0 - {a} + {a} * ratio)) AS l{i}" for i, a in enumerate(_GRID_A))).replace("ROWS", ", ".join(f"{a}, l{i}" for i, a in enumerate(_GRID_A)))


def _substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem import catalog

    return catalog.relations().frame(spark, _SUBSTITUTION, catalog.Tables(spark, sf_dir))


#: pair_bayes_factor on Spark: exposures are a few whole numbers, and most pairs have the same; what is known of each goes to where the pairs lie.
_BAYES_FACTOR = OPERATORS["pair_bayes_factor"].replace("SELECT x.actor", "SELECT /*+ BROADCAST(z), BROADCAST(q) */ x.actor")


def _bayes_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem import catalog

    return catalog.relations().frame(spark, _BAYES_FACTOR, catalog.Tables(spark, sf_dir))


QUERIES = {
    "pair_bayes_factor": _bayes_factor,
    "class_mixture_llr": _class_mixture,
    "sparse_activity_lbf": lambda spark, d: sparse_activity_lbf(_sizes(spark, d)),
    "substitution_llr": _substitution,
    "em_mixture_rate": lambda spark, d: em_mixture_rate(_llrs(spark, d)).select("actor", "target", F.round("rate", 6).alias("rate"), F.round("llr", 6).alias("llr")),
    "random_rate_marginal": lambda spark, d: random_rate_marginal(_llrs(spark, d)).select("actor", "target", F.round("llr", 6).alias("llr"), F.round("rate", 6).alias("rate")),
    "random_rate_first_k": lambda spark, d: random_rate_first_k(_llrs(spark, d)).select("actor", "target", "episode", F.round("decoded", 6).alias("decoded")),
    "episodic_activity": lambda spark, d: episodic_activity(_llrs(spark, d)).select("actor", "target", "episode", F.round("lbf", 5).alias("lbf"), F.round("active", 6).alias("active")),
}
_L = "SELECT actor, target, episode, sum(l) AS l FROM {tilts} GROUP BY actor, target, episode"
ORACLES = {
    "em_mixture_rate": f"""
WITH RECURSIVE h AS ({_L}), e AS (SELECT actor, target, 1e-1 AS rate, 0 AS k FROM h GROUP BY actor, target
  UNION ALL SELECT h.actor, h.target, sum(e.rate * exp(h.l) / (1e0 - e.rate + e.rate * exp(h.l))) / count(*), e.k + 1 FROM e JOIN h ON h.actor = e.actor AND h.target = e.target WHERE e.k < 10 GROUP BY h.actor, h.target, e.k)
SELECT e.actor, e.target, round(e.rate, 6) AS rate, round(sum(ln(1e0 - e.rate + e.rate * exp(h.l))), 6) AS llr FROM e JOIN h ON h.actor = e.actor AND h.target = e.target WHERE e.k = 10 GROUP BY e.actor, e.target, e.rate""",
    "episodic_activity": f"""
WITH RECURSIVE h AS (SELECT t.*, row_number() OVER (PARTITION BY actor, target ORDER BY episode) AS i, count(*) OVER (PARTITION BY actor, target) AS n FROM ({_L}) t),
f AS (SELECT actor, target, 0 AS i, 1e-1 AS active, 0e0 AS lbf FROM h WHERE i = 1
  UNION ALL SELECT h.actor, h.target, CAST(h.i AS INT), (f.active * 9e-1 + (1e0 - f.active) * 1e-1) * exp(h.l) / (1e0 - (f.active * 9e-1 + (1e0 - f.active) * 1e-1) + (f.active * 9e-1 + (1e0 - f.active) * 1e-1) * exp(h.l)),
    f.lbf + ln(1e0 - (f.active * 9e-1 + (1e0 - f.active) * 1e-1) + (f.active * 9e-1 + (1e0 - f.active) * 1e-1) * exp(h.l)) FROM f JOIN h ON h.actor = f.actor AND h.target = f.target AND h.i = f.i + 1),
b AS (SELECT actor, target, CAST(n AS INT) AS i, 1e0 AS a, 1e0 AS z FROM h WHERE i = n
  UNION ALL SELECT h.actor, h.target, CAST(h.i - 1 AS INT), (9e-1 * exp(h.l) * b.a + 1e-1 * b.z) / (b.a + b.z), (1e-1 * exp(h.l) * b.a + 9e-1 * b.z) / (b.a + b.z) FROM b JOIN h ON h.actor = b.actor AND h.target = b.target AND h.i = b.i WHERE h.i > 1)
SELECT h.actor, h.target, h.episode, round(t.lbf, 5) AS lbf, round(f.active * b.a / (f.active * b.a + (1e0 - f.active) * b.z), 6) AS active FROM h JOIN f ON f.actor = h.actor AND f.target = h.target AND f.i = h.i JOIN b ON b.actor = h.actor AND b.target = h.target AND b.i = h.i
JOIN f t ON t.actor = h.actor AND t.target = h.target AND t.i = h.n""",
    "random_rate_marginal": f"""
WITH h AS ({_L}), g AS (SELECT r, w / sum(w) OVER () AS w FROM (SELECT r, (1e0 - r) ** 8 AS w FROM (SELECT (x + 5e-1) / 16e0 AS r FROM range(16) AS t(x)) a) b),
s AS (SELECT actor, target, r, w, sum(ln(1e0 - r + r * exp(l))) AS s FROM h CROSS JOIN g GROUP BY actor, target, r, w), m AS (SELECT s.*, max(s) OVER (PARTITION BY actor, target) AS m FROM s)
SELECT actor, target, round(max(m) + ln(sum(w * exp(s - m))), 6) AS llr, round(sum(w * r * exp(s - m)) / sum(w * exp(s - m)), 6) AS rate FROM m GROUP BY actor, target""",
    "random_rate_first_k": f"""
WITH RECURSIVE h AS (SELECT t.*, row_number() OVER (PARTITION BY actor, target ORDER BY episode) AS i FROM ({_L}) t), g AS (SELECT r, w / sum(w) OVER () AS w FROM (SELECT r, (1e0 - r) ** 8 AS w FROM (SELECT (x + 5e-1) / 8e0 AS r FROM range(8) AS t(x)) a) b),
o AS (SELECT actor, target, episode, i, r, w, r * exp(l) / (1e0 - r + r * exp(l)) AS p, ln(1e0 - r + r * exp(l)) AS l FROM h CROSS JOIN g),
f AS (SELECT actor, target, r, 1 AS i, 1e0 AS d0, 0e0 AS d1, 0e0 AS d2, 0e0 AS d3, 0e0 AS d4 FROM o WHERE i = 1
  UNION ALL SELECT o.actor, o.target, o.r, CAST(o.i + 1 AS INT), d0 * (1e0 - p), d1 * (1e0 - p) + d0 * p, d2 * (1e0 - p) + d1 * p, d3 * (1e0 - p) + d2 * p, d4 * (1e0 - p) + d3 * p FROM f JOIN o ON o.actor = f.actor AND o.target = f.target AND o.r = f.r AND o.i = f.i),
s AS (SELECT actor, target, r, ln(max(w)) + sum(l) AS s FROM o GROUP BY actor, target, r), m AS (SELECT s.*, exp(s - max(s) OVER (PARTITION BY actor, target)) AS w FROM s)
SELECT o.actor, o.target, o.episode, round(sum(m.w * o.p * (d0 + d1 + d2 + d3 + d4)) / sum(m.w), 6) AS decoded FROM o JOIN f ON f.actor = o.actor AND f.target = o.target AND f.r = o.r AND f.i = o.i JOIN m ON m.actor = o.actor AND m.target = o.target AND m.r = o.r GROUP BY o.actor, o.target, o.episode""",
}
