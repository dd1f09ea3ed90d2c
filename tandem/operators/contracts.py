"""Checks that tables keep what is promised of them (M1-M6), and order-free fingerprints (A4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIVE = range(1, 6)
# a result table as it is handed in, with all its columns
_RESULT = f"""SELECT p.lo, p.hi, p.pool, p.score / (p.score + 1e0) AS risk, CASE p.family WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS behavior, {", ".join(f"t.ep{k}" for k in _FIVE)} FROM {{pair_scores}} p
JOIN (SELECT lo, hi, {", ".join(f"max(CASE WHEN r = {k} THEN episode END) AS ep{k}" for k in _FIVE)} FROM (SELECT lo, hi, episode, row_number() OVER (PARTITION BY lo, hi ORDER BY score DESC, ts, episode) AS r FROM {{scored}}) x GROUP BY lo, hi) t ON t.lo = p.lo AND t.hi = p.hi"""
_SAME = " OR ".join(f"ep{i} = ep{j}" for i in _FIVE for j in _FIVE if i < j)
_HOLES = " OR ".join(f"(ep{k} IS NULL AND ep{k + 1} IS NOT NULL)" for k in range(1, 5))

#: M3: checks by name, each a statement that counts what fails. Diagnostic ones may find something in good data.
RAW_CHECKS = {
    "member_key": "SELECT count(*) - count(DISTINCT member) FROM {members}", "episode_key": "SELECT count(*) - count(DISTINCT episode) FROM {episodes}",
    "participant_key": "SELECT count(*) FROM (SELECT 1 AS x FROM {participants} GROUP BY episode, member HAVING count(*) <> 1) t", "event_key": "SELECT count(*) FROM (SELECT 1 AS x FROM {ev} GROUP BY episode, ordinal HAVING count(*) <> 1) t",
    "one_player_episodes": "SELECT count(*) FROM (SELECT 1 AS x FROM {participants} GROUP BY episode HAVING count(*) < 2) t", "unit_positive": "SELECT count(*) FROM {episodes} WHERE unit IS NULL OR unit <= 0e0", "window_null": "SELECT count(*) FROM {episodes} WHERE win IS NULL", "time_null": "SELECT count(*) FROM {episodes} WHERE ts IS NULL",
    "nets_not_zero": "SELECT count(*) FROM (SELECT 1 AS x FROM {participants} GROUP BY episode HAVING abs(sum(net)) > 1e-6) t", "event_orphan": "SELECT count(*) FROM {ev} v WHERE NOT EXISTS (SELECT 1 FROM {episodes} e WHERE e.episode = v.episode)", "member_orphan": "SELECT count(*) FROM {participants} v WHERE NOT EXISTS (SELECT 1 FROM {members} m WHERE m.member = v.member)",
    "label_lo_unknown": "SELECT count(*) FROM {pair_labels} l WHERE NOT EXISTS (SELECT 1 FROM {members} m WHERE m.member = l.lo)", "label_hi_unknown": "SELECT count(*) FROM {pair_labels} l WHERE NOT EXISTS (SELECT 1 FROM {members} m WHERE m.member = l.hi)",
    "target_lo_unknown": "SELECT count(*) FROM (SELECT DISTINCT lo FROM {scored} WHERE win = 'evaluation') l WHERE NOT EXISTS (SELECT 1 FROM {members} m WHERE m.member = l.lo)", "target_hi_unknown": "SELECT count(*) FROM (SELECT DISTINCT hi FROM {scored} WHERE win = 'evaluation') l WHERE NOT EXISTS (SELECT 1 FROM {members} m WHERE m.member = l.hi)",
    "label_of_itself": "SELECT count(*) FROM {pair_labels} WHERE lo = hi", "target_of_itself": "SELECT count(*) FROM {pair_episodes} WHERE lo = hi", "listed_other_window": "SELECT count(*) FROM {listed} g JOIN {episodes} e ON e.episode = g.episode WHERE e.win <> 'development'",
    "listed_unknown_episode": "SELECT count(*) FROM {listed} g WHERE NOT EXISTS (SELECT 1 FROM {episodes} e WHERE e.episode = g.episode)", "listed_unknown_pair": "SELECT count(*) FROM {listed} g WHERE NOT EXISTS (SELECT 1 FROM {pair_labels} l WHERE l.lo = g.lo AND l.hi = g.hi)",
    "listed_rank_key": "SELECT count(*) FROM (SELECT 1 AS x FROM {listed} GROUP BY lo, hi, evidence_rank HAVING count(*) <> 1) t", "labelled_target": "SELECT count(*) FROM {pair_labels} l WHERE label IS NOT NULL AND EXISTS (SELECT 1 FROM {scored} s WHERE s.lo = l.lo AND s.hi = l.hi AND s.win = 'evaluation')",
    "amount_range": "SELECT count(*) FROM {ev} WHERE amount < 0e0", "put_below_amount": "SELECT count(*) FROM {steps} WHERE stage_sunk < 0e0", "pot_range": "SELECT count(*) FROM {steps} WHERE pot < 0e0", "to_call_range": "SELECT count(*) FROM {ev} WHERE to_call < 0e0", "active_range": "SELECT count(*) FROM {steps} WHERE active < 1 OR active > 20",
    "contiguous": "SELECT count(*) FROM (SELECT 1 AS x FROM {ev} GROUP BY episode HAVING min(ordinal) <> 0 OR max(ordinal) + 1 <> count(*)) t", "stage_domain": "SELECT count(*) FROM {ev} WHERE stage NOT BETWEEN 0 AND 3", "action_domain": "SELECT count(*) FROM {ev} WHERE action NOT IN ('fold', 'check', 'call', 'raise', 'all_in')",
    "acts_after_exit": "SELECT count(*) FROM {ev} v JOIN {participants} p ON p.episode = v.episode AND p.member = v.member AND v.ordinal > p.exit_ordinal",
    "shared_mismatch": "SELECT count(*) FROM (SELECT lo, hi, n FROM {pair_scores}) p JOIN (SELECT a.member AS lo, b.member AS hi, count(*) AS n FROM {participants} a JOIN {participants} b ON b.episode = a.episode AND a.member < b.member GROUP BY a.member, b.member) s ON s.lo = p.lo AND s.hi = p.hi WHERE s.n <> p.n",
}
DIAGNOSTIC = ("nets_not_zero", "one_player_episodes", "acts_after_exit", "labelled_target", "active_range")

#: M3 by what is read: for each relation and key one statement with all its checks.
FUSED = {
    "SELECT count(*) - count(DISTINCT member) AS member_key FROM {members}": ("member_key",),
    "SELECT count(*) - count(DISTINCT episode) AS episode_key, count(CASE WHEN unit IS NULL OR unit <= 0e0 THEN 1 END) AS unit_positive, count(CASE WHEN win IS NULL THEN 1 END) AS window_null, count(CASE WHEN ts IS NULL THEN 1 END) AS time_null FROM {episodes}": ("episode_key", "unit_positive", "window_null", "time_null"),
    """SELECT sum(doubled) AS participant_key, count(CASE WHEN rows < 2 THEN 1 END) AS one_player_episodes, count(CASE WHEN abs(net) > 1e-6 THEN 1 END) AS nets_not_zero, sum(orphans) AS member_orphan FROM (
  SELECT episode, sum(CASE WHEN c <> 1 THEN 1 ELSE 0 END) AS doubled, sum(c) AS rows, sum(net) AS net, sum(CASE WHEN m.member IS NULL THEN c ELSE 0 END) AS orphans FROM (SELECT episode, member, count(*) AS c, sum(net) AS net FROM {participants} GROUP BY episode, member) a
  LEFT JOIN (SELECT DISTINCT member FROM {members}) m ON m.member = a.member GROUP BY episode) b""": ("participant_key", "one_player_episodes", "nets_not_zero", "member_orphan"),
    """SELECT sum(doubled) AS event_key, sum(CASE WHEN first <> 0 OR last + 1 <> rows THEN 1 ELSE 0 END) AS contiguous, sum(CASE WHEN e.episode IS NULL THEN rows ELSE 0 END) AS event_orphan, sum(amounts) AS amount_range, sum(calls) AS to_call_range, sum(stages) AS stage_domain, sum(actions) AS action_domain, sum(puts) AS put_below_amount, sum(pots) AS pot_range, sum(actives) AS active_range, sum(late) AS acts_after_exit FROM (
  SELECT episode, sum(CASE WHEN c <> 1 THEN 1 ELSE 0 END) AS doubled, min(ordinal) AS first, max(ordinal) AS last, sum(c) AS rows, sum(amounts) AS amounts, sum(calls) AS calls, sum(stages) AS stages, sum(actions) AS actions, sum(puts) AS puts, sum(pots) AS pots, sum(actives) AS actives, sum(late) AS late FROM (
    SELECT episode, ordinal, count(*) AS c, count(CASE WHEN amount < 0e0 THEN 1 END) AS amounts, count(CASE WHEN to_call < 0e0 THEN 1 END) AS calls, count(CASE WHEN stage NOT BETWEEN 0 AND 3 THEN 1 END) AS stages, count(CASE WHEN action NOT IN ('fold', 'check', 'call', 'raise', 'all_in') THEN 1 END) AS actions,
      count(CASE WHEN stage_sunk < 0e0 THEN 1 END) AS puts, count(CASE WHEN pot < 0e0 THEN 1 END) AS pots, count(CASE WHEN active < 1 OR active > 20 THEN 1 END) AS actives, count(CASE WHEN own_exits - CASE WHEN act = 'exit' THEN 1 ELSE 0 END > 0 THEN 1 END) AS late FROM {steps} GROUP BY episode, ordinal) a GROUP BY episode) b
  LEFT JOIN (SELECT DISTINCT episode FROM {episodes}) e ON e.episode = b.episode""": ("event_key", "contiguous", "event_orphan", "amount_range", "to_call_range", "stage_domain", "action_domain", "put_below_amount", "pot_range", "active_range", "acts_after_exit"),
    """SELECT count(CASE WHEN a.member IS NULL THEN 1 END) AS label_lo_unknown, count(CASE WHEN b.member IS NULL THEN 1 END) AS label_hi_unknown, count(CASE WHEN l.lo = l.hi THEN 1 END) AS label_of_itself, count(CASE WHEN l.label IS NOT NULL AND t.lo IS NOT NULL THEN 1 END) AS labelled_target
  FROM {pair_labels} l LEFT JOIN (SELECT DISTINCT member FROM {members}) a ON a.member = l.lo LEFT JOIN (SELECT DISTINCT member FROM {members}) b ON b.member = l.hi LEFT JOIN (SELECT DISTINCT lo, hi FROM {scored} WHERE win = 'evaluation') t ON t.lo = l.lo AND t.hi = l.hi""": ("label_lo_unknown", "label_hi_unknown", "label_of_itself", "labelled_target"),
    """SELECT count(DISTINCT CASE WHEN a.member IS NULL THEN t.lo END) AS target_lo_unknown, count(DISTINCT CASE WHEN b.member IS NULL THEN t.hi END) AS target_hi_unknown
  FROM (SELECT DISTINCT lo, hi FROM {scored} WHERE win = 'evaluation') t LEFT JOIN (SELECT DISTINCT member FROM {members}) a ON a.member = t.lo LEFT JOIN (SELECT DISTINCT member FROM {members}) b ON b.member = t.hi""": ("target_lo_unknown", "target_hi_unknown"),
    "SELECT count(*) AS target_of_itself FROM {pair_episodes} WHERE lo = hi": ("target_of_itself",),
    """SELECT sum(CASE WHEN c <> 1 THEN 1 ELSE 0 END) AS listed_rank_key, sum(others) AS listed_other_window, sum(unknown) AS listed_unknown_episode, sum(CASE WHEN l.lo IS NULL THEN c ELSE 0 END) AS listed_unknown_pair FROM (
  SELECT g.lo, g.hi, g.evidence_rank, count(*) AS c, count(CASE WHEN e.win <> 'development' THEN 1 END) AS others, count(CASE WHEN e.episode IS NULL THEN 1 END) AS unknown FROM {listed} g LEFT JOIN {episodes} e ON e.episode = g.episode GROUP BY g.lo, g.hi, g.evidence_rank) g
  LEFT JOIN (SELECT DISTINCT lo, hi FROM {pair_labels}) l ON l.lo = g.lo AND l.hi = g.hi""": ("listed_rank_key", "listed_other_window", "listed_unknown_episode", "listed_unknown_pair"),
    RAW_CHECKS["shared_mismatch"].replace("SELECT count(*)", "SELECT count(*) AS shared_mismatch", 1): ("shared_mismatch",),
}


def fused_checks(fused: Mapping[str, Sequence[str]] = FUSED, diagnostic: Sequence[str] = DIAGNOSTIC) -> str:
    """Spark's SQL for name, failed and kind of checks that are columns of statements, each of which has one row; a sum over nothing counts as 0."""
    parts = []
    for k, (sql, names) in enumerate(fused.items()):
        rows = ", ".join(f"'{n}', CAST(coalesce({n}, 0) AS BIGINT), '{'diagnostic' if n in diagnostic else 'hard'}'" for n in names)
        parts.append(f"SELECT stack({len(names)}, {rows}) AS (name, failed, kind) FROM ({sql}) q{k}")
    return " UNION ALL ".join(parts)


#: validate_membership on Spark: a result row gives its citations at once, and these go to their episodes once, where both members are looked up in one list.
_MEMBERSHIP_ON_SPARK = f"""
SELECT count(*) AS cited, count(CASE WHEN e.episode IS NULL THEN 1 END) AS unknown, count(CASE WHEN e.win <> 'evaluation' THEN 1 END) AS other_window, count(CASE WHEN NOT coalesce(array_contains(p.members, c.lo) AND array_contains(p.members, c.hi), FALSE) THEN 1 END) AS not_present
FROM (SELECT lo, hi, episode FROM (SELECT lo, hi, explode(array({", ".join(f"ep{k}" for k in _FIVE)})) AS episode FROM ({_RESULT}) t) x WHERE episode IS NOT NULL) c LEFT JOIN {{episodes}} e ON e.episode = c.episode
LEFT JOIN (SELECT episode, collect_set(member) AS members FROM {{participants}} GROUP BY episode) p ON p.episode = c.episode"""


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tandem import catalog

    return catalog.relations().frame(spark, _MEMBERSHIP_ON_SPARK, catalog.Tables(spark, sf_dir))


OPERATORS = {
    # M1: what is wrong with a result table, one number for each rule
    "validate_result": f"""
WITH t AS ({_RESULT}), k AS (SELECT count(*) AS doubled FROM (SELECT 1 AS x FROM t GROUP BY lo, hi HAVING count(*) > 1) d), w AS (SELECT DISTINCT lo, hi FROM {{pair_labels}}),
m AS (SELECT count(CASE WHEN t.lo IS NULL THEN 1 END) AS missing, count(CASE WHEN w.lo IS NULL THEN 1 END) AS unexpected FROM w FULL OUTER JOIN t ON t.lo = w.lo AND t.hi = w.hi)
SELECT count(*) AS n, count(CASE WHEN lo IS NULL OR hi IS NULL THEN 1 END) AS null_key, count(CASE WHEN risk IS NULL THEN 1 END) AS null_risk, count(CASE WHEN risk < 0e0 OR risk > 1e0 OR isnan(risk) THEN 1 END) AS bad_risk, count(CASE WHEN behavior NOT IN ('a', 'b', 'c') THEN 1 END) AS bad_behavior, count(CASE WHEN behavior IS NULL OR trim(behavior) = '' THEN 1 END) AS blank_behavior,
  count(CASE WHEN {_SAME} THEN 1 END) AS repeated, count(CASE WHEN {_HOLES} THEN 1 END) AS holes, count(CASE WHEN ep1 IS NULL THEN 1 END) AS without, max(k.doubled) AS doubled, max(m.missing) AS missing, max(m.unexpected) AS unexpected FROM t CROSS JOIN k CROSS JOIN m""",
    # M2
    "validate_membership": f"""
WITH t AS ({_RESULT}), c AS ({" UNION ALL ".join(f"SELECT lo, hi, ep{k} AS episode FROM t WHERE ep{k} IS NOT NULL" for k in _FIVE)})
SELECT count(*) AS cited, count(CASE WHEN e.episode IS NULL THEN 1 END) AS unknown, count(CASE WHEN e.win <> 'evaluation' THEN 1 END) AS other_window, count(CASE WHEN a.member IS NULL OR b.member IS NULL THEN 1 END) AS not_present
FROM c LEFT JOIN {{episodes}} e ON e.episode = c.episode LEFT JOIN {{participants}} a ON a.episode = c.episode AND a.member = c.lo LEFT JOIN {{participants}} b ON b.episode = c.episode AND b.member = c.hi""",
    # M3: named checks with how many rows fail them
    "audit_raw": fused_checks(),
    # M4
    "audit_features": """
WITH d AS (SELECT win, count(*) AS doubled FROM (SELECT win, lo, hi, episode FROM {pair_features1} GROUP BY win, lo, hi, episode HAVING count(*) > 1) t GROUP BY win), p AS (SELECT win, count(*) AS pairs FROM (SELECT DISTINCT win, lo, hi FROM {pair_features1}) t GROUP BY win)
SELECT f.win, count(*) AS n, max(p.pairs) AS pairs, count(CASE WHEN t_ab IS NULL OR t_ba IS NULL OR risk_proxy IS NULL THEN 1 END) AS nulls, coalesce(max(d.doubled), 0) AS doubled, count(CASE WHEN t_ab > 0e0 AND t_ba > 0e0 THEN 1 END) AS both_ways, count(CASE WHEN isnan(risk_proxy) OR isnan(mean_pot) THEN 1 END) AS not_finite,
  count(CASE WHEN e.win <> f.win THEN 1 END) AS wrong_window FROM {pair_features1} f JOIN {episodes} e ON e.episode = f.episode JOIN p ON p.win = f.win LEFT JOIN d ON d.win = f.win GROUP BY f.win""",
}


class ContractError(ValueError):
    """A table doesn't keep what was promised of it."""


def violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """name and failed: for each condition the number of rows of df for which it holds, in one pass."""
    counts = df.agg(*(F.count_if(c).alias(n) for n, c in checks.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("failed")) for n in checks))).alias("x")).select("x.*")


def validate_result(df: DataFrame, columns: Sequence[str], key: str, risk: str, behavior: str, known: Sequence[str], evidence: Sequence[str], wanted: DataFrame | None = None) -> DataFrame:
    """Raises ContractError for wrong columns; else the violations of a result table: nulls, blanks, risk outside 0 to 1, unknown behavior, repeated evidence, keys doubled, missing or unexpected."""
    if list(df.columns) != list(columns):
        raise ContractError(f"columns are {df.columns}")
    texts = [c for c, t in df.dtypes if t == "string"]
    listed = F.filter(F.array(*evidence), lambda x: x.isNotNull() & (x != "NO_EVIDENCE"))
    found = violations(
        df,
        {
            "null": sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) > 0,
            "blank": sum(((F.trim(c) == "").cast("int") for c in texts), F.lit(0)) > 0,
            "risk": F.isnan(risk) | (F.col(risk) < 0) | (F.col(risk) > 1),
            "behavior": ~F.col(behavior).isin(*known),
            "repeated": F.size(listed) != F.size(F.array_distinct(listed)),
        },
    )
    out = found.unionByName(df.agg((F.count(key) - F.count_distinct(key)).alias("failed")).select(F.lit("doubled").alias("name"), "failed"))
    if wanted is not None:
        missing = wanted.select(key).join(df.select(key), key, "left_anti")
        unexpected = df.select(key).join(wanted.select(key), key, "left_anti")
        for name, rows in (("missing", missing), ("unexpected", unexpected)):
            out = out.unionByName(rows.agg(F.count(F.lit(1)).alias("failed")).select(F.lit(name).alias("name"), "failed"))
    return out


def require_features(df: DataFrame, registered: Sequence[str]) -> DataFrame:
    """M5: df if it has exactly the registered columns that begin with f_, else ContractError; a non-finite value fails the job that meets it."""
    own = [c for c in df.columns if c.startswith("f_")]
    if sorted(own) != sorted(registered):
        raise ContractError(f"missing {sorted(set(registered) - set(own))}, not registered {sorted(set(own) - set(registered))}")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*(F.when(bad(c), F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in df.columns))


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], one_to_one: bool = False) -> DataFrame:
    """Inner join that raises ContractError where right's keys (or, one to one, left's) repeat, or rows of left would be lost."""
    for side, rows in (("right", right), ("left", left))[: 2 if one_to_one else 1]:
        if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ContractError(f"keys repeat on the {side}")
    if not left.join(right, list(keys), "left_anti").isEmpty():
        raise ContractError("rows of the left have no partner")
    return left.join(right, list(keys))


def window_safe_join(base: DataFrame, extra: DataFrame, keys: Sequence[str] = ("win", "pool", "lo", "hi")) -> DataFrame:
    """checked_join() on keys that include the window, so that features of another window can't be joined."""
    for name, rows in (("base", base), ("extra", extra)):
        if missing := [k for k in keys if k not in rows.columns]:
            raise ContractError(f"{name} has no {', '.join(missing)}")
    return checked_join(base, extra, keys, one_to_one=True)


def fingerprint(df: DataFrame) -> DataFrame:
    """A4: number of rows and an order-free sum of row hashes over all columns, sorted by name."""
    texts = []
    for name, kind in sorted(df.dtypes):
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = c.cast("decimal(38,6)")
        elif kind.startswith("timestamp"):
            c = F.unix_seconds(c.cast("timestamp"))
        texts.append(F.coalesce(c.cast("string"), F.lit("\\N")))
    row = F.md5(F.concat_ws("|", *texts))
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long")).alias("hash"))


def run_receipt(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """M6: rows before, after, and how many changed in any of the columns."""
    b, a = before.select(*key, F.struct(*columns).alias("_b")), after.select(*key, F.struct(*columns).alias("_a"))
    both = b.join(a, list(key), "full_outer")
    return both.agg(F.count("_b").alias("before"), F.count("_a").alias("after"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))


def _model(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    from tandem import catalog

    return catalog.relations().frame(spark, sql, catalog.Tables(spark, folder))


_PAIRS = "SELECT pool, win, lo, hi, count(*) AS n, round(avg(score), 6) AS mean FROM {scored} GROUP BY pool, win, lo, hi"
_LEANS = "SELECT pool, win, lo, hi, round(avg(lean), 6) AS lean FROM {scored} GROUP BY pool, win, lo, hi"
_BEFORE = "SELECT lo, hi, round(avg(score), 6) AS score, max(episode) AS last FROM {scored} GROUP BY lo, hi"
_AFTER = "SELECT lo, hi, CASE WHEN lo % 3 = 0 THEN 0e0 ELSE round(avg(score), 6) END AS score, max(episode) AS last FROM {scored} GROUP BY lo, hi"


#: A1: the tables that the model and other operators read, with the kinds of their columns: i integer, d double, t time, s text.
TABLES = {
    "supplier": "s_acctbal d, s_name s, s_nationkey i, s_suppkey i",
    "orders": "o_custkey i, o_orderdate t, o_orderkey i, o_orderpriority s, o_orderstatus s, o_totalprice d",
    "nation": "n_name s, n_nationkey i, n_regionkey i",
    "lineitem": "l_discount d, l_extendedprice d, l_linenumber i, l_linestatus s, l_orderkey i, l_partkey i, l_quantity d, l_returnflag s, l_shipdate t, l_suppkey i, l_tax d",
    "part": "p_brand s, p_name s, p_partkey i, p_retailprice d, p_size i, p_type s",
    "events": "event_id i, event_type s, props s, ts t, user_id i, value d",
    "documents": "doc_id i, lang s, n_chars i, source s, text s",
    "labels": "doc_id i, quality i, toxic i",
}


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    """A1: the fingerprints of the tables that are read."""
    from functools import reduce

    from tandem import catalog

    known = catalog.Tables(spark, folder)
    return reduce(DataFrame.unionByName, [fingerprint(known[t]).select(F.lit(t).alias("name"), "n", "hash") for t in TABLES])


def _stored(spark: SparkSession, folder: str, name: str, save, load) -> DataFrame:  # noqa: ANN001
    from tandem.sources.sinks import scratch

    path = scratch(spark, name)
    save(path)
    return load(path)


def _features_stored(spark: SparkSession, folder: str) -> DataFrame:
    """A2: pair means written by window and read again."""
    from tandem.sources.sinks import write_features

    return _stored(spark, folder, "features", lambda p: write_features(_model(spark, folder, _PAIRS), p, ("win",)), lambda p: spark.read.parquet(p).select("pool", "win", "lo", "hi", "n", "mean"))


def _result_stored(spark: SparkSession, folder: str) -> DataFrame:
    """A3: a result written as CSV and read again, its sentinels as they are in the files."""
    from tandem.sources.sinks import write_result_csv

    columns = ("lo", "hi", "behavior", "ep1", "ep2", "ep3", "ep4", "ep5")
    rows = _model(spark, folder, f"SELECT lo, hi, behavior, {', '.join(f'ep{k}' for k in _FIVE)} FROM ({_RESULT}) t")
    kinds = ", ".join(f"{c} {'bigint' if c in ('lo', 'hi') else 'string'}" for c in columns)
    return _stored(spark, folder, "result", lambda p: write_result_csv(rows, p, columns, ("lo", "hi"), columns[3:]), lambda p: spark.read.schema(kinds).option("header", True).csv(p))


QUERIES = {
    "load_tables": _tables,
    "validate_membership": _membership,
    "table_fingerprint": lambda spark, d: fingerprint(_model(spark, d, "SELECT * FROM {orders}")),
    "write_features": _features_stored,
    "write_result_csv": _result_stored,
    "checked_join": lambda spark, d: checked_join(_model(spark, d, _PAIRS), _model(spark, d, "SELECT lo, hi, label, family FROM {pair_labels}"), ("lo", "hi")).select("win", "lo", "hi", "n", "mean", "label", "family"),
    "window_safe_join": lambda spark, d: window_safe_join(_model(spark, d, _PAIRS), _model(spark, d, _LEANS)).select("win", "pool", "lo", "hi", "n", "mean", "lean"),
    "require_features": lambda spark, d: require_features(_model(spark, d, "SELECT pool, lo, hi, round(score, 6) AS f_score, round(top, 6) AS f_top FROM {pair_scores}"), ("f_score", "f_top")),
    "run_receipt": lambda spark, d: run_receipt(_model(spark, d, _BEFORE), _model(spark, d, _AFTER), ("lo", "hi"), ("score", "last")),
}


def _hashed(table: str, texts_: Sequence[str]) -> str:
    """What fingerprint() gives, in the checking engine's SQL; columns in the order of their names."""
    texts = ", ".join(f"coalesce({c}, '\\N')" for c in texts_)
    return f"SELECT '{table}' AS name, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {texts})), 1, 8) AS BIGINT)) AS BIGINT) AS hash FROM {{{table}}}"


_KINDS = {"i": "CAST({} AS VARCHAR)", "d": "CAST(CAST({} AS DECIMAL(38, 6)) AS VARCHAR)", "t": "CAST(CAST(floor(epoch({})) AS BIGINT) AS VARCHAR)", "s": "{}"}
_HASHED = {t: _hashed(t, [_KINDS[kind].format(c) for c, kind in (x.split() for x in columns.split(", "))]) for t, columns in TABLES.items()}
ORACLES = {
    "audit_raw": " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(({c}) AS BIGINT) AS failed, '{'diagnostic' if n in DIAGNOSTIC else 'hard'}' AS kind" for n, c in RAW_CHECKS.items()),
    "load_tables": " UNION ALL ".join(_HASHED.values()),
    "table_fingerprint": _HASHED["orders"].replace("SELECT 'orders' AS name, ", "SELECT "),
    "write_features": _PAIRS,
    "write_result_csv": f"SELECT lo, hi, behavior, {', '.join(f"coalesce(CAST(ep{k} AS VARCHAR), 'NO_EVIDENCE') AS ep{k}" for k in _FIVE)} FROM ({_RESULT}) t",
    "checked_join": f"SELECT a.win, a.lo, a.hi, a.n, a.mean, b.label, b.family FROM ({_PAIRS}) a JOIN {{pair_labels}} b ON b.lo = a.lo AND b.hi = a.hi",
    "window_safe_join": f"SELECT a.win, a.pool, a.lo, a.hi, a.n, a.mean, b.lean FROM ({_PAIRS}) a JOIN ({_LEANS}) b ON b.win = a.win AND b.pool = a.pool AND b.lo = a.lo AND b.hi = a.hi",
    "require_features": "SELECT pool, lo, hi, round(score, 6) AS f_score, round(top, 6) AS f_top FROM {pair_scores}",
    "run_receipt": f"SELECT count(b.lo) AS before, count(a.lo) AS after, count(CASE WHEN b.score <> a.score OR b.last <> a.last THEN 1 END) AS changed FROM ({_BEFORE}) b FULL OUTER JOIN ({_AFTER}) a ON a.lo = b.lo AND a.hi = b.hi",
}
