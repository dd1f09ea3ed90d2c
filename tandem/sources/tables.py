"""Reading input tables, and the relations of the event model over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations")


class Tables(Mapping):
    """Tables of a folder by name, read when asked for; views() registers them for SQL."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "parquet", schemas: Mapping[str, StructType] | None = None) -> None:
        self.spark, self.folder, self.kind, self.schemas = spark, folder, kind, schemas or {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        reader = self.spark.read.format(self.kind)
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        elif self.kind != "parquet":
            raise ValueError(f"{self.kind} tables need a schema: {name}")
        if self.kind == "csv":
            reader = reader.option("header", True)
        return reader.load(f"{self.folder}/{name}.{self.kind}")

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def views(self, *names: str) -> None:
        for n in names or TABLES:
            self[n].createOrReplaceTempView(n)


#: members act in episodes; ev are their ordered events; participants are (episode, member); pair_wide are the unordered pairs of
#: one pool in each episode with what both did; pair_labels and listed are what is known of pairs and of their episodes.
MODEL = {
    "members": "SELECT s_suppkey AS member, s_nationkey % 5 AS pool, s_nationkey AS region, s_acctbal AS balance FROM {supplier}",
    "episodes": """
SELECT o_orderkey AS episode, o_orderdate AS ts, o_totalprice / 1e2 AS unit, o_orderpriority AS priority,
  CASE WHEN o_orderdate < TIMESTAMP '1998-04-01 00:00:00' THEN 'development' ELSE 'evaluation' END AS win
FROM {orders}""",
    # strength has few binary digits, so sums of it are the same in any order
    "events0": """
SELECT l_orderkey AS episode, l_suppkey AS member,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS BIGINT) AS ordinal,
  CASE WHEN l_returnflag = 'R' THEN 'fold' WHEN l_returnflag = 'A' THEN CASE WHEN l_quantity >= 44 THEN 'all_in' ELSE 'raise' END WHEN l_linestatus = 'O' THEN 'check' ELSE 'call' END AS action,
  CAST(l_extendedprice AS DOUBLE) AS amount, floor(l_quantity * 256e-2) / 128e0 AS strength,
  CASE WHEN l_tax > 7e-2 THEN l_extendedprice * 12e-1 WHEN l_tax > 4e-2 THEN l_extendedprice * 5e-1 ELSE 0e0 END AS to_call, l_extendedprice * (l_discount - 5e-2) AS net_part
FROM {lineitem}""",
    # an all-in is a push only for more than what is to be called
    "ev": """
SELECT e.*, CASE WHEN ordinal < 2 THEN 0 WHEN ordinal < 4 THEN 1 WHEN ordinal < 6 THEN 2 ELSE 3 END AS stage,
  CASE action WHEN 'fold' THEN 'exit' WHEN 'check' THEN 'hold' WHEN 'call' THEN 'match' WHEN 'raise' THEN 'push' ELSE CASE WHEN amount > to_call THEN 'push' ELSE 'match' END END AS act FROM {events0} e""",
    "participants": """
SELECT episode, member, sum(amount) AS contribution, sum(net_part) AS net, min(CASE WHEN act = 'exit' THEN ordinal END) AS exit_ordinal, max(strength) AS strength
FROM {ev} GROUP BY episode, member""",
    "pair_wide": """
SELECT m.pool, a.member AS lo, b.member AS hi, a.episode, a.net AS net_lo, b.net AS net_hi, a.contribution AS put_lo, b.contribution AS put_hi, a.strength AS s_lo, b.strength AS s_hi,
  a.exit_ordinal AS exit_lo, b.exit_ordinal AS exit_hi, t.won, t.players, t.stayed, t.final_pot
FROM {participants} a JOIN {participants} b ON a.episode = b.episode AND a.member < b.member
JOIN (SELECT episode, sum(greatest(net, 0e0)) AS won, count(*) AS players, count(CASE WHEN exit_ordinal IS NULL THEN 1 END) AS stayed, sum(contribution) AS final_pot FROM {participants} GROUP BY episode) t ON t.episode = a.episode
JOIN {members} m ON m.member = a.member JOIN {members} n ON n.member = b.member AND n.pool = m.pool""",
    # what doesn't depend on the order of events: it need not be found for this
    "pair_nets": "SELECT pool, lo, hi, episode, net_lo, net_hi, put_lo, put_hi, s_lo, s_hi FROM {pair_wide}",
    "pair_episodes": "SELECT pool, lo, hi, episode FROM {pair_nets}",
    "pair_labels": """
SELECT pool, lo, hi, CASE WHEN (lo * 7919 + hi * 104729) % 20 = 0 THEN 1 WHEN (lo * 7919 + hi * 104729) % 20 < 7 THEN 0 END AS label, (lo + hi) % 3 AS family
FROM (SELECT DISTINCT pool, lo, hi FROM {pair_episodes}) t""",
    "listed": """
SELECT pool, lo, hi, episode, evidence_rank FROM (
  SELECT p.pool, p.lo, p.hi, p.episode, CAST(row_number() OVER (PARTITION BY p.lo, p.hi ORDER BY e.ts, p.episode) AS BIGINT) AS evidence_rank
  FROM {pair_episodes} p JOIN {episodes} e ON e.episode = p.episode
  JOIN {pair_labels} l ON l.lo = p.lo AND l.hi = p.hi AND l.label = 1
  WHERE e.win = 'development' AND (p.episode * 31 + p.lo) % 3 = 0) t
WHERE evidence_rank <= 5""",
    # transfers of each pair-episode, per unit, and the score that the examples rank by
    "transfers": """
SELECT q.*, e.ts, e.win, e.unit, least(greatest(-net_lo, 0e0), greatest(net_hi, 0e0)) / nullif(e.unit, 0e0) AS t_ab, least(greatest(-net_hi, 0e0), greatest(net_lo, 0e0)) / nullif(e.unit, 0e0) AS t_ba
FROM {pair_wide} q JOIN {episodes} e ON e.episode = q.episode""",
    "moved": """
SELECT q.*, e.ts, e.win, e.unit, least(greatest(-net_lo, 0e0), greatest(net_hi, 0e0)) / nullif(e.unit, 0e0) AS t_ab, least(greatest(-net_hi, 0e0), greatest(net_lo, 0e0)) / nullif(e.unit, 0e0) AS t_ba
FROM {pair_nets} q JOIN {episodes} e ON e.episode = q.episode""",
    "scored": "SELECT pool, lo, hi, episode, ts, win, greatest(t_ab, t_ba) AS score, t_ab - t_ba AS lean FROM {moved}",
    "pair_scores": """
SELECT s.pool, s.lo, s.hi, count(*) AS n, avg(s.score) AS score, max(s.score) AS top, max(l.label) AS label, max(l.family) AS family
FROM {scored} s JOIN {pair_labels} l ON l.lo = s.lo AND l.hi = s.hi GROUP BY s.pool, s.lo, s.hi""",
    # a probability for each pair-episode, for decoders
    "chances": "SELECT pool, lo, hi, episode, ts, least(greatest(score / (score + 1e1), 1e-6), 999e-3) AS p FROM {scored}",
}

#: Events are dealt by episode once: the partition key keeps one name from the exchange on, so windows over an episode and its stages or members, and joins on it, shuffle nothing more. Every column takes part in
#: the order and all others are derived above it, so all readers of a plan ask for the same exchange and share it.
_RAW = "l_linenumber, l_partkey, member, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"

#: Events that a task takes. Many sorts and windows share the stage and each holds its rows, so tasks must not grow with the table.
TASK_EVENTS = 1 << 17


def _events0(frame: Callable[[str], DataFrame]) -> DataFrame:
    """events0 on Spark, in as many parts as the events need; where the cores take them all at once, Spark chooses."""
    first = frame("SELECT count(*) AS n FROM {lineitem}")
    parts = -(-first.first().n // TASK_EVENTS)
    dealt = f"/*+ REPARTITION({parts}, episode) */ " if parts > first.sparkSession.sparkContext.defaultParallelism else ""
    return frame(f"""
SELECT episode, member, CAST(place - 1 AS BIGINT) AS ordinal,
  CASE WHEN l_returnflag = 'R' THEN 'fold' WHEN l_returnflag = 'A' THEN CASE WHEN l_quantity >= 44 THEN 'all_in' ELSE 'raise' END WHEN l_linestatus = 'O' THEN 'check' ELSE 'call' END AS action,
  CAST(l_extendedprice AS DOUBLE) AS amount, floor(l_quantity * 256e-2) / 128e0 AS strength,
  CASE WHEN l_tax > 7e-2 THEN l_extendedprice * 12e-1 WHEN l_tax > 4e-2 THEN l_extendedprice * 5e-1 ELSE 0e0 END AS to_call, l_extendedprice * (l_discount - 5e-2) AS net_part
FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY {_RAW}) AS place FROM (SELECT {dealt}* FROM (SELECT l_orderkey AS episode, l_suppkey AS member, {_RAW.replace("member, ", "")} FROM {{lineitem}}) r) l) t""")


#: An episode's participants are few: Spark gathers them once and takes the pairs from the array, where the self-joins would read and shuffle all events four times.
#: No WITH here: Spark takes gathered lists for nondeterministic, so a named subquery with one that is read twice is dealt out anew to any task, away from its episodes, or not planned at all.
_GATHERED = """(SELECT episode, array_sort(collect_list(struct({columns}))) AS s{more} FROM (SELECT p.*, m.pool FROM {{participants}} p LEFT JOIN {{members}} m ON m.member = p.member) p GROUP BY episode HAVING count(*) > 1)"""
_FACING = "(SELECT *, explode(filter(s, b -> b.member > a.member AND b.pool = a.pool)) AS b FROM (SELECT *, explode(s) AS a FROM {gathered} g) x) y"

MODEL_ON_SPARK = {
    "events0": _events0,
    "pair_wide": """
SELECT a.pool, a.member AS lo, b.member AS hi, episode, a.net AS net_lo, b.net AS net_hi, a.contribution AS put_lo, b.contribution AS put_hi, a.strength AS s_lo, b.strength AS s_hi,
  a.exit_ordinal AS exit_lo, b.exit_ordinal AS exit_hi, won, players, stayed, final_pot FROM """
    + _FACING.format(gathered=_GATHERED.format(columns="member, pool, net, contribution, strength, exit_ordinal", more=", sum(greatest(net, 0e0)) AS won, count(*) AS players, count_if(exit_ordinal IS NULL) AS stayed, sum(contribution) AS final_pot")),
    "pair_nets": """
SELECT a.pool, a.member AS lo, b.member AS hi, episode, a.net AS net_lo, b.net AS net_hi, a.contribution AS put_lo, b.contribution AS put_hi, a.strength AS s_lo, b.strength AS s_hi FROM """
    + _FACING.format(gathered=_GATHERED.format(columns="member, pool, net, contribution, strength", more="")),
}
