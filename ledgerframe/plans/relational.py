"""The operators on the driver's relational tables, each with SQL for the same rows.

Surrogates: nations are contracts, market segments symbols, customers accounts; orders are transactions and lines their
actions; sign-ups are interface versions and clicks the rows decoded with them; parts are templates with facets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import asof, grouping, lookups, overlay, ranking, validation
from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        @wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c: str):
    """Prices have two decimals; sums of decimals do not depend on the order of rows."""
    return F.col(c).cast("decimal(18,2)")


def balances(spark: SparkSession, d: str) -> DataFrame:
    """(contract, account, symbol, amount): orders summed by customer."""
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(money("o_totalprice")).alias("amount"))
    c = table(spark, d, "customer").join(per, "c_custkey").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("n_name").alias("contract"), F.col("c_name").alias("account"), F.col("c_mktsegment").alias("symbol"), F.col("amount").cast("decimal(38,2)").alias("amount"))


_BAL = """SELECT n_name AS contract, c_name AS account, c_mktsegment AS symbol, a.amount FROM customer
JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount FROM orders GROUP BY 1) a ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey"""


@query(f"WITH b AS ({_BAL}) SELECT contract, account, symbol, amount FROM b WHERE symbol = 'BUILDING' ORDER BY amount DESC, account LIMIT 10")
def top_holders(spark, d):
    return ranking.top(balances(spark, d).filter("symbol = 'BUILDING'"), 10, F.col("amount").desc(), F.col("account"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN greatest(100, (SELECT min(o_orderkey) FROM orders)) AND least(1000000, (SELECT max(o_orderkey) FROM orders))")
def range_scan_clamped(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lo, hi = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    if lo is None or max(100, lo) > min(1_000_000, hi):
        raise ValueError("no block of the range is there")
    return o.filter(F.col("o_orderkey").between(max(100, lo), min(1_000_000, hi)))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' OR (event_type = 'click' AND user_id = 7) OR (event_type = 'view' AND user_id = 11 AND value > 50)")
def selector_or_filter(spark, d):
    e, u, t = table(spark, d, "events"), F.col("user_id"), F.col("event_type")
    return e.filter(lookups.select_targets([(t == "error",), (t == "click", u == 7), (t == "view", u == 11, F.col("value") > 50)])).select("event_id", "user_id", "event_type")


def _versions(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("version"), F.col("value").alias("version_value"))


_ASOF = """WITH s AS (SELECT user_id, ts, event_id AS version, value AS version_value FROM events WHERE event_type = 'signup'),
c AS (SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'click')
SELECT c.user_id, c.event_id, c.value, s.version, s.version_value FROM c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.ts >= s.ts"""


@query(_ASOF)
def asof_version(spark, d):
    clicks, versions = _versions(spark, d)
    return asof.asof_join(clicks, versions, ["user_id"], "ts", "ts", ["version"], ["version", "version_value"]).select("user_id", "event_id", "value", "version", "version_value")


@query(_ASOF)
def asof_version_buckets(spark, d):
    """The same with time cut into 16 buckets, as for busy keys."""
    clicks, versions = _versions(spark, d)
    return asof.asof_join(clicks, versions, ["user_id"], "ts", "ts", ["version"], ["version", "version_value"], buckets=16).select("user_id", "event_id", "value", "version", "version_value")


@query("""WITH s AS (SELECT user_id, ts, event_id AS version, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type = 'signup')
SELECT c.user_id, c.event_id, s.version, CASE WHEN c.value >= 100 THEN s.version ELSE s.before END AS decoded_with
FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN s ON c.user_id = s.user_id AND c.ts >= s.ts""")
def asof_retry_previous(spark, d):
    clicks, versions = _versions(spark, d)
    j = asof.asof_join(clicks, versions, ["user_id"], "ts", "ts", ["version"], ["version"], previous=True)
    return j.select("user_id", "event_id", "version", asof.current_or_previous(F.col("value") >= 100, F.col("version"), F.col("prev_version")).alias("decoded_with"))


@query("SELECT user_id, event_id AS version, epoch_us(ts) AS valid_from, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS valid_to FROM events WHERE event_type = 'signup'")
def version_intervals(spark, d):
    v = asof.validity_intervals(_versions(spark, d)[1], ["user_id"], "ts", ["version"])
    return v.select("user_id", "version", F.unix_micros(F.col("ts").cast("timestamp")).alias("valid_from"), F.unix_micros(F.col("valid_to").cast("timestamp")).alias("valid_to"))


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def broadcast_enrich(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name", "n_name")


def _big_lines(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def eligible_semi(spark, d):
    return table(spark, d, "part").join(_big_lines(spark, d), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def ineligible_anti(spark, d):
    return table(spark, d, "part").join(_big_lines(spark, d), "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_size, largest, p_size = largest AS is_largest FROM part, (SELECT max(p_size) AS largest FROM part)")
def config_cross(spark, d):
    p = table(spark, d, "part")
    config = p.agg(F.max("p_size").alias("largest"))  # one row by construction
    return p.crossJoin(F.broadcast(config)).select("p_partkey", "p_size", "largest", (F.col("p_size") == F.col("largest")).alias("is_largest"))


@query("""SELECT o_orderkey, coalesce(n, 0) AS n_returned, q AS returned_quantity FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2)))::DECIMAL(28,2) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def optional_left_join(spark, d):
    back = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(money("l_quantity")).alias("q"))
    j = table(spark, d, "orders").join(back, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_returned"), F.col("q").cast("decimal(28,2)").alias("returned_quantity"))


@query("""SELECT c_name AS account, n_name AS network, s.n AS n_orders, s.total, k.kinds, s.keys
FROM customer JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DECIMAL(28,2) AS total, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1) s ON s.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY 1) k ON k.o_custkey = c_custkey""")
def account_assembly(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    stats = o.groupBy("c_custkey").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("total"), F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    kinds = o.groupBy("c_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("kinds"))
    a = lookups.assemble(table(spark, d, "customer"), "c_custkey", {"stats": stats, "kind": kinds}).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    text = lambda c: F.when(c.isNotNull(), F.concat_ws(",", c))
    return a.select(F.col("c_name").alias("account"), F.col("n_name").alias("network"), F.col("stats.n").alias("n_orders"), F.col("stats.total").cast("decimal(28,2)").alias("total"), text(F.col("kind.kinds")).alias("kinds"), text(F.col("stats.keys").cast("array<string>")).alias("keys"))


def _spend(spark, d, year):
    return table(spark, d, "orders").filter(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.sum(money("o_totalprice")).cast("decimal(28,2)").alias("spent"), F.count("*").alias("n"))


_SPEND = "SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DECIMAL(28,2) AS spent, count(*) AS n FROM orders WHERE year(o_orderdate) = {} GROUP BY 1"


@query(f"WITH b AS ({_SPEND.format(1995)}), o AS ({_SPEND.format(1996)}) SELECT coalesce(o.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN o.o_custkey IS NULL THEN b.spent ELSE o.spent END AS spent, CASE WHEN o.o_custkey IS NULL THEN b.n ELSE o.n END AS n, o.o_custkey IS NOT NULL AS from_overlay FROM b FULL JOIN o ON b.o_custkey = o.o_custkey")
def full_outer_merge(spark, d):
    return lookups.overlay_merge(_spend(spark, d, 1995), _spend(spark, d, 1996), ["o_custkey"], ["spent", "n"])


@query("SELECT q.pos, q.o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey IS NOT NULL AS found FROM (SELECT i AS pos, (i * 7919) % 20000 AS o_orderkey FROM range(500) r(i)) q LEFT JOIN orders o ON o.o_orderkey = q.o_orderkey")
def batch_hydrate(spark, d):
    want = spark.range(500).select(F.col("id").alias("pos"), (F.col("id") * 7919 % 20000).alias("o_orderkey"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", money("o_totalprice").alias("price"))
    return lookups.hydrate(want, rows, ["o_orderkey"]).select("pos", "o_orderkey", "o_custkey", "price", "found")


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
_LINE_SQL = ", ".join(_LINE_ORDER)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_SQL}) = 1")
def first_row_wins(spark, d):
    return ranking.first_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in _LINE_ORDER]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT l_partkey AS p_partkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers, count(DISTINCT l_suppkey)::INTEGER AS n FROM lineitem GROUP BY 1")
def reverse_index(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("s"))
    return lookups.reverse_index(l, "p_partkey", "s").select("p_partkey", F.concat_ws(",", "members").alias("suppliers"), "n")


_GROUPING = f"""WITH l AS (SELECT l_orderkey AS tx, l_partkey % 5 AS digest, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_SQL}) AS ordinal FROM lineitem),
a AS (SELECT *, ordinal - 1 AS creator FROM l),
c AS (SELECT a.*, CASE WHEN a.creator > 0 AND p.digest = a.digest THEN a.creator ELSE a.ordinal END AS canonical FROM a LEFT JOIN a p ON p.tx = a.tx AND p.ordinal = a.creator)
SELECT tx, digest, canonical, min(ordinal) AS first_position, arg_min(l_partkey, ordinal) AS body, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY ordinal) AS receivers, count(*)::INTEGER AS n_receipts FROM c GROUP BY 1, 2, 3"""


@query(_GROUPING)
def notification_grouping(spark, d):
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)).cast("long")
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx"), (F.col("l_partkey") % 5).alias("digest"), "l_partkey", F.col("l_suppkey").alias("receiver"), number.alias("ordinal")).withColumn("creator", F.col("ordinal") - 1).withColumn("position", F.col("ordinal"))
    g = grouping.group_notifications(a, ["tx"], "digest", "ordinal", "creator", "position", ["l_partkey"], ["receiver"])
    return g.select("tx", "digest", "canonical", "first_position", F.col("l_partkey").alias("body"), F.concat_ws(",", F.col("receipts.receiver").cast("array<string>")).alias("receivers"), "n_receipts")


@query("SELECT k // 10 AS bucket, count(*) AS n, substr(arg_min('event ' || event_id, event_id), 1, 140) AS sample FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error') GROUP BY 1 ORDER BY n DESC, bucket LIMIT 25")
def failure_breakdown(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select("event_id", F.expr("get_json_object(props, '$.k') :: bigint div 10").alias("bucket"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("said"))
    return grouping.failure_report(e, ["bucket"], "said", "event_id")


@query("SELECT count(DISTINCT user_id) AS users FROM events")
def distinct_users(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("users"))


@query(f"WITH b AS ({_BAL}) SELECT contract, symbol, count(*) AS holders FROM b GROUP BY 1, 2")
def holder_count(spark, d):
    return balances(spark, d).groupBy("contract", "symbol").agg(F.count("*").alias("holders"))


@query("""WITH t AS (SELECT p_brand, l_suppkey, sum(CAST(l_quantity AS DECIMAL(18,2)))::DECIMAL(28,2) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT p_brand, l_suppkey, q, row_number() OVER (PARTITION BY p_brand ORDER BY q DESC, l_suppkey)::INTEGER AS rank, count(*) OVER (PARTITION BY p_brand) AS holders FROM t""")
def token_holders(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    t = l.groupBy("p_brand", "l_suppkey").agg(F.sum(money("l_quantity")).cast("decimal(28,2)").alias("q"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("q").desc(), "l_suppkey")))
    return t.withColumn("holders", F.count("*").over(Window.partitionBy("p_brand")))


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS bytes FROM customer WHERE c_acctbal > 0 ORDER BY bytes DESC, c_custkey LIMIT 100")
def top_ram(spark, d):
    return ranking.top(table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", money("c_acctbal").alias("bytes")), 100, F.col("bytes").desc(), F.col("c_custkey"))


@query("SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2)))::DECIMAL(28,2) AS cpu, sum(CAST(l_tax AS DECIMAL(18,2)))::DECIMAL(28,2) AS net FROM lineitem GROUP BY 1 HAVING cpu + net > 0 ORDER BY cpu + net DESC, l_orderkey LIMIT 100")
def top_stake(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(money("l_quantity")).cast("decimal(28,2)").alias("cpu"), F.sum(money("l_tax")).cast("decimal(28,2)").alias("net"))
    return ranking.top(s.withColumn("stake", F.col("cpu") + F.col("net")).filter("stake > 0"), 100, F.col("stake").desc(), F.col("l_orderkey")).drop("stake")


@query("""WITH x AS (SELECT * FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'brand' AS dim, p_brand AS key, count(*) AS n FROM x GROUP BY p_brand UNION ALL SELECT 'type', p_type, count(*) FROM x GROUP BY p_type
UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM x GROUP BY p_size UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), count(*) FROM x GROUP BY l_suppkey
UNION ALL SELECT 'flag', l_returnflag, count(*) FROM x GROUP BY l_returnflag""")
def dim_counts(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return lookups.unpivot_counts(x, {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size"), "supplier": F.col("l_suppkey"), "flag": F.col("l_returnflag")})


def _orders_of(spark, d, low, high):
    return table(spark, d, "orders").filter(F.col("o_custkey").between(low, high)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 1 AND 40 ORDER BY o_orderkey DESC LIMIT 100")
def dim_page1(spark, d):
    return ranking.page(_orders_of(spark, d, 1, 40), "o_orderkey", 100)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 1 AND 90 AND o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 50")
def cursor_page(spark, d):
    return ranking.page(_orders_of(spark, d, 1, 90), "o_orderkey", 50, after=1000)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 50 OFFSET 200")
def browse_offset(spark, d):
    return ranking.browse(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 200, 50, F.col("o_orderkey").desc())


_MINT = f"row_number() OVER (PARTITION BY l_partkey ORDER BY {_LINE_SQL})"


def _mints(spark, d):
    return ranking.ordinals(table(spark, d, "lineitem"), ["l_partkey"], _LINE_ORDER, "mint")


@query(f"SELECT l_partkey, l_orderkey, l_linenumber, {_MINT}::INTEGER AS mint FROM lineitem")
def mint_rank(spark, d):
    return _mints(spark, d).select("l_partkey", "l_orderkey", "l_linenumber", "mint")


@query(f"SELECT l_partkey, l_orderkey, mint, p_name FROM (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, {_MINT}::INTEGER AS mint FROM lineitem) JOIN part ON p_partkey = l_partkey ORDER BY mint, l_orderkey, l_partkey, l_linenumber, l_suppkey LIMIT 100 OFFSET 40")
def sorted_by_mint(spark, d):
    page = ranking.browse(_mints(spark, d).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "mint"), 40, 100, *[F.col(c) for c in ("mint", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")])
    return page.join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_partkey", "l_orderkey", "mint", "p_name")


_BASE_DAY = "1996-01-01"


@query(f"""WITH b AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '{_BASE_DAY}' GROUP BY 1)
SELECT l.l_partkey, l_orderkey, l_linenumber, (coalesce(n, 0) + row_number() OVER (PARTITION BY l.l_partkey ORDER BY {_LINE_SQL.replace('l_partkey', 'l.l_partkey')}))::BIGINT AS ordinal
FROM lineitem l LEFT JOIN b USING (l_partkey) WHERE l_shipdate >= TIMESTAMP '{_BASE_DAY}'""")
def mint_continuation(spark, d):
    l = table(spark, d, "lineitem")
    base = l.filter(F.col("l_shipdate") < _BASE_DAY).groupBy("l_partkey").agg(F.count("*").alias("n"))
    new = l.filter(F.col("l_shipdate") >= _BASE_DAY).join(base, "l_partkey", "left")
    return ranking.ordinals(new, ["l_partkey"], _LINE_ORDER, "ordinal", F.coalesce("n", F.lit(0)).cast("long")).select("l_partkey", "l_orderkey", "l_linenumber", "ordinal")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_SQL}) = 1 AS first_in_tx FROM lineitem")
def first_in_tx(spark, d):
    return ranking.ordinals(table(spark, d, "lineitem"), ["l_orderkey"], _LINE_ORDER, "n").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("n") == 1).alias("first_in_tx"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' INTERSECT SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 40")
def facet_intersect(spark, d):
    p = table(spark, d, "part")
    return p.filter("p_brand = 'Brand#13'").select("p_partkey").intersect(p.filter("p_size between 10 and 40").select("p_partkey"))


_SETS = {"base": "o_orderkey % 3 = 0", "add": "o_orderkey % 5 = 1", "rem": "o_orderkey % 7 = 2", "tomb": "o_orderkey % 11 = 3"}


@query("SELECT o_orderkey FROM orders WHERE ({base} OR {add}) AND NOT ({rem}) AND NOT ({tomb})".format(**_SETS))
def effective_set(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return lookups.effective_set(*(o.filter(s) for s in _SETS.values()), "o_orderkey")


@query("""WITH o AS (SELECT o_custkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS HUGEINT) AS u, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 's' WHEN o_orderdate <= TIMESTAMP '1995-06-30' THEN 'm' ELSE 'g' END AS k FROM orders),
s AS (SELECT o_custkey, coalesce(sum(u) FILTER (k = 'm'), 0) AS m, coalesce(sum(u) FILTER (k = 'g'), 0) AS g, coalesce(sum(u) FILTER (k = 's'), 0) AS s FROM o GROUP BY 1)
SELECT o_custkey, (m * 10007 // 9973)::DECIMAL(38,0) AS matured, (g * 10007 // 9973)::DECIMAL(38,0) AS maturing, (s * 10007 // 9973)::DECIMAL(38,0) AS savings FROM s""")
def rex_split(spark, d):
    from ..operators import rex

    o = table(spark, d, "orders").select("o_custkey", (money("o_totalprice") * 100).cast("decimal(38,0)").alias("units"), F.col("o_orderdate").alias("matures"))
    return rex.split(o, "o_custkey", "units", "matures", now="1995-06-30", savings_from="1998-01-01", lendable=10007, total=9973)


@query("WITH g AS (SELECT o_orderkey, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS island FROM orders) SELECT max(o_orderkey) AS watermark, count(*) AS ranges FROM g WHERE island = (SELECT min(island) FROM g)")
def watermark_islands(spark, d):
    return grouping.contiguous_watermark(table(spark, d, "orders").select(F.col("o_orderkey").alias("s"), F.col("o_orderkey").alias("e")), "s", "e")


def _events(spark, d):
    op = F.create_map(*[F.lit(x) for p in (("signup", "mint"), ("purchase", "transfer"), ("error", "burn"), ("view", "setdata")) for x in p])
    e = table(spark, d, "events").filter("event_type <> 'click'")
    # assets are spread finer than users, so that some are never burned
    key = (F.col("user_id") * 100 + F.col("event_id") % 37).alias("asset_id")
    return e.select(key, F.col("event_id").alias("block"), F.lit(0).cast("long").alias("pos"), op[F.col("event_type")].alias("op"), (F.floor("value") % 10).cast("string").alias("owner"), F.get_json_object("props", "$.k").alias("data"), (F.col("user_id") % 5).cast("long").alias("template"))


def _overlay_sql(upto: str = "") -> str:
    return f"""e AS (SELECT user_id * 100 + event_id % 37 AS asset_id, event_id AS block, event_type AS t, CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) AS owner, json_extract_string(props, '$.k') AS data, user_id % 5 AS template FROM events WHERE event_type <> 'click' {upto}),
b AS (SELECT asset_id, min(block) FILTER (t = 'signup') AS born, count(*) FILTER (t = 'error') AS dead FROM e GROUP BY 1),
l AS (SELECT e.* FROM e JOIN b USING (asset_id) WHERE dead = 0 AND born IS NOT NULL AND (block > born AND t <> 'signup' OR block = born)),
m AS (SELECT *, lag(owner) OVER (PARTITION BY asset_id ORDER BY block) AS was FROM l WHERE t IN ('signup', 'purchase')),
s AS (SELECT asset_id, (SELECT arg_max(owner, block) FROM m WHERE m.asset_id = x.asset_id AND (t = 'signup' OR owner <> was)) AS owner,
  arg_max(data, block) FILTER (t IN ('signup', 'view')) AS data, max(template) FILTER (t = 'signup')::BIGINT AS template,
  (SELECT max(block) FROM m WHERE m.asset_id = x.asset_id AND (t = 'signup' OR owner <> was)) AS block FROM l x GROUP BY asset_id)"""


@query(f"WITH {_overlay_sql()} SELECT asset_id, owner, data, template, block FROM s")
def overlay_state(spark, d):
    return overlay.current_state(_events(spark, d))


_HALF = "AND event_id <= (SELECT max(event_id) // 2 FROM events)"


def _half(events) -> int:
    """The middle of the events' blocks."""
    return (events.agg(F.max("block")).first()[0] or 0) // 2


@query(f"WITH {_overlay_sql(_HALF)} SELECT asset_id, owner, data, template, block FROM s")
def overlay_rollback(spark, d):
    return overlay.current_state(_events(spark, d), upto=_half(table(spark, d, "events").select(F.col("event_id").alias("block"))))


@query(f"WITH {_overlay_sql()} SELECT 'owner' AS dim, owner AS key, count(*) AS n FROM s GROUP BY owner UNION ALL SELECT 'data', data, count(*) FROM s GROUP BY data UNION ALL SELECT 'template', CAST(template AS VARCHAR), count(*) FROM s GROUP BY template")
def overlay_counts(spark, d):
    s = overlay.current_state(_events(spark, d))
    return lookups.unpivot_counts(s, {"owner": F.col("owner"), "data": F.col("data"), "template": F.col("template")})


@query(f"WITH {_overlay_sql()} SELECT side, 0::BIGINT AS n, (SELECT count(*) FROM s) AS total FROM (VALUES ('left'), ('right')) t(side)")
def compaction_equivalence(spark, d):
    """The state after a compaction in the middle of the events against a replay of all of them."""
    e = _events(spark, d)
    cut = _half(e)
    half = overlay.compact(e.filter(F.col("block") <= cut)).drop("ordinal")
    # burned ids of the first half must stay dead: later events on them are dropped with them
    dead = e.filter((F.col("block") <= cut) & (F.col("op") == "burn")).select("asset_id").distinct()
    after = overlay.current_state(e.filter(F.col("block") > cut).join(dead, "asset_id", "left_anti"), half)
    return overlay.differences(after, overlay.current_state(e))


@query("SELECT greatest(0, epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(ts)))::BIGINT)::BIGINT AS age, greatest(0, epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(ts)))::BIGINT) <= 180 AS in_sync FROM events")
def sync_age(spark, d):
    age = C.age_seconds(F.lit("2030-01-01").cast("timestamp"), F.max("ts").cast("timestamp"))
    return table(spark, d, "events").agg(age.cast("long").alias("age")).withColumn("in_sync", F.col("age") <= 180)


def _assets(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.format_string("%d", F.col("o_orderkey") * 13), F.lit("."), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.when(F.col("o_orderkey") % 17 == 0, " bad").otherwise(" WAX")).alias("text"))


_ASSETS = "SELECT o_orderkey, (o_orderkey * 13) || '.' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN o_orderkey % 17 = 0 THEN ' bad' ELSE ' WAX' END AS text FROM orders"


@query(f"SELECT o_orderkey, CASE WHEN text LIKE '% WAX' THEN CAST(replace(split_part(text, ' ', 1), '.', '') AS DECIMAL(38,0)) END AS units, CASE WHEN text LIKE '% WAX' THEN 4 END AS precision, CASE WHEN text LIKE '% WAX' THEN 'WAX' END AS symbol FROM ({_ASSETS})")
def asset_parse(spark, d):
    return _assets(spark, d).withColumn("a", C.parse_asset(F.col("text"))).select("o_orderkey", "a.units", "a.precision", "a.symbol")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN '-' ELSE '' END || (o_orderkey * 37 // 10000) || '.' || lpad(CAST(o_orderkey * 37 % 10000 AS VARCHAR), 4, '0') || ' EOS' AS text FROM orders")
def asset_format(spark, d):
    units = F.when(F.col("o_orderkey") % 2 == 1, -F.col("o_orderkey") * 37).otherwise(F.col("o_orderkey") * 37)
    return table(spark, d, "orders").select("o_orderkey", C.format_asset(units, F.lit(4), F.lit("EOS")).alias("text"))


@query("SELECT o_orderkey, strftime(TIMESTAMP '2000-01-01' + to_milliseconds((1229428973 + o_orderkey) * 500), '%Y-%m-%dT%H:%M:%S.%g') AS iso FROM orders")
def slot_iso(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.slot_iso(F.col("o_orderkey") + 1229428973).alias("iso"))


@query("SELECT o_orderkey, 'wax-action-' || lpad(CAST(greatest(1, (o_orderkey + 999) // 1000) AS VARCHAR), 6, '0') AS index FROM orders")
def index_partition(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.index_name("wax", "action", F.col("o_orderkey"), 1000).alias("index"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) ELSE CAST(l_extendedprice AS VARCHAR) END AS price FROM lineitem")
def js_number(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.js_number(F.col("l_quantity").cast("double")).alias("quantity"), C.js_number(F.col("l_extendedprice").cast("double")).alias("price"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 ELSE -(o_orderkey + 1) // 2 END AS decoded FROM orders")
def zigzag(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.zigzag_decode(F.col("o_orderkey")).alias("decoded"))


@query("SELECT c_custkey, lower(hex(c_name)) AS digits, c_name AS back FROM customer")
def hex_round_trip(spark, d):
    digits = F.lower(F.hex("c_name"))
    return table(spark, d, "customer").select("c_custkey", digits.alias("digits"), F.unhex(digits).cast("string").alias("back"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", C.json_long(F.col("props"), "$.missing", "$.k").alias("k"))


@query("SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS BIGINT), -1) AS v FROM events")
def json_coerce(spark, d):
    v = F.when(F.col("event_id") % 3 == 0, F.lit("x")).otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", F.coalesce(C.json_long(F.to_json(F.struct(v.alias("first"))), "$.key", "$.first"), F.lit(-1)).alias("v"))


@query("SELECT p_partkey, 'brand=' || p_brand || ',size=' || CASE WHEN p_partkey % 2 = 0 THEN 'over' ELSE CAST(p_size AS VARCHAR) END AS merged FROM part")
def map_merge(spark, d):
    under = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    over = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("size"), F.lit("over"))).otherwise(F.create_map().cast("map<string,string>"))
    entries = F.array_sort(F.map_entries(C.merge_maps(under, over)))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("merged"))


@query("SELECT o_orderkey AS block, 'wax-delta-' || lpad(CAST(greatest(1, (o_orderkey + 9999) // 10000) AS VARCHAR), 6, '0') AS _index, o_orderkey || '-' || c_name || '-' || o_orderpriority AS _id FROM orders JOIN customer ON c_custkey = o_custkey")
def bulk_ids(spark, d):
    from ..sources import sinks

    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("block", F.col("o_orderkey"))
    return sinks.bulk_ids(o, "wax", "delta", "block", 10000, ["o_orderkey", "c_name", "o_orderpriority"]).select("block", "_index", "_id")


@query("SELECT (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicated, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS duplicated_orders")
def unique_keys(spark, d):
    from ..operators import validation

    return validation.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("duplicated")).crossJoin(validation.duplicate_keys(table(spark, d, "orders"), ["o_orderkey"]).agg(F.count("*").alias("duplicated_orders")))


@query("SELECT 'orders' AS collection, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def collection_counts(spark, d):
    from ..operators import validation

    return validation.collection_counts({n: table(spark, d, n) for n in ("orders", "customer", "events")})


@query("SELECT count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_quantity > 25) AS large FROM lineitem")
def run_statistics(spark, d):
    return grouping.conditional_counts(table(spark, d, "lineitem"), returned=F.col("l_returnflag") == "R", large=F.col("l_quantity") > 25)


@query("""WITH k AS (SELECT c_custkey, unnest(['K:' || c_name, 'L:' || c_mktsegment || c_nationkey]) AS key FROM customer)
SELECT key, string_agg(DISTINCT CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS accounts, count(DISTINCT c_custkey)::INTEGER AS n FROM k GROUP BY key""")
def key_holders(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("a"), F.explode(F.array(F.concat(F.lit("K:"), "c_name"), F.concat(F.lit("L:"), "c_mktsegment", F.col("c_nationkey").cast("string")))).alias("key"))
    return lookups.reverse_index(c, "key", "a").select("key", F.concat_ws(",", "members").alias("accounts"), "n")


@query("SELECT o_custkey, arg_max(o_orderstatus, struct_pack(o_orderdate, o_orderkey)) AS status, max(o_orderdate)::DATE AS day FROM orders GROUP BY 1")
def last_write_wins(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.max("o_orderdate").alias("day"))
    return o.withColumn("day", F.to_date("day"))


_NETWORKS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "none such")


@query(f"SELECT c_mktsegment AS network, n_name AS account, count(*) AS n, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DECIMAL(28,2) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment IN {_NETWORKS} GROUP BY 1, 2")
def network_fan_out(spark, d):
    """One question put to every network and the answers in one list; a network without an answer is left out."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    answer = lambda net: net.groupBy(F.col("n_name").alias("account")).agg(F.count("*").alias("n"), F.sum(money("c_acctbal")).cast("decimal(28,2)").alias("total"))
    return lookups.fan_out({name: c.filter(F.col("c_mktsegment") == name) for name in _NETWORKS}, answer)


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey)::INTEGER AS group_no FROM orders QUALIFY dense_rank() OVER (ORDER BY o_custkey) <= 40")
def batch_block_cap(spark, d):
    """Only the first 40 distinct blocks of a request are resolved."""
    o = table(spark, d, "orders")
    allowed = o.select("o_custkey").distinct().orderBy("o_custkey").limit(40)
    numbered = allowed.withColumn("group_no", F.row_number().over(Window.orderBy("o_custkey")))
    return o.join(numbered, "o_custkey").select("o_orderkey", "group_no")


_LIST = "SELECT list_sort(list(CAST(l_extendedprice AS DECIMAL(18,2)))) AS v FROM lineitem"


@query(f"SELECT share, v[1 + least(floor(len(v) * share)::BIGINT, len(v) - 1)] AS value FROM ({_LIST}), (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) t(share)")
def order_statistics(spark, d):
    l = table(spark, d, "lineitem").select(money("l_extendedprice").alias("v"))
    return validation.order_statistics(l, "v", (0.5, 0.9, 0.99))


@query("""SELECT o_orderkey, x.column, x.left, x.right FROM (SELECT o_orderkey, unnest(list_filter([
{'column': 'o_custkey', 'left': CAST(o_custkey AS VARCHAR), 'right': CAST(o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR)},
{'column': 'o_orderstatus', 'left': o_orderstatus, 'right': CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END}], lambda x: x.left IS DISTINCT FROM x.right)) AS x FROM orders WHERE o_orderkey % 11 <> 0)
UNION ALL SELECT o_orderkey, '*', 'present', NULL FROM orders WHERE o_orderkey % 11 = 0""")
def answer_mismatches(spark, d):
    """Two answers that should be the same, value by value; one of them is altered and lacks some rows."""
    o, k = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_orderkey")
    other = o.filter(k % 11 != 0).select("o_orderkey", (F.col("o_custkey") + F.when(k % 5 == 0, 1).otherwise(0)).alias("o_custkey"), F.when(k % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return validation.mismatches(o, other, ["o_orderkey"])


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 9223372036854775807 ELSE (o_custkey + o_orderkey)::BIGINT END AS added, CASE WHEN o_custkey % 2 = 0 THEN -9223372036854775808 ELSE -(o_custkey + o_orderkey)::BIGINT END AS taken,
((o_orderkey + o_custkey % 9) // (o_custkey % 9 + 1))::BIGINT AS pages FROM orders""")
def whole_numbers(spark, d):
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    big = F.when(c % 2 == 0, F.lit(2**63 - 1)).otherwise(c)
    small = F.when(c % 2 == 0, F.lit(-(2**63))).otherwise(-c)
    return table(spark, d, "orders").select("o_orderkey", C.saturating_add(big, k).alias("added"), C.saturating_add(small, -k).alias("taken"), C.ceil_div(k, c % 9 + 1).alias("pages"))


@query("""SELECT l_orderkey, '[' || string_agg('[' || l_linenumber || ',' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ']', ',' ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey, l_extendedprice) || ']' AS canonical FROM lineitem GROUP BY 1""")
def canonical_text(spark, d):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice")))
    pairs = F.transform(lines, lambda x: F.array(x["l_linenumber"].cast("double"), x["l_quantity"].cast("double")))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(pairs.alias("x"))
    return g.select("l_orderkey", C.canonical(F.col("x"), g.schema["x"].dataType).alias("canonical"))


@query(f"""SELECT o_orderkey, CASE WHEN text LIKE '% WAX' THEN 1 ELSE 0 END AS n_tokens, CASE WHEN text LIKE '% WAX' THEN CAST(CAST(replace(split_part(text, ' ', 1), '.', '') AS DECIMAL(38,0)) AS VARCHAR) END AS amount,
CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'token' || o_orderkey % 3 END AS contract, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 19)::INTEGER END AS precision FROM ({_ASSETS})""")
def token_lists(spark, d):
    """Lists of asset texts and of extended symbols, with malformed members."""
    k = F.col("o_orderkey")
    sym = F.when(k % 4 == 0, "nonsense").otherwise(F.concat((k % 19).cast("string"), F.lit(",WAX")))
    a = _assets(spark, d).select("o_orderkey", C.backed_tokens(F.array("text", F.lit("x"))).alias("t"), C.extended_symbols(F.array(F.struct(sym.alias("sym"), F.concat(F.lit("token"), (k % 3).cast("string")).alias("contract")))).alias("s"))
    return a.select("o_orderkey", F.size("t").alias("n_tokens"), F.get("t", F.lit(0))["amount"].alias("amount"), F.get("s", F.lit(0))["token_contract"].alias("contract"), F.get("s", F.lit(0))["token_precision"].alias("precision"))


@query("""SELECT o_orderkey, epoch(o_orderdate)::BIGINT + CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 5400 ELSE -7200 END AS seconds FROM orders""")
def expirations(spark, d):
    """Times without a zone, with Z and with offsets of both signs."""
    t = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("-01:30"), F.lit("+02:00")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(C.expiration(F.concat(t, zone))).alias("seconds"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'soft' WHEN 2 THEN 'hard' ELSE 'hard' END AS kind FROM part")
def map_differences(spark, d):
    """Attribute maps of JSON values: equal ones, a number as text on one side, another value, a key too many."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    ours = F.create_map(F.lit("name"), F.to_json(F.struct("p_name")), F.lit("size"), size)
    other = F.when(k % 4 == 1, F.concat(F.lit('"'), size, F.lit('"'))).when(k % 4 == 2, F.concat(F.lit('"x'), size, F.lit('"'))).otherwise(size)
    theirs = F.create_map(F.lit("name"), F.to_json(F.struct("p_name")), F.lit("size"), other)
    theirs = F.when(k % 4 == 3, F.map_concat(theirs, F.create_map(F.lit("more"), F.lit("1")))).otherwise(theirs)
    return table(spark, d, "part").select("p_partkey", C.map_difference(ours, theirs).alias("kind"))


@query("""SELECT '{"code":"token","scope":"bank","table":"accounts","primary_key":"' || o_orderkey || '","payer":"bank","block_num":' || o_orderkey // 100 || ',"present":true,' || CASE WHEN o_orderkey % 3 = 0 THEN '"value":"' || lower(hex(CAST(o_orderkey AS VARCHAR))) || '"}' ELSE '"data":{"k":' || o_custkey || '}}' END AS value FROM orders""")
def row_lines(spark, d):
    """Contract rows as lines, decoded or in hexadecimal."""
    from ..sources import sinks

    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.lit("token").alias("code"), F.lit("bank").alias("scope"), F.lit("accounts").alias("table"), k.cast("string").alias("primary_key"), F.lit("bank").alias("payer"), F.floor(k / 100).alias("block_num"), F.when(k % 3 != 0, F.to_json(F.struct(F.col("o_custkey").alias("k")))).alias("json"), k.cast("string").cast("binary").alias("value"))
    return sinks.row_lines(rows)
