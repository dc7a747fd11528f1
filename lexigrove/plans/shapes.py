"""The relational query shapes of a dictionary store, on the driver's tables.

Each shape is declared once as a DataFrame plan and once as SQL for DuckDB.
Key lists are joined, never collected; ranks are computed inside groups, and the
only global order is that of a single group's list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numerals import percentage
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The word pattern shared by both dialects: runs of Latin letters.
LETTERS = "[a-zà-öø-ÿß]+"


def shape(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def keys(spark: SparkSession, values: list[int], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


@shape("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 32, 100, 32)")
def lookup_pk(spark, d):
    wanted = keys(spark, [1, 7, 32, 100, 32], "o_orderkey")
    return table(spark, d, "orders").join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@shape("SELECT c_custkey FROM customer WHERE c_custkey IN (1, 2, 3, 3, 5, 8, 13, 13, 21) AND c_acctbal > 0")
def lookup_semi_in_list(spark, d):
    wanted = keys(spark, [1, 2, 3, 3, 5, 8, 13, 13, 21], "c_custkey")
    return table(spark, d, "customer").where("c_acctbal > 0").join(wanted, "c_custkey", "left_semi").select("c_custkey")


@shape(
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem "
    "WHERE (l_orderkey, l_linenumber) IN ((1, 1), (3, 2), (5, 1), (7, 4))"
)
def lookup_two_key(spark, d):
    wanted = spark.createDataFrame([(1, 1), (3, 2), (5, 1), (7, 4)], "l_orderkey long, l_linenumber int")
    return table(spark, d, "lineitem").join(wanted, ["l_orderkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@shape(
    "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE o_orderkey IS NULL AND n_regionkey = 1"
)
def candidates_no_kanji(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey = 1")
    ordered = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return (
        table(spark, d, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(ordered, "c_custkey", "left_anti")
        .select("c_custkey", "n_name")
    )


@shape(
    "SELECT DISTINCT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey "
    "WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' AND l_linenumber = 1"
)
def candidates_three_way(spark, d):
    first = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").join(first, "o_orderkey", "left_semi")
    return (
        table(spark, d, "customer")
        .where("c_mktsegment = 'BUILDING'")
        .join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .select("c_custkey")
    )


@shape(
    "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey "
    "WHERE p_name LIKE '%ring%' AND s_acctbal > 5000 AND l_quantity > 45"
)
def contains_three_way(spark, d):
    part = table(spark, d, "part").where(F.col("p_name").contains("ring"))
    supplier = table(spark, d, "supplier").where("s_acctbal > 5000")
    return (
        table(spark, d, "lineitem")
        .where("l_quantity > 45")
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
        .select("l_orderkey", "l_linenumber", "p_name", "s_name")
    )


@shape("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1")
def headword(spark, d):
    return table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey")


@shape("SELECT o_custkey, l_partkey FROM orders, lineitem WHERE o_orderkey = l_orderkey")
def derived_bag_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey")


@shape(
    "SELECT DISTINCT s_suppkey, s_name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey "
    "WHERE l_returnflag IN ('R', 'A') AND l_quantity = 50"
)
def distinct_with_pos(spark, d):
    shipped = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "A") & (F.col("l_quantity") == 50))
    return table(spark, d, "supplier").join(shipped, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey", "s_name")


@shape(
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' "
    "UNION SELECT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'"
)
def own_union_derived(spark, d):
    customer = table(spark, d, "customer")
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    own, derived = customer.where("c_mktsegment = 'MACHINERY'"), customer.join(pending, "c_custkey", "left_semi")
    return own.select("c_custkey", "c_name").union(derived.select("c_custkey", "c_name")).distinct()


@shape("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(ring|g.ar)$')")
def regex_scan(spark, d):
    return table(spark, d, "part").where(F.col("p_name").rlike("(ring|g.ar)$")).select("p_partkey", "p_name")


@shape(
    "WITH t AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 7 END AS common FROM part) "
    "SELECT p_partkey, common, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN common IS NULL THEN 2 WHEN common = 0 THEN 1 ELSE 0 END, common, p_partkey) AS place FROM t"
)
def common_order(spark, d):
    common = F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 7)
    order = Window.partitionBy("p_brand").orderBy(F.when(F.col("common").isNull(), 2).when(F.col("common") == 0, 1).otherwise(0), "common", "p_partkey")
    return table(spark, d, "part").select("p_partkey", "p_brand", common.alias("common")).select("p_partkey", "common", F.row_number().over(order).alias("place"))


@shape("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def no_link_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@shape("SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey IN (1, 2, 3)")
def distinct_derived(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_suppkey").isin(1, 2, 3)).select("l_partkey").distinct()


@shape(
    "WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_id % 50 + 1 END AS via FROM events) "
    "SELECT e.event_id, c.c_custkey FROM e JOIN customer c ON c.c_custkey = CASE WHEN via IS NOT NULL THEN via ELSE user_id END"
)
def parents_coalesce_join(spark, d):
    via = F.when(F.col("event_type") != "click", F.col("event_id") % 50 + 1)
    linked = table(spark, d, "events").select("event_id", F.coalesce(via, "user_id").alias("c_custkey"))
    return linked.join(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("event_id", "c_custkey")


@shape("SELECT conv_id, string_agg(role, '; ' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def sense_gloss_agg(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.expr("listagg(role, '; ') WITHIN GROUP (ORDER BY turn)").alias("roles"), F.count(F.lit(1)).alias("n")
    )


@shape(
    "SELECT p_partkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY p_partkey ORDER BY l_returnflag, l_orderkey, l_linenumber) AS place "
    "FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size < 10 AND l_returnflag IN ('A', 'R')"
)
def prop_rows_tagged(spark, d):
    order = Window.partitionBy("p_partkey").orderBy("l_returnflag", "l_orderkey", "l_linenumber")
    tagged = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    return (
        table(spark, d, "part").where("p_size < 10").join(tagged, F.col("l_partkey") == F.col("p_partkey"))
        .select("p_partkey", "l_returnflag", "l_linestatus", F.row_number().over(order).alias("place"))
    )


@shape(
    "WITH g AS (SELECT o_custkey, o_orderdate, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY ALL) "
    "SELECT o_custkey, o_orderdate, n, round(spent, 2) AS spent FROM g QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) = 1"
)
def first_per_group(spark, d):
    first = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    daily = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("spent"))
    return daily.withColumn("_at", F.row_number().over(first)).where("_at = 1").select("o_custkey", "o_orderdate", "n", F.round("spent", 2).alias("spent"))


@shape(
    "SELECT DISTINCT a.l_suppkey, a.l_linestatus FROM lineitem a WHERE NOT EXISTS "
    "(SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R')"
)
def self_anti(spark, d):
    lines = table(spark, d, "lineitem")
    returned = lines.where("l_returnflag = 'R'").select("l_orderkey")
    return lines.join(returned, "l_orderkey", "left_anti").select("l_suppkey", "l_linestatus").distinct()


@shape("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING bool_and(l_linestatus = 'O')")
def all_members_flagged(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "O").alias("all"))
    return table(spark, d, "orders").join(lines.where("all"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@shape(
    "SELECT DISTINCT a.user_id, b.event_type FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type WHERE a.event_type = 'purchase'"
)
def self_tag_join(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type")
    tagged = events.where("event_type = 'purchase'").select("user_id").distinct()
    return events.where("event_type <> 'purchase'").distinct().join(tagged, "user_id").select("user_id", "event_type")


@shape("SELECT n_nationkey, n_name FROM nation WHERE n_name <> ALL (SELECT * FROM (VALUES ('FRANCE'), ('NATION_3'), ('BRAZIL')) v(x))")
def not_in_order(spark, d):
    return table(spark, d, "nation").where(~F.col("n_name").isin("FRANCE", "NATION_3", "BRAZIL")).select("n_nationkey", "n_name")


@shape(
    "SELECT DISTINCT ON (l_partkey, l_suppkey) l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem "
    "WHERE (l_quantity > 25) IS NOT FALSE ORDER BY l_partkey, l_suppkey, l_orderkey, l_linenumber"
)
def distinct_on(spark, d):
    kept = table(spark, d, "lineitem").where(F.coalesce(F.col("l_quantity") > 25, F.lit(True)))
    return (
        kept.groupBy("l_partkey", "l_suppkey")
        .agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("first"))
        .select("l_partkey", "l_suppkey", "first.l_orderkey", "first.l_linenumber")
    )


_SETS = "SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS s FROM orders GROUP BY o_custkey"


@shape(f"WITH g AS ({_SETS}) SELECT array_to_string(s, ',') AS members, count(*) AS n, min(o_custkey) AS least FROM g GROUP BY s")
def set_identity_intersect(spark, d):
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    return sets.groupBy(F.array_join("s", ",").alias("members")).agg(F.count(F.lit(1)).alias("n"), F.min("o_custkey").alias("least"))


@shape(
    "WITH k AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS s FROM orders) "
    "SELECT DISTINCT a.k, a.s FROM k a JOIN (VALUES (CAST(NULL AS VARCHAR)), ('F')) v(s) ON a.s IS NOT DISTINCT FROM v.s"
)
def null_safe_dedup(spark, d):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), status.alias("s"))
    wanted = spark.createDataFrame([(None,), ("F",)], "w string")
    return rows.join(wanted, F.col("s").eqNullSafe(F.col("w")), "left_semi").distinct()


@shape("SELECT n_nationkey, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_nationkey) AS next_id FROM nation")
def next_id(spark, d):
    top = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("top"))
    nation = table(spark, d, "nation")  # ids are dealt to a batch of new entries, here 25
    return nation.join(F.broadcast(top)).select("n_nationkey", (F.col("top") + F.row_number().over(Window.orderBy("n_nationkey"))).alias("next_id"))


@shape(
    "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ord "
    "FROM lineitem WHERE NOT (l_linenumber = 1 AND l_returnflag = 'N')"
)
def reorder_ord(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    kept = table(spark, d, "lineitem").where("NOT (l_linenumber = 1 AND l_returnflag = 'N')")
    return kept.select("l_orderkey", "l_linenumber", (F.row_number().over(order) - 1).alias("ord"))


@shape(
    "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, "
    "(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation"
)
def entry_stats(spark, d):
    count = lambda name, key, out: table(spark, d, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(out))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        table(spark, d, "nation").select("n_nationkey")
        .join(count("customer", "c_nationkey", "n_customers"), "n_nationkey", "left")
        .join(count("supplier", "s_nationkey", "n_suppliers"), "n_nationkey", "left")
        .select("n_nationkey", zero("n_customers"), zero("n_suppliers"))
    )


@shape(
    "SELECT l_suppkey, l_returnflag, count(*) AS n, printf('%.2f%%', 100.0 * count(*) / greatest(sum(count(*)) OVER (PARTITION BY l_suppkey), 1)) AS share "
    "FROM lineitem GROUP BY l_suppkey, l_returnflag"
)
def reading_stats(spark, d):
    total = F.sum("n").over(Window.partitionBy("l_suppkey"))
    counted = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", percentage(F.lit(100.0) * F.col("n") / F.greatest(total, F.lit(1))))


#: A word of the lexicon occurs so often.
OFTEN = 20
_WORDS_SQL = f"""words AS (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '{LETTERS}')) AS word FROM documents),
lexicon AS (SELECT word, count(*) AS n FROM words GROUP BY word HAVING count(*) >= {OFTEN})"""
#: Also: all runs and the places of words of the lexicon in them.
SPANS_SQL = f"""{_WORDS_SQL},
runs AS (SELECT DISTINCT word AS run FROM words),
starts AS (SELECT run, unnest(range(0, length(run))) AS start FROM runs),
ends AS (SELECT run, start, unnest(range(start + 1, least(length(run), start + (SELECT max(length(word)) FROM lexicon)) + 1)) AS stop FROM starts),
placed AS (SELECT run, start, stop, word, n FROM (SELECT run, start, stop, substr(run, start + 1, stop - start) AS word FROM ends) JOIN lexicon USING (word))"""


def words(spark, d) -> DataFrame:
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", found.alias("word"))


def lexicon(spark, d) -> DataFrame:
    counted = words(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= OFTEN)


@shape(f"WITH {SPANS_SQL} SELECT run, start, stop, word, n FROM placed")
def spans_lookup(spark, d):
    """All substrings of all words that are in the lexicon: spans joined, not looked up one by one."""
    counted = words(spark, d).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return placed(counted).select("run", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "word", "n")


def placed(counted: DataFrame) -> DataFrame:
    """(run, start, stop, word, n): the words of the lexicon in each word of ``counted`` (word, n)."""
    lex = counted.where(F.col("n") >= OFTEN)
    longest = lex.agg(F.max(F.char_length("word"))).scalar()  # no longer span can be a word
    return spans(counted.select(F.col("word").alias("run")), longest).join(lex, "word").select("run", "start", "stop", "word", "n")


def spans(runs: DataFrame, longest: Column) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(0), F.char_length("run") - 1)).alias("start")
    stops = F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + longest, F.char_length("run")))).alias("stop")
    return runs.select("run", starts).select("run", "start", stops).withColumn("word", F.expr("substring(run, start + 1, stop - start)"))


@shape(
    "SELECT user_id, event_id, value FROM events QUALIFY 2 * value >= max(value) OVER (PARTITION BY user_id, event_type)"
)
def cull_half_max(spark, d):
    top = F.max("value").over(Window.partitionBy("user_id", "event_type"))
    return table(spark, d, "events").withColumn("_top", top).where("2 * value >= _top").select("user_id", "event_id", "value")


@shape(
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY 3 * o_totalprice >= 2 * first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
)
def two_thirds_first(spark, d):
    best = F.first("o_totalprice").over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("_best", best).where("3 * o_totalprice >= 2 * _best").select("o_custkey", "o_orderkey")


@shape("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def lead_reading(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_role"))


@shape(
    "WITH s AS (SELECT user_id, event_id AS a, event_id + 3 AS b FROM events), g AS (SELECT user_id, a, lag(b) OVER (PARTITION BY user_id ORDER BY a) AS before FROM s) "
    "SELECT user_id, before AS gap_start, a AS gap_stop FROM g WHERE before < a"
)
def gap_rows(spark, d):
    before = F.lag(F.col("event_id") + 3).over(Window.partitionBy("user_id").orderBy("event_id"))
    return (
        table(spark, d, "events").select("user_id", before.alias("gap_start"), F.col("event_id").alias("gap_stop")).where("gap_start < gap_stop")
    )


@shape(
    "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) "
    "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events"
)
def carry_forward(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, d, "events").select("user_id", "event_id", F.last(bought, ignorenulls=True).over(w).alias("carried"))


@shape(f"""WITH {_WORDS_SQL}
SELECT word, n, n * CASE length(word) WHEN 1 THEN 1 WHEN 2 THEN 8 WHEN 3 THEN 24 WHEN 4 THEN 40 WHEN 5 THEN 60 ELSE length(word) * 12 END AS score FROM lexicon""")
def length_score(spark, d):
    length = F.char_length("word")
    steps = F.element_at(F.array(*map(F.lit, (1, 8, 24, 40, 60))), F.least(length, F.lit(5)))
    return lexicon(spark, d).withColumn("score", F.col("n") * F.when(length <= 5, steps).otherwise(length * 12))


@shape(
    "SELECT a.doc_id, a.l AS line, b.l AS next_line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM documents) a "
    "JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM documents) b "
    "ON a.doc_id = b.doc_id AND b.l = a.l + 1 JOIN (VALUES ('T', 'A'), ('E', 'T'), ('D', 'E')) r(x, y) ON left(a.t, 1) = r.x AND left(b.t, 1) = r.y"
)
def pair_rules(spark, d):
    """Adjacent tokens matched with a rule table: one pass with lead, no self-join."""
    rules = spark.createDataFrame([("T", "A"), ("E", "T"), ("D", "E")], "x string, y string")
    lines = table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("t"))
    pairs = F.explode(F.filter(F.transform("t", lambda x, i: F.struct((i + 1).alias("line"), F.left(x, F.lit(1)).alias("x"), F.left(F.get("t", i + 1), F.lit(1)).alias("y"))), lambda p: p["y"].isNotNull()))
    found = lines.select("doc_id", pairs.alias("p")).select("doc_id", "p.*")
    return found.join(rules, ["x", "y"]).select("doc_id", F.col("line").cast("long"), (F.col("line") + 1).cast("long").alias("next_line"))


_FROM, _TO = "àâäéèêëîïôöùûüçñáíóúß", "aaaeeeeiioouuucnaious"


@shape(f"SELECT doc_id, md5(regexp_replace(translate(lower(text), '{_FROM}', '{_TO}'), '[^a-z0-9]+', ' ', 'g')) AS normal FROM documents")
def normalize_text(spark, d):
    folded = F.regexp_replace(F.translate(F.lower("text"), _FROM, _TO), "[^a-z0-9]+", " ")
    return table(spark, d, "documents").select("doc_id", F.md5(folded).alias("normal"))


@shape(
    "WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+|[^0-9]+')) AS run, generate_subscripts(regexp_extract_all(text, '[0-9]+|[^0-9]+'), 1) - 1 AS place FROM documents WHERE regexp_matches(text, '[0-9]')) "
    "SELECT doc_id, place, regexp_matches(run, '^[0-9]') AS digits, length(run) AS n FROM r"
)
def split_runs(spark, d):
    runs = F.regexp_extract_all("text", F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    found = table(spark, d, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.posexplode(runs).alias("place", "run"))
    return found.select("doc_id", F.col("place").cast("long"), F.col("run").rlike("^[0-9]").alias("digits"), F.char_length("run").alias("n"))


@shape(
    "WITH r AS (SELECT c_custkey, unnest(regexp_extract_all(c_name, '[0-9]+|[^0-9]+')) AS run, generate_subscripts(regexp_extract_all(c_name, '[0-9]+|[^0-9]+'), 1) AS place FROM customer), "
    "o AS (SELECT *, sum(length(run)) OVER (PARTITION BY c_custkey ORDER BY place) AS stop FROM r) "
    "SELECT c_custkey, CAST(stop - length(run) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM o WHERE regexp_matches(run, '^[0-9]')"
)
def char_groups(spark, d):
    """Runs of digits with offsets, without leaving the row."""
    runs = F.regexp_extract_all("c_name", F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.char_length(x)).alias("at"),
        F.when(x.rlike("^[0-9]"), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.char_length(x)).alias("stop"))))).otherwise(acc["found"]).alias("found"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))
    groups = F.aggregate(runs, zero, step, lambda acc: acc["found"])
    return table(spark, d, "customer").select("c_custkey", F.inline(groups)).select("c_custkey", F.col("start").cast("long"), F.col("stop").cast("long"))


@shape("SELECT o_orderkey, CAST(regexp_extract(CAST(o_orderkey AS VARCHAR), '[0-9]+') AS BIGINT) AS parsed FROM orders")
def number_parse(spark, d):
    digits = F.split(F.col("o_orderkey").cast("string"), "")
    value = F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc * 10 + c.cast("long"))
    return table(spark, d, "orders").select("o_orderkey", value.alias("parsed"))


_RULES = [("ka", "カ"), ("ki", "キ"), ("k", "ッ"), ("sha", "シャ"), ("shi", "シ"), ("a", "ア"), ("i", "イ"), ("n", "ン"), ("na", "ナ"), ("ni", "ニ")]
_INPUTS = ["kani", "shika", "kanna", "nanika", "xyz", "a"]
_RULES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _RULES)
_INPUTS_SQL = ", ".join(f"('{x}')" for x in _INPUTS)


@shape(f"""WITH RECURSIVE rules(romaji, kana) AS (VALUES {_RULES_SQL}), inputs(word) AS (VALUES {_INPUTS_SQL}),
step(word, kana, rest) AS (
    SELECT word, '', word FROM inputs
    UNION ALL SELECT s.word, s.kana || r.kana, substr(s.rest, length(r.romaji) + 1) FROM step s JOIN rules r ON left(s.rest, length(r.romaji)) = r.romaji)
SELECT word, kana FROM step WHERE rest = ''""")
def romaji_expand(spark, d):
    return spark.sql(f"""WITH RECURSIVE rules(romaji, kana) AS (VALUES {_RULES_SQL}), inputs(word) AS (VALUES {_INPUTS_SQL}),
        step(word, kana, rest) AS (
            SELECT word, CAST('' AS STRING), word FROM inputs
            UNION ALL SELECT s.word, concat(s.kana, r.kana), substring(s.rest, length(r.romaji) + 1) FROM step s JOIN rules r ON left(s.rest, length(r.romaji)) = r.romaji)
        SELECT word, kana FROM step WHERE rest = ''""")


@shape(
    "SELECT o_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity, min(l_partkey) AS first_part FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"
)
def json_doc(spark, d):
    """Nested documents built with structs, written as JSON and read back."""
    lines = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))))
    orders = table(spark, d, "orders")
    docs = orders.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(lines.alias("lines"))
    text = docs.select("o_orderkey", F.to_json(F.struct("lines")).alias("json"))
    back = F.from_json("json", "lines array<struct<line:int,part:long,quantity:double>>")["lines"]
    add: Column = F.aggregate(back, F.lit(0.0), lambda acc, x: acc + x["quantity"])
    return text.select("o_orderkey", F.size(back).cast("long").alias("n_lines"), add.alias("quantity"), F.array_min(F.transform(back, lambda x: x["part"])).alias("first_part"))
