"""Relational surface: projections, filters, joins, aggregates, ordering, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import CLOCK_SQL, SECONDS_SQL, access_records, hash_sql, registry, table
from trustweave.functions import faults
from trustweave.functions import scalar as S
from trustweave.operators import relational as R

QUERIES, ORACLES, query = registry()


# -- projections ---------------------------------------------------------------

@query("SELECT o_orderkey AS order_id, o_totalprice AS price FROM orders")
def foreach_project(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price"))


@query("SELECT o_custkey, o_totalprice FROM orders")
def project_positional(spark, d):
    return R.positional(table(spark, d, "orders"), 1, 3)


@query("""SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
          TRY_CAST(event_type AS INTEGER) AS bad, CAST(user_id AS VARCHAR) AS user_name FROM events""")
def project_cast(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("k"),
        F.col("event_type").try_cast("int").alias("bad"),
        F.col("user_id").cast("string").alias("user_name"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def flatten_tuple(spark, d):
    nested = table(spark, d, "orders").select(F.struct("o_orderkey", "o_orderstatus", "o_totalprice").alias("s"))
    return nested.select("s.*")


@query("SELECT conv_id, turn, role, text FROM conversations")
def flatten_bag(spark, d):
    bags = R.group_bags(table(spark, d, "conversations"), ["conv_id"], part=F.col("turn") % 3)
    return R.flatten_bag(bags)


@query("SELECT *, o_totalprice * 2 AS twice FROM orders")
def star_project(spark, d):
    return table(spark, d, "orders").select("*", (F.col("o_totalprice") * 2).alias("twice"))


@query("""SELECT s.s_suppkey AS "supplier::s_suppkey", s.s_nationkey AS "supplier::s_nationkey",
          s.s_name AS "supplier::s_name", s.s_acctbal AS "supplier::s_acctbal",
          n.n_nationkey AS "nation::n_nationkey", n.n_name AS "nation::n_name", n.n_regionkey AS "nation::n_regionkey"
          FROM supplier s JOIN nation n ON s_nationkey = n_nationkey""")
def qualified_names(spark, d):
    left = R.qualified(table(spark, d, "supplier"), "supplier")
    right = R.qualified(table(spark, d, "nation"), "nation")
    return left.join(right, F.col("`supplier::s_nationkey`") == F.col("`nation::n_nationkey`"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS country,
          CAST(c_acctbal AS INTEGER) AS balance, TRY_CAST(c_mktsegment AS DOUBLE) AS segment
          FROM (SELECT c_custkey, c_name, c_nationkey, trunc(c_acctbal) AS c_acctbal, c_mktsegment FROM customer)""")
def project_as_schema(spark, d):
    fields = {"id": "string", "name": "string", "country": "long", "balance": "int", "segment": "double"}
    return R.as_schema(table(spark, d, "customer"), fields)


# -- filters -----------------------------------------------------------------------

@query("""SELECT l_orderkey, l_quantity, l_discount FROM lineitem
          WHERE l_quantity <= 10 AND l_discount >= 0.05 AND l_extendedprice < 20000""")
def filter_compare(spark, d):
    keep = (F.col("l_quantity") <= 10) & (F.col("l_discount") >= 0.05) & (F.col("l_extendedprice") < 20000)
    return table(spark, d, "lineitem").filter(keep).select("l_orderkey", "l_quantity", "l_discount")


@query("SELECT doc_id, lang FROM documents WHERE NOT regexp_full_match(text, '(?s)[A-M].*') AND lang <> ''")
def filter_not_matches(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(~R.matches(F.col("text"), "(?s)[A-M].*") & ~R.matches(F.col("lang"), "")).select("doc_id", "lang")


@query("""SELECT doc_id, value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)
          WHERE len(string_split(value, ',')) = 3""")
def filter_arity(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("value"))
    return R.with_arity(lines, 3)


# -- joins ------------------------------------------------------------------------------

@query("""SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_equi(spark, d):
    return (
        table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice"))


@query("""SELECT l_orderkey, l_linenumber, p_partkey, l_quantity, p_size FROM lineitem JOIN part
          ON l_partkey = p_partkey AND l_quantity <= p_size AND l_extendedprice / l_quantity <= p_retailprice * 2""")
def join_theta_post(spark, d):
    on = (
        (F.col("l_partkey") == F.col("p_partkey"))
        & (F.col("l_quantity") <= F.col("p_size"))
        & (F.col("l_extendedprice") / F.col("l_quantity") <= F.col("p_retailprice") * 2))
    return table(spark, d, "lineitem").join(table(spark, d, "part"), on).select(
        "l_orderkey", "l_linenumber", "p_partkey", "l_quantity", "p_size")


# -- aggregates ---------------------------------------------------------------------------

@query("""SELECT conv_id, count(*) AS n_turns,
          string_agg(turn || ':' || role || ':' || text, '|' ORDER BY turn) AS bag
          FROM conversations GROUP BY conv_id""")
def group_by(spark, d):
    bags = R.group_bags(table(spark, d, "conversations"), ["conv_id"])
    line = lambda r: F.concat_ws(":", r.turn.cast("string"), r.role, r.text)
    ordered = F.array_sort(F.transform("bag", lambda r: F.struct(r.turn, r.role, r.text)))
    return bags.select(
        "conv_id", F.size("bag").cast("long").alias("n_turns"),
        F.array_join(F.transform(ordered, line), "|").alias("bag"))


@query("""SELECT o_custkey, CAST(sum(k) AS BIGINT) AS total FROM
          (SELECT o_custkey, CAST(o_totalprice AS INTEGER) AS k FROM
            (SELECT o_custkey, floor(o_totalprice) AS o_totalprice FROM orders)) GROUP BY o_custkey""")
def sum_by_key(spark, d):
    whole = F.floor("o_totalprice").cast("int")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(whole).alias("total"))


@query("""SELECT count(flag) AS cnt FROM (SELECT CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag FROM lineitem)""")
def group_all_count(spark, d):
    flag = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("flag")
    return R.count_all(table(spark, d, "lineitem").select(flag))


@query("SELECT l_returnflag, l_shipdate, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC")
def order_desc(spark, d):
    items = table(spark, d, "lineitem").select("l_returnflag", "l_shipdate", "l_extendedprice")
    return R.ordered_desc(items, "l_extendedprice")


# -- scalars -----------------------------------------------------------------------------------

@query(f"""SELECT 'doc' AS kind, doc_id AS id, CAST({hash_sql('text')} AS INTEGER) AS h FROM documents
           UNION ALL SELECT 'part', p_partkey, CAST({hash_sql('p_name')} AS INTEGER) FROM part
           UNION ALL SELECT 'event', event_id, CAST({hash_sql('event_type')} AS INTEGER) FROM events""")
def string_hash(spark, d):
    parts = [("doc", "documents", "doc_id", "text"), ("part", "part", "p_partkey", "p_name"),
             ("event", "events", "event_id", "event_type")]
    frames = [
        table(spark, d, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), S.string_hash(F.col(text)).alias("h"))
        for kind, name, key, text in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice,
          CAST(floor((l_extendedprice - 20000.0) / 75.5) AS INTEGER) AS bucket,
          CASE WHEN l_quantity = 25 THEN 0 WHEN l_quantity > 25 THEN 2147483647 ELSE -2147483648 END AS flat
          FROM lineitem""")
def bucketize(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        S.bucketize(F.col("l_extendedprice"), F.lit(20000.0), F.lit(75.5)).alias("bucket"),
        S.bucketize(F.col("l_quantity"), F.lit(25.0), F.lit(0.0)).alias("flat"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0
          ELSE l_discount * ln(l_discount / (l_discount + l_tax)) END, 9) AS term FROM lineitem""")
def jsd_term(spark, d):
    term = S.jsd_term(F.col("l_discount"), F.col("l_discount") + F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(term, 9).alias("term"))


@query("""SELECT l_orderkey, l_linenumber,
          round(exp(-0.5 * ((l_quantity - 25.5) / 14.4) ** 2 - ln(14.4) - 0.5 * ln(2 * pi())), 12) AS density
          FROM lineitem""")
def normal_density(spark, d):
    density = S.normal_density(F.col("l_quantity"), F.lit(25.5), F.lit(14.4))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(density, 12).alias("density"))


@query("""SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9.]+)', 1) AS DOUBLE) AS k,
          TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def to_double(spark, d):
    return table(spark, d, "events").select(
        "event_id", S.to_double(F.regexp_extract("props", "([0-9.]+)", 1)).alias("k"),
        S.to_double(F.col("event_type")).alias("bad"))


@query("""SELECT doc_id, pos - 1 AS pos, item FROM (
            SELECT doc_id, unnest(parts) AS item, unnest(range(1, len(parts) + 1)) AS pos FROM (
              SELECT doc_id, string_split(regexp_replace(text, ',+$', ''), ',') AS parts FROM documents))""")
def split_csv(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.posexplode(S.split_csv(F.col("text"))).alias("pos", "item")
    ).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT o_custkey, string_agg(k || ':' || printf('%.3f', v), ',' ORDER BY k) AS confidence FROM
          (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS k,
             count(*) + 100 + 0.5 AS v FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def confidence_string(spark, d):
    k = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    values = table(spark, d, "orders").groupBy("o_custkey", k.alias("k")).agg((F.count(F.lit(1)) + 100.5).alias("v"))
    return values.groupBy("o_custkey").agg(S.confidence_string(F.col("k"), F.col("v")).alias("confidence"))


@query("""SELECT event_id, CAST(0 AS INTEGER) AS col_idx, value AS confidence FROM events
          UNION ALL SELECT event_id, 3, CAST(user_id AS DOUBLE) FROM events""")
def parse_confidence(spark, d):
    text = F.concat(F.lit("0:"), F.col("value").cast("string"), F.lit(",3:"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select(
        "event_id", F.explode(S.parse_confidence(text)).alias("col_idx", "confidence"))


@query(f"""WITH {CLOCK_SQL} SELECT event_id, {SECONDS_SQL} AS seconds FROM clocks""")
def duration(spark, d):
    return access_records(table(spark, d, "events")).select(
        F.col("event_id"), S.duration(F.col("FirstAccess"), F.col("LastAccess")).alias("seconds"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_quantity / l_discount END AS ratio FROM lineitem""")
def density_ratio(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", S.density_ratio(F.col("l_quantity"), F.col("l_discount")).alias("ratio"))


# -- fault injection ------------------------------------------------------------------------------

@query("""SELECT o_orderkey, CAST(trunc(o_custkey * 1.5) AS INTEGER) AS up, CAST(trunc(o_custkey * -0.5) AS INTEGER) AS down,
          CAST(least(o_orderkey * 1000001.0, 2147483647) AS INTEGER) AS clamped FROM orders""")
def perturb(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", faults.perturb(F.col("o_custkey"), 0.5).alias("up"),
        faults.perturb(F.col("o_custkey"), -1.5).alias("down"),
        faults.perturb(F.col("o_orderkey"), 1000000.0).alias("clamped"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS n, TRUE AS in_bounds FROM part")
def random_generate(spark, d):
    bounds = table(spark, d, "part").select(
        "p_partkey", (F.col("p_partkey") % 7).cast("int").alias("origin"),
        (F.col("p_partkey") % 7 + F.col("p_size")).cast("int").alias("boundary"), F.col("p_size").alias("length"))
    drawn = faults.random_generate(bounds, seed=11)
    inside = (F.col("value") >= F.col("origin")) & (F.col("value") < F.col("boundary"))
    return drawn.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(inside).alias("in_bounds"))


@query("SELECT l_returnflag, count(*) AS total, TRUE AS near_rate FROM lineitem GROUP BY l_returnflag")
def drop(spark, d):
    items = table(spark, d, "lineitem")
    kept = faults.drop(items, 0.4, seed=7, key=["l_orderkey", "l_linenumber", "l_partkey"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("kept"))
    total = items.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("total"))
    near = F.abs(F.coalesce("kept", F.lit(0)) / F.col("total") - 0.4) < 4 / F.sqrt("total")
    return total.join(kept, "l_returnflag", "left").select("l_returnflag", "total", near.alias("near_rate"))
