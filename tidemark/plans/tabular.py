"""Tabular analytics: scans, filters, groups, dimension join, sort, top-k."""

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import tabular as op
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import readers, writers

PRICE, QTY, DISC = "l_extendedprice", "l_quantity", "l_discount"


@query("""
SELECT l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem
""")
def scan_projected(t):
    cols = ["l_suppkey", "l_linenumber", QTY, PRICE, DISC]
    return readers.scan_parquet(t.spark, t.path("lineitem"), cols)


@query("""
SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_quantity), 4) AS avg_qty
FROM lineitem
""")
def direct_file_agg(t):
    return readers.query_files_in_place(
        t.spark,
        """SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price,
                  round(avg(l_quantity), 4) AS avg_qty FROM {lineitem}""",
        lineitem=t.path("lineitem"),
    )


@query("""
SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS avg_balance
FROM customer WHERE c_acctbal > 20 GROUP BY c_nationkey
""")
def csv_roundtrip_agg(t):
    path = writers.write_csv(t.customer, scratch_path(t.spark, "csv"))
    back = readers.scan_csv(t.spark, path, t.customer.schema)
    return op.selective_group(back, F.col("c_acctbal") > 20, ["c_nationkey"], {"avg_balance": "c_acctbal"})


@query("SELECT count(*) AS n FROM lineitem")
def materialised_count(t):
    name = "tidemark_lineitem"
    table = writers.create_table_as(t.lineitem.select("l_orderkey", "l_suppkey", PRICE, DISC), name)
    return table.agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 5 AND l_extendedprice > 20000")
def filter_count(t):
    return op.count_where(t.lineitem, F.col(QTY) > 5, F.col(PRICE) > 20000)


@query("""
SELECT l_suppkey, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price
FROM lineitem WHERE l_extendedprice > 20000 GROUP BY l_suppkey
""")
def selective_group_avg(t):
    return op.selective_group(t.lineitem, F.col(PRICE) > 20000, ["l_suppkey"], {"avg_price": PRICE})


@query("""
SELECT l_suppkey, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price,
       round(avg(l_discount), 4) AS avg_discount
FROM lineitem GROUP BY l_suppkey
""")
def group_avg(t):
    return op.group_agg(t.lineitem, ["l_suppkey"], {"avg_price": PRICE, "avg_discount": DISC})


@query("""
SELECT l_suppkey, l_linenumber, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price
FROM lineitem GROUP BY l_suppkey, l_linenumber
ORDER BY n DESC, l_suppkey ASC NULLS LAST, l_linenumber ASC NULLS LAST LIMIT 20
""")
def group_topk(t):
    return op.group_topk(t.lineitem, ["l_suppkey", "l_linenumber"], {"avg_price": PRICE}, 20)


@query("""
SELECT r_name, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
""")
def dim_join_agg(t):
    dim = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return op.dim_join_agg(t.lineitem, dim, "l_suppkey", "s_suppkey", "r_name", {"avg_price": PRICE})


SORT_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", QTY, PRICE, DISC]


@query(f"""
SELECT {', '.join(SORT_COLUMNS)} FROM lineitem
ORDER BY l_extendedprice DESC NULLS LAST, l_discount DESC NULLS LAST,
         l_orderkey NULLS LAST, l_linenumber NULLS LAST, l_partkey NULLS LAST, l_suppkey NULLS LAST
""")
def full_sort(t):
    return op.full_sort(t.lineitem.select(*SORT_COLUMNS), *_sort_order())


def _sort_order():
    tie = [F.asc_nulls_last(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return [F.desc_nulls_last(PRICE), F.desc_nulls_last(DISC), *tie]


@query(f"""
SELECT {', '.join(SORT_COLUMNS)}, row_number() OVER (
  ORDER BY l_extendedprice DESC NULLS LAST, l_discount DESC NULLS LAST,
           l_orderkey NULLS LAST, l_linenumber NULLS LAST, l_partkey NULLS LAST, l_suppkey NULLS LAST) AS position
FROM lineitem
""")
def full_sort_positions(t):
    """The order as a column, so that it can be compared."""
    return op.ordered_positions(t.lineitem.select(*SORT_COLUMNS), *_sort_order())


@query("""
SELECT o_orderpriority,
       coalesce(CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR), '-') AS F,
       coalesce(CAST(count(*) FILTER (o_orderstatus = 'O') AS VARCHAR), '-') AS O,
       coalesce(CAST(nullif(count(*) FILTER (o_orderstatus = 'X'), 0) AS VARCHAR), '-') AS X
FROM orders GROUP BY o_orderpriority
""")
def result_grid(t):
    return op.pivot_grid(t.orders, "o_orderpriority", "o_orderstatus", F.count(F.lit(1)), ["F", "O", "X"], empty="-")


@query("SELECT DISTINCT source FROM documents ORDER BY source NULLS LAST")
def distinct_sources(t):
    return t.documents.select("source").distinct().orderBy(F.asc_nulls_last("source"))


@query("""
SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1
""")
def duplicate_ids(t):
    return op.duplicates(t.orders, "o_custkey")


@query("""
WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
     b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM a JOIN b USING (k)
""")
def multiset_shared(t):
    def side(flag):
        return t.lineitem.filter(F.col("l_returnflag") == flag).groupBy(
            F.col("l_suppkey").alias("k")
        ).agg(F.count("*").alias("n"))

    return op.multiset_intersect_size(side("R"), side("A"), "k")


@query("""
SELECT e.event_id, e.user_id FROM events e
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_mktsegment = 'BUILDING')
""")
def unknown_clients(t):
    from tidemark.operators.cache import rejected

    accounts = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("user_id"))
    return rejected(t.events, accounts, "user_id").select("event_id", "user_id")


@query("""
SELECT e.event_id, e.user_id, c.c_name FROM events e JOIN customer c ON c.c_custkey = e.user_id
WHERE c.c_mktsegment = 'BUILDING'
""")
def known_clients(t):
    from tidemark.operators.cache import accepted

    accounts = t.customer.filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("user_id"), "c_name"
    )
    return accepted(t.events, accounts, "user_id").select("event_id", "user_id", "c_name")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def strict_lookup(t):
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    found = op.strict_lookup(t.orders.select("o_orderkey", "o_custkey"), names, ["o_custkey"], "customer")
    return found.select("o_orderkey", "c_name", "c_mktsegment")


@query("""
SELECT event_id, strftime(ts, '%H:%M:%S') AS at, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events
""")
def event_clock(t):
    return t.events.select(
        "event_id", labels.time_of_day(F.col("ts")).alias("at"), labels.iso_utc(F.col("ts")).alias("iso")
    )


@query("""
SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(value) * 100) AS avg_value
FROM events GROUP BY 1
""")
def json_props_agg(t):
    """Cents keep the average of the small groups independent of the order of addition."""
    parsed = t.events.withColumn("k", F.from_json("props", "k int")["k"])
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double")
    return parsed.groupBy("k").agg(
        F.count("*").alias("n"), (cents / (F.count("value") * 100)).alias("avg_value")
    )


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, length(o_orderstatus) AS n_tags,
       o_totalprice > 100000 AS large
FROM orders
""")
def json_roundtrip(t):
    row = F.struct(
        F.col("o_orderkey").alias("id"),
        F.array(F.col("o_orderstatus")).alias("tags"),
        (F.col("o_totalprice") > 100000).alias("active"),
        F.struct(
            F.col("o_totalprice").alias("a"), F.array(F.length("o_orderpriority")).alias("b"),
            F.col("o_orderpriority").alias("c"),
        ).alias("nested"),
    )
    schema = (
        "id bigint, tags array<string>, active boolean, "
        "nested struct<a: double, b: array<int>, c: string>"
    )
    parsed = t.orders.select(F.from_json(F.to_json(row), schema).alias("r"))
    return parsed.select(
        F.col("r.id").alias("o_orderkey"),
        F.col("r.tags")[0].alias("o_orderstatus"),
        F.col("r.nested.a").alias("o_totalprice"),
        F.col("r.nested.c").alias("o_orderpriority"),
        F.size("r.tags").cast("bigint").alias("n_tags"),
        F.col("r.active").alias("large"),
    )


@query("""
SELECT o_orderpriority,
       '{"' || string_agg(o_orderstatus || '":' || n, ',"' ORDER BY o_orderstatus) || '}' AS json
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
GROUP BY o_orderpriority
""")
def nested_json(t):
    counts = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return writers.nested_json(counts, "o_orderpriority", "o_orderstatus", "n")


@query("""
SELECT n_nationkey, n_name, list_sum(list_transform(string_split(n_name, ''), lambda x: unicode(x)))::BIGINT AS code_sum,
       (list_sum(list_transform(string_split(n_name, ''), lambda x: unicode(x))) % 3)::INTEGER AS bucket
FROM nation
""")
def codepoint_bucket(t):
    from tidemark.functions.text import code_point_sum

    total = code_point_sum(F.col("n_name"))
    return t.nation.select(
        "n_nationkey", "n_name", total.alias("code_sum"), (total % 3).cast("int").alias("bucket")
    )


@query("""
SELECT c_custkey, c_name || '-unit' || i AS child_id, c_name || ' unit ' || i AS child_name, 'closed' AS status
FROM customer, unnest(generate_series(1, 1 + c_custkey % 3)) AS s(i)
""")
def generated_children(t):
    n = (F.lit(1) + F.col("c_custkey") % 3).cast("int")
    child = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.concat(F.col("c_name"), F.lit("-unit"), i.cast("string")).alias("child_id"),
            F.concat(F.col("c_name"), F.lit(" unit "), i.cast("string")).alias("child_name"),
            F.lit("closed").alias("status"),
        ),
    )
    return t.customer.select("c_custkey", F.inline(child))


@query()
def format_sizes(t):
    from tidemark.operators.samples import format_sizes as ratio

    csv = scratch_path(t.spark, "sizes-csv")
    parquet = scratch_path(t.spark, "sizes-parquet")
    writers.write_csv(t.orders, csv)
    t.orders.write.parquet(parquet)
    files = None
    for name, path in (("csv", csv), ("parquet", parquet)):
        part = t.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
            F.lit(name).alias("format"), F.col("length").alias("bytes")
        )
        files = part if files is None else files.unionByName(part)
    return ratio(files)
