"""A property graph over the relational tables.

Regions become repositories, nations and customers files, orders, parts and suppliers symbols;
foreign keys become relations. Every row of every table takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.functions.ids import edge_id, stable_id
from ripplet.functions.paths import extension, file_kind, is_test_path
from ripplet.model import EDGE_SCHEMA, NODE_SCHEMA, Graph, conform
from ripplet.session import dealt, table


def _key(prefix: str, *cols: Column) -> Column:
    return F.concat(F.lit(prefix), *[c.cast("string") for c in cols])


def region_key(col: str) -> Column:
    return _key("repository:", F.col(col))


def nation_key(col: str) -> Column:
    return _key("file:nation:", F.col(col))


def customer_key(col: str) -> Column:
    return _key("file:customer:", F.col(col))


def order_key(col: str) -> Column:
    return _key("symbol:order:", F.col(col))


def part_key(col: str) -> Column:
    return _key("symbol:part:", F.col(col))


def supplier_key(col: str) -> Column:
    return _key("symbol:supplier:", F.col(col))


def customer_path() -> Column:
    suffix = (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", ".spec.ts")
        .when(F.col("c_mktsegment") == "MACHINERY", ".d.ts")
        .otherwise(".ts")
    )
    return F.concat(
        F.lit("src/customers/"), F.lower("c_mktsegment"), F.lit("/c"),
        F.col("c_custkey").cast("string"), suffix)


def _files(df: DataFrame, key: Column, path: Column) -> DataFrame:
    return df.select(key.alias("canonical_key"), path.alias("path")).select(
        "*", F.lit("File").alias("label"), file_kind(F.col("path")).alias("kind"),
        file_kind(F.col("path")).alias("file_kind"), extension(F.col("path")).alias("extension"),
        is_test_path(F.col("path")).alias("is_test"), F.lit(False).alias("deleted"))


def commerce_nodes(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name: table(spark, folder, name)
    regions = read("region").select(
        region_key("r_regionkey").alias("canonical_key"), F.lit("Repository").alias("label"),
        F.lower("r_name").alias("name"))
    nations = _files(
        read("nation"), nation_key("n_nationkey"),
        F.concat(F.lit("src/nations/n"), F.col("n_nationkey").cast("string"), F.lit(".ts")))
    customers = _files(read("customer"), customer_key("c_custkey"), customer_path())
    homes = read("customer").select(F.col("c_custkey").alias("o_custkey"), customer_path().alias("path"))
    orders = read("orders").join(homes, "o_custkey").select(
        order_key("o_orderkey").alias("canonical_key"), F.lit("Symbol").alias("label"),
        _key("order", F.col("o_orderkey")).alias("name"),
        _key("order", F.col("o_orderkey")).alias("qualified_name"),
        F.lit("function").alias("kind"), "path", file_kind(F.col("path")).alias("file_kind"),
        (F.col("o_orderstatus") == "O").alias("exported"),
        F.lit(1).alias("start_line"), F.lit(9).alias("end_line"),
        F.concat(F.lit("function order"), F.col("o_orderkey").cast("string"), F.lit("(): "),
                 F.lower("o_orderpriority")).alias("signature"))
    parts = read("part").select(
        part_key("p_partkey").alias("canonical_key"), F.lit("Symbol").alias("label"),
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"),
        F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."),
                 F.replace("p_name", F.lit(" "), F.lit("-"))).alias("qualified_name"),
        F.when(F.col("p_type") == "ECONOMY", "interface").otherwise("function").alias("kind"),
        F.concat(F.lit("src/parts/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))),
                 F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"),
        F.lit("source").alias("file_kind"), (F.col("p_size") > 25).alias("exported"),
        F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"))
    suppliers = read("supplier").select(
        supplier_key("s_suppkey").alias("canonical_key"), F.lit("Symbol").alias("label"),
        _key("supplier", F.col("s_suppkey")).alias("name"),
        _key("supplier", F.col("s_suppkey")).alias("qualified_name"),
        F.lit("interface").alias("kind"),
        F.concat(F.lit("src/suppliers/s"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("path"),
        F.lit("source").alias("file_kind"), F.lit(True).alias("exported"),
        F.lit(1).alias("start_line"), F.lit(20).alias("end_line"))
    out = None
    for piece in (regions, nations, customers, orders, parts, suppliers):
        piece = conform(
            piece.withColumn("id", stable_id(F.col("canonical_key"))).withColumn("root_hash", F.lit("trade")),
            NODE_SCHEMA)
        out = piece if out is None else out.unionByName(piece)
    return out


def _edges(df: DataFrame, edge_type: str, source: Column, target: Column) -> DataFrame:
    ends = df.select(stable_id(source).alias("source"), stable_id(target).alias("target"))
    return ends.select(
        edge_id(F.lit(edge_type), F.col("source"), F.col("target")).alias("id"),
        F.lit(edge_type).alias("type"), "source", "target",
        F.lit("semantic").alias("confidence"), F.lit("trade").alias("root_hash"))


def commerce_edges(spark: SparkSession, folder: str) -> DataFrame:
    read = lambda name: table(spark, folder, name)
    customers, orders = read("customer"), read("orders")
    lines = read("lineitem")
    n = lines.count()  # from the files' footers
    unlike = lambda df, *cols: dealt(df.select(*cols), n, *cols).distinct()
    # Dealt by order, so that the join with orders finds the lines of an order where they already are.
    called = dealt(lines.select("l_orderkey", "l_partkey"), n, "l_orderkey").distinct()
    supplied = unlike(lines, "l_partkey", "l_suppkey")
    testing = unlike(
        customers.filter(F.col("c_mktsegment") == "HOUSEHOLD")
        .join(orders, F.col("c_custkey") == F.col("o_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey")), "c_custkey", "l_partkey")
    pieces = [
        _edges(read("nation"), "CONTAINS", region_key("n_regionkey"), nation_key("n_nationkey")),
        _edges(customers, "IMPORTS", customer_key("c_custkey"), nation_key("c_nationkey")),
        _edges(orders, "DEFINES", customer_key("o_custkey"), order_key("o_orderkey")),
        _edges(called, "CALLS", order_key("l_orderkey"), part_key("l_partkey")),
        _edges(supplied, "IMPLEMENTS", part_key("l_partkey"), supplier_key("l_suppkey")),
        _edges(testing, "TESTS", customer_key("c_custkey"), part_key("l_partkey")),
    ]
    out = conform(pieces[0], EDGE_SCHEMA)
    for piece in pieces[1:]:
        out = out.unionByName(conform(piece, EDGE_SCHEMA))
    return out


def commerce_graph(spark: SparkSession, folder: str) -> Graph:
    return Graph(commerce_nodes(spark, folder), commerce_edges(spark, folder))
