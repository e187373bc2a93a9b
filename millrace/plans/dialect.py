"""Queries written once as SQL: a text for Spark over temporary views, and the same in DuckDB's dialect as its oracle."""

from __future__ import annotations

from collections.abc import Callable

from millrace.catalog import ORACLE_SQL, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Spark:
    nan, double = "double('NaN')", "DOUBLE"
    map_, filter_, size = "transform", "filter", "size"

    def lam(self, v, body):
        return f"{v} -> {body}"

    def agg(self, e, sep, order):
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {e} AS e))), x -> x.e), {sep})"

    def even(self, x, n=0):
        return f"bround({x}, {n})"

    def md5int(self, x):
        return f"CAST(conv(substring(md5({x}), 1, 8), 16, 10) AS BIGINT)"

    def explode(self, arr, alias, col):
        return f"LATERAL VIEW explode({arr}) {alias} AS {col}"

    def posexplode(self, arr, alias, pos, col):
        return f"LATERAL VIEW posexplode({arr}) {alias} AS {pos}, {col}"

    def seq(self, a, b):
        return f"sequence({a}, {b})"

    def words(self, c):
        return f"filter(split({c}, '(?U)\\\\s+'), x -> x <> '')"

    def extract(self, s, p, g=1):
        return f"regexp_extract({s}, '{p}', {g})"

    def json(self, c, k):
        return f"get_json_object({c}, '$.{k}')"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def collect(self, e, order):
        return f"transform(array_sort(collect_list(struct({order} AS o, {e} AS e))), x -> x.e)"

    def find(self, needle, s):
        return f"locate({needle}, {s})"

    def log2(self):
        return "ln(2e0)"


class Duck(Spark):
    nan = "'NaN'::DOUBLE"
    map_, filter_, size = "list_transform", "list_filter", "len"

    def lam(self, v, body):
        return f"lambda {v}: {body}"

    def agg(self, e, sep, order):
        return f"string_agg({e}, {sep} ORDER BY {order})"

    def even(self, x, n=0):
        return f"round_even({x}, {n})"

    def md5int(self, x):
        return f"('0x' || substring(md5({x}), 1, 8))::BIGINT"

    def explode(self, arr, alias, col):
        return f", unnest({arr}) AS {alias}({col})"

    def posexplode(self, arr, alias, pos, col):
        return f", LATERAL (SELECT unnest({arr}) AS {col}, generate_subscripts({arr}, 1) - 1 AS {pos}) AS {alias}"

    def seq(self, a, b):
        return f"range({a}, {b} + 1)"

    def words(self, c):
        return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"

    def json(self, c, k):
        return f"json_extract_string({c}, '$.{k}')"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def collect(self, e, order):
        return f"list({e} ORDER BY {order})"

    def find(self, needle, s):
        return f"strpos({s}, {needle})"


def both(text: Callable[[Spark], str]):
    """Register a query by the name of the function that writes its SQL."""

    def run(spark, d, build=text):
        sql = build(Spark())
        for name in TABLES:
            if name in sql:
                spark.read.parquet(f"{d}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(sql)

    run.__module__, run.__name__, run.__doc__ = text.__module__, text.__name__, text.__doc__
    QUERIES[text.__name__] = run
    ORACLE_SQL[text.__name__] = text(Duck())
    return run
