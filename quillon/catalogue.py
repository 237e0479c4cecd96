"""The engine's registered queries, in its own dialect, and their SQL oracles."""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expr import Context, Registry, apply, compile_text, evaluate, evaluate_as, parse
from .expr.errors import ExpressionError
from .session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FLAGSHIP = "select l_returnflag, l_linestatus, count(l_quantity), sum(l_extendedprice) from lineitem where l_quantity >= 10 group by l_returnflag, l_linestatus order by l_returnflag"


_opened: weakref.WeakKeyDictionary[SparkSession, dict[str, Session]] = weakref.WeakKeyDictionary()


def session(spark: SparkSession, sf_dir: str) -> Session:
    """One session for each folder, as a user would keep it: its tables are opened once."""
    known = _opened.setdefault(spark, {})
    if sf_dir not in known:
        s = known[sf_dir] = Session(spark)
        s.register_parquet(sf_dir, *TABLES)
        _more_tables(s)
    return known[sf_dir]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of floats are rounded: their last digits depend on the order of summation."""
    return session(spark, sf_dir).sql(FLAGSHIP).withColumn("SUM_l_extendedprice", F.round("SUM_l_extendedprice", 2))


def _more_tables(s: Session) -> None:
    """What the supplied tables lack: NULLs in predicates (f7) and in join keys (n8, r8), orders that not all customers
    have (big), a boolean column (flags)."""
    q, p = F.when(F.col("l_linenumber") != 1, F.col("l_quantity")), F.when(F.col("l_linenumber") != 2, F.col("l_partkey") % 50)
    s.register_later("f7", lambda: s.table("lineitem").df.select(F.col("l_orderkey").alias("k"), q.alias("q"), p.alias("p")))
    s.register_later("n8", lambda: s.table("nation").df.select(F.when(F.col("n_nationkey") >= 3, F.col("n_nationkey")).alias("nk"), "n_name"))
    s.register_later("r8", lambda: s.table("region").df.select(F.when(F.col("r_regionkey") >= 2, F.col("r_regionkey")).alias("rk"), "r_name"))
    s.register_later("flags", lambda: s.table("lineitem").df.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("returned")))
    s.register_later("big", lambda: s.table("orders").df.where("o_totalprice > 300000").select("o_orderkey", "o_custkey", "o_totalprice"))


_F7 = "(SELECT l_orderkey AS k, CASE WHEN l_linenumber <> 1 THEN l_quantity END AS q, CASE WHEN l_linenumber <> 2 THEN l_partkey % 50 END AS p FROM lineitem) f7"
_N8 = "(SELECT CASE WHEN n_nationkey >= 3 THEN n_nationkey END AS nk, n_name FROM nation) n8"
_R8 = "(SELECT CASE WHEN r_regionkey >= 2 THEN r_regionkey END AS rk, r_name FROM region) r8"
_BIG = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) big"
_ALL = "count(*) AS COUNT_l_quantity, min(l_quantity) AS MIN_l_quantity, max(l_quantity) AS MAX_l_quantity, sum(l_quantity) AS SUM_l_quantity, round(avg(l_quantity), 6) AS AVG_l_quantity"

#: name -> (statement of the dialect, the same for DuckDB)
SELECTS: dict[str, tuple[str, str]] = {
    "scan_project": ("select o_orderkey, o_totalprice from orders", "SELECT o_orderkey, o_totalprice FROM orders"),
    "scan_star": ("select * from nation", "SELECT * FROM nation"),
    "scan_qualified": ("select nation.n_name, n_name, region.r_name from nation join region on n_regionkey == r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "filter_conj": ('select l_orderkey, l_quantity, l_returnflag from lineitem where l_quantity >= 49 and l_returnflag != "N"', "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 49 AND l_returnflag <> 'N'"),
    "filter_or_group": ('select l_orderkey, l_quantity from lineitem where (l_quantity >= 49 or l_quantity < 2) and l_linestatus == "F"', "SELECT l_orderkey, l_quantity FROM lineitem WHERE (l_quantity >= 49 OR l_quantity < 2) AND l_linestatus = 'F'"),
    "filter_col_col": ("select l_orderkey, l_linenumber, l_quantity from lineitem where l_linenumber > l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber > l_quantity"),
    "filter_const_col": ("select l_orderkey, l_quantity from lineitem where 48 < l_quantity", "SELECT l_orderkey, l_quantity FROM lineitem WHERE 48 < l_quantity"),
    "filter_range_negative": ("select s_suppkey, s_acctbal from supplier where s_acctbal < -500 or s_acctbal >= 9000", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < -500 OR s_acctbal >= 9000"),
    "filter_point": ("select * from customer where c_custkey == 77", "SELECT * FROM customer WHERE c_custkey = 77"),
    "filter_int_on_double": ("select l_orderkey, l_quantity from lineitem where l_quantity == 5", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity = 5"),
    "filter_like_star": ('select p_partkey, p_name from part where p_name like "blue*"', "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'blue%'"),
    "filter_like_qmark": ('select o_orderkey, o_orderstatus from orders where o_orderstatus like "?" and o_orderpriority like "*-?RG*"', "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus LIKE '_' AND o_orderpriority LIKE '%-_RG%'"),
    "null_eq": ("select k, q from f7 where q == 5", f"SELECT k, q FROM {_F7} WHERE q = 5"),
    "null_lt": ("select k, q from f7 where q < 5", f"SELECT k, q FROM {_F7} WHERE q < 5 OR q IS NULL"),
    "null_le": ("select k, q from f7 where q <= 5", f"SELECT k, q FROM {_F7} WHERE q <= 5 OR q IS NULL"),
    "null_gt": ("select k, q from f7 where q > 45", f"SELECT k, q FROM {_F7} WHERE q > 45"),
    "null_ge": ("select k, q from f7 where q >= 45", f"SELECT k, q FROM {_F7} WHERE q >= 45"),
    "null_ne": ("select k, q from f7 where q != 5", f"SELECT k, q FROM {_F7} WHERE q IS DISTINCT FROM 5"),
    "null_cols_lt": ("select k, q, p from f7 where q < p", f"SELECT k, q, p FROM {_F7} WHERE q < p OR (q IS NULL AND p IS NOT NULL)"),
    "null_cols_ge": ("select k, q, p from f7 where q >= p", f"SELECT k, q, p FROM {_F7} WHERE q >= p OR p IS NULL"),
    "null_cols_eq": ("select k, q, p from f7 where q == p", f"SELECT k, q, p FROM {_F7} WHERE q IS NOT DISTINCT FROM p"),
    "filter_bool_column": ("select l_orderkey, l_linenumber from flags where returned == true and l_linenumber != 2", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 2"),
    "filter_like_literal": ('select o_orderkey from orders where o_orderpriority like "1-*" or o_orderpriority like "*_*" or o_orderpriority like "*LOW"', "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%' OR contains(o_orderpriority, '_') OR o_orderpriority LIKE '%LOW'"),
    "is_null": ("select k from f7 where q is null", f"SELECT k FROM {_F7} WHERE q IS NULL"),
    "is_not_null": ("select k, p from f7 where p is not null and q == null", f"SELECT k, p FROM {_F7} WHERE p IS NOT NULL AND q IS NULL"),
    "join_inner": ("select o_orderkey, c_name from orders join customer on o_custkey == c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_chain": ("select o_orderkey, c_name, n_name from orders join customer on o_custkey == c_custkey join nation on c_nationkey == n_nationkey where o_totalprice > 200000", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000"),
    "join_star": ('select l_orderkey, p_name, s_name from lineitem join part on p_partkey == l_partkey join supplier on lineitem.l_suppkey == supplier.s_suppkey where p_name like "blue*"', "SELECT l_orderkey, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_name LIKE 'blue%'"),
    "join_left": ("select c_custkey, o_orderkey, o_totalprice from customer left join big on c_custkey == o_custkey", f"SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN {_BIG} ON c_custkey = o_custkey"),
    "join_right": ("select c_custkey, c_name, o_orderkey from customer right join big on c_custkey == o_custkey and c_acctbal > 5000", f"SELECT c_custkey, c_name, o_orderkey FROM customer RIGHT JOIN {_BIG} ON c_custkey = o_custkey AND c_acctbal > 5000"),
    "join_full": ("select c_custkey, o_orderkey from customer full join big on o_custkey == c_custkey and c_acctbal > 5000", f"SELECT c_custkey, o_orderkey FROM customer FULL JOIN {_BIG} ON o_custkey = c_custkey AND c_acctbal > 5000"),
    "join_left_null_filter": ("select c_custkey from customer left join big on c_custkey == o_custkey where o_totalprice < 310000", f"SELECT c_custkey FROM customer LEFT JOIN {_BIG} ON c_custkey = o_custkey WHERE o_totalprice < 310000 OR o_totalprice IS NULL"),
    "join_cross": ("select r_name, n_name from region join nation", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "join_theta": ("select s_suppkey, c_custkey from supplier join customer on s_acctbal > c_acctbal and c_nationkey == s_nationkey", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_acctbal > c_acctbal AND c_nationkey = s_nationkey"),
    "join_null_safe": ("select n_name, r_name from n8 join r8 on nk == rk", f"SELECT n_name, r_name FROM {_N8} JOIN {_R8} ON nk IS NOT DISTINCT FROM rk"),
    "agg_count": ("select l_returnflag, count(l_orderkey) from lineitem group by l_returnflag", "SELECT l_returnflag, count(*) AS COUNT_l_orderkey FROM lineitem GROUP BY l_returnflag"),
    "agg_min": ("select l_returnflag, min(l_extendedprice) from lineitem group by l_returnflag", "SELECT l_returnflag, min(l_extendedprice) AS MIN_l_extendedprice FROM lineitem GROUP BY l_returnflag"),
    "agg_max": ("select l_returnflag, max(l_extendedprice) from lineitem group by l_returnflag", "SELECT l_returnflag, max(l_extendedprice) AS MAX_l_extendedprice FROM lineitem GROUP BY l_returnflag"),
    "agg_sum": ("select l_returnflag, sum(l_linenumber) from lineitem group by l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS SUM_l_linenumber FROM lineitem GROUP BY l_returnflag"),
    "agg_avg": ("select l_returnflag, avg(l_linenumber) from lineitem group by l_returnflag", "SELECT l_returnflag, round(avg(l_linenumber), 6) AS AVG_l_linenumber FROM lineitem GROUP BY l_returnflag"),
    "agg_all": ("select l_returnflag, l_linestatus, count(l_quantity), min(l_quantity), max(l_quantity), sum(l_quantity), avg(l_quantity) from lineitem group by l_returnflag, l_linestatus", f"SELECT l_returnflag, l_linestatus, {_ALL} FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_key_hidden": ("select count(o_orderkey) from orders group by o_orderstatus, o_orderpriority", "SELECT count(*) AS COUNT_o_orderkey FROM orders GROUP BY o_orderstatus, o_orderpriority"),
    "agg_key_counted": ("select o_orderstatus, count(o_orderstatus) from orders group by o_orderstatus", "SELECT o_orderstatus, count(*) AS COUNT_o_orderstatus FROM orders GROUP BY o_orderstatus"),
    "agg_null_group": ("select q, count(q), min(p), sum(p) from f7 group by q", f"SELECT q, count(*) AS COUNT_q, min(p) AS MIN_p, CAST(sum(p) AS BIGINT) AS SUM_p FROM {_F7} GROUP BY q"),
    "agg_global": ("select count(l_quantity), min(l_quantity), max(l_quantity), sum(l_quantity), avg(l_quantity) from lineitem", f"SELECT {_ALL} FROM lineitem"),
    "agg_empty": ("select count(l_quantity), max(l_quantity) from lineitem where l_quantity > 1000", "SELECT count(*) AS COUNT_l_quantity, max(l_quantity) AS MAX_l_quantity FROM lineitem WHERE l_quantity > 1000"),
    "agg_join": ("select n_name, count(c_custkey), max(c_acctbal) from customer join nation on c_nationkey == n_nationkey group by n_name", "SELECT n_name, count(*) AS COUNT_c_custkey, max(c_acctbal) AS MAX_c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "agg_outer_count": ("select c_custkey, count(o_orderkey) from customer left join big on c_custkey == o_custkey group by c_custkey", f"SELECT c_custkey, count(*) AS COUNT_o_orderkey FROM customer LEFT JOIN {_BIG} ON c_custkey = o_custkey GROUP BY c_custkey"),
    "having": ("select o_custkey, count(o_orderkey) from orders group by o_custkey having COUNT_o_orderkey > 15", "SELECT o_custkey, count(*) AS COUNT_o_orderkey FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "having_call": ('select o_orderpriority from orders group by o_orderpriority, o_orderstatus having max(o_totalprice) > 400000 and o_orderstatus != "P"', "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority, o_orderstatus HAVING max(o_totalprice) > 400000 AND o_orderstatus <> 'P'"),
    "group_no_aggregate": ("select p_brand, p_size from part group by p_brand, p_size", "SELECT p_brand, p_size FROM part GROUP BY p_brand, p_size"),
    "order_multi": ("select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderstatus desc, o_totalprice", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice"),
    "order_agg": ("select c_nationkey, max(c_acctbal) from customer group by c_nationkey order by max(c_acctbal) desc", "SELECT c_nationkey, max(c_acctbal) AS MAX_c_acctbal FROM customer GROUP BY c_nationkey ORDER BY 2 DESC"),
    "order_unselected": ("select c_name from customer order by c_acctbal desc", "SELECT c_name FROM customer ORDER BY c_acctbal DESC"),
    "order_nulls": ("select k, q from f7 order by q desc, k", f"SELECT k, q FROM {_F7} ORDER BY q DESC NULLS FIRST, k"),
    "distinct": ("select distinct p_brand, p_type from part", "SELECT DISTINCT p_brand, p_type FROM part"),
    "distinct_nulls": ("select distinct q, p from f7", f"SELECT DISTINCT q, p FROM {_F7}"),
    "distinct_order": ("select distinct l_returnflag, l_linestatus from lineitem order by l_linestatus desc, l_returnflag", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY l_linestatus DESC, l_returnflag"),
}

#: Floats whose last digits depend on the order of summation are rounded on both sides.
ROUNDED = {"agg_avg": {"AVG_l_linenumber": 6}, "agg_all": {"AVG_l_quantity": 6}, "agg_global": {"AVG_l_quantity": 6}}

#: name -> (table, key columns, column -> expression, the same columns for DuckDB)
EXPRESSIONS: dict[str, tuple[str, tuple[str, ...], dict[str, str], str]] = {
    "expr_arith": (
        "lineitem",
        ("l_orderkey", "l_linenumber"),
        {"a": "l_orderkey * 3 - l_linenumber + 7", "b": "l_partkey / 7", "c": "l_partkey % 7", "d": "l_extendedprice * (1 - l_discount)", "e": "-l_quantity / 3", "f": "l_linenumber ^ 2", "g": "-l_linenumber ^ 2", "h": "1.0 / (l_quantity - 5)"},
        "l_orderkey * 3 - l_linenumber + 7 AS a, l_partkey // 7 AS b, l_partkey % 7 AS c, l_extendedprice * (1 - l_discount) AS d, -l_quantity / 3 AS e, pow(l_linenumber, 2) AS f, -pow(l_linenumber, 2) AS g, CASE WHEN l_quantity = 5 THEN CAST('inf' AS DOUBLE) ELSE 1.0::DOUBLE / (l_quantity - 5) END AS h",
    ),
    "expr_bool": (
        "lineitem",
        ("l_orderkey", "l_linenumber"),
        {"a": 'l_quantity > 25 && l_returnflag == "R" || l_discount >= 0.08', "b": '!(l_tax < 0.05)', "c": 'l_returnflag LIKE "?" && l_linestatus != "O"', "d": "(l_linenumber, 1) == (1, l_linenumber)"},
        "l_quantity > 25 AND l_returnflag = 'R' OR l_discount >= 0.08 AS a, NOT (l_tax < 0.05) AS b, l_returnflag LIKE '_' AND l_linestatus <> 'O' AS c, l_linenumber = 1 AS d",
    ),
    "expr_math_log": (
        "part",
        ("p_partkey",),
        {"a": "round(math::ln(p_size) * 1000000)", "b": "round(math::log(p_retailprice, 10) * 1000000)", "c": "round(math::log2(p_size) * 1000000)", "d": "round(math::log10(p_retailprice) * 1000000)", "e": "round(math::exp(p_size / 10.0) * 1000)", "f": "math::exp2(p_size % 8)", "g": "math::pow(p_size, 2)"},
        "round(ln(p_size) * 1000000) AS a, round(ln(p_retailprice) / ln(10) * 1000000) AS b, round(log2(p_size) * 1000000) AS c, round(log10(p_retailprice) * 1000000) AS d, round(exp(p_size / 10.0::DOUBLE) * 1000) AS e, pow(2.0::DOUBLE, p_size % 8) AS f, pow(p_size::DOUBLE, 2) AS g",
    ),
    "expr_math_trig": (
        "part",
        ("p_partkey",),
        {f: f"round(math::{f}(p_size / 51.0) * 1000000)" for f in ("cos", "acos", "sin", "asin", "tan", "atan")} | {"atan2": "round(math::atan2(p_size, -3) * 1000000)", "hypot": "round(math::hypot(p_size, 4) * 1000000)", "sqrt": "round(math::sqrt(p_size) * 1000000)", "cbrt": "round(math::cbrt(p_size) * 1000000)"},
        ", ".join(f"round({f}(p_size / 51.0::DOUBLE) * 1000000) AS {f}" for f in ("cos", "acos", "sin", "asin", "tan", "atan")) + ", round(atan2(p_size, -3) * 1000000) AS atan2, round(sqrt(p_size * p_size + 16) * 1000000) AS hypot, round(sqrt(p_size) * 1000000) AS sqrt, round(cbrt(p_size) * 1000000) AS cbrt",
    ),
    "expr_math_hyper": (
        "part",
        ("p_partkey",),
        {f: f"round(math::{f}({'1 + ' if f == 'acosh' else ''}p_size / 51.0) * 1000000)" for f in ("cosh", "acosh", "sinh", "asinh", "tanh", "atanh")},
        ", ".join(f"round({f}({'1 + ' if f == 'acosh' else ''}p_size / 51.0::DOUBLE) * 1000000) AS {f}" for f in ("cosh", "acosh", "sinh", "asinh", "tanh", "atanh")),
    ),
    "expr_round": ("customer", ("c_custkey",), {"a": "floor(c_acctbal)", "b": "ceil(c_acctbal)", "c": "round(c_acctbal / 2)"}, "floor(c_acctbal) AS a, ceil(c_acctbal) AS b, round(c_acctbal / 2) AS c"),
    "expr_float_class": (
        "part",
        ("p_partkey",),
        {"a": "math::is_nan((p_size - 5) * 1.0 / (p_size - 5))", "b": "math::is_finite(1.0 / (p_size - 5))", "c": "math::is_infinite(1.0 / (p_size - 5))", "d": "math::is_normal(p_size - 5)"},
        "p_size = 5 AS a, p_size <> 5 AS b, p_size = 5 AS c, p_size <> 5 AS d",
    ),
    "expr_minmax": ("part", ("p_partkey",), {"a": "min(p_size, 25, 30)", "b": "max(p_size, 25)", "c": "min(p_size, p_retailprice)", "d": "max(p_size, 25.5)"}, "least(p_size::BIGINT, 25, 30) AS a, greatest(p_size::BIGINT, 25) AS b, least(p_size::DOUBLE, p_retailprice) AS c, greatest(p_size::DOUBLE, 25.5::DOUBLE) AS d"),
    "expr_minmax_nan": (
        "part",
        ("p_partkey",),
        {"a": "max(p_retailprice, (p_size - 5) * 1.0 / (p_size - 5))", "b": "min((p_size - 5) * 1.0 / (p_size - 5), p_size)", "c": "max(0.0 / 0.0, 1.0, p_size % 2)"},
        "CASE WHEN p_size = 5 THEN p_retailprice ELSE greatest(p_retailprice, 1.0::DOUBLE) END AS a, CASE WHEN p_size = 5 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS b, 1.0::DOUBLE AS c",
    ),
    "expr_if": ("part", ("p_partkey",), {"a": 'if(p_size > 25, "large", "small")', "b": "if(p_size > 25, p_size, 0.5)"}, "CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS a, CASE WHEN p_size > 25 THEN p_size::DOUBLE ELSE 0.5::DOUBLE END AS b"),
    "expr_string": (
        "part",
        ("p_partkey",),
        {"a": "str::to_uppercase(p_name)", "b": "str::to_lowercase(p_brand)", "c": 'str::trim("  " + p_name + " ")', "d": "len(p_name)", "e": "str::from(p_name)", "f": "str::from(p_size)", "g": 'p_name + "-" + p_type', "h": "str::from(p_size, true, p_brand)"},
        "upper(p_name) AS a, lower(p_brand) AS b, p_name AS c, CAST(strlen(p_name) AS BIGINT) AS d, '\"' || p_name || '\"' AS e, p_size::VARCHAR AS f, p_name || '-' || p_type AS g, '(' || p_size || ', true, \"' || p_brand || '\")' AS h",
    ),
    "expr_regex": ("part", ("p_partkey",), {"a": 'str::regex_matches(p_name, "^b[a-z]+e ")', "b": 'str::regex_replace(p_name, "([aeiou])", "<$1>")'}, "regexp_matches(p_name, '^b[a-z]+e ') AS a, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS b"),
    "expr_regex_unicode": ("part", ("p_partkey",), {"a": r'str::regex_matches(p_name, "^\\p{L}+ \\p{Ll}+$")', "b": r'str::regex_replace(p_name, "(?<first>\\p{L})\\p{L}*", "${first}")'}, r"regexp_matches(p_name, '^\p{L}+ \p{Ll}+$') AS a, regexp_replace(p_name, '(\p{L})\p{L}*', '\1', 'g') AS b"),
    "expr_bits": (
        "part",
        ("p_partkey",),
        {"a": "bitand(p_partkey, 12)", "b": "bitor(p_partkey, 12)", "c": "bitxor(p_partkey, 12)", "d": "bitnot(p_partkey)", "e": "shl(p_partkey, 3)", "f": "shr(-p_partkey, 2)"},
        "p_partkey & 12 AS a, p_partkey | 12 AS b, xor(p_partkey, 12) AS c, ~p_partkey AS d, p_partkey * 8 AS e, CAST(floor(-p_partkey / 4.0::DOUBLE) AS BIGINT) AS f",
    ),
    "expr_typeof": ("part", ("p_partkey",), {"a": "typeof(p_name)", "b": "typeof(p_size)", "c": "typeof(p_retailprice)", "d": "typeof(p_size > 1)", "e": "typeof(p_size, 1)", "f": "typeof()"}, "'string' AS a, 'int' AS b, 'float' AS c, 'boolean' AS d, 'tuple' AS e, 'empty' AS f"),
    "expr_tuple_len": ("part", ("p_partkey",), {"a": "len(p_size, 1, (2, 3))", "b": "len((p_name, p_brand))"}, "CAST(3 AS BIGINT) AS a, CAST(2 AS BIGINT) AS b"),
    "expr_constants": ("region", ("r_regionkey",), {"a": "round(PI * 1000000)", "b": "round(E * SQRT_2 * 1000000)", "c": "round(LN_10 * 1000000)"}, "round(pi() * 1000000) AS a, round(exp(1) * sqrt(2) * 1000000) AS b, round(ln(10) * 1000000) AS c"),
}


def _select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = session(spark, sf_dir).sql(SELECTS[name][0])
        return df.withColumns({c: F.round(c, n) for c, n in ROUNDED.get(name, {}).items()})

    return run


def _expression(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, keys, columns, _ = EXPRESSIONS[name]
        df = session(spark, sf_dir).table(table).df
        context = Context.of(df)
        context.variables = Context.with_constants().variables | context.variables
        return df.select(*keys, *(compile_text(text, context).column.alias(label) for label, text in columns.items()))

    return run


def join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join_inner by a sort-merge join; the hint goes with the registered frame."""
    s, opened = Session(spark), session(spark, sf_dir)
    s.register("orders", opened.table("orders").df)
    s.register("customer", opened.table("customer").df.hint("merge"))
    return s.sql(SELECTS["join_inner"][0])


def expr_assign_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = session(spark, sf_dir).table("part").df
    return apply(df, "a = p_size * 2; b = a + 1; a += 10; c = a > b").select("p_partkey", "a", "b", "c")


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user function that Spark's own expressions can state, and one that needs Python: Arrow batches, no rows."""
    registry = Registry()
    registry.register_column("muladd", lambda a, b, c: a * b + c, "bigint")
    registry.register("squares", lambda s: (s * s).astype("int64"), "bigint")
    df = session(spark, sf_dir).table("part").df
    return apply(df, "a = muladd(p_size, 3, 1); b = squares(p_size)", registry).select("p_partkey", "a", "b")


def _loaded(spark: SparkSession, sf_dir: str) -> Session:
    """A database with a copy of nation, as the DML queries change it."""
    s, opened = Session(spark), session(spark, sf_dir)
    s.sql("create db work")
    s.sql("connect db work")
    s.sql("create table region2 (rk int primary key, rname varchar not null)")
    s.sql("create table nation2 (nk int unique, nname varchar, rk int references region2(rk), create index btree nk_index on (nk))")
    s.catalog.append("work", "region2", opened.table("region").df.selectExpr("r_regionkey AS rk", "r_name AS rname"))
    s.catalog.append("work", "nation2", opened.table("nation").df.selectExpr("n_nationkey AS nk", "n_name AS nname", "n_regionkey AS rk"))
    return s


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _loaded(spark, sf_dir)
    s.sql('insert into nation2 (nk, nname, rk) values (100, "ATLANTIS", 1)')
    s.sql("insert into nation2 (nk) values (101)")
    return s.sql("select * from nation2")


def dml_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines, of which one has a known key and one an unknown region."""
    s = _loaded(spark, sf_dir)
    s.batch('insert into nation2 (nk, rk) values (100, 1)\ninsert into nation2 (nk, rk) values (3, 1)\n\ninsert into nation2 (nk, rk) values (102, 77)\ninsert into nation2 (nk nname) values (103 "X")')
    return s.sql("select * from nation2")


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _loaded(spark, sf_dir)
    s.sql('update nation2 set nname = "changed", rk = 2 where nk < 5 or nname like "*A"')
    return s.sql("select * from nation2")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _loaded(spark, sf_dir)
    s.sql("delete from nation2 where rk == 1 and nk >= 3")
    return s.sql("select * from nation2")


def ddl_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).sql("select * from schemas")


def ddl_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).sql("select tablename, index_name, fieldname, index_type from indexes")


def dml_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After single INSERTs, an UPDATE and a DELETE, one folder is left, and the rows are the same."""
    s = _loaded(spark, sf_dir)
    for i in range(100, 103):
        s.sql(f"insert into nation2 (nk, rk) values ({i}, 1)")
    s.sql("update nation2 set rk = 2 where nk == 101")
    s.sql("insert into nation2 (nk) values (104)")
    s.sql("delete from nation2 where nk < 5")
    s.vacuum("nation2")
    return s.sql("select * from nation2")


def _rows(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> list[tuple]:
    """A small table's rows in order, on the driver."""
    return [tuple(r) for r in session(spark, sf_dir).table(table).df.select(*columns).orderBy(*columns).collect()]


def dump_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump file with a further row for each region, and one that breaks a constraint."""
    s = _loaded(spark, sf_dir)
    lines = [f'insert into region2 (rk, rname) values ({k + 10}, "{n.lower()}")' for k, n in _rows(spark, sf_dir, "region", "r_regionkey", "r_name")]
    s.catalog.store.create("dump.sql", "\n".join([*lines, "", 'insert into region2 (rk, rname) values (12, "again")']))
    s.load_dump(f"{s.catalog.store.root}/dump.sql")
    return s.sql("select * from region2")


def eval_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation by kind, of parsed trees over variables from a row of region; a wrong kind gives its error's name."""
    key, name = _rows(spark, sf_dir, "region", "r_regionkey", "r_name")[2]
    context = Context.with_values({"k": key, "n": name})
    cases = [("string", "str::to_lowercase(n) + str::from(k)"), ("int", "k * 21"), ("float", "k / 4.0"), ("number", "k + 1"), ("boolean", "k >= 2 && len(n) == 4"), ("tuple", "k, k + 1"), ("empty", "()"), ("int", "k / 4.0"), ("string", "k"), ("tuple", "n")]
    out = []
    for kind, text in cases:
        try:
            value = str(evaluate_as(spark, kind, parse(text), context))
        except ExpressionError as e:
            value = type(e).__name__
        out.append((kind, text, value))
    evaluate(spark, "m = k; m += 40", context)
    out.append(("int", "m", str(evaluate_as(spark, "int", "m", context))))
    return spark.createDataFrame(out, "kind string, expression string, result string")


def constraint_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each statement is refused with, or ok."""
    s = _loaded(spark, sf_dir)
    statements = {
        "primary_key_null": 'insert into region2 (rname) values ("X")',
        "primary_key_again": 'insert into region2 (rk, rname) values (1, "X")',
        "not_null": "insert into region2 (rk) values (50)",
        "unique": "insert into nation2 (nk) values (3)",
        "reference": "insert into nation2 (nk, rk) values (200, 50)",
        "type": 'insert into nation2 (nk) values ("three")',
        "range": "insert into nation2 (nk) values (3000000000)",
        "column": "insert into nation2 (nkey) values (3)",
        "update_unique": "update nation2 set nk = 5 where nk == 6",
        "fine": "insert into nation2 (nk, rk) values (201, 4)",
    }
    out = []
    for name, text in statements.items():
        try:
            s.sql(text)
            out.append((name, "ok"))
        except ValueError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "name string, verdict string")


_VERDICTS = {
    "primary_key_null": "rk is NULL but NOT NULL Constraint",
    "primary_key_again": "Duplicate Value : rk",
    "not_null": "rname is NULL but NOT NULL Constraint",
    "unique": "Duplicate Value : nk",
    "reference": "Foreign Reference Not Found : (region2.rk)",
    "type": "Wrong data type:nk",
    "range": "Wrong data type:nk",
    "column": "nkey does not exist",
    "update_unique": "Duplicate Value : nk",
    "fine": "ok",
}
_NATION2 = "SELECT n_nationkey AS nk, n_name AS nname, n_regionkey AS rk FROM nation"

OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "flagship": (flagship, "SELECT l_returnflag, l_linestatus, count(*) AS COUNT_l_quantity, round(sum(l_extendedprice), 2) AS SUM_l_extendedprice FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag, l_linestatus"),
    "join_merge": (join_merge, SELECTS["join_inner"][1]),
    "expr_assign_chain": (expr_assign_chain, "SELECT p_partkey, p_size::BIGINT * 2 + 10 AS a, p_size::BIGINT * 2 + 1 AS b, true AS c FROM part"),
    "udf_scalar": (udf_scalar, "SELECT p_partkey, p_size::BIGINT * 3 + 1 AS a, p_size::BIGINT * p_size AS b FROM part"),
    "dml_insert": (dml_insert, f"{_NATION2} UNION ALL SELECT 100, 'ATLANTIS', 1 UNION ALL SELECT 101, NULL, NULL"),
    "dml_batch": (dml_batch, f"{_NATION2} UNION ALL SELECT 100, NULL, 1 UNION ALL SELECT 103, 'X', NULL"),
    "dml_update": (dml_update, "SELECT n_nationkey AS nk, CASE WHEN n_nationkey < 5 OR n_name LIKE '%A' THEN 'changed' ELSE n_name END AS nname, CASE WHEN n_nationkey < 5 OR n_name LIKE '%A' THEN 2 ELSE n_regionkey END AS rk FROM nation"),
    "dml_delete": (dml_delete, f"{_NATION2} WHERE NOT (n_regionkey = 1 AND n_nationkey >= 3)"),
    "dml_vacuum": (dml_vacuum, f"{_NATION2} WHERE n_nationkey >= 5 UNION ALL SELECT 100, NULL, 1 UNION ALL SELECT 101, NULL, 2 UNION ALL SELECT 102, NULL, 1 UNION ALL SELECT 104, NULL, NULL"),
    "dump_load": (dump_load, "SELECT r_regionkey AS rk, r_name AS rname FROM region UNION ALL SELECT r_regionkey + 10, lower(r_name) FROM region"),
    "eval_typed": (
        eval_typed,
        "WITH r AS (SELECT r_regionkey AS k, r_name AS n FROM region ORDER BY 1, 2 LIMIT 1 OFFSET 2) SELECT kind, expression, result FROM r, LATERAL (VALUES "
        "('string', 'str::to_lowercase(n) + str::from(k)', lower(n) || k), ('int', 'k * 21', (k * 21)::VARCHAR), ('float', 'k / 4.0', (k / 4.0::DOUBLE)::VARCHAR), ('number', 'k + 1', (k + 1)::DOUBLE::VARCHAR), "
        "('boolean', 'k >= 2 && len(n) == 4', CASE WHEN k >= 2 AND strlen(n) = 4 THEN 'True' ELSE 'False' END), ('tuple', 'k, k + 1', '(' || k || ', ' || (k + 1) || ')'), ('empty', '()', 'None'), "
        "('int', 'k / 4.0', 'ExpectedInt'), ('string', 'k', 'ExpectedString'), ('tuple', 'n', 'ExpectedTuple'), ('int', 'm', (k + 40)::VARCHAR)) t(kind, expression, result)",
    ),
    "ddl_catalog": (
        ddl_catalog,
        "SELECT * FROM (VALUES ('region2', 'rk', 'int', true, false, true, NULL, NULL), ('region2', 'rname', 'varchar', false, false, false, NULL, NULL), ('nation2', 'nk', 'int', false, true, true, NULL, NULL), ('nation2', 'nname', 'varchar', false, true, false, NULL, NULL), ('nation2', 'rk', 'int', false, true, false, 'region2', 'rk')) t(tablename, fieldname, fieldtype, pkey_piece, nullable, \"unique\", foreign_table, foreign_field)",
    ),
    "ddl_indexes": (ddl_indexes, "SELECT 'nation2' AS tablename, 'nk_index' AS index_name, 'nk' AS fieldname, 'btree' AS index_type"),
    "constraint_verdicts": (constraint_verdicts, "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _VERDICTS.items()) + ") t(name, verdict)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in OTHERS.items()} | {n: _select(n) for n in SELECTS} | {n: _expression(n) for n in EXPRESSIONS}


def oracle_sql() -> dict[str, str]:
    expressions = {n: f"SELECT {', '.join(keys)}, {columns} FROM {table}" for n, (table, keys, _, columns) in EXPRESSIONS.items()}
    return {n: q for n, (_, q) in OTHERS.items()} | {n: q for n, (_, q) in SELECTS.items()} | expressions
