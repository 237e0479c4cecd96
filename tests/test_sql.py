"""The dialect: parsing, NULL rules, joins, groups, order, DML and constraints, on small fixtures and against DuckDB."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from quillon import catalogue
from quillon.dml import ConstraintError
from quillon.session import Session
from quillon.sql import ast
from quillon.sql.parser import SqlError, parse

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def s(spark):
    return Session(spark)


@pytest.fixture
def db(s):
    s.sql("create db d")
    s.sql("connect db d")
    return s


def rows(df):
    return [tuple(r) for r in df.collect()]


# parsing


def test_parse_spacing_case_and_strings():
    stmt = parse('SELECT  DISTINCT a , t.b, Max( c )\nFROM t LEFT JOIN u ON t.a == u.a WHERE x LIKE "A and B*" AND (y IS  NOT null OR z >= -1.5)\nGROUP   BY a,b HAVING MAX_c > 3 ORDER  BY a DESC, b asc;')
    assert stmt.distinct and stmt.items == [ast.Name("a"), ast.Name("b", "t"), ast.Aggregate("MAX", ast.Name("c"))]
    assert stmt.joins[0].how == "left" and stmt.where.left.right == ast.Literal("A and B*")
    assert stmt.where.right.right == ast.Condition(">=", ast.Name("z"), ast.Literal(-1.5))
    assert [d for _, d in stmt.order_by] == [True, False] and stmt.having.op == ">"
    # AND binds tighter than OR
    assert parse("select a from t where a == 1 or b == 2 and c == 3").where.op == "or"
    created = parse("create table student (id int primary key, firstname varchar not null, lastname varchar , create index btree s_id on (id))")
    assert [c.name for c in created.columns] == ["id", "firstname", "lastname"] and created.indexes == [ast.IndexDef("s_id", "btree", ["id"])]
    assert parse("insert into t (a b) values (1 null)").values == [1, None]
    assert parse("update t set a = 1, b = .5 where c != true").values == {"a": 1, "b": 0.5}


@pytest.mark.parametrize(
    "text",
    ["", "select", "select a", "select a from", "select a from t where", "select a from t where a ==", "select a from t where a + 1 == 2", "select a from t group a", "select a from t limit 3", "insert into t (a, b) values (1)", "create table t (a decimal)", "create table t ()", "select a from t extra", 'select a from t where a == ""'],
)
def test_parse_errors(text):
    with pytest.raises(SqlError):
        parse(text)


def test_boolean_trees(spark):
    from quillon.plans.boolean import clauses, qualified, simplified
    from quillon.plans.select import Scope, Table

    node = parse("select a from t where a == 1 and (b < 2 or a == 3) or b is null").where
    leaves = clauses(node)
    assert [c.op for c in leaves] == ["==", "<", "==", "IS"]
    assert simplified(node, {}) == node
    assert simplified(node, {leaves[0]: False}) == leaves[3] and simplified(node, {leaves[3]: True}) is True
    assert simplified(node, {leaves[3]: False, leaves[0]: True, leaves[1]: False}) == leaves[2]
    assert simplified(node, dict.fromkeys(leaves, False)) is False
    scope, df = Scope(), spark.createDataFrame([(1, 2)], "a int, b int")
    scope.add(Table("t", df, df.schema))
    assert str(clauses(qualified(node, scope))[1].left) == "t.b"
    with pytest.raises(SqlError):
        qualified(parse("select a from t where c == 1").where, scope)


# NULL rules


def test_null_truth_tables(spark, s):
    df = spark.createDataFrame([(None,), (4,), (5,), (6,)], "q int")
    s.register("f7", df)
    expected = {"==": [5], "!=": [None, 4, 6], "<": [None, 4], "<=": [None, 4, 5], ">": [6], ">=": [5, 6]}
    mirror = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
    for op, want in expected.items():
        assert [r[0] for r in rows(s.sql(f"select q from f7 where q {op} 5"))] == want
        assert [r[0] for r in rows(s.sql(f"select q from f7 where 5 {mirror[op]} q"))] == want
    pairs = spark.createDataFrame([(None, None), (1, None), (None, 1), (1, 2), (2, 1), (1, 1)], "a int, b int")
    s.register("p", pairs)
    truth = {"==": "TFFFFT", "!=": "FTTTTF", "<": "FFTTFF", "<=": "TFTTFT", ">": "FTFFTF", ">=": "TTFFTT"}
    for op, want in truth.items():
        got = rows(s.sql(f"select a, b from p where a {op} b"))
        assert got == [r for r, t in zip([(None, None), (1, None), (None, 1), (1, 2), (2, 1), (1, 1)], want, strict=True) if t == "T"], op
    assert [r[0] for r in rows(s.sql("select q from f7 order by q"))] == [4, 5, 6, None]
    assert [r[0] for r in rows(s.sql("select q from f7 order by q desc"))] == [None, 6, 5, 4]
    assert rows(s.sql("select count(q), min(q), max(q), sum(q), avg(q) from f7")) == [(4, 4, 6, 15, 5.0)]
    assert rows(s.sql("select q from f7 where q is null")) == [(None,)]
    assert len(rows(s.sql("select q from f7 where q == null"))) == 1
    assert len(rows(s.sql("select q from f7 where q is not 5"))) == 3


def test_null_like_is_no_match(spark, s):
    s.register("t", spark.createDataFrame([(None,), ("a%b",), ("axb",), ("A.B",), ("a\nb",)], "x string"))
    assert rows(s.sql('select x from t where x like "a?b"')) == [("a%b",), ("axb",), ("a\nb",)]
    assert rows(s.sql('select x from t where x like "a%*"')) == [("a%b",)]
    assert rows(s.sql('select x from t where x like "*.?"')) == [("A.B",)]
    assert len(rows(s.sql("select x from t where x like x"))) == 4


def test_pushdown_and_plain_comparisons(spark, s):
    s.register_parquet(DATA, "lineitem")
    plan = s.sql("select l_orderkey from lineitem where l_linenumber >= 3 and l_returnflag == \"R\"")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_linenumber,3)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in plan
    plan = s.sql("select l_orderkey from lineitem where l_linenumber < 3")._jdf.queryExecution().toString()
    assert "Or(LessThan(l_linenumber,3),IsNull(l_linenumber))" in plan


def test_like_is_pushed_down(spark, s):
    s.register("t", spark.createDataFrame([("user_1",), ("userx1",), ("a_user_",), ("50%",), ("x50%y",), (None,), ("a\\b",), ("",)], "x string"))
    cases = {"user_*": ["user_1"], "*user_": ["a_user_"], "*50%*": ["50%", "x50%y"], "user_1": ["user_1"], "*": ["user_1", "userx1", "a_user_", "50%", "x50%y", "a\\b", ""], "?_us*_": ["a_user_"], "a\\*": ["a\\b"], "?\\?": ["a\\b"], "": []}
    for pattern, want in cases.items():
        if pattern:
            assert [r[0] for r in rows(s.sql(f'select x from t where x like "{pattern}"'))] == want, pattern
    s.register_parquet(DATA, "part")
    for pattern, filter_ in (("blue_*", "StringStartsWith(p_name,blue_)"), ("*_steel", "StringEndsWith(p_name,_steel)"), ("*e%s*", "StringContains(p_name,e%s)"), ("x_y", "EqualTo(p_name,x_y)")):
        assert filter_ in s.sql(f'select p_partkey from part where p_name like "{pattern}"')._jdf.queryExecution().toString()


# joins, groups


def test_joins_null_keys_many_to_many_and_outer(spark, s):
    s.register("a", spark.createDataFrame([(None, "n1"), (None, "n2"), (1, "x"), (1, "y"), (1, "z"), (2, "w")], "k int, v string"))
    s.register("b", spark.createDataFrame([(None, 0), (1, 1), (1, 2), (1, 3), (1, 4), (3, 5)], "bk int, w int"))
    assert s.sql("select v, w from a join b on k == bk").count() == 2 + 3 * 4
    assert s.sql("select v, w from a join b on bk == k").count() == 14
    left = rows(s.sql("select v, w from a left join b on k == bk"))
    assert len(left) == 15 and ("w", None) in left
    right = rows(s.sql("select v, w from a right join b on k == bk"))
    assert len(right) == 15 and (None, 5) in right
    assert s.sql("select v, w from a full join b on k == bk").count() == 16
    assert s.sql("select v, w from a join b").count() == 36
    assert s.sql("select v, w from a join b on k < bk and w > 0").count() == sum((a is None and b is not None) or (a is not None and b is not None and a < b) for a in (None, None, 1, 1, 1, 2) for b in (1, 1, 1, 1, 3))
    # after an outer join the other side's columns may be NULL, and NULL is smallest
    assert ("w",) in rows(s.sql("select v from a left join b on k == bk where w < 1"))
    s.register("c", spark.createDataFrame([(1, "q")], "k int, u string"))
    assert s.sql("select * from a join c on a.k == c.k").columns == ["a_k", "v", "c_k", "u"]
    with pytest.raises(SqlError, match="ambiguous"):
        s.sql("select v from a join c on k == u")
    with pytest.raises(SqlError, match="twice"):
        s.sql("select v from a join a on k == k")


def test_groups(spark, s):
    s.register("t", spark.createDataFrame([("a", 1, 2.5), ("a", 1, 3.5), (None, 7, None), (None, None, 1.0), ("b", 4, 0.5)], "g string, i int, d double"))
    got = sorted(rows(s.sql("select g, count(i), min(i), max(i), sum(i), avg(i), min(d), sum(d) from t group by g")), key=repr)
    assert got == sorted([("a", 2, 1, 1, 2, 1.0, 2.5, 6.0), (None, 2, 7, 7, 7, 7.0, 1.0, 1.0), ("b", 1, 4, 4, 4, 4.0, 0.5, 0.5)], key=repr)
    assert s.sql("select g, min(i), sum(i) from t group by g").schema == T.StructType([T.StructField("g", T.StringType()), T.StructField("MIN_i", T.IntegerType()), T.StructField("SUM_i", T.LongType())])
    assert rows(s.sql("select g from t group by g having SUM_i >= 4 order by g")) == [("b",), (None,)]
    assert rows(s.sql("select g from t group by g having count(i) > 1 order by sum(d) desc")) == [("a",), (None,)]
    assert rows(s.sql("select count(g) from t group by i order by count(g) desc, i")) == [(2,), (1,), (1,), (1,)]
    assert rows(s.sql("select count(i) from t where i > 100")) == [(0,)]
    assert rows(s.sql("select i, count(i) from t where i > 100 group by i")) == []
    assert rows(s.sql("select g, g from t group by g order by g")) == [("a",), ("b",), (None,)]
    for text in ("select g, count(i) from t", "select i from t group by g", "select sum(g) from t", "select g from t where count(i) > 1", "select nope from t", "select g from nope", "select distinct g from t order by i", "select g from t where g > 1"):
        with pytest.raises(SqlError):
            s.sql(text)


def test_distinct_and_order(spark, s):
    s.register("t", spark.createDataFrame([(1, "b"), (2, "a"), (1, "b"), (None, "a"), (None, "a")], "i int, v string"))
    assert sorted(rows(s.sql("select distinct i, v from t")), key=repr) == [(1, "b"), (2, "a"), (None, "a")]
    assert rows(s.sql("select distinct v from t order by v desc")) == [("b",), ("a",)]
    assert rows(s.sql("select v from t order by i desc, v")) == [("a",), ("a",), ("a",), ("b",), ("b",)]
    assert [len(b) for b in s.results(spark.range(120).toDF("x"))] == [50, 50, 20]


# DDL and DML


def test_tables_rows_and_constraints(db):
    db.sql("create table parent (id int primary key, name varchar not null)")
    db.sql("create table child (id int unique, pid int references parent(id), note varchar, ok bool, big bigint, small smallint, f single, x double, n serial)")
    with pytest.raises(SqlError, match="already exists"):
        db.sql("create table parent (id int)")
    db.sql('insert into parent (id, name) values (1, "one")')
    refused = {
        'insert into parent (id, name) values (1, "again")': "Duplicate Value : id",
        "insert into parent (id) values (2)": "name is NULL but NOT NULL Constraint",
        'insert into parent (name) values ("x")': "id is NULL but NOT NULL Constraint",
        "insert into child (id, pid) values (1, 9)": "Foreign Reference Not Found",
        'insert into child (id) values ("one")': "Wrong data type:id",
        "insert into child (id, small) values (1, 40000)": "Wrong data type:small",
        "insert into child (id, f) values (1, 1.0) ; ": None,
        "insert into child (nope) values (1)": "nope does not exist",
    }
    for text, message in refused.items():
        if message is None:
            db.sql(text)
        else:
            with pytest.raises(ConstraintError, match=message):
                db.sql(text)
    db.sql("insert into child (pid) values (1)")
    with pytest.raises(ConstraintError, match="Duplicate Value : id"):
        db.sql("insert into child (pid) values (null)")  # NULL equals NULL
    db.sql('insert into child (id, pid, note, ok, big, small, f, x, n) values (2, null, "n", true, 5000000000, -3, .5, 2, 7)')
    assert rows(db.sql("select * from child where id == 2")) == [(2, None, "n", True, 5000000000, -3, 0.5, 2.0, 7)]
    assert rows(db.sql("select id from child where ok == true")) == [(2,)]
    assert db.sql("update child set note = \"u\", x = null where id >= 1").rows == 2
    assert sorted(rows(db.sql("select id, note, x from child")), key=repr) == sorted([(1, "u", None), (2, "u", None), (None, None, None)], key=repr)
    with pytest.raises(ConstraintError):
        db.sql("update child set id = 9")
    with pytest.raises(ConstraintError):
        db.sql("update child set pid = 77 where id == 1")
    with pytest.raises(ConstraintError):
        db.sql("update parent set name = null")
    assert db.sql("delete from child where id < 2").rows == 2  # NULL is smaller
    assert db.sql("select * from child").count() == 1
    assert db.sql("delete from child").rows == 1 and db.sql("select count(id) from child").first()[0] == 0


def test_batch_planning_and_rows(db, tmp_path):
    db.sql("create table t (id smallint unique, name varchar)")
    with pytest.raises(SqlError, match="Batch Planning Failed"):
        db.batch('insert into t (id) values (1)\nselect id from t')
    with pytest.raises(SqlError, match="Batch Planning Failed"):
        db.batch('insert into t (id) values (1)\ninsert into t (id) values ("x")')
    assert db.sql("select * from t").count() == 0
    status = db.batch("\n".join(f'insert into t (id, name) values ({i % 90}, "v{i}")' for i in range(100)))
    assert status.rows == 90 and status.failures == ("Duplicate Value : id",) * 10 and status.message == "Batch Success, Inserted: 90"
    (tmp_path / "more.sql").write_text("insert into t (id) values (200)\n\ninsert into t (id) values (201)\n")
    assert db.load_dump(str(tmp_path / "more.sql")).rows == 2
    assert db.sql("select * from t").count() == 92


def test_catalogue_survives_and_commands(spark, tmp_path):
    a = Session(spark, f"file://{tmp_path}")
    a.sql("CREATE DB one")
    with pytest.raises(SqlError):
        a.sql("create db one")
    with pytest.raises(SqlError, match="no database"):
        a.sql("create table t (a int)")
    a.sql("connect db one")
    a.sql("create table employee (id smallint, name varchar, salary int, job varchar, create index hash e_id on (id), create index btree e_sal on (salary, job))")
    rng = random.Random(5)
    people = [(rng.randint(-32768, 32766), f"n{i}", rng.randint(-(2**31), 2**31 - 2), None if i % 7 == 0 else "Engineer") for i in range(100)]
    a.batch("\n".join(f"insert into employee (id, name, salary, job) values ({i}, \"{n}\", {sal}, {'null' if j is None else f'{chr(34)}{j}{chr(34)}'})" for i, n, sal, j in people))
    b = Session(spark, f"file://{tmp_path}")
    b.sql("connect db one")
    assert Counter(rows(b.sql("select * from employee"))) == Counter(people)
    assert sorted(rows(b.sql("select index_name, fieldname, index_type from indexes"))) == [("e_id", "id", "hash"), ("e_sal", "job", "btree"), ("e_sal", "salary", "btree")]
    assert rows(b.sql("select database_name from databases")) == [("one",)]
    assert b.sql("select * from tables_files").count() == 1
    assert rows(b.sql("select fieldname from schemas where fieldtype == \"varchar\" order by fieldname")) == [("job",), ("name",)]
    assert b.sql("sync").message and b.sql("exit db").message
    with pytest.raises(SqlError):
        b.sql("select * from employee")
    with pytest.raises(SqlError):
        b.sql("connect db two")


def test_two_sessions_and_open_readers(spark, tmp_path):
    a, b = Session(spark, f"file://{tmp_path}"), Session(spark, f"file://{tmp_path}")
    a.sql("create db d")
    a.sql("connect db d")
    b.sql("connect db d")
    a.sql("create table t (id int unique, v varchar)")
    b.sql("create table u (id int)")
    a.sql("create table w (id int)")
    assert sorted(r[0] for r in rows(b.sql("select tablename from schemas where fieldname == \"id\""))) == ["t", "u", "w"]
    a.sql('insert into t (id, v) values (1, "one")')
    b.sql('insert into t (id, v) values (2, "two")')
    with pytest.raises(ConstraintError):
        a.sql("insert into t (id) values (2)")
    before = a.sql("select * from t")
    b.sql('update t set v = "new" where id == 1')
    b.sql("delete from t where id == 2")
    assert sorted(rows(before)) == [(1, "one"), (2, "two")] and rows(a.sql("select * from t")) == [(1, "new")]
    # a change on top of folders that are no longer the table's is refused
    from quillon.sources.catalog import Conflict

    with pytest.raises(Conflict):
        a.catalog.replace("d", "t", before, ["d/t/none"])
    for i in range(3):
        a.sql(f"insert into t (id) values ({i + 10})")
    assert len(b.catalog.folders("d", "t")) == 4
    kept = Counter(rows(a.sql("select * from t")))
    assert b.vacuum("t").rows >= 4 and len(a.catalog.folders("d", "t")) == 1
    assert Counter(rows(a.sql("select * from t"))) == kept and len(b.catalog.store.names("d/t")) == 1


def test_writers_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    a = Session(spark, f"file://{tmp_path}")
    a.sql("create db d")
    a.sql("connect db d")
    a.sql("create table t (id int unique)")

    def write(k):
        s = Session(spark, f"file://{tmp_path}")
        s.sql("connect db d")
        for tries in range(20):
            try:
                s.sql(f"insert into t (id) values ({k})")
                return True
            except SqlError:  # the table was changed too often meanwhile
                continue
            except ConstraintError:
                return False

    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(write, [1, 2, 3, 1, 2, 3])) == 3
    assert sorted(r[0] for r in rows(a.sql("select id from t"))) == [1, 2, 3]


def test_own_root_is_in_the_shared_folder(spark):
    from quillon.sources.store import shared_folder

    s = Session(spark)
    s.sql("create db d")
    assert s.catalog.store.root.startswith(shared_folder(spark))


# all registered queries against DuckDB


def _value(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


def duck(folder, sql):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return names, out.fetchall()


def same_as_sql(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    names, want = duck(folder, sql)
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    got = Counter(repr(tuple(_value(r[c]) for c in columns)) for r in df.collect())
    assert got == Counter(repr(tuple(_value(r[names.index(c)]) for c in columns)) for r in want)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_registered_query(spark, name):
    same_as_sql(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_theta_join_reaches_whole_tables(spark):
    suppliers, customers = ([tuple(r) for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(*c).collect()] for t, c in (("supplier", ("s_suppkey", "s_nationkey", "s_acctbal")), ("customer", ("c_custkey", "c_nationkey", "c_acctbal"))))
    pairs = Counter((s, c) for s, n, x in suppliers for c, m, y in customers if x > y and n == m)
    assert Counter(rows(catalogue.queries()["join_theta"](spark, DATA))) == pairs
    assert max(c for _, c in pairs) > 50


def test_outer_joins_read_every_customer(spark):
    out = {n: rows(catalogue.queries()[n](spark, DATA)) for n in ("join_right", "join_full", "join_left_null_filter", "agg_outer_count")}
    everyone = {r[0] for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect()}
    assert {r[0] for r in out["agg_outer_count"]} == everyone == {r[0] for r in out["join_full"]} - {None}
    assert any(r[0] is None for r in out["join_right"]) and any(r[1] is None for r in out["join_full"])
    assert any(r[0] % 3 for r in out["join_left_null_filter"])


def _theta_tables(spark, folder):
    """Two tables of many rows and few keys, each with NULL, NaN and both zeros, in one file of one task; and a third."""
    numbers = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, *(float(i % 37 - 18) for i in range(2000))]
    a = [(i, (None, 1, 2)[i % 3], x, i % 7 - 3 if i % 11 else None) for i, x in enumerate(numbers)]
    b = [(i, (None, 1.0, 2.0, math.nan)[i % 4], x, i % 5) for i, x in enumerate(numbers[:80])]
    spark.createDataFrame(a, "aid int, ak int, ax double, ay int").coalesce(1).write.parquet(f"{folder}/a.parquet")
    spark.createDataFrame(b, "bid int, bk double, bx double, bz int").coalesce(1).write.parquet(f"{folder}/b.parquet")
    spark.createDataFrame([(i, f"n{i}") for i in range(-3, 4)], "nk int, nx string").write.parquet(f"{folder}/n.parquet")
    s = Session(spark)
    s.register_parquet(str(folder), "a", "b", "n")
    return s, a, b


def _holds(op, x, y):
    """NULL is the smallest value and equals itself; NaN compares with nothing."""
    if any(v is not None and v != v for v in (x, y)):
        return False
    x, y = ((v is not None, v or 0) for v in (x, y))
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y}[op]


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_theta_join_against_pairs(spark, tmp_path, op, monkeypatch):
    from quillon.plans import select

    s, a, b = _theta_tables(spark, tmp_path)
    monkeypatch.setattr(select, "BLOCK", 16)
    want = Counter((x[0], y[0]) for x in a for y in b if _holds("==", x[1], y[1]) and _holds(op, x[2], y[2]))
    mirrored = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
    assert Counter(rows(s.sql(f"select aid, bid from a join b on ax {op} bx and ak == bk"))) == want
    assert Counter(rows(s.sql(f"select aid, bid from b join a on bk == ak and ax {op} bx"))) == want
    more = Counter((x[0], y[0]) for x in a for y in b if _holds("==", x[1], y[1]) and _holds(op, x[2], y[2]) and _holds(mirrored, x[3], y[3]) and x[0] > 50)
    assert Counter(rows(s.sql(f"select aid, bid from a join b on ak == bk and ax {op} bx and ay {mirrored} bz and aid > 50"))) == more
    grouped = Counter(x[3] for x in a for y in b if _holds("==", x[1], y[1]) and _holds(op, x[2], y[2]) and x[3] is not None)
    out = rows(s.sql(f"select nx, count(bid), max(bz) from a join b on bk == ak and ax {op} bx join n on nk == ay group by nx having MAX_bz >= 0 order by nx"))
    assert [(r[0], r[1]) for r in out] == sorted((f"n{k}", v) for k, v in grouped.items())
    assert s.sql(f"select * from a join b on ak == bk and ax {op} bx").columns == ["aid", "ak", "ax", "ay", "bid", "bk", "bx", "bz"]


def test_theta_join_is_dealt_to_tasks(spark, tmp_path):
    """One file of one task on either side; every task makes pairs, and no more than a few times its share."""
    s, _, _ = _theta_tables(spark, tmp_path)
    made = Counter(r[0] for r in s.sql("select aid, bid from a join b on ax > bx and ak == bk").select(F.spark_partition_id()).collect())
    assert len(made) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(made.values()) < 3 * sum(made.values()) / len(made)
