import pytest
from lodeframe.engine import Engine, compile_expression
from lodeframe.errors import BindError, ParseError
from lodeframe.plans.parser import parse_expression, parse_query


@pytest.mark.parametrize("text", [
    "SELECT a FROM t", "SELECT DISTINCT a, b AS c FROM t@v0123456789abcdef01 AS x WHERE a = 1 AND NOT b > 2 OR c IN (1, 2)",
    "SELECT count(DISTINCT a), sum(b) FROM t GROUP BY a, b + 1 HAVING count() > 1 ORDER BY 1 DESC NULLS FIRST LIMIT 3 OFFSET 2",
    "SELECT CASE WHEN a IS NOT NULL THEN 'it''s' ELSE \"Odd Name\" END, .5, 1e3, -(a - 1) / 2 FROM t", "SELECT x.*, x.a FROM t AS x",
])
def test_printed_queries_parse_to_themselves(text):
    q = parse_query(text)
    assert parse_query(str(q)) == q


@pytest.mark.parametrize("text", ["", "INSERT x", "SELECT a == 1", "SELECT 1 FROM t LIMIT -1", "SELECT a FROM t JOIN u", "SELECT f(*)", "SELECT 'x\ny'", "SELECT 1e+3", "SELECT a FROM t@vxyz", "SELECT count(DISTINCT *)", "SELECT (1", "SELECT a b c FROM t"])
def test_bad_text(text):
    with pytest.raises(ParseError):
        parse_query(text)


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    rows = [(1, None, 1.45, "Joe", True), (2, 3, 2.5, " Ondřej\t", False), (3, 0, -3.5, "Bob", None)]
    df = spark.createDataFrame(rows, "foo int, bar bigint, x double, name string, ok boolean").repartition(3)
    e.catalog.view("t", df)
    return e


@pytest.mark.parametrize(("text", "want"), [
    ("foo/2", [0, 1, 1]), ("(-foo)/2", [0, -1, -1]), ("round(x)", [1.0, 3.0, -4.0]), ("round(x, 1)", [1.5, 2.5, -3.5]), ("trim(name)", ["Joe", "Ondřej", "Bob"]), ("left(name, 2)", ["Jo", " O", "Bo"]),
    ("left(name, -1)", ["", "", ""]), ("split_part(name, 'o', 1)", ["J", "", "B"]), ("split_part(name, 'zz', 1)", ["", "", ""]), ("sqrt(x - 2)", [None, 0.7071067811865476, None]),
    ("coalesce(bar, foo)", [1, 3, 0]), ("bar = NULL", [True, False, False]), ("bar IS NOT NULL", [False, True, True]), ("foo != NULL", [True, True, True]), ("nullif(bar, 0)", [None, 3, None]), ("nullif(foo, NULL)", [1, 2, 3]),
    ("ok OR foo = 3", [True, False, True]), ("ok IS TRUE", [True, False, False]), ("NOT foo = 1", [False, True, True]), ("foo IN (1, 3.0)", [True, False, True]), ("name LIKE '%o%'", [True, False, True]), ("foo < NULL", [None] * 3), ("1 + 2 * foo", [3, 5, 7]),
])
def test_expressions(engine, text, want):
    got = [r[0] for r in engine.sql(f"SELECT {text} AS v FROM t ORDER BY foo").collect()]
    assert got == (pytest.approx(want) if all(isinstance(w, float) for w in want) else want)


def test_names_and_duplicates(engine):
    assert engine.sql('SELECT foo+1, FOO, *, foo FROM t').columns == ["foo+1", "FOO", "foo", "bar", "x", "name", "ok", "foo"]


@pytest.mark.parametrize("text", [
    "SELECT nope FROM t", "SELECT foo = name FROM t", "SELECT foo FROM t WHERE foo", "SELECT foo, count() FROM t", "SELECT foo FROM t WHERE count() > 1", "SELECT sum(name) FROM t", "SELECT sum(sum(foo)) FROM t", "SELECT NULL = NULL FROM t",
    "SELECT foo FROM t ORDER BY 2", "SELECT foo FROM t GROUP BY 3", "SELECT left(foo, 1) FROM t", "SELECT sin() FROM t", "SELECT u.foo FROM t", "SELECT lower(DISTINCT name) FROM t", "SELECT NOT foo FROM t", "SELECT -name FROM t", "SELECT *", "SELECT coalesce(foo, name) FROM t",
])
def test_bind_errors(engine, text):
    with pytest.raises(BindError):
        engine.sql(text)


@pytest.mark.parametrize(("clause", "want"), [("ASC", [0, 3, None]), ("DESC", [None, 3, 0]), ("ASC NULLS FIRST", [None, 0, 3]), ("DESC NULLS LAST", [3, 0, None])])
def test_null_order(engine, clause, want):
    assert [r[0] for r in engine.sql(f"SELECT bar FROM t ORDER BY bar {clause}").collect()] == want


def test_grouping(engine):
    assert engine.sql("SELECT count() AS n, max(foo) AS m FROM t WHERE 1 > 2").collect() == [(0, None)]
    assert sorted(engine.sql("SELECT foo > 1 AS big, foo > 1 AS again, count() + 1 AS n FROM t GROUP BY big").collect()) == [(False, False, 2), (True, True, 3)]
    assert engine.sql("SELECT bar FROM t GROUP BY bar HAVING bar IS NULL").collect() == [(None,)]
    assert engine.sql("SELECT avg(DISTINCT foo) AS a FROM t WHERE foo > 9").collect() == [(None,)]


def test_compile_expression(engine, spark):
    df = spark.range(3)
    assert [r[0] for r in df.select(compile_expression("id * 2", df)).collect()] == [0, 2, 4]
    assert str(parse_expression("a+b * (c - 1)")) == "a+b*(c-1)"


def test_null_and_negative_arguments(spark):
    from lodeframe.engine import Engine

    e = Engine(spark)
    e.catalog.view("t", spark.createDataFrame([("a-b", 1), ("a-b", None), ("a-b", 0)], "s string, n long"))
    assert [r.l for r in e.sql("SELECT left(s, n) AS l FROM t ORDER BY n").collect()] == ["", "a", None]
    assert [r.p for r in e.sql("SELECT split_part(s, '-', n) AS p FROM t ORDER BY n").collect()] == ["", "a", None]
    with pytest.raises(Exception, match="not negative"):
        e.sql("SELECT split_part(s, '-', n - 2) AS p FROM t").collect()
    assert [r.l for r in e.sql("SELECT left(s, n - 5) AS l FROM t WHERE n = 1").collect()] == [""]


def test_joins(spark):
    from lodeframe.engine import Engine
    from lodeframe.errors import BindError, ParseError
    from lodeframe.plans.parser import parse_query

    e = Engine(spark)
    e.catalog.view("a", spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, v string"))
    e.catalog.view("b", spark.createDataFrame([(1, 0.5), (1, 1.5), (None, 2.5)], "k long, w double"))
    rows = lambda text: [tuple(r) for r in e.sql(text).collect()]
    assert rows("SELECT a.k AS k, v, w FROM a JOIN b ON a.k = b.k ORDER BY w") == [(1, "x", 0.5), (1, "x", 1.5)]
    assert rows("SELECT v, w FROM a LEFT JOIN b ON a.k = b.k AND w < 1 ORDER BY v") == [("x", 0.5), ("y", None), ("z", None)]
    assert rows("SELECT * FROM a JOIN b ON a.k = b.k ORDER BY w LIMIT 1") == [(1, "x", 1, 0.5)]
    assert rows("SELECT one.v AS p, two.v AS q FROM a one JOIN a two ON one.k = two.k - 1") == [("x", "y")]
    assert rows("SELECT v, count(w) AS n FROM a LEFT OUTER JOIN b ON b.k = a.k GROUP BY v ORDER BY v") == [("x", 2), ("y", 0), ("z", 0)]
    for wrong in ("SELECT k FROM a JOIN b ON a.k = b.k", "SELECT v FROM a JOIN b ON a.k < b.k", "SELECT v FROM a JOIN b ON w = 1", "SELECT v FROM a JOIN a ON a.k = a.k", "SELECT v FROM a x JOIN b ON a.k = b.k", "SELECT v FROM a JOIN b ON a.k", "SELECT v FROM a JOIN b ON count(w) = a.k"):
        with pytest.raises(BindError):
            e.sql(wrong)
    for wrong in ("SELECT v FROM a JOIN b", "SELECT v FROM a CROSS JOIN b ON a.k = b.k", "SELECT v FROM a LEFT b ON a.k = b.k"):
        with pytest.raises(ParseError):
            e.sql(wrong)
    text = "SELECT v FROM a AS x LEFT JOIN b@v0123456789abcdef01 ON x.k = b.k WHERE v > 'a'"
    assert str(parse_query(str(parse_query(text)))) == str(parse_query(text))
