import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsframe.functions import records, report, text, user


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_strip(spark):
    assert one(spark, text.strip_prefixes(F.lit("FOOBARBAZ"), ["FOO", "BAR"])) == "BAZ"
    assert one(spark, text.strip_prefixes(F.lit("FOOBARBAZ"), ["BAR", "FOO"])) == "BARBAZ"
    assert one(spark, text.strip_both(F.lit("foobarfoo"), "foo")) == "bar"
    assert one(spark, text.strip_suffixes(F.lit("foobar"), "bar")) == "foo"


def test_keys(spark):
    assert one(spark, text.digits(F.lit("800-555-1212"))) == "8005551212"
    assert one(spark, text.int_or(F.lit("3a"))) is None
    assert one(spark, text.int_or(F.lit("3a"), 0)) == 0
    assert one(spark, text.int_or(F.lit("3"))) == 3
    assert one(spark, text.snake_case(F.lit("UserInfo"))) == "user_info"
    assert one(spark, text.slug(F.lit("Hello, World_1"))) == "hello-world_1"
    assert one(spark, text.title(F.lit("first_name"))) == "First Name"
    assert one(spark, text.hex_pairs(F.lit("000000000001"))) == "00:00:00:00:00:01"


@pytest.mark.parametrize("given,want", [("1", "1"), ("123", "123"), ("1234567890", "1,234,567,890"), ("123.0", "123.0"),
                                        ("1234.56789", "1,234.56789"), ("1234.50", "1,234.50"), ("-123", "-123"), ("-1234", "-1,234"), (None, None)])
def test_commas(spark, given, want):
    assert one(spark, report.commas(F.lit(given).cast("string"))) == want


def test_ordinals_and_base36(spark):
    wanted = {0: "0th", 1: "1st", 2: "2nd", 3: "3rd", 4: "4th", 11: "11th", 12: "12th", 13: "13th", 91: "91st", 101: "101st",
              102: "102nd", 111: "111th"}
    rows = spark.createDataFrame([(n,) for n in wanted], "n int").select("n", report.ordinal(F.col("n"))).collect()
    assert {r[0]: r[1] for r in rows} == wanted
    assert [one(spark, report.base36(F.lit(n))) for n in (0, 35, 119292)] == ["0", "z", "2k1o"]
    with pytest.raises(Exception, match="positive"):
        one(spark, report.base36(F.lit(-393)))


def test_display(spark):
    assert one(spark, report.fill(F.lit("8005551212"), "(XXX) XXX-XXXX")) == "(800) 555-1212"
    assert one(spark, report.fill(F.lit("12"), "$X1X2")) == "$1122"
    assert one(spark, report.fill(F.lit("80"), "XXX")) is None
    assert one(spark, report.fill_date(F.lit("20240102030405"))) == "2024-01-02 03:04:05"
    assert one(spark, report.shorten(F.lit("a" * 14 + "b" * 5 + "c" * 14))) == "a" * 14 + ".." + "c" * 14
    assert one(spark, report.shorten(F.lit("short"))) == "short"
    assert one(spark, report.rate_text(F.lit(2 * 1024 * 1024 + 1))) == "2.0m"
    assert one(spark, report.rate_text(F.lit(2560))) == "2k"
    assert one(spark, report.rate_text(F.lit(1024))) == "1024b"
    assert one(spark, report.size_text(F.lit(1 << 30))) == "1G"
    assert one(spark, report.size_text(F.lit(1000))) == "1000"


def test_age(spark):
    d = dt.datetime(1970, 5, 1)
    cases = [(d, d, "0 microseconds ago")]
    for delta, want in [(dict(microseconds=1), "1 microsecond ago"), (dict(microseconds=2), "2 microseconds ago"),
                        (dict(microseconds=-1), "1 microsecond from now"), (dict(microseconds=-2), "2 microseconds from now"),
                        (dict(microseconds=2000), "2 milliseconds ago"), (dict(seconds=2), "2 seconds ago"),
                        (dict(seconds=120), "2 minutes ago"), (dict(seconds=7200), "2 hours ago"), (dict(days=2), "2 days ago")]:
        cases.append((d, d + dt.timedelta(**delta), want))
    cases += [(dt.datetime(1970, 1, 1), d, "January  1"), (dt.datetime(1969, 1, 1), d, "January  1, 1969"),
              (dt.datetime(1970, 6, 1), d, "June  1, 1970"), (None, d, "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a timestamp_ntz, b timestamp_ntz")
    got = dict(df.select("i", report.age(F.col("a"), F.col("b"))).collect())
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_shape(spark):
    df = spark.createDataFrame([([1, 2], 1)], "a array<int>, b int")
    assert records.shape(df, ["a"]).first().a == 2
    assert records.shape(df, [], {"a": []}).first().a == [1, 2]
    assert records.shape(df, [], {"b": []}).first().b == [1]
    assert records.shape(df, [], {"c": 5}).first().c == 5
    with pytest.raises(KeyError):
        records.shape(df, ["missing"])
    assert one(spark, records.if_else(F.lit(None).cast("boolean"), "a", "b")) == "b"


def test_replace_and_last(spark):
    replaced, last = text.replace_and_last(F.lit("goooooofball"), "g(oo+)fball", "f$1lish")
    assert one(spark, replaced) == "foooooolish"
    assert one(spark, last) == ["oooooo"]
    assert one(spark, text.replace_and_last(F.lit("none"), "g(oo+)", "x")[1]) is None


def test_markup(spark):
    assert one(spark, text.escape_markup(F.lit("<b> http://a.b (http://c.d)"))) == "&lt;b> <http://a.b> (http://c.d)"


def test_statements(spark):
    cases = {"select a from users where id = 1": ("select", "users", True, "read"), "SELECT 1": (None, None, None, "read"),
             "UPDATE users SET a = 1": ("update", "users", False, "write"), "delete from log where id = 1": ("delete", "log", False, "write"),
             "insert into log values (1)": ("insert", "log", False, "write")}
    df = spark.createDataFrame([(c,) for c in cases], "sql string")
    got = {r.sql: (r.kind, r.table, r.reads, r.target) for r in text.classify_statements(df, "sql").collect()}
    assert got == cases


def test_digest(spark):
    stored = records.salted(F.lit("abcde"), F.lit("secret"))
    assert one(spark, records.verify(F.lit("secret"), stored)) is True
    assert one(spark, records.verify(F.lit("other"), stored)) is False
    assert one(spark, records.verify(F.lit("x"), F.lit("malformed"))) is False


def test_actions(spark):
    df, actions = spark.range(5), user.Actions()
    actions.add("double", lambda d: d.select((F.col("id") * 2).alias("id")))
    assert sorted(r.id for r in actions.run("double", df, "id", spark.createDataFrame([(1,), (3,)], "id long")).collect()) == [2, 6]
    with pytest.raises(LookupError):
        actions.run("none", df, "id", df)
    with pytest.raises(ValueError):
        actions.run("double", df, "id", df.limit(0))


def test_safe_map_isolates_failures(spark):
    got = user.safe_map(spark.range(4), lambda r: 10 // r["id"], "long").orderBy("id").collect()
    assert [(r.value, r.ok) for r in got] == [(None, False), (10, True), (5, True), (3, True)]
    assert got[0].error.startswith("ZeroDivisionError")
