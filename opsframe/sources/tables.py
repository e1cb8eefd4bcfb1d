"""Table scans and JDBC options."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_dialects: dict[str, dict] = {}


def register_dialect(name: str, subprotocol: str, driver: str, port: int | None = None) -> None:
    """Make a database name known to `jdbc_options`."""
    _dialects[name] = {"subprotocol": subprotocol, "driver": driver, "port": port}


# Public JDBC subprotocols and driver classes.
register_dialect("mysql", "mysql", "com.mysql.cj.jdbc.Driver", 3306)
register_dialect("postgres", "postgresql", "org.postgresql.Driver", 5432)
register_dialect("sqlite", "sqlite", "org.sqlite.JDBC")
register_dialect("firebird", "firebirdsql", "org.firebirdsql.jdbc.FBDriver", 3050)
register_dialect("mssql", "sqlserver", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433)
register_dialect("oracle", "oracle:thin", "oracle.jdbc.OracleDriver", 1521)


def parse_url(url: str) -> dict:
    """`dbn://user:pw@host:port/db` as a dict; absent parts are None."""
    parts = urlparse(url)
    text = {"user": parts.username, "pw": parts.password, "host": parts.hostname}
    return {"dbn": parts.scheme, "db": unquote(parts.path[1:]), "port": parts.port,
            **{k: unquote(v) if v else None for k, v in text.items()}}


def jdbc_options(url: str) -> dict[str, str]:
    """Spark JDBC options for a database URL. An unregistered database name is an error."""
    p = parse_url(url)
    if p["dbn"] not in _dialects:
        raise LookupError(f"unknown database {p['dbn']!r}; known: {sorted(_dialects)}")
    d = _dialects[p["dbn"]]
    host = p["host"] or "localhost"
    port = p["port"] or d["port"]
    where = f"{host}:{port}" if port else host
    target = {"sqlite": p["db"], "mssql": f"//{where};databaseName={p['db']}", "oracle": f"@//{where}/{p['db']}"}
    options = {"url": f"jdbc:{d['subprotocol']}:{target.get(p['dbn'], f'//{where}/' + p['db'])}", "driver": d["driver"]}
    return options | {k: v for k, v in (("user", p["user"]), ("password", p["pw"])) if v is not None}


def read_jdbc(spark: SparkSession, url: str, table: str, split: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """Scan a database table; `split` = (column, low, high, parts) reads it in parallel ranges."""
    reader = spark.read.format("jdbc").options(dbtable=table, **jdbc_options(url), **options)
    if split:
        column, low, high, parts = split
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(dbtable=table, **jdbc_options(url), **options).mode(mode).save()


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Scan files of any Spark format. Give a schema for text formats: inferring it reads the data twice."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)
