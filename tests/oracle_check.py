"""Run registered queries next to their SQL and compare row counts, types and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else float(f"{value:.10g}"))
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _kind(name: str) -> str:
    name = name.lower()
    if name in ("string", "varchar"):
        return "text"
    if name in ("bigint", "int64", "hugeint", "ubigint"):
        return "bigint"
    if name in ("integer", "int"):
        return "int"
    if name in ("double",):
        return "double"
    if name in ("float", "real"):
        return "float"
    return name


def compare(spark_df, con, sql: str) -> list[str]:
    """Problems found; an empty list means both sides agree."""
    columns = sorted(spark_df.columns)
    spark_types = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    relation = con.sql(sql)
    duck_types = {n: _kind(str(t)) for n, t in zip(relation.columns, relation.types)}
    if columns != sorted(relation.columns):
        return [f"columns differ: spark {columns} sql {sorted(relation.columns)}"]
    problems = [f"type of {c}: spark {spark_types[c]} sql {duck_types[c]}"
                for c in columns if spark_types[c] != duck_types[c]]
    left = [tuple(_plain(row[c]) for c in columns) for row in spark_df.collect()]
    order = [relation.columns.index(c) for c in columns]
    right = [tuple(_plain(row[i]) for i in order) for row in relation.fetchall()]
    if len(left) != len(right):
        problems.append(f"rows: spark {len(left)} sql {len(right)}")
    key = lambda row: tuple((v is None, str(type(v)), str(v)) for v in row)
    a, b = sorted(left, key=key), sorted(right, key=key)
    if a != b:
        different = [(x, y) for x, y in zip(a, b) if x != y][:2]
        problems.append(f"values differ {columns}: {str(different)[:700]}")
    if not left:
        problems.append("no rows")
    return problems


def main(argv):
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from forumlens.session import local_session

    sf_dir = "/root/testdata/sf" + (argv[1] if len(argv) > 1 else "0.01")
    wanted = argv[2].split(",") if len(argv) > 2 else [""]
    spark = local_session(8)
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad, slow = 0, []
    for name in queries:
        if not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                problems = compare(df, con, sqls[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        seconds = time.time() - start
        slow.append((seconds, name))
        if problems:
            bad += 1
            print(f"BAD  {name} {seconds:.1f}s", *problems, sep="\n     ", flush=True)
        elif "-v" in argv:
            print(f"ok   {name} {seconds:.1f}s", flush=True)
    print(f"{len(slow)} queries, {bad} bad; slowest", [(n, round(s, 1)) for s, n in sorted(slow)[-8:]])
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
