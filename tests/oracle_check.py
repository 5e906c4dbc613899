"""Compare registered queries with their DuckDB SQL: `python tests/oracle_check.py DIR [names]`."""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tallyroute.plans.oracle import ORACLE_SQL, TABLES  # noqa: E402
from tallyroute.plans.queries import QUERIES  # noqa: E402


DUCKDB_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "date": "DATE",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    return {d[0]: str(d[1]) for d in cursor.description}, cursor.fetchall()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def differences(sf_dir: str, name: str, df) -> str | None:
    rows = df.collect()
    types, expected = oracle_rows(sf_dir, ORACLE_SQL[name])
    schema = {f.name: DUCKDB_TYPES[f.dataType.simpleString()] for f in df.schema.fields}
    if schema != types:
        return f"schema {sorted(schema.items() ^ types.items())}"
    ours, theirs = canonical(df.columns, rows), canonical(list(types), expected)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} != {b}"
    return None


if __name__ == "__main__":
    from tallyroute.plans.session import local_session

    session = local_session()
    folder, wanted = sys.argv[1], sys.argv[2:] or list(QUERIES)
    failed = 0
    for query in wanted:
        began = time.time()
        try:
            found = differences(folder, query, QUERIES[query](session, folder))
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"{query}: {found or 'ok'} ({time.time() - began:.1f} s)", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
