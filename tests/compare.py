"""Run queries against their check statements: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (Decimal, float, int)):
        number = float(value)
        return None if math.isnan(number) else (int(number) if number.is_integer() else number)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


KINDS = {"INTEGER": "whole", "BIGINT": "whole", "int": "whole", "bigint": "whole", "VARCHAR": "text", "string": "text",
         "BOOLEAN": "flag", "boolean": "flag", "DOUBLE": "double", "double": "double"}


def kinds_of(pairs):
    return sorted((name, KINDS.get(str(kind), str(kind))) for name, kind in pairs)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, folder, query, check):
    """None when the query and its statement give the same rows, else a short text."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(check)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    kinds = kinds_of(df.dtypes), kinds_of((d[0], d[1]) for d in cursor.description)
    if kinds[0] != kinds[1]:
        return f"columns {set(kinds[0]) - set(kinds[1])} against {set(kinds[1]) - set(kinds[0])}"
    if got != want:
        extra = [r for r in got if r not in want][:3] if len(got) < 20000 else []
        missing = [r for r in want if r not in got][:3] if len(got) < 20000 else []
        return f"{len(got)} rows against {len(want)}\n  {sorted(names)}\n  only query: {extra}\n  only check: {missing}"
    return None if got else "no rows"


if __name__ == "__main__":
    from tidewatch.plans import CHECKS, QUERIES
    from tidewatch.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(folder)
    for name in names:
        start = time.time()
        try:
            if name in CHECKS:
                result = difference(spark, con, folder, QUERIES[name], CHECKS[name])
            else:
                result = f"unchecked, {QUERIES[name](spark, folder).count()} rows"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if result is None else 'DIFF'} {name} {time.time() - start:.1f}s"
              + (f" {result}" if result else ""), flush=True)
