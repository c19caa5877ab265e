"""Compare registered queries with their SQL forms in an in-process DuckDB.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(table: pa.Table) -> pa.Table:
    names = sorted(table.column_names)
    table = table.select(names)
    fields = []
    for f in table.schema:
        kind = f.type
        if pa.types.is_large_string(kind):
            kind = pa.string()
        fields.append(pa.field(f.name, kind))
    return table.cast(pa.schema(fields))


def _rows(table: pa.Table) -> list[tuple]:
    columns = [table[c].to_pylist() for c in table.column_names]
    rows = zip(*columns) if columns else []
    # adding zero turns -0.0 into 0.0
    rows = [tuple(v + 0.0 if isinstance(v, float) else v for v in row) for row in rows]
    return sorted(rows, key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    got, want = _plain(spark_df.toArrow()), _plain(con.sql(sql).to_arrow_table())
    out = []
    if got.column_names != want.column_names:
        return [f"columns {got.column_names} / {want.column_names}"]
    kinds = [(f.name, str(f.type), str(g.type)) for f, g in zip(got.schema, want.schema) if f.type != g.type]
    if kinds:
        out.append(f"types {kinds}")
    if got.num_rows != want.num_rows:
        out.append(f"rows {got.num_rows} / {want.num_rows}")
    a, b = _rows(got), _rows(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        out.append(f"{len(bad)} rows differ, first {bad[:2]}")
    return out


def main() -> int:
    import __spark_entry__ as contract
    from faintline import get_spark

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = get_spark(master="local[8]", conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), contract.oracle_sql(), 0
    for name, run in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            problems = differences(df, con, oracles[name]) if name in oracles else []
            note = "" if name in oracles else f"(rows only: {df.count()})"
        except Exception:
            problems, note = [traceback.format_exc()[-1500:]], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {time.time() - start:6.2f}s {name} {note}", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
