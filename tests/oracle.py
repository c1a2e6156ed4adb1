"""Run a query and its SQL oracle and compare columns, types and rows."""

import duckdb

TABLES = ("events", "part")
# DuckDB type of a Spark type, as the oracles have to return it.
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(df, sql, sf_dir):
    """Differences as text, empty if there are none."""
    result = duck(sf_dir).execute(sql)
    expected_types = {d[0]: str(d[1]).upper() for d in result.description}
    expected_rows = result.fetchall()
    names = sorted(expected_types)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} != {names}"
    for f in df.schema:
        kind = f.dataType.simpleString()
        kind = TYPES.get(kind, kind.upper())
        if kind != expected_types[f.name]:
            return f"type of {f.name}: {kind} != {expected_types[f.name]}"
    position = {d: i for i, d in enumerate(d[0] for d in result.description)}
    want = sorted((tuple(r[position[n]] for n in names) for r in expected_rows), key=_key)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} != {w}"
    return ""
