"""Run registered queries and their checking statements side by side."""

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def ordered(columns, rows):
    names = sorted(columns)
    places = [columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[p]) for p in places) for r in rows), key=lambda r: tuple(map(repr, r)))


def kind(name):
    """Type family, so that engines' names for one type compare equal."""
    name = str(name).lower()
    for family, words in {"int": ("bigint", "long"), "int32": ("integer", "int"), "double": ("double",),
                          "text": ("varchar", "string"), "bool": ("bool",)}.items():
        if any(name.startswith(w) for w in words):
            return family
    return name


def compare(con, spark, folder, function, statement):
    """None when both sides agree, else a description of the first difference."""
    df = function(spark, folder)
    rows = df.collect()
    result = con.execute(statement)
    columns, types = [d[0] for d in result.description], [d[1] for d in result.description]
    expected = result.fetchall()
    if len(set(df.columns)) < len(df.columns) or len(set(columns)) < len(columns):
        return f"repeated names in {df.columns} or {columns}"
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    ours = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {c: kind(t) for c, t in zip(columns, types)}
    wrong = {c: (ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]}
    if len(rows) != len(expected):
        return f"rows {len(rows)} != {len(expected)}"
    names, a = ordered(df.columns, [tuple(r) for r in rows])
    _, b = ordered(columns, expected)
    for x, y in zip(a, b):
        if x != y:
            return f"{[(n, p, q) for n, p, q in zip(names, x, y) if p != q]} in {dict(zip(names, x))}"
    return f"types {wrong}" if wrong else None


def main(names, folder):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from lendgauge.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, statements = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            if name in statements:
                found = compare(con, spark, folder, queries[name], statements[name])
            else:
                found = f"rows only: {queries[name](spark, folder).count()}"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:400]}"
        if found or len(names) < 30:
            print(f"{name}: {found or 'ok'} ({time.time() - start:.1f}s)", flush=True)
    print("checked", len(names or queries))


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
