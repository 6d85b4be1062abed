"""Queries take every row of their tables: small tables with ids beyond any subset, against plain Python."""

import random

from tabulon import catalog


def part_table(spark, folder):
    names = ["red bolt", "bolt red", "red bolt new", "gear", "old gear", "cold anvil hot", "hot cold"]
    rows = [(i, names[i * 5 % len(names)]) for i in [*range(1, 9), *range(396, 406), 5000, 70001, 70002, 900000]]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{folder}/part.parquet")
    return rows


def test_known_formats_of_all_parts(spark, tmp_path):
    words = {i: set(n.split(" ")) for i, n in part_table(spark, tmp_path)}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in words.items() for b, y in words.items() if len(x & y) / len(x | y) >= 0.5}
    got = catalog.queries()["jo10_known_formats"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.score for r in got} == want
    assert len(got) == len(want) and {a for a, _ in want} == set(words)


def line_table(spark, folder, rows):
    names = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_extendedprice double"
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/lineitem.parquet")


def role_of(cells):
    """Of (order, text, has a price) the role of a column without a header."""
    n, texts = len(cells), [t for _, t, _ in sorted(cells)]
    ints = [int(t) if len(t) <= 4 else None for t in texts]
    whole = sum(i is not None for i in ints)
    ups = sum(x is not None and y is not None and y > x for x, y in zip(ints, ints[1:], strict=False))
    if sum(p for _, _, p in cells) >= 0.4 * n:
        return "price"
    if whole >= 0.8 * n:
        return "row" if whole >= 3 and ups >= 0.7 * (whole - 1) else "qty"
    return "code" if sum(len(t) >= 4 for t in texts) >= 0.7 * n else "text"


def test_roles_of_all_columns(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for supplier in range(12):
        for line in range(1, 8):
            kind, n = (supplier + line) % 5, rng.choice((1, 2, 3, 9, 40))
            for k in range(n):
                part = {0: rng.randrange(10000), 1: 5 + 7 * k, 2: rng.randrange(10000, 90000), 3: rng.choice((7, 70, 12345)), 4: rng.randrange(10, 20000)}[kind]
                rows.append((k // 2 * 3000, line, supplier, part, rng.choice("RAN" if kind == 4 else "AANNNNNNR"), 1.0))
    line_table(spark, tmp_path, rows)
    cells = {}
    for order, line, supplier, part, flag, _ in rows:
        cells.setdefault((supplier, line), []).append(((order, part), str(part), flag == "R"))
    want = {k: role_of(v) for k, v in cells.items()}
    got = catalog.queries()["ag9_column_roles"](spark, str(tmp_path)).collect()
    assert {(r.tbl, r.col): r.role for r in got} == want and len(got) == len(want) == 84
    assert set(want.values()) == {"price", "row", "qty", "code", "text"}


def test_restarts_of_all_orders(spark, tmp_path):
    rng = random.Random(5)
    orders = [0, 1, 2, 1023, 1024, 1025, 1999, 2000, 2001, 5000, 5001, *rng.sample(range(9000, 400000), 60), 2**40]
    rows = [(o, line, rng.randrange(9), rng.randrange(99), "A", float(rng.randrange(999))) for o in orders for line in rng.sample(range(1, 8), rng.randrange(1, 4)) for _ in range(rng.choice((1, 1, 2)))]
    line_table(spark, tmp_path, rows)
    rows.sort(key=lambda r: (r[0], r[1], r[3], r[2], r[5]))
    want = sorted((y[0], y[3], 1) for x, y in zip(rows, rows[1:], strict=False) if y[1] == 1 and x[1] > 1)
    got = catalog.queries()["wi4_restarts"](spark, str(tmp_path)).collect()
    assert sorted((r.l_orderkey, r.l_partkey, r.l_linenumber) for r in got) == want
    assert sum(o >= 2000 for o, _, _ in want) > 10 and all(r.restart for r in got)
