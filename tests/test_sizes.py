"""Tables as larger runs have them: folders of parts, long keys, many small pages; against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tabulon import catalog
from tabulon.operators import joins
from tests.oracle import connect, difference


def test_streams_of_a_folder_of_parts(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "system") for c in range(9) for t in range(c + 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.queries()["sm2_ordered_answers"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == rows


def test_cell_numbers_of_long_keys(spark, tmp_path):
    keys = [0, 7, 999_999, 1_000_000, 1_199_999, 2**31 - 1]
    rows = [(i, line, key) for i, key in enumerate(keys) for line in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["pr8_cell_number"](spark, str(tmp_path)).collect()
    assert {(r.l_orderkey, r.l_linenumber): r.v for r in got} == {(i, line): key if line == 2 else None for i, line, key in rows}


def many_pages(spark, folder, n=400):
    rng = random.Random(7)
    rows = [(o, rng.randrange(1, 8), float(rng.randrange(1, 51)), rng.choice("RAN"), "O") for o in range(n) for _ in range(rng.randrange(1, 9))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    return rows


def without_a_call_a_page(df):
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    return df.collect()


def test_merged_rows_of_many_pages(spark, tmp_path):
    want, pages = [], defaultdict(set)
    for page, line, y, _, _ in many_pages(spark, tmp_path):
        if line == 1:
            pages[page].add(y)
    for page, held in pages.items():
        runs = []
        for y in sorted(held):
            if runs and y <= runs[-1][1] + 2:
                runs[-1][1] = y + 4
            else:
                runs.append([y, y + 4])
        want += [(page, *r) for r in runs]
    got = without_a_call_a_page(catalog.queries()["sk12_merged_rows"](spark, str(tmp_path)))
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > len(pages)


def test_merged_rows_of_all_boxes(spark, tmp_path):
    want, pages = [], defaultdict(set)
    for page, _, y, _, _ in many_pages(spark, tmp_path):
        pages[page].add(y)
    for page, held in pages.items():
        runs = []
        for y in sorted(held):
            if runs and y <= runs[-1][1] + 2:
                runs[-1][1] = y + 4
            else:
                runs.append([y, y + 4])
        want += [(page, *r) for r in runs]
    query = catalog.queries()["sk12_merged_rows"](spark, str(tmp_path))
    assert sorted(map(tuple, without_a_call_a_page(query))) == sorted(want) and len(pages) == 400
    con = connect(str(tmp_path))
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert not difference(query, catalog.oracle_sql()["sk12_merged_rows"], con)


def test_grids_of_many_pages(spark, tmp_path):
    pages = defaultdict(set)
    for page, line, *_ in many_pages(spark, tmp_path):
        pages[page].add(line)
    even = {p: sum(x % 2 == 0 for x in held) for p, held in pages.items()}
    got = {name: sorted(map(tuple, without_a_call_a_page(catalog.queries()[name](spark, str(tmp_path))))) for name in ("jo9_grid_lines", "jo11_known_layouts")}
    assert got["jo9_grid_lines"] == sorted((p, len(x), 1.0, True) for p, x in pages.items())
    assert got["jo11_known_layouts"] == sorted((p, even[p], even[p] / len(x), even[p] >= 0.95 * len(x)) for p, x in pages.items() if even[p])


def test_grid_likeness_reads_lines_once(spark, tmp_path):
    rng = random.Random(11)
    line = lambda p, i: (p, i, rng.random() < 0.9, rng.choice((0.5, 5.0)) + rng.randrange(6) * 0.0025, rng.choice((0.0, 0.01, 0.03)), 1.0)
    names = "page long, id long, across boolean, pos double, start double, end double"
    a, b = ([line(p, rng.choice((None, *range(8)))) for p in [*range(90), None] for _ in range(rng.randrange(12))] for _ in range(2))
    a, b = a + [(90 + s, 1, True, None if s else 0.5, 0.0, 1.0) for s in range(2)], b + [(90 + s, 1, True, 0.5, 0.0, None if s else 1.0) for s in range(2)]
    x, y = (spark.createDataFrame(r, names).repartition(3) for r in (a, b))
    paired = joins.greedy_match(joins.line_candidates(x, y, ["page"])).groupBy("page").count().collect()
    matched = {r.page: r["count"] for r in paired}
    n_a, n_b = (defaultdict(int), defaultdict(int))
    for rows, n in ((a, n_a), (b, n_b)):
        for r in rows:
            n[r[0]] += 1
    want = sorted((p, matched.get(p, 0), matched.get(p, 0) / max(n_a[p], n_b[p])) for p in n_a if p is not None and p in n_b)
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found = joins.grid_likeness(x, y, "page")
        got = sorted((r.page, r.matched, r.likeness) for r in found.collect())
        assert got == want and sum(m for _, m, _ in want) > 90
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Join" not in found._jdf.queryExecution().toString()


def test_greedy_match_of_many_pages(spark):
    rng = random.Random(9)
    rows = [(page, i, i // 2, j, float(rng.randrange(4))) for page in [*range(60), None] for i in range(6) for j in rng.sample(range(7), rng.randrange(1, 5))]
    want = set()
    for page in {r[0] for r in rows}:
        left, used = defaultdict(list), set()
        for _, i, at, j, d in (r for r in rows if r[0] == page):
            left[i].append((at, d, j))
        for i in sorted(left, key=lambda i: (min(left[i]), i)):
            free = [x for x in sorted(left[i]) if x[2] not in used]
            if free:
                used.add(free[0][2])
                want.add((page, i, free[0][2], free[0][1]))
    got = without_a_call_a_page(joins.greedy_match(spark.createDataFrame(rows, "page long, left_id long, left_ord int, right_id long, distance double").repartition(5)))
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_sequences_with_nulls(spark, tmp_path):
    rows = [(1, 5.0, 1.0), (1, 6.0, 2.0), (1, 9.0, None), (2, 1.0, 3.0), (2, None, 4.0), (2, 3.0, 5.0), (2, 4.0, 6.0), (None, 1.0, 1.0), (None, 2.0, 2.0), (3, None, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    assert not difference(catalog.queries()["fi9_increasing"](spark, str(tmp_path)), catalog.oracle_sql()["fi9_increasing"], connect(str(tmp_path)))


def test_sequences_with_ties_in_any_layout(spark, tmp_path):
    rng, query, sql = random.Random(11), catalog.queries()["fi9_increasing"], catalog.oracle_sql()["fi9_increasing"]
    rows = [(o, rng.choice([None, -0.0, 0.0, 1.0, 2.0, 3.0]), rng.choice([None, -0.0, 0.0, 1.0, 2.0])) for o in [*range(200), None] for _ in range(6)]
    closed = sql.replace("ORDER BY l_extendedprice)", "ORDER BY l_extendedprice, l_quantity)")  # one of the results that the SQL leaves open
    assert closed != sql
    for name, laid in (("there", rows), ("back", rows[::-1])):
        spark.createDataFrame(laid, "l_orderkey long, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/made_{name}")
        (tmp_path / name).mkdir()
        next((tmp_path / f"made_{name}").glob("*.parquet")).rename(tmp_path / name / "lineitem.parquet")
        assert not difference(query(spark, f"{tmp_path}/{name}"), closed, connect(f"{tmp_path}/{name}"))


def test_known_formats_of_keys_in_several_rows(spark, tmp_path):
    rows = [(1, "red bolt"), (1, "bolt new"), (2, "new bolt"), (None, "red bolt"), (3, None), (4, ""), (5, ""), (6, "red red bolt")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "part.parquet")
    assert not difference(catalog.queries()["jo10_known_formats"](spark, str(tmp_path)), catalog.oracle_sql()["jo10_known_formats"], connect(str(tmp_path)))


def test_known_formats_of_one_name_use_all_tasks(spark, tmp_path):
    spark.range(2000).selectExpr("id AS p_partkey", "'red bolt' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["jo10_known_formats"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*"), F.min("score")).collect()
    assert sum(r[1] for r in got) == 2000 * 2000 and {r[2] for r in got} == {1.0}
    assert max(r[1] for r in got) < 2000 * 2000 / 4


def boxes_with_nulls(spark, folder):
    """No two boxes of a page are equal; some have no place, some no line."""
    held = [(p, i, y) for p in (*range(20), None) for i in (*range(1, 5), None) for y in (1.0, 6.0, 20.0, 50.0, None)]
    rows = [(*b, "A", "O") for b in random.Random(4).sample(held, 400)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{folder}/made")
    next((folder / "made").glob("*.parquet")).rename(folder / "lineitem.parquet")


def test_islands_of_boxes_with_nulls(spark, tmp_path):
    boxes_with_nulls(spark, tmp_path)
    for name in ("wi10_islands", "ag7_edge_clusters"):
        assert not difference(catalog.queries()[name](spark, str(tmp_path)), catalog.oracle_sql()[name], connect(str(tmp_path)))


def test_column_runs_of_boxes_with_nulls(spark, tmp_path):
    boxes_with_nulls(spark, tmp_path)
    assert not difference(catalog.queries()["wi16_column_runs"](spark, str(tmp_path)), catalog.oracle_sql()["wi16_column_runs"], connect(str(tmp_path)))
