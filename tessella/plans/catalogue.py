"""The driver's queries over its tables, each with the same question in DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import a1
from tessella.functions import text as X
from tessella.functions.cells import conforms, number_text, text_number
from tessella.functions.formula import compile_expression, range_total, sum_if, translate
from tessella.operators import catalog as K
from tessella.operators import coverage as C
from tessella.operators import detect as D
from tessella.operators import evals as E
from tessella.operators import gate as G
from tessella.operators import grid as S
from tessella.operators import index as I
from tessella.operators import layout as L
from tessella.operators import probes as B
from tessella.operators import resolve as R
from tessella.plans import evaluate as V
from tessella.plans import fixtures as FX
from tessella.plans import tables as T
from tessella.plans.extract import Config, extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT CAST(n_nationkey + 2 AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, text FROM (
  SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS n_nationkey, unnest([1, 2, 3]) AS col, unnest([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)]) AS text FROM nation)
WHERE text IS NOT NULL AND text <> '' UNION ALL SELECT 1, 1, 'n_nationkey' UNION ALL SELECT 1, 2, 'n_name' UNION ALL SELECT 1, 3, 'n_regionkey'
""")
def q01_cells_nonempty(spark, sf_dir):
    from tessella.functions.cells import cell_text

    grid = S.grid_of(t(spark, sf_dir, "nation"), "n_nationkey", "nation")
    return S.long_cells(grid).select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), cell_text(F.col("cell")).alias("text"))


@query("""
SELECT CAST(rn + 1 AS BIGINT) AS "row", s_name AS b, s_acctbal AS d FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) WHERE rn + 1 BETWEEN 4 AND 9
""")
def q02_region_scan(spark, sf_dir):
    part = S.region(S.grid_of(t(spark, sf_dir, "supplier"), "s_suppkey", "supplier"), "supplier", "B4:D9")
    return part.select(F.col("row").cast("bigint"), F.element_at("cells", 1)["str"].alias("b"), F.element_at("cells", 3)["num"].alias("d"))


@query("""
WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) + 1 AS r FROM customer)
SELECT c_custkey AS row_key, 'c_name' AS column_name, c_name AS value, 'B' || r AS cell_ref, 'ok' AS status FROM c
UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, 'E' || r, 'ok' FROM c
""")
def q03_point_lookup_batch(spark, sf_dir):
    customer = t(spark, sf_dir, "customer")
    asked = customer.select(F.col("c_custkey").alias("row_key"), F.explode(F.array(F.lit("c_name"), F.lit("c_mktsegment"))).alias("column_name"))
    return I.lookup(S.numbered(customer, "c_custkey"), "c_custkey", asked, ["c_name", "c_mktsegment"])


@query("""
SELECT id AS row_key, name AS column_name, CASE WHEN name <> 'c_name' THEN 'unknown-column' WHEN c_custkey IS NULL THEN 'unknown-row' ELSE 'ok' END AS status
FROM (SELECT c_custkey * 3 AS id, unnest(['c_name', 'nothing']) AS name FROM customer) LEFT JOIN (SELECT c_custkey FROM customer) ON c_custkey = id
""")
def q04_lookup_missing(spark, sf_dir):
    customer = t(spark, sf_dir, "customer")
    asked = customer.select((F.col("c_custkey") * 3).alias("row_key"), F.explode(F.array(F.lit("c_name"), F.lit("nothing"))).alias("column_name"))
    return I.lookup(S.numbered(customer, "c_custkey"), "c_custkey", asked, ["c_name"]).select("row_key", "column_name", "status")


@query("""
SELECT CAST(rn AS BIGINT) AS position, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn IN (1, 2, 100, 2500, 5000)
""")
def q05_positional_lookup(spark, sf_dir):
    rows = S.with_row_number(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], first=2)
    asked = spark.createDataFrame([(i,) for i in (1, 2, 100, 2500, 5000)], "position bigint")
    return I.positional(rows, asked).select("position", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""
WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM part), k AS (SELECT *, n + 1 AS r FROM p WHERE n <= 40)
SELECT p_partkey AS row_key, 'p_name' AS column_name, p_name AS value, 'A' || r AS cell_ref FROM k UNION ALL SELECT p_partkey, 'p_brand', p_brand, 'B' || r FROM k UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR), 'C' || r FROM k
""")
def q06_read_all_limit(spark, sf_dir):
    return I.read_all(S.numbered(t(spark, sf_dir, "part"), "p_partkey"), "p_partkey", ["p_name", "p_brand", "p_size"], max_keys=40)


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS rn FROM region)
SELECT CAST(1 AS BIGINT) AS "row", CAST(1 AS BIGINT) AS col, 'r_regionkey' AS text UNION ALL SELECT 2, 1, 'r_name'
UNION ALL SELECT 1, rn + 1, CAST(r_regionkey AS VARCHAR) FROM r UNION ALL SELECT 2, rn + 1, r_name FROM r
""")
def q07_transpose_view(spark, sf_dir):
    from tessella.functions.cells import cell_text

    turned = S.transposed(S.grid_of(t(spark, sf_dir, "region"), "r_regionkey", "region"))
    return S.long_cells(turned).select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), cell_text(F.col("cell")).alias("text"))


def _messy(spark, sf_dir) -> DataFrame:
    """A sheet with two title rows, a gap, the nation table set in by two columns, and a stray cell below."""
    nation = S.with_row_number(t(spark, sf_dir, "nation"), ["n_nationkey"], first=5)
    cell = lambda c, k: S.cell(c, k)
    none = S.cell(F.lit(None).cast("string"), "str")
    row = lambda r, *cells: spark.range(1).select(F.lit("messy").alias("sheet"), F.lit(r).alias("row"), F.array(*cells).alias("cells"))
    text = lambda s: cell(F.lit(s), "str")
    data = nation.select(F.lit("messy").alias("sheet"), F.col("row").cast("int").alias("row"), F.array(none, none, cell(F.col("n_nationkey"), "int"), cell(F.col("n_name"), "str"), cell(F.col("n_regionkey"), "int")).alias("cells"))
    last = t(spark, sf_dir, "nation").count() + 5
    out = row(1, none, none, text("Report")).union(row(3, none, none, text("All nations"))).union(row(4, none, none, text("Key"), text("Name"), text("Region"))).union(data)
    return out.union(row(last + 1, none, none, none, none, none, none, text("stray")))


@query("""
SELECT CAST(r AS BIGINT) AS "row", CAST(n AS BIGINT) AS n, banner, candidate FROM (VALUES (1, 1, true, false), (2, 0, false, false), (3, 1, true, false), (4, 3, false, true)) v(r, n, banner, candidate)
UNION ALL SELECT 4 + row_number() OVER (ORDER BY n_nationkey), 3, false, true FROM nation UNION ALL SELECT count(*) + 5, 0, false, false FROM nation UNION ALL SELECT count(*) + 6, 1, false, false FROM nation
""")
def q08_header_candidates(spark, sf_dir):
    return D.row_profile(_messy(spark, sf_dir)).select(F.col("row").cast("bigint"), F.col("n").cast("bigint"), "banner", "candidate")


@query("SELECT 'messy' AS sheet, CAST(4 AS BIGINT) AS header_row, CAST(1 AS BIGINT) AS span, 'C3:E' || (count(*) + 4) AS region, false AS ambiguous FROM nation")
def q09_detect_region(spark, sf_dir):
    return D.region_text(D.detect_tables(_messy(spark, sf_dir))).select("sheet", F.col("header_row").cast("bigint"), F.col("span").cast("bigint"), "region", "ambiguous")


@query("""
SELECT r_name AS sheet, CAST(c AS BIGINT) AS col, n AS name FROM region, (VALUES (1, 'Nation'), (2, 'Key'), (3, 'Total')) v(c, n)
""")
def q10_two_row_header(spark, sf_dir):
    region, nation = t(spark, sf_dir, "region"), t(spark, sf_dir, "nation")
    text = lambda s: S.cell(s if not isinstance(s, str) else F.lit(s), "str")
    none = S.cell(F.lit(None).cast("string"), "str")
    top = region.select(F.col("r_name").alias("sheet"), F.lit(1).alias("row"), F.array(none, text(F.col("r_name")), text("Total")).alias("cells"))
    leaf = region.select(F.col("r_name").alias("sheet"), F.lit(2).alias("row"), F.array(text("Nation"), text("Key"), none).alias("cells"))
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    body = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("sheet"), (F.row_number().over(w) + 2).cast("int").alias("row"), F.array(text(F.col("n_name")), S.cell(F.col("n_nationkey"), "int"), S.cell(F.col("n_nationkey") * 2, "int")).alias("cells")
    )
    grid = top.union(leaf).union(body)
    return D.column_names(grid, D.detect_tables(grid)).select("sheet", F.col("col").cast("bigint"), "name")


KINDS = "CASE WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'date' WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'BOOLEAN' THEN 'boolean' ELSE 'number' END"


@query(" UNION ALL ".join(f"SELECT '{name}' AS sheet, row_number() OVER () AS col, {KINDS} AS dtype FROM (DESCRIBE {name})" for name in ("orders", "part", "events")))
def q11_dtype_infer(spark, sf_dir):
    keys = {"orders": "o_orderkey", "part": "p_partkey", "events": "event_id"}
    grid = functools.reduce(DataFrame.unionByName, (S.grid_of(t(spark, sf_dir, name), key, name) for name, key in keys.items()))
    return D.infer_dtypes(grid, D.detect_tables(grid)).select("sheet", F.col("col").cast("bigint"), "dtype")


@query(r"""
WITH v AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN '1,' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') WHEN 2 THEN CAST(p_partkey AS VARCHAR) || '_000' WHEN 3 THEN CAST(p_partkey AS VARCHAR) || 'd' ELSE ' 1e3 ' END AS s FROM part)
SELECT k, k % 5 IN (0, 2, 4) AS inferred, k % 5 <> 3 AS conforming, CAST(CASE k % 5 WHEN 0 THEN k WHEN 2 THEN k * 1000 WHEN 4 THEN 1000 END AS DOUBLE) AS value FROM v
""")
def q12_dtype_text_numbers(spark, sf_dir):
    k = F.col("p_partkey")
    s = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 5 == 2, F.concat(k.cast("string"), F.lit("_000"))).when(k % 5 == 3, F.concat(k.cast("string"), F.lit("d"))).otherwise(" 1e3 ")
    return t(spark, sf_dir, "part").select(k.alias("k"), s.alias("s")).select(
        "k", number_text(F.col("s")).alias("inferred"), conforms(S.cell(F.col("s"), "str"), F.lit("number")).alias("conforming"), text_number(F.col("s")).alias("value")
    )


@query("""
WITH n AS (SELECT 'lineitem' AS table_id, count(*) AS r, 11 AS c FROM lineitem UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'nation', count(*), 3 FROM nation UNION ALL SELECT 'wide', 10, 100),
p AS (SELECT table_id, CASE WHEN r / 5000.0 >= c / 40.0 THEN 'row' ELSE 'col' END AS axis, CASE WHEN r / 5000.0 >= c / 40.0 THEN r ELSE c END AS n, greatest(1, least(4, CAST(ceil(greatest(r / 5000.0, c / 40.0)) AS INTEGER))) AS k FROM n),
s AS (SELECT *, CAST(ceil(n / CAST(k AS DOUBLE)) AS BIGINT) AS step FROM p)
SELECT table_id, axis, CAST(k AS BIGINT) AS k, CAST(b AS BIGINT) AS band, CAST(b * step + 1 AS BIGINT) AS low, CAST(least((b + 1) * step, n) AS BIGINT) AS high FROM s, generate_series(0, 3) g(b) WHERE b < k AND b * step < n
""")
def q13_plan_bands(spark, sf_dir):
    sizes = None
    for name, cols in (("lineitem", 11), ("orders", 6), ("nation", 3)):
        one = t(spark, sf_dir, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_id"), "n_rows", F.lit(cols).alias("n_cols"))
        sizes = one if sizes is None else sizes.union(one)
    sizes = sizes.union(spark.range(1).select(F.lit("wide"), F.lit(10).cast("bigint"), F.lit(100)))
    return S.plan_bands(sizes).select("table_id", "axis", F.col("k").cast("bigint"), F.col("band").cast("bigint"), F.col("low").cast("bigint"), F.col("high").cast("bigint"))


@query("""
SELECT CAST(b AS BIGINT) AS band, 'value' AS name, 'dtype-mismatch' AS problem FROM (SELECT DISTINCT event_id % 4 AS b FROM events) WHERE b IN (2)
UNION ALL SELECT b, 'extra', 'extra-column' FROM (SELECT DISTINCT event_id % 4 AS b FROM events) WHERE b = 3
""")
def q14_band_conflicts(spark, sf_dir):
    bands = t(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("band")).distinct()
    drift = F.when(F.col("band") == 2, "string").otherwise("number")
    value = bands.select("band", F.lit("value").alias("name"), drift.alias("dtype"))
    extra = bands.where("band = 3").select("band", F.lit("extra").alias("name"), F.lit("number").alias("dtype"))
    return G.band_conflicts(value.unionByName(extra)).select(F.col("band").cast("bigint"), "name", "problem")


@query("""
WITH o AS (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS r FROM orders), l AS (SELECT o_custkey AS key, lag(r) OVER (PARTITION BY o_custkey ORDER BY r) AS s, r FROM o)
SELECT key, CAST(s AS BIGINT) AS shadowed_row, CAST(r AS BIGINT) AS winning_row FROM l WHERE s IS NOT NULL
""")
def q15_key_collisions(spark, sf_dir):
    return I.collisions(S.numbered(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), "o_custkey")


@query("""
SELECT CAST(r AS BIGINT) AS "row" FROM (SELECT l.doc_id AS k, row_number() OVER (ORDER BY d.doc_id) + 1 AS r FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE k IS NULL
""")
def q16_blank_keys(spark, sf_dir):
    docs, labels = t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"))
    rows = S.numbered(docs.join(labels, F.col("doc_id") == F.col("label_id"), "left"), "doc_id")
    return I.blank_keys(rows, ["label_id"])


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) + 1 AS r FROM orders)
SELECT o_custkey AS key, CAST(max(r) AS BIGINT) AS last, CAST(min(r) AS BIGINT) AS "first", arg_max(o_totalprice, r) AS value FROM o GROUP BY o_custkey
""")
def q17_last_wins_index(spark, sf_dir):
    rows = S.numbered(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    wins = I.key_map(rows, "o_custkey").join(rows.select(F.col("row").alias("last"), F.col("o_totalprice").alias("value")), "last")
    return wins.select("key", "last", "first", "value")


@query("""
WITH n AS (SELECT count(*) AS n FROM lineitem), p AS (SELECT DISTINCT CAST(round_even(j * (n - 1.0) / 299, 0) AS BIGINT) AS i FROM n, generate_series(0, 299) g(j)),
l AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem)
SELECT l.i, l_orderkey, l_linenumber FROM l JOIN p ON p.i = l.i
""")
def q18_stride_sample(spark, sf_dir):
    rows = S.with_row_number(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], name="i", first=0)
    return S.stride_sample(rows, 300).select("i", "l_orderkey", "l_linenumber")


@query("""
WITH v AS (SELECT event_type AS column_name, CASE WHEN event_id % 3 = 0 AND event_type <> 'click' THEN 'pending' ELSE CAST(CAST(value AS INTEGER) AS VARCHAR) END AS s FROM events)
SELECT column_name, count(*) AS total, count(*) FILTER (try_cast(s AS DOUBLE) IS NULL) AS bad FROM v GROUP BY column_name HAVING count(*) >= 5 AND count(*) FILTER (try_cast(s AS DOUBLE) IS NULL) > 0.2 * count(*)
""")
def q19_dtype_conformance(spark, sf_dir):
    s = F.when((F.col("event_id") % 3 == 0) & (F.col("event_type") != "click"), "pending").otherwise(F.col("value").cast("int").cast("string"))
    values = t(spark, sf_dir, "events").select(F.col("event_type").alias("column_name"), s.alias("s"))
    return G.dtype_conformance(values, conforms(S.cell(F.col("s"), "str"), F.lit("number")))


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS r FROM orders)
SELECT o_orderkey AS key, CAST(r AS BIGINT) AS "row", CAST(CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey END AS DOUBLE) AS live_key FROM o WHERE o_orderkey > 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0)
""")
def q20_row_integrity(spark, sf_dir):
    rows = S.numbered(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    k = F.col("o_orderkey")
    live = rows.select("row", F.when(k % 11 == 0, -k).when(k % 13 != 0, k).alias("live_key"))
    return G.row_integrity(rows.select(k.alias("key"), "row"), live).select("key", "row", F.col("live_key").cast("double"))


@query("""
SELECT p_partkey AS row_key, 'p_retailprice' AS column_name, p_retailprice AS want, CASE WHEN p_partkey % 17 = 0 THEN p_retailprice + 1 END AS have FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 19 = 0
""")
def q21_round_trip(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    k, v = F.col("p_partkey"), F.col("p_retailprice")
    live = part.select(k.alias("row_key"), F.lit("p_retailprice").alias("column_name"), v.alias("value"))
    asked = part.where(k % 19 != 0).select(k.alias("row_key"), F.lit("p_retailprice").alias("column_name"), F.when(k % 17 == 0, v + 1).otherwise(v).alias("value"))
    extra = part.where((k % 19 == 0) & (k % 17 == 0)).select(k.alias("row_key"), F.lit("p_retailprice").alias("column_name"), (v + 1).alias("value"))
    return G.round_trip(live, asked.union(extra))


@query("""
WITH live AS (SELECT column_name AS name, ordinal_position AS col FROM (VALUES ('p_partkey', 1), ('p_name', 2), ('p_brand', 3), ('p_type', 4), ('p_size', 5), ('p_retailprice', 6)) v(column_name, ordinal_position)),
declared AS (SELECT * FROM (VALUES ('p_partkey', 1), ('p_brand', 2), ('p_name', 3), ('p_weight', 7)) v(name, col))
SELECT name, 'column-name' AS "check" FROM declared WHERE name NOT IN (SELECT name FROM live) UNION ALL SELECT name, 'column-coverage' FROM live WHERE name NOT IN (SELECT name FROM declared)
UNION ALL SELECT d.name, 'column-integrity' FROM declared d JOIN live l ON l.name = d.name WHERE d.col <> l.col
""")
def q22_header_coverage(spark, sf_dir):
    live = spark.createDataFrame([(c, i) for i, c in enumerate(t(spark, sf_dir, "part").columns, 1)], "name string, col int")
    declared = spark.createDataFrame([("p_partkey", 1), ("p_brand", 2), ("p_name", 3), ("p_weight", 7)], "name string, col int")
    return G.header_differences(declared, live)


#: Events as cells: blocks of ten rows, two blank rows between them, a scatter of columns.
SPARSE = "SELECT DISTINCT 'events' AS sheet, CAST(event_id // 70 * 12 + event_id % 70 // 7 + 1 AS INTEGER) AS \"row\", CAST((event_id * 37 + user_id * 11) % 41 + 1 AS INTEGER) AS col FROM events"
AREAS = (("a", 2, 2, 20, 15), ("b", 10, 10, 40, 30), ("c", 100, 5, 1_000_000, 20))
INSIDE = " OR ".join(f'("row" BETWEEN {r0} AND {r1} AND col BETWEEN {c0} AND {c1})' for _, r0, c0, r1, c1 in AREAS)


def _sparse(spark, sf_dir) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    row = F.floor(k / 70) * 12 + F.floor((k % 70) / 7) + 1
    return t(spark, sf_dir, "events").select(F.lit("events").alias("sheet"), row.cast("int").alias("row"), ((k * 37 + u * 11) % 41 + 1).cast("int").alias("col")).distinct()


def _regions(spark) -> DataFrame:
    return spark.createDataFrame([(n, "events", *box) for n, *box in AREAS], "region_id string, sheet string, min_row int, min_col int, max_row int, max_col int")


@query(f"""
WITH c AS ({SPARSE}), h AS (SELECT *, ({INSIDE}) AS hit FROM c)
SELECT sheet, count(*) AS total, count(*) FILTER (hit) AS covered, count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS share FROM h GROUP BY sheet
""")
def q23_coverage_score(spark, sf_dir):
    return C.coverage(_sparse(spark, sf_dir), _regions(spark))


@query(f"""
WITH c AS ({SPARSE}) SELECT * FROM c WHERE NOT ({INSIDE})
""")
def q24_uncovered_cells(spark, sf_dir):
    return C.uncovered(_sparse(spark, sf_dir), _regions(spark))


@query(f"""
WITH RECURSIVE c AS (SELECT "row" AS r, col AS k, ("row" - 1) // 12 AS b FROM ({SPARSE})),
reach AS (SELECT r, k, b, r AS sr, k AS sk FROM c UNION SELECT c.r, c.k, c.b, reach.sr, reach.sk FROM reach JOIN c ON c.b = reach.b AND abs(c.r - reach.r) <= 1 AND abs(c.k - reach.k) <= 1),
lab AS (SELECT r, k, min(sr * 100 + sk) AS label FROM reach GROUP BY r, k)
SELECT CAST(min(r) AS BIGINT) AS min_row, CAST(min(k) AS BIGINT) AS min_col, CAST(max(r) AS BIGINT) AS max_row, CAST(max(k) AS BIGINT) AS max_col, count(*) AS n FROM lab GROUP BY label
""")
def q25_components(spark, sf_dir):
    return C.pieces(_sparse(spark, sf_dir)).select(*(F.col(c).cast("bigint") for c in ("min_row", "min_col", "max_row", "max_col", "n")))


@query(f"""
WITH c AS ({SPARSE}), g AS (SELECT * FROM (VALUES {", ".join(str(a) for a in AREAS)}) v(region_id, r0, c0, r1, c1))
SELECT region_id, CAST(r1 - r0 - 1 - (SELECT count(DISTINCT "row") FROM c WHERE "row" > r0 AND "row" < r1 AND col BETWEEN c0 AND c1) AS BIGINT) AS blank_rows,
CAST(c1 - c0 - 1 - (SELECT count(DISTINCT col) FROM c WHERE col > c0 AND col < c1 AND "row" BETWEEN r0 AND r1) AS BIGINT) AS blank_cols FROM g
""")
def q26_interior_gaps(spark, sf_dir):
    return C.interior_gaps(_sparse(spark, sf_dir), _regions(spark)).select("region_id", F.col("blank_rows").cast("bigint"), F.col("blank_cols").cast("bigint"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def q28_formula_row(spark, sf_dir):
    charge = compile_expression("price * (1 - discount) * (1 + tax)", {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax")})
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", charge.alias("charge"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN o_totalprice * 0.9 ELSE o_totalprice + 5 END AS due FROM orders")
def q29_formula_if_cmp(spark, sf_dir):
    due = compile_expression("IF(total >= limit, total * 0.9, total + 5)", {"total": F.col("o_totalprice"), "limit": F.lit(100000.0)})
    return t(spark, sf_dir, "orders").select("o_orderkey", due.alias("due"))


@query("""
SELECT l_orderkey, sum(l_quantity) AS total, avg(l_quantity) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_orderkey
""")
def q30_formula_aggs(spark, sf_dir):
    made = {n: range_total(f, F.col("l_quantity")) for n, f in (("total", "SUM"), ("mean", "AVG"), ("low", "MIN"), ("high", "MAX"), ("n", "COUNT"))}
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(c.alias(n) for n, c in made.items()))


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS want, false AS failed FROM lineitem WHERE l_orderkey % 23 = 0
""")
def q31_computed_mismatch(spark, sf_dir):
    formula = compile_expression("price * (1 - discount)", {"price": F.col("l_extendedprice"), "discount": F.col("l_discount")})
    stored = F.when(F.col("l_orderkey") % 23 == 0, formula + 1).otherwise(formula)
    return G.computed_mismatch(t(spark, sf_dir, "lineitem").withColumn("net", stored), "net", formula).select("l_orderkey", "l_linenumber", "want", "failed")


@query("""
SELECT l_orderkey, l_linenumber, floor((l_quantity - 25) / 4) AS quarter, round_even(l_quantity / 4, 0) AS half_even, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity / (l_linenumber - 1) END AS ratio FROM lineitem
""")
def q32_formula_floor_round(spark, sf_dir):
    o = {"q": F.col("l_quantity"), "n": F.col("l_linenumber").cast("double")}
    return t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", compile_expression("(q - 25) // 4", o).alias("quarter"), compile_expression("ROUND(q / 4)", o).alias("half_even"), compile_expression("q / (n - 1)", o).alias("ratio")
    )


@query(r"""
SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(p_name || 'NetGDPGrowth', '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), '|') AS tokens FROM part
""")
def q33_tokenise(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(X.tokens(F.concat("p_name", F.lit("NetGDPGrowth"))), "|").alias("tokens"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS squashed FROM customer")
def q34_squash(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", X.squash(F.col("c_name")).alias("squashed"))


PHRASES = ("show revenue of asia", "EUROPE", "middle-east totals", "america's share", "afr", "nothing here", "MIDDLE EAST and asia")


@query(r"""
WITH p AS (SELECT * FROM (VALUES (0, 'show revenue of asia'), (1, 'europe'), (2, 'middle-east totals'), (3, 'america''s share'), (4, 'afr'), (5, 'nothing here'), (6, 'middle east and asia')) v(pid, phrase)),
x AS (SELECT pid, phrase, r_name, list_filter(string_split_regex(phrase, '[^a-z0-9]+'), lambda x: x <> '') AS w, list_filter(string_split_regex(lower(r_name), '[^a-z0-9]+'), lambda x: x <> '') AS t, regexp_replace(lower(r_name), '[^a-z0-9]+', '', 'g') AS s FROM p, region)
SELECT CAST(pid AS BIGINT) AS pid, r_name, CAST(CASE WHEN regexp_matches(phrase, '(^|[^a-z0-9])' || lower(r_name) || '($|[^a-z0-9])') THEN 3 WHEN list_has_all(w, t) OR list_contains(w, s) THEN 2
WHEN len(s) >= 3 AND len(list_filter(w, lambda x: len(x) >= 3 AND (starts_with(x, s) OR starts_with(s, x)))) > 0 THEN 1 ELSE 0 END AS BIGINT) AS tier FROM x
""")
def q35_match_tier(spark, sf_dir):
    phrases = spark.createDataFrame(list(enumerate(PHRASES)), "pid bigint, phrase string").select("pid", F.lower("phrase").alias("pl"), X.token_set(F.col("phrase")).alias("w"))
    both = phrases.join(t(spark, sf_dir, "region").select("r_name"), F.lit(True))
    return both.select("pid", "r_name", X.match_tier(F.col("r_name"), F.col("pl"), F.col("w")).cast("bigint").alias("tier"))


def _catalog(spark, sf_dir):
    """Two small tables by region and by market segment, as a catalog with values."""
    nation, region, customer = (t(spark, sf_dir, n) for n in ("nation", "region", "customer"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))

    def summary(table_id: str, key: str) -> DataFrame:
        s = joined.groupBy(F.col(key).alias("row_key")).agg(F.count("*").cast("double").alias("customers"), F.max("c_acctbal").alias("top balance"))
        return s.select(F.lit(table_id).alias("table_id"), "row_key", F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in ("customers", "top balance")))))

    values = summary("region", "r_name").union(summary("segment", "c_mktsegment"))
    columns = spark.createDataFrame([("region", 0, 0, "customers"), ("region", 0, 1, "top balance"), ("segment", 1, 0, "customers"), ("segment", 1, 1, "top balance")], "table_id string, tpos int, cpos int, column_name string")
    keys = values.select("table_id", "row_key").distinct()
    rows = keys.select("table_id", F.when(F.col("table_id") == "region", 0).otherwise(1).alias("tpos"), F.row_number().over(Window.partitionBy("table_id").orderBy("row_key")).alias("rpos"), "row_key")
    return columns, rows, values


ASKED = (
    "How many customers are in ASIA?", "top balance for Europe", "customers BUILDING", "top_balance middle east", "what is the top balance of machinery", "customers of atlantis", "customersAmerica", "top balance",
)
RESOLVED = """
WITH a AS (SELECT * FROM (VALUES (0, 'region', 'ASIA', 'customers'), (1, 'region', 'EUROPE', 'top balance'), (2, 'segment', 'BUILDING', 'customers'), (3, 'region', 'MIDDLE EAST', 'top balance'), (4, 'segment', 'MACHINERY', 'top balance'), (6, 'region', 'AMERICA', 'customers')) v(pid, table_id, row_key, column_name)),
j AS (SELECT c.*, r_name FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT 'region' AS table_id, r_name AS row_key, CAST(count(*) AS DOUBLE) AS n, max(c_acctbal) AS m FROM j GROUP BY r_name UNION ALL SELECT 'segment', c_mktsegment, count(*), max(c_acctbal) FROM j GROUP BY c_mktsegment)
"""


@query(RESOLVED + "SELECT CAST(pid AS BIGINT) AS pid, a.table_id, a.row_key, column_name FROM a JOIN s ON s.table_id = a.table_id AND s.row_key = a.row_key")
def q36_resolve(spark, sf_dir):
    columns, rows, _ = _catalog(spark, sf_dir)
    return R.resolve(spark.createDataFrame(list(enumerate(ASKED)), "pid bigint, phrase string"), columns, rows)


@query(RESOLVED + "SELECT CAST(g.i AS BIGINT) AS pid, CASE WHEN column_name = 'customers' THEN n ELSE m END AS value FROM generate_series(0, 7) g(i) LEFT JOIN a ON a.pid = g.i LEFT JOIN s ON s.table_id = a.table_id AND s.row_key = a.row_key")
def q37_semantic_answer(spark, sf_dir):
    columns, rows, values = _catalog(spark, sf_dir)
    return R.answers(spark.createDataFrame(list(enumerate(ASKED)), "pid bigint, phrase string"), columns, rows, values)


@query("""
WITH j AS (SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT 'share' AS formula, max(n) FILTER (r_name = 'ASIA') / CAST(max(n) FILTER (r_name = 'ASIA') + max(n) FILTER (r_name = 'EUROPE') AS DOUBLE) AS value FROM j UNION ALL SELECT 'broken', NULL
""")
def q38_formula_by_phrase(spark, sf_dir):
    columns, rows, values = _catalog(spark, sf_dir)
    asked = spark.createDataFrame([(0, "share", "a", "customers asia"), (1, "share", "b", "customers europe"), (2, "broken", "a", "customers asia"), (3, "broken", "b", "customers nowhere")], "pid bigint, formula string, name string, phrase string")
    return K.formulas_by_phrase(asked, R.answers(asked, columns, rows, values), {"share": "a / (a + b)", "broken": "a / (a + b)"})


@query(RESOLVED + "SELECT table_id, row_key, 'customers' AS column_name, n AS value FROM s UNION ALL SELECT table_id, row_key, 'top balance', m FROM s")
def q39_measures(spark, sf_dir):
    _, _, values = _catalog(spark, sf_dir)
    return values.join(K.small_tables(values), "table_id", "left_semi").where("value is not null").select("table_id", "row_key", "column_name", "value")


@query("SELECT array_to_string(list(s_name ORDER BY s_suppkey)[1:60], '|') AS row_keys, count(*) > 60 AS truncated FROM supplier")
def q40_catalog_capped(spark, sf_dir):
    keys = t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("table_id"), F.col("s_suppkey").alias("rpos"), F.col("s_name").alias("row_key"))
    return K.capped_keys(keys).select(F.array_join("row_keys", "|").alias("row_keys"), F.col("row_keys_truncated").alias("truncated"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_partkey % 9 AS r, p_partkey % 5 AS c FROM part), b AS (SELECT id, greatest(least(r + 4, 8) - greatest(r, 3) + 1, 0) * greatest(least(c + 3, 6) - greatest(c, 2) + 1, 0) AS i FROM p)
SELECT id, i / CAST(20 + 30 - i AS DOUBLE) AS iou FROM b
""")
def q41_iou_match(spark, sf_dir):
    k = F.col("p_partkey")
    boxes = t(spark, sf_dir, "part").select(
        k.alias("id"), (k % 9).alias("a_min_row"), (k % 9 + 4).alias("a_max_row"), (k % 5).alias("a_min_col"), (k % 5 + 3).alias("a_max_col"), F.lit(3).alias("b_min_row"), F.lit(8).alias("b_max_row"), F.lit(2).alias("b_min_col"), F.lit(6).alias("b_max_col")
    )
    return boxes.select("id", C.rectangle_iou("a_", "b_").alias("iou"))


def _scored(spark, sf_dir) -> DataFrame:
    customer = t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    labels = customer.select(k.alias("sample_id"), F.col("c_mktsegment").alias("tier"), F.col("c_acctbal").alias("expected"))
    answers = customer.where(k % 10 != 3).select(k.alias("sample_id"), F.when(k % 10 == 5, F.col("c_acctbal") + 10).otherwise(F.col("c_acctbal")).alias("value"))
    return E.score_samples(labels, answers)


@query("SELECT c_custkey AS sample_id, c_custkey % 10 NOT IN (3, 5) AS passed FROM customer")
def q42_score_samples(spark, sf_dir):
    return _scored(spark, sf_dir).select("sample_id", "passed")


@query("""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (n_nationkey % 5 = 0) AS gone, count(*) FILTER (n_nationkey % 5 = 1) AS off, count(*) FILTER (n_nationkey % 5 = 2) AS twice FROM nation),
c AS (SELECT n - gone - off AS tp, off + twice AS fp, gone + off AS fn FROM n)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, tp / CAST(tp + fp AS DOUBLE) AS "precision", tp / CAST(tp + fn AS DOUBLE) AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM c
""")
def q43_measure_prf(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    labelled = nation.select(F.col("n_name").alias("name"), k.cast("double").alias("value"))
    found = nation.where(k % 5 != 0).select(F.col("n_name").alias("name"), F.when(k % 5 == 1, k + 100).otherwise(k).cast("double").alias("value"))
    twice = nation.where(k % 5 == 2).select(F.col("n_name").alias("name"), k.cast("double").alias("value"))
    return E.precision_recall(E.score_measures(labelled, found.union(twice), ["name"])).select("tp", "fp", "fn", "precision", "recall", F.col("f1").cast("double"))


@query("""
SELECT c_mktsegment AS tier, count(*) AS n, count(*) FILTER (c_custkey % 10 NOT IN (3, 5)) AS n_passed, avg(CASE WHEN c_custkey % 10 NOT IN (3, 5) THEN 1.0 ELSE 0.0 END) AS rate FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())
""")
def q44_scorecard_grouping_sets(spark, sf_dir):
    return E.score_card(_scored(spark, sf_dir), "tier")


LEDGER = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _ledger(spark, sf_dir) -> DataFrame:
    line = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    place = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return line.join(orders.join(customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))


@query(f"""
SELECT r_name AS region, strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment AS segment, round(sum(l_extendedprice), 2) AS amount, sum(l_quantity) AS quantity, count(*) AS n {LEDGER} GROUP BY GROUPING SETS ((r_name), (strftime(o_orderdate, '%Y-%m')), (c_mktsegment))
""")
def q45_ledger_totals(spark, sf_dir):
    rows = _ledger(spark, sf_dir).select(F.col("r_name").alias("region"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("c_mktsegment").alias("segment"), "l_extendedprice", "l_quantity")
    keys = [F.col(c) for c in ("region", "month", "segment")]
    return rows.groupingSets([[k] for k in keys], *keys).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"), F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("""
SELECT coalesce(c_mktsegment, 'Total') AS segment, round(sum(o_totalprice) FILTER (q = 1), 2) AS q1, round(sum(o_totalprice) FILTER (q = 2), 2) AS q2, round(sum(o_totalprice) FILTER (q = 3), 2) AS q3, round(sum(o_totalprice) FILTER (q = 4), 2) AS q4, round(sum(o_totalprice), 2) AS total
FROM (SELECT c_mktsegment, o_totalprice, quarter(o_orderdate) AS q FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ROLLUP (c_mktsegment)
""")
def q46_totals_row_col(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", F.col("o_totalprice").alias("v"), F.quarter("o_orderdate").alias("q"))
    quarters = [F.round(F.sum(F.when(F.col("q") == i, F.col("v"))), 2).alias(f"q{i}") for i in range(1, 5)]
    return rows.rollup("c_mktsegment").agg(*quarters, F.round(F.sum("v"), 2).alias("total")).withColumn("segment", F.coalesce("c_mktsegment", F.lit("Total"))).drop("c_mktsegment")


@query(f"""
SELECT r_name AS region, round(sum(l_extendedprice), 2) AS amount, round(sum(l_extendedprice), 2) + 5 AS declared {LEDGER} WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY r_name
""")
def q47_reconcile_summary(spark, sf_dir):
    live = _ledger(spark, sf_dir).groupBy(F.col("r_name").alias("region")).agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    declared = live.select("region", F.lit("amount").alias("measure"), F.when(F.col("region").isin("ASIA", "EUROPE"), F.col("amount") + 5).otherwise(F.col("amount")).alias("declared"))
    return V.reconcile(live, ["region"], {"amount": "amount"}, declared, most=0.005).select("region", F.col("live").alias("amount"), "declared")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (1, 777, 1500)")
def q48_needle_rows(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").where(F.col("l_orderkey").isin(1, 777, 1500)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN -floor(o_totalprice) ELSE floor(o_totalprice) END AS DOUBLE) AS value FROM orders")
def q49_parse_raw(spark, sf_dir):
    k, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    raw = F.when(k % 4 == 0, X.format_raw(v, thousands=True, footnote="a")).when(k % 4 == 1, X.format_raw(-v, parens=True)).when(k % 4 == 2, v.cast("string")).otherwise("n/a")
    return t(spark, sf_dir, "orders").select("o_orderkey", X.parse_raw(raw)["number"].alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' (a)' ELSE '(' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ')' END AS raw FROM orders")
def q50_format_raw(spark, sf_dir):
    v = F.floor("o_totalprice").cast("bigint")
    return t(spark, sf_dir, "orders").select("o_orderkey", X.format_raw(F.when(F.col("o_orderkey") % 2 == 0, v).otherwise(-v), thousands=True, parens=True, footnote="a").alias("raw"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN props END AS found FROM events")
def q51_extract_json(spark, sf_dir):
    k, p = F.col("event_id"), F.col("props")
    fenced, prose = F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone.")), F.concat(F.lit("The answer is "), p, F.lit(" as asked."))
    said = F.when(k % 5 == 0, p).when(k % 5 == 1, fenced).when(k % 5 == 2, prose).when(k % 5 == 3, F.concat(F.lit("Not {this} but "), p, F.lit(' and {"later": 1} or }{'))).otherwise("no {answer")
    return t(spark, sf_dir, "events").select("event_id", X.extract_json(said).alias("found"))


#: Messages as the gate writes them, and the categories that they must have.
MESSAGES = (
    ("coverage gap: column x", "coverage-gap"), ("column-name: x", "column-name"), ("column-integrity: x", "column-integrity"), ("column-coverage: x", "column-coverage"), ("row-integrity: x", "row-integrity"), ("row-key collision: x", "row-key-collision"),
    ("blank row key: x", "blank-row-key"), ("empty index: x", "empty-index"), ("round-trip: x", "round-trip"), ("dtype-mismatch: x", "dtype-mismatch"), ("computed mismatch x", "computed"), ("dtype mismatch x", "other"), ("anything else", "other"),
)


@query(f"""
WITH m AS (SELECT * FROM (VALUES {", ".join(str((i, c)) for i, (_, c) in enumerate(MESSAGES))}) v(i, c)) SELECT c AS category, count(*) AS n FROM lineitem JOIN m ON i = l_orderkey % {len(MESSAGES)} GROUP BY c
""")
def q52_finding_categories(spark, sf_dir):
    message = F.element_at(F.array(*(F.lit(m) for m, _ in MESSAGES)), (F.col("l_orderkey") % len(MESSAGES) + 1).cast("int"))
    return t(spark, sf_dir, "lineitem").select(X.category(message).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def _candidates(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, sf_dir, "part").select((k % 20).alias("sheet"), (k % 7).alias("signature"), (k * 13 % 10 / 10).alias("coverage"), (k * 7 % 4).alias("errors"), (k * 5 % 3).alias("gaps"), (k * 11 % 10 / 10).alias("confidence"), k.alias("pos"))


CANDIDATES = """
WITH c AS (SELECT p_partkey % 20 AS sheet, p_partkey % 7 AS signature, p_partkey * 13 % 10 / 10.0 AS coverage, p_partkey * 7 % 4 AS errors, p_partkey * 5 % 3 AS gaps, p_partkey * 11 % 10 / 10.0 AS confidence, p_partkey AS pos FROM part),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sheet, signature ORDER BY confidence DESC, pos) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY coverage DESC, errors, gaps, confidence DESC, pos) AS rank FROM d)
"""


@query(CANDIDATES + "SELECT sheet, pos, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 3")
def q53_candidate_rank(spark, sf_dir):
    return L.rank_candidates(_candidates(spark, sf_dir)).where("rank <= 3").select("sheet", "pos", F.col("rank").cast("bigint"))


@query(CANDIDATES + """, p AS (SELECT *, lead(coverage) OVER w AS c2, lead(errors) OVER w AS e2, lead(gaps) OVER w AS g2 FROM r WINDOW w AS (PARTITION BY sheet ORDER BY rank))
SELECT sheet, pos, coalesce(coverage >= c2 AND errors <= e2 AND gaps <= g2, true) AS dominant FROM p WHERE rank = 1""")
def q53b_dominance(spark, sf_dir):
    return L.dominated(L.rank_candidates(_candidates(spark, sf_dir)))


@query("""
WITH c AS (SELECT s_suppkey % 15 AS table_id, s_suppkey * 7 % 5 AS errors, s_suppkey * 3 % 4 AS labels, s_suppkey AS pos FROM supplier)
SELECT table_id, errors, labels, pos FROM c QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY errors, labels DESC, pos) = 1
""")
def q54_repair_rank(spark, sf_dir):
    k = F.col("s_suppkey")
    return L.best_repair(t(spark, sf_dir, "supplier").select((k % 15).alias("table_id"), (k * 7 % 5).alias("errors"), (k * 3 % 4).alias("labels"), k.alias("pos")))


COLUMN_ROLES = [("p_partkey", "number", "key"), ("p_name", "string", "value"), ("p_size", "string", "value"), ("p_retailprice", "number", "value")]


@query("SELECT * FROM (VALUES ('p_partkey', 'number', 'key'), ('p_name', 'string', 'value'), ('p_size', 'number', 'value'), ('p_retailprice', 'number', 'computed')) v(name, dtype, role)")
def q55_patch_apply(spark, sf_dir):
    columns = spark.createDataFrame(COLUMN_ROLES, "name string, dtype string, role string")
    patches = spark.createDataFrame([("p_size", "number", None), ("p_name", "blob", "value"), ("p_retailprice", None, "computed"), ("nowhere", "date", "key")], "name string, dtype string, role string")
    return L.apply_patches(columns, patches)


@query("SELECT * FROM (VALUES ('p_name', 'value', 'key'), ('p_retailprice', 'value', 'computed')) v(name, role, found_role)")
def q56_role_disagreement(spark, sf_dir):
    declared = spark.createDataFrame([(n, r) for n, _, r in COLUMN_ROLES], "name string, role string")
    found = spark.createDataFrame([("p_partkey", "key"), ("p_name", "key"), ("p_retailprice", "computed")], "name string, role string")
    return L.role_disagreements(declared, found)


@query("""
WITH w AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_name || ' large'), ' ') AS w, string_split(lower(p_name), ' ') AS u FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)) - CASE WHEN list_contains(u, x) THEN 1 ELSE 0 END > 0)), '|') AS rest FROM w
""")
def q57_multiset_residual(spark, sf_dir):
    twice = F.concat_ws(" ", "p_name", "p_name", F.lit("large"))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(X.residual(F.split(F.lower(twice), " "), F.array_distinct(F.split(F.lower("p_name"), " ")))), "|").alias("rest"))


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) + 1 AS r, count(*) OVER () AS n FROM orders)
SELECT 'peek' AS probe, CAST(r AS BIGINT) AS "row", o_orderkey FROM o WHERE r BETWEEN 10 AND 14 UNION ALL SELECT 'tail', r, o_orderkey FROM o WHERE r > n + 1 - 5
""")
def q60_tail_and_column_probes(spark, sf_dir):
    rows = S.numbered(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return B.peek(rows, 10, 5).select(F.lit("peek").alias("probe"), "row", "o_orderkey").union(B.tail(rows, 5).select(F.lit("tail").alias("probe"), "row", "o_orderkey"))


@query(f"""
SELECT r_name AS region, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue {LEDGER} GROUP BY r_name
""")
def q61_wide_view_sql(spark, sf_dir):
    """Tables registered as relations, then plain SQL over them."""
    for name in ("lineitem", "orders", "customer", "nation", "region"):
        I.register(t(spark, sf_dir, name), f"sheet_{name}")
    tables = LEDGER
    for name in ("lineitem", "orders", "customer", "nation", "region"):
        tables = tables.replace(f"FROM {name} ", f"FROM sheet_{name} ").replace(f"JOIN {name} ", f"JOIN sheet_{name} ")
    return spark.sql(f"SELECT r_name AS region, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue {tables} GROUP BY r_name")


@query("""
WITH c AS (SELECT c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS value FROM customer) SELECT c_custkey AS pid, c_name AS row_key, 'account balance' AS column_name, value FROM c
""")
def q36b_resolve_batch(spark, sf_dir):
    """A phrase for every customer, resolved among all customers in one set of jobs: a few thousand phrases and as many row keys."""
    customer = t(spark, sf_dir, "customer")
    columns = spark.createDataFrame([("customer", 0, 0, "account balance"), ("customer", 0, 1, "market segment")], "table_id string, tpos int, cpos int, column_name string")
    rows = customer.select(F.lit("customer").alias("table_id"), F.lit(0).alias("tpos"), F.col("c_custkey").alias("rpos"), F.col("c_name").alias("row_key"))
    phrases = customer.select(F.col("c_custkey").alias("pid"), F.concat(F.lit("what is the account balance for "), F.lower("c_name"), F.lit("?")).alias("phrase"))
    values = customer.select("c_name", F.col("c_acctbal").cast("double").alias("value")).withColumnRenamed("c_name", "row_key")
    return R.resolve(phrases, columns, rows).join(values, "row_key").select("pid", "row_key", "column_name", "value")


def _faulty(spark, sf_dir) -> DataFrame:
    """The nation table, twice over, once for each region on a sheet of its own, each with another fault."""
    w = Window.partitionBy("r_regionkey").orderBy("copy", "n_nationkey")
    both = t(spark, sf_dir, "region").crossJoin(t(spark, sf_dir, "nation")).withColumn("copy", F.explode(F.array(F.lit("a"), F.lit("b"))))
    both = both.withColumn("i", F.row_number().over(w)).withColumn("name", F.concat("n_name", F.lit(" "), "copy")).withColumn("first", F.first("name").over(w))
    text, num, none = (lambda c: S.cell(c if not isinstance(c, str) else F.lit(c), "str")), (lambda c: S.cell(c, "int")), S.cell(F.lit(None).cast("string"), "str")
    k = F.col("r_regionkey") % 5
    key = F.when((k == 0) & (F.col("i") == 3), none).when((k == 1) & (F.col("i") == 4), text(F.col("first"))).otherwise(text(F.col("name")))
    size = F.when((k == 2) & (F.col("i") > 30), text("n/a")).otherwise(num(F.col("n_nationkey")))
    body = both.select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("sheet"), (F.col("i") + 1).cast("int").alias("row"), F.array(key, size, num(F.col("n_regionkey"))).alias("cells"))
    region = t(spark, sf_dir, "region").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("sheet"), k.alias("k"))
    n = 2 * t(spark, sf_dir, "nation").count()
    head = region.select("sheet", F.lit(1).alias("row"), F.array(text("Nation"), text("Size"), F.when(F.col("k") == 3, text("Size")).otherwise(text("Region"))).alias("cells"))
    below = region.where("k = 4")
    second = [below.select("sheet", F.lit(n + 3 + i).alias("row"), F.array(a, b).alias("cells")) for i, (a, b) in enumerate(((text("Item"), text("Cost")), (text("x"), num(F.lit(1))), (text("y"), num(F.lit(2)))))]
    return functools.reduce(DataFrame.union, [body, head, *second])


@query("""
WITH s AS (SELECT 's' || r_regionkey AS sheet, r_regionkey % 5 AS k FROM region)
SELECT sheet, CASE k WHEN 0 THEN 'blank-row-key' WHEN 1 THEN 'row-key-collision' WHEN 2 THEN 'dtype-mismatch' WHEN 3 THEN 'column-name' ELSE 'uncovered-data' END AS category, CAST(1 AS BIGINT) AS n FROM s
""")
def q62_gate_findings(spark, sf_dir):
    """A whole extraction: every sheet has one fault, and the gate or the scan finds just that."""
    found = extract(_faulty(spark, sf_dir)).findings.where("severity = 'error'")
    return found.groupBy("sheet", "category").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS i FROM region),
f AS (SELECT 's' || i || 'a' AS sheet, 'empty-header-corner' AS category, 's' || i || 'a!A1' AS ref FROM r UNION ALL SELECT 's' || i || 'a', 'transpose-suspected', 's' || i || 'a!A1:C3' FROM r
UNION ALL SELECT 's' || i || 'b', 'false-header-span', 's' || i || 'b!A1:C4' FROM r UNION ALL SELECT 's' || i || 'c', 'uncovered-data', 's' || i || 'c!A5:B7' FROM r)
SELECT * FROM f
""")
def q27_detection_findings(spark, sf_dir):
    """Three sheets for each region: an empty corner over labels, a row of values taken for a header, a second table below the first."""
    text, num, none = (lambda c: S.cell(c if not isinstance(c, str) else F.lit(c), "str")), (lambda n: S.cell(F.lit(n), "int")), S.cell(F.lit(None).cast("string"), "str")
    regions = S.with_row_number(t(spark, sf_dir, "region"), ["r_regionkey"], "i")
    name = text(F.col("r_name"))
    sheets = {
        "a": [[none, text("Jan"), text("Feb")], [name, num(1), num(2)], [text("Cost"), num(3), num(4)]],
        "b": [[text("Item"), text("Q1"), text("Q2")], [name, text("49"), text("1,200")], [text("x"), num(3), num(4)], [text("y"), num(5), num(6)]],
        "c": [[text("Item"), text("Cost")], [name, num(1)], [text("x"), num(2)], [], [text("Product"), text("Price")], [name, num(9)], [text("z"), num(8)]],
    }
    parts = [regions.select(F.concat(F.lit("s"), F.col("i").cast("string"), F.lit(tag)).alias("sheet"), F.lit(r).alias("row"), F.array(*cells).alias("cells")) for tag, lines in sheets.items() for r, cells in enumerate(lines, 1) if cells]
    found = extract(functools.reduce(DataFrame.union, parts)).findings
    return found.where("source = 'static' and category not like 'orchestration%'").select("sheet", "category", "ref")


@query("""
SELECT 'orders__0' AS table_id, 'A1:F' || (count(*) + 1) AS region, true AS passed, CAST(0 AS BIGINT) AS failures FROM orders UNION ALL SELECT 'part__1', 'A1:F' || (count(*) + 1), true, 0 FROM part
""")
def q63_extract_report(spark, sf_dir):
    """Whole tables as sheets through detection, reading, bands and the gate: tens of thousands of rows, no failure."""
    sheets = {"orders": "o_orderkey", "part": "p_partkey"}
    grid = functools.reduce(DataFrame.unionByName, (S.grid_of(t(spark, sf_dir, n).select(*t(spark, sf_dir, n).columns[:6]), k, n) for n, k in sheets.items()))
    return extract(grid).report().select("table_id", "region", "passed", F.size("failures").cast("bigint").alias("failures"))


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) + 1 AS r FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS row_key, CAST(o_totalprice AS DOUBLE) AS value, 'D' || r AS cell_ref FROM o
""")
def q64_extraction_query(spark, sf_dir):
    """A request for every row of a sheet, answered through the extraction's key index."""
    orders = t(spark, sf_dir, "orders")
    grid = S.grid_of(orders.select(*orders.columns[:6]), "o_orderkey", "orders")
    asked = orders.select(F.lit("orders").alias("sheet"), F.col("o_orderkey").cast("string").alias("row_key"), F.lit("o_totalprice").alias("column_name"))
    return extract(grid).query(asked).select("row_key", F.coalesce(F.col("cell.num"), F.col("cell.int").cast("double")).alias("value"), "cell_ref")


@query("""
WITH l AS (SELECT r_name, n_name, count(*) OVER (PARTITION BY r_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS sheet, 'vertical' AS winner_before, 'blocks' AS winner, CAST(2 AS BIGINT) AS tables, CAST(2 * (max(n) + 1) + 2 * (max(n) + 1) AS BIGINT) AS covered FROM l GROUP BY r_name
""")
def q65_layout_ensemble(spark, sf_dir):
    """Two stacked tables on a sheet for each region: the block lens covers both and wins over the upright one."""
    both = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.withColumn("i", F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey"))).withColumn("n", F.count("*").over(Window.partitionBy("r_name")))
    text, num = (lambda c: S.cell(c if not isinstance(c, str) else F.lit(c), "str")), (lambda c: S.cell(c, "int"))
    parts = []
    for shift in (F.lit(0), F.col("n") + 2):
        parts.append(rows.select(F.col("r_name").alias("sheet"), (F.col("i") + 1 + shift).cast("int").alias("row"), F.array(text(F.col("n_name")), num(F.col("n_nationkey"))).alias("cells")))
        parts.append(rows.where("i = 1").select(F.col("r_name").alias("sheet"), (1 + shift).cast("int").alias("row"), F.array(text("Nation"), text("Key")).alias("cells")))
    done = extract(functools.reduce(DataFrame.union, parts), Config(lenses=("vertical", "blocks")))
    h = done.handles.groupBy("sheet").agg(F.count("*").alias("tables"), F.sum((F.col("max_row") - F.col("min_row") + 1) * (F.col("max_col") - F.col("min_col") + 1)).cast("bigint").alias("covered"))
    return h.select("sheet", F.lit("vertical").alias("winner_before"), F.when(F.col("tables") > 1, "blocks").otherwise("vertical").alias("winner"), "tables", "covered")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber = 1 AS used, l_orderkey * 10 + l_linenumber AS h FROM lineitem WHERE l_linenumber < 10), d AS (SELECT DISTINCT * FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN used THEN 0 ELSE 1 END, h) AS i, count(*) FILTER (used) OVER () AS u FROM d) SELECT l_orderkey, l_linenumber FROM r WHERE used OR i <= 500
""")
def q58_prune_cells(spark, sf_dir):
    """Cells of a label: those that samples refer to, and others, in hash order, up to 500 in all."""
    cells = t(spark, sf_dir, "lineitem").where("l_linenumber < 10").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") == 1).alias("used"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("h")).distinct()
    return FX.pruned(cells, "used", F.col("h"), 500).select("l_orderkey", "l_linenumber")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'p_size*p_retailprice' WHEN 1 THEN '(p_size+p_retailprice)' WHEN 2 THEN NULL ELSE 'p_size**2-p_retailprice' END AS expression,
CASE WHEN p_partkey % 4 = 2 THEN 'unsupported function: VLOOKUP (Phase 1)' ELSE '' END AS reason FROM part
""")
def q59_formula_translate(spark, sf_dir):
    """A formula text for every part, translated in Arrow batches."""
    n = F.col("p_partkey")
    r = n.cast("string")
    text = F.when(n % 4 == 0, F.concat(F.lit("=E"), r, F.lit("*F"), r)).when(n % 4 == 1, F.concat(F.lit("=SUM(E"), r, F.lit(":F"), r, F.lit(")"))).when(n % 4 == 2, F.concat(F.lit("=VLOOKUP(E"), r, F.lit(",1)"))).otherwise(F.concat(F.lit("=$E$"), r, F.lit("^2-F"), r))
    names = {5: "p_size", 6: "p_retailprice"}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [translate(f, k, names) for k, f in zip(batch.column("p_partkey").to_pylist(), batch.column("f").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("p_partkey"), pa.array([m[0] for m in made], pa.string()), pa.array([m[2] for m in made], pa.string())], ["p_partkey", "expression", "reason"])

    return t(spark, sf_dir, "part").select("p_partkey", text.alias("f")).mapInArrow(run, "p_partkey bigint, expression string, reason string")


@query("""
SELECT o_orderkey, 'What is the price for order ' || o_orderkey || ' in orders?' AS named, CASE o_orderkey % 2 WHEN 0 THEN printf('%d', o_orderkey) END AS general FROM orders WHERE false
UNION ALL SELECT o_orderkey, 'x', CAST(o_orderkey AS VARCHAR) FROM orders
""")
def q66_general_numbers(spark, sf_dir):
    """Whole numbers below a million in the general format."""
    return t(spark, sf_dir, "orders").select("o_orderkey", F.lit("x").alias("named"), F.when(F.col("o_orderkey") < 1_000_000, X.general(F.col("o_orderkey").cast("double"))).otherwise(F.col("o_orderkey").cast("string")).alias("general"))


@query("""
SELECT c_mktsegment AS key, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS finished, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def q67_sumif(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("key")).agg(sum_if(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("finished"), F.count("*").alias("n"))
