"""Sources, sinks, projections, guards, joins and set operations of the recordings."""

from __future__ import annotations

from math import pi

from pyspark.sql import Window
from pyspark.sql import functions as F

from sequora.operators import sequences as sq
from sequora.operators.motion import positions
from sequora.operators.resampling import window_sample
from sequora.operators.sequences import r6
from sequora.operators.spatial import coverage, re_origin
from sequora.plans.registry import EV, GAP, query
from sequora.plans.transitions import P1, operator, steady
from sequora.sources import formats, npy
from sequora.sources.bindings import event_sequence, group_of, table
from sequora.sources.storage import fresh_path


@query(f"WITH {EV} SELECT rec, t, value FROM ev WHERE label = 2")
def state_filter(spark, sf_dir):
    return event_sequence(spark, sf_dir).where("label = 2").select("rec", "t", "value")


@query(f"WITH {EV} SELECT rec, t, value FROM ev WHERE value BETWEEN 100 AND 200")
def clip_closed(spark, sf_dir):
    return event_sequence(spark, sf_dir).where(F.col("value").between(100, 200)).select("rec", "t", "value")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20")
def open_bin_filter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity > 10 and l_quantity < 20").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"WITH {EV} SELECT rec, t, round(degrees(phase), 6) AS degrees, round(k / (CASE WHEN rec % 14 >= 9 THEN 365 ELSE 170 END), 6) AS cm, round(micros / 1e6::DOUBLE / 60, 4) AS minutes FROM ev")
def unit_projection(spark, sf_dir):
    scale = F.when(F.col("rec") % 14 >= 9, 365).otherwise(170)
    return event_sequence(spark, sf_dir).select("rec", "t", r6(F.degrees("phase")).alias("degrees"), r6(F.col("k") / scale).alias("cm"), F.round(F.col("micros") / 1e6 / 60, 4).alias("minutes"))


@query(f"WITH {EV} SELECT rec, count(*) AS n FROM ev GROUP BY rec HAVING count(*) > 60")
def support_guard(spark, sf_dir):
    return event_sequence(spark, sf_dir).groupBy("rec").agg(F.count(F.lit(1)).alias("n")).where("n > 60")


@query(f"WITH {EV} SELECT rec, round((max(micros) - min(micros)) / 6e7::DOUBLE, 4) AS minutes FROM ev GROUP BY rec HAVING max(micros) - min(micros) > 27 * 86400000000")
def duration_guard(spark, sf_dir):
    d = event_sequence(spark, sf_dir).groupBy("rec").agg((F.max("micros") - F.min("micros")).alias("d"))
    return d.where(F.col("d") > 27 * 86_400_000_000).select("rec", F.round(F.col("d") / 6e7, 4).alias("minutes"))


@query(f"WITH {EV} SELECT rec, round(avg(CASE WHEN k <= 30 THEN value END), 6) AS dark, round(avg(CASE WHEN k > 30 AND k <= 60 THEN value END), 6) AS dim, round(avg(CASE WHEN k > 60 THEN value END), 6) AS bright FROM ev GROUP BY rec")
def stimulus_filter(spark, sf_dir):
    mean = lambda cond: r6(F.avg(F.when(cond, F.col("value"))))
    k = F.col("k")
    return event_sequence(spark, sf_dir).groupBy("rec").agg(mean(k <= 30).alias("dark"), mean((k > 30) & (k <= 60)).alias("dim"), mean(k > 60).alias("bright"))


@query(f"WITH {EV} SELECT rec, t, nullif(label, 1) AS label FROM ev")
def sentinel_to_null(spark, sf_dir):
    return event_sequence(spark, sf_dir).select("rec", "t", F.nullif("label", F.lit(1)).alias("label"))


@query(f"WITH {EV} SELECT rec, t, CASE WHEN t < count(*) OVER (PARTITION BY rec) - 1 THEN label END AS label FROM ev")
def unpad_last_null(spark, sf_dir):
    """Recordings joined end to end need a missing symbol behind each: the last one goes. Rows are never padded, so none is cut."""
    return sq.drop_ends(event_sequence(spark, sf_dir), first=0, last=1).select("rec", "t", "label")


@query(f"WITH {GAP} SELECT rec, t, CASE WHEN label IS NOT NULL THEN value END AS value FROM ev")
def mask_propagate(spark, sf_dir):
    return event_sequence(spark, sf_dir, gaps=True).select("rec", "t", F.when(F.col("label").isNotNull(), F.col("value")).alias("value"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL")
def parquet_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("SELECT o_orderkey % 4 AS shard, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def shard_union(spark, sf_dir):
    """Shards written apart and read by one path."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 4).alias("shard"))
    back = formats.round_trip(orders, "parquet", partition_by=["shard"])
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {EV}, c AS (SELECT label AS i, k % 6 AS j, count(*) AS v FROM ev GROUP BY ALL) SELECT i, j, v FROM c")
def matrix_scan(spark, sf_dir):
    """A matrix as rows of arrays, read back as cells."""
    cells = event_sequence(spark, sf_dir).groupBy(F.col("label").alias("i"), (F.col("k") % 6).alias("j")).agg(F.count(F.lit(1)).alias("v"))
    rows = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m")).select("i", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.try_element_at("m", j)).alias("row"))
    return formats.matrix_cells(rows, "i", "row").where("v is not null")


@query("SELECT o_custkey AS a, o_orderkey AS b FROM orders")
def grid_text_scan(spark, sf_dir):
    """Integer columns written as text with spaces between, read back with a schema."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return formats.round_trip(rows, "csv", options={"sep": " "})


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def roundtrip_parquet(spark, sf_dir):
    return formats.round_trip(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "parquet")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def roundtrip_csv(spark, sf_dir):
    return formats.round_trip(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "csv", options={"header": "true"})


@query("SELECT n_name, r_name, count(c_custkey) AS n, round(avg(c_acctbal), 6) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def group_members(spark, sf_dir):
    """Equi-join of many rows with two dimensions of a fixed size."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dims = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    joined = c.join(dims, c.c_nationkey == dims.n_nationkey)
    return joined.groupBy("n_name", "r_name").agg(F.sum("n").alias("n"), r6(F.sum("s") / F.sum("n")).alias("balance"))


N_CONDITIONS = 14
RANGES = f"c AS (SELECT i::INT AS cond, lo + ceil(i * w)::BIGINT AS lo, lo + ceil((i + 1) * w)::BIGINT AS hi FROM (SELECT min(user_id) AS lo, (max(user_id) + 1 - min(user_id)) / {N_CONDITIONS}::DOUBLE AS w FROM events), unnest(range(0, {N_CONDITIONS})) AS u(i))"


@query(f"WITH {EV}, {RANGES} SELECT rec, cond, count(*) AS n FROM ev JOIN c ON rec >= lo AND rec < hi GROUP BY ALL")
def condition_range_join(spark, sf_dir):
    """Half-open ranges of recordings, 14 of them over all recordings: a table of fixed size, so a broadcast range join after the aggregation."""
    ends = table(spark, sf_dir, "events").agg(F.min("user_id").alias("lo"), ((F.max("user_id") + 1 - F.min("user_id")) / F.lit(float(N_CONDITIONS))).alias("w"))
    c = ends.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(N_CONDITIONS - 1))).alias("cond"))
    c = c.select("cond", (F.col("lo") + F.ceil(F.col("cond") * F.col("w"))).alias("lo"), (F.col("lo") + F.ceil((F.col("cond") + 1) * F.col("w"))).alias("hi"))
    n = event_sequence(spark, sf_dir).groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(c), (F.col("rec") >= F.col("lo")) & (F.col("rec") < F.col("hi"))).select("rec", "cond", "n")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def group_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def group_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query(f"WITH {EV} SELECT rec, (rec % 7)::INT AS grp, count(*) AS n FROM ev WHERE rec % 7 <> 3 GROUP BY ALL")
def group_complement(spark, sf_dir):
    seq = event_sequence(spark, sf_dir)
    inside = seq.where(group_of() == 3).select("rec").distinct()
    return seq.join(inside, "rec", "left_anti").groupBy("rec", group_of().alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).subtract(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("SELECT s_nationkey AS id FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id")).union(table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_nationkey")).distinct()


@query("SELECT 'c' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_nationkey, s_acctbal FROM supplier")
def concat_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query(f"WITH {EV}, g AS (SELECT DISTINCT (rec % 7)::INT AS grp FROM ev) SELECT grp, d AS delay, s AS seed FROM g, unnest([1, 3, 5]) AS a(d), unnest(range(0, 4)) AS b(s)")
def param_grid(spark, sf_dir):
    """The groups that occur, by the delays and seeds of a sweep: a product of small sets."""
    g = event_sequence(spark, sf_dir).select(group_of().alias("grp")).distinct()
    return g.select("grp", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("delay")).select("grp", "delay", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("seed"))


@query(f"WITH {EV}, {P1}, {steady()} SELECT state, round(pi, 6) AS pi FROM pi ORDER BY pi DESC, state LIMIT 1")
def heaviest_state(spark, sf_dir):
    return operator(spark, sf_dir)[1].agg(F.max_by("state", F.struct("pi", -F.col("state"))).alias("state"), r6(F.max("pi")).alias("pi"))


@query(f"""WITH {EV}, o AS (SELECT rec, t, label, (rec % 7)::INT AS grp, row_number() OVER (PARTITION BY rec % 7 ORDER BY rec, t) - 1 AS pos, count(*) OVER (PARTITION BY rec % 7) AS n FROM ev),
 s AS (SELECT *, floor(('0x' || substr(md5('0:' || grp), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (n - 100))::BIGINT AS start FROM o)
SELECT grp, pos - start + 2 AS place, label FROM s WHERE pos >= start AND pos < start + 100 UNION ALL SELECT grp, x, NULL FROM (SELECT DISTINCT grp FROM s), unnest([0, 1, 102, 103]) AS u(x)""")
def window_sample_padded(spark, sf_dir):
    """A run of 100 rows of each group from a hashed start, two missing rows on each side.

    Places inside a group are a recording's offset (running sums over recordings, not rows) plus the place in the recording.
    """
    return window_sample(event_sequence(spark, sf_dir).select("rec", "t", "label").withColumn("grp", group_of()), "grp", 100, 0).select("grp", "place", "label")


XYG = "xy AS (SELECT rec, t, sum(k / 50.0::DOUBLE * cos(phase)) OVER (PARTITION BY rec ORDER BY t) AS x, sum(k / 50.0::DOUBLE * sin(phase)) OVER (PARTITION BY rec ORDER BY t) AS y FROM ev)"


def paths(spark, sf_dir):
    return positions(event_sequence(spark, sf_dir).withColumn("step", F.col("k") / 50.0), "step", "phase")


@query(f"WITH {EV}, {XYG}, c AS (SELECT DISTINCT rec, floor(x)::INT AS ix, floor(y)::INT AS iy FROM xy), g AS (SELECT ix, iy, count(*) AS recs FROM c GROUP BY ALL) SELECT ix, iy, recs, round(sqrt((ix + 0.5) ** 2 + (iy + 0.5) ** 2), 6) AS radius, round(atan2(iy + 0.5, ix + 0.5), 6) AS angle FROM g")
def grid_cells(spark, sf_dir):
    """Cells of the plane that recordings reached, with the radius and angle of their centres."""
    c = paths(spark, sf_dir).select("rec", F.floor("x").cast("int").alias("ix"), F.floor("y").cast("int").alias("iy")).distinct().groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("recs"))
    cx, cy = F.col("ix") + 0.5, F.col("iy") + 0.5
    return c.select("ix", "iy", "recs", r6(F.sqrt(cx * cx + cy * cy)).alias("radius"), r6(F.atan2(cy, cx)).alias("angle"))


#: 50 radii, evenly spaced in their logarithm.
RADII = [round(0.8 * (100 / 0.8) ** (i / 49), 6) for i in range(50)]
HALF = int(max(RADII)) + 1


@query(f"""WITH {EV}, {XYG}, g AS (SELECT x::INT AS ix, y::INT AS iy, sqrt((x + 0.5::DOUBLE) ** 2 + (y + 0.5::DOUBLE) ** 2) AS r FROM unnest(range(-{HALF}, {HALF})) AS a(x), unnest(range(-{HALF}, {HALF})) AS b(y)), rad AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RADII)}]) AS radius),
 c AS (SELECT DISTINCT rec, floor(x)::INT AS ix, floor(y)::INT AS iy FROM xy), tot AS (SELECT radius, count(*) AS cells FROM rad JOIN g ON r <= radius GROUP BY radius),
 v AS (SELECT rec, radius, count(*) AS seen FROM c JOIN g USING (ix, iy) JOIN rad ON r <= radius GROUP BY ALL) SELECT a.rec, tot.radius, round(coalesce(seen, 0) / cells, 6) AS share FROM (SELECT DISTINCT rec FROM ev) a, tot LEFT JOIN v ON v.rec = a.rec AND v.radius = tot.radius""")
def detect_coverage(spark, sf_dir):
    """Share of the cells within each radius that a recording reached: distinct cells get the least radius that holds them, then running counts."""
    return coverage(paths(spark, sf_dir), RADII).select("rec", "radius", r6(F.col("share")).alias("share"))


WEDGE_CELLS = sum(1 for x in range(0, 10) for y in range(-10, 10) if (cx := (x + 0.5) / 2) ** 2 + (cy := (y + 0.5) / 2) ** 2 < 25 and abs(cy) <= cx * 3**-0.5)


@query(f"""WITH {EV}, {XYG}, o AS (SELECT rec, t, x - first_value(x) OVER w AS dx, y - first_value(y) OVER w AS dy, first_value(atan2(y, x)) OVER w AS psi FROM xy WINDOW w AS (PARTITION BY rec ORDER BY t)),
 r AS (SELECT rec, t, floor(round((dx * cos(psi) + dy * sin(psi)) * 2, 9)) AS ix, floor(round((dy * cos(psi) - dx * sin(psi)) * 2, 9)) AS iy FROM o WHERE t <= 30 AND t > 0), c AS (SELECT DISTINCT rec, ix, iy FROM r WHERE abs((iy + 0.5::DOUBLE) / 2) <= (ix + 0.5::DOUBLE) / 2 * pow(3, -0.5) AND ((ix + 0.5::DOUBLE) / 2) ** 2 + ((iy + 0.5::DOUBLE) / 2) ** 2 < 25)
SELECT a.rec, round(count(c.ix) / {WEDGE_CELLS}::DOUBLE, 6) AS share FROM (SELECT DISTINCT rec FROM ev) a LEFT JOIN c USING (rec) GROUP BY a.rec""")
def hunt_coverage(spark, sf_dir):
    """Share of the cells of the wedge ahead that a recording's first 30 steps reach, 0 for recordings that reach none."""
    xy = paths(spark, sf_dir)
    cell = lambda c: F.floor(F.round(F.col(c) * 2, 9))
    c = re_origin(xy).where("t <= 30 and t > 0").select("rec", cell("x").alias("ix"), cell("y").alias("iy")).distinct()
    cx, cy = (F.col("ix") + 0.5) / 2, (F.col("iy") + 0.5) / 2
    inside = c.where((F.abs(cy) <= cx * 3**-0.5) & (cx * cx + cy * cy < 25)).groupBy("rec").agg(F.count(F.lit(1)).alias("n"))
    recs = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec")).distinct()
    return recs.join(inside, "rec", "left").select("rec", r6(F.coalesce("n", F.lit(0)) / F.lit(float(WEDGE_CELLS))).alias("share"))


@query(f"WITH {EV}, {XYG} SELECT rec, t, round(x, 6) AS x, round(y, 6) AS y FROM xy WHERE NOT (y > -2 AND y < 2)")
def outside_band(spark, sf_dir):
    """Positions outside an excluded band."""
    return paths(spark, sf_dir).where(~((F.col("y") > -2) & (F.col("y") < 2))).select("rec", "t", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("WITH o AS (SELECT o_custkey AS a, o_orderkey AS b, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT i, a, b FROM o WHERE i % 100 = 7")
def grid_row_pick(spark, sf_dir):
    """Lines of an integer matrix in text, picked by their number: each line carries it, so a pick is a filter."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return formats.round_trip(formats.numbered(rows, ["b"], "i"), "csv", options={"sep": " "}).where("i % 100 = 7").select("i", "a", "b")


@query("SELECT n_nationkey AS i, j::INT AS j, (CASE WHEN j = 0 THEN n_regionkey ELSE n_nationkey * j END)::DOUBLE AS v FROM nation, unnest(range(0, 3)) AS u(j) WHERE CASE WHEN j = 0 THEN n_regionkey ELSE n_nationkey * j END <> 0")
def matrix_from_arrays(spark, sf_dir):
    """The array adapter: a small matrix of the driver (the fixed table of nations) becomes an edge list."""
    nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_regionkey").toPandas()
    keys = nations.n_nationkey.to_numpy()
    return formats.matrix_from_arrays(spark, [[r, k, 2 * k] for k, r in zip(keys.tolist(), nations.n_regionkey.tolist())])


#: Lines of the written matrix that a task reads.
NPY_LINES = 40


@query(f"WITH {EV}, c AS (SELECT rec, label AS j, count(*)::DOUBLE AS v FROM ev GROUP BY ALL), r AS (SELECT DISTINCT rec FROM ev), g AS (SELECT rec, unnest([0, 2, 4])::INT AS j FROM r) SELECT (dense_rank() OVER (ORDER BY g.rec) - 1)::BIGINT AS i, g.j, v FROM g LEFT JOIN c USING (rec, j)")
def matrix_npy(spark, sf_dir):
    """Symbol counts of the recordings as a matrix in array files, missing where a symbol never comes; read back by ranges of lines, three of its columns."""
    npy.register(spark)
    n = event_sequence(spark, sf_dir).groupBy("rec").pivot("label", list(range(5))).agg(F.count(F.lit(1)).cast("double"))
    lines = formats.numbered(n, ["rec"], "i").select("i", F.array(*[F.col(f"`{j}`") for j in range(5)]).alias("row"))
    path = fresh_path(spark, "npy")
    lines.repartitionByRange("i").write.format("npy").mode("append").save(path)
    back = spark.read.format("npy").options(lines=NPY_LINES, columns="0,2,4").load(path)
    return back.select("i", F.posexplode("row").alias("at", "v")).select("i", (F.col("at") * 2).cast("int").alias("j"), "v")
