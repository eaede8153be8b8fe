"""Queries through files: what a writer leaves in the shared folder, and the reader's frame of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.operators.runs import numbered, shared_path
from quakeframe.plans.stand_ins import PICKS, picks, rounded, table
from quakeframe.sources import readers, sinks

#: Places of a line item, for an order without ties between different items.
ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Extensions of the archive's files, by line number.
ENDS = ("mseed", "MSEED", "txt", "sac", "SAC", "csv")


def _archive(spark, sf_dir):
    """Paths of an archive: a folder per station, some of them abstracted, and a folder of a chunk."""
    end = F.get(F.array(*[F.lit(e) for e in ENDS]), (F.col("l_linenumber") % len(ENDS)).cast("int"))
    root = F.when(F.col("l_suppkey") % 3 == 0, "/abstracted_waveforms/").otherwise("/raw/")
    folder = F.when(F.col("l_orderkey") % 7 == 0, "20240101T000000Z_20240101T000100Z").otherwise(F.format_string("S%04d", F.col("l_suppkey")))
    return table(spark, sf_dir, "lineitem").select(F.concat(root, folder, F.lit("/f"), (F.col("l_partkey") % 5).cast("string"), F.lit("."), end).alias("path"))


def archive_files(spark, sf_dir):
    return readers.waveform_files(_archive(spark, sf_dir))


def archive_stations(spark, sf_dir):
    return readers.stations_of(readers.waveform_files(_archive(spark, sf_dir)))


def resolved_files(spark, sf_dir):
    """The chunk's own files, or the parent folder's where the chunk's own decode to nothing."""
    li = table(spark, sf_dir, "lineitem")
    path = F.concat_ws("/", *ITEM)
    files = li.select(F.col("l_orderkey").alias("chunk"), (F.col("l_suppkey") % 3).alias("sta"), path.alias("path"), (F.col("l_linestatus") == "O").alias("local")).distinct()
    decoded = li.filter("l_tax < 0.05").select(path.alias("path"), F.greatest(F.col("l_quantity").cast("int") - 25, F.lit(0)).alias("samples")).dropDuplicates(["path"])
    return readers.resolve_files(files, decoded, ["chunk", "sta"])


def _trial_file(spark, sf_dir) -> str:
    """A trial file of all line items in order: records, snapshots, errors, blank and broken lines."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, "env").when(F.col("l_linenumber") == 2, "error").otherwise("single")
    record = F.to_json(F.struct(kind.alias("kind"), F.col("l_returnflag").alias("backend"), F.lit("fp32").alias("dtype"), F.struct((F.col("l_linestatus") == "O").alias("compile")).alias("backend_extra"), (F.col("l_suppkey") % 3).cast("int").alias("n_cpu_workers"), F.col("l_quantity").alias("total_s"), F.col("l_partkey").alias("part")))
    line = F.when(F.col("l_linenumber") == 6, "").when(F.col("l_linenumber") == 7, F.lit('{"kind": "single", "tot')).otherwise(record)
    path = shared_path(spark)
    li.select(*ITEM, line.alias("value")).repartitionByRange(*ITEM).sortWithinPartitions(*ITEM).select("value").write.text(path)
    return path


def trial_file(spark, sf_dir):
    rows = readers.read_trials(spark, _trial_file(spark, sf_dir), include_errors=True)
    return rounded(rows.groupBy("variant", "is_error").agg(F.count(F.lit(1)).alias("n"), F.sum("wall_time_s").alias("wall_s")))


def env_rows(spark, sf_dir):
    """Snapshots by their place among all snapshots of the file."""
    rows = readers.env_rows(spark, _trial_file(spark, sf_dir))
    return numbered(rows, ["file", "block", "line"], "place", 1).select("place", F.get_json_object("value", "$.part").cast("long").alias("part"))


def result_files(spark, sf_dir):
    """A result file per supplier, read back to one row per successful repeat, with the quality of its cell."""
    li = table(spark, sf_dir, "lineitem")
    repeat = F.struct((F.col("l_discount") < 0.02).alias("success"), F.col("l_quantity").alias("inference_s"), F.col("l_linenumber").cast("int").alias("repeat_index"))
    cells = li.groupBy("l_suppkey").agg(F.collect_list(repeat).alias("repeats"), F.max("l_tax").alias("f1"))
    timing = F.struct(F.size("repeats").alias("n_repeats"), F.col("repeats"))
    record = sinks.result_struct(F.create_map(F.lit("supplier"), F.col("l_suppkey").cast("string")), timing, F.struct(F.create_map(F.lit("f1"), F.col("f1")).alias("P")))
    path = shared_path(spark)
    sinks.write_results(cells.select("l_suppkey", record.alias("r")).select("l_suppkey", "r.*"), path, ("l_suppkey",))
    found = readers.read_results(spark, path, {"supplier": r"/l_suppkey=(\d+)/"}, "*.json")
    kept = found.select("supplier", "schema_version", (F.col("meta")["supplier"] == F.col("supplier")).alias("same"), F.col("timing.n_repeats").alias("n_repeats"), F.col("pick_quality_vs_catalog.P")["f1"].alias("f1"), "timing")
    keys = ["supplier", "schema_version", "same", "n_repeats", "f1"]
    return rounded(readers.result_repeats(kept, keys).groupBy(*keys).agg(F.count_if("ok").alias("n_ok"), F.count(F.lit(1)).alias("rows"), F.sum("inference_s").alias("inference_s")))


def trial_table(spark, sf_dir):
    """A trial table with human names and some cells that hold no number, written and read leniently."""
    li = table(spark, sf_dir, "lineitem")
    bad = F.col("l_linenumber") == 7
    named = {
        "Order": F.col("l_orderkey"), "Line": F.col("l_linenumber"), "Part": F.col("l_partkey"), "Number of CPUs": F.when(bad, "many").otherwise(F.col("l_quantity").cast("int").cast("string")),
        "GPUs Used": F.when(~bad, F.concat(F.lit("["), (F.col("l_suppkey") % 4).cast("string"), F.lit(", 9]"))), "Runtime (s)": F.when(F.col("l_linenumber") == 6, "x").otherwise(F.col("l_extendedprice").cast("string")),
    }
    path = shared_path(spark)
    li.select(*[c.alias(n) for n, c in named.items()]).write.option("header", "true").csv(path)
    columns = {"Order": "l_orderkey long", "Line": "l_linenumber long", "Part": "l_partkey long", "Number of CPUs": "cpus int", "GPUs Used": "gpus list", "Runtime (s)": "runtime double"}
    return rounded(readers.read_trial_csv(spark, path, columns).withColumn("gpus", F.concat_ws(",", F.col("gpus").cast("array<string>"))))


def pick_files(spark, sf_dir):
    """Pick files of all stations, written and read back."""
    side = lambda p, c: F.when(F.col("phase") == p, F.col(c))
    paired = picks(spark, sf_dir).select("station", side("P", "t").alias("p_time"), side("P", "prob").alias("p_prob"), side("S", "t").alias("s_time"), side("S", "prob").alias("s_prob"))
    path = shared_path(spark)
    sinks.write_picks(sinks.pick_rows(paired, "SB"), path)
    back = readers.read_picks(spark, path)
    return rounded(back.select("station", "phase", F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), "prob"))


def synthetic(spark, sf_dir):
    """Made-up waveforms of every supplier's station: the pulses' samples and the sum of each trace."""
    stations = table(spark, sf_dir, "supplier").select(F.format_string("S%04d", F.col("s_suppkey")).alias("sta"))
    made = readers.synthetic_network(spark, stations, 300, 5)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return made.select("sta", "cha", "p_sample", "s_sample", F.round(total, 3).alias("total"))


QUERIES = {
    "A3_waveform_files": archive_files, "A1_archive_stations": archive_stations, "A4_resolved_files": resolved_files, "A9_trial_file": trial_file, "A10_env_rows": env_rows,
    "A11_A29_result_files": result_files, "A13_trial_table": trial_table, "A14_pick_files": pick_files, "A26_synthetic_network": synthetic,
}

ARCHIVE = """files AS (SELECT DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN '/abstracted_waveforms/' ELSE '/raw/' END || folder || '/f' || (l_partkey % 5) || '.' || ending AS path, folder, l_suppkey % 3 = 0 AS abstracted
  FROM (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN '20240101T000000Z_20240101T000100Z' ELSE printf('S%04d', l_suppkey) END AS folder, ['mseed', 'MSEED', 'txt', 'sac', 'SAC', 'csv'][l_linenumber % 6 + 1] AS ending FROM lineitem)
  WHERE ending NOT IN ('txt', 'csv'))"""
NOISE = "(('0x' || substr(md5('5/{salt}/' || {of}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"

ORACLE_SQL = {
    "A3_waveform_files": f"WITH {ARCHIVE} SELECT DISTINCT path FROM files",
    "A1_archive_stations": f"WITH {ARCHIVE} SELECT DISTINCT folder AS station FROM files WHERE abstracted AND NOT contains(folder, 'Z_')",
    "A4_resolved_files": """WITH f AS (SELECT DISTINCT l_orderkey AS chunk, l_suppkey % 3 AS sta, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS path, l_linestatus = 'O' AS local FROM lineitem),
 d AS (SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS path, any_value(greatest(floor(l_quantity)::INTEGER - 25, 0)) AS samples FROM lineitem WHERE l_tax < 0.05 GROUP BY 1),
 r AS (SELECT f.*, coalesce(samples, 0)::INTEGER AS samples FROM f LEFT JOIN d ON f.path = d.path), own AS (SELECT chunk, sta, sum(samples) FILTER (local) AS own FROM r GROUP BY ALL)
 SELECT r.* FROM r JOIN own ON r.chunk = own.chunk AND r.sta = own.sta WHERE local = (coalesce(own, 0) > 0)""",
    "A9_trial_file": """SELECT l_returnflag || '/fp32' || CASE WHEN l_linestatus = 'O' THEN '/compiled' ELSE '' END || CASE WHEN l_suppkey % 3 > 0 THEN '/w' || (l_suppkey % 3) ELSE '' END AS variant,
 l_linenumber = 2 AS is_error, count(*) AS n, round(sum(l_quantity), 6) AS wall_s FROM lineitem WHERE l_linenumber BETWEEN 2 AND 5 GROUP BY ALL""",
    "A10_env_rows": "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place, l_partkey AS part FROM lineitem WHERE l_linenumber = 1",
    "A11_A29_result_files": """SELECT l_suppkey::VARCHAR AS supplier, 3::INTEGER AS schema_version, true AS same, count(*)::INTEGER AS n_repeats, round(max(l_tax), 6) AS f1, count(*) FILTER (l_discount < 0.02) AS n_ok,
 greatest(1, count(*) FILTER (l_discount < 0.02)) AS rows, round(sum(l_quantity) FILTER (l_discount < 0.02), 6) AS inference_s FROM lineitem GROUP BY l_suppkey""",
    "A13_trial_table": """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, CASE WHEN l_linenumber <> 7 THEN floor(l_quantity)::INTEGER END AS cpus, CASE WHEN l_linenumber <> 7 THEN (l_suppkey % 4) || ',9' ELSE '' END AS gpus,
 CASE WHEN l_linenumber <> 6 THEN round(l_extendedprice, 6) END AS runtime FROM lineitem""",
    "A14_pick_files": f"WITH {PICKS} SELECT station, phase, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS t, round(printf('%.6f', prob)::DOUBLE, 6) AS prob FROM picks",
    "A26_synthetic_network": f"""WITH s AS (SELECT printf('S%04d', s_suppkey) AS sta FROM supplier), p AS (SELECT sta, (floor({NOISE.format(salt="p", of="sta")} * 100) + 50)::INTEGER AS p_sample FROM s),
 x AS (SELECT sta, comp, p_sample, ({NOISE.format(salt="noise", of="sta || '/' || comp || '/' || i")} / 10 - 0.05::DOUBLE + exp(-((i - p_sample) ** 2) / 50.0::DOUBLE) + exp(-((i - p_sample - 75) ** 2) / 128.0::DOUBLE))::FLOAT AS v
   FROM p, (SELECT unnest(['Z', 'N', 'E']) AS comp) c, range(300) g(i))
 SELECT sta, 'HH' || comp AS cha, p_sample, p_sample + 75 AS s_sample, round(sum(v::DOUBLE), 3) AS total FROM x GROUP BY ALL""",
}
