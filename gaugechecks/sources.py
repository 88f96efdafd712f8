"""Sources and sinks. Files are first written by Spark from the given tables, into a fresh shared folder."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gaugechecks.tables import DIRTY, dirty, table
from sparkgauge.operators.counts import null_counts
from sparkgauge.operators.duplicates import drop_duplicates
from sparkgauge.plans import validation
from sparkgauge.session import scratch_path
from sparkgauge.sources import files, readers, records, sinks, store

QUERIES, SQL = {}, {}
SPLITS_A_FILE = 2


def register(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def exported(spark, sf, name="orders", header="true"):
    return sinks.write_csv(table(spark, sf, name), scratch_path(spark, f"{name}-csv"), header=header)


@register("csv_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def csv_scan(spark, sf):
    orders = readers.read_csv(spark, exported(spark, sf))
    return orders.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@register("csv_null_markers", f"WITH {DIRTY} SELECT k, qty, CASE WHEN flag <> '' THEN flag END AS flag, TRY_CAST(mixed AS BIGINT) AS mixed FROM dirty")
def csv_null_markers(spark, sf):
    path = sinks.write_csv(dirty(spark, sf).select("k", "qty", "flag", "mixed"), scratch_path(spark, "dirty-csv"))
    return readers.read_csv(spark, path)


QUOTED = """replace(text, ' ', '" ')"""


@register("csv_round_trip", f"SELECT doc_id, {QUOTED} || chr(10) || 'x,\"y\"' AS text, lang FROM documents")
def csv_round_trip(spark, sf):
    docs = table(spark, sf, "documents")
    quoted = F.concat(F.replace("text", F.lit(" "), F.lit('" ')), F.lit('\nx,"y"'))
    path = sinks.write_csv(docs.select("doc_id", quoted.alias("text"), "lang"), scratch_path(spark, "quoted-csv"))
    return readers.read_csv(spark, path, "doc_id bigint, text string, lang string", null_values=())


@register("corrupt_rows", "SELECT 'surplus_cells' AS reason, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 7 = 0")
def corrupt_rows(spark, sf):
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "9"))
    path = scratch_path(spark, "surplus-csv")
    table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    found = readers.corrupt_rows(spark, path, ["o_orderkey", "o_orderstatus"])
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.split_part("record", F.lit(","), F.lit(1)).cast("bigint")).alias("keys"))


@register("connector", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size, count(DISTINCT p_brand) AS brands FROM part")
def connector(spark, sf):
    source = readers.Source(spark, "parquet")
    part = source.read(f"{sf}/part.parquet")
    return part.agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"), F.count_distinct("p_brand").alias("brands"))


@register("raw_headers", "SELECT CAST(position AS INTEGER) AS position, header FROM (VALUES (0, 'o_orderkey'), (1, 'o_custkey'), (2, 'o_orderstatus'), (3, 'o_totalprice'), (4, 'o_orderdate'), (5, 'o_orderpriority')) AS v(position, header)")
def raw_headers(spark, sf):
    return validation.header_frame(spark, readers.raw_headers(spark, exported(spark, sf)))


@register("duplicate_headers", "SELECT source AS header, count(*) AS times FROM documents GROUP BY source HAVING count(*) > 1")
def duplicate_headers(spark, sf):
    return validation.duplicate_headers(table(spark, sf, "documents").select(F.col("source").alias("header")))


@register("encoding_check", "SELECT count(*) AS lines, CAST(0 AS BIGINT) AS invalid_lines FROM orders")
def encoding_check(spark, sf):
    found = files.encoding_check(spark, exported(spark, sf, header="false"))
    return found.agg(F.sum("lines").alias("lines"), F.sum("invalid_lines").alias("invalid_lines"))


@register("file_headers", """SELECT 'o_orderkey|o_custkey' AS header, 1 AS files, count(*) AS rows FROM orders UNION ALL SELECT 'c_custkey|c_name', 1, count(*) FROM customer""")
def file_headers(spark, sf):
    """Files with two different headers below one path, and the rows behind each."""
    parts = {"orders": ["o_orderkey", "o_custkey"], "customer": ["c_custkey", "c_name"]}
    paths = [sinks.write_csv(table(spark, sf, t).select(*c).coalesce(1), scratch_path(spark, f"{t}-csv"), header="true") for t, c in parts.items()]
    heads = readers.file_headers(spark, paths).select(F.array_join("header", "|").alias("header"), F.col("files").cast("int").alias("files"))
    counts = [readers.read_csv(spark, p).agg(F.count(F.lit(1)).alias("rows")).withColumn("header", F.lit("|".join(c))) for p, c in zip(paths, parts.values())]
    return heads.join(counts[0].unionByName(counts[1]), "header")


@register("encoding_violations", "SELECT 'INVALID_ENCODING' AS code, count(*) AS lines, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS invalid_lines FROM orders")
def encoding_violations(spark, sf):
    """Lines with bytes that are no UTF-8, in as many files as tasks write."""
    line = F.concat(F.col("o_orderkey").cast("string").cast("binary"), F.when(F.col("o_orderkey") % 5 == 0, F.unhex(F.lit("2CC328"))).otherwise(F.unhex(F.lit("2CC3A4"))))
    path = scratch_path(spark, "bytes-csv")
    table(spark, sf, "orders").select(line.cast("string").alias("value")).write.text(path)
    found = files.encoding_violations(spark, path).select("code").distinct()
    return found.crossJoin(files.encoding_check(spark, path).agg(F.sum("lines").alias("lines"), F.sum("invalid_lines").alias("invalid_lines")))


@register("file_violations", "SELECT code, files FROM (VALUES ('EMPTY_FILE', 1), ('UNSUPPORTED_FILE', 3)) AS v(code, files) WHERE (SELECT count(*) FROM nation) > 2")
def file_violations(spark, sf):
    """An empty file and files of another kind, in folders of several levels."""
    path, nation = scratch_path(spark, "mixed-files"), table(spark, sf, "nation")
    sinks.write_csv(nation.coalesce(1), f"{path}/good/part=1", header="true")
    nation.limit(0).select(F.col("n_name").alias("value")).coalesce(1).write.option("header", "false").csv(f"{path}/empty")
    nation.select(F.col("n_name").alias("value")).repartition(3, "value").write.text(f"{path}/other/deep")
    return files.file_checks(spark, path).groupBy("code").agg(F.count(F.lit(1)).cast("int").alias("files"))


@register("record_violations", """SELECT 'CORRUPTED_FILE' AS code, 'Corrupted CSV structure: ' || count(*) FILTER (WHERE o_orderkey % 7 = 0) || ' record(s) with more cells than the header has.' AS message FROM orders""")
def record_violations(spark, sf):
    """Records with too many cells, as a critical violation of the source; the header leads each file that a task writes."""
    key = F.col("o_orderkey").cast("string")
    cells = F.when(F.col("o_orderkey") % 7 == 0, F.concat(key, F.lit(",x,9"))).otherwise(F.concat(key, F.lit(",x")))
    path = scratch_path(spark, "surplus-csv")
    table(spark, sf, "orders").select(cells.alias("a,b")).write.options(header="true", quote="\u0000").option("sep", "\t").csv(path)
    return readers.CsvSource(spark).violations(path).select("code", "message")


@register("csv_split_scan", f"SELECT doc_id, {QUOTED} || chr(10) || 'x,\"y\"' AS text, lang FROM documents")
def csv_split_scan(spark, sf):
    """Files with line breaks in their cells, put together from their lines, which several tasks may read."""
    docs = table(spark, sf, "documents")
    # A task writes a file from SPLITS_A_FILE splits of the table, whatever its size; the texts of a file are more than a split.
    parts = math.ceil(docs.rdd.getNumPartitions() / SPLITS_A_FILE)
    quoted = F.concat(F.replace("text", F.lit(" "), F.lit('" ')), F.lit('\nx,"y"'))
    path = sinks.write_csv(docs.select("doc_id", quoted.alias("text"), "lang").coalesce(max(1, parts)), scratch_path(spark, "quoted-csv"))
    cells = readers.split_rows(spark, path, ["doc_id", "text", "lang"])
    return cells.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@register("file_checks", "SELECT 'CORRUPTED_FILE' AS code, 'critical' AS severity FROM orders HAVING count(*) > 0")
def file_checks(spark, sf):
    return files.file_checks(spark, exported(spark, sf), size_limit=10).select("code", "severity").distinct()


@register("table_metadata", f"WITH {DIRTY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS null_count FROM dirty"
    for c, t in (("k", "bigint"), ("qty", "double"), ("price", "double"), ("flag", "string"), ("mixed", "string"), ("day", "string"), ("const", "string"), ("empty", "string"))))
def table_metadata(spark, sf):
    d = dirty(spark, sf)
    return readers.table_metadata(d).join(null_counts(d), "column_name").select("column_name", "data_type", "null_count")


@register("csv_sink", f"""WITH {DIRTY} SELECT CASE WHEN flag <> '' THEN flag END AS flag, count(*) AS n, count(qty) AS n_qty, round(sum(price), 2) AS price FROM (SELECT DISTINCT * FROM dirty) GROUP BY 1""")
def csv_sink(spark, sf):
    clean = drop_duplicates(dirty(spark, sf))
    path = sinks.write_csv(clean, scratch_path(spark, "clean-csv"))
    again = readers.read_csv(spark, path, "k bigint, qty double, price double, flag string, mixed string, day string, const string, empty string")
    return again.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count("qty").alias("n_qty"), F.round(F.sum("price"), 2).alias("price"))


@register("preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 100")
def preview(spark, sf):
    return readers.preview(table(spark, sf, "orders").drop("o_orderdate", "o_orderpriority"), ["o_orderkey"])


@register("latest_run", """SELECT dataset_id, event_id, event_type FROM (SELECT CAST(user_id AS VARCHAR) AS dataset_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) AS e WHERE rn = 1""")
def latest_run(spark, sf):
    runs = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("dataset_id"), F.col("ts").alias("run_ts"), "event_id", "event_type")
    return store.latest_run(runs, order=[F.desc("run_ts"), F.desc("event_id")]).drop("run_ts")


@register("result_store", """SELECT CAST(o_custkey AS VARCHAR) AS dataset_id, 'completed' AS status, count(*) AS rows_count, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY o_custkey""")
def result_store(spark, sf):
    orders = table(spark, sf, "orders").withColumn("dataset_id", F.col("o_custkey").cast("string"))
    path = scratch_path(spark, "runs")
    started = orders.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows_count"), F.lit(0).cast("bigint").alias("statuses"))
    store.append_runs(started.select("dataset_id", F.lit(1).alias("run_ts"), F.lit("processing").alias("status"), "rows_count", "statuses"), path)
    done = orders.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows_count"), F.count_distinct("o_orderstatus").alias("statuses"))
    store.append_runs(done.select("dataset_id", F.lit(2).alias("run_ts"), F.lit("completed").alias("status"), "rows_count", "statuses"), path)
    return store.latest_run(store.all_runs(spark, path)).drop("run_ts")


@register("cleaning_history", f"""WITH {DIRTY} SELECT 'dirty' AS dataset_id, type, "column" FROM (VALUES ('drop_duplicates', NULL, (SELECT count(*) > count(DISTINCT k) FROM dirty)), ('impute_missing', 'qty', (SELECT count(*) > count(qty) FROM dirty))) AS v(type, "column", fires) WHERE fires""")
def cleaning_history(spark, sf):
    from sparkgauge.operators.duplicates import duplicate_count

    d = dirty(spark, sf)
    operations = []
    if duplicate_count(d).first()["duplicate_count"]:
        operations.append({"type": "drop_duplicates", "column": None})
    if null_counts(d).filter("column_name = 'qty' AND null_count > 0").count():
        operations.append({"type": "impute_missing", "column": "qty", "strategy": "median"})
    path = store.append_history(spark, scratch_path(spark, "history"), "dirty", operations)
    return spark.read.parquet(path).select("dataset_id", F.inline("operations")).select("dataset_id", "type", "column")


def responses(spark, sf):
    """conversations as model answers: plain, fenced, inside prose, incomplete or broken JSON."""
    c = table(spark, sf, "conversations")
    safe = F.translate("text", "{}", "()")
    whole = F.to_json(F.struct(
        F.col("role").alias("title"), safe.alias("summary"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("key_takeaway"),
        F.array(F.struct(F.lit("id").alias("label"), F.col("conv_id").cast("string").alias("value"))).alias("evidence"), F.lit("none").alias("limitations"),
    ))
    kind = F.col("conv_id") % 5
    raw = (
        F.when(kind == 0, whole)
        .when(kind == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here is the answer: "), whole, F.lit(" I hope {it} helps.")))
        .when(kind == 3, F.to_json(F.struct(F.col("role").alias("title"), safe.alias("summary"))))
        .otherwise(F.concat(F.lit("{ broken "), safe))
    )
    return c.select("conv_id", "turn", raw.alias("raw"))


@register("response_records", """SELECT conv_id, turn, CASE WHEN conv_id % 5 <= 2 THEN role END AS title, CASE WHEN conv_id % 5 <= 2 THEN md5(translate(text, '{}', '()')) END AS summary,
CASE WHEN conv_id % 5 <= 2 THEN 'turn ' || turn END AS takeaway, CASE WHEN conv_id % 5 <= 2 THEN 'id=' || conv_id || ' (Python Statistical Engine)' END AS evidence,
CASE conv_id % 5 WHEN 3 THEN 'missing_fields' WHEN 4 THEN 'not_json' END AS reject_reason FROM conversations""")
def response_records(spark, sf):
    found = records.response_records(responses(spark, sf), "raw")
    first = F.get("out_evidence", F.lit(0))
    return found.select(
        "conv_id", "turn", F.col("out_title").alias("title"), F.md5("out_summary").alias("summary"), F.col("out_key_takeaway").alias("takeaway"),
        F.format_string("%s=%s (%s)", first.getField("label"), first.getField("value"), first.getField("source")).alias("evidence"), "reject_reason",
    ).withColumn("evidence", F.when(F.col("reject_reason").isNull(), F.col("evidence")))


@register("missing_fields", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN 'v' ELSE '' END AS missing FROM events""")
def missing_fields(spark, sf):
    e = table(spark, sf, "events")
    parts = F.array_compact(F.array(F.when(F.col("event_id") % 3 != 0, '"k": 1'), F.when(F.col("event_id") % 2 != 0, '"v": 2'), F.lit('"props": ')))
    json = F.concat(F.lit("{"), F.concat_ws(", ", parts), F.col("props"), F.lit("}"))
    return e.select("event_id", F.concat_ws("", records.missing_fields(json, ("k", "v", "props"))).alias("missing"))
