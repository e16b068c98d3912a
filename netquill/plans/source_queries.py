"""Queries of sources and sinks (written and read back), preparation, splits and read paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import features, joins, metrics, splits
from ..schemas import id_column, prefixed_columns
from ..sources import csv_scan, files
from . import extract, registry, serve
from .queries import query, table


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf):
    path = files.scratch_path(spark, "csv")
    files.write_csv(table(spark, sf, "customer"), path)
    return files.read_csv(spark, path, ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT CAST(doc_id AS VARCHAR) AS flow_uid, text, lang AS label_name FROM documents WHERE length(trim(text)) > 0")
def jsonl_roundtrip(spark, sf):
    path = files.scratch_path(spark, "jsonl")
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("flow_uid"), "text", F.col("lang").alias("label_name"))
    files.write_jsonl(d, path)
    return files.read_flows(spark, path).where(F.length(F.trim("text")) > 0).select("flow_uid", "text", "label_name")


@query("SELECT text FROM documents WHERE length(trim(text)) > 0")
def jsonl_texts(spark, sf):
    path = files.scratch_path(spark, "texts")
    files.write_jsonl(table(spark, sf, "documents").select("text"), path)
    return files.read_texts(spark, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text, NULL::VARCHAR AS gone FROM documents WHERE lang <> 'en' AND text <> ''")
def encoded_csv_scan(spark, sf):
    """Texts written in GB18030, read in byte ranges; the source answers the filters, a column no file has is null."""
    path = files.scratch_path(spark, "gb18030")
    csv_scan.write_encoded_csv(table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[\\r\\n]+", " ").alias("text"), "lang"), path)
    return csv_scan.scan_csv(spark, path, ["doc_id", "lang", "text", "gone"], [("lang", "<>", "en"), ("text", "is not null", None)])


@query("SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS feat_0, CAST(embedding[2] AS DOUBLE) AS feat_1, CAST(embedding[3] AS DOUBLE) AS feat_2 FROM embeddings")
def vector_sink(spark, sf):
    path = files.scratch_path(spark, "vectors")
    e = table(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    files.vector_table(e, "embedding", 3, ids=("vec_id",), extra=("label",)).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("vec_id", "label", *prefixed_columns(back))


@query("SELECT event_type AS label, CAST(user_id % 3 AS INT) AS linktype, count(*) AS n FROM events GROUP BY 1, 2")
def label_partitions(spark, sf):
    """Two appends to a sink partitioned by label and link type; each of its folders is one pair."""
    path = files.scratch_path(spark, "by-label")
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("label"), (F.col("user_id") % 3).cast("int").alias("linktype"))
    files.write_by_label(e.where("event_id % 2 = 0"), path)
    files.write_by_label(e.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("label", "linktype").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name AS section, n_name AS name, CAST(n_nationkey AS DOUBLE) / 100 AS f1, CAST(n_nationkey AS BIGINT) AS support FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'accuracy', 0.5, CAST(7 AS BIGINT) FROM region")
def report_scan(spark, sf):
    """A report of several sections, written as text and read back."""
    path = files.scratch_path(spark, "report")
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.format_string("%20s   0.1000   0.2000   %.4f   %d", "n_name", F.col("n_nationkey") / 100, "n_nationkey")
    text = n.groupBy("r_name").agg(F.concat_ws("\n", F.concat(F.lit("=== "), F.first("r_name"), F.lit(" ===")), F.lit("   precision recall f1-score support"), F.concat_ws("\n", F.collect_list(line)), F.lit("accuracy   0.5000   7")).alias("value"))
    text.select("value").write.text(path)
    return files.read_report(spark, path).select("section", "name", "f1", "support")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, NULL::VARCHAR AS c_name FROM supplier UNION ALL SELECT NULL, NULL, c_name FROM customer")
def merged_parts(spark, sf):
    parts = [files.scratch_path(spark, "part") for _ in range(2)]
    files.write_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name"), parts[0])
    files.write_csv(table(spark, sf, "customer").select("c_name"), parts[1])
    path = files.scratch_path(spark, "merged")
    files.merge_parts(spark, parts, path)
    return files.read_csv(spark, path, ["s_suppkey", "s_name", "c_name"])


@query("SELECT 'csv' AS kind, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'jsonl', (SELECT count(*) FROM part)")
def row_counts(spark, sf):
    a, b = files.scratch_path(spark, "orders"), files.scratch_path(spark, "part")
    files.write_csv(table(spark, sf, "orders"), a)
    files.write_jsonl(table(spark, sf, "part"), b)
    return spark.createDataFrame([("csv", files.count_rows(spark, a)), ("jsonl", files.count_rows(spark, b, "jsonl"))], "kind string, n long")


@query("SELECT 'names' AS alias, CAST(sum(length(r_name) + 1) AS INT) AS n FROM region")
def image_bytes(spark, sf):
    """Bytes of a file in a report folder by its alias; an alias of an absent file gives no row."""
    path = files.scratch_path(spark, "images")
    table(spark, sf, "region").select(F.col("r_name").alias("value")).coalesce(1).write.text(path)
    name = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1)).first()[0]
    return files.read_images(spark, path, {"names": name, "none": "absent.png"}).select("alias", F.length("content").alias("n"))


@query("SELECT event_id, value FROM events")
def leakage_dropped(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("src_ip"), F.col("event_type").alias("protocol"), F.col("ts").alias("timestamp"), F.col("value"), F.col("props").alias("zeek_conn_log"))
    return features.drop_leakage(e)


@query("SELECT o_orderkey, o_custkey AS src_port, o_totalprice AS other, o_orderpriority AS dst_ip, epoch(o_orderdate) AS timestamp FROM orders")
def column_names(spark, sf):
    """Columns of a connection list are found by the words in their names."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("﻿ Source_Port"), F.col("o_totalprice").alias("other"), F.col("o_orderpriority").alias("Destination  IP"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("Time stamp"))
    found = scalar.standard_names(o.columns)
    o = o.select(*[F.col(f"`{c}`").alias(found.get(c, c)) for c in o.columns])
    return o.withColumn("timestamp", F.col("timestamp") / F.lit(1e6))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN d > 0 THEN round(d / 86400.0, 4) ELSE -1.0 END AS days FROM (SELECT *, epoch(l_shipdate) - (694224000.0 + l_orderkey % 7 * 40000000) AS d FROM lineitem)")
def day_spans(spark, sf):
    x = table(spark, sf, "lineitem")
    later = F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(1e6)
    return x.select("l_orderkey", "l_linenumber", scalar.days_between(later, F.lit(694224000.0) + F.col("l_orderkey") % 7 * 40000000).alias("days"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN [] ELSE [CAST(user_id AS DOUBLE), value] END AS cell FROM events")
def array_cells(spark, sf):
    text = F.when(F.col("event_id") % 3 == 2, "no array").otherwise(F.format_string("[%d, %s]", "user_id", F.col("value").cast("string")))
    return table(spark, sf, "events").select("event_id", scalar.parse_array(text).alias("cell"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type END AS name FROM events")
def literal_cells(spark, sf):
    """JSON, Python literals and neither."""
    n, e = F.col("event_id") % 3, F.col("event_type")
    cell = F.when(n == 0, F.format_string('{"name": "%s"}', e)).when(n == 1, F.format_string("{'name': '%s', 'none': None, 'yes': True}", e)).otherwise("neither {")
    return table(spark, sf, "events").select("event_id", F.get_json_object(scalar.literal_to_json(cell), "$.name").alias("name"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 END AS id FROM events")
def label_ids(spark, sf):
    n = F.col("event_id") % 3
    return table(spark, sf, "events").select("event_id", scalar.label_id(F.when(n == 0, " Ransomware").when(n == 1, "1")).alias("id"))


@query("""SELECT doc_id, CAST(dense_rank() OVER (ORDER BY coalesce(lang, 'nan')) - 1 AS INT) AS lang, n_chars FROM documents""")
def texts_encoded(spark, sf):
    """Text columns of few values become codes, others go."""
    return features.encode_texts(table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.md5("text").alias("many")))


@query("""WITH v AS (SELECT vec_id, label, embedding AS e FROM embeddings) SELECT vec_id, label, CAST(e[3] AS DOUBLE) AS feat_0, CAST(e[4] AS DOUBLE) AS feat_1 FROM v""")
def semantic_swap(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.get("embedding", 0).alias("feat_0"), F.get("embedding", 1).alias("feat_1"), F.get("embedding", 2).alias("feat_2"), F.array(F.get("embedding", 2).cast("double"), F.get("embedding", 3).cast("double")).alias("reduced"))
    return features.replace_semantic(e, prefixed_columns(e), "reduced", 2)


@query("SELECT o.o_orderkey AS row_id, o.o_totalprice, l.n FROM orders o JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey")
def rows_side_by_side(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.count(F.lit(1)).alias("n"), F.first("l_tax").alias("o_totalprice"))
    return joins.by_row(o, n)


@query(
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels), q AS (SELECT *, floor(n * 0.2 + 0.5) AS a FROM r)
SELECT doc_id, quality, CASE WHEN k < a THEN 'test' WHEN k < a + floor((n - a) * 0.25 + 0.5) THEN 'val' ELSE 'train' END AS subset FROM q"""
)
def guarded_split(spark, sf):
    return splits.guarded_split(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query(
    """WITH w AS (SELECT o_orderkey, o_totalprice / sum(o_totalprice) OVER () * 500 AS e, ('0x' || substr(md5('42:' || o_orderkey), 1, 12))::BIGINT / 281474976710656.0 AS u FROM orders)
SELECT o_orderkey, CAST(floor(e) + CASE WHEN u < e - floor(e) THEN 1 ELSE 0 END AS BIGINT) AS draws FROM w WHERE floor(e) + CASE WHEN u < e - floor(e) THEN 1 ELSE 0 END > 0"""
)
def weighted_draws(spark, sf):
    s = splits.weighted_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 500)
    return s.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("draws"))


@query("WITH u AS (SELECT c_custkey AS key, c_nationkey AS nation, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier) SELECT * FROM u ORDER BY md5('42:' || key), key")
def reshuffled_union(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return splits.reshuffled([c, s], "key")


@query("WITH f AS (SELECT user_id FROM events GROUP BY user_id ORDER BY min(event_id), user_id LIMIT 20) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM f)")
def quota_scan(spark, sf):
    return splits.first_keys(table(spark, sf, "events").select("event_id", "user_id"), "user_id", "event_id", 20)


@query("SELECT 'm/checkpoint-' || max(o_orderkey) AS path, max(o_orderkey) AS number FROM orders")
def newest_checkpoint(spark, sf):
    names = table(spark, sf, "orders").select(F.concat(F.lit("m/checkpoint-"), F.col("o_orderkey").cast("string")).alias("path"))
    return registry.newest(names.union(names.select(F.lit("m/other-99999999"))).union(names.select(F.lit("m/checkpoint-"))))


def _tasks(spark, sf):
    n = F.col("event_id") % 4
    return table(spark, sf, "events").select(F.concat(F.lit("T-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("task_id"), F.col("ts").alias("started_at"), F.when(n == 0, "running").when(n == 1, "failed").otherwise("done").alias("status"))


@query("SELECT 'T-' || lpad(event_id::VARCHAR, 9, '0') AS task_id, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'done' END AS status FROM events ORDER BY ts DESC NULLS LAST, task_id LIMIT 20")
def recent_tasks(spark, sf):
    return serve.recent_tasks(_tasks(spark, sf)).select("task_id", "status")


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 4 = 0) AS running, count(*) FILTER (event_id % 4 > 1) AS done, count(*) FILTER (event_id % 4 = 1) AS failed FROM events")
def task_counts(spark, sf):
    return serve.task_counts(_tasks(spark, sf))


@query("WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS status, o_totalprice AS w, o_custkey AS n FROM orders) SELECT round(sum(w) FILTER (status = 'ok'), 2) AS wall_s, sum(n) FILTER (status = 'ok')::BIGINT AS rows, round(sum(n) FILTER (status = 'ok') / sum(w) FILTER (status = 'ok'), 6) AS rows_per_s, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed FROM s")
def stage_summary(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status"), F.col("o_totalprice").alias("wall_s"), F.col("o_totalprice").alias("cpu_s"), F.col("o_custkey").alias("rows"))
    return metrics.stage_summary(o).select(F.round("wall_s", 2).alias("wall_s"), "rows", F.round("rows_per_s", 6).alias("rows_per_s"), "ok", "failed")


def _predictions(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.format_string("f%06d", "vec_id").alias("flow_uid"), scalar.label_name(F.col("label") % 8).alias("pred_label_name"))


@query("SELECT flow_uid, name AS pred_label_name FROM (SELECT 'f' || lpad(vec_id::VARCHAR, 6, '0') AS flow_uid, list_extract(['benign', 'adware', 'dns2tcp', 'dnscat2', 'iodine', 'ransomware', 'scareware', 'smsmalware'], label % 8 + 1) AS name FROM embeddings) WHERE name = 'iodine' ORDER BY flow_uid LIMIT 10 OFFSET 5")
def predictions_page(spark, sf):
    return serve.predictions_page(_predictions(spark, sf), 10, 5, "iodine")


@query("SELECT 'f' || lpad(vec_id::VARCHAR, 6, '0') AS flow_uid FROM embeddings ORDER BY flow_uid LIMIT 7 OFFSET 3")
def metadata_page(spark, sf):
    return serve.metadata_page(_predictions(spark, sf), 7, 3).select("flow_uid")


@query("SELECT 'f' || lpad(vec_id::VARCHAR, 6, '0') AS flow_uid, 'adware' AS pred_label_name FROM embeddings WHERE label % 8 = 1")
def label_filter(spark, sf):
    p = _predictions(spark, sf)
    return p.where(F.col("pred_label_name") == "adware").select(id_column(p), "pred_label_name")


@query("SELECT r_name AS section, n_name AS name, CAST(n_nationkey AS DOUBLE) AS f1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'weighted avg', CAST(r_regionkey AS DOUBLE) FROM region")
def evaluation(spark, sf):
    r = table(spark, sf, "region")
    n = table(spark, sf, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("section"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("f1"))
    w = r.select(F.col("r_name").alias("section"), F.lit("weighted avg").alias("name"), F.col("r_regionkey").cast("double").alias("f1"))
    return serve.evaluation(n.unionByName(w)).select("section", "name", "f1")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS sni, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'TLSv1.2' END AS tls_version, CASE WHEN event_id % 2 = 0 THEN 'CN=' || user_id END AS cert_subject FROM events")
def tls_details(spark, sf):
    """Wrapped and plain logs, single quotes, lists and absent ones."""
    n, e = F.col("event_id") % 4, F.col("event_type")
    ssl = F.when(n == 0, F.format_string('{"s": {"server_name": "%s", "version": "TLSv1.2"}}', e)).when(n == 1, F.format_string("{'server_name': '%s', 'version': 'TLSv1.2'}", e)).when(n == 2, F.format_string('[{"server_name": "%s", "version": "TLSv1.2"}]', e)).otherwise("{not valid json")
    x509 = F.when(n % 2 == 0, F.format_string('[{"certificate.subject": "CN=%d", "certificate.version": "3"}]', "user_id")).otherwise("-")
    t = extract.tls_details(table(spark, sf, "events").select("event_id", ssl.alias("zeek_ssl_log"), x509.alias("zeek_x509_log")))
    return t.select("event_id", "sni", "tls_version", "cert_subject")


@query(
    """WITH s AS (SELECT max(len(embedding)) AS n FROM embeddings), m AS (SELECT count(DISTINCT k) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events))
SELECT CAST(s.n + m.n AS INT) AS total, s.n / (s.n + m.n)::DOUBLE AS semantic, m.n / (s.n + m.n)::DOUBLE AS manual FROM s, m"""
)
def pool_shares(spark, sf):
    """A pool of the embeddings' components and the features named in the events' properties."""
    semantic = table(spark, sf, "embeddings").agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    manual = table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("k")).agg(F.count_distinct("k").alias("n")).first()["n"]
    s = serve.pool_shares(semantic, manual)
    return spark.createDataFrame([(s["total"], s["semantic"], s["manual"])], "total int, semantic double, manual double")
