"""An access log derived from the event and page tables, as a relation and as log text.

The texts below are plain SQL that Spark and DuckDB both run, so one definition feeds a query
and its check. ``{events}``, ``{pages}`` and ``{access_log}`` stand for the input relations.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sinks.files import SharedFiles

ACCESS_LOG_SQL = """
SELECT e.event_id, e.user_id,
  date_trunc('second', e.ts) AS utc_ts,
  CAST(e.ts AS DATE) AS utc_date,
  CASE e.event_id % 11
    WHEN 0 THEN '/arcgis/rest/services/Hosted/layer' || CAST(e.user_id % 7 AS VARCHAR(9)) || '/FeatureServer/0/query'
    WHEN 1 THEN '/Mimas/rest/services/basemap' || CAST(e.user_id % 5 AS VARCHAR(9)) || '/MapServer/export'
    WHEN 2 THEN '/mimas/admin/machines'
    WHEN 3 THEN '/portal/sharing/rest/content/items/item' || CAST(e.user_id % 9 AS VARCHAR(9)) || '/data'
    WHEN 4 THEN '/portal/sharing/rest/content/users/u' || CAST(e.user_id AS VARCHAR(9)) || '/items/item' || CAST(e.user_id % 9 AS VARCHAR(9))
    WHEN 5 THEN '/portal/sharing/rest/content/users/u' || CAST(e.user_id AS VARCHAR(9)) || '/fold/items/item' || CAST(e.user_id % 9 AS VARCHAR(9)) || '/update'
    WHEN 6 THEN CASE WHEN e.user_id % 5 = 0 THEN '/portal/sharing/rest/community/self'
      ELSE '/portal/sharing/rest/community/users/User' || CAST(e.user_id + e.event_id % 2 AS VARCHAR(9)) || '%40x' END
    WHEN 7 THEN '/portal/sharing/rest/content/users/u' || CAST(e.user_id AS VARCHAR(9)) || '/deleteItems'
    WHEN 8 THEN '/'
    WHEN 9 THEN '//averyveryverylongrootname/x' || CAST(e.user_id % 3 AS VARCHAR(9))
    ELSE '/rhea/rest/services'
  END AS uri_stem,
  CASE e.user_id % 4
    WHEN 0 THEN 'Mozilla/5.0+(X11)+A'
    WHEN 1 THEN 'ArcGIS-FieldMaps/24.1+(iOS+17.5;+iPhone)+(' || upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) || ')'
    WHEN 2 THEN 'Survey123/3.19+AppFramework/5.6+(Android+13;+en_CA;+' || h || ')'
    ELSE 'ArcGISRuntime-Qt/200+(iOS;+Survey123+3)'
  END AS user_agent,
  CASE WHEN e.event_id % 7 = 0 THEN '-' ELSE p.url END AS referer,
  CASE e.event_id % 8
    WHEN 1 THEN '-'
    WHEN 2 THEN '10.1.2.3'
    WHEN 3 THEN '10.1.2.3:443'
    WHEN 4 THEN '10.1.2.4,+10.9.9.9'
    WHEN 5 THEN '2001:db8::1'
    WHEN 6 THEN '[2001:db8::2]:443'
    WHEN 7 THEN 'not-an-ip'
  END AS forwarded_for,
  CASE WHEN e.event_type = 'error' THEN 500 WHEN e.event_id % 13 = 0 THEN 404 ELSE 200 END AS status,
  CAST(round(e.value * 1000) AS INT) AS time_taken_ms
FROM (
  SELECT *, md5(CAST(user_id AS VARCHAR(20))) AS h, event_id % (SELECT count(*) FROM {pages}) AS target_page
  FROM {events}
) e LEFT JOIN {pages} p ON p.page_id = e.target_page
"""

# Two files per day, by parity of event_id. A header precedes one event in twenty of each file,
# with three field lists in turn, so most files start with lines that have no header yet. The
# even file of each 17th has no header, a header of the odd file of each 13th lacks a field.
# Remark and blank lines, and five kinds of broken lines, are mixed in.
LOG_LINES_SQL = """
WITH l AS (
  SELECT *,
    'u_ex' || replace(substr(CAST(utc_date AS VARCHAR(10)), 3, 8), '-', '') || '_x_' || CAST(event_id % 2 AS VARCHAR(1)) || '.log' AS file,
    (event_id - event_id % 40) % 120 AS variant,
    event_id % 97 AS slip,
    CASE WHEN event_id % 97 = 6 THEN '2024-02-30' ELSE CAST(utc_date AS VARCHAR(10)) END AS d,
    substr(CAST(utc_ts AS VARCHAR(19)), 12, 8) AS t,
    CASE WHEN event_id % 97 IN (7, 9) THEN '2x0' ELSE CAST(status AS VARCHAR(9)) END AS s,
    CASE WHEN event_id % 97 IN (8, 9) THEN '1.5' ELSE CAST(time_taken_ms AS VARCHAR(12)) END AS tt,
    coalesce(forwarded_for, '-') AS xff
  FROM {access_log}
)
SELECT file, event_id,
  CASE WHEN event_id % 40 <> event_id % 2 OR (day(utc_date) = 17 AND event_id % 2 = 0) THEN NULL
    WHEN event_id % 40 = 1 AND day(utc_date) = 13
      THEN '#Fields: date time cs-uri-stem cs(User-Agent) sc-status time-taken'
    WHEN variant = 0 THEN '#Fields: date time cs-uri-stem cs(User-Agent) cs(Referer) sc-status time-taken X-Forwarded-For'
    WHEN variant = 40 THEN '#fields:  time date sc-status Time-Taken cs-uri-stem cs(referer) cs(user-agent)'
    ELSE '#Fields: date time s-ip cs-method cs-uri-stem cs-uri-query s-port cs-username c-ip cs(User-Agent) cs(Referer) sc-status sc-substatus sc-win32-status time-taken X-Forwarded-For'
  END AS header,
  CASE WHEN event_id % 50 = 3 THEN '#Remark: nothing' END AS remark,
  CASE WHEN event_id % 50 = 4 THEN '   ' END AS blank,
  CASE WHEN slip = 5 THEN d || ' ' || t || ' ' || uri_stem
    WHEN variant = 0 THEN d || ' ' || t || ' ' || uri_stem || ' ' || user_agent || ' ' || referer || ' ' || s || ' ' || tt || ' ' || xff
    WHEN variant = 40 THEN t || ' ' || d || ' ' || s || ' ' || tt || '  ' || uri_stem || ' ' || referer || ' ' || user_agent
    ELSE d || ' ' || t || ' 10.0.0.1 GET ' || uri_stem || ' - 443 - 10.0.0.9 ' || user_agent || ' ' || referer || ' ' || s || ' 0 0 ' || tt || ' ' || xff
  END AS data
FROM l
"""


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access-log relation, with the columns of a request and its file date."""
    return spark.sql(
        ACCESS_LOG_SQL,
        events=spark.read.parquet(f"{sf_dir}/events.parquet"),
        pages=spark.read.parquet(f"{sf_dir}/pages.parquet"),
    ).withColumn("utc_ts", F.col("utc_ts").cast("timestamp_ntz"))


def as_requests(log: DataFrame) -> DataFrame:
    """The access log as requests: one file per UTC date, lines ordered by event."""
    return log.select(
        F.concat(F.lit("u_ex"), F.date_format("utc_date", "yyMMdd"), F.lit(".log")).alias("file"),
        F.col("utc_date").alias("file_utc_date"),
        F.lit(0).cast("long").alias("block_start"),
        F.col("event_id").alias("line_id"),
        "utc_ts",
        "uri_stem",
        "user_agent",
        "referer",
        "status",
        "time_taken_ms",
        "forwarded_for",
    )


def log_lines(log: DataFrame) -> DataFrame:
    """The access log as text lines, in the shape :func:`..sources.lines.read_log_lines` gives;
    a split holds 200 consecutive events."""
    per_event = log.sparkSession.sql(LOG_LINES_SQL, access_log=log)
    order = W.partitionBy("file", "block_start").orderBy("event_id", "kind")
    return (
        per_event.select(
            "file",
            "event_id",
            (F.col("event_id") - F.col("event_id") % 200).alias("block_start"),
            F.posexplode(F.array("header", "remark", "blank", "data")).alias("kind", "line"),
        )
        .where(F.col("line").isNotNull())
        .withColumn("line_id", F.row_number().over(order).cast("long"))
        .select("file", "block_start", "line_id", "line")
    )


def clean_lines(log: DataFrame, rows_per_file: int = 100_000) -> DataFrame:
    """``(file, event_id, kind, line)``: the access log as well-formed files of bounded length, a
    header first in each. A request whose forwarded-for is undeclared goes to a file without that
    field."""
    declared = F.col("forwarded_for").isNotNull()
    number = F.floor(F.col("event_id") / rows_per_file).cast("string")
    piece = F.concat(number, F.when(declared, "a").otherwise("b"))
    text = [F.date_format("utc_ts", "yyyy-MM-dd HH:mm:ss")] + [
        F.col(c).cast("string") for c in ("uri_stem", "user_agent", "referer", "status", "time_taken_ms")
    ]
    rows = log.select(
        F.concat(F.lit("u_ex"), F.date_format("utc_date", "yyMMdd"), F.lit("_x_"), piece, F.lit(".log")).alias("file"),
        "event_id",
        declared.alias("declared"),
        F.lit(1).alias("kind"),
        F.concat_ws(" ", *text, "forwarded_for").alias("line"),
    )
    fields = F.lit("#Fields: date time cs-uri-stem cs(User-Agent) cs(Referer) sc-status time-taken")
    heads = rows.groupBy("file").agg(
        F.min("event_id").alias("event_id"),
        F.lit(0).alias("kind"),
        F.when(F.first("declared"), F.concat(fields, F.lit(" X-Forwarded-For"))).otherwise(fields).alias("line"),
    )
    return heads.unionByName(rows.drop("declared"))


def write_log_files(lines: DataFrame, directory: str) -> str:
    """Write lines as ``<directory>/<file>``, one task per file; gives the directory."""
    staging = f"{directory}/staging"
    (
        lines.repartition("file")
        .sortWithinPartitions("file", "event_id", "kind")
        .select("file", "line")
        .write.partitionBy("file")
        .text(staging)
    )
    files = SharedFiles(lines.sparkSession, directory)
    parts = files.glob(f"{staging}/file=*/part-*")
    files.move({part: f"{directory}/{part.split('/file=')[1].split('/')[0]}" for part in parts})
    files.delete(staging)
    return directory


def local_date_span(log: DataFrame) -> tuple[date, date]:
    """First and last local date any request can fall on."""
    first, last = log.agg(F.min("utc_date"), F.max("utc_date")).first()
    return first - timedelta(days=1), last + timedelta(days=1)
