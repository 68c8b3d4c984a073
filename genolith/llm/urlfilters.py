"""URL filters by dated lists: validity intervals, and an as-of join of every capture with the entries active at its fetch.

A list is a log of events (entry, verdict, since): an event holds until the entry's next one, and a null verdict takes
the entry off the list. Entries are domains, which also hold for their subdomains, or a host with a path
prefix of whole segments. The most specific active entry wins: paths over domains, longer over shorter ones.

A capture meets the list once for each number of labels or path segments that any entry has, in an equi-join with the
as-of condition; an entry has one interval at a time, so a join never multiplies captures and needs no aggregation
after it. The list is broadcast while it is small (BROADCAST_ENTRIES); beyond that the joins shuffle, and Spark splits
skewed hosts.

Defined cases. Null, empty or unparsable url, or null fetch time: no entry, kept. Repeated captures each get their
verdict. Several events of an entry at the same time: `block` wins over `allow`, and both over a removal. Empty list:
all kept. Empty captures: no rows. Hosts are lower-cased; credentials, port, query and fragment are left out. All
columns of the captures are kept unless they clash with host, entry, verdict or kept, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Intervals that are broadcast.
BROADCAST_ENTRIES = 500_000

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"

#: A small dated list for the query below: entry, verdict (None: taken off), since.
EVENTS = [
    ("spam-farm.example.org", "block", "2024-02-01"),
    ("spam-farm.example.org", None, "2024-09-01"),
    ("spam-farm.example.org", "block", "2024-11-01"),
    ("example.net", "block", "2024-03-01"),
    ("example.net", None, "2024-06-15"),
    ("blog.ththan.example.net", "allow", "2024-04-01"),
    ("example.com", "allow", "2024-01-15"),
    ("therin.example.net/en", "block", "2024-05-01"),
    ("m.therou.example.com/en", "block", "2024-01-20"),
    ("m.therou.example.com/en", "allow", "2024-08-20"),
]


def validity(events: DataFrame) -> DataFrame:
    """entry, verdict, valid_from, valid_to (exclusive, NULL: open) of the times at which an entry is on the list."""
    rank = F.when(F.col("verdict") == "block", 2).when(F.col("verdict").isNotNull(), 1).otherwise(0)
    one = events.where("entry is not null and since is not null").withColumn("entry", F.lower("entry")).groupBy("entry", "since").agg(F.max_by("verdict", rank).alias("verdict"))
    until = F.lead("since").over(Window.partitionBy("entry").orderBy("since"))
    return one.select("entry", "verdict", F.col("since").alias("valid_from"), until.alias("valid_to")).where("verdict is not null")


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def evaluate(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures with host, entry and verdict (NULL: none is active) and kept (not blocked)."""
    active = validity(events)
    shape = active.select(F.col("entry").contains("/").alias("path"), (F.size(F.split("entry", "/")) - 1).alias("segments"), F.size(F.split("entry", r"\.")).alias("labels"))
    levels = shape.select("path", F.when(F.col("path"), F.col("segments")).otherwise(F.col("labels")).alias("n")).distinct().collect()  # a few small numbers
    few = active.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    out = captures.drop("host", "entry", "verdict", "kept").withColumn("host", host_of(F.col(url)))
    path = F.filter(F.split(F.regexp_extract(F.col(url), PATH, 1), "/"), lambda x: x != "")
    found = []
    for k, (is_path, n) in enumerate(sorted(((r.path, r.n) for r in levels), reverse=True)):  # most specific first
        if is_path:
            key = F.when(F.size(path) >= n, F.concat_ws("/", "host", F.lower(F.array_join(F.slice(path, 1, n), "/"))))
        else:
            labels = F.split("host", r"\.")
            key = F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), "."))
        own = active.where((F.col("entry").contains("/") & (F.size(F.split("entry", "/")) - 1 == n)) if is_path else (~F.col("entry").contains("/") & (F.size(F.split("entry", r"\.")) == n)))
        own = own.select(F.col("entry").alias(f"__e{k}"), F.col("verdict").alias(f"__v{k}"), F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"))
        at = F.col(fetched)
        on = (F.col(f"__k{k}") == F.col(f"__e{k}")) & (at >= F.col("__from")) & (F.col("__to").isNull() | (at < F.col("__to")))
        out = out.withColumn(f"__k{k}", key).join(F.broadcast(own) if few else own, on, "left").drop("__from", "__to", f"__k{k}")
        found.append(k)
    first = lambda c: F.coalesce(*(F.col(f"__{c}{k}") for k in found)) if found else F.lit(None).cast("string")
    out = out.withColumn("entry", first("e")).withColumn("verdict", first("v")).drop(*(f"__{c}{k}" for k in found for c in "ev"))
    return out.withColumn("kept", ~F.coalesce(F.col("verdict") == "block", F.lit(False)))


def events_frame(spark: SparkSession, events=EVENTS) -> DataFrame:
    return spark.createDataFrame(events, "entry string, verdict string, since string").withColumn("since", F.to_date("since"))


def op4_dated_lists(spark, sf_dir: str) -> DataFrame:
    """Every page, captured on a day that follows from its number, against the list of that day."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched_at"))
    return evaluate(pages, events_frame(spark)).select("page_id", "url", F.col("fetched_at").cast("string").alias("fetched_at"), "host", "entry", "verdict", "kept")


def _values() -> str:
    return ", ".join(f"('{e}', {'NULL' if v is None else repr(v)}, DATE '{d}')" for e, v, d in EVENTS)


OP4_SQL = rf"""
WITH ev(entry, verdict, since) AS (VALUES {_values()}),
act AS (SELECT * FROM (SELECT entry, verdict, since AS valid_from, lead(since) OVER (PARTITION BY entry ORDER BY since) AS valid_to FROM ev) WHERE verdict IS NOT NULL),
cap AS (SELECT row_number() OVER () AS k, page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS fetched_at, nullif(regexp_extract(lower(url), '{HOST}', 1), '') AS host, regexp_extract(url, '{PATH}', 1) AS path FROM pages),
hit AS (SELECT k, entry, verdict, row_number() OVER (PARTITION BY k ORDER BY CAST(contains(entry, '/') AS INT) DESC, length(entry) DESC) AS r FROM cap JOIN act
  ON fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
  AND CASE WHEN contains(entry, '/') THEN starts_with(host || lower(path) || '/', entry || '/') ELSE host = entry OR ends_with(host, '.' || entry) END)
SELECT page_id, url, CAST(fetched_at AS VARCHAR) AS fetched_at, host, entry, verdict, coalesce(verdict <> 'block', true) AS kept FROM cap LEFT JOIN (SELECT * FROM hit WHERE r = 1) USING (k)
"""
