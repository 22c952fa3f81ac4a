"""The request pipeline: batch models of its queues and caches, and a Structured Streaming job over the events.

A micro-batch stores arrived tiles before it answers requests; requests for one tile in a batch are one request. What has arrived
in any earlier batch is in the store as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered
from tessera.plans.dialect import Family, fixture, run

FAMILY = Family()
same, own = FAMILY.same, FAMILY.own
_KEY = "fileid, scale, x, y"
KEYS = ["fileid", "scale", "x", "y"]

same("coalesce_requests", f"select fileid, min(req_id) as first_request, count(*) as requests, count(distinct concat(cast(scale as string), '/', cast(x as string), '/', cast(y as string))) as tiles, min(scale) as min_scale from img_requests where kind = 'request' group by fileid")


@own("flush_batches", "with n as (select req_id, row_number() over (order by req_id) as n from img_requests where kind = 'arrive') select cast((n - 1) ~/ 257 as bigint) as batch, count(*) as tiles, min(req_id) as first_id, max(req_id) as last_id from n group by (n - 1) ~/ 257")
def flush_batches(spark: SparkSession, sf_dir: str, limit: int = 256) -> DataFrame:
    """Arrived tiles are written when more than ``limit`` are held."""
    arrived = numbered(fixture(spark, sf_dir, "img_requests").where("kind = 'arrive'").select("req_id"), "req_id", "n")
    batch = F.expr(f"(n - 1) div {limit + 1}").alias("batch")
    return arrived.groupBy(batch).agg(F.count("*").alias("tiles"), F.min("req_id").alias("first_id"), F.max("req_id").alias("last_id"))


@own("round_robin_jobs", "select req_id, cast((row_number() over (order by req_id) - 1) % 2 as int) as worker, cast((row_number() over (order by req_id) - 1) ~/ 2 as bigint) as place from img_requests where kind = 'request'")
def round_robin_jobs(spark: SparkSession, sf_dir: str, workers: int = 2) -> DataFrame:
    jobs = numbered(fixture(spark, sf_dir, "img_requests").where("kind = 'request'").select("req_id"), "req_id", "n")
    return jobs.selectExpr("req_id", f"cast((n - 1) % {workers} as int) as worker", f"(n - 1) div {workers} as place")


# -- the tile cache ------------------------------------------------------------------------------------------------------
def cached_tiles(events: DataFrame) -> DataFrame:
    """The entries of a tile cache after events(req_id, fileid, scale, x, y, kind), with status and number of events.

    A request enters a tile as REQUESTED unless it is there, an arrival makes it SUCCEEDED, and an abort takes out a requested tile
    but none that has arrived. So an entry that ever arrived has succeeded, and others are requested if a request follows the last
    abort; that is known from three values, which merge from parts.
    """
    last = lambda kind: F.expr(f"max(req_id) filter (where kind = '{kind}')").alias(kind)
    seen = events.groupBy(*KEYS).agg(last("request"), last("abort"), last("arrive"), F.count("*").alias("events"))
    status = F.expr("case when arrive is not null then 'SUCCEEDED' when request > coalesce(abort, request - 1) then 'REQUESTED' end")
    return seen.select(*KEYS, status.alias("status"), "events").where("status is not null")


def after_cleanup(cache: DataFrame, min_keep_scale: int) -> DataFrame:
    """Requested tiles are aborted and leave; of arrived ones those below the scale that is kept leave."""
    return cache.where(f"status = 'SUCCEEDED' and scale >= {min_keep_scale}")


def with_cancelled(cache: DataFrame, scale: int, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Entries with whether a view of this scale and range of tiles cancels them: requested, and of another scale or outside."""
    inside = f"scale = {scale} and x >= {left} and x < {right} and y >= {top} and y < {bottom}"
    return cache.withColumn("cancelled", F.expr(f"status = 'REQUESTED' and not ({inside})"))


#: The same as a fold over the events of each tile, one by one.
_CACHE = f"""with e as (select {_KEY}, list(kind order by req_id) as kinds from img_requests group by {_KEY}),
c as (select {_KEY}, len(kinds) as events, list_reduce(list_prepend('none', kinds), lambda s, k : case when k = 'arrive' then 'SUCCEEDED' when s = 'SUCCEEDED' then s when k = 'request' then 'REQUESTED' else 'none' end) as status from e)"""


@own("tile_request_state", f"{_CACHE} select {_KEY}, status, events from c where status <> 'none'")
def tile_request_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached_tiles(fixture(spark, sf_dir, "img_requests"))


@own("cache_cleanup", f"{_CACHE} select {_KEY} from c where status = 'SUCCEEDED' and not scale < 4")
def cache_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after_cleanup(cached_tiles(fixture(spark, sf_dir, "img_requests")), 4).select(*KEYS)


@own("cancel_jobs", f"{_CACHE} select {_KEY}, status, status = 'REQUESTED' and (scale <> 2 or x not in (0, 1) or y not in (0, 1)) as cancelled from c where status <> 'none'")
def cancel_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cancelled(cached_tiles(fixture(spark, sf_dir, "img_requests")), 2, 0, 0, 2, 2).select(*KEYS, "status", "cancelled")


def job_states(cache: DataFrame) -> DataFrame:
    """Handles grouped by file: how many there are, have finished or are still asked for, and whether all have finished."""
    done = F.expr("count(*) filter (where status = 'SUCCEEDED')")
    return cache.groupBy("fileid").agg(F.count("*").alias("jobs"), done.alias("finished"), F.expr("count(*) filter (where status = 'REQUESTED')").alias("waiting"), (done == F.count("*")).alias("all_finished"))


@own("job_status", f"{_CACHE} select fileid, count(*) as jobs, sum(cast(status = 'SUCCEEDED' as bigint))::bigint as finished, sum(cast(status = 'REQUESTED' as bigint))::bigint as waiting, bool_and(status = 'SUCCEEDED') as all_finished from c where status <> 'none' group by fileid")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_states(cached_tiles(fixture(spark, sf_dir, "img_requests")))


same("job_all_aborted", f"select {_KEY}, min(case when kind = 'abort' then 1 else 0 end) = 1 as all_aborted from img_requests group by {_KEY}")


# -- late requests -------------------------------------------------------------------------------------------------------
def late_outcomes(requests: DataFrame, low: int, high: int) -> DataFrame:
    """What a generation job of levels low to high does with requests(.., scale, state, kept): a waiting job queues them, a running one
    answers those in its range at its end, a finished one those whose tile it has kept; an aborted one rejects them."""
    ranged = f"scale between {low} and {high}"
    outcome = f"case when state = 'waiting' then 'queued' when state = 'running' and {ranged} then 'answered at end' when state = 'done' and {ranged} and kept then 'answered' else 'rejected' end"
    return requests.withColumn("outcome", F.expr(outcome))


#: A file's job waits until its first tile arrives, runs until its last, and then is done; an abort that no arrival follows ends it.
_JOBS = """select q.req_id, q.scale, case when j.first_arrive is null and q.req_id > j.last_abort then 'aborted' when j.first_arrive is null or q.req_id < j.first_arrive then 'waiting' when q.req_id < j.last_arrive then 'running' when j.last_abort > j.last_arrive and q.req_id > j.last_abort then 'aborted' else 'done' end as state, t.req_id is not null and t.req_id < q.req_id as kept
from img_requests q left join (select fileid, min(case when kind = 'arrive' then req_id end) as first_arrive, max(case when kind = 'arrive' then req_id end) as last_arrive, max(case when kind = 'abort' then req_id end) as last_abort from img_requests group by fileid) j on j.fileid = q.fileid
left join (select fileid, scale, x, y, min(req_id) as req_id from img_requests where kind = 'arrive' group by fileid, scale, x, y) t on t.fileid = q.fileid and t.scale = q.scale and t.x = q.x and t.y = q.y where q.kind = 'request'"""


@own("late_requests", f"with j as ({_JOBS}) select req_id, state, 'queued' as outcome from j where state = 'waiting' union all select req_id, state, if(scale >= 1 and scale <= 4, 'answered at end', 'rejected') from j where state = 'running' union all select req_id, state, if(scale >= 1 and scale <= 4 and kept, 'answered', 'rejected') from j where state = 'done' union all select req_id, state, 'rejected' from j where state = 'aborted'")
def late_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_outcomes(run(spark, sf_dir, _JOBS), 1, 4).select("req_id", "state", "outcome")


# -- the stream ----------------------------------------------------------------------------------------------------------
def answer_batch(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """One answer for each tile requested in a batch, after the batch's own arrivals are stored."""
    known = stored.select(*KEYS).unionByName(batch.where("kind = 'arrive'").select(*KEYS)).distinct().withColumn("there", F.lit(True))
    wanted = batch.where("kind = 'request'").groupBy(*KEYS).agg(F.min("req_id").alias("req_id"))
    return wanted.join(known, KEYS, "left").select(*KEYS, "req_id", F.coalesce("there", F.lit(False)).alias("answered"))


@own("stream_tile_requests", f"with a as (select distinct {_KEY} from img_tiles where scale >= 3 union select distinct {_KEY} from img_requests where kind = 'arrive'), w as (select {_KEY}, min(req_id) as req_id from img_requests where kind = 'request' group by {_KEY}) select w.*, a.fileid is not null as answered from w left join a on a.fileid = w.fileid and a.scale = w.scale and a.x = w.x and a.y = w.y")
def stream_tile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = fixture(spark, sf_dir, "img_tiles").where("scale >= 3")
    return answer_batch(fixture(spark, sf_dir, "img_requests"), stored)


def request_stream(spark: SparkSession, source: str, schema: str, stored: DataFrame, target: str, checkpoint: str):
    """The job as a stream of Parquet event files. Each batch writes its arrivals to the store below ``target``, then answers from all
    that is stored. A batch that runs again after a failure replaces its own files, so it counts once."""
    kinds = stored.select(*KEYS).schema

    def handle(batch: DataFrame, number: int) -> None:
        batch.where("kind = 'arrive'").select(*KEYS).distinct().write.mode("overwrite").parquet(f"{target}/arrived/batch={number}")
        arrived = spark.read.schema(kinds).option("recursiveFileLookup", "true").parquet(f"{target}/arrived")
        answers = answer_batch(batch, stored.select(*KEYS).unionByName(arrived))
        answers.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/answers/batch={number}")

    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
