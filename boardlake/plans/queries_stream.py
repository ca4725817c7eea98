"""Registered streaming query: results land as files, stream into running score frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matchpoints as mp
from ..sources import fixtures
from ..streaming import scores as ST
from .boards import scored_results
from .queries_mp import FREQ_CTE, FREQ_MP_BODY
from .oracle import sql_scored_results, with_fixtures
from .registry import register


@register(
    "stream_event_time",
    "T1,T2",
    with_fixtures(["board_results"], sql_scored_results(), """
select session_id, board, score_ns, count(*) n, 'counted' kind from scored where score_ns is not null and epoch_ms(result_time) >= epoch_ms(timestamp '1995-01-01')
  group by all
union all select session_id, board, score_ns, count(*) n, 'late' kind from scored where result_time < timestamp '1995-01-01' group by all"""),
)
def q_stream_event_time(spark, sf_dir):
    """Results land by event time: those from 1995 on first, then all of them again; the older ones are late by then and go to the side table."""
    res = scored_results(fixtures.board_results(spark, sf_dir))
    landed = res.select("session_id", "board", "l_orderkey", "l_linenumber", "l_partkey", "score_ns", F.col("result_time").cast("timestamp").alias("result_time"))
    src, root = ST.scratch_path(spark, "landing"), ST.scratch_path(spark, "stream")
    newest = landed.where("result_time >= timestamp '1995-01-01'")
    ids = ["session_id", "board", "l_orderkey", "l_linenumber", "l_partkey", "result_time"]
    days = f"{newest.agg(F.datediff(F.max('result_time'), F.lit('1995-01-01'))).first()[0]} days"
    for rows in (newest, landed):
        rows.write.mode("append").parquet(src)
        counts = ST.land_within(ST.stream_files(spark, src, landed.schema), ids, "result_time", days, ["session_id", "board"], "score_ns", root, grain="year")
    late = spark.read.schema(landed.schema).parquet(f"{root}/late").groupBy("session_id", "board", "score_ns").agg(F.count("*").alias("n"))
    return counts.withColumn("kind", F.lit("counted")).unionByName(late.withColumn("kind", F.lit("late"))).select("session_id", "board", "score_ns", "n", "kind")


@register("stream_mp_frequency", "T1,T2,A9", with_fixtures(["board_results"], FREQ_CTE, FREQ_MP_BODY))
def q_stream_mp_frequency(spark, sf_dir):
    """Scored results land as parquet files, every file twice; a file stream lands each result once and counts the scores of
    what is new; matchpoints are computed from the running frequencies."""
    res = scored_results(fixtures.board_results(spark, sf_dir))
    landed = res.select("session_id", "board", "l_orderkey", "l_linenumber", "l_partkey", "score_ns",
                        F.col("result_time").cast("timestamp").alias("result_time"))
    src = ST.scratch_path(spark, "landing")
    landed.write.mode("overwrite").parquet(src)
    # a second delivery of the same results: must not be counted twice
    landed.write.mode("append").parquet(src)
    stream = ST.stream_files(spark, src, landed.schema)
    freq = ST.land_and_count(stream, ["session_id", "board", "l_orderkey", "l_linenumber", "l_partkey", "result_time"], ["session_id", "board"], "score_ns",
                             ST.scratch_path(spark, "stream"))
    out = mp.matchpoints_from_frequency(freq, ["session_id", "board"], "score_ns", "n")
    return out.select("session_id", "board", "score_ns", "n", "beaten", "mp_ns", "mp_ew", "pct_ns", "pct_ew")
