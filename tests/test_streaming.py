"""Review decisions as a stream: the same states as in batch."""

import random

from pyspark.sql import functions as F

from terraspan.operators import review
from terraspan.streaming import observations


def test_decisions_of_a_stream_are_those_of_the_log(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, rng.randrange(12), rng.randrange(50), rng.choice([*review.DECISIONS, "NOTE"])) for k in range(300)]
    schema = "seq long, candidate_id long, ts long, decision string"
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    for part in range(3):
        df = spark.createDataFrame(rows[part::3], schema).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(df.schema).parquet(log)
        observations.keep_decisions(stream, out, check).awaitTermination()
    got = {r.candidate_id: (r.decision, r.decisions) for r in observations.decided(spark, out).collect()}
    queue = spark.createDataFrame([(k, "NEW") for k in range(12)], "candidate_id long, status string")
    want = review.current_state(queue, spark.read.parquet(log)).where("decisions > 0").collect()
    assert got == {r.candidate_id: (r.decision, r.decisions) for r in want}
