"""A deterministic event table whose outcomes carry skill and difficulty."""

from pyspark.sql import functions as F

from obsexp.functions.hashing import fast_uniform

N_ENTITIES, SKILL_SD = 60, 0.25


def normal(seed, *cols):
    u, v = fast_uniform(seed, *cols), fast_uniform(seed + 1000, *cols)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)


def signal(spark, n=30000, seed=5, drift=0.0):
    base = spark.range(n, numPartitions=8).select(
        F.col("id").alias("event_id"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(N_ENTITIES)).alias("entity"),
        F.floor(F.col("id") / 40).alias("grp"), F.timestamp_seconds(F.lit(1400000000) + F.col("id") * 600).alias("ts"))
    base = base.withColumns({"x1": normal(seed + 1, "event_id"), "x2": normal(seed + 2, "event_id"),
                             "cat": F.element_at(F.array(*[F.lit(c) for c in "abc"]), (F.pmod("event_id", F.lit(3)) + 1).cast("int")),
                             "skill": SKILL_SD * normal(99, "entity")})
    logit = -0.2 + drift + 0.8 * F.col("x1") - 0.5 * F.col("x2") + F.when(F.col("cat") == "c", 0.4).otherwise(0.0) + F.col("skill")
    base = base.withColumn("p_true", 1 / (1 + F.exp(-logit)))
    return base.withColumn("made", (fast_uniform(seed + 3, "event_id") < F.col("p_true")).cast("int"))
