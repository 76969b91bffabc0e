"""A profile works its rows out once."""

from pyspark.sql import functions as F

from eigenframe.operators import quality
from eigenframe.roles import Roles


def test_rows_of_a_profile_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 1.5).alias("b"), F.when(F.col("id") % 3 > 0, "x").alias("c"))
    df = df.mapInArrow(count, df.schema)
    out = quality.profile(df, Roles(("a", "b"), ("c",), (), None, None, ("a", "b", "c")))
    assert made.value == 200
    assert out.rows == 200 and out.duplicates == 0 and out.columns.count() == 3
