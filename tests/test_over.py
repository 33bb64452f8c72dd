from pyspark.sql import functions as F

from millrace.functions.tokens import SignTokens


def test_over_is_what_counting_says(spark):
    rows = spark.createDataFrame([("a b c",), ("İ!İ!",), ("",), (None,), ("abc",), ("a.b.c.d",), ("Ünï",)], "t string")
    for most in range(8):
        assert rows.where(~SignTokens().over(F.col("t"), most).eqNullSafe(SignTokens().count(F.col("t")) > most)).count() == 0
