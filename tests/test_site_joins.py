"""Tables with a row for each site meet by a shuffle, whatever their files hint at."""

from pyspark.sql import functions as F

from junctura.operators import evaluation as E, folds, ranking as R


def merges(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge")


def test_folds_ranks_and_correlations_pass_the_driver_by(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 7), i % 3) for i in range(60)], "site_id bigint, hit int, score double, label int")
    dealt = folds.stratified_folds(df, "site_id", "hit", 3, 42)
    assert merges(dealt) == 1 and dealt.count() == 60
    average = R.rank_average(df, ["score", "label"], "site_id")
    assert merges(average) == 2 and average.count() == 60
    rho = E.grouped_spearman(df.withColumn("split", F.lit("a")), ["split"], "score", "label")
    assert merges(rho) >= 1 and rho.count() == 1
