from pyspark.sql import functions as F

from corpusprep.operators.ordered import global_index, group_index


def test_global_index_of_three_million_rows_with_a_payload(spark):
    df = spark.range(3_000_000).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("x"), 20).alias("payload"))
    out = global_index(df, ["k"], total_col="n")
    r = out.agg(F.count_distinct("index").alias("d"), F.min("index").alias("lo"), F.max("index").alias("hi"), F.max("n").alias("n"),
                F.max(F.length("payload")).alias("p")).first()
    assert (r.d, r.lo, r.hi, r.n, r.p) == (3_000_000, 0, 2_999_999, 3_000_000, 20)
    # in order: the rows below a bound are those with the smallest positions
    below = out.where("k < 0")
    assert below.agg(F.max("index") + 1).first()[0] == below.count()


def test_group_index(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k"))
    for r in group_index(df, ["g"], ["k"]).collect():
        assert int(r.k[1:]) == r["index"] * 7 + r.g


def test_empty(spark):
    assert global_index(spark.range(0), ["id"]).collect() == []


def test_positions_in_a_huge_group_do_not_shuffle_it_by_group(spark):
    df = spark.range(3000).selectExpr("'g' AS g", "id AS k")
    out = group_index(df, ["g"], ["k"])
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert [r["index"] for r in out.orderBy("k").collect()] == list(range(3000))
