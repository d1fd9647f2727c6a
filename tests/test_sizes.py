"""Results that must not depend on the order or the number of rows."""

from pyspark.sql import functions as F

from examlattice.operators import analytics


def test_mean_scores_are_exact_whatever_the_order(spark):
    orders = [[32.1, 100.0, 68.8, 58.3, -16.7], [-16.7, 58.3, 68.8, 100.0, 32.1], [100.0, 9.4, 58.3, 58.3, 16.5], [58.3, 9.4, 58.3, 100.0, 16.5]]  # means 48.5 and 48.5; doubles give 48.49999999999999 for the first
    scores = spark.createDataFrame([(u, x) for u, own in enumerate(orders) for x in own], "user_id long, percent double").coalesce(1)
    answers = spark.range(len(orders)).select(F.col("id").alias("user_id"), F.lit("A").alias("selected_answer"), F.lit(True).alias("is_correct"), F.lit(10).alias("seconds"))
    assert {r.user_id: r.mean_score for r in analytics.overview(answers, scores).collect()} == {u: 48 for u in range(len(orders))}
    odd = scores.where("user_id < 2").withColumn("percent", F.col("percent") - 1)  # 47.5
    assert {r.mean_score for r in analytics.overview(answers.where("user_id < 2"), odd).collect()} == {48}


def test_mean_scores_of_two_tests_are_those_of_the_sql(spark):
    """Two doubles have one sum in whatever order: 41.7 and -16.7 give a little more than 25, and 13 where whole tenths gave 12."""
    import duckdb

    pairs = [[-16.7, 41.7], [41.7, -16.7], [12.5], [37.5], [33.3, 33.4], [62.4, 62.6], [None, 12.5], [None, None]]
    rows = [(u, x) for u, own in enumerate(pairs) for x in own]
    scores = spark.createDataFrame(rows, "user_id long, percent double").repartition(3)
    answers = spark.range(len(pairs)).select(F.col("id").alias("user_id"), F.lit("A").alias("selected_answer"), F.lit(True).alias("is_correct"), F.lit(10).alias("seconds"))
    values = ", ".join(f"({u}, {'NULL' if x is None else x}::DOUBLE)" for u, x in rows)
    want = dict(duckdb.sql(f"SELECT u, CAST(round_even(avg(x), 0) AS INT) FROM (VALUES {values}) AS t(u, x) GROUP BY u").fetchall())
    assert {r.user_id: r.mean_score for r in analytics.overview(answers, scores).collect()} == want and want[0] == want[1] == 13


def test_shuffles_of_responses_grow_with_the_lines(spark, monkeypatch):
    from examlattice import domain
    from examlattice.plans import oracles, queries

    import duckdb

    folder = "/root/testdata/sf0.001"
    rows = domain.n_lines(spark, folder)
    monkeypatch.setattr(domain, "TASK_ROWS", -(-rows // 9))
    duck = duckdb.connect()
    for t in ("part", "orders", "customer", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for sent in (0, 200_000):  # questions that are shuffled, and that are not
        monkeypatch.setattr(domain, "SENT_ROWS", sent)
        for name in ("subject_breakdown", "next_positions", "revision_schedule", "mistake_draw", "suspicion_cards"):
            found = queries.QUERIES[name](spark, folder)
            assert found.rdd.getNumPartitions() == 9 or name == "suspicion_cards"
            assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, duck.execute(oracles.ORACLES[name]).fetchall()))


def test_the_notebook_reads_the_responses_once(spark):
    from examlattice.operators import grading, revision
    from examlattice.plans import queries

    folder = "/root/testdata/sf0.001"
    for name in ("mistake_notebook", "notebook_counts", "notebook_revise"):
        plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [l_orderkey") == 1
    # few users and questions, so that folds are long; nobody's answers have no schedule
    r = queries.Tables(spark, folder).responses.withColumn("user_id", F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 3)).where("question_id < 40").localCheckpoint()
    days = r.where("selected_answer IS NOT NULL AND is_correct IS NOT NULL AND attempt_status != 'in_progress'").select("user_id", "question_id", F.col("started_at").cast("date").alias("day"), (F.col("attempt_id") * 100 + F.col("position")).alias("seq"), F.col("is_correct").alias("correct"), "confidence")
    apart = revision.notebook(r, grading.mistake_reasons(r), revision.schedule(days), queries.TODAY)
    once = revision.notebook_at_once(grading.with_reasons(r), queries.TODAY)
    assert sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))
    assert once.count() > 50


def test_practice_is_drawn_by_many_tasks(spark):
    """Few bytes and much work: requests that were grouped by user before must not be gathered in one task."""
    from examlattice.plans import oracles, queries

    import duckdb

    folder = "/root/testdata/sf0.001"
    found = queries.QUERIES["practice_draw"](spark, folder)
    assert found.rdd.getNumPartitions() == 4
    assert len({r.p for r in found.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1
    duck = duckdb.connect()
    for t in ("part", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(duck.execute(oracles.ORACLES["practice_draw"]).fetchall())


def test_a_task_has_no_more_lines_than_it_should(spark, monkeypatch):
    """Also where the session has more shuffle partitions than the lines call for, which Spark would gather."""
    from examlattice import domain
    from examlattice.plans import queries

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(domain, "TASK_ROWS", -(-domain.n_lines(spark, folder) // 3))
    for name in ("revision_schedule", "mistake_draw"):
        assert queries.QUERIES[name](spark, folder).rdd.getNumPartitions() == 4
