"""A key holding a large share of the rows: results stay whole and exact."""

from pyspark.sql import functions as F

from scriptorium.operators import mutate as M
from scriptorium.operators import relations as R
from scriptorium.operators import search as S


def test_first_per_key_hot_key(spark):
    n = 30000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                               F.col("id").alias("seq")).repartition(8)
    first, rest = R.split_first_per_key(df, ["k"], ["seq"])
    f = {r.k: r.seq for r in first.collect()}
    assert f[0] == 0 and len(f) == 1 + (n - n // 3)
    assert rest.count() == n // 3 - 1                      # every other row of the hot key
    last = {r.k: r.seq for r in R.first_per_key(df, ["k"], ["seq"], last=True).collect()}
    assert last[0] == n - 3


def test_insert_links_hot_paper(spark):
    # one paper holds a third of all link rows (duplicates included)
    rows = [(i % 500, 1, i) for i in range(3000)] + [(i, 2 + i, 0) for i in range(6000)]
    inc = spark.createDataFrame(rows, "author_id long, paper_id long, author_position int")
    held = spark.createDataFrame([(1, 1)], "author_id long, paper_id long")
    ok, bad = M.insert_links(held, inc, ["author_id", "paper_id"], ["author_position"])
    assert ok.filter("paper_id = 1").count() == 499          # 500 authors minus the held one
    assert ok.count() == 499 + 6000
    assert bad.count() == 3000 - 499
    kept = {r.author_id: r.author_position for r in ok.filter("paper_id = 1").collect()}
    assert all(kept[a] == a for a in kept)                   # first position kept


def test_hot_term_postings_and_match(spark):
    docs = spark.createDataFrame([(i, f"{i:06d}", "the title", ("the " * (i % 7 + 1)) + f"w{i}", "", "")
                                  for i in range(2000)],
                                 "paper_id long, archive_id string, title string, abstract string, "
                                 "keywords string, authors string")
    idx = S.build_postings(docs)
    the = idx.postings.filter("term = 'the'").groupBy("field").agg(F.sum("tf").alias("n")).collect()
    assert {r.field: r.n for r in the} == {"title": 2000, "abstract": sum(i % 7 + 1 for i in range(2000))}
    assert S.match_count(idx, S.all_of("the", "w17")).first().total == 1
    page = S.search_page(idx, S.term("the"), limit=5).collect()
    assert len(page) == 5


def test_group_positions_hot_group_matches_window(spark):
    from pyspark.sql import Window
    n = 20000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("g"),
                               (F.col("id") * 7919 % n).alias("o")).repartition(6)
    got = {(r.g, r.o): r.pos for r in R.group_positions(df, "g", ["o"], "pos", hot_rows=1000).collect()}
    got_cold = {(r.g, r.o): r.pos for r in R.group_positions(df, "g", ["o"], "pos").collect()}
    assert got_cold == got
    ref = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    want = {(r.g, r.o): r.pos for r in ref.collect()}
    assert got == want


def test_group_positions_without_hot_groups_take_one_window(spark):
    df = spark.createDataFrame([(i % 7 or None, i) for i in range(100)], "g long, o long")
    got = R.group_positions(df, "g", ["o"], "pos")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan and plan.count("Window") == 1
    assert sorted(r.pos for r in got.filter("g IS NULL").collect()) == list(range(1, 16))
    # counting a frame of more rows may only change how the positions are found
    many = R.group_positions(df, "g", ["o"], "pos", hot_rows=20, counted=df.unionByName(df))
    assert got.columns == many.columns == ["g", "o", "pos"]
    assert sorted(map(str, many.collect())) == sorted(map(str, got.collect()))


def test_listing_rows_are_listed_where_their_page_is(spark):
    from scriptorium.sources import html as H
    plan = H.render_listing_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    top = plan[:plan.index("SortMergeJoin") if "SortMergeJoin" in plan else plan.index("Join")]
    assert top.count("RepartitionByExpression") + top.count("Exchange hashpartitioning(page") == 1
    assert top.index("collect_list") < top.index("Exchange hashpartitioning(page")


def test_numbers_are_dense_and_distinct_at_size(spark, tmp_root):
    n = 2_000_000
    payload = F.concat(F.lit("payload "), F.sha2(F.col("id").cast("string"), 256))
    spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1)
                          .alias("g"), payload.alias("p")).write.parquet(f"{tmp_root}/rows")
    df = spark.read.parquet(f"{tmp_root}/rows")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = R.dense_index(df, ["k"], "i").agg(F.countDistinct("i").alias("d"), F.min("i").alias("a"), F.max("i").alias("z"),
                                                F.count_if(F.col("i") != F.col("k")).alias("off")).first()
        assert tuple(got) == (n, 0, n - 1, 0)
        held = spark.createDataFrame([(5,)], "paper_id long")
        ids = M.assign_ids(df, held, "paper_id", ["k"]).agg(F.countDistinct("paper_id").alias("d"), F.max("paper_id").alias("z")).first()
        assert tuple(ids) == (n, n + 5)
        hot = R.group_positions(df, "g", ["k"], "pos", hot_rows=100_000).groupBy("g").agg(
            F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("z"), F.sum(F.xxhash64("pos", "k") % 1009).alias("h"))
        cold = R.group_positions(df, "g", ["k"], "pos").groupBy("g").agg(
            F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("z"), F.sum(F.xxhash64("pos", "k") % 1009).alias("h"))
        assert sorted(map(tuple, hot.collect())) == sorted(map(tuple, cold.collect()))
        assert all(r.n == r.d == r.z for r in cold.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_no_row_is_lost_between_first_and_rest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 5, "a"), (2, None, "b"), (None, 1, "c"), (None, 1, "c")],
                               "k long, seq long, v string")
    first, rest = R.split_first_per_key(df, ["k"], ["seq"])
    assert first.count() == 3 and rest.count() == 3
