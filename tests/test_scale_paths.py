"""The forms for large groups and hot keys give what plain windows and joins give."""

import random
import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from tenderloom.operators import evaluation, labels, notices, ordered, search, store
from tenderloom.plans import evaluating


def events(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", i, rng.choice([None, 1.0, 2.0, 5.0]), rng.choice([None, "x", "y"])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, v double, s string").repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_row_numbers(small_groups):
    df = events(small_groups)
    for keys in ([], ["k"]):
        plain = df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("t")).cast("bigint"))
        assert rows(ordered.row_numbers(df, keys, ["t"], "n").select(*plain.columns)) == rows(plain)


def test_running_before(small_groups):
    df = events(small_groups)
    window = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("k", "t", F.count("v").over(window).alias("n"), F.coalesce(F.sum("v").over(window), F.lit(0.0)).alias("total"))
    assert rows(ordered.running_before(df, ["k"], ["t"], F.col("v"), "n", "total").select("k", "t", "n", "total")) == rows(plain)


def test_carried(small_groups):
    df = events(small_groups)
    for before in (False, True):
        window = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        plain = df.select("k", "t", F.last("s", True).over(window).alias("last_s"), F.last("v", True).over(window).alias("last_v"))
        got = ordered.carried(df, ["k"], ["t"], {"last_s": F.col("s"), "last_v": F.col("v")}, before)
        assert rows(got.select("k", "t", "last_s", "last_v")) == rows(plain)


def test_look_back(small_groups):
    df = events(small_groups)
    plain = df.select("k", "t", F.collect_list("t").over(Window.partitionBy("k").orderBy("t").rowsBetween(-3, 0)).alias("seen"))
    assert rows(ordered.look_back(df, ["k"], ["t"], {"seen": F.col("t")}, 3).select("k", "t", "seen")) == rows(plain)


def test_running_sums_do_not_depend_on_the_cuts(small_groups):
    rng = random.Random(5)
    df = small_groups.createDataFrame([(i, rng.random() * 10 ** rng.randrange(6)) for i in range(500)], "t int, v double")
    sums = []
    for partitions in (2, 9):
        small_groups.conf.set("spark.sql.shuffle.partitions", partitions)
        sums.append(rows(ordered.running_before(df, [], ["t"], F.col("v"), "n", "total")))
    small_groups.conf.set("spark.sql.shuffle.partitions", 4)
    assert sums[0] == sums[1]


def test_a_hot_group_in_a_narrow_band_is_cut(small_groups):
    df = small_groups.createDataFrame([("hot", 1000 + i) for i in range(600)] + [("cold", i * 50) for i in range(400)], "k string, t int")
    ranged = ordered._with_ranges(df, ["k"], ["t"])
    assert ranged.where("k = 'hot'").select("__range").distinct().count() >= 2


def test_join_with_a_map_column(spark):
    stored = spark.sql("SELECT 1 AS doc_id, map('a', 1.0) AS latencies UNION ALL SELECT 2, map('b', 2.0)")
    assert [r["doc_id"] for r in store.without_document(stored, spark.sql("SELECT 2 AS doc_id"), "doc_id").collect()] == [1]


def test_labels_of_very_many_lengths(spark):
    index = spark.createDataFrame([("x" * 400 + ".pdf",)], "source string")
    wanted = spark.createDataFrame([("x" * n,) for n in range(1, 320)], "label string")
    found = labels.match_sources(wanted, labels.source_index(index, F.col("source")))
    assert found.count() == 319


def test_vectors_without_values_are_left_out(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "query_id long, vector array<double>")
    assert [(r["query_id"], r["id"], r["distance"]) for r in search.nearest(index, asked, 1).collect()] == [(7, 3, 0.0)]


def test_decomposed_names_are_the_same_source(spark):
    name = "한국대학교_정보시스템.pdf"
    truth = spark.createDataFrame([(1, [name])], "query_id long, sources array<string>")
    hits = spark.createDataFrame([(1, 1, unicodedata.normalize("NFD", name))], "query_id long, rank int, source string")
    assert [(r["hit_position"], r["recall_at_k"]) for r in evaluation.source_metrics(truth, hits, 5).collect()] == [(1, 1.0)]


def test_repeated_chunk_labels_count_once(spark):
    ground = "struct<sources: array<string>, chunk_uids: array<string>, chunk_orders: array<int>>"
    items = spark.createDataFrame([(1, (["s"], ["a_1", "A_1", "a_2"], [3, 3]))], f"id long, ground_truth {ground}")
    truth = evaluating.truth_of(items).first()
    assert (truth["uids"], truth["orders"]) == (["a_1", "a_2"], ["3"])


def test_picks_are_taken_per_label(spark):
    scored = spark.createDataFrame([(1, "one label", f"s{i}", f"c{i}", float(9 - i), True) for i in range(3)],
                                   "item_id int, label string, source string, chunk_id string, score double, acceptable boolean")
    picked = labels.select_labels(scored, spark.createDataFrame([(1, 1)], "item_id int, target_n int")).collect()
    assert [r["chunk_id"] for r in picked] == ["c0"]


def test_no_source_gives_an_empty_bid_table(spark):
    table = notices.first_usable_bid_table(None, None, None, spark)
    assert table.count() == 0 and table.columns == ["notice_no", "project", "org", "budget", "deadline"]


def test_top_per_group(spark):
    df = events(spark)
    got = ordered.top_per_group(df, ["k"], [F.desc("t")], 4, spread=F.pmod("t", F.lit(3)))
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t")))).filter("rank <= 4")
    assert rows(got.select("k", "t", "rank")) == rows(plain.select("k", "t", "rank"))


def test_anomaly_rule(spark):
    def flags(seconds):
        frame = spark.createDataFrame([(i, float(s)) for i, s in enumerate(seconds)], "i int, s double")
        return [r["is_anomaly"] for r in store.run_anomalies(frame, [], ["i"], "s", F.lit(True)).orderBy("i").collect()]

    assert flags([10] * 9 + [61])[-1] is True
    assert flags([10] * 10 + [30])[-1] is False
    assert flags([10] * 10 + [31])[-1] is True


def test_upsert_is_repeatable(spark):
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id int, t string")
    fresh = spark.createDataFrame([(1, "n"), (3, "m")], "doc_id int, t string")
    once = store.upserted(stored, fresh)
    assert rows(once) == [(1, "n"), (2, "c"), (3, "m")] == rows(store.upserted(once, fresh))
