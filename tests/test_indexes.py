"""Stored indexes: trigrams, vector codes, the Z-order curve. Equal to the scan, and reading less."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shopspark.functions.text import similarity, trigrams
from shopspark.operators import knn
from shopspark.operators.name_index import alike_texts, alike_to, asked_grams, build_name_index
from shopspark.operators.radius import within_radius
from shopspark.operators.vector_codes import build_codes, similar_by_codes, train
from shopspark.sources.zorder import RANGES, box_ranges, circle_ranges, read_circle, write_along_curve, z_key


def scan_rows(df):
    """Rows that the scan of a plan gave."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(2)
    words = ["widget", "gadget", "ring", "bolt", "plate", "Größe", "x", "anna", "annas", "banana"]
    made = [" ".join(rng.choice(words) + rng.choice(["", "s", "y"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    made += ["common word " + w for w in words] + ["", None, "!!", "widget", "Widget"]
    return spark.createDataFrame([(i, n, f"Brand {i % 7}") for i, n in enumerate(made)], "id bigint, name string, brand string")


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_indexed_names_equal_the_scan(spark, names, tmp_path, threshold):
    index = build_name_index(names, str(tmp_path), columns=("name", "brand"))
    questions = names.where("id % 5 = 0").select(F.col("name").alias("question"))
    questions = questions.unionByName(spark.createDataFrame([("brand 3",), (None,), ("?",), ("zzz",)], "question string"))
    texts = names.selectExpr("'name' field", "name text").unionByName(names.selectExpr("'brand' field", "brand text"))
    texts = texts.where("text is not null").groupBy("field", "text").agg(F.count("*").alias("rows"))
    asked = questions.where("question is not null").distinct()
    pairs = asked.crossJoin(texts).withColumn("score", similarity(trigrams(F.col("text")), trigrams(F.col("question"))))
    columns = ["question", "field", "text", "rows", "score"]
    want = rows(pairs.where(F.col("score") >= threshold).select(columns))
    assert rows(alike_texts(index, questions, threshold).select(columns)) == want
    some = want[len(want) // 2][0]
    assert rows(alike_to(index, some, threshold).select(columns)) == [r for r in want if r[0] == some]


def test_a_question_reads_its_rare_grams(spark, names, tmp_path):
    index = build_name_index(names, str(tmp_path), columns=("name",))
    own = [r.gram for r in asked_grams(index, spark.createDataFrame([("common word ring",)], "question string"), 0.6).collect()]
    assert 0 < len(own) < trigrams_of(spark, "common word ring")
    plan = alike_to(index, "common word ring", 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "") or "In(gram" in plan
    assert "PartitionFilters" in plan and "shelf" in plan


def trigrams_of(spark, text):
    return spark.range(1).select(F.size(trigrams(F.lit(text)))).first()[0]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_codes_find_the_neighbours(spark, tmp_path, folder):
    vectors = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), "embedding")
    index = build_codes(vectors, str(tmp_path / "codes"), key="vec_id")
    found = similar_by_codes(index, asked, 10, skip_self=True)
    exact = knn.similar(vectors, asked, 10, key="vec_id", query_key="id", skip_self=True)
    assert found.count() == exact.count() == 10 * asked.count()
    assert knn.recall(found, exact).first()[0] >= 0.9
    sizes = index.read(spark).select(F.max(F.length("code")), F.min(F.size("v") * 4)).first()
    assert 8 * sizes[0] <= sizes[1]  # codes are an eighth of the vectors at most
    assert sum(b.shape[0] for b in index.books) <= 16 * 256


def test_codes_of_special_vectors(spark, tmp_path):
    given = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 0.1])]
    vectors = spark.createDataFrame(given, "id bigint, embedding array<float>")
    index = build_codes(vectors, str(tmp_path / "codes"), parts=2)
    found = similar_by_codes(index, vectors.where("id in (1, 4)"), 2, skip_self=True)
    assert [(r.query_id, r.id, r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 2, 1), (1, 6, 2)]
    assert similar_by_codes(index, vectors.limit(0), 2).count() == 0
    assert train(np.zeros((5, 2))).tolist() == [[0.0, 0.0]]


def points(spark):
    rng = random.Random(8)
    where = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(4000)] + [(90.0, 180.0), (-90.0, -180.0), (None, 1.0), (0.0, 180.0), (0.0, -180.0)]
    return spark.createDataFrame([(i, *w) for i, w in enumerate(where)], "id bigint, latitude double, longitude double")


def test_circles_along_the_curve(spark, tmp_path):
    path = str(tmp_path / "z")
    write_along_curve(points(spark).repartition(4), path, row_group_bytes=8192)
    for place in ((48.0, 2.0, 800_000.0), (0.0, 179.9, 900_000.0), (-89.0, 10.0, 700_000.0), (10.0, -179.0, 2_500_000.0), (5.0, 5.0, 1.0)):
        want = rows(within_radius(points(spark), *place).select("id"))
        found = read_circle(spark, path, *place)
        assert rows(found.select("id")) == want
        assert len(circle_ranges(*place)) <= RANGES
    ranges = circle_ranges(48.0, 2.0, 800_000.0)
    scan = spark.read.parquet(path).where(" or ".join(f"z between {a} and {b}" for a, b in ranges))
    assert scan_rows(scan) < 1500  # of 4,005


def test_ranges_cover_the_box(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame([(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(500)], "lat double, lon double")
    keys = cells.select("lat", "lon", z_key(F.col("lat"), F.col("lon")).alias("z")).collect()
    for _ in range(20):
        (s, n), (w, e) = sorted(rng.sample(range(65536), 2)), sorted(rng.sample(range(65536), 2))
        ranges = box_ranges(s, n, w, e, 8)
        assert len(ranges) <= 8
        for k in keys:
            row, col = int((k.lat + 90) / 180 * 65536), int((k.lon + 180) / 360 * 65536)
            if s <= row <= n and w <= col <= e:
                assert any(a <= k.z <= b for a, b in ranges)
