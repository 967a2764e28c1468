"""Queries over source code made from part tables of our own."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quernel import codebase, queries
from quernel.operators import reviews
from quernel.plans.repository import Repository


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """3000 parts of two brands, small enough a file for one task to read."""
    out = str(tmp_path_factory.mktemp("parts"))
    rows = spark.range(3000).selectExpr("id AS p_partkey", "concat('Brand#', id % 2) AS p_brand", "cast(id * 7 % 50 + 1 AS int) AS p_size")
    rows.coalesce(1).write.parquet(f"{out}/part.parquet")
    return out


def differing(name, df, sf):
    """Rows that the query or its SQL lacks."""
    got, db = df.toPandas(), duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet/*.parquet'")
    cols = ", ".join(sorted(got.columns))
    both = [f"SELECT {cols} FROM got", f"SELECT {cols} FROM ({queries.oracle_sql()[name]})"]
    return [db.execute(f"{a} EXCEPT ALL {b}").fetchall() for a, b in (both, both[::-1])]


def test_debt_places_however_partitions_are_merged(spark, sf):
    settings = {"parallelismFirst": "false", "minPartitionSize": "1k"}
    for k, v in settings.items():
        spark.conf.set(f"spark.sql.adaptive.coalescePartitions.{k}", v)
    try:
        for size in ("20k", "40k"):
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            assert differing("code_debt", queries.queries()["code_debt"](spark, sf), sf) == [[], []], size
    finally:
        for k in ("advisoryPartitionSizeInBytes", *(f"coalescePartitions.{k}" for k in settings)):
            spark.conf.unset(f"spark.sql.adaptive.{k}")


def test_source_code_is_made_by_many_tasks(spark, sf, monkeypatch):
    """The table is one small file, the code made of it is not."""
    monkeypatch.setattr(codebase, "PARTS", 500)
    p = spark.read.parquet(f"{sf}/part.parquet")
    made = codebase.code_files(spark, sf)
    tasks = made.where("path LIKE '%.py' AND path NOT LIKE '%/%'").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert p.rdd.getNumPartitions() == 1 and len(tasks) >= 5 and sum(r["count"] for r in tasks) == 3000


def test_no_more_tasks_than_keep_the_cores_busy(spark, sf, monkeypatch):
    monkeypatch.setattr(codebase, "PARTS", 10)
    cores = spark.sparkContext.defaultParallelism
    assert codebase.code_files(spark, sf).rdd.getNumPartitions() == 3 * codebase.WAVES * cores
    monkeypatch.setattr(codebase, "MOST_PARTS", 50)
    assert codebase.code_files(spark, sf).rdd.getNumPartitions() == 3 * (3000 // 50 + 1)


@pytest.mark.parametrize("name", ["code_metrics", "code_findings", "code_prompts", "code_reviews", "code_edges"])
def test_only_the_facts_it_needs(spark, sf, name, monkeypatch):
    from quernel.plans import repository

    kinds = []
    plain = repository.ast_facts
    monkeypatch.setattr(repository, "ast_facts", lambda files, wanted: kinds.append(set(wanted)) or plain(files, wanted))
    assert differing(name, queries.queries()[name](spark, sf), sf) == [[], []]
    assert kinds and all("called" not in k and ({"import", "used"} & k) != {"import", "used"} for k in kinds)


def test_a_part_left_out_raises(files):
    r = Repository(files({"a.py": "import b\n"}), parts=("metrics",))
    assert r.wide_metrics.first().complexity_score == 1
    with pytest.raises(ValueError, match="without graph"):
        r.edges  # noqa: B018


def test_reviews_make_prompts_of_their_files_alone(spark):
    rows = spark.createDataFrame([("r", f"{k}.py", ".py", "x") for k in range(9)], "repo_id string, path string, ext string, text string")
    asked = []

    def ask(part):
        asked.extend(r.path for r in part.collect())
        return part.select("repo_id", "path", F.col("path").alias("prompt"))

    def reviewer(prompt):
        if prompt == "1.py":
            raise ValueError
        return prompt

    got = reviews.review(rows, reviewer, ask=ask)
    assert [r.review for r in got.orderBy("file").collect()] == ["0.py", "2.py", "3.py"] and sorted(asked) == [f"{k}.py" for k in range(9)]
    asked.clear()
    assert reviews.review(rows, str, ask=ask).count() == 3 and sorted(asked) == ["0.py", "1.py", "2.py"]
