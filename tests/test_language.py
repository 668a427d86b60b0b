"""The boolean language: grammar, null logic and laws of set algebra."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.dsl.compiler import decide, evaluate, validate
from shardloom.dsl.parser import QueryError, parse

SHAPE = (
    "shard_id string, source string, light_decision string, light_score double, final_value_score double, training_loss_normalized double, "
    "aesthetic_avg double, caption_quality double, diversity_score double, has_unified int"
)
ROWS = [
    ("01", "Maps", "keep", 0.9, 0.8, 0.1, 0.5, 0.7, 0.2, 1),
    ("02", "maps", "discard", 0.2, 0.8, None, None, None, None, 0),
    ("03", "art", None, None, float("nan"), 0.9, 0.4, 0.3, 0.9, None),
    ("04", "art", "keep", 0.5, 0.0, 0.5, 0.2, 0.5, 0.5, 1),
    ("05", None, "unknown", 0.7, 0.6, float("nan"), 0.9, 0.45, 0.5, 1),
]


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame(ROWS, SHAPE).cache()


def ids(pool, text, **kw):
    return {r.shard_id for r in evaluate(pool, text, **kw).where("included").collect()}


EVERY = {r[0] for r in ROWS}


def test_precedence():
    assert parse("a OR b AND NOT c").kind == "or"
    assert parse("(a OR b) AND c").kind == "and"
    assert parse("NOT NOT a").children[0].kind == "not"
    assert parse('top_pct(35) and "odd-name"').children[1].name == "odd-name"


@pytest.mark.parametrize("text", ["", "a AND", "(a", "a)", "top_pct(", "top_pct(,)", "a b", "top_pct(1,)", "&", "1"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_validation():
    assert validate("top_pct(35) AND NOT source:maps") == []
    assert validate("nothing(3)") == ["unknown function nothing"]
    assert validate("old") == ["unknown selection old"]
    assert validate("old", {"old"}) == []
    assert validate("source()") != []


def test_primitives(pool):
    assert ids(pool, "all") == EVERY
    assert ids(pool, "keep") == {"01", "03", "04", "05"}
    assert ids(pool, "source:MAPS") == {"01", "02"}
    assert ids(pool, "top_n(2)") == {"01", "02"}
    assert ids(pool, "top_pct(40)") == {"01"}
    assert ids(pool, "low_caption") == {"02", "03"}
    assert ids(pool, "min_caption(0.45)") == {"01", "04", "05"}
    assert ids(pool, "min_loss(0.5)") == {"03", "04"}
    assert ids(pool, "high_diversity(25)") == {"03"}


def test_no_diversity_scores_selects_all(pool):
    from pyspark.sql import functions as F

    assert ids(pool.withColumn("diversity_score", F.lit(None).cast("double")), "high_diversity(10)") == EVERY


def test_empty_pool_and_extra_columns(spark, pool):
    from pyspark.sql import functions as F

    assert ids(spark.createDataFrame([], SHAPE), "top_pct(50) OR hard_focus") == set()
    odd = pool.withColumn("rank", F.lit(1)).withColumn("total", F.lit(2))
    assert ids(odd, "top_n(2)") == {"01", "02"}


@settings(max_examples=8, deadline=None)
@given(st.sampled_from(["keep", "top_pct(60)", "min_light(0.5)", "low_caption"]), st.sampled_from(["source:art", "min_score(0.5)", "hard_focus(50)"]))
def test_laws(pool, a, b):
    assert ids(pool, f"NOT ({a} AND {b})") == ids(pool, f"NOT {a} OR NOT {b}")
    assert ids(pool, f"NOT NOT {a}") == ids(pool, a)
    assert ids(pool, f"NOT {a}") == EVERY - ids(pool, a)


def test_overrides(spark, pool):
    base = spark.createDataFrame([("01", "include"), ("04", "include"), ("02", "exclude")], "shard_id string, decision string")
    got = decide(evaluate(pool, "all"), include=["03"], exclude=["01"], floor=0.1, base=base).collect()
    assert {r.shard_id: r.decision for r in got} == {"01": "exclude", "02": "exclude", "03": "include", "04": "exclude", "05": "exclude"}
