"""Plan-shape guards for the scale design (checked on the optimized physical plan)."""

import re

import numpy as np
from pyspark.sql import functions as F

from paths import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_have_a_single_exchange(spark):
    from webloom.operators.html import html_events, text_blocks
    plan = _plan(text_blocks(html_events(spark.read.parquet(f"{SF001}/pages.parquet"))))
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", plan)) == 1
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_word_count_prunes_columns_and_combines_map_side(spark):
    from webloom.plans.catalog import QUERIES
    plan = _plan(QUERIES["top_k_words"](spark, SF001))
    assert "ReadSchema: struct<text:string>" in plan
    assert "TakeOrderedAndProject" in plan
    assert plan.count("HashAggregate") >= 2  # partial + final


def test_rules_and_fusion_add_no_exchange(spark):
    from webloom.operators.classifiers import num_words_rules
    from webloom.operators.fusion import proximity_fusion
    from webloom.operators.html import html_events, text_blocks
    b = text_blocks(html_events(spark.read.parquet(f"{SF001}/pages.parquet")))
    plan = _plan(proximity_fusion(num_words_rules(b)))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_topic_rows_travel_per_document_block(spark):
    """One join of the needs with lambda by term block, one cogroup by document block; no entry is joined with lambda."""
    from webloom.operators.topics import block_needs, doc_blocks, e_step, term_blocks
    rows = [(str(d), w, 2.0) for d in range(50) for w in range(d % 5, d % 5 + 10)]
    corpus = spark.createDataFrame(rows, "doc_id string, term_id long, count double")
    blocks = doc_blocks(corpus, 3)
    plan = _plan(e_step(blocks, block_needs(blocks, 3), term_blocks(spark, 3, 20), np.ones(3), np.full(3, 0.1), 3, 20))
    assert plan.count("Join") == 1 and plan.count("FlatMapCoGroupsInArrow") == 1 and "Generate" not in plan


def test_vocabulary_ids_do_not_depend_on_exchange_reuse(spark):
    from webloom.operators.vectorize import assign_ids
    terms = spark.range(200_000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        ids = assign_ids(terms).agg(F.count_distinct("term_id"), F.min("term_id"), F.max("term_id")).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert tuple(ids) == (200_000, 0, 199_999)


def test_vocabulary_ids_without_single_partition_window_over_terms(spark):
    from webloom.operators.vectorize import assign_ids
    terms = spark.range(1000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"))
    plan = _plan(assign_ids(terms))
    # the only single-partition step is the per-partition offset table
    assert plan.count("Exchange SinglePartition") <= 1


def test_rules_change_rows_of_rich_pages(spark):
    """No rule of these queries is vacuous."""
    from webloom.plans.rich_pages import RULES, _owned, before_and_after, q_content_images_rich_pages
    blocks = _owned(spark, SF001)[1].drop("owner").cache()
    for name in RULES:
        before, after = before_and_after(blocks, name)
        assert before.select(*after.columns).exceptAll(after).count() > 0, name
    assert {r.src for r in q_content_images_rich_pages(spark, SF001).select("src").distinct().collect()} == {"/pic.png"}
