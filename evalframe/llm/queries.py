"""The queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evalframe.session import table


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    return table(spark, d, "problem_specs"), dict(id_col="spec_id", text_cols=("title", "statement"), k=3, threshold=(1, 2), min_words=20)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.near_duplicates import near_duplicate_pairs

    df, kw = _p1(spark, d)
    return near_duplicate_pairs(df, **kw).toDF("spec_id_a", "spec_id_b")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.near_duplicates import near_duplicate_classes

    df, kw = _p1(spark, d)
    return near_duplicate_classes(df, **kw).withColumnRenamed("id", "spec_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.quota_sample import quota_sample

    report = quota_sample(table(spark, d, "oracle_meta"), table(spark, d, "sample_targets"), counted=True)[1]
    return report.where(F.col("available") < F.col("need")).select("dimension", "category")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.quota_sample import quota_sample

    return quota_sample(table(spark, d, "oracle_meta"), table(spark, d, "sample_targets"))[0].withColumnRenamed("id", "oracle_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.quota_sample import quota_sample

    return quota_sample(table(spark, d, "oracle_meta"), table(spark, d, "sample_targets"), counted=True)[1]


def p2_margins(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the rows drawn: need and available of each target, the rows drawn of those taken whole, and the sizes.

    Categories with no more rows than they need are taken whole if what their dimension asks for fits into the
    sample, and so do the rows of all of them together.
    """
    from evalframe.llm.quota_sample import norm, quota_sample

    meta = table(spark, d, "oracle_meta")
    sample, report = quota_sample(meta, table(spark, d, "sample_targets"), counted=True)
    size = sample.agg(F.count(F.lit(1)).alias("size"), F.countDistinct("id").alias("ids"))
    carried = F.concat(F.array(F.struct(F.lit("difficulty").alias("dimension"), norm(F.col("difficulty")).alias("c")), F.struct(F.lit("source").alias("dimension"), norm(F.col("source")).alias("c"))), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tags").alias("dimension"), norm(t).alias("c"))))
    asked = F.sum(F.least("available", "need")).over(Window.partitionBy("dimension"))
    report = report.join(F.broadcast(size)).withColumn("flagged", (F.col("available") <= F.col("need")) & ((F.col("dimension") == "tags") | (asked <= F.col("size"))))
    scarce = report.where("flagged").select("dimension", norm(F.col("category")).alias("c"))
    rows = meta.select("oracle_id", F.explode(carried).alias("x")).select("oracle_id", "x.*").join(F.broadcast(scarce), ["dimension", "c"]).agg(F.countDistinct("oracle_id").alias("scarce"))
    both = report.join(F.broadcast(rows))
    whole = F.when(F.col("flagged") & (F.col("scarce") <= F.col("size")), F.col("sampled"))
    return both.select("dimension", "category", "need", "available", whole.alias("whole"), "size", "ids")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.source_parse import unparsable_files

    return unparsable_files(table(spark, d, "solutions")).select(F.col("id").alias("solution_id"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.source_parse import parse_rates

    return parse_rates(table(spark, d, "solutions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.format_duplicates import answer_fields, code_fields, format_classes

    code = format_classes(table(spark, d, "solutions"), "solution_id", "code", code_fields).withColumn("tbl", F.lit("solutions"))
    rejected = format_classes(table(spark, d, "dpo_pairs"), "pair_id", "rejected", answer_fields).withColumn("tbl", F.lit("dpo_pairs"))
    both = code.unionByName(rejected).where("id <> kept_id")
    return both.select("tbl", "kept_id", F.col("id").alias("copy_id"))


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.format_duplicates import answer_fields, code_fields, format_classes

    code = format_classes(table(spark, d, "solutions"), "solution_id", "code", code_fields).withColumn("tbl", F.lit("solutions"))
    rejected = format_classes(table(spark, d, "dpo_pairs"), "pair_id", "rejected", answer_fields).withColumn("tbl", F.lit("dpo_pairs"))
    return code.unionByName(rejected).where("id = kept_id").select("tbl", "kept_id", "copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.pair_defects import pair_defects

    return pair_defects(table(spark, d, "dpo_pairs")).where("rule_order = 1").select("pair_id", "field", "defect")


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.pair_defects import pair_defects

    return pair_defects(table(spark, d, "dpo_pairs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.split_overlap import split_overlap_pairs

    return split_overlap_pairs(table(spark, d, "test_cases")).select(F.col("id_a").alias("case_id_a"), F.col("id_b").alias("case_id_b"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.split_overlap import split_overlap_report

    return split_overlap_report(table(spark, d, "test_cases"))


def vocabulary_path() -> str:
    """The vocabulary file: EVALFRAME_TOKENIZER if set, else the installed public one."""
    return os.environ.get("EVALFRAME_TOKENIZER") or "/opt/tokenizers/byte_bpe_50k.json"


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.bpe_automaton import token_ids

    return token_ids(table(spark, d, "documents"), vocabulary_path())


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.bpe_automaton import token_report

    return token_report(table(spark, d, "documents"), vocabulary_path())


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.leak_suffix import leaked_pairs

    return leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.leak_suffix import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.leak_suffix import without_leaks

    return without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "source", "n_chars")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from evalframe.llm.sentences import sentences

    return sentences(table(spark, d, "documents"))


def p9_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, and the least, mean and greatest length, by source of the document."""
    from evalframe.llm.sentences import sentences

    docs = table(spark, d, "documents")
    size = F.col("end_pos") - F.col("start_pos")
    by_doc = sentences(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("lo"), F.sum(size).alias("total"), F.max(size).alias("hi"))
    joined = docs.select("doc_id", "source").join(by_doc, "doc_id")
    return joined.groupBy("source").agg(F.sum("n").alias("sentences"), F.min("lo").alias("shortest"), (F.sum("total") / F.sum("n")).alias("mean_chars"), F.max("hi").alias("longest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
