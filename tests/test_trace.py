"""Stages measured in the job that does the work."""

import public_tokenizers
import time

from pyspark.sql import functions as F

from loomspan.functions.splitters import python_splitter
from loomspan.operators import prune as P
from loomspan.operators.models import ModelScorer, overlap_model
from loomspan.operators.process import process
from loomspan.operators.scorers import FunctionScorer
from loomspan.operators.tokenizers import FileTokenizer
from loomspan.operators.trace import COUNTS, STAGES, Trace


def contexts(spark, n=6):
    return spark.range(n).select(F.lit(0).alias("query_idx"), F.col("id").cast("int").alias("context_idx"), F.lit("red fox").alias("query"), F.lit("A red fox ran. The sky is blue. ").alias("context_text")).coalesce(2)


def test_counts_and_seconds(spark):
    trace, plain = Trace(), P.prune(contexts(spark), None, language="en")
    traced = P.prune(contexts(spark), None, language="en", trace=trace)
    assert traced.columns == plain.columns and sorted(map(str, traced.collect())) == sorted(map(str, plain.collect()))
    assert trace.counts() == {"contexts": 6, "sentences": 12, "fragments": 12, "blocks": 6}
    told = trace.seconds()
    assert set(told) == {"preprocess_seconds", "total_seconds", *(f"{s}_seconds" for s in STAGES)}
    assert told["tokenize_seconds"] == 0 and told["total_seconds"] > 0 and all(v >= 0 for v in told.values())
    assert abs(told["total_seconds"] - told["preprocess_seconds"] - sum(told[f"{s}_seconds"] for s in ("assembly", "inference", "postprocess"))) < 1e-9


def test_time_goes_to_the_stage_that_takes_it(spark):
    def slow_split(text):
        time.sleep(0.05)
        return [text]

    def slow_scores(questions, texts):
        time.sleep(0.3)
        return [0.5] * len(texts)

    trace = Trace()
    P.prune(contexts(spark, 4), None, sentence_splitter=python_splitter(slow_split), trace=trace).collect()
    told = trace.seconds()
    assert told["sentence_collect_seconds"] > 0.1 and told["sentence_collect_seconds"] > 5 * told["inference_seconds"]
    trace = Trace()
    P.prune(contexts(spark, 4), None, language="en", scorer=FunctionScorer(slow_scores, slow_scores), trace=trace).collect()
    told = trace.seconds()
    assert told["inference_seconds"] > 0.3 and told["inference_seconds"] > told["preprocess_seconds"]


def test_no_further_job(spark):
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("traced", "one action")
    try:
        P.prune(contexts(spark), None, language="en", trace=Trace()).collect()
        traced = len(seen.getJobIdsForGroup("traced"))
        spark.sparkContext.setJobGroup("plain", "one action")
        P.prune(contexts(spark), None, language="en").collect()
        assert traced == len(seen.getJobIdsForGroup("plain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_model_and_a_tokenizer_are_traced(spark):
    trace = Trace()
    scorer = ModelScorer(overlap_model, FileTokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    P.prune(contexts(spark), None, language="en", scorer=scorer, trace=trace).collect()
    assert trace.seconds()["tokenize_seconds"] > 0 and trace.counts()["blocks"] == 6


def test_process_tells_of_its_stages(spark):
    got = process(spark, "red fox", ["A red fox ran. The sky is blue.", "Blue."])["performance_trace"]
    assert {c: got[c] for c in COUNTS} == {"contexts": 2, "sentences": 3, "fragments": 3, "blocks": 2} and got["total_seconds"] > 0
