"""The run ledger: append-only step events folded to state, and what follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import fresh

#: The steps that can be redone, in order.
STEPS = ("4b_flag", "4b_review", "5_mute", "6_recombine", "6b_encode", "7_mux")
#: Artifacts and the class that decides how long they stay.
ARTIFACTS = {
    "transcript.json": "record", "matches.json": "record", "review.json": "record", "censor_log.json": "record",
    "dialog.wav": "correction", "score_sfx.wav": "correction",
    "audio_stereo.wav": "intermediate", "dialog_censored.wav": "intermediate", "audio_censored.wav": "intermediate",
    "audio_encoded.mka": "intermediate", "transcript_NN.json": "intermediate",
}
JOB = "job_id string, input_path string, status string, steps_completed array<string>, _corrupt_record string"


def scan_jobs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(readable jobs, corrupt documents) of a folder of job documents; a corrupt one isn't fatal."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("dir"), F.col("value").alias("doc"))
    return split_jobs(parse_jobs(raw))


def parse_jobs(raw: DataFrame) -> DataFrame:
    """Job documents in a text column ``doc``, parsed; text that isn't a job goes to _corrupt_record."""
    return raw.withColumn("job", F.from_json("doc", JOB, {"mode": "PERMISSIVE"})).select("dir", "job.*")


def split_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return jobs.filter("_corrupt_record is null").drop("_corrupt_record"), jobs.filter("_corrupt_record is not null")


def ledger_fold(events: DataFrame) -> DataFrame:
    """Ordered done-list per job from (job_id, seq, step, action): a step is done if its last done or undo
    is a done; its place is the first done after its last undo."""
    steps = events.filter(F.col("action").isin("done", "undo"))
    undone = F.max(F.when(F.col("action") == "undo", F.col("seq")))
    folded = steps.groupBy("job_id", "step").agg(
        F.max_by("action", "seq").alias("last"),
        undone.alias("undone"),
        F.sort_array(F.collect_list(F.when(F.col("action") == "done", F.col("seq")))).alias("dones"),
    )
    at = F.array_min(F.filter("dones", lambda s: s > F.coalesce(F.col("undone"), F.lit(-1))))
    done = folded.filter("last = 'done'").withColumn("at", at)
    return done.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "step"))), lambda x: x["step"]).alias("steps_completed"))


def ledger_status(events: DataFrame) -> DataFrame:
    """running, failed, interrupted or complete: the last event decides, so resuming clears a failure; the
    failed or interrupted step is named only then."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("action", "step"), "seq").alias("e"))
    status = F.when(F.col("e.action") == "error", "failed").when(F.col("e.action") == "interrupt", "interrupted").when((F.col("e.action") == "done") & (F.col("e.step") == STEPS[-1]), "complete").otherwise("running")
    return last.select("job_id", status.alias("status"), F.when(F.col("e.action").isin("error", "interrupt"), F.col("e.step")).alias("failed_step"))


def step_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STEPS)), "ord int, step string")


def cascade_steps(named: DataFrame) -> DataFrame:
    """Steps to clear for each job of ``named`` (job_id, step): each named one and all later ones."""
    steps = F.broadcast(step_order(named.sparkSession))  # six rows
    least = named.join(steps, "step").groupBy("job_id").agg(F.min("ord").alias("least"))
    return least.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("step")) for i, s in enumerate(STEPS)]))).select("job_id", "s.*", "least").filter("ord >= least").drop("least")


def correction_cascade(jobs: DataFrame) -> DataFrame:
    """What a correction clears: from 5_mute on."""
    return cascade_steps(jobs.select("job_id", F.lit("5_mute").alias("step")))


def correction_gate(requests: DataFrame, folded: DataFrame) -> DataFrame:
    """Requests (job_id, kind) that can't be served: ``no_job`` for unknown jobs, ``not_flagged`` for
    corrections of a job whose 4b_flag isn't done."""
    known = folded.select("job_id", F.array_contains("steps_completed", "4b_flag").alias("flagged"), F.lit(True).alias("known"))
    problem = F.when(F.col("known").isNull(), "no_job").when((F.col("kind") == "correction") & ~F.col("flagged"), "not_flagged")
    return requests.join(known, "job_id", "left").select("job_id", "kind", problem.alias("problem")).filter("problem is not null")


def retention_plan(artifacts: DataFrame) -> DataFrame:
    """keep or delete for (artifact, keep_intermediates, keep_correction_artifacts); deletes nothing."""
    kinds = F.create_map(*[x for k, v in ARTIFACTS.items() for x in (F.lit(k), F.lit(v))])
    kind = F.coalesce(F.try_element_at(kinds, F.col("artifact")), F.lit("intermediate"))
    keep = (F.col("class") == "record") | F.col("keep_intermediates") | ((F.col("class") == "correction") & F.col("keep_correction_artifacts"))
    return artifacts.withColumn("class", kind).withColumn("plan", F.when(keep, "keep").otherwise("delete"))


def pending_segments(segments: DataFrame, inventory: DataFrame, artifacts: list[str]) -> DataFrame:
    """Segments (job_id, seg) of which an artifact is missing. The inventory becomes a row a segment, and is merged with the
    segments: both may come from an explode, after which Spark takes tables for small and would broadcast them."""
    there = [fresh(f"there{i}", segments) for i in range(len(artifacts))]
    has = [F.bool_or(F.col("artifact") == a).alias(c) for a, c in zip(artifacts, there)]
    held = inventory.filter(F.col("artifact").isin(*artifacts)).groupBy("job_id", "seg").agg(F.count("*").alias(fresh("n", segments)), *has)
    missing = reduce(Column.__or__, [~F.coalesce(F.col(c), F.lit(False)) for c in there], F.lit(False))
    return segments.join(held.hint("merge"), ["job_id", "seg"], "left").filter(missing).select("job_id", "seg").distinct()


def ledger_find(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs by id; the first folder name wins where an id occurs twice."""
    return jobs.join(wanted.select("job_id").distinct(), "job_id", "left_semi").groupBy("job_id").agg(F.min("dir").alias("dir"), F.min_by("status", "dir").alias("status"))


def required_step_join(folded: DataFrame, inventory: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Artifacts that are missing although needed: rules are (artifact, step that makes it, step that
    uses it up); an error where the first is done, the second isn't, and the artifact isn't there."""
    rule = F.explode(F.array(*[F.struct(F.lit(a).alias("artifact"), F.lit(m).alias("maker"), F.lit(c).alias("consumer")) for a, m, c in rules]))
    due = folded.withColumn("r", rule).select("job_id", "steps_completed", "r.*")
    due = due.filter(F.array_contains("steps_completed", F.col("maker")) & ~F.array_contains("steps_completed", F.col("consumer")))
    return due.join(inventory, ["job_id", "artifact"], "left_anti").select("job_id", "artifact", "maker", "consumer")
