"""Reads of the catalogue that join several versioned relations: each one plan, with conditions that reach the scans.

Samples are (sample, dataset, external, duration, unusable). Results are versions of a sample's
results: (sample, result, created, ...); the current one is the latest by created, then by result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators import catalog


def current(results: DataFrame, key: str, condition: Column, order: tuple[str, ...] = ("created", "result")) -> DataFrame:
    """The latest of each key's rows that meet ``condition``."""
    return catalog.latest(results.where(condition), [key], *order)


def represented(duration: Column, analyzed: Column) -> Column:
    """Seconds of a recording that its analysis stands for: null only without an analysis."""
    return F.least(F.coalesce(duration, analyzed), analyzed)


def audit_evidence(samples: DataFrame, datasets: DataFrame, quality: DataFrame, regions: DataFrame, exclusions: DataFrame, chosen: Column, metric: str, annotation: str, analysis: str, least: float) -> DataFrame:
    """What a corpus audit reads of each usable recording of the ``chosen`` datasets whose current quality is over ``least``.

    ``quality`` has metric, status, annotation, score, analyzed; ``regions`` (sample, analysis,
    annotation, payload); ``exclusions`` (sample, id, scope, start, end): a recording's takes it out, an
    interval's come as a sorted array.
    """
    best = current(quality, "sample", (F.col("metric") == metric) & (F.col("status") == "completed") & (F.col("annotation") == annotation)).where(F.col("score") > least)
    region = regions.where((F.col("analysis") == analysis) & (F.col("annotation") == annotation)).select("sample", F.col("payload").alias("regions"))
    cuts = exclusions.where("scope = 'interval'").groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("start", "id", "end"))).alias("intervals"))
    own = samples.where(chosen & ~F.col("unusable")).join(exclusions.where("scope = 'recording'").select("sample"), "sample", "left_anti")
    x = own.join(datasets, "dataset").join(best.select("sample", "score", "analyzed"), "sample").join(region, "sample", "left").join(cuts, "sample", "left")
    none = F.array().cast(cuts.schema["intervals"].dataType)
    return x.select("dataset", "name", "sample", "external", represented(F.col("duration"), F.col("analyzed")).alias("seconds"), "score", "regions", F.coalesce("intervals", none).alias("intervals"))


def region_evidence(samples: DataFrame, tracks: DataFrame, quality: DataFrame, activity: DataFrame, metric: str, annotation: str) -> DataFrame:
    """Recordings with current quality and, for both tracks (track, sample, side, sha), the latest activity made of the track's present audio."""
    best = current(quality, "sample", (F.col("metric") == metric) & (F.col("status") == "completed") & (F.col("annotation") == annotation))
    fresh = tracks.join(activity.withColumnRenamed("sha", "_sha"), "track").where("sha = _sha")
    last = catalog.latest(fresh.select("sample", "side", "updated", "result", "payload"), ["sample", "side"], "updated", "result")
    side = lambda n: last.where(F.col("side") == n).select("sample", F.col("payload").alias(f"activity_{n}"))
    x = samples.join(best.select("sample", "result", "analyzed"), "sample").join(side(1), "sample").join(side(2), "sample")
    return x.select("sample", "external", represented(F.col("duration"), F.col("analyzed")).alias("seconds"), "result", "activity_1", "activity_2")


def transcripts(samples: DataFrame, tracks: DataFrame, made: DataFrame, models: list[str]) -> DataFrame:
    """(sample, external, side, model, ...) of the latest transcript without error of each track and model, of present audio."""
    ok = made.where(F.col("model").isin(models) & F.col("error").isNull()).withColumnRenamed("sha", "_sha")
    last = catalog.latest(ok.join(tracks, "track").where("sha = _sha").select("sample", "side", "model", "updated", "result", "text"), ["sample", "side", "model"], "updated", "result")
    return last.join(samples.select("sample", "external"), "sample").select("sample", "external", "side", "model", "result", "text")


def complete_samples(found: DataFrame, models: list[str]) -> DataFrame:
    """Samples with a transcript of either side by every model."""
    return found.groupBy("sample").agg(F.count_distinct("side", "model").alias("n")).where(F.col("n") == 2 * len(models)).select("sample")


def unreviewed(predictions: DataFrame, reviews: DataFrame, version: str) -> DataFrame:
    """Predictions of one estimator for samples that nobody reviewed."""
    return predictions.where(F.col("version") == version).join(reviews.select("sample").distinct(), "sample", "left_anti")


def registered(samples: DataFrame, tracks: DataFrame) -> DataFrame:
    """(sample, external, track_1, track_2) of samples with both tracks."""
    per = tracks.groupBy("sample").agg(F.max(F.when(F.col("side") == 1, F.col("track"))).alias("track_1"), F.max(F.when(F.col("side") == 2, F.col("track"))).alias("track_2"))
    return samples.join(per.where("track_1 is not null and track_2 is not null"), "sample").select("sample", "external", "track_1", "track_2")


def review_items(items: DataFrame, samples: DataFrame, tracks: DataFrame, quality: DataFrame, regions: DataFrame) -> DataFrame:
    """Review items (item, sample, replaces, result, score, region, sha_1, sha_2, metric, annotation, decision) with what replaces each, and whether its evidence is still current.

    Evidence is current if the sample is usable, both tracks hold the audio of then, the result is still the
    latest of its versions with the score of then, and its regions are there.
    """
    done = quality.where("status = 'completed'")
    last = catalog.latest(done.select("sample", "metric", "annotation", "created", F.col("result"), F.col("score")), ["sample", "metric", "annotation"], "created", "result")
    last = last.select("sample", "metric", "annotation", F.col("result").alias("_result"), F.col("score").alias("_score"))
    audio = tracks.groupBy("sample").agg(F.max(F.when(F.col("side") == 1, F.col("sha"))).alias("_sha1"), F.max(F.when(F.col("side") == 2, F.col("sha"))).alias("_sha2"))
    there = regions.select("sample", F.col("region").alias("_region"), F.col("annotation").alias("_annotation")).distinct()
    x = items.join(samples.select("sample", "external", "unusable"), "sample").join(last, ["sample", "metric", "annotation"], "left").join(audio, "sample", "left")
    r = there.withColumnRenamed("sample", "_sample")
    x = x.join(r, (F.col("sample") == F.col("_sample")) & (F.col("region") == F.col("_region")) & (F.col("annotation") == F.col("_annotation")), "left")
    same = (F.col("sha_1") == F.col("_sha1")) & (F.col("sha_2") == F.col("_sha2")) & (F.col("result") == F.col("_result")) & (F.col("score") == F.col("_score"))
    now = ~F.col("unusable") & F.coalesce(same, F.lit(False)) & F.col("_region").isNotNull()
    by = items.where("replaces is not null").groupBy(F.col("replaces").alias("item")).agg(F.max("item").alias("replaced_by"))
    return x.join(by, "item", "left").select("item", "sample", "external", "decision", "replaces", "replaced_by", now.alias("current"))


def latest_judgments(judgments: DataFrame, keys: list[str]) -> DataFrame:
    """The last judgment of each item by each reviewer."""
    return catalog.latest(judgments, keys, "created", "judgment")


def progress(judgments: DataFrame, queue: DataFrame, keys: list[str]) -> DataFrame:
    """One row: items of the queue, judged ones, and judged ones by verdict."""
    x = queue.join(judgments.select(*keys, "verdict"), keys, "left")
    return x.agg(F.count("*").alias("n"), F.count("verdict").alias("judged"), F.count_if(F.col("verdict") == "aligned").alias("aligned"), F.count_if(F.col("verdict") == "misaligned").alias("misaligned"), F.count_if(F.col("verdict") == "unsure").alias("unsure"))
