"""The engine's commands as functions on DataFrames: index, profile, evaluate, score, tells, plan_rewrite, judge_candidates.

A corpus has doc_id, path, text, source. Paragraphs are lines, or with segmenter="markdown" the included leaves. What a step refuses it refuses by raising, before any later step runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .functions import constants as C
from .functions.tables import materialize
from .operators import corpus as corpora
from .operators import evaluate as evaluation
from .operators import gates, lint, preserve, publication, rewrite, rounds, structure, style

KEYS = ["doc_id", "seg"]


class CorpusTooSmall(ValueError):
    """The corpus doesn't meet a requirement of a profile."""


@dataclass(frozen=True)
class Profile:
    #: A row per feature, and the standardised features of the calibrate split.
    stats: DataFrame
    reference: DataFrame


@dataclass(frozen=True)
class Evaluation:
    """Thresholds, and what may be claimed with them. emitted: by band, whether its error is bounded within its target; a band that isn't there may
    be claimed. reason: why a release doesn't ship, or empty."""

    low: float | None
    high: float | None
    verdict: str
    auc: float | None
    emitted: dict[str, bool] = field(default_factory=dict)
    bounds: dict[str, float | None] = field(default_factory=dict)
    auc_lower: float | None = None
    intervals: Row | None = None
    reason: str = "uncalibrated"

    @property
    def shippable(self) -> bool:
        return self.reason == ""


def index(corpus: DataFrame) -> DataFrame:
    """The corpus with admission, duplicates and splits."""
    return materialize(corpora.admitted(corpus), "index")


def features(indexed: DataFrame, segmenter: str = "line") -> DataFrame:
    """Paragraphs above the floor, in long form."""
    paragraphs = corpora.segments(corpora.eligible(indexed).select("doc_id", "source", "split", "text"), segmenter)
    return style.long_form(style.vectors(paragraphs, floor=C.MIN_LEXICAL).drop("line", "_t"))


def profile(indexed: DataFrame, segmenter: str = "line") -> Profile:
    """The author's profile from train paragraphs, and its reference from calibrate paragraphs."""
    long = materialize(features(indexed, segmenter), "features")
    one = F.lit("author").alias("author")
    gate = gates.adequacy(indexed.select(one, "admission", "split"), long.select(one, "split", *KEYS).distinct(), "author").first()
    if gate is None or gate["gate"]:
        raise CorpusTooSmall(gate["gate"] if gate else "no-eligible-document")
    stats = materialize(style.profile(long.where("split = 'train'")), "stats")
    return Profile(stats, materialize(style.standardized(long.where("split = 'calibrate'"), stats), "reference"))


def score(fitted: Profile, segments: DataFrame, evaluated: Evaluation | None = None) -> DataFrame:
    """(doc_id, seg, available, met, distance, reason, band) of paragraphs in long form; without an evaluation, or apart thresholds, no band.

    A band whose error isn't bounded within its target falls to drifting, which claims nothing.
    """
    devs = style.deviations(materialize(style.standardized(segments, fitted.stats), "standard"), fitted.reference)
    d = style.distances(devs, KEYS).withColumn("distance", F.round("distance", 9))
    apart = evaluated is not None and evaluated.verdict == "separated"
    return gates.calibrated_bands(d, evaluated.low if apart else 0.0, evaluated.high if apart else 0.0, evaluated.emitted if apart else {}, apart)


def evaluate(fitted: Profile, author: DataFrame, distractor: DataFrame, resamples: int = C.RESAMPLES, seed: int = C.BOOTSTRAP_SEED, segmenter: str = "line") -> Evaluation:
    """Thresholds from the author's calibrate paragraphs, and AUC, its lower bound and the bands' error bounds from the test ones, against all of the
    distractors'. Resamples draw whole documents. The corpora must share no content."""
    if not corpora.overlap(corpora.eligible(author), corpora.eligible(distractor)).isEmpty():
        raise ValueError("author and distractor share documents")
    columns = ["document", "distance"]
    own = features(author, segmenter)
    others = score(fitted, features(distractor, segmenter)).select(F.lit("distractor").alias("class"), F.col("doc_id").alias("document"), "distance")
    others = materialize(others, "distractor")

    def classed(split: str) -> DataFrame:
        held = score(fitted, own.where(F.col("split") == split)).select(F.lit("author").alias("class"), F.col("doc_id").alias("document"), "distance")
        return materialize(held.select("class", *columns).unionByName(others.select("class", *columns)), split)

    calibrate, test = classed("calibrate"), classed("test")
    limits = materialize(evaluation.thresholds(calibrate), "limits")
    row = limits.first()
    clusters = dict.fromkeys(("author", "distractor"), 0) | {r["class"]: r["n"] for r in test.where("distance is not null").groupBy("class").agg(F.countDistinct("document").alias("n")).collect()}
    drawn = materialize(evaluation.resampled(test, row["low"], row["high"], resamples, seed), "draws")
    bounds = materialize(evaluation.error_bounds(drawn, clusters["author"], clusters["distractor"]), "bounds")
    lower = materialize(evaluation.auc_bound(drawn, min(clusters.values())), "auc")
    verdict = evaluation.release(limits, bounds, lower).first()
    held = evaluation.intervals(materialize(evaluation.resampled(calibrate, resamples=resamples, seed=seed), "held")).first()
    by_band = bounds.collect()  # a row for each claiming band
    return Evaluation(
        row["low"], row["high"], row["verdict"], evaluation.auc(test).first()["auc"], {r["band"]: r["emitted"] for r in by_band}, {r["band"]: r["bound"] for r in by_band}, lower.first()["auc_lower"], held, verdict["reason"],
    )


def tells(corpus: DataFrame, rules: list[lint.Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, verdicts by document)."""
    found = materialize(lint.findings(corpus, rules if rules is not None else lint.default_rules()), "findings")
    return found, lint.severity_vector(found)


def plan_rewrite(scored: DataFrame, paragraphs: DataFrame, published: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(doc_id, seg, disposition) of scored paragraphs (doc_id, seg, line), published ones by hash h; chosen (doc_id, seg) makes targets explicit."""
    own = paragraphs.select(*KEYS, F.sha2(F.trim("line"), 256).alias("h"), F.contains("line", F.lit("`")).alias("excised"))
    asked = corpora.already_rewritten(scored.join(own, KEYS), published)
    if chosen is not None:
        asked = asked.join(chosen.select(*KEYS).distinct().withColumn("chosen", F.lit(True)), KEYS, "left").fillna(False, ["chosen"])
    return asked.select(*KEYS, rewrite.disposition(chosen is not None).alias("disposition"))


def judge_candidates(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_current, n_candidate, code): the first guard that a candidate fails."""
    return preserve.judged(pairs)


def measured(fitted: Profile, texts: DataFrame, evaluated: Evaluation | None = None) -> DataFrame:
    """(key, segments, distance, banded, features) of texts (key, text): how many paragraphs above the floor each is, and of one that is one, its distance,
    whether it falls in a band, and the features that the distance rests on."""
    lines = corpora.lines(texts.select(F.col("key").alias("doc_id"), "text"))
    standard = style.standardized(style.long_form(style.vectors(lines, floor=C.MIN_LEXICAL).drop("line")), fitted.stats)
    devs = style.deviations(materialize(standard, "standard"), fitted.reference)
    used = devs.where("dev is not null").groupBy(*KEYS).agg(F.array_sort(F.collect_set("feature")).alias("features"))
    apart = evaluated is not None and evaluated.verdict == "separated"
    d = style.distances(devs, KEYS).withColumn("distance", F.round("distance", 9))
    d = gates.calibrated_bands(d, evaluated.low if apart else 0.0, evaluated.high if apart else 0.0, evaluated.emitted if apart else {}, apart)
    each = d.join(used, KEYS, "left").groupBy("doc_id").agg(F.count("*").cast("int").alias("segments"), F.first("distance").alias("distance"), F.first(F.col("band").isNotNull()).alias("banded"), F.first("features").alias("features"))
    out = texts.select("key").join(each.withColumnRenamed("doc_id", "key"), "key", "left")
    one = F.col("segments") == 1
    return out.select("key", F.coalesce("segments", F.lit(0)).alias("segments"), *[F.when(one, F.col(c)).alias(c) for c in ("distance", "banded", "features")])


def execute(
    fitted: Profile, evaluated: Evaluation | None, documents: DataFrame, targets: DataFrame, candidates: DataFrame, rules: list[lint.Rule] | None = None, attempts: int = 3, allow_uncalibrated: bool = False
) -> tuple[rounds.Outcome, DataFrame, DataFrame]:
    """Rewrites targets (doc_id, start, length), included leaves of documents (doc_id, text), by candidates (doc_id, start, index, text).

    Gives the outcome of the rounds (a target is named doc_id:start), the assembled documents, and the check of every leaf that they must have. A candidate is
    measured, held against the original, looked through for tells, and put in its place before it may be accepted.
    """
    leaves = materialize(structure.document_leaves(documents), "leaves")
    name = F.concat_ws(":", "doc_id", "start").alias("target")
    own = materialize(targets.join(leaves.where("included and size(excisions) = 0"), ["doc_id", "start", "length"]).select("doc_id", "start", "length", name, F.col("text").alias("original")), "targets")
    offered = materialize(candidates.join(own, ["doc_id", "start"]).where(F.col("index") < attempts).select("doc_id", "start", "length", "target", "original", "index", F.coalesce("text", F.lit("")).alias("text")), "offered")
    # the originals are candidates of index -1
    every = materialize(offered.select("target", "index", "original", "text").unionByName(own.select("target", F.lit(-1).alias("index"), "original", F.col("original").alias("text"))), "every")
    key = F.concat_ws(":", "target", "index")
    scores = measured(fitted, every.select(key.alias("key"), "text"), evaluated)
    found = lint.findings(every.select(key.alias("doc_id"), "text"), rules if rules is not None else lint.default_rules())
    vector = lint.severity_vector(found).select(F.col("doc_id").alias("key"), *[F.col(c).cast("int").alias(c) for c in ("errors", "warns", "infos")])
    tells_of = every.select("target", "index", key.alias("key")).join(vector, "key")
    facts = rounds.against(every, tells_of).withColumn("key", key).join(scores, "key").drop("key")
    whole = publication.splices(documents, leaves, offered.select("doc_id", "start", "length", "index", "text")).select(name, "index", "intact")
    facts = materialize(facts.join(whole, ["target", "index"], "left").fillna(False, ["intact"]), "facts")
    outcome = rounds.run(facts.where("index = -1"), facts.where("index >= 0"), attempts, allow_uncalibrated)
    won = outcome.targets.where("changed").select("target", F.col("accepted").alias("index"))
    replaced = materialize(offered.join(won, ["target", "index"]).select("doc_id", "start", "length", "text"), "replacements")
    made = materialize(publication.assembled(documents, leaves, replaced), "assembled")
    return outcome, made, publication.checked(publication.expectations(leaves, replaced), made.select("doc_id", "text"))
