"""What must hold before a step may use what another made: policies, fresh drafts, performed checks, usable profiles, attested screens, whole bundles."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from . import corpus, identity

REGISTER = "^[a-z0-9][a-z0-9-]{0,31}$"
OVERLAP = "overlap-exact-hash-v1"
#: Checks without which a corpus isn't qualified prose.
QUALIFYING = ("near-duplicate", "language", "contamination", "source-control", "structure")


@dataclass(frozen=True)
class Policy:
    """How a corpus is admitted and split. Anything outside of its vocabulary is refused when it is made."""

    register: str
    role: str = "author"
    min_lexical: int = 1
    seed: str = "penstroke-v1"
    weights: dict[str, int] = field(default_factory=lambda: {"train": 8, "calibrate": 1, "test": 1})

    def __post_init__(self) -> None:
        problem = (
            "register" if not re.match(REGISTER, self.register) else "role" if self.role not in ("author", "distractor") else "min_lexical" if self.min_lexical < 1 else "seed" if not self.seed
            else "weights" if set(self.weights) != {"train", "calibrate", "test"} or any(w <= 0 for w in self.weights.values()) else ""
        )
        if problem:
            raise ValueError(f"policy: {problem}")

    def identity(self, spark) -> str:
        return identity.policy_id(spark, register=self.register, role=self.role, min_lexical=self.min_lexical, seed=self.seed, weights="/".join(str(self.weights[k]) for k in ("train", "calibrate", "test")))


def invalid_at(content: Column) -> Column:
    """The offset of the first byte that isn't UTF-8, or null. Valid content, which the engine finds by itself, isn't decoded again."""

    def first(raw: bytes | None) -> int | None:
        try:
            bytes(raw or b"").decode("utf-8")
        except UnicodeDecodeError as e:
            return e.start
        return None

    return F.udf(first, "long", useArrow=True)(F.when(~F.is_valid_utf8(content.cast("string")), content))


def freshness(drafts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of drafts (path, content_hash) against files (path, content) as they are now: ok, stale, missing, or not-local for a path that
    leads out of its folder."""
    j = drafts.select("path", "content_hash").join(files.select("path", "content", F.lit(True).alias("there")), "path", "left")
    local = ~F.col("path").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\")
    return j.select("path", F.when(~local, "not-local").when(F.col("there").isNull(), "missing").when(F.sha2("content", 256) == F.col("content_hash"), "ok").otherwise("stale").alias("state"))


def draft_snapshot(documents: DataFrame, path: str, min_lexical: int = 1) -> DataFrame:
    """The one document of a path, admitted by itself, in the split of drafts; one that isn't eligible, or isn't there, raises."""
    own = corpus.admitted(documents.where(F.col("path") == path), min_lexical)
    row = own.select("admission").first()
    if row is None:
        raise LookupError(path)
    if row["admission"] != "eligible":
        raise ValueError(f"{path}: {row['admission']}")
    return own.withColumn("split", F.lit("draft"))


def requires_checks(statuses: DataFrame) -> bool:
    """Whether a check (check_name, state) that qualifies a corpus wasn't performed, or isn't among them."""
    done = statuses.where(F.col("check_name").isin(*QUALIFYING) & (F.col("state") != "not-performed")).select("check_name").distinct().count()
    return done < len(QUALIFYING)


def usable(profiles: DataFrame, stats: DataFrame) -> DataFrame:
    """(profile_id, reason) of profiles (profile_id, unit, floor, documents, paragraphs) with their statistics (profile_id, feature, n, mean, variance);
    an empty reason for those that may be used."""
    finite = F.col("mean").isNotNull() & ~F.isnan("mean") & F.col("variance").isNotNull() & ~F.isnan("variance") & (F.col("variance") >= 0)
    held = stats.groupBy("profile_id").agg(F.countDistinct("feature").alias("features"), F.count("*").alias("rows"), F.count_if(F.col("feature").isin(*C.FEATURES)).alias("known"), F.count_if(finite | (F.col("n") < C.MIN_OBSERVATIONS)).alias("sound"))
    j = profiles.join(held, "profile_id", "left").fillna(0, ["features", "rows", "known", "sound"])
    n = len(C.FEATURES)
    reason = (
        F.when(F.col("unit") != "paragraph", "other-unit").when(F.col("floor") < 1, "no-floor").when((F.col("known") != n) | (F.col("rows") != n) | (F.col("features") != n), "other-manifest")
        .when(F.col("documents") < C.MIN_DOCUMENTS, "too-few-documents").when(F.col("paragraphs") < C.MIN_PARAGRAPHS, "too-few-paragraphs").when(F.col("sound") != n, "unsound-statistics").otherwise("")
    )
    return j.select("profile_id", reason.alias("reason"))


def overlap_attestation(author: DataFrame, distractor: DataFrame) -> DataFrame:
    """One row (author_id, distractor_id, algorithm, state, shared): what a screen of two corpora's content found, bound to what was screened."""
    spark = author.sparkSession
    ids = [identity.tree_id(d.select(F.col("content_hash").alias("digest"))) for d in (author, distractor)]
    shared = corpus.overlap(author, distractor).count()
    return spark.createDataFrame([(*ids, OVERLAP, "failed" if shared else "passed", shared)], "author_id string, distractor_id string, algorithm string, state string, shared long")


def attested(screens: DataFrame, author_id: str, distractor_id: str, algorithm: str = OVERLAP) -> str:
    """Why a pair of corpora isn't proved to share nothing, or empty: there must be a screen of this very pair, by this algorithm, that passed and found nothing."""
    rows = screens.where((F.col("author_id") == author_id) & (F.col("distractor_id") == distractor_id)).groupBy("algorithm", "state", "shared").count().limit(3).collect()
    if not rows:
        return "not-screened"
    if len(rows) > 1:
        return "contradicting-screens"
    r = rows[0]
    return "other-algorithm" if r["algorithm"] != algorithm else "overlapping" if r["state"] != "passed" or r["shared"] else ""


def bundles(heads: DataFrame, references: DataFrame, releases: DataFrame) -> DataFrame:
    """(register, profile_id, reference_id, release_id, state) of heads (register, profile_id): what scoring loads together. The sole reference of the
    profile is used; state is ok, no-reference or ambiguous-reference; a missing release only means that nothing is calibrated."""
    refs = references.groupBy("profile_id").agg(F.countDistinct("id").alias("n"), F.min("id").alias("reference_id"))
    out = heads.join(refs, "profile_id", "left").join(releases.groupBy("profile_id").agg(F.max("id").alias("release_id")), "profile_id", "left")
    state = F.when(F.col("n").isNull(), "no-reference").when(F.col("n") > 1, "ambiguous-reference").otherwise("ok")
    return out.select("register", "profile_id", F.when(F.col("n") == 1, F.col("reference_id")).alias("reference_id"), "release_id", state.alias("state"))


def chosen_paragraphs(value: str) -> list[int]:
    """The paragraphs that a list names: decimal numbers with commas between, none twice."""
    parts = value.split(",")
    if not all(re.fullmatch("[0-9]+", p) for p in parts):
        raise ValueError(f"not a list of paragraphs: {value!r}")
    out = [int(p) for p in parts]
    if len(set(out)) != len(out):
        raise ValueError(f"a paragraph is named twice: {value!r}")
    return out


def same_set(a: str, b: str) -> Column:
    """Whether two arrays hold the same values equally often, in any order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def unlike_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two frames of the same columns has more often, and how often more (`n`, negative where b has more). Both are counted before they meet."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_s")).unionByName(b.select(*columns, F.lit(-1).alias("_s")))
    return both.groupBy(*columns).agg(F.sum("_s").alias("n")).where("n <> 0")


def report_counts(scored: DataFrame, floor: DataFrame, key: str) -> DataFrame:
    """(key, segments, below_floor, measured, in_range, drifting, not_you) of scored paragraphs (key, distance, band) and of paragraphs below the floor (key)."""
    own = scored.groupBy(key).agg(
        F.count("*").alias("segments"), F.count("distance").alias("measured"), *[F.count_if(F.col("band") == b).alias(b.replace("-", "_")) for b in ("in-range", "drifting", "not-you")]
    )
    return own.join(floor.groupBy(key).agg(F.count("*").alias("below_floor")), key, "full").fillna(0)

