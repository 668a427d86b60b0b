"""Problem 1: is a text running language, or an enumeration, record or junk?

Method: every text gets a vector of statistics; each language has a robust
mean and covariance of its prose; the squared Mahalanobis distance to them says
how far a text is from running language, and its terms, one per statistic, say
why. The fit starts from medians and median deviations and is then
reweighted: mean and covariance of the texts within a cutoff, a few times over.
All sums are taken over all texts, in one aggregate of fixed size per step.

Statistics are Spark expressions; distances and sums are matrix products over
Arrow batches. Besides the rows per key nothing is shuffled but sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..io import table
from ..session import stage

#: Common function words by language.
COMMON = {
    "en": "the no of and to a an in is was that it for on with as by at from are were be this which who not or have had they their his her its but while near into one under where now before after during through behind beside them",
    "de": "der die das und ist ein eine einen im in den dem von vom zu mit auf nicht sich des es wird während daneben steht aus auch liegt am",
    "es": "el la los las de del que y en un una por con no para su al se es lo como más donde sin junto desde nadie",
    "fr": "le la les de des du et un une dans est que qui pour pas sur au aux par ne avec près plus sans d n a depuis devant",
    "it": "il lo la gli le di che e un una in per non con del della sono è al nel più senza",
    "pt": "o os as de que e um uma em por com não para do da no na se é mais sem",
    "nl": "de het een en van in is op te dat die voor met niet aan zijn er ook zonder",
}
FALLBACK = "en"
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœ"
#: Runs of fewer than four count as three.
CONSONANTS = "[bcdfghjklmnpqrstvwxzßçñ]{4,}"
#: Words from which a phrase can be told from a label.
LABEL_WORDS = 3

STATISTICS = [
    "log_words",
    "mean_word_length",
    "symbol_ratio",
    "digit_word_share",
    "common_share",
    "content_run",
    "separator_rate",
    "repeat_share",
    "line_end_share",
    "line_rate",
    "vowel_share",
    "consonant_run",
]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``k, t, language, n`` and STATISTICS of every text that is not null or blank.

    Tags and entities are dress: they are taken out of what is counted as text
    but count as symbols. The language is the one whose common words are most
    frequent; texts without any are measured against the fallback.
    """
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col(key).isNotNull() & F.col(text).rlike(r"[^\s\p{Z}]"))
    bare = F.regexp_replace("t", r"</?(?:p|b|i|em|strong|br|span)\s*/?>|&nbsp;|&#\d{1,5};|&[a-z]{2,6};", " ")
    bare = F.regexp_replace(bare, r"[\p{Mn}\p{Cf}]+", "")
    # what sites put around a caption
    bare = F.regexp_replace(bare, r"(?i)\s*(?:see more at|via|more at|from)\s+(?:https?://|www\.)\S+", " ")
    out = out.withColumn("b", F.regexp_replace(F.regexp_replace(bare, r"[ \t\p{Z}]+", " "), r"^\s+|\s+$", ""))
    out = out.withColumn("w", _words(F.lower("b"))).withColumn("n", F.size("w")).withColumn("size", F.length(F.regexp_replace("b", r"\s+", "")))
    named = {lang: F.array(*[F.lit(x) for x in dict.fromkeys(words.split())]) for lang, words in COMMON.items()}
    # most texts are settled by the fallback's words alone; the other lists are looked at for the rest only
    hits = {lang: F.size(F.array_intersect("w", listed)) for lang, listed in named.items()}
    ranked = F.array_max(F.array(*[F.struct(h.alias("h"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, h) in enumerate(hits.items())]))
    chosen = F.when(hits[FALLBACK] >= 0.25 * F.col("n"), F.lit(FALLBACK)).otherwise(ranked["lang"])
    foreign = F.regexp_count("b", F.lit(r"[\p{L}&&[^\p{IsLatin}]]")) > 0.5 * F.col("size")
    chosen = F.when(foreign, F.lit("other")).otherwise(chosen)
    out = out.withColumn("language", chosen)
    in_language = F.lit(None).cast("array<string>")
    for lang, listed in named.items():
        in_language = F.when(F.col("language") == lang, listed).otherwise(in_language)
    out = out.withColumn("own", F.coalesce(in_language, F.array().cast("array<string>")))
    # a word is a dot if it is common in its language, else a dash
    out = out.withColumn("marks", F.array_join(F.transform("w", lambda x: F.when(F.array_contains("own", x), F.lit(".")).otherwise(F.lit("-"))), ""))
    run = F.array_max(F.transform(F.split("marks", r"\."), lambda x: F.length(x)))
    words = F.greatest("n", F.lit(1)).cast("double")
    size = F.greatest("size", F.lit(1)).cast("double")
    lines = F.filter(F.split("b", r"[\r\n]+"), lambda x: F.trim(x) != "")
    return (
        out.withColumn("lines", lines)
        .withColumn("joined", F.array_join("w", ""))
        .withColumn("joined_by_space", F.array_join("w", " "))
        .select(
            "k",
            "language",
            "n",
            F.ln(words).alias("log_words"),
            (F.length("joined") / words).cast("double").alias("mean_word_length"),
            (F.regexp_count("b", F.lit(r"[^\p{L}\p{N}\s.,;'’-]")) / size).alias("symbol_ratio"),
            (F.size(F.filter("w", lambda x: x.rlike(r"\p{N}"))) / words).alias("digit_word_share"),
            F.when(F.col("language") == "other", F.lit(0.4)).otherwise(F.length(F.replace("marks", F.lit("-"), F.lit(""))) / words).alias("common_share"),
            F.when(F.col("language") == "other", F.lit(1.5)).otherwise(F.ln(1.0 + run)).alias("content_run"),
            (F.regexp_count("b", F.lit(r"[,;:|/\\•*=»\t_#]")) / words).alias("separator_rate"),
            (F.lit(1.0) - F.size(F.array_distinct("w")) / words).alias("repeat_share"),
            (F.size(F.filter("lines", lambda x: x.rlike(r"[.!?…。！？]\s*$"))) / F.greatest(F.size("lines"), F.lit(1))).cast("double").alias("line_end_share"),
            (F.ln(F.greatest(F.size("lines"), F.lit(1)).cast("double"))).alias("line_rate"),
            F.when(F.col("language") == "other", F.lit(0.4)).otherwise((F.length("joined") - F.length(F.translate("joined", VOWELS, ""))) / F.greatest(F.length("joined"), F.lit(1))).alias("vowel_share"),
            F.when(F.col("language") == "other", F.lit(3.0)).otherwise(F.coalesce(F.array_max(F.transform(F.regexp_extract_all("joined_by_space", F.lit(CONSONANTS), 0), lambda x: F.length(x))), F.lit(3)).cast("double")).alias("consonant_run"),
        )
    )


class ProseModel:
    """Mean and inverse covariance of the statistics by language; a few numbers, sent with the tasks."""

    def __init__(self, means: dict[str, np.ndarray], inverses: dict[str, np.ndarray]) -> None:
        self.means, self.inverses = means, inverses
        self.default = FALLBACK if FALLBACK in means else min(means)

    def terms(self, languages: np.ndarray, x: np.ndarray) -> np.ndarray:
        """One term per text and statistic; their sum over the statistics is the squared distance."""
        out = np.empty_like(x)
        known = np.where(np.isin(languages, list(self.means)), languages, self.default)
        for lang in np.unique(known):
            own = known == lang
            apart = x[own] - self.means[lang]
            out[own] = apart * (apart @ self.inverses[lang])
        return out


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    languages = batch.column("language").to_numpy(zero_copy_only=False).astype("U8")
    return languages, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS]).astype("f8")


def _sums(whole: DataFrame, model: ProseModel, inner: float) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Per language the number of texts within ``inner``, and the sums of statistics and of their products.

    Every batch gives one row of sums per language; Spark adds them up.
    """
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                languages, x = _matrix(batch)
                inside = model.terms(languages, x).sum(axis=1) <= inner
                for lang in np.unique(languages[inside]):
                    own = x[inside & (languages == lang)]
                    sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                    total[str(lang)] = total.get(str(lang), 0) + sums
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["language", "sums"])

    parts = whole.select("language", *STATISTICS).mapInArrow(run, "language string, sums array<double>")
    added = parts.select("language", F.posexplode("sums").alias("i", "v")).groupBy("language", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in added.collect():  # languages x (1 + d + d * d) numbers
        out.setdefault(r.language, np.zeros(1 + d + d * d))[r.i] = r.v
    return {lang: (int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d)) for lang, v in out.items()}


#: The least standard deviation a statistic counts with, so that one that is constant in prose does not decide alone.
FLOOR = np.array([0.35, 0.6, 0.02, 0.06, 0.09, 0.22, 0.09, 0.08, 0.5, 0.35, 0.06, 1.0])
#: A language with fewer texts in the fit is measured against the fallback's model.
LEAST_TEXTS = 30
STEPS = 3
#: Share by which correlations are shrunk.
SHRINK = 0.3
#: Squared distance up to which a text takes part in the next step of the fit.
INNER = 25.0


def fit_prose(measured: DataFrame) -> ProseModel:
    """Robust mean and covariance per language, from all texts of LABEL_WORDS + 1 words or more."""
    d = len(STATISTICS)
    whole = measured.where(F.col("n") > LABEL_WORDS)
    quantiles = [F.percentile_approx(s, [0.25, 0.5, 0.75], 2000).alias(s) for s in STATISTICS]
    start = whole.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *quantiles).collect()  # one row per language
    means, inverses = {}, {}
    for r in start:
        if r.n >= LEAST_TEXTS:
            means[r.language] = np.array([r[s][1] for s in STATISTICS], "f8")
            spread = np.maximum([(r[s][2] - r[s][0]) / 1.349 for s in STATISTICS], FLOOR)
            inverses[r.language] = np.diag(1.0 / spread**2)
    if not means:
        return ProseModel({FALLBACK: np.zeros(d)}, {FALLBACK: np.diag(1.0 / FLOOR**2)})
    model = ProseModel(means, inverses)
    for _ in range(STEPS):
        means, inverses = {}, {}
        for lang, (n, sums, products) in _sums(whole, model, INNER).items():
            if n < LEAST_TEXTS:
                continue
            mean = sums / n
            cov = products / n - np.outer(mean, mean)
            # correlations are shrunk, as texts made to one pattern correlate almost perfectly;
            # statistics that hardly vary get the floor as their spread
            spread = np.diag(cov)
            cov = (1 - SHRINK) * cov + SHRINK * np.diag(spread) + np.diag(np.maximum(FLOOR**2 - spread, 0))
            means[lang], inverses[lang] = mean, np.linalg.inv(cov)
        if not means:
            break
        model = ProseModel(means, inverses)
    return model


#: Squared distance from which a text is no running language.
CUTOFF = 30.0


def prose_distance(docs: DataFrame, key: str = "id", text: str = "caption", cutoff: float = CUTOFF) -> DataFrame:
    """``key, language, words``, STATISTICS, ``distance``, ``by_<statistic>`` and ``is_prose``.

    One row per distinct key whose text is not null or blank; of a key with
    several texts the smallest counts. Texts of up to three ordinary words are
    labels: is_prose is null for them. Ordinary words hold no digits or symbols
    and enough vowels to be spoken. Ties and
    repeated texts get equal values. An empty table gives an empty result.
    """
    one = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.min(text).alias(text))
    measured = stage(statistics(one, key, text), "statistics")
    model = fit_prose(measured)
    by = [f"by_{name}" for name in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = model.terms(*_matrix(batch)) if batch.num_rows else np.empty((0, len(STATISTICS)))
            arrays = [*batch.columns, pa.array(terms.sum(axis=1).round(6)), *[pa.array(terms[:, i].round(6)) for i in range(len(STATISTICS))]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "distance", *by])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema)
    scored = measured.mapInArrow(run, f"{kinds}, distance double, " + ", ".join(f"{c} double" for c in by))
    label = (F.col("n") <= LABEL_WORDS) & (F.col("n") > 0) & (F.col("digit_word_share") == 0) & (F.col("symbol_ratio") <= 0.05)
    label = label & (F.col("mean_word_length") <= 14) & (F.col("vowel_share") >= 0.25) & (F.col("consonant_run") <= 4)
    return scored.select(
        F.col("k").alias(key),
        "language",
        F.col("n").alias("words"),
        *STATISTICS,
        "distance",
        *by,
        F.when(~label, F.col("distance") < cutoff).alias("is_prose"),
    )


def _captions(spark: SparkSession, folder: str) -> DataFrame:
    return prose_distance(table(spark, folder, "images"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Images whose caption is no running language."""
    return _captions(spark, folder).where("is_prose = false").select("id")


def p1_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _captions(spark, folder)


QUERIES = {"p1_found": p1_found, "p1_statistics": p1_statistics}
