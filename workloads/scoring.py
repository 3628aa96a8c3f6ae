"""Encoding, scoring, explanation and evaluation queries."""

import numpy as np
from pyspark.sql import functions as F

from attendra import config
from attendra.operators import encoding as E
from attendra.operators import evaluation as V
from attendra.operators import quality as Q
from attendra.operators.explain import contributions
from attendra.operators.filters import flagged
from attendra.operators.permutation import permutation_importance
from attendra.operators.scoring import LogisticScorer, PandasScorer, SparkModelScorer
from attendra.plans.model_bundle import bundle, bundle_rows, load_bundle, save_bundle
from attendra.plans.risk_report import risk_rows, scoped_features
from attendra.plans.training_set import training_set
from attendra.sources.storage import materialize, new_path
from attendra.sources.versions import VersionedTable
from workloads import reports, standin
from workloads.registry import query


def features(t):
    """Batch feature rows of the target year."""
    return scoped_features(
        standin.batch_tables(t), standin.TARGET_YEAR, standin.COHORT, patterns=standin.PATTERNS
    )


VOCAB_SQL = """SELECT 'c_mktsegment' AS feature, c_mktsegment AS label,
        CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT c_mktsegment FROM customer)"""


@query("ml1_learn_vocab", VOCAB_SQL)
def learn_vocab(t):
    return E.learn_vocab(t.customer, ["c_mktsegment"])


@query(
    "ml1_encode",
    """WITH codes AS (
        SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT p_brand FROM part))
    SELECT p_partkey, COALESCE(code, CAST((SELECT MAX(code) + 1 FROM codes) AS INTEGER)) AS p_brand_index
    FROM part LEFT JOIN codes ON codes.p_brand = CASE WHEN p_size < 5 THEN 'New ' || part.p_brand ELSE part.p_brand END""",
)
def encode(t):
    """All brands are known; small parts carry labels that are not."""
    vocab = materialize(E.learn_vocab(t.part, ["p_brand"]), "vocab")
    label = F.when(F.col("p_size") < 5, F.concat(F.lit("New "), "p_brand")).otherwise(F.col("p_brand"))
    return E.encode(t.part.select("p_partkey", label.alias("p_brand")), vocab, ["p_brand"]).drop("p_brand")


@query(
    "ml1_growing_vocab",
    """WITH first AS (
        SELECT p_brand, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT p_brand, p_type FROM part JOIN lineitem ON l_partkey = p_partkey
              WHERE l_shipdate < DATE '1995-01-25')),
    old AS (SELECT DISTINCT p_type AS label, code, 1 AS version FROM first),
    new AS (
        SELECT p_type AS label, CAST((SELECT COALESCE(MAX(code), -1) FROM old) + dense_rank() OVER (ORDER BY p_type) AS INTEGER) AS code,
               2 AS version
        FROM (SELECT DISTINCT p_type FROM part WHERE p_type NOT IN (SELECT label FROM old)))
    SELECT label, code, version FROM old UNION ALL SELECT * FROM new""",
)
def growing_vocab(t):
    """Types of the parts shipped in the first weeks, then of all parts: old codes stay."""
    stored = VersionedTable(t.spark, new_path(t.spark, "vocab"))
    early = t.lineitem.filter(F.col("l_shipdate") < F.lit("1995-01-25").cast("date"))
    first = t.part.join(early, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    E.grow_vocab(stored, first, ["p_type"])
    E.grow_vocab(stored, t.part, ["p_type"])
    return stored.read().select("label", "code", "version")


INPUTS = [
    "attendance_rate_t_minus_1",
    "was_chronic_last_year",
    "chronic_condition_count",
    "dental_compliant",
    "student_gender",
]


@query(
    "ml2_feature_frame",
    f"WITH {standin.BATCH_FEATURES_SQL} SELECT student_key, {', '.join(INPUTS)} FROM features",
)
def feature_frame(t):
    return E.feature_frame(features(t), INPUTS, keep=["student_key"])


SCORES_SQL = f"""WITH {standin.BATCH_FEATURES_SQL}
    SELECT student_key, {standin.SCORE_SQL} AS risk_score FROM features"""


@query("ml3_score", SCORES_SQL)
def scores(t):
    return standin.SCORER.score(features(t)).select("student_key", "risk_score")


def pandas_scorer() -> PandasScorer:
    """The same weights as a model that lives in Python."""
    names = list(standin.SCORER.weights)
    weights = [standin.SCORER.weights[n] for n in names]
    intercept = standin.SCORER.intercept

    def load():
        vector = np.array(weights)

        def predict(batch):
            return 1 / (1 + np.exp(-(batch[names].to_numpy(dtype="float64") @ vector + intercept)))

        return predict

    return PandasScorer(load, names)


@query("ml3_score_pandas", SCORES_SQL)
def scores_pandas(t):
    return pandas_scorer().score(features(t)).select("student_key", "risk_score")


INDEXED = LogisticScorer(
    {**standin.SCORER.weights, "student_gender_index": 0.1, "student_current_grade_code_index": 0.02},
    standin.SCORER.intercept - 0.3,
)


@query(
    "ml3_score_indexed",
    f"""WITH {standin.BATCH_FEATURES_SQL}, genders AS (
        SELECT student_gender, dense_rank() OVER (ORDER BY student_gender) - 1 AS code
        FROM (SELECT DISTINCT student_gender FROM student WHERE student_gender IS NOT NULL)),
    grades AS (
        SELECT student_current_grade_code,
               dense_rank() OVER (ORDER BY student_current_grade_code) - 1 AS code
        FROM (SELECT DISTINCT student_current_grade_code FROM student)),
    indexed AS (
        SELECT f.*, COALESCE(g.code, (SELECT MAX(code) + 1 FROM genders)) AS student_gender_index,
               r.code AS student_current_grade_code_index
        FROM features f LEFT JOIN genders g USING (student_gender)
        LEFT JOIN grades r USING (student_current_grade_code))
    SELECT student_key, {standin.logistic_sql(INDEXED.weights, INDEXED.intercept)} AS risk_score
    FROM indexed""",
)
def scores_indexed(t):
    vocab = materialize(E.learn_vocab(standin.student(t), config.CATEGORY_FEATURES), "vocab")
    rows = risk_rows(
        standin.batch_tables(t),
        standin.TARGET_YEAR,
        standin.COHORT,
        INDEXED,
        vocab,
        patterns=standin.PATTERNS,
    )
    return rows.select("student_key", "risk_score")


def contributions_sql() -> str:
    cases = []
    for factor, (name, neutral) in config.NEUTRAL_VALUES.items():
        replaced = {name: f"CAST({neutral} AS DOUBLE)"}
        if name == "attendance_rate_t_minus_1":
            replaced["was_chronic_last_year"] = "0"
        changed = standin.logistic_sql(standin.SCORER.weights, standin.SCORER.intercept, replaced)
        cases.append(f"SELECT student_key, '{factor}' AS factor, {changed} AS changed FROM features")
    return f"""WITH {standin.BATCH_FEATURES_SQL},
    base AS (SELECT student_key, {standin.SCORE_SQL} AS risk_score FROM features),
    cases AS ({" UNION ALL ".join(cases)}),
    effects AS (
        SELECT student_key, factor, risk_score - changed AS delta
        FROM base JOIN cases USING (student_key)
        WHERE risk_score >= 0.4 AND abs(risk_score - changed) > 0.001)
    SELECT student_key, factor, round(delta, 4) AS delta,
        CASE WHEN delta > 0 THEN 'risk' ELSE 'protective' END AS direction,
        CAST(row_number() OVER (PARTITION BY student_key ORDER BY abs(delta) DESC, factor) AS INTEGER)
            AS rank
    FROM effects QUALIFY rank <= 12"""


@query("ml4_contributions", contributions_sql())
def explained(t):
    atrisk = flagged(standin.SCORER.score(features(t)), config.RISK_THRESHOLD)
    return contributions(atrisk, standin.SCORER)


@query("ml4_contributions_pandas", contributions_sql())
def explained_pandas(t):
    scorer = pandas_scorer()
    atrisk = flagged(scorer.score(features(t)), config.RISK_THRESHOLD)
    return contributions(atrisk, scorer)


class ScoreOnly:
    """A scorer without counterfactuals of its own."""

    def score(self, df):
        return standin.SCORER.score(df)


@query("ml4_contributions_rescored", contributions_sql())
def explained_rescored(t):
    atrisk = flagged(standin.SCORER.score(features(t)), config.RISK_THRESHOLD)
    return contributions(atrisk, ScoreOnly())


@query(
    "ml5_sweep",
    f"""WITH {standin.SCORED_SQL}
    SELECT school_name, COUNT(*) AS total, CAST(threshold AS DOUBLE) AS threshold,
        CAST(count_if(risk_score >= threshold) AS BIGINT) AS flagged,
        round(count_if(risk_score >= threshold) / COUNT(*), 6) AS share
    FROM scored, (SELECT unnest([0.4, 0.5, 0.6]) AS threshold) GROUP BY school_name, threshold""",
)
def sweep(t):
    swept = V.sweep(standin.scored(t), by="school_name")
    return swept.withColumn("share", F.round("share", 6))


# Truth for the light scores: a rate below two thirds.
LABELLED_SQL = f"""{standin.SCORED_SQL}, labelled AS (
    SELECT risk_score, CAST(prior_yr_attendance < 0.66 AS INTEGER) AS label
    FROM scored WHERE risk_score IS NOT NULL)"""


def labelled(t):
    known = standin.scored(t).filter(F.col("risk_score").isNotNull())
    return known.select("risk_score", (F.col("prior_yr_attendance") < 0.66).cast("int").alias("label"))


@query(
    "ml6_evaluate",
    f"""WITH {LABELLED_SQL}, counts AS (
        SELECT CAST(count_if(risk_score >= 0.4 AND label = 1) AS BIGINT) AS tp,
               CAST(count_if(risk_score >= 0.4 AND label = 0) AS BIGINT) AS fp,
               CAST(count_if(risk_score < 0.4 AND label = 0) AS BIGINT) AS tn,
               CAST(count_if(risk_score < 0.4 AND label = 1) AS BIGINT) AS fn FROM labelled)
    SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
        round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity,
        round(tn / (tn + fn), 6) AS negative_predictive_value,
        round((tp + fp) / (tp + fp + tn + fn), 6) AS flagged_share FROM counts""",
)
def evaluate(t):
    result = V.evaluate(labelled(t), "label")
    ratios = ["accuracy", "recall", "specificity", "negative_predictive_value", "flagged_share"]
    return result.withColumns({c: F.round(c, 6) for c in ratios})


@query(
    "ml7_best_threshold",
    f"""WITH {LABELLED_SQL}, steps AS (
        SELECT risk_score AS threshold, COUNT(*) AS n, SUM(label) AS pos FROM labelled GROUP BY 1),
    curve AS (
        SELECT threshold, SUM(n) OVER w AS flagged, SUM(pos) OVER w AS tp, SUM(pos) OVER () AS positives
        FROM steps WINDOW w AS (ORDER BY threshold DESC))
    SELECT threshold, CAST(flagged AS BIGINT) AS flagged, CAST(tp AS BIGINT) AS tp,
        CAST(positives AS BIGINT) AS positives, round(2 * tp / (flagged + positives), 6) AS f1
    FROM curve ORDER BY 2 * tp / (flagged + positives) DESC, threshold LIMIT 1""",
)
def best_threshold(t):
    return V.best_threshold(labelled(t), "label").withColumn("f1", F.round("f1", 6))


def encoded_rows(t):
    """Training rows with all model inputs, encoded as they are read."""
    tables = standin.placed_by_year(standin.tables(t))
    rows = materialize(training_set(tables, patterns=standin.PATTERNS), "training")
    vocab = materialize(E.learn_vocab(rows, config.CATEGORY_FEATURES), "vocab")
    return E.encode(rows, vocab, config.CATEGORY_FEATURES)


def training_rows(t):
    """Stored training rows with all model inputs."""
    return materialize(encoded_rows(t), "encoded")


@query("ml7_fit")
def fit(t):
    """Figures of a held-out year: trained before Y-1, threshold from Y-1, measured on Y."""
    return V.fit_held_out(training_rows(t)).figures


@query("ml8_importance")
def importance(t):
    model, _ = V.fit(encoded_rows(t))
    return V.importance(t.spark, model)


YEAR_PARTS = "CASE WHEN school_year = last THEN 'measure' WHEN school_year = last - 1 THEN 'choose' ELSE 'learn' END"


@query(
    "ml7_split",
    f"""WITH {reports.TRAINING_SQL}, ends AS (SELECT MAX(school_year) AS last FROM features)
    SELECT {YEAR_PARTS} AS part, school_year, is_chronic_current_year, COUNT(*) AS n,
           COUNT(DISTINCT student_key) AS students
    FROM features, ends GROUP BY ALL""",
)
def split(t):
    """Rows of every part by year and label; each student-year is in one part."""
    rows = materialize(reports.training(t).select("student_key", "school_year", config.LABEL), "training")
    parts = V.split_by_period(rows)
    named = [getattr(parts, name).withColumn("part", F.lit(name)) for name in ("learn", "choose", "measure")]
    every = named[0].unionByName(named[1]).unionByName(named[2])
    return every.groupBy("part", "school_year", config.LABEL).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("student_key").alias("students")
    )


SCORED_TRAINING_SQL = f"""{reports.TRAINING_SQL}, judged AS (
    SELECT student_key, school_year, {standin.SCORE_SQL} AS risk_score, is_chronic_current_year AS label FROM features)"""


def scored_training(t):
    """Training rows with the fixed scorer's scores."""
    scored = standin.SCORER.score(reports.training(t))
    return scored.select("student_key", "school_year", "risk_score", F.col(config.LABEL).alias("label"))


def quality_sql(source: str, by: str) -> str:
    """AUC by ranks with ties, and Brier scores, straight from the rows."""
    return f"""ranked AS (
        SELECT *, rank() OVER (PARTITION BY {by} ORDER BY risk_score)
                  + (COUNT(*) OVER (PARTITION BY {by}, risk_score) - 1) / 2 AS place
        FROM {source} WHERE risk_score IS NOT NULL AND label IS NOT NULL),
    quality AS (
        SELECT {by}, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS positives,
               (SUM(place) FILTER (label = 1) - SUM(label) * (SUM(label) + 1) / 2)
                 / nullif(SUM(label) * SUM(1 - label), 0) AS auc,
               AVG((risk_score - label) ** 2) AS brier, AVG(label) * (1 - AVG(label)) AS base_brier
        FROM ranked GROUP BY {by})"""


@query(
    "ml6_held_out",
    f"""WITH {SCORED_TRAINING_SQL}, ends AS (SELECT MAX(school_year) AS last FROM judged),
    steps AS (
        SELECT risk_score AS threshold, COUNT(*) AS n, SUM(label) AS pos
        FROM judged, ends WHERE school_year = last - 1 GROUP BY 1),
    curve AS (
        SELECT threshold, SUM(n) OVER w AS flagged, SUM(pos) OVER w AS tp, SUM(pos) OVER () AS positives
        FROM steps WINDOW w AS (ORDER BY threshold DESC)),
    chosen AS (SELECT threshold FROM curve ORDER BY 2 * tp / (flagged + positives) DESC, threshold LIMIT 1),
    held AS (SELECT judged.* FROM judged, ends WHERE school_year = last),
    {quality_sql("held", "school_year")},
    counts AS (
        SELECT threshold, CAST(count_if(risk_score >= threshold AND label = 1) AS BIGINT) AS tp,
               CAST(count_if(risk_score >= threshold AND label = 0) AS BIGINT) AS fp,
               CAST(count_if(risk_score < threshold AND label = 0) AS BIGINT) AS tn,
               CAST(count_if(risk_score < threshold AND label = 1) AS BIGINT) AS fn
        FROM held, chosen GROUP BY threshold)
    SELECT threshold, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
        round(tp / (tp + fn), 6) AS recall, round(auc, 6) AS auc, round(brier, 6) AS brier
    FROM counts, quality""",
)
def held_out(t):
    parts = V.split_by_period(materialize(scored_training(t), "scored"))
    found = V.measure_held_out(parts.choose, parts.measure, "label")
    rounded = (F.round(c, 6).alias(c) for c in ("accuracy", "recall", "auc", "brier"))
    return found.select("threshold", "tp", "fp", "tn", "fn", *rounded)


@query(
    "ml6_rank_quality",
    f"""WITH {SCORED_TRAINING_SQL}, {quality_sql("judged", "school_year")}
    SELECT school_year, n, positives, round(auc, 6) AS auc, round(brier, 6) AS brier,
           round(base_brier, 6) AS base_brier FROM quality""",
)
def rank_quality(t):
    """Per year, from histograms of the two halves of the students added up."""
    scored = materialize(scored_training(t), "scored")
    halves = [scored.filter(F.col("student_key") % 2 == half) for half in (0, 1)]
    merged = Q.merge_histograms([Q.score_histogram(h, "label", by=["school_year"]) for h in halves], ["school_year"])
    found = Q.rank_quality(merged, ["school_year"])
    return found.withColumns({c: F.round(c, 6) for c in ("auc", "brier", "base_brier")})


@query(
    "ml6_calibration",
    f"""WITH {SCORED_TRAINING_SQL}
    SELECT least(CAST(floor(round(risk_score * 10000) * 10 / 10000) AS INTEGER), 9) AS bin, COUNT(*) AS n,
           CAST(SUM(label) AS BIGINT) AS positives, round(AVG(risk_score), 6) AS mean_score,
           round(AVG(label), 6) AS positive_share
    FROM judged WHERE risk_score IS NOT NULL AND label IS NOT NULL GROUP BY 1""",
)
def calibration(t):
    found = Q.calibration(Q.score_histogram(scored_training(t), "label"))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_score", "positive_share")})


SHUFFLED = ("attendance_rate_t_minus_1", "tardy_total_t_minus_1", "student_504_indicator", "was_chronic_last_year")


def permutation_sql() -> str:
    cases = [f"SELECT '(none)' AS factor, {standin.SCORE_SQL} AS risk_score, label FROM paired"]
    for factor in SHUFFLED:
        replaced = {factor: f"other_{factor}"}
        if factor == "attendance_rate_t_minus_1":
            replaced["was_chronic_last_year"] = f"CAST(other_{factor} < 0.90 AS INTEGER)"
        score = standin.logistic_sql(standin.SCORER.weights, standin.SCORER.intercept, replaced)
        cases.append(f"SELECT '{factor}' AS factor, {score} AS risk_score, label FROM paired")
    others = ", ".join(f"d.{c} AS other_{c}" for c in SHUFFLED)
    return f"""WITH {reports.TRAINING_SQL}, kept AS MATERIALIZED (
        SELECT *, is_chronic_current_year AS label,
               row_number() OVER (ORDER BY student_key, school_year) AS place,
               row_number() OVER (ORDER BY md5(student_key || '|' || school_year || '|42'), student_key, school_year) AS given
        FROM features),
    paired AS (SELECT r.*, {others} FROM kept r JOIN kept d ON r.place = d.given),
    cases AS ({" UNION ALL ".join(cases)}), {quality_sql("cases", "factor")}
    SELECT q.factor, round(q.auc, 6) AS auc, round(b.auc - q.auc, 6) AS auc_loss,
           round(q.brier - b.brier, 6) AS brier_gain
    FROM quality q, quality b WHERE b.factor = '(none)' AND q.factor <> '(none)'"""


@query("ml8_permutation", permutation_sql())
def permutation(t):
    rows = materialize(reports.training(t), "training")
    found = permutation_importance(rows, standin.SCORER, SHUFFLED, ["student_key", "school_year"])
    return found.select("factor", *(F.round(c, 6).alias(c) for c in ("auc", "auc_loss", "brier_gain")))


@query(
    "ml7_stored",
    f"""WITH {standin.BATCH_FEATURES_SQL}, scored AS (SELECT *, {standin.SCORE_SQL} AS risk_score FROM features)
    SELECT student_key, risk_score, CASE WHEN risk_score <= 0.45 THEN 'Low Risk'
        WHEN risk_score <= 0.6 THEN 'Elevated Risk' ELSE 'High Risk' END AS risk_tier FROM scored""",
)
def stored_model(t):
    """Report rows by a model, threshold and input order read back from a bundle."""
    path = new_path(t.spark, "bundle")
    save_bundle(bundle(standin.SCORER, 0.45, learned_until=standin.TARGET_YEAR - 1), t.spark, path)
    kept = load_bundle(t.spark, path)
    rows = bundle_rows(
        standin.batch_tables(t), standin.TARGET_YEAR, standin.COHORT, kept, patterns=standin.PATTERNS
    )
    return rows.select("student_key", "risk_score", "risk_tier")


@query("ml7_stored_trees")
def stored_trees(t):
    """Report rows by boosted trees, in-session and read back with their vocabularies; both scores must agree."""
    tables = standin.tables(t)
    rows = materialize(training_set(standin.placed_by_year(tables), patterns=standin.PATTERNS), "training")
    vocab = materialize(E.learn_vocab(rows, config.CATEGORY_FEATURES), "vocab")
    encoded = materialize(E.encode(rows, vocab, config.CATEGORY_FEATURES), "encoded")
    held = V.fit_held_out(encoded, last=standin.TARGET_YEAR)
    path = new_path(t.spark, "bundle")
    made = bundle(SparkModelScorer(held.model), held.threshold, vocab, held.learned_until)
    save_bundle(made, t.spark, path)
    found = bundle_rows(
        tables, standin.TARGET_YEAR, standin.COHORT, load_bundle(t.spark, path), patterns=standin.PATTERNS
    )
    now = bundle_rows(tables, standin.TARGET_YEAR, standin.COHORT, made, patterns=standin.PATTERNS)
    unsaved = now.select("student_key", F.col("risk_score").alias("unsaved_score"))
    return found.select("student_key", "risk_score", "risk_tier").join(unsaved, "student_key")
