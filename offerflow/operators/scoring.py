"""Offer scoring: pairs with the CV, prompt text, the scorer plug point,
verdict parsing, the dead-letter table and the analysis backlog.

The reference hands each (description, CV) pair to an outside model. Here
the scorer is pluggable with a fixed verdict schema; the default scorer is
ours, deterministic and fully native (skill-hit ratio), so it runs inside
whole-stage codegen. A user scorer runs through ``mapInArrow``, on pandas
frames of a few megabytes, never per row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clip
from ..schemas import VERDICT_RAW
from .state import new_offers

CHAR_LIMIT = 8000
#: Bytes of pairs (texts and CVs) that a scorer is given at once, about.
SCORER_BYTES = 2 << 20

#: Default prompt (the model call itself is outside this library); any text with the two slots may be given.
PROMPT_TEMPLATE = "Offer:\n{description}\n---\nApplicant:\n{cv}\n---\nReply with match_score (0 to 100), missing_skills and advice.\n"

# Score bands and their report colours.
BAND_HIGH, BAND_MID = 70, 45
COLOR_GREEN, COLOR_YELLOW, COLOR_RED = "#28a745", "#ffc107", "#dc3545"


def offer_cv_pairs(offers: DataFrame, resumes: DataFrame) -> DataFrame:
    """Pair each matched offer (with profile_id) with that search's CV."""
    return offers.join(resumes.select("profile_id", "cv_text"), "profile_id")


def render_prompt_col(desc: str = "description", cv: str = "cv_text", n: int = CHAR_LIMIT,
                      template: str = PROMPT_TEMPLATE) -> Column:
    """``template`` with the description, cut at ``n`` characters, and the CV in its slots, in this order."""
    head, rest = template.split("{description}")
    mid, tail = rest.split("{cv}")
    return F.concat(F.lit(head), clip(desc, n), F.lit(mid), F.coalesce(F.col(cv), F.lit("")), F.lit(tail))


def render_prompt(pairs: DataFrame, template: str = PROMPT_TEMPLATE) -> DataFrame:
    return pairs.withColumn("prompt", render_prompt_col(template=template))


def score_band_col(score: str | Column = "match_score", legacy: bool = False) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    if legacy:
        s = F.coalesce(s, F.lit(0))
    return (F.when(s >= BAND_HIGH, F.lit("green"))
            .when(s >= BAND_MID, F.lit("yellow"))
            .when(s.isNotNull(), F.lit("red")))


def band_color_col(band: str | Column = "band") -> Column:
    b = F.col(band) if isinstance(band, str) else band
    return (F.when(b == "green", F.lit(COLOR_GREEN)).when(b == "yellow", F.lit(COLOR_YELLOW))
            .otherwise(F.lit(COLOR_RED)))


LDESC = "_ldesc"


def with_scoring_text(offers: DataFrame, desc: str = "description") -> DataFrame:
    """Adds the lower-cased description once per offer, so that a
    join fanning offers out to many searches does not redo it per pair."""
    return offers.withColumn(LDESC, F.lower(F.col(desc)))


_FOUND = "_found"


def skill_hits_col(desc: str = "description", skills: str = "skills", ldesc: str | None = None) -> Column:
    """Per skill of the search, in order: (skill, found as a substring of the
    whole, lower-cased description)."""
    d = F.col(ldesc) if ldesc else F.lower(F.col(desc))
    sk = F.coalesce(F.col(skills), F.array().cast("array<string>"))
    return F.transform(sk, lambda s: F.struct(s.alias("s"), d.contains(F.lower(s)).alias("hit")))


def default_verdict_cols(found: str = _FOUND) -> list[Column]:
    """Our default scorer over the skill hits: share of the search's skills
    found; missing skills keep their order."""
    f = F.col(found)
    n_sk = F.size(f)
    n_hit = F.size(F.filter(f, lambda x: x["hit"]))
    # round(100 * hits / n) half up, in integers: (200 * hits + n) div (2 * n)
    score = F.when(n_sk == 0, F.lit(0)).otherwise(
        F.floor((n_hit * 200 + n_sk) / (n_sk * 2))).cast("int")
    missing = F.transform(F.filter(f, lambda x: ~x["hit"]), lambda x: x["s"])
    advice = (F.when(score >= BAND_HIGH, F.lit("Strong fit: apply."))
              .when(score >= BAND_MID, F.lit("Partial fit: close the missing skills first."))
              .otherwise(F.lit("Weak fit: skip unless the role interests you.")))
    return [score.alias("match_score"), missing.alias("missing_skills"), advice.alias("advice")]


ScorerFn = Callable[[pd.DataFrame], pd.DataFrame]


def score_offers(pairs: DataFrame, scorer: ScorerFn | None = None, template: str = PROMPT_TEMPLATE) -> DataFrame:
    """Adds match_score, missing_skills, advice and error.

    ``scorer`` gets slices of about SCORER_BYTES, so that a worker holds few texts as
    Python objects, and few prompts, however many rows Spark hands it at once. It gets a pandas batch (columns of ``pairs`` plus ``prompt``) and
    returns a frame of the same length with match_score, missing_skills,
    advice and optionally error. When it raises, the batch is scored offer by
    offer, so only those that raise by themselves are marked failed.
    """
    guarded = pairs.where(F.length("description") > 0)
    if scorer is None:
        ld = LDESC if LDESC in pairs.columns else None
        # the substring tests run once per pair: the hits are a column of
        # their own, read by score, missing skills and advice
        hits = guarded.withColumn(_FOUND, skill_hits_col(ldesc=ld))
        out = hits.select("*", *default_verdict_cols(), F.lit(None).cast("string").alias("error")).drop(_FOUND)
        return out.drop(LDESC) if ld else out

    # the prompts are made slice by slice in the worker: they are as long as the texts
    head, rest = template.split("{description}")
    mid, tail = rest.split("{cv}")
    verdict = {"match_score": (T.IntegerType(), pa.int32()), "missing_skills": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
               "advice": (T.StringType(), pa.string()), "error": (T.StringType(), pa.string())}
    taken = guarded.drop("prompt", *verdict)
    out_schema = T.StructType([*taken.schema.fields, T.StructField("prompt", T.StringType()),
                               *(T.StructField(c, t) for c, (t, _) in verdict.items())])

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        res = scorer(pdf)
        out = pd.DataFrame(index=pdf.index)
        out["match_score"] = pd.to_numeric(res.get("match_score"), errors="coerce").astype("Int32")
        out["missing_skills"] = res.get("missing_skills")
        out["advice"] = res.get("advice")
        out["error"] = res["error"] if "error" in res else None
        return out

    def verdicts(part: pa.RecordBatch):
        pdf = _frame(part)
        pdf["prompt"] = [head + d[:CHAR_LIMIT] + mid + ("" if pd.isna(c) else c) + tail for d, c in zip(pdf["description"], pdf["cv_text"])]
        prompts = pa.array(pdf["prompt"], pa.string())
        try:
            out = scored(pdf)
        except Exception as exc:  # noqa: BLE001 - kept as dead letters
            if len(pdf) > 1:
                del pdf, prompts
                for i in range(part.num_rows):
                    yield from verdicts(part.slice(i, 1))
                return
            out = pd.DataFrame({"match_score": [None], "missing_skills": [None], "advice": [None], "error": [f"{type(exc).__name__}: {exc}"]})
        columns = [pa.array(out[c], t, from_pandas=True) for c, (_, t) in verdict.items()]
        yield pa.RecordBatch.from_arrays([*part.columns, prompts, *columns], names=out_schema.names)

    def run(batches):
        for batch in batches:
            rows = max(1, batch.num_rows * SCORER_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield from verdicts(batch.slice(at, rows))

    return taken.mapInArrow(run, out_schema)


def _frame(part: pa.RecordBatch) -> pd.DataFrame:
    """As Spark hands frames to pandas functions: times without a zone, maps as dicts."""
    pdf = part.to_pandas(maps_as_pydicts="lossy")
    for c in pdf.columns:
        if isinstance(pdf[c].dtype, pd.DatetimeTZDtype):
            pdf[c] = pdf[c].dt.tz_localize(None)
    return pdf


def scored_ok(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("error").isNull() & F.col("match_score").isNotNull())


def dead_letter(scored: DataFrame) -> DataFrame:
    """Offers whose scoring failed, with the reason; they return to the backlog."""
    return scored.where(F.col("error").isNotNull() | F.col("match_score").isNull()).withColumn(
        "error", F.coalesce(F.col("error"), F.lit("no_score")))


def parse_verdict(raw: DataFrame, col: str = "raw") -> DataFrame:
    """Raw JSON reply -> typed verdict + verdict_error.

    The score is read as text and cast with ``try_cast`` so "80" passes, and
    80.5, 180 and non-JSON are rejected with a reason instead of silently
    turning into null or an out-of-range score.
    """
    parsed = F.from_json(F.col(col), VERDICT_RAW)
    p = raw.withColumn("_v", parsed)
    score_txt = F.col("_v.match_score")
    as_dec = F.expr("try_cast(trim(_v.match_score) AS DECIMAL(20,6))")
    score = F.when(as_dec.isNotNull() & (as_dec == F.floor(as_dec)) & (F.abs(as_dec) <= F.lit(2147483647)),
                   as_dec.cast("int"))
    is_json = F.get_json_object(F.col(col), "$").isNotNull()
    err = (F.when(~F.coalesce(is_json, F.lit(False)) | F.col("_v").isNull(), F.lit("not_json"))
           .when(score_txt.isNull(), F.lit("missing_score"))
           .when(score.isNull(), F.lit("score_not_integer"))
           .when((score < 0) | (score > 100), F.lit("score_out_of_range"))
           .when(F.col("_v.missing_skills").isNull(), F.lit("missing_skills_null"))
           .when(F.col("_v.advice").isNull(), F.lit("missing_advice")))
    return p.select(
        *[c for c in raw.columns],
        score.alias("match_score"),
        F.col("_v.missing_skills").alias("missing_skills"),
        F.col("_v.advice").alias("advice"),
        err.alias("verdict_error"),
    )


def analysis_backlog(offers: DataFrame, results: DataFrame, url: str = "url") -> DataFrame:
    """Offers not analysed yet (by URL; null URLs in results ignored) and
    with a description."""
    done = results.select(F.col(url).alias("job_url")).where(F.col("job_url").isNotNull()).distinct()
    return new_offers(offers, done).where(F.length("description") > 0)


def to_result(scored: DataFrame) -> DataFrame:
    """Offer + verdict to the nested result row (URL as string)."""
    return scored.select(
        *[c for c in ("profile_id", "batch_id", "seq") if c in scored.columns],
        F.col("company"), F.col("title"), F.col("job_url").cast("string").alias("url"), F.col("location"),
        F.struct(F.col("match_score").cast("int").alias("match_score"),
                 F.col("missing_skills"), F.col("advice")).alias("analysis"),
    )
