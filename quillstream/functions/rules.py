"""Decision rules as column expressions: queue membership, relevance, risk, failures, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Least scores of the risk levels above low, and the default relevance threshold.
RISK_LEVELS = ((85, "critical"), (65, "high"), (35, "medium"))
RELEVANCE_THRESHOLD = 70
# HTTP statuses worth another try, by who answered (besides 500 and above).
RETRY_FETCH, RETRY_SCORER = (403, 408, 425, 429), (408, 409, 425, 429)
# Seconds that a crawler rests after a failure.
COOLDOWN = {"robots_denied": 24 * 3600, "access_blocked": 24 * 3600, "temporarily_unavailable": 15 * 60}
UNRECORDED = ("cooldown", "disabled")


def risk_level(score: Column) -> Column:
    level = F.lit("low")
    for least, name in reversed(RISK_LEVELS):
        level = F.when(score >= least, F.lit(name)).otherwise(level)
    return level


def is_candidate(now: Column, content: str = "ic", review: str = "rr", business: str = "ba") -> Column:
    """Whether an article, outer-joined with its content, review and analysis, awaits work. Comparisons with null are
    unknown and so not true: a stage in progress is no candidate; a stale hash is one again."""
    ic, rr, ba = (lambda name, t=t: F.col(f"{t}.{name}") for t in (content, review, business))
    retry = (ic("status") == "failed") & (ic("is_terminal") == 0) & ic("ignored_at").isNull() & (ic("next_retry_at").isNull() | (ic("next_retry_at") <= now))
    unanalysed = ba("article_id").isNull() | (ba("analysis_status") == "failed") | (ba("content_hash") != ic("content_hash"))
    unreviewed = rr("article_id").isNull() | (rr("status") == "failed") | (rr("content_hash") != ic("content_hash"))
    ready = (ic("status") == "success") & (unreviewed | ((rr("status") == "success") & (rr("is_relevant") == 1) & unanalysed))
    return F.coalesce(ic("article_id").isNull() | retry | ready, F.lit(False))


def queue_rank(content: str = "ic") -> Column:
    """0 unread, 1 content there, 2 to retry."""
    return F.when(F.col(f"{content}.article_id").isNull(), 0).when(F.col(f"{content}.status") == "success", 1).otherwise(2)


def disposition(now: Column, ignored: Column, terminal: Column, retry: Column) -> Column:
    return F.when(ignored.isNotNull(), "ignored").when(terminal == 1, "final_failed").when(retry.isNotNull() & (retry > now), "waiting").otherwise("retry_ready")


def failure_rank(ignored: Column, terminal: Column) -> Column:
    return F.when(ignored.isNull() & (terminal == 1), 0).when(ignored.isNull(), 1).otherwise(2)


def category_relevant(named: dict[str, str], new_versions: tuple[str, ...], category: Column, review: str = "rr") -> Column:
    """Whether a successful positive review counts for a keyword's category.

    named: categories with a rule of their own, and the review code that older prompts used for each. Reviews of a new
    prompt version name keyword categories themselves. Any other category, or none, takes every relevant review.
    """
    rr = lambda name: F.col(f"{review}.{name}")
    code = F.lit(None).cast("string")
    for name, old in named.items():
        code = F.when(category == name, F.lit(old)).otherwise(code)
    new = rr("prompt_version").isin(*new_versions)
    by_name = F.array_contains(rr("keyword_categories"), category)
    by_code = (rr("category") == code) | F.array_contains(rr("secondary_categories"), code)
    fits = category.isNull() | code.isNull() | (new & by_name) | (~new & by_code)
    return (rr("status") == "success") & (rr("is_relevant") == 1) & F.coalesce(fits, F.lit(False))


def gated(threshold: int, review: str | None = None) -> dict[str, Column]:
    """Columns of a review after the threshold: relevant with a score under it is irrelevant, category other, lists empty,
    and the reason says so."""
    c = lambda name: F.col(f"{review}.{name}" if review else name)
    low = (c("is_relevant") == 1) & (c("relevance_score") < threshold)
    out = (c("is_relevant") != 1) | low
    none = F.array().cast(T.ArrayType(T.StringType()))
    return {
        "is_relevant": F.when(low, 0).otherwise(c("is_relevant")),
        "category": F.when(out, "other").otherwise(c("category")),
        "secondary_categories": F.when(out, none).otherwise(F.array_remove(F.array_distinct(c("secondary_categories")), c("category"))),
        "keyword_categories": F.when(out, none).otherwise(F.array_distinct(c("keyword_categories"))),
        "relevance_reason": F.when(low, F.concat(c("relevance_reason"), F.lit(f" (score below {threshold})"))).otherwise(c("relevance_reason")),
    }


def assessment_fault(codes: tuple[str, ...], review: bool = True) -> Column:
    """Why a scorer's row is refused, null if it is sound: enums, bounds and list lengths."""
    checks = [("category", ~F.col("category").isin(*codes) | F.col("category").isNull()), ("secondary_categories", (F.size("secondary_categories") > 2) | F.exists("secondary_categories", lambda v: ~v.isin(*codes)))]
    if review:
        checks += [("relevance_score", ~F.col("relevance_score").between(0, 100)), ("confidence", ~F.col("confidence").between(0, 100)), ("relevance_reason", ~F.length("relevance_reason").between(1, 1000)), ("evidence", F.size("evidence") > 8), ("keyword_categories", F.size("keyword_categories") > 3)]
    else:
        checks += [("summary", ~F.length("summary").between(1, 1500)), ("impact_score", ~F.col("impact_score").between(1, 5)), ("impact_analysis", ~F.length("impact_analysis").between(1, 2000)), ("risk_score", ~F.col("risk_score").between(0, 100)), ("risk_level", ~F.col("risk_level").isin("low", "medium", "high", "critical")), ("impact_direction", ~F.col("impact_direction").isin("positive", "negative", "mixed", "neutral"))]
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks])


def retryable(status: Column, who: str = "fetch") -> Column:
    return status.isin(*(RETRY_FETCH if who == "fetch" else RETRY_SCORER)) | (status >= 500)


def crawler_failure(status: Column, allowed: Column) -> Column:
    """Failure kind of a crawler's answer; null for one that may be read."""
    return F.when(~allowed, "robots_denied").when(status == 429, "rate_limited").when(status.isin(401, 403), "access_blocked").when(status >= 500, "temporarily_unavailable").when(status >= 400, "crawler_error")


def cooldown_seconds(kind: Column, explicit: Column, setting: Column) -> Column:
    """What the answer itself asked for, else the kind's rest, else the setting; null for kinds that are not recorded."""
    rest = F.lit(None).cast("int")
    for name, seconds in COOLDOWN.items():
        rest = F.when(kind == name, F.lit(seconds)).otherwise(rest)
    return F.when(~kind.isin(*UNRECORDED), F.coalesce(F.when(explicit.isNotNull(), F.greatest(F.lit(1), explicit)), rest, setting))


def run_status(failed: Column, succeeded: Column, pending: Column) -> Column:
    return F.when(pending > 0, "partial").when(failed == 0, "success").when(succeeded == 0, "failed").otherwise("partial")


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def valid_ids(ids: Column, allowed: Column) -> Column:
    """Ids that are allowed, in order and once each."""
    return F.array_distinct(F.filter(ids, lambda x: F.array_contains(allowed, x)))


def cited_details(details: Column, allowed: Column) -> Column:
    """Details with their allowed citations only; those left without any go."""
    kept = F.transform(details, lambda d: F.struct(d["title"].alias("title"), d["content"].alias("content"), valid_ids(d["article_ids"], allowed).alias("article_ids")))
    return F.filter(kept, lambda d: F.size(d["article_ids"]) > 0)


def positive_ids(values: Column) -> Column:
    """Distinct positive whole numbers among strings; a fraction is none."""
    ids = F.transform(values, lambda v: F.when(v.rlike(r"^\s*[+-]?[0-9]+\s*$"), v.try_cast("bigint")))
    return F.array_distinct(F.filter(ids, lambda v: v.isNotNull() & (v > 0)))


def json_list(c: Column) -> Column:
    """A JSON list of strings; empty for null, blank or broken text."""
    return F.coalesce(F.from_json(c, T.ArrayType(T.StringType())), F.array().cast(T.ArrayType(T.StringType())))


def clamped(value: str | None, low: int, high: int, default: int) -> int:
    try:
        return max(low, min(high, int(value)))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
