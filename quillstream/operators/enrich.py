"""The enrichment queue: content, then a relevance gate, then analysis, as pure transitions of tables.

Readers and scorers are functions from an iterator of pandas frames to one, run by mapInPandas over a set number of
partitions; each phase is checkpointed before the next begins. A deterministic scorer by rules is the default.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import dates, rules, text
from quillstream.operators import merge
from quillstream.operators.lineage import cut
from quillstream.sources.tables import SCHEMAS, Tables

Stage = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
CONTENT = "article_id long, requested_url string, final_url string, full_text string, http_status int, content_type string, failure_kind string, retryable boolean, message string"
REVIEW = "article_id long, is_relevant int, relevance_score int, relevance_reason string, category string, secondary_categories array<string>, keyword_categories array<string>, evidence array<string>, confidence int, prompt_tokens long, completion_tokens long, error string"
ANALYSIS = "article_id long, category string, secondary_categories array<string>, summary string, impact_direction string, impact_score int, impact_analysis string, risk_level string, risk_score int, risk_factors array<string>, opportunities array<string>, recommended_actions array<string>, evidence array<string>, prompt_tokens long, completion_tokens long, error string"


def star(t: Tables) -> DataFrame:
    """Articles outer-joined with content (ic), review (rr) and analysis (ba): one to one, all on the article's id."""
    a = t["articles"].alias("a")
    for name, alias in (("article_contents", "ic"), ("article_relevance_reviews", "rr"), ("business_articles", "ba")):
        a = a.join(t[name].alias(alias), F.col("a.id") == F.col(f"{alias}.article_id"), "left")
    return a


def candidates(t: Tables, now: Column, limit: int | None = None, force: bool = False, article_ids: list[int] | None = None, run_id: int | None = None) -> DataFrame:
    """(article_id, rank) of what awaits work: unread first, then ready, then to retry; newest first. force takes everything,
    and an empty id list is no filter."""
    rows = star(t)
    if not force:
        rows = rows.where(rules.is_candidate(now))
    if article_ids:
        rows = rows.where(F.col("a.id").isin(article_ids))
    if run_id is not None:
        started = t["collection_runs"].where(F.col("id") == run_id).select(F.col("started_at").alias("_at"))
        rows = rows.join(started, F.col("a.collected_at") == F.col("_at"), "left_semi")
    rows = rows.select(F.col("a.id").alias("article_id"), rules.queue_rank().alias("rank"), F.col("a.published_at").alias("published_at")).orderBy("rank", F.desc("published_at"), F.desc("article_id"))
    return rows.limit(limit) if limit is not None else rows


def batches(queue: DataFrame, size: int) -> DataFrame:
    """The ordered queue with batch numbers from 0; size is kept within 1..100. Rows are numbered within ranges of the order."""
    newest = F.coalesce(-F.unix_micros("published_at"), F.lit((1 << 63) - 1))
    ordered = queue.withColumn("_order", F.struct("rank", newest.alias("newest"), (-F.col("article_id")).alias("last")))
    nth = merge.next_ids(queue.sparkSession.createDataFrame([], "id long"), ordered, "_order")
    return nth.withColumn("batch", F.floor((F.col("id") - 1) / max(1, min(100, size))).cast("int")).drop("_order", "id")


def with_content(contents: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Contents after reader results: success resets the retry state; a failure counts, waits twice as long each time, and
    is final after three attempts or where no other try can help."""
    r = results.alias("r").join(contents.select("article_id", F.col("attempt_count").alias("_before")), "article_id", "left")
    ok = F.col("failure_kind").isNull()
    attempt = F.coalesce("_before", F.lit(0)) + 1
    r = r.withColumn("_clean", F.when(ok, text.normalize_full_text(F.col("full_text"))))  # a step of its own, so that it is done once for all three
    new = r.select(
        "article_id", F.when(ok, "success").otherwise("failed").alias("status"), "requested_url", F.when(ok, F.col("final_url")).alias("final_url"), F.col("_clean").alias("full_text"),
        F.when(ok, text.content_hash(F.col("_clean"))).alias("content_hash"), F.when(ok, F.length("_clean")).alias("content_chars"), "http_status", "content_type", F.lit("injected").alias("extractor"), now.cast("timestamp").alias("fetched_at"),
        F.when(ok, "").otherwise(F.substring("message", 1, 2000)).alias("error_message"), F.when(ok, 0).otherwise(attempt).alias("attempt_count"), F.when(ok, "").otherwise(F.substring("failure_kind", 1, 100)).alias("failure_kind"),
        F.when(ok, None).otherwise(dates.next_retry(now, attempt, F.col("retryable"))).alias("next_retry_at"), F.when(ok, 0).otherwise((~F.col("retryable") | (attempt >= dates.MAX_ATTEMPTS)).cast("int")).alias("is_terminal"), F.lit(None).cast("timestamp").alias("ignored_at"),
    )
    return merge.upsert(contents, new.withColumn("seq", F.lit(1)), ["article_id"])


def retried(contents: DataFrame, article_id: int) -> DataFrame:
    """A failed content made new again by hand."""
    hit = (F.col("article_id") == article_id) & (F.col("status") == "failed")
    new = {"attempt_count": F.lit(0), "failure_kind": F.lit(""), "next_retry_at": F.lit(None).cast("timestamp"), "is_terminal": F.lit(0), "ignored_at": F.lit(None).cast("timestamp")}
    return contents.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()})


def ignored(contents: DataFrame, article_id: int, now: Column) -> DataFrame:
    hit = (F.col("article_id") == article_id) & (F.col("status") == "failed")
    new = {"is_terminal": F.lit(1), "next_retry_at": F.lit(None).cast("timestamp"), "ignored_at": now.cast("timestamp")}
    return contents.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()})


@dataclass(frozen=True)
class Boundary:
    """What assessments may say of a company: sentences that match the pattern stay only if the text itself names it. The notes
    say so where they went; ``paths`` say by category how its event may reach the company, ``other_path`` for the rest."""

    pattern: str
    review_note: str = ""
    analysis_note: str = ""
    paths: tuple[tuple[str, str], ...] = ()
    other_path: str = ""
    summary: str = ""

    def named(self) -> Column:
        return F.coalesce(F.col("full_text").rlike(self.pattern), F.lit(False))

    def without(self, c: Column) -> Column:
        return F.coalesce(text.sentences_without(c, self.pattern), F.lit(""))

    def unnamed(self, values: str) -> Column:
        return F.filter(values, lambda v: ~v.rlike(self.pattern))

    def review(self) -> dict[str, Column]:
        reason = F.substring(F.concat(self.without(F.col("relevance_reason")), F.lit(self.review_note)), 1, 1000)
        return {c: F.when(self.named(), F.col(c)).otherwise(new) for c, new in (("relevance_reason", reason), ("evidence", self.unnamed("evidence")))}

    def analysis(self) -> dict[str, Column]:
        path = F.lit(self.other_path)
        for category, told in self.paths:
            path = F.when(F.col("category") == category, F.lit(told)).otherwise(path)
        said = lambda c: F.nullif(self.without(F.col(c)), F.lit(""))
        new = {"summary": F.coalesce(said("summary"), F.lit(self.summary)), "impact_analysis": F.concat(F.coalesce(said("impact_analysis"), path), F.lit(self.analysis_note)), "evidence": self.unnamed("evidence")}
        new |= {c: F.filter(F.transform(c, self.without), lambda v: v != "") for c in ("risk_factors", "opportunities", "recommended_actions")}
        return {c: F.when(self.named(), F.col(c)).otherwise(v) for c, v in new.items()}


def with_reviews(t: Tables, results: DataFrame, now: Column, codes: tuple[str, ...], threshold: int, version: str, boundary: Boundary | None = None) -> Tables:
    """Tables after scorer results: refused or failed ones are stored as failed; sound ones pass the boundary and the gate, and
    a negative review takes the accepted row away."""
    fault = F.coalesce(F.col("error"), rules.assessment_fault(codes))
    r = results.withColumn("fault", fault).join(t["article_contents"].select("article_id", "content_hash", "full_text"), "article_id")
    r = r.withColumns(boundary.review()) if boundary else r
    r = r.withColumns(rules.gated(threshold)).withColumn("evidence", text.clean_list(F.col("evidence")))
    bad = F.col("fault").isNotNull()
    kept = [f.name for f in SCHEMAS["article_relevance_reviews"].fields if f.name in ("is_relevant", "relevance_score", "relevance_reason", "category", "secondary_categories", "keyword_categories", "evidence", "confidence")]
    new = r.select("article_id", F.when(bad, "failed").otherwise("success").alias("status"), "content_hash", *[F.when(~bad, F.col(c)).alias(c) for c in kept], F.lit(version).alias("prompt_version"), now.cast("timestamp").alias("reviewed_at"), F.coalesce("fault", F.lit("")).alias("error_message"))
    negative = new.where("status = 'success' and is_relevant = 0").select("article_id")
    return t | {"article_relevance_reviews": merge.upsert(t["article_relevance_reviews"], new.withColumn("seq", F.lit(1)), ["article_id"]), "business_articles": t["business_articles"].join(negative, "article_id", "left_anti")}


def with_analyses(t: Tables, results: DataFrame, now: Column, codes: tuple[str, ...], boundary: Boundary | None = None) -> Tables:
    """Tables after analyses: refused or failed ones are stored as failed."""
    r = results.withColumn("fault", F.coalesce(F.col("error"), rules.assessment_fault(codes, review=False))).join(t["article_contents"].select("article_id", "content_hash", "full_text"), "article_id")
    lists = ("risk_factors", "opportunities", "recommended_actions", "evidence")
    r = r.withColumns(boundary.analysis()) if boundary else r
    r = r.withColumns({c: text.clean_list(F.col(c)) for c in lists} | {"secondary_categories": F.array_remove(F.array_distinct("secondary_categories"), F.col("category"))})
    bad = F.col("fault").isNotNull()
    kept = [c for c in SCHEMAS["business_articles"].names if c not in ("article_id", "analysis_status", "content_hash", "analyzed_at", "error_message")]
    new = r.select("article_id", F.when(bad, "failed").otherwise("success").alias("analysis_status"), "content_hash", *[F.when(~bad, F.col(c)).alias(c) for c in kept], now.cast("timestamp").alias("analyzed_at"), F.coalesce("fault", F.lit("")).alias("error_message"))
    return t | {"business_articles": merge.upsert(t["business_articles"], new.withColumn("seq", F.lit(1)), ["article_id"])}


def run_outcomes(items: DataFrame) -> DataFrame:
    """A row for each run from its items: counts, and the status that follows from them."""
    c = items.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin("pending", "processing")).alias("pending"),
        F.count_if(F.col("is_relevant") == 1).alias("relevant"), F.count_if((F.col("status") == "success") & (F.col("is_relevant") == 0)).alias("irrelevant"),
    )
    return c.withColumn("status", rules.run_status(F.col("failed"), F.col("succeeded"), F.col("pending")))


def folded_events(events: DataFrame) -> DataFrame:
    """Run items from a log of stage events (run_id, article_id, seq, and the fields that changed, the others null): the last
    value of each field."""
    fields = [c for c in SCHEMAS["ai_analysis_run_items"].names if c not in ("run_id", "article_id")]
    return events.groupBy("run_id", "article_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields])


def rule_reader(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A reader without network: an article's own summary is its text; a blank one is a failure that may pass."""
    for pdf in rows:
        body = (pdf["title"].fillna("") + "\n" + pdf["summary"].fillna("")).str.strip()
        ok = pdf["summary"].fillna("").str.strip() != ""
        yield pd.DataFrame({"article_id": pdf["article_id"], "requested_url": pdf["url"], "final_url": pdf["url"], "full_text": body, "http_status": 200, "content_type": "text/plain", "failure_kind": [None if x else "empty_content" for x in ok], "retryable": True, "message": ["" if x else "no text" for x in ok]})


def rule_scorer(terms: tuple[str, ...], category: str = "other") -> Stage:
    """A scorer by rules: 40 points for each term that the text holds, up to 100; relevant with any. It charges two tokens an article, and one a term."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            held = [[t for t in terms if t.casefold() in (x or "").casefold()] for x in pdf["full_text"]]
            yield pd.DataFrame({
                "article_id": pdf["article_id"], "is_relevant": [int(bool(h)) for h in held], "relevance_score": [min(100, 40 * len(h)) for h in held], "relevance_reason": ["holds " + ", ".join(h) if h else "holds no term" for h in held],
                "category": [category if h else "other" for h in held], "secondary_categories": [[] for _ in held], "keyword_categories": [[] for _ in held], "evidence": held, "confidence": 100, "prompt_tokens": 2, "completion_tokens": [len(h) for h in held], "error": None,
            })

    return run


def rule_analyst(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An analysis by rules; its risk is a hash of the text, so that reruns agree. It charges three tokens an article."""
    for pdf in rows:
        risk = [int(hashlib.sha256((x or "").encode()).hexdigest()[:4], 16) % 101 for x in pdf["full_text"]]
        none = [[] for _ in risk]
        yield pd.DataFrame({
            "article_id": pdf["article_id"], "category": pdf["category"], "secondary_categories": none, "summary": [(x or "-")[:200] for x in pdf["full_text"]], "impact_direction": "neutral", "impact_score": 1, "impact_analysis": "by rule",
            "risk_level": ["critical" if r >= 85 else "high" if r >= 65 else "medium" if r >= 35 else "low" for r in risk], "risk_score": risk, "risk_factors": none, "opportunities": none, "recommended_actions": none, "evidence": none, "prompt_tokens": 3, "completion_tokens": 0, "error": None,
        })


#: What each task tells its model of an article, besides the text: a review sees the article alone, an analysis its review too.
TASKS = {"review": ("title", "publisher", "published_at"), "analysis": ("title", "publisher", "published_at", "category", "relevance_reason"), "report": ("article_id", "title", "publisher", "published_at", "category", "risk_score", "summary", "matched_keyword_names")}


def prompt(rows: DataFrame, instruction: str, most_chars: int = 30000, task: str = "review", profile: str = "") -> DataFrame:
    """Rows with system and user prompts of a task: the instruction, led by the company's profile where there is one, and the
    task's fields as compact JSON, with the text cut. A report has no text: it is about many articles."""
    fields = [F.col(c).cast("string").alias(c) if c == "published_at" else F.col(c) for c in TASKS[task] if c in rows.columns]
    if task != "report":
        body, cut_off = text.truncated(F.col("full_text"), most_chars)
        fields += [body.alias("full_text"), cut_off.alias("truncated")]
    return rows.withColumns({"system_prompt": F.lit("\n\n".join(x for x in (profile, instruction) if x)), "user_prompt": F.to_json(F.struct(*fields))})


def report_prompt(inputs: DataFrame, instruction: str, day: str, profile: str = "") -> DataFrame:
    """One row: the prompts of a day's report over its articles (what report.report_input gives), the riskiest first."""
    told = inputs.select(*[F.col(c).cast("string").alias(c) if c == "published_at" else F.col(c) for c in TASKS["report"] if c in inputs.columns])
    order = F.struct((-F.col("risk_score")).alias("risk"), F.col("article_id").alias("id"), F.struct(*told.columns).alias("a"))
    rows = told.agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["a"]).alias("articles"))
    user = F.to_json(F.struct(F.lit(day).alias("report_date"), F.size("articles").alias("article_count"), "articles"))
    return rows.select(F.lit("\n\n".join(x for x in (profile, instruction) if x)).alias("system_prompt"), user.alias("user_prompt"))


# Ends of the failure kinds that stop a batch for all, and that are worth one try at once.
STOPPING, AT_ONCE = ("_http_429", "_web_search_unavailable"), ("_web_unavailable",)


def guarded(reader: Stage, step: int = 20) -> Stage:
    """The reader asked for ``step`` articles at a time: failures that pass at once are tried once more, and after one that
    means that the provider refuses everybody the rest of the partition is not asked for, so it stays in the queue."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                told = list(reader(iter([part])))
                if not told:
                    continue
                got = pd.concat(told, ignore_index=True)
                kind = got["failure_kind"].fillna("")
                once = got.loc[kind.str.endswith(AT_ONCE) & got["retryable"].fillna(False).astype(bool), "article_id"]
                if len(once):
                    again = reader(iter([part[part["article_id"].isin(once)]]))
                    got = pd.concat([got[~got["article_id"].isin(once)], *again], ignore_index=True)
                    kind = got["failure_kind"].fillna("")
                yield got
                if kind.str.endswith(STOPPING).any():
                    return

    return run


#: Rounds in which a service is asked: after each it is known whether it refuses everybody.
ROUNDS = 4


def answers(rows: DataFrame, stage: Stage, schema: str, parallelism: int | None, refuses: bool = False) -> DataFrame:
    """What a stage says of rows, written as it comes. With ``parallelism`` (1 to 20) it asks a service: as many requests are in flight as
    tasks, in rounds by the article's hash, and where ``refuses``, once an answer of a round means that the provider refuses everybody, the
    rounds behind it ask nothing; what was answered is kept. Without, a stage is local work, and Spark's partitions are left alone."""
    if parallelism is None:
        return cut(rows.mapInPandas(stage, schema))
    workers, got = max(1, min(20, parallelism)), None
    rows = cut(rows)
    for k in range(ROUNDS if refuses else 1):
        own = rows.where(F.pmod(F.xxhash64("article_id"), F.lit(ROUNDS)) == k) if refuses else rows
        part = cut(own.repartition(workers).mapInPandas(stage, schema))
        got = part if got is None else got.unionByName(part)
        if refuses and part.where(F.col("failure_kind").rlike(f"({'|'.join(STOPPING)})$")).take(1):
            break
    return got


def refused(t: Tables, queue: DataFrame, now: Column) -> bool:
    """Whether an article of the queue was answered just now by a provider that refuses everybody."""
    kinds = t["article_contents"].where(F.col("failure_kind").rlike(f"({'|'.join(STOPPING)})$") & (F.col("fetched_at") == now))
    return bool(kinds.join(queue.select("article_id"), "article_id", "left_semi").take(1))


def run_batch(t: Tables, queue: DataFrame, now: Column, run_id: int, codes: tuple[str, ...], reader: Stage = rule_reader, scorer: Stage | None = None, analyst: Stage = rule_analyst, parallelism: int | None = None, threshold: int = rules.RELEVANCE_THRESHOLD, version: str = "v1", force: bool = False, boundary: Boundary | None = None) -> Tables:
    """Articles of the queue (article_id, and batch where it has several: each is a run of its own, numbered from run_id on)
    through its phases, all batches at once. Content that succeeded is kept unless forced, and so is a review of the same
    hash, at no tokens; analyses of relevant articles always run again. What the reader did not come to stays pending."""
    scorer = scorer or rule_scorer(())
    of = F.lit(run_id).cast("long") + (F.col("batch") if "batch" in queue.columns else F.lit(0))
    queue = cut(queue.select("article_id", of.alias("run_id")))
    own = queue.select("article_id")
    have = t["article_contents"].where("status = 'success'").select("article_id")
    read = own if force else own.join(have, "article_id", "left_anti")
    read = read.join(t["articles"].withColumnRenamed("id", "article_id"), "article_id").select("article_id", "title", "url", "publisher", "summary")
    got = answers(read, guarded(reader), CONTENT, parallelism, refuses=True)
    t = t | {"article_contents": cut(with_content(t["article_contents"], got, now))}

    ready = own.join(t["article_contents"].where("status = 'success'"), "article_id")
    told = ready.join(t["articles"].select(F.col("id").alias("article_id"), "title", "publisher", "published_at"), "article_id")
    valid = t["article_relevance_reviews"].where("status = 'success'").select("article_id", "content_hash")
    ask = told if force else told.join(valid, ["article_id", "content_hash"], "left_anti")
    scores = answers(ask.select("article_id", "title", "publisher", "published_at", "full_text"), scorer, REVIEW, parallelism)
    t = with_reviews(t, scores, now, codes, threshold, version, boundary)
    t = t | {"article_relevance_reviews": cut(t["article_relevance_reviews"]), "business_articles": cut(t["business_articles"])}

    relevant = t["article_relevance_reviews"].where("status = 'success' and is_relevant = 1").select("article_id", "category", "content_hash")
    accepted = told.join(relevant, ["article_id", "content_hash"])
    found = answers(accepted.select("article_id", "title", "publisher", "published_at", "full_text", "category"), analyst, ANALYSIS, parallelism)
    t = with_analyses(t, found, now, codes, boundary)
    t = t | {"business_articles": cut(t["business_articles"])}

    rows = queue.alias("q")
    for name, alias in (("article_contents", "ic"), ("article_relevance_reviews", "rr"), ("business_articles", "ba")):
        rows = rows.join(t[name].alias(alias), F.col("q.article_id") == F.col(f"{alias}.article_id"), "left")
    no_text, no_review = F.col("ic.status") != "success", F.coalesce(F.col("rr.status") != "success", F.lit(True))
    minor = F.coalesce(F.col("rr.is_relevant") == 0, F.lit(False))
    left = F.col("ic.article_id").isNull()
    worst = F.when(left, "pending").when(no_text | no_review, "failed").when(minor, "success").otherwise(F.coalesce("ba.analysis_status", F.lit("failed")))
    item = rows.select(
        F.col("q.run_id").alias("run_id"), F.col("q.article_id").alias("article_id"), worst.alias("status"), F.coalesce("ic.status", F.lit("pending")).alias("content_status"), F.when(left, "pending").when(no_text, "skipped").otherwise(F.coalesce("rr.status", F.lit("failed"))).alias("relevance_status"),
        F.when(left, "pending").when(no_text | no_review | minor, "skipped").otherwise(F.coalesce("ba.analysis_status", F.lit("failed"))).alias("business_analysis_status"), F.when(~no_text, F.col("rr.is_relevant")).alias("is_relevant"), F.coalesce(F.nullif("ic.error_message", F.lit("")), F.nullif("rr.error_message", F.lit("")), F.col("ba.error_message"), F.lit("")).alias("error_message"),
    )
    item = cut(item)
    old = queue.select("run_id").distinct()
    items = t["ai_analysis_run_items"].join(old, "run_id", "left_anti").select(*item.columns).unionByName(item)
    spent = scores.select("article_id", "prompt_tokens", "completion_tokens").unionByName(found.select("article_id", "prompt_tokens", "completion_tokens"))
    tokens = queue.join(spent, "article_id", "left").groupBy("run_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")])
    run = run_outcomes(item).join(tokens, "run_id").select(
        F.col("run_id").alias("id"), "status", now.cast("timestamp").alias("started_at"), now.cast("timestamp").alias("finished_at"), F.col("total").cast("int").alias("articles_total"), F.col("succeeded").cast("int").alias("articles_succeeded"), F.col("failed").cast("int").alias("articles_failed"), F.col("relevant").cast("int").alias("articles_relevant"), "prompt_tokens", "completion_tokens", F.lit("").alias("message"),
    )
    runs = t["ai_analysis_runs"].join(old.withColumnRenamed("run_id", "id"), "id", "left_anti").select(*run.columns).unionByName(run)
    return t | {"ai_analysis_run_items": items, "ai_analysis_runs": runs}


def run_queue(t: Tables, now: Column, first_run_id: int, codes: tuple[str, ...], size: int = 20, stop: Callable[[Tables], bool] = lambda t: False, wave: int = 10_000, **options) -> Tables:
    """All of the queue: batches are runs of their own, but ``wave`` of them go through the phases together, so the tables are
    merged once a wave. ``stop`` is asked between waves (a pause); a provider that refuses everybody stops its readers at once, the
    rounds that have not begun, and the waves behind."""
    queue = cut(batches(candidates(t, now), size))
    last = queue.agg(F.max("batch")).first()[0]
    for k in range(0, 0 if last is None else last + 1, wave):
        if stop(t):
            break
        own = queue.where(F.col("batch").between(k, k + wave - 1))
        t = run_batch(t, own, now, first_run_id, codes, **options)
        if refused(t, own, now):
            break
    return t
