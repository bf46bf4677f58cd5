"""The three workloads as plans: scan many changes, build and price requests, take responses back to reviews."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.functions.text import strip, tokens
from diffloom.operators import cost, lines, masking, merging, outcome, packing, reports, responses, rules
from diffloom.sources import sinks
from diffloom.sources.cache import ResponseCache
from diffloom.sources.shared import stored


@dataclass
class Scan:
    """Everything that rules alone say of a table of changes. Each member is a plan; nothing runs until it is asked for.

    A change that can't be read (a parse error) ends before the scan: it has a status and nothing else, no finding, request or review.

    keep: what is done with the tables that several steps read (files, masked lines, findings). `stored` writes each of them
    once, so that the diff text is parsed once whatever is made of it; the default leaves all to one plan, for a
    single query.
    """

    changes: DataFrame
    rule_list: tuple = rules.RULES
    keep: Callable[[DataFrame], DataFrame] = lambda df: df

    @cached_property
    def sound(self) -> DataFrame:
        return lines.sound(self.changes)

    @cached_property
    def readable(self) -> DataFrame:
        """change_id of each change that gets a review, an empty one if its text is blank."""
        return self.statuses.where("status <> 'parse_error'").select("change_id")

    @cached_property
    def files(self) -> DataFrame:
        return self.keep(lines.split_files(self.sound))

    @cached_property
    def hunks(self) -> DataFrame:
        return lines.split_hunks(self.sound)

    @cached_property
    def lines(self) -> DataFrame:
        return lines.number_lines(self.sound, located=True)

    @cached_property
    def masked(self) -> DataFrame:
        return self.keep(masking.mask_lines(self.lines))

    @cached_property
    def statuses(self) -> DataFrame:
        return self.keep(lines.parse_status(self.changes))

    @cached_property
    def on_lines(self) -> DataFrame:
        return self.keep(rules.scan_lines(self.masked, self.files, self.rule_list))

    def of_rule(self, rule_id: str) -> DataFrame:
        """One rule's findings: a selection of the one pass."""
        return self.on_lines.where(F.col("rule_id") == rule_id)

    @cached_property
    def found(self) -> DataFrame:
        """Masker's and rules' findings (V9): one pass over the lines, one over the files."""
        return self.on_lines.drop("tier").unionByName(rules.manifest_changes(self.files))

    @cached_property
    def findings(self) -> DataFrame:
        return self.keep(merging.strongest(self.found))

    @cached_property
    def suppressed(self) -> DataFrame:
        return rules.suppressed_lines(self.on_lines)

    @cached_property
    def added(self) -> DataFrame:
        return self.keep(lines.added_lines(self.masked, self.files))

    @cached_property
    def filtered(self) -> DataFrame:
        return self.keep(packing.exclusions(self.files, self.masked))

    @cached_property
    def notes(self) -> DataFrame:
        return self.keep(packing.exclusion_notes(self.filtered))

    @cached_property
    def reviewable(self) -> DataFrame:
        return self.keep(lines.has_added_lines(self.masked))

    def reviews(self, findings: DataFrame | None = None, summaries: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
        """Reviews of changes (all that can be read if none are given), of rules' findings alone if none are given."""
        return reports.assemble(*self._reviewed(findings, summaries, changes))

    def _reviewed(self, findings: DataFrame | None = None, summaries: DataFrame | None = None, changes: DataFrame | None = None) -> tuple[DataFrame, ...]:
        f = self.findings if findings is None else findings
        none = self.changes.sparkSession.createDataFrame([], f"change_id {self.changes.schema['change_id'].dataType.simpleString()}, summary string, overall_risk string, pr_comment string")
        return self.readable if changes is None else changes, f, none if summaries is None else summaries, self.notes, self.reviewable

    def artifacts(self) -> DataFrame:
        return sinks.artifacts(self.keep(self.reviews()), self.findings, self.notes)

    def artifact_parts(self, findings: DataFrame | None = None, summaries: DataFrame | None = None, changes: DataFrame | None = None, part_rows: int = reports.PART_ROWS) -> DataFrame:
        """The texts of `artifacts` in ordered parts, for changes with more findings than a task holds."""
        given = self._reviewed(findings, summaries, changes)
        return reports.parts(self.keep(reports.heads(*given)), given[1], self.notes, part_rows)


@dataclass
class Requests:
    """Requests of a scan, with keys and prices."""

    scan: Scan
    system: str
    model: str
    run_date: str
    prices: DataFrame
    max_input_tokens: int = packing.MAX_INPUT_TOKENS

    @cached_property
    def hunk_texts(self) -> DataFrame:
        return self.scan.keep(packing.located_hunk_texts(self.scan.masked))

    @cached_property
    def blocks(self) -> DataFrame:
        kind = self.scan.changes.schema["change_id"].dataType.simpleString()
        return self.scan.keep(packing.blocks(self.hunk_texts, packing.assign(self.hunk_texts, self.max_input_tokens, kind)))

    @cached_property
    def batches(self) -> DataFrame:
        return packing.batches(self.blocks)

    @cached_property
    def reviews(self) -> DataFrame:
        r = self._keyed(packing.review_requests(self.batches, self.scan.suppressed, self.system))
        return self.scan.keep(r.select("change_id", F.lit("review").alias("call"), "batch_no", F.col("batch_no").alias("call_no"), F.concat(F.lit("review-"), "batch_no").alias("label"), *_REQUEST))

    def _keyed(self, requests: DataFrame) -> DataFrame:
        r = requests.withColumn("model", F.lit(self.model)).withColumn("prompt_key", cost.request_key(F.lit(self.model), F.lit(""), F.col("system"), F.col("user")))
        return r.withColumn("tokens", tokens(F.col("system")) + tokens(F.col("user"))).withColumn("run_date", F.lit(self.run_date).cast("date"))

    def summaries(self, findings: DataFrame) -> DataFrame:
        """The summary request of each change that has review requests, over its findings; the call after its reviews."""
        last = self.blocks.groupBy("change_id").agg((F.max("batch_no") + 1).alias("call_no"))
        r = self._keyed(packing.summary_requests(self.scan.filtered, findings, self.system)).join(last, "change_id")
        return r.select("change_id", F.lit("summary").alias("call"), F.lit(0).alias("batch_no"), "call_no", F.lit("summary").alias("label"), *_REQUEST)

    def with_worst_cost(self, requests: DataFrame) -> DataFrame:
        ceiling = F.when(F.col("call") == "summary", cost.SUMMARY_OUTPUT).otherwise(cost.REVIEW_OUTPUT)
        return cost.with_rates(requests, self.prices).withColumn("worst", cost.worst_cost(F.col("tokens"), ceiling))

    @cached_property
    def dry_run(self) -> DataFrame:
        """What all calls would cost at worst, the summary of the rules' findings among them (P13); nothing is sent."""
        calls = self.reviews.select("change_id", "label", "model", "run_date", "call", "tokens").unionByName(self.summaries(self.scan.findings).select("change_id", "label", "model", "run_date", "call", "tokens"))
        return cost.dry_run(self.with_worst_cost(calls))


_REQUEST = ("system", "user", "model", "prompt_key", "tokens", "run_date")


@dataclass
class Reviewed:
    """Responses joined to the requests by key, checked, and merged with the scan's findings.

    answers(prompt_key, response, input_tokens, output_tokens, cache_read, cache_write): one table of recorded or cached responses; a
    request without one, or with a blank one, has failed. max_call_tokens and max_run_cost are the budgets of a call and of a change's run.
    cache: requests that it has a response to are no calls: they cost nothing, are held against no budget, and need no
    answer; `remember` adds the responses of the run's own calls. Each step's table is written once, for the steps after it
    read it several times; give it a scan that keeps its own tables too.
    """

    requests: Requests
    answers: DataFrame
    max_call_tokens: int = packing.MAX_INPUT_TOKENS
    max_run_cost: float = 1.0
    cache: ResponseCache | None = None

    @property
    def scan(self) -> Scan:
        return self.requests.scan

    def _called(self, requests: DataFrame) -> DataFrame:
        """Each request with its checked response, whether the cache had it, and its actual cost, which is 0 where nothing was sent or came."""
        had = self.cache.found(requests) if self.cache else requests.withColumn("cached", F.lit(None).cast("string"))
        got = responses.attached(had, self.answers)
        hit = F.col("cached").isNotNull()
        got = got.withColumn("hit", hit).withColumn("response", F.coalesce("cached", F.when(F.col("response").rlike(r"(?U)\S"), F.col("response")))).drop("cached")
        got = self.requests.with_worst_cost(responses.check(got))
        return got.withColumn("actual", F.when(F.col("hit") | F.col("response").isNull(), 0.0).otherwise(F.coalesce(cost.usage_cost(), F.lit(0.0))))

    def _results(self, calls: DataFrame) -> DataFrame:
        c = cost.budgets(calls, self.max_call_tokens, self.max_run_cost)
        result = F.when(F.col("over_tokens") | F.col("over_cost"), "budget").when(F.col("response").isNull(), "api_error").when(F.col("valid"), "ok").otherwise("malformed")
        return c.withColumn("result", result)

    @cached_property
    def calls(self) -> DataFrame:
        """Review and summary calls that the run came to, in order up to the first of a change that fails; a budget stops its call before it is
        sent. Cached ones among them."""
        both = self._results(self.review_calls.unionByName(self.summary_calls))
        fails = both.where("result <> 'ok'").groupBy("change_id").agg(F.min("call_no").alias("_fails"))
        return stored(both.join(fails, "change_id", "left").where("result <> 'budget' AND (_fails IS NULL OR call_no <= _fails)").drop("_fails"))

    def usage(self) -> DataFrame:
        """Tokens and cost of the calls that were sent and answered, per call, change and in all."""
        return cost.usage_totals(self.calls.where("NOT hit AND response IS NOT NULL"))

    def recorded(self) -> DataFrame:
        """change_id, call, batch_no, label, response of every response that the run took up, the cached ones too."""
        batches = self.requests.reviews.groupBy("change_id").agg(F.count("*").alias("n_batches"))
        r = self.calls.where("response IS NOT NULL").join(batches, "change_id").withColumn("stem", F.col("change_id"))
        return sinks.labelled(r).select("change_id", "call", "batch_no", "label", strip(F.col("response")).alias("response"))

    def remember(self) -> DataFrame:
        """Put the responses of the run's own calls into the cache (S8); what was new."""
        return self.cache.put(self.calls.where("NOT hit").select("prompt_key", "response"))

    @cached_property
    def review_calls(self) -> DataFrame:
        """The review calls with their results, up to the first of a change that fails."""
        return stored(self._called(self.requests.reviews))

    @cached_property
    def review_failures(self) -> DataFrame:
        return stored(outcome.first_failures(self._results(self.review_calls)))

    @cached_property
    def packed(self) -> DataFrame:
        return self.requests.blocks.select("change_id", "batch_no", "path", "capped")

    @cached_property
    def model_findings(self) -> DataFrame:
        """The model's findings on files and lines that the change has, of changes whose review calls all came through."""
        kept = outcome.kept_model_findings(responses.model_findings(self.review_calls), self.review_failures)
        f = merging.known_files(kept, self.scan.files)
        return merging.capped(merging.mapped_lines(f, self.scan.added).drop("unmapped"), self.packed)

    @cached_property
    def merged(self) -> DataFrame:
        """Both detectors' findings of each change that adds a line."""
        m = merging.merge(self.scan.found, self.model_findings)
        return stored(m.join(self.scan.reviewable.where("reviewable").select("change_id"), "change_id", "left_semi"))

    @cached_property
    def summary_calls(self) -> DataFrame:
        """One for each change whose review calls all came through."""
        wanted = self.requests.summaries(self.merged).join(self.review_failures.select("change_id"), "change_id", "left_anti")
        return stored(self._called(wanted))

    @cached_property
    def failures(self) -> DataFrame:
        """The call that decides, if one failed (U4): the summary is only asked for where no review call failed."""
        both = self.review_calls.unionByName(self.summary_calls)
        late = outcome.first_failures(self._results(both).where("call = 'summary'"))
        return self.review_failures.unionByName(late)

    @cached_property
    def outcomes(self) -> DataFrame:
        return stored(outcome.outcomes(self.scan.statuses, self.scan.reviewable, self.failures, outcome.gate(self.merged)))

    @cached_property
    def reviews(self) -> DataFrame:
        """Reviews of the changes that have one; a summary that failed is replaced by the rules' own text."""
        return self.scan.reviews(*self._shown)

    @cached_property
    def _shown(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        shown = self.outcomes.where("has_review").select("change_id")
        good = responses.summaries(self.summary_calls).join(self.failures.select("change_id"), "change_id", "left_anti")
        return self.merged, good, shown

    def artifacts(self) -> DataFrame:
        return sinks.artifacts(stored(self.reviews), self.merged, self.scan.notes)

    def artifact_parts(self, part_rows: int = reports.PART_ROWS) -> DataFrame:
        return self.scan.artifact_parts(*self._shown, part_rows=part_rows)


def whole_run(changes: DataFrame, **parameters) -> Reviewed:
    """W1, W2 and W3 over changes, every shared table written once. parameters: those of Requests, and answers and budgets."""
    own = {k: parameters.pop(k) for k in ("answers", "max_call_tokens", "max_run_cost", "cache") if k in parameters}
    return Reviewed(Requests(Scan(changes, keep=stored), **parameters), **own)
