"""Ranking requests and the checks around an experiment: rendering, validation, frozen selections, predictions.

The model is not part of the engine: a tokenizer and a scorer are columns or functions that callers pass.
Checks are queries for violations; `require_empty` turns a violation into an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import fixed, numeric, records, text
from winnow.operators import evaluation, joins


def ordered_candidates(catalog: DataFrame, n: int) -> list[tuple[str, str]]:
    """(id, name) of the n candidates, by case-folded name and id; ids and names must be unique and not blank."""
    rows = catalog.select("journal_id", "journal_name", text.casefold("journal_name").alias("f")).orderBy("f", "journal_id").limit(n + 1).collect()  # a catalog of n
    if len(rows) != n or len({r["journal_id"] for r in rows}) != n or len({r["f"] for r in rows}) != n or any(not (r["journal_id"] or "").strip() or not (r["journal_name"] or "").strip() for r in rows):
        raise ValueError(f"the catalog is not {n} distinct candidates")
    return [(r["journal_id"], r["journal_name"]) for r in rows]


def first_words(c: Column, n: int) -> Column:
    """A stand-in for a tokenizer: the first n white-space words."""
    return F.array_join(F.slice(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""), 1, n), " ")


def requests(papers: DataFrame, candidates: Sequence[tuple[str, str]], instruction: str, training: bool, shorten: Callable[[Column], Column]) -> DataFrame:
    """(paper_id, target, request, request_hash): the request as compact JSON whose criteria keep the candidates'
    order; a label only when training. The hash covers the text as sent."""
    state = F.concat(F.lit("Manuscript:\n"), shorten(F.concat_ws("\n", "title", "abstract")))
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.to_json(F.array(c)), r"^\[", ""), r"\]$", "")
    names = {i: n for i, n in candidates}
    criteria = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(quoted(F.lit(n)), F.lit(":null")) for _, n in candidates]), F.lit("}"))
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("target")]
    tail = F.concat(F.lit(',"label":'), quoted(label)) if training else F.lit("")
    body = F.concat(F.lit('{"state":'), quoted(state), F.lit(',"questions":{"journal":{"type":"choice","instructions":'), quoted(F.lit(instruction)), F.lit(',"criteria":'), criteria, tail, F.lit("}}}"))
    known = papers.where(F.assert_true(F.col("target").isin(*names), F.lit("target is no candidate")).isNull())
    made = known.select("paper_id", "group_id", "target", body.alias("request"), F.lit([i for i, _ in candidates]).alias("candidates"), F.lit([n for _, n in candidates]).alias("choice_keys"))
    return made.withColumn("request_hash", F.sha2("request", 256))


def request_violations(rows: DataFrame, candidates: Sequence[tuple[str, str]], training: bool) -> DataFrame:
    """(paper_id, violation): the first check that a request or its metadata fails."""
    ids, names = [i for i, _ in candidates], [n for _, n in candidates]
    question = F.get_json_object("request", "$.questions.journal")
    criteria = F.get_json_object(question, "$.criteria")
    label = F.get_json_object(question, "$.label")
    expected = F.element_at(F.lit(names), F.array_position(F.col("candidates"), F.col("target")).cast("int"))
    once = F.count("*").over(Window.partitionBy("paper_id")) + F.count("*").over(Window.partitionBy("group_id"))
    first = F.coalesce(
        F.when(~F.json_object_keys(F.get_json_object("request", "$.questions")).eqNullSafe(F.array(F.lit("journal"))), "one question is required"),
        F.when(~F.json_object_keys(criteria).eqNullSafe(F.lit(names)) | ~F.col("candidates").eqNullSafe(F.lit(ids)) | ~F.col("choice_keys").eqNullSafe(F.lit(names)), "candidates differ"),
        F.when(F.exists(F.map_values(F.from_json(criteria, "map<string,string>")), lambda v: v.isNotNull()), "criteria hold values"),
        F.when(~F.coalesce(F.col("target").isin(ids), F.lit(False)), "target is no candidate"),
        F.when(~F.sha2("request", 256).eqNullSafe(F.col("request_hash")), "hash differs"),
        F.when(~label.eqNullSafe(expected), "label differs") if training else F.when(label.isNotNull(), "label outside training"),
        F.when(F.col("_once") != 2, "repeated paper or group"),
    )
    return rows.withColumn("_once", once).select("paper_id", first.alias("violation")).where("violation IS NOT NULL")


def frozen_selection(identifiers: DataFrame, papers: DataFrame) -> DataFrame:
    """identifiers (paper_id, record_sha256, ...) with their papers; fails on ids that are gone or records that changed."""
    cols = [c for c in papers.columns if c != "paper_id"]
    hashed = papers.select("paper_id", *cols, records.ordered_digest(F.struct("paper_id", *cols)).alias("_hash"))
    both = identifiers.join(hashed, "paper_id", "left")
    ok = F.assert_true(F.coalesce(F.col("_hash") == F.col("record_sha256"), F.lit(False)), F.concat(F.lit("missing or changed: "), "paper_id"))
    return both.where(ok.isNull()).drop("_hash")


def without_text(selection: DataFrame, held: str = "test") -> DataFrame:
    """A selection whose held-out rows keep their identifiers only."""
    blank = lambda c: F.when(F.col("part") != held, F.col(c)).alias(c)
    return selection.select(*[blank(c) if c in ("title", "abstract") else c for c in selection.columns])


def prediction_violations(predictions: DataFrame, expected: DataFrame, candidates: Sequence[str], tolerance: float = 1e-5) -> DataFrame:
    """(paper_id, violation) of predictions (paper_id, target, candidates, probabilities in candidate order,
    ranking) against the expected queries (paper_id, target)."""
    p = predictions.withColumn("_n", F.count("*").over(Window.partitionBy("paper_id")))
    both = expected.select("paper_id", F.col("target").alias("_target")).join(p, "paper_id", "full_outer")
    pairs = F.array_sort(F.zip_with("probabilities", "candidates", lambda v, c: F.struct((-v).alias("v"), c.alias("c"))))
    ranked = F.transform(pairs, lambda x: x["c"])
    first = F.coalesce(
        F.when(F.col("_target").isNull() | F.col("_n").isNull(), "unexpected or missing query"),
        F.when(F.col("_n") > 1, "repeated query"),
        F.when(~F.col("target").eqNullSafe(F.col("_target")), "target differs"),
        F.when(~F.col("candidates").eqNullSafe(F.lit(list(candidates))), "candidates differ"),
        F.when(~numeric.valid_probabilities(F.col("probabilities"), len(candidates), tolerance), "probabilities are invalid"),
        F.when(~F.col("ranking").eqNullSafe(ranked), "ranking differs"),
    )
    return both.select("paper_id", first.alias("violation")).where("violation IS NOT NULL")


def request_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Queries that two runs do not share, or that they were sent differently."""
    return joins.differing_keys(a, b, "paper_id", ["request_hash", "target"])


def changed_settings(before: DataFrame, now: DataFrame, ignored: Column | None = None) -> DataFrame:
    """(name) of settings (name, value) that differ, or that one side lacks; names for which `ignored` holds don't matter. Scans, prepared
    inputs and selections are used again only where there is none."""
    changed = joins.differing_keys(before, now, "name", ["value"])
    return changed if ignored is None else changed.where(~ignored)


def order_differences(saved: DataFrame, found: DataFrame) -> DataFrame:
    """(place, saved, found) of the places at which two ordered lists (place, candidate) differ, null where one has none."""
    both = saved.select("place", F.col("candidate").alias("saved")).join(found.select("place", F.col("candidate").alias("found")), "place", "full_outer")
    return both.where(~F.col("saved").eqNullSafe(F.col("found")))


def completed_runs(runs: DataFrame, prepared_hash: str, mode: str) -> DataFrame:
    """Rows of the run log that count as done for these inputs."""
    return runs.where((F.col("status") == "complete") & F.col("checks_pass") & (F.col("prepared_hash") == prepared_hash) & (F.col("mode") == mode))


def open_stages(runs: DataFrame, prepared_hash: str, rates: Sequence[float]) -> list[tuple[str, float | None]]:
    """What may run next: the pilot, then each rate of the screen that is not done, then the full run at the best rate."""
    done = completed_runs(runs, prepared_hash, "pilot").limit(1).count()
    if not done:
        return [("pilot", None)]
    screened = [r[0] for r in completed_runs(runs, prepared_hash, "screen").where(F.col("learning_rate").isin(*rates)).select("learning_rate").distinct().collect()]  # configured rates
    if left := [r for r in rates if r not in screened]:
        return [("screen", r) for r in left]
    best = completed_runs(runs, prepared_hash, "screen").orderBy(F.desc("top3"), "learning_rate", "epoch").first()
    return [("full", best["learning_rate"])] if not completed_runs(runs, prepared_hash, "full").limit(1).count() else []


def refine_titles(rows: DataFrame, unsuitable: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): stored rows under a stricter title rule, without reading the sources again."""
    return rows.where(~unsuitable), rows.where(unsuitable).withColumn("reason", F.lit("unsuitable_title"))


def refined_audit(audit: DataFrame, removed: DataFrame, group: str = "journal_id") -> DataFrame:
    """audit (group, eligible, rejections map) after `removed` (group, reason) went: each leaves the eligible rows and counts for its
    reason. Groups that lose nothing stay as they are; more removed than were eligible is an error."""
    n = removed.groupBy(group, "reason").count().groupBy(group).agg(F.sum("count").alias("_n"), F.map_from_entries(F.collect_list(F.struct("reason", "count"))).alias("_more"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    both = audit.join(n, group, "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_more": F.coalesce("_more", none)})
    ok = F.assert_true(F.col("eligible") >= F.col("_n"), F.concat(F.lit("more removed than eligible: "), F.col(group).cast("string")))
    total = F.map_zip_with(F.coalesce("rejections", none), "_more", lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return both.where(ok.isNull()).select(group, (F.col("eligible") - F.col("_n")).alias("eligible"), total.alias("rejections"))


def request_lengths(rows: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    """rows (title, abstract, request, candidates) with query_tokens, state_tokens, request_tokens and choice_count; count gives a text's
    tokens. The state is what the request says of the paper; a query counts for its first 768 tokens."""
    state = F.get_json_object("request", "$.state")
    query = F.least(count(F.concat_ws("\n", "title", "abstract")), F.lit(fixed.QUERY_TOKENS))
    return rows.withColumns({"query_tokens": query, "state_tokens": count(state), "request_tokens": count(F.col("request")), "choice_count": F.size("candidates")})


def budget_violations(rows: DataFrame, n_options: int, max_state: int = fixed.STATE_TOKENS, max_request: int = fixed.REQUEST_TOKENS) -> DataFrame:
    """(paper_id, violation) of requests with their lengths that exceed a budget or have lost choices."""
    first = F.coalesce(F.when(F.col("request_tokens") > max_request, "request exceeds its budget"), F.when(F.col("state_tokens") > max_state, "state exceeds its budget"), F.when(F.col("choice_count") != n_options, "choices are missing"))
    return rows.select("paper_id", first.alias("violation")).where("violation IS NOT NULL")


def encoding_violations(rows: DataFrame, n_options: int, max_request: int = fixed.REQUEST_TOKENS) -> DataFrame:
    """(paper_id, violation) of encodings (paper_id, state_truncated, ids array, option_index array of arrays, one for each question): a state
    that was cut, too many ids, or not one question with all the options."""
    cut_or_long = F.coalesce("state_truncated", F.lit(False)) | F.coalesce(F.size("ids") > max_request, F.lit(True))
    whole = (F.size("option_index") == 1) & (F.size(F.try_element_at("option_index", F.lit(1))) == n_options)
    first = F.when(cut_or_long, "the context budget is exceeded").when(~F.coalesce(whole, F.lit(False)), "options were lost in encoding")
    return rows.select("paper_id", first.alias("violation")).where("violation IS NOT NULL")


def metric_differences(stored: DataFrame, computed: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(metric, stored, computed) of the metrics (metric, value) that one side lacks or that differ by more than the tolerance."""
    both = stored.select("metric", F.col("value").alias("stored")).join(computed.select("metric", F.col("value").alias("computed")), "metric", "full_outer")
    return both.where(~F.coalesce(F.abs(F.col("stored") - F.col("computed")) <= tolerance, F.col("stored").isNull() & F.col("computed").isNull()))


def catalog_status(catalog: DataFrame, directory: DataFrame, overrides: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(journal_id, issns, verified, status, other_titles) of a catalog (journal_id, journal_name) against a directory (title, issns) by name key.

    Reviewed ISSNs (journal_id, issns) win; of all titles with the name the valid ISSNs count, but several titles that
    share none are `ambiguous` and give nothing. What `previous` (journal_id, issns, verified) holds as verified
    is kept unless it is reviewed. other_titles are the titles found for a row that stays unverified. One bad row stops no other.
    """
    c = catalog.select("journal_id", text.name_key("journal_name").alias("_key"))
    found = c.join(directory.select(text.name_key("title").alias("_key"), "title", "issns"), "_key")
    titles = found.groupBy("journal_id").agg(F.count("*").alias("_titles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("issns")))).alias("_all"), F.array_sort(F.collect_set("title")).alias("_named"))
    common = joins.common_values(found, "journal_id", "issns")
    reviewed = overrides.select("journal_id", F.col("issns").alias("_reviewed"))
    both = c.select("journal_id").join(titles, "journal_id", "left").join(common, "journal_id", "left").join(reviewed, "journal_id", "left")
    if previous is not None:
        both = both.join(previous.where("verified").select("journal_id", F.col("issns").alias("_kept")), "journal_id", "left")
    else:
        both = both.withColumn("_kept", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    ambiguous = (F.col("_titles") > 1) & (F.size("common") == 0)
    valid = lambda c: F.filter(c, lambda x: text.valid_issn(x))
    issns = F.when(F.col("_reviewed").isNotNull(), F.array_sort(F.array_distinct(valid(F.col("_reviewed"))))).when(F.col("_kept").isNotNull(), F.col("_kept")).when(~ambiguous, valid(F.col("_all")))
    judged = both.withColumn("issns", F.coalesce(issns, none)).withColumn("verified", F.size("issns") > 0)
    status = (
        F.when(F.col("_reviewed").isNotNull(), F.when(F.col("verified"), "reviewed").otherwise("unresolved")).when(F.col("_kept").isNotNull(), "kept")
        .when(ambiguous, "ambiguous").when(F.col("verified"), "verified").otherwise("unresolved")
    )
    return judged.select("journal_id", "issns", "verified", status.alias("status"), F.when(F.col("verified"), none).otherwise(F.coalesce("_named", none)).alias("other_titles"))


def metrics_of(predictions: DataFrame) -> DataFrame:
    """The metrics of stored rankings (paper_id, target, ranking)."""
    rank = F.array_position("ranking", F.col("target"))
    return evaluation.metrics(predictions.select("paper_id", "target", F.when(rank > 0, rank).alias("rank")))
