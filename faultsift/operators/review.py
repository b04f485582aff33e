"""Review of local results by answers from outside: which events need one, what an answer must look like, when to stop asking.

Nothing is asked here: answers are a table, however they were made. Without one, every event keeps its local result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultsift.plans import dims

# Below these, a local result is reviewed; from the last on, an answer is applied.
EVENT_CONFIDENCE, CATEGORY_CONFIDENCE, ROOT_MARGIN, APPLIES = 0.75, 0.60, 0.12, 0.65
# The fields of an answer, its opinions, and its limits.
FIELDS = ["confidence", "event_opinion", "evidence_ids", "fault_category", "rationale", "root_cause_top5"]
OPINIONS = ["supports", "uncertain", "contradicts"]
MOST_EVIDENCE, MOST_RATIONALE = 8, 500


def needed(events: DataFrame, category: DataFrame, top5: DataFrame, by: list[str]) -> DataFrame:
    """(by, event, start, roots, category, margin, needs): whether an event's confidence, its category's or the margin of its first root is low.

    events: (by, event, start, confidence); category: (by, event, category, confidence); top5: (by, event, node, score,
    rank). The margin is the first score's lead over the second, as a part of the first; 1 without a second.
    """
    keys = [*by, "event"]
    roots = top5.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "node", "score"))).alias("_r"))
    one, two = F.col("_r")[0]["score"], F.get("_r", 1)["score"]
    margin = F.coalesce((one - two) / F.greatest(F.abs(one), F.lit(1e-8)), F.lit(1.0))
    rows = events.select(*keys, "start", F.col("confidence").alias("_e")).join(category.select(*keys, "category", F.col("confidence").alias("_c")), keys).join(roots, keys)
    low = (F.col("_e") < EVENT_CONFIDENCE) | (F.col("_c") < CATEGORY_CONFIDENCE) | (margin < ROOT_MARGIN)
    return rows.select(*keys, "start", F.transform("_r", lambda x: x["node"]).alias("roots"), "category", margin.alias("margin"), low.alias("needs"))


def _answer(text: Column, roots: Column, allowed: Column) -> dict[str, Column]:
    """What a valid answer says; valid is false where anything of it is not as it must be."""
    v = F.try_parse_json(text)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    is_text = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    said, cited = get("$.root_cause_top5", "array<string>"), get("$.evidence_ids", "array<string>")
    pair = F.concat_ws(".", get("$.fault_category.major_category", "string"), get("$.fault_category.sub_category", "string"))
    names = F.create_map(*(F.lit(x) for name, major, sub in dims.TAXONOMY for x in (f"{major}.{sub}", name)))
    category = F.get(F.map_values(F.map_filter(names, lambda k, _: k == pair)), 0)
    sure = get("$.confidence", "double")
    number = F.schema_of_variant(F.try_variant_get(v, "$.confidence", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    checks = [
        F.array_sort(F.json_object_keys(text)) == F.array(*map(F.lit, FIELDS)),
        F.array_sort(F.json_object_keys(F.get_json_object(text, "$.fault_category"))) == F.array(F.lit("major_category"), F.lit("sub_category")),
        get("$.event_opinion", "string").isin(OPINIONS),
        F.array_sort(said) == F.array_sort(roots),
        category.isNotNull(),
        (F.size(cited) >= 1) & (F.size(cited) <= MOST_EVIDENCE) & (F.size(F.array_distinct(cited)) == F.size(cited)) & (F.size(F.array_except(cited, allowed)) == 0),
        number & ~F.isnan(sure) & (sure >= 0) & (sure <= 1),
        is_text("$.rationale") & (F.length(get("$.rationale", "string")) <= MOST_RATIONALE),
    ]
    valid = F.lit(True)
    for check in checks:
        valid = valid & F.coalesce(check, F.lit(False))
    return {"valid": valid, "opinion": get("$.event_opinion", "string"), "roots": said, "category": category, "confidence": sure}


def reviewed(found: DataFrame, by: list[str], answers: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """found (by, event, start, roots, category, needs) with status, reason, and the roots and category after the review.

    answers: (by, event, answer), JSON texts. allowed: (by, event, ids), what an answer may cite beside the roots. An answer
    counts if it is whole and legal, reorders the roots, and is sure of an opinion; a missing or illegal one is a failure,
    after which the case asks no more: later events that needed a review keep their local result, too.
    Without answers the status is disabled, for events that need none skipped_confident.
    """
    keys = [*by, "event"]
    local = found.select(*keys, "start", F.col("roots").alias("_roots"), F.col("category").alias("_category"), "needs")
    if answers is None:
        return local.select(*keys, F.lit("disabled").alias("status"), F.lit(None).cast("string").alias("reason"), F.col("_roots").alias("roots"), F.col("_category").alias("category"))
    rows = local.join(answers.select(*keys, "answer"), keys, "left")
    rows = rows.join(allowed.select(*keys, F.col("ids").alias("_ids")), keys, "left") if allowed is not None else rows.withColumn("_ids", F.array().cast("array<string>"))
    ids = F.concat(F.transform("_roots", lambda n: F.concat(F.lit("root:"), n)), F.coalesce("_ids", F.array().cast("array<string>")))
    said = _answer(F.col("answer"), F.col("_roots"), ids)
    rows = rows.withColumns({f"_{k}_": v for k, v in said.items()})
    failed = F.when(F.col("needs") & ~F.col("_valid_"), 1).otherwise(0)
    before = F.coalesce(F.sum(failed).over(W.partitionBy(*by).orderBy("start", "event").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_open", before > 0)
    applies = (F.col("_opinion_") != "uncertain") & (F.col("_confidence_") >= APPLIES)
    status = F.when(~F.col("needs"), "skipped_confident").when(F.col("_open") | ~F.col("_valid_"), "fallback").when(applies, "accepted").otherwise("not_applied")
    reason = F.when(status == "fallback", F.when(F.col("_open"), "review circuit open").otherwise("review unavailable or response invalid"))
    taken = status == "accepted"
    return rows.select(
        *keys, status.alias("status"), reason.alias("reason"), F.when(taken, F.col("_roots_")).otherwise(F.col("_roots")).alias("roots"),
        F.when(taken, F.col("_category_")).otherwise(F.col("_category")).alias("category"),
    )


def blended(scores: DataFrame, learned: DataFrame, by: list[str], rule_part: float = 0.75) -> DataFrame:
    """(by, node, rule, learned, score) of each group's candidates: three quarters of the rules' distribution, the rest a model's.

    scores: (by, node, score); their distribution is the softmax of ln(1 + score). learned: (by, node, logit); a
    candidate without a row has no part of the model's distribution.
    """
    w = W.partitionBy(*by)
    lift = 1 + F.greatest(F.col("score"), F.lit(0.0))
    rules = scores.select(*by, "node", (lift / F.sum(lift).over(w)).alias("rule"))
    top = learned.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(w)))
    model = top.select(*by, "node", (F.col("_e") / F.sum("_e").over(w)).alias("learned"))
    rows = rules.join(model, [*by, "node"], "left").na.fill(0.0, ["learned"])
    return rows.withColumn("score", F.col("rule") * rule_part + F.col("learned") * (1 - rule_part))
