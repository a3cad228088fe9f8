"""Scores of detectors against labelled spans.

gold: doc_id, start, end, text, entity_type. pred: runner, doc_id, start, end, text, entity_type. Gold and
predictions meet once, as arrays of one (doc_id, entity_type) each, on a co-partition by these; matching
then runs in the row, among spans of one type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluier.functions import spans as S
from sluier.operators.entity_types import category_of, entity_types

PAIRED = "array<struct<g:int,p:int>>"
MODES = ("exact", "overlap")
SPANS = "array<struct<start:int,end:int,entity_type:string,text:string>>"


def _with_runners(rows: DataFrame, pred: DataFrame, runners: DataFrame | None) -> DataFrame:
    """rows with the array __runners of the names of all detectors: one row of the plan holds them."""
    named = pred.select("runner") if runners is None else runners.select("runner")
    return rows.crossJoin(F.broadcast(named.agg(F.array_sort(F.collect_set("runner")).alias("__runners"))))  # one row


def paired(gold: DataFrame, pred: DataFrame, runners: DataFrame | None = None) -> DataFrame:
    """(runner, doc_id, entity_type, gold, pred): arrays in the order of the text, for every runner and every document and type that has either."""
    span = F.struct("start", "end", "entity_type", "text")
    g = gold.groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_list(span)).alias("gold"))
    p = pred.groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity_type", "text", "runner"))).alias("every"))
    return _by_runner(_with_runners(g.join(p, ["doc_id", "entity_type"], "full"), pred, runners))


def paired_documents(docs: DataFrame) -> DataFrame:
    """The same from documents that hold their labels and finds as arrays (doc_id, labels, finds): nothing is shuffled."""
    types = F.array_distinct(F.concat(F.transform("labels", lambda x: x["entity_type"]), F.transform("finds", lambda x: x["entity_type"])))
    label = lambda x: F.struct(x["start"], x["end"], x["entity_type"], x["text"])
    find = lambda x: F.struct(x["start"], x["end"], x["entity_type"], x["text"], x["runner"])
    some = lambda column, t, form: F.array_sort(F.transform(F.filter(column, lambda x: x["entity_type"] == t), form))
    of = lambda t: F.struct(t.alias("entity_type"), some("labels", t, label).alias("gold"), some("finds", t, find).alias("every"))
    rows = docs.select("doc_id", S.each(F.transform(types, of)).alias("x")).filter("x is not null").select("doc_id", "x.entity_type", "x.gold", "x.every")
    return _by_runner(_with_runners(rows, _runners_in(docs), None))


def _runners_in(docs: DataFrame) -> DataFrame:
    """The names of the detectors that found anything."""
    return docs.select(S.each(F.array_distinct(F.transform("finds", lambda x: x["runner"]))).alias("runner")).filter("runner is not null")


def _by_runner(both: DataFrame) -> DataFrame:
    mine = lambda r: F.struct(r.alias("runner"), F.filter("every", lambda x: x["runner"] == r).cast("array<struct<start:int,end:int,entity_type:string,text:string,runner:string>>").alias("pred"))
    rows = both.select("doc_id", "entity_type", F.coalesce("gold", S.none(SPANS)).alias("gold"), S.each(F.transform("__runners", mine)).alias("r")).filter("r is not null")
    told = F.transform(F.coalesce("r.pred", F.array().cast("array<struct<start:int,end:int,entity_type:string,text:string,runner:string>>")), lambda x: x.dropFields("runner")).cast(SPANS)
    return rows.select("r.runner", "doc_id", "entity_type", "gold", told.alias("pred")).filter("size(gold) + size(pred) > 0")


def _shared(a: Column, b: Column) -> Column:
    return F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])


def matches(gold: Column, pred: Column, mode: str) -> Column:
    """Pairs (g, p) of places, one to one. Gold in order takes the unused prediction of its type: the equal one, or the one with the largest overlap (first on a tie).

    Both are sorted by start, so a prediction that ends before a gold span is out of the game for all that follow.
    """

    def same(p: Column, g: Column) -> Column:
        return (p["entity_type"] == g["entity_type"]) & ((p["start"] == g["start"]) & (p["end"] == g["end"]) if mode == "exact" else _shared(p, g) > 0)

    def step(state: Column, g: Column) -> Column:
        fit = F.filter(state["open"], lambda x: same(x["p"], g["g"]))
        if mode == "exact":
            best = F.try_element_at(fit, F.lit(1))["i"]
        else:
            best = -F.array_max(F.transform(fit, lambda x: F.struct(_shared(x["p"], g["g"]).alias("n"), (-x["i"]).alias("i"))))["i"]

        def taken(b: Column) -> Column:
            rest = F.filter(state["open"], lambda x: (x["p"]["end"] > g["g"]["start"]) & (b.isNull() | (x["i"] != b)))
            done = F.when(b.isNotNull(), F.concat(state["done"], F.array(F.struct(g["i"].alias("g"), b.alias("p"))))).otherwise(state["done"])
            return F.struct(done.alias("done"), rest.alias("open"))

        return S.let(best, taken)

    gold_numbered = F.transform(gold, lambda g, i: F.struct(i.alias("i"), g.alias("g")))
    pred_numbered = F.transform(pred, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    every = F.aggregate(gold_numbered, F.struct(S.none(PAIRED).alias("done"), pred_numbered.alias("open")), step, lambda s: s["done"])
    # Most documents have one span of a type, or none on one side; these need no fold.
    first = F.array(F.struct(F.lit(0).alias("g"), F.lit(0).alias("p")))
    single = F.when(same(pred[0], gold[0]), first).otherwise(S.none(PAIRED))
    return F.when((F.size(gold) == 0) | (F.size(pred) == 0), S.none(PAIRED)).when((F.size(gold) == 1) & (F.size(pred) == 1), single).otherwise(every)


def type_counts(pairs: DataFrame, *modes: str) -> DataFrame:
    """(runner, mode, entity_type, tp, fp, fn), all modes in one pass."""
    tp = [F.sum(F.size(matches(F.col("gold"), F.col("pred"), m)).cast("bigint")).alias(f"tp_{m}") for m in modes]
    n = pairs.groupBy("runner", "entity_type").agg(*tp, F.sum(F.size("gold")).alias("n_gold"), F.sum(F.size("pred")).alias("n_pred"))
    told = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(f"tp_{m}").alias("tp")) for m in modes)))
    rows = n.select("runner", "entity_type", "n_gold", "n_pred", told.alias("m"))
    return rows.select("runner", "m.mode", "entity_type", "m.tp", (F.col("n_pred") - F.col("m.tp")).alias("fp"), (F.col("n_gold") - F.col("m.tp")).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def prf(tp: Column, fp: Column, fn: Column, digits: int | None = 4) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; 0 where undefined."""
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    out = (p, r, _ratio(2 * p * r, p + r))
    return tuple(F.round(x, digits) for x in out) if digits else out


def scores(counts: DataFrame) -> DataFrame:
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f})


def micro_macro(counts: DataFrame) -> DataFrame:
    """(runner, mode, tp, fp, fn, micro_precision, micro_recall, micro_f1, macro_f1); macro is the mean of unrounded F1 of types with gold."""
    f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"), None)[2]
    rows = counts.withColumn("f1", f1)
    total = rows.groupBy("runner", "mode").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.coalesce(F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("f1"))), F.lit(0.0)), 4).alias("macro_f1"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.withColumns({"micro_precision": p, "micro_recall": r, "micro_f1": f})


def _mean_of_rounded(score: Column, where: Column) -> Column:
    """Mean of scores with four digits, rounded half up to four digits; in whole numbers, so the same in any order of rows."""
    total, n = F.sum(F.when(where, F.round(score * 10000).cast("bigint")).otherwise(0)), F.greatest(F.count_if(where), F.lit(1))
    return F.floor((2 * total + n) / (2 * n)) / 10000


def _grouped(counts: DataFrame) -> DataFrame:
    types = entity_types(counts.sparkSession).select("entity_type", "identifier_group")
    return scores(counts).join(F.broadcast(types), "entity_type", "left").withColumn("identifier_group", F.coalesce("identifier_group", F.lit("indirect")))


def group_macro_f1(counts: DataFrame) -> DataFrame:
    """(runner, mode, identifier_group, macro_f1): mean of the rounded F1 of types with gold."""
    with_gold = _grouped(counts).filter("tp + fn > 0")
    return with_gold.groupBy("runner", "mode", "identifier_group").agg(_mean_of_rounded(F.col("f1"), F.lit(True)).alias("macro_f1"))


def group_totals(counts: DataFrame) -> DataFrame:
    """Subtotals by direct and indirect and a grand total (group `total`): sums, and means of rounded P, R, F1 over types with gold."""
    gold = F.col("tp") + F.col("fn") > 0
    mean = lambda c: _mean_of_rounded(F.col(c), gold).alias(c)
    rolled = _grouped(counts).rollup("runner", "mode", "identifier_group").agg(F.grouping_id().alias("level"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), mean("precision"), mean("recall"), mean("f1"))
    return rolled.filter("level <= 1").withColumn("identifier_group", F.when(F.col("level") == 1, "total").otherwise(F.col("identifier_group"))).drop("level")


def confusion(pairs: DataFrame) -> DataFrame:
    """(runner, gold_type, pred_type, n): gold without a match against predictions without one, largest overlap first come."""
    rows = pairs.withColumn("m", matches(F.col("gold"), F.col("pred"), "overlap"))
    left = F.filter(F.transform("gold", lambda g, i: F.when(~F.exists("m", lambda m: m["g"] == i), g)), lambda g: g.isNotNull())
    right = F.filter(F.transform("pred", lambda p, i: F.when(~F.exists("m", lambda m: m["p"] == i), p)), lambda p: p.isNotNull())
    rest = rows.select("runner", "doc_id", left.alias("l"), right.alias("r")).filter("size(l) + size(r) > 0")
    rest = rest.groupBy("runner", "doc_id").agg(F.array_sort(F.flatten(F.collect_list("l"))).alias("l"), F.array_sort(F.flatten(F.collect_list("r"))).alias("r")).filter("size(l) > 0 and size(r) > 0")
    anonymous = lambda spans: F.transform(spans, lambda s: s.withField("entity_type", F.lit("")))
    rest = rest.withColumn("c", matches(anonymous(F.col("l")), anonymous(F.col("r")), "overlap"))
    told = F.transform("c", lambda m: F.struct(F.element_at("l", m["g"] + 1)["entity_type"].alias("gold_type"), F.element_at("r", m["p"] + 1)["entity_type"].alias("pred_type")))
    return rest.select("runner", S.each(told).alias("x")).filter("x is not null").groupBy("runner", "x.gold_type", "x.pred_type").agg(F.count(F.lit(1)).alias("n"))


_STRETCH = "array<struct<start:int,end:int>>"


def _joined(spans: Column) -> Column:
    """Stretches that cover the same text as the spans (sorted by start) and don't overlap; empty where a span adds nothing."""

    def add(state: Column, s: Column) -> Column:
        part = F.struct(F.greatest(s["start"], state["at"]).alias("start"), F.greatest(s["end"], state["at"]).alias("end"))
        return F.struct(part["end"].alias("at"), F.concat(state["out"], F.array(part)).alias("out"))

    return S.walk(spans, add, _STRETCH)


def _covered(bounded: Column, g: Column) -> Column:
    """Characters of a span that stretches cover; they come in blocks with bounds, of which only those near the span are read."""
    near = F.filter(bounded, lambda b: (b["low"] < g["end"]) & (b["high"] > g["start"]))
    inside = lambda n, s: n + F.greatest(F.lit(0), F.least(s["end"], g["end"]) - F.greatest(s["start"], g["start"]))
    return F.aggregate(near, F.lit(0), lambda n, b: n + F.aggregate(b["part"], F.lit(0), inside))


def coverage(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(runner, doc_id, start, end, entity_type, text, covered): share of each gold span under the union of a runner's predictions of any type.

    Gold and predictions of a document meet once, as arrays; predictions become stretches without overlap, so touching and nested ones count once.
    """
    g = gold.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "entity_type", "text")).alias("gold"))
    p = pred.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "runner"))).alias("every"))
    return _coverage(_with_runners(g.join(p, "doc_id", "left"), pred, None))


def coverage_documents(docs: DataFrame) -> DataFrame:
    """The same from documents that hold their labels and finds as arrays (doc_id, labels, finds)."""
    g = F.transform("labels", lambda x: F.struct(x["start"], x["end"], x["entity_type"], x["text"])).alias("gold")
    p = F.array_sort(F.transform("finds", lambda x: F.struct(x["start"], x["end"], x["runner"]))).alias("every")
    return _coverage(_with_runners(docs.select("doc_id", g, p), _runners_in(docs), None))


def _coverage(both: DataFrame) -> DataFrame:
    def told(r: Column) -> Column:
        mine = F.filter(F.coalesce("every", F.array().cast("array<struct<start:int,end:int,runner:string>>")), lambda x: x["runner"] == r)
        bounds = lambda b: F.struct(b[0]["start"].alias("low"), F.element_at(b, -1)["end"].alias("high"), b.alias("part"))
        bounded = F.transform(S.blocks(_joined(mine)), bounds)
        return S.let(bounded, lambda b: F.struct(r.alias("runner"), F.transform("gold", lambda x: F.struct(x.alias("g"), _covered(b, x).alias("n"))).alias("spans")))

    rows = both.select("doc_id", S.each(F.transform("__runners", told)).alias("r")).filter("r is not null")
    rows = rows.select("r.runner", "doc_id", F.explode("r.spans").alias("x"))
    share = F.round(F.col("x.n") / (F.col("x.g.end") - F.col("x.g.start")), 6)
    return rows.select("runner", "doc_id", "x.g.start", "x.g.end", "x.g.entity_type", "x.g.text", share.alias("covered"))


def exposed(covered: DataFrame) -> DataFrame:
    """Gold spans that are not wholly covered, with category and severity."""
    return covered.filter("covered < 1").withColumns({"category": category_of(F.col("entity_type")), "severity": F.when(F.col("covered") == 0, "full").otherwise("partial")})


def leak_rate(covered: DataFrame) -> DataFrame:
    """(runner, direct, leaked, leak_rate, gate): direct identifiers not wholly covered; the gate is open without any."""
    direct = category_of(F.col("entity_type")) == "direct_identifier"
    n = covered.groupBy("runner").agg(F.count_if(direct).alias("direct"), F.count_if(direct & (F.col("covered") < 1)).alias("leaked"))
    return n.withColumn("leak_rate", F.round(_ratio(F.col("leaked"), F.col("direct")), 6)).withColumn("gate", F.when(F.col("leaked") == 0, "open").otherwise("closed"))


def over_redaction(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Predictions that meet no gold span of any type.

    Spans of a document are sorted by start once: a prediction meets gold that began before it and reaches into it, or gold that begins inside it. So
    the largest end before and the smallest start behind tell, whatever the number of spans.
    """
    empty = F.col("end") <= F.col("start")
    rows = pred.withColumns({"__gold": F.lit(False), "__order": F.when(empty, 0).otherwise(2)})
    marks = gold.select("doc_id", "start", "end", F.lit(True).alias("__gold"), F.lit(1).alias("__order"))
    every = rows.unionByName(marks, allowMissingColumns=True)
    line = Window.partitionBy("doc_id").orderBy("start", "__order")
    reached = F.max(F.when(F.col("__gold"), F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.min(F.when(F.col("__gold"), F.col("start"))).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    told = every.withColumns({"__reached": reached, "__behind": behind}).filter("not __gold")
    free = F.coalesce(F.col("__reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("__behind") >= F.col("end"), F.lit(True))
    return told.filter(F.col("doc_id").isNull() | free).drop("__gold", "__order", "__reached", "__behind")


def generalisation_check(expected: DataFrame, gold: DataFrame, done: DataFrame) -> DataFrame:
    """expected (doc_id, original, form) against generalised spans (doc_id, start, end, original, entity_type, generalized_to).

    A gold text that occurs once is sought at its own place first, else any span with that text will do. Reasons: not_detected, wrong_type (found but
    left as it was), wrong_form (the form isn't in what it became), ok.
    """
    once = gold.groupBy("doc_id", F.col("text").alias("original")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("gs"))
    found = done.groupBy("doc_id", "original").agg(F.array_sort(F.collect_list(F.struct("start", "generalized_to"))).alias("found"))
    rows = expected.join(once, ["doc_id", "original"], "left").join(found, ["doc_id", "original"], "left")
    exact = F.try_element_at(F.filter("found", lambda f: (F.col("n") == 1) & (f["start"] == F.col("gs"))), F.lit(1))
    pick = F.coalesce(exact, F.try_element_at(F.col("found"), F.lit(1)))
    reason = F.when(pick.isNull(), "not_detected").when(pick["generalized_to"].isNull(), "wrong_type").when(~F.contains(pick["generalized_to"], F.col("form")), "wrong_form").otherwise("ok")
    return rows.select("doc_id", "original", "form", reason.alias("reason"))


def generalisation_rate(checked: DataFrame) -> DataFrame:
    n, ok = F.count(F.lit(1)), F.count_if(F.col("reason") == "ok")
    return checked.agg(n.alias("checked"), ok.alias("ok")).withColumn("rate", F.round(F.when(F.col("checked") == 0, 1.0).otherwise(F.col("ok") / F.col("checked")), 4)).withColumn("summary", F.concat(F.col("ok").cast("string"), F.lit("/"), F.col("checked").cast("string")))


def record_summary(gold: DataFrame, pred: DataFrame, covered: DataFrame) -> DataFrame:
    """(runner, doc_id, n_gold, n_pred, leaked): counts, and the direct texts that leak, sorted."""
    direct = category_of(F.col("entity_type")) == "direct_identifier"
    g = covered.groupBy("runner", "doc_id").agg(F.count(F.lit(1)).alias("n_gold"), F.array_sort(F.collect_list(F.when(direct & (F.col("covered") < 1), F.col("text")))).alias("leaked"))
    p = pred.groupBy("runner", "doc_id").agg(F.count(F.lit(1)).alias("n_pred"))
    none = F.array().cast("array<string>")
    return g.join(p, ["runner", "doc_id"], "full").select("runner", "doc_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("leaked", none).alias("leaked"))


def latency(runs: DataFrame, exact: bool = True) -> DataFrame:
    """(runner, mean, p50, p95) of latency_ms; exact percentiles interpolate, the approximate ones need no sort of a group."""
    at = (lambda q: F.percentile("latency_ms", q)) if exact else (lambda q: F.percentile_approx("latency_ms", q))
    return runs.groupBy("runner").agg(F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.round(at(0.5), 4).alias("p50_ms"), F.round(at(0.95), 4).alias("p95_ms"))


def layer_status(runs: DataFrame) -> DataFrame:
    """(runner, status): ok if any run was, else the most common one (the smaller on a tie), null without any."""
    n = runs.filter("llm_status is not null").groupBy("runner", "llm_status").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("runner").agg(F.bool_or(F.col("llm_status") == "ok").alias("ok"), F.min_by("llm_status", F.struct(-F.col("n"), "llm_status")).alias("common"))
    return runs.select("runner").distinct().join(best, "runner", "left").select("runner", F.when(F.col("ok"), "ok").otherwise(F.col("common")).alias("status"))


def finds_by_type(pred: DataFrame) -> DataFrame:
    """Finds by type and by type and layer (layer `all`)."""
    rolled = pred.rollup("runner", "entity_type", "layer").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("finds"))
    return rolled.filter("level <= 1").withColumn("layer", F.when(F.col("level") == 1, "all").otherwise(F.col("layer"))).drop("level")


def compare(counts: DataFrame, leaks: DataFrame, times: DataFrame) -> DataFrame:
    """One wide row a runner."""
    m = micro_macro(counts)
    side = lambda mode: m.filter(F.col("mode") == mode).select("runner", *(F.col(c).alias(f"{mode}_{c}") for c in ("micro_precision", "micro_recall", "micro_f1", "macro_f1")))
    return side("exact").join(side("overlap"), "runner").join(leaks, "runner").join(times, "runner")


def report_document(counts: DataFrame, leaks: DataFrame, by_type: DataFrame) -> DataFrame:
    """One nested row a runner from small aggregates."""
    types = scores(counts).groupBy("runner").agg(F.array_sort(F.collect_list(F.struct("mode", "entity_type", "tp", "fp", "fn", "precision", "recall", "f1"))).alias("types"))
    finds = by_type.filter("layer = 'all'").groupBy("runner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "finds")))).alias("finds"))
    return types.join(finds, "runner").join(leaks.select("runner", F.struct("direct", "leaked", "leak_rate", "gate").alias("leaks")), "runner")
