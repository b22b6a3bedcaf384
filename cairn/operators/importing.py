"""Import of cards from an older knowledge base: classification, axes, drop reasons and grouping into features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import CJK, clean_tags, is_blank, units
from cairn.operators.validation import MIN_MECHANISM_UNITS

# Fixed values.
AXIS_ALIASES = {
    "runtime_control_flow": ("运行", "控制流", "control flow"),
    "data_flow": ("数据流", "data flow"),
    "state_lifecycle": ("状态", "生命周期", "state"),
    "failure_recovery": ("失败", "恢复", "failure", "recovery"),
    "concurrency_timing": ("并发", "时序", "concurrency"),
}
REASONS = ("code_mismatch", "no_code_span", "evidence_missing", "schema_invalid")
GOTCHAS = ("gotcha", "pitfall", "陷阱", "踩坑", "坑")
MOST_EVIDENCE, MOST_ENTRY_POINTS, MOST_TAGS, MOST_CHARACTERISTICS = 6, 8, 12, 8
MOST_TITLE, MOST_SUMMARY, MIN_ONE_LINER_UNITS, REACH = 200, 1000, 10, 40
CODE_KINDS, CARD_KINDS = ("snippet", "skeleton"), ("mechanism", "snippet", "skeleton", "gotcha", "decision")
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
NOT_BLANK = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def card_kind(card_type: Column, mechanism: Column, has_code: Column, gotchas: tuple[str, ...] = GOTCHAS) -> Column:
    """(kind, rule) of an older card; a null kind is skipped."""
    warns = F.array_contains(F.transform(F.array(*map(F.lit, gotchas)), lambda g: F.contains(F.lower(mechanism), g)), True)
    pick = lambda kind, rule: F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(rule).alias("rule"))
    return (F.when((card_type == "feature_pattern") & has_code, pick("snippet", "feature_pattern/code-span")).when(card_type == "feature_pattern", pick("mechanism", "feature_pattern/mechanism"))
            .when((card_type == "integration_note") & F.coalesce(warns, F.lit(False)), pick("gotcha", "integration_note/gotcha")).when(card_type == "integration_note", pick("decision", "integration_note/decision"))
            .when(card_type == "project_characteristic", pick(None, "project_characteristic/skip")).when(has_code, pick("snippet", "unknown/code-span")).otherwise(pick("mechanism", "unknown/mechanism")))


def axis_of(text: Column) -> Column:
    """The first axis whose name or alias the text holds, else ''."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("")
    for axis, aliases in reversed(AXIS_ALIASES.items()):
        holds = F.contains(low, F.lit(axis))
        for alias in aliases:
            holds = holds | F.contains(low, F.lit(alias))
        out = F.when(holds, axis).otherwise(out)
    return out


def drop_reason(kind: Column, attempted: Column, hit: Column, has_code: Column, evidence: Column, valid: Column) -> Column:
    """Why a card is not imported, null if it is. The order of the tests matters."""
    return (F.when((attempted > 0) & (hit == 0), "code_mismatch").when(kind.isin("snippet", "skeleton") & ~has_code, "no_code_span")
            .when((attempted == 0) & kind.isin("mechanism", "decision", "gotcha"), "evidence_missing").when(evidence == 0, "evidence_missing").when(~valid, "schema_invalid"))


def reason_counts(cards: DataFrame) -> DataFrame:
    """(reason, n) for every reason, 0 included."""
    every = cards.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, REASONS))).alias("reason"))
    return every.join(cards.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")), "reason", "left").fillna(0, ["n"])


def hit_rate(cards: DataFrame) -> DataFrame:
    return cards.agg(F.when(F.sum("attempted") > 0, F.round(F.sum("hit") / F.sum("attempted"), 4)).otherwise(0.0).alias("hit_rate"))


def grouped(cards: DataFrame, least: int = 3) -> DataFrame:
    """Cards (source_id, card_id, label, axis) with the feature they go to: by label where a source has at least ``least`` labels, else by axis, else in consecutive parts."""
    from cairn.operators.catalog import thirds

    n = cards.groupBy("source_id").agg(F.count_distinct(F.nullif("label", F.lit(""))).alias("labels"), F.count_distinct(F.nullif("axis", F.lit(""))).alias("axes"))
    rows = thirds(cards.join(n, "source_id"), "source_id", "card_id", least)
    group = F.when(F.col("labels") >= least, F.coalesce(F.nullif("label", F.lit("")), F.lit("other"))).when(F.col("axes") >= least, F.coalesce(F.nullif("axis", F.lit("")), F.lit("other"))).otherwise(F.concat(F.lit("part-"), (F.col("part") + 1).cast("string")))
    return rows.select("source_id", "card_id", group.alias("feature"))


def evidence_by_card(evidence: DataFrame, most: int | None = None) -> DataFrame:
    """(card_id, evidence): each card's evidence (card_id, path, start_line, end_line) in order, the first ``most`` of it if given."""
    rows = evidence.where(F.col("card_id").isNotNull()).groupBy("card_id").agg(F.array_sort(F.collect_list(F.struct("path", "start_line", "end_line"))).alias("evidence"))
    return rows if most is None else rows.withColumn("evidence", F.slice("evidence", 1, most))


def source_keys(*tables: DataFrame) -> DataFrame:
    """The distinct non-empty keys of all tables (key)."""
    rows = tables[0].select("key")
    for table in tables[1:]:
        rows = rows.union(table.select("key"))
    return rows.where(F.coalesce("key", F.lit("")) != "").distinct()


def entry_points(paths: Column, report_path: Column, most: int = MOST_ENTRY_POINTS) -> Column:
    """The first distinct paths, ``most`` at most; the report's own where there are none."""
    own = F.slice(F.array_distinct(F.filter(paths, lambda p: F.coalesce(p, F.lit("")) != "")), 1, most)
    return F.when(F.size(own) > 0, own).otherwise(F.filter(F.array(report_path), lambda p: p.isNotNull()))


def _line_list(text: Column) -> Column:
    """A text's lines; no empty one behind a final line end."""
    lines = F.split(text, LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def recut(evidence: DataFrame, files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Evidence (repo_key, card_id, ord, path, line) cut anew from files (repo_key, path, text): attempted, hit, and of hits the span, its text and the file's hash.

    A path without leading dots and slashes and a line number make an attempt; it hits if the file is there, not longer than
    ``max_chars``, and has that line, not blank. The span is the run of lines that are not blank around it, REACH each way at
    most. Files join their evidence by path; only spans go on.
    """
    path = F.regexp_replace(F.btrim(F.coalesce("path", F.lit(""))), r"^[./]+", "")
    asked = evidence.select("repo_key", "card_id", "ord", path.alias("path"), F.col("line").cast("int").alias("line"), ((F.btrim(F.coalesce("path", F.lit(""))) != "") & F.col("line").isNotNull()).alias("attempted"))
    there = files.where(F.lit(True) if max_chars is None else F.char_length("text") <= max_chars).select("repo_key", "path", "text")
    rows = asked.join(there, ["repo_key", "path"], "left").select("*", F.explode_outer(F.array(_line_list(F.col("text")))).alias("lines"))
    at, n = F.col("line") - 1, F.size("lines")
    blank = lambda i: ~F.get("lines", i).rlike(NOT_BLANK)
    hit = F.col("attempted") & F.col("lines").isNotNull() & (F.col("line") >= 1) & (F.col("line") <= n)
    rows = rows.withColumn("hit", F.coalesce(F.when(hit, ~blank(at)), F.lit(False)))
    low, high = F.greatest(at - REACH, F.lit(0)), F.least(at + REACH, n - 1)
    first = F.coalesce(F.array_max(F.filter(F.sequence(low, at), blank)) + 1, low)
    last = F.coalesce(F.array_min(F.filter(F.sequence(at, high), blank)) - 1, high)
    only = lambda c: F.when(F.col("hit"), c)
    rows = rows.withColumns({"start_line": only(first + 1), "end_line": only(last + 1)})
    text = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return rows.select("repo_key", "card_id", "ord", "path", "attempted", "hit", "start_line", "end_line", only(text).alias("excerpt"), only(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16)).alias("file_sha"))


def card_problems(kind: Column, title: Column, summary: Column, mechanism: Column, has_spans: Column, code: Column, evidence: Column) -> Column:
    """Codes of what is wrong with an imported card, in order of the rules."""
    empty = lambda c: ~F.coalesce(c, F.lit("")).rlike(NOT_BLANK)
    text, wants = F.btrim(F.coalesce(mechanism, F.lit(""))), F.coalesce(kind.isin(*CODE_KINDS), F.lit(False))
    rules = [
        (~F.coalesce(kind.isin(*CARD_KINDS), F.lit(False)), "bad_enum"), (empty(title), "missing_field"), (F.char_length(F.coalesce(summary, F.lit(""))) < 12, "missing_field"),
        (is_blank(text), "blank_principle"), (~is_blank(text) & text.rlike(CJK), "unicode_language_mismatch"), (~is_blank(text) & ~text.rlike(CJK) & (units(text) < MIN_MECHANISM_UNITS), "principle_too_short"),
        (wants & ~has_spans, "code_required"), (wants & has_spans & empty(code), "code_required"), (~wants & has_spans, "code_forbidden"), (evidence == 0, "missing_field"),
    ]
    return F.filter(F.array(*[F.when(when, F.lit(code_)) for when, code_ in rules]), lambda c: c.isNotNull())


def report_problems(features: Column, characteristics: Column, entry_points_: Column, risks: Column, one_liner: Column) -> Column:
    """Codes of what is wrong with an assembled report, by the lengths of its lists and its first line."""
    rules = [(features < 3, "too_few_features"), (characteristics < 1, "missing_field"), (entry_points_ < 1, "missing_field"), (risks < 1, "missing_field"), (units(F.coalesce(one_liner, F.lit(""))) < MIN_ONE_LINER_UNITS, "missing_field")]
    return F.filter(F.array(*[F.when(when, F.lit(code)) for when, code in rules]), lambda c: c.isNotNull())


def imported(cards: DataFrame, spans: DataFrame) -> DataFrame:
    """Older cards (repo_key, card_id, card_type, title, summary, mechanism, tags, label) with what becomes of each, from its evidence as ``recut`` gives it.

    Adds status (import, drop or skip), reason, kind, rule, attempted, hit, pending, problems, and of imported cards the texts
    as they are stored: empty ones filled from the others, cut to their lengths, code from the spans of code cards, evidence.
    Cards in another language than asked are imported as pending.
    """
    cut = F.struct("ord", "path", "start_line", "end_line", "excerpt")
    found = spans.groupBy("repo_key", "card_id").agg(F.count_if("attempted").alias("attempted"), F.count_if("hit").alias("hit"), F.array_sort(F.collect_list(F.when(F.col("hit"), cut))).alias("spans"))
    text = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")))
    rows = cards.withColumnsRenamed({"title": "_t", "summary": "_s", "mechanism": "_m"}).join(found, ["repo_key", "card_id"], "left").fillna(0, ["attempted", "hit"])
    made = F.col("hit") > 0
    rows = rows.withColumn("_k", card_kind(F.lower(text("card_type")), text("_m"), made))
    kind, code = F.col("_k.kind"), F.array_join(F.filter(F.transform(F.flatten(F.transform("spans", lambda e: F.split(e.excerpt, "\n"))), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != ""), "\n")
    filled = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    title = filled(text("_t"), F.btrim(F.substring(text("_m"), 1, 60)), F.btrim(F.substring(text("_s"), 1, 60)), F.lit("Imported card"))
    rows = rows.withColumns({"title": title}).withColumn("summary", filled(text("_s"), F.substring(text("_m"), 1, 200), F.col("title")))
    rows = rows.withColumn("mechanism", filled(text("_m"), F.col("summary"))).withColumn("code", F.when(kind.isin(*CODE_KINDS), code))
    rows = rows.withColumns({"title": F.substring("title", 1, MOST_TITLE), "summary": F.substring("summary", 1, MOST_SUMMARY)})
    rows = rows.withColumn("problems", card_problems(kind, F.col("title"), F.col("summary"), F.col("mechanism"), made & kind.isin(*CODE_KINDS), F.col("code"), F.col("hit")))
    blocking = F.filter("problems", lambda c: c != "unicode_language_mismatch")
    reason = F.when(kind.isNotNull(), drop_reason(kind, F.col("attempted"), F.col("hit"), made, F.col("hit"), F.size(blocking) == 0))
    rows = rows.withColumns({"reason": reason, "kind": kind, "rule": F.col("_k.rule"), "tags": F.slice(clean_tags(F.col("tags")), 1, MOST_TAGS)})
    status = F.when(F.col("kind").isNull(), "skip").when(F.col("reason").isNotNull(), "drop").otherwise("import")
    pending = (status == "import") & F.array_contains("problems", "unicode_language_mismatch")
    return rows.withColumns({"status": status, "pending": pending}).drop("_t", "_s", "_m", "_k")


def feature_evidence(cards: DataFrame, features: DataFrame) -> DataFrame:
    """(repo_key, feature, evidence): the different places that a feature's imported cards name, by kind and title of the cards, MOST_EVIDENCE at most."""
    rows = cards.where("status = 'import'").join(features, ["repo_key", "card_id"]).select("repo_key", "feature", F.struct("kind", "title", "card_id").alias("card"), F.posexplode("spans").alias("i", "e"))
    first = rows.groupBy("repo_key", "feature", "e.path", "e.start_line").agg(F.min(F.struct("card", "i", "e.end_line")).alias("first"))
    place = F.row_number().over(Window.partitionBy("repo_key", "feature").orderBy("first.card", "first.i"))
    few = first.withColumn("place", place).where(F.col("place") <= MOST_EVIDENCE)
    entry = F.struct("place", "path", "start_line", F.col("first.end_line").alias("end_line"))
    return few.groupBy("repo_key", "feature").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("place")).alias("evidence"))
