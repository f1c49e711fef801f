"""Entity detection: rows in, a long findings table out.

Detectors are array expressions on the text column (offsets are UTF-8 bytes),
so detection is a projection followed by one explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.hof import let, prefix_sums
from cloakframe.plans import lexicon as lx

ENTITY = "struct<text:string,entity_type:string,start:int,end:int,confidence:float,source:string>"
NO_ENTITIES = f"array<{ENTITY}>"

PATTERNS = dict(lx.DETECTOR_PATTERNS)


def _java(pattern: str) -> str:
    return pattern.replace(r"\b", r"(?U:\b)")


def _entity(text: Column, kind: Column, start: Column, end: Column, confidence: float | Column, source: str) -> Column:
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(
        text.alias("text"), kind.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"),
        conf.cast("float").alias("confidence"), F.lit(source).alias("source"),
    )


# A text without a match of the cheap pattern cannot match the detectors beside
# it, so most texts are scanned once per line of this table.
_GUARDS = [
    ("[0-9]{8}", ["身份证号", "手机号", "银行卡号", "护照号"]),
    ("@", ["邮箱"]),
    (r"\d\.\d{1,3}\.\d", ["IP地址"]),
    ("[一-龥]{2}", ["地名", "地址"]),
]
_SPEC = "array<struct<ord:int,kind:string,matches:array<string>,gaps:array<string>,confidence:double,source:string>>"


def _located(specs: Column) -> Column:
    """Entities with byte offsets from (kind, matches, gaps, confidence, source).

    Offsets are running sums of the byte lengths of the gaps and the matches.
    """

    def build(s: Column) -> Column:
        lengths = F.zip_with(
            F.slice(s["gaps"], 1, F.size(s["matches"])), s["matches"], lambda g, m: F.octet_length(g) + F.octet_length(m)
        )
        return F.zip_with(
            s["matches"],
            prefix_sums(lengths),
            lambda m, e: F.struct(
                m.alias("text"), s["kind"].alias("entity_type"), (e - F.octet_length(m)).cast("int").alias("start"),
                e.cast("int").alias("end"), s["confidence"].cast("float").alias("confidence"), s["source"].alias("source"),
            ),
        )

    return F.flatten(F.transform(F.filter(specs, lambda s: F.size(s["matches"]) > 0), build))


def _spec(text: Column, ord: int, kind: str, pattern: str, source: str, confidence: float) -> Column:
    regex = _java(pattern)
    return F.struct(
        F.lit(ord).alias("ord"),
        F.lit(kind).alias("kind"),
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("matches"),
        F.split(text, regex, -1).alias("gaps"),
        F.lit(confidence).alias("confidence"),
        F.lit(source).alias("source"),
    )


def pattern_entities(text: Column, kind: str, pattern: str, source: str = "regex", confidence: float = 1.0) -> Column:
    """All matches of one pattern with byte offsets."""
    specs = F.array(_spec(text, 0, kind, pattern, source, confidence))
    return _located(F.when(F.rlike(text, F.lit(_java(pattern))), specs).otherwise(F.array().cast(_SPEC)))


def regex_entities(text: Column, kinds: list[str] | None = None) -> Column:
    """Rule-pattern detector over the chosen entity types, in catalogue order."""
    chosen = {k: (i, p) for i, (k, p) in enumerate(lx.DETECTOR_PATTERNS) if kinds is None or k in kinds}
    guarded = {k for _, ks in _GUARDS for k in ks}
    groups = [*_GUARDS, *[(p, [k]) for k, (_, p) in chosen.items() if k not in guarded]]
    parts = []
    for guard, members in groups:
        specs = [_spec(text, chosen[k][0], k, chosen[k][1], "regex", 1.0) for k in members if k in chosen]
        if specs:
            hit = F.contains(text, F.lit(guard)) if guard == "@" else F.rlike(text, F.lit(guard))
            parts.append(F.when(hit, F.array(*specs)).otherwise(F.array().cast(_SPEC)))
    return _located(F.sort_array(F.concat(*parts)) if len(parts) > 1 else parts[0])


def _byte_start(text: Column, pos: Column) -> Column:
    """Byte offset of 0-based character position."""
    return F.octet_length(F.left(text, pos))


def _gaps(text: Column, pattern: str) -> Column:
    """Texts between the zero-width matches of ``pattern``; ``split`` gives none before a match at the very start."""
    parts = F.split(text, pattern, -1)
    return F.when(F.rlike(text, F.lit(rf"\A(?:{pattern})")), F.concat(F.array(F.lit("")), parts)).otherwise(parts)


def name_candidates(text: Column) -> Column:
    """Surname detector: Han windows of 2-4 characters that start with a common surname.

    Zero-width matches give overlapping windows; texts without Han characters
    are not looked at.
    """
    surname = "[" + "".join(lx.COMMON_SURNAMES) + "]"
    windows = []
    for n in (2, 3, 4):
        # overlapping windows: a zero-width look at each start
        windows.append((n, f"(?=[一-龥]{{{n}}})(?=({surname}[一-龥]{{{n - 1}}}))"))

    def per_length(n: int, pattern: str) -> Column:
        def build(hits: Column, gaps: Column) -> Column:
            before = F.slice(gaps, 1, F.size(hits))
            found = F.struct(
                hits.alias("h"),
                prefix_sums(F.transform(before, lambda g: F.char_length(g))).alias("chars"),
                prefix_sums(F.transform(before, lambda g: F.octet_length(g))).alias("bytes"),
                F.transform(before, lambda g: F.right(g, F.lit(20))).alias("tails"),
            )
            return let(found, lambda f: F.transform(f["h"], lambda h, i: candidate(f, h, i)))

        def candidate(f: Column, h: Column, i: Column) -> Column:
            # the 20 characters before: gaps between matches are not empty, so 21 of them are enough
            start = F.greatest(i - 19, F.lit(1))
            near = F.right(F.array_join(F.slice(f["tails"], start, i + 2 - start), ""), F.lit(20))
            context = F.lit(False)
            for word in lx.NAME_CONTEXT_WORDS:
                context = context | F.contains(near, F.lit(word))
            return F.struct(
                F.get(f["chars"], i).cast("int").alias("pos"), F.lit(n).alias("n"), h.alias("text"),
                F.get(f["bytes"], i).cast("int").alias("at"), context.alias("ctx"),
            )

        return let(
            F.struct(
                F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("h"),
                _gaps(text, pattern).alias("g"),
            ),
            lambda s: build(s["h"], s["g"]),
        )

    found = F.sort_array(F.concat(*[per_length(n, p) for n, p in windows]))
    kept = F.filter(found, lambda c: ~c["text"].isin(*lx.NAME_STOP_WORDS) & (c["ctx"] | (c["n"] < 4)))
    entities = F.transform(
        kept,
        lambda c: _entity(
            c["text"], F.lit("姓名"), c["at"], c["at"] + F.octet_length(c["text"]),
            F.when(c["ctx"], F.lit(0.85)).otherwise(F.lit(0.70)), "ner",
        ),
    )
    return F.when(F.rlike(text, F.lit("[一-龥]{2}")), entities).otherwise(F.array().cast(NO_ENTITIES))


def looks_like_name(name: Column, compound_extra: int | None = None) -> Column:
    """2-4 Han characters that begin with a listed surname (or a compound one)."""
    tail = "+" if compound_extra is None else f"{{1,{compound_extra}}}"
    compound = f"^(?:{'|'.join(lx.COMPOUND_SURNAMES)})[一-龥]{tail}$"
    common = f"^[{''.join(lx.COMMON_SURNAMES)}]"
    return name.rlike("^[一-龥]{2,4}$") & (name.rlike(compound) | name.rlike(common))


def labelled_names(text: Column) -> Column:
    """Names beside a label or a form of address; distinct by span, ordered by start."""

    def one(pattern: str, order: int) -> Column:
        # "(prefix)(name)(suffix)": offsets of the captured name
        regex = pattern

        def build(hits: Column, names: Column, gaps: Column) -> Column:
            ends = prefix_sums(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.octet_length(g) + F.octet_length(h)))
            whole = F.arrays_zip(hits.alias("h"), names.alias("n"), ends.alias("e"))
            return F.transform(
                whole,
                lambda w: let(
                    w["e"] - F.octet_length(w["h"]) + (
                        F.octet_length(w["h"]) - F.octet_length(w["n"]) if order == 0 else F.lit(0)
                    ),
                    lambda st: F.struct(st.cast("int").alias("start"), w["n"].alias("text")),
                ),
            )

        return let(
            F.struct(
                F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("h"),
                F.regexp_extract_all(text, F.lit(regex), F.lit(1)).alias("n"),
                F.split(text, regex, -1).alias("g"),
            ),
            lambda s: build(s["h"], s["n"], s["g"]),
        )

    both = F.concat(*[one(p, i) for i, p in enumerate(lx.LABELLED_NAME_PATTERNS)])
    spans = F.sort_array(F.array_distinct(F.filter(both, lambda s: looks_like_name(s["text"]))))
    entities = F.transform(
        spans, lambda s: _entity(s["text"], F.lit("姓名"), s["start"], s["start"] + F.octet_length(s["text"]), 1.0, "label")
    )
    return F.when(F.rlike(text, F.lit("[一-龥]")), entities).otherwise(F.array().cast(NO_ENTITIES))


def file_name_names(stem: Column) -> Column:
    """Whole Han runs of a name that look like a personal name."""
    runs = pattern_entities(stem, "汉字", "[一-龥]+", source="name")
    runs = F.transform(runs, lambda e: e.withField("entity_type", F.lit("姓名")))
    return F.filter(runs, lambda e: looks_like_name(e["text"], compound_extra=2))


def digit_windows(text: Column) -> Column:
    """Every 11-numeral window that starts with 1; overlapping windows are kept."""
    pattern = r"(?=(1\p{N}{10}))"

    def build(hits: Column, gaps: Column) -> Column:
        starts = prefix_sums(F.transform(F.slice(gaps, 1, F.size(hits)), lambda g: F.octet_length(g)))
        return F.zip_with(
            hits, starts, lambda h, p: _entity(h, F.lit("手机号"), p, p + F.octet_length(h), 0.7, "search")
        )

    found = let(
        F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("h"),
            _gaps(text, pattern).alias("g"),
        ),
        lambda s: build(s["h"], s["g"]),
    )
    return F.when(F.rlike(text, F.lit(r"1\p{N}{10}")), found).otherwise(F.array().cast(NO_ENTITIES))


DETECTORS = {
    "regex": regex_entities,
    "ner": name_candidates,
    "label": labelled_names,
    "search": digit_windows,
}


def entities_column(text: Column, detectors: list[str] = ("regex",), kinds: list[str] | None = None) -> Column:
    """Array of entities of the chosen detectors, in detector order."""
    parts = [regex_entities(text, kinds) if d == "regex" else DETECTORS[d](text) for d in detectors]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def detect(
    df: DataFrame, id_col: str, text_col: str, detectors: list[str] = ("regex",), kinds: list[str] | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """Long findings table. ``keep_empty`` keeps one NULL row for texts without findings."""
    rows = df.select(
        id_col, F.posexplode_outer(entities_column(F.col(text_col), list(detectors), kinds)).alias("ord", "e")
    ).select(id_col, "ord", "e.*")
    return rows if keep_empty else rows.filter(F.col("text").isNotNull())


def detect_rows(df: DataFrame, id_col: str, columns: list[str], **kwargs) -> DataFrame:
    """Detection over the cells of a row joined by a space; rows without findings drop out."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return detect(df.select(id_col, joined.alias("_row_text")), id_col, "_row_text", **kwargs)


def normalize_type(raw: Column) -> Column:
    """Known aliases to the ten entity types; other types are kept."""
    pairs = {alias: kind for kind, aliases in lx.ENTITY_ALIASES.items() for alias in aliases}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.element_at(table, raw), raw)


_SOURCE_ORDER = {"regex": 0, "ner": 1, "label": 2, "ai": 3, "search": 4}


def merge_detections(findings: DataFrame, id_col: str, ai: bool = True) -> DataFrame:
    """One row per (document, text, span).

    Names need two different detectors (or the surname detector alone when
    ``ai`` is off); other types keep the most confident finding, the last one
    on ties, and list their sources.
    """
    order = F.create_map(*[F.lit(x) for kv in _SOURCE_ORDER.items() for x in kv])
    seq = F.coalesce(F.element_at(order, F.col("source")), F.lit(99))
    grouped = findings.groupBy(id_col, "text", "start", "end").agg(
        F.sort_array(
            F.collect_list(
                F.struct(seq.alias("seq"), F.col("ord").alias("ord"), "entity_type", "confidence", "source")
            )
        ).alias("g")
    )
    first_type = F.get("g", F.lit(0))["entity_type"]
    is_name = first_type.isin("人名") | F.contains(first_type, F.lit("姓名"))
    sources = F.array_distinct(F.transform("g", lambda x: x["source"]))
    best = F.element_at(
        F.sort_array(
            F.transform("g", lambda x, i: F.struct(x["confidence"].alias("c"), i.alias("i"), x["entity_type"].alias("t")))
        ),
        -1,
    )
    confirmed = (F.size(sources) >= 2) if ai else F.array_contains(sources, "ner")
    return (
        grouped.withColumn("is_name", is_name)
        .filter(~F.col("is_name") | confirmed)
        .select(
            id_col, "text",
            F.when(F.col("is_name"), "姓名").otherwise(best["t"]).alias("entity_type"),
            "start", "end",
            F.when(F.col("is_name"), F.when(F.size(sources) >= 3, 0.95).otherwise(0.85)).otherwise(best["c"]).cast("float").alias("confidence"),
            F.when(F.col("is_name"), F.concat(F.lit("confirmed_by_"), F.size(sources).cast("string")))
            .otherwise(F.concat(F.lit("union("), F.array_join(F.transform("g", lambda x: x["source"]), ","), F.lit(")")))
            .alias("source"),
        )
    )


MODEL_VALUE_BYTES = 100


def judge_model_answers(answers: DataFrame, documents: DataFrame, id_col: str, text_col: str, answer_col: str = "answer") -> DataFrame:
    """All values of already produced model answers (``type|value`` or ``type:v1,v2`` lines), one row each, with ``reason``.

    ``reason`` is null for a finding, ``VALUE_TOO_LONG`` above 100 bytes, ``NOT_IN_TEXT`` where the document does not hold the
    value or there is no such document. Refusals, empty values and lines without a separator are no values. A document meets
    its values as one array, so its text is not copied for each of them.
    """
    line = F.trim(F.col("line"))
    refusal = (line == "") | (line == "无") | line.rlike("没有|无法|提取结果")
    bar = F.contains(line, F.lit("|"))
    kind_bar, value_bar = F.substring_index(line, "|", 1), F.regexp_extract(line, r"(?s)^[^|]*\|(.*)$", 1)
    wide_colon = F.contains(line, F.lit("："))
    colon = F.when(wide_colon, "：").otherwise(":")
    kind_colon = F.split_part(line, colon, F.lit(1))
    value_colon = F.substring(line, F.char_length(kind_colon) + 2, F.char_length(line))
    values = (
        answers.select(id_col, F.posexplode(F.split(answer_col, r"\r?\n")).alias("line_no", "line"))
        .filter(~refusal & (bar | F.contains(line, F.lit("：")) | F.contains(line, F.lit(":"))))
        .select(
            id_col, "line_no",
            F.trim(F.when(bar, kind_bar).otherwise(kind_colon)).alias("kind"),
            F.posexplode(F.when(bar, F.array(value_bar)).otherwise(F.split(value_colon, ","))).alias("item_no", "value"),
        )
        .withColumn("value", F.trim("value"))
        .filter("value <> ''")
        .groupBy(id_col).agg(F.collect_list(F.struct("line_no", "item_no", "kind", "value")).alias("_values"))
    )
    doc = F.col("_doc")

    def judged(v: Column) -> Column:
        at = F.coalesce(F.call_function("instr", doc, v["value"]), F.lit(0))
        start = _byte_start(doc, at - 1)
        return F.struct(
            v["value"].alias("text"), normalize_type(v["kind"]).alias("entity_type"),
            F.when(at > 0, start).cast("int").alias("start"), F.when(at > 0, start + F.octet_length(v["value"])).cast("int").alias("end"),
            F.lit(0.80).cast("float").alias("confidence"), F.lit("ai").alias("source"),
            (v["line_no"].cast("bigint") * F.lit(1 << 32) + v["item_no"]).alias("ord"),
            F.when(F.octet_length(v["value"]) > MODEL_VALUE_BYTES, "VALUE_TOO_LONG").when(at == 0, "NOT_IN_TEXT").alias("reason"),
        )

    met = values.join(documents.select(id_col, F.col(text_col).alias("_doc")), id_col, "left")
    return met.select(id_col, F.inline(F.transform("_values", judged)))


def parse_model_answers(answers: DataFrame, documents: DataFrame, id_col: str, text_col: str, answer_col: str = "answer") -> DataFrame:
    """Findings from already produced model answers; what is turned down, and why, is in :func:`judge_model_answers`."""
    return judge_model_answers(answers, documents, id_col, text_col, answer_col).filter("reason IS NULL").drop("reason")


def finding_rows(detections: DataFrame, id_col: str) -> DataFrame:
    return detections.select(id_col, "text", "entity_type", "start", "end")


def label_data_class(findings: DataFrame) -> DataFrame:
    """Add data class, level and required masking to findings."""
    sensitive = F.col("entity_type").isin(*lx.C3_ENTITY_TYPES)
    level = F.when(sensitive, 3).otherwise(2)
    names = F.create_map(*[F.lit(x) for n, lv, _ in lx.DATA_CLASSES for x in (lv, n)])
    masks = F.create_map(*[F.lit(x) for _, lv, m in lx.DATA_CLASSES for x in (lv, m)])
    return findings.withColumn("class_level", level).withColumn("data_class", F.element_at(names, F.col("class_level"))).withColumn(
        "required_masking", F.element_at(masks, F.col("class_level"))
    )


def document_class(findings: DataFrame, id_col: str) -> DataFrame:
    """Highest data class per document."""
    return label_data_class(findings).groupBy(id_col).agg(
        F.max("class_level").alias("class_level"), F.max_by("data_class", "class_level").alias("data_class")
    )


def score_expected(expected: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Recall per category: expected values (``required`` or not) against findings."""
    found = findings.select(*keys, "text").distinct().withColumn("found", F.lit(1))
    joined = expected.join(found, [*keys, "text"], "left")
    return joined.groupBy("category").agg(
        F.count("*").alias("expected"),
        F.count("found").alias("found"),
        F.count_if("required").alias("required"),
        F.count_if(F.col("required") & F.col("found").isNotNull()).alias("required_found"),
        (F.count("found") / F.count("*")).alias("recall"),
    )
