"""Document masking with ordered rules, value reuse and numbered placeholders.

One document is one row, so masking is a projection: no shuffle, no Python
worker, and nothing that depends on how rows are spread over partitions.

Per row:

1. A cheap test tells whether any rule can match; other rows pass untouched.
2. Rule after rule, matches are recorded and swapped for the rule's sentinel
   (see :mod:`cloakframe.functions.hof`), so a later rule cannot look inside an
   earlier placeholder. Rules that cannot cross a line feed run over the whole
   text at once; otherwise the text is cut into lines first.
3. Each sentinel is lined up with its recorded value. Read by (line, rule,
   position) the values give the order of first appearance: distinct originals
   get their placeholder in that order from one counter; rules without a
   counter give a constant.
4. Sentinels are swapped for placeholders.

Steps 3 and 4 only sort and slice inside the row, which keeps a document with
very many values at O(n log n).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.hof import (
    SENTINEL_CAPACITY,
    SENTINEL_CLASS,
    constant_array,
    let,
    lookup,
    sentinel,
    sentinel_char,
    sort_by_key,
)
from cloakframe.functions.sizes import small_batches
from cloakframe.operators.finding_sweep import swept_contained, swept_findings
from cloakframe.operators.term_join import attach_terms, swept, written
from cloakframe.operators.term_match import candidate_terms
from cloakframe.plans import lexicon as lx
from cloakframe.plans.rules import RuleSet, java_pattern

MAPPING_TYPE = (
    "array<struct<original:string,masked:string,rule_id:string,first_seen:int,line:int,n_occurrences:int>>"
)
SEED_TYPE = "array<struct<original:string,masked:string,rule_id:string>>"
FINDINGS_TYPE = "array<struct<text:string,entity_type:string>>"

# A pattern that may match any character could swallow a sentinel; such rules
# are applied between sentinels only.
_WIDE = re.compile(r"(?<!\\)\.|\[\^|\\[SDWPXHV]|-\\x\{|-[\U000F0000-\U0010FFFF]")
# A pattern that may match a line feed, or that looks at line ends, has to see
# one line at a time.
_LINE_BOUND = re.compile(r"\[\^|\\[sDWPXnvRAzZGxu]|\(\?|(?<![\\\[])\^|(?<!\\)\$")


@dataclass
class MaskOutput:
    """Results of :func:`mask_documents` as DataFrames.

    ``wide`` has one row per input row; the others are derived from it.
    """

    wide: DataFrame
    id_col: str
    rules: RuleSet

    @property
    def masked(self) -> DataFrame:
        return self.wide.drop("mapping", "masked_entity_count")

    @property
    def mapping(self) -> DataFrame:
        """Long mapping table. ``restorable`` is false where two originals of a
        document share one masked text (constants of one category)."""
        masked = F.sort_array(F.transform("mapping", lambda m: m["masked"]))
        # neighbours of the sorted texts are compared, and the answer is written into the array before it is taken apart
        shared = let(masked, lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        told = let(shared, lambda s: F.transform("mapping", lambda m: m.withField("restorable", ~F.array_contains(s, m["masked"]))))
        return self.wide.select(self.id_col, F.inline(told))

    @property
    def summary(self) -> DataFrame:
        return self.wide.select(
            self.id_col,
            "masked_entity_count",
            F.size("mapping").alias("distinct_values"),
        )

    @property
    def warnings(self) -> DataFrame:
        rows = [(w,) for w in self.rules.warnings]
        return self.wide.sparkSession.createDataFrame(rows, "warning STRING")


def segments(text: Column) -> Column:
    return F.split(text, SENTINEL_CLASS, -1)


def _sentinels(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTINEL_CLASS), F.lit(0))


def _occurrences(rank: Column, originals: Column) -> Column:
    return F.transform(originals, lambda m: F.struct(rank.cast("int").alias("rank"), m.alias("original")))


def _line(text: Column, occ: Column) -> Column:
    return F.struct(text.alias("t"), occ.alias("occ"))


def is_wide(pattern: str) -> bool:
    """Whether a pattern could match a sentinel."""
    return bool(_WIDE.search(pattern))


def apply_pattern(lines: Column, rank: int, pattern: str, wide: bool) -> Column:
    """One rule over all lines; lines without a match pass unchanged."""
    regex, mark = F.lit(pattern), F.lit(sentinel_char(rank))

    def narrow_step(s: Column) -> Column:
        return F.when(
            s["t"].rlike(pattern),
            _line(
                F.regexp_replace(s["t"], regex, mark),
                F.concat(s["occ"], _occurrences(F.lit(rank), F.regexp_extract_all(s["t"], regex, F.lit(0)))),
            ),
        ).otherwise(s)

    def wide_step(s: Column) -> Column:
        matches = F.flatten(
            F.transform(segments(s["t"]), lambda p: F.regexp_extract_all(p, regex, F.lit(0)))
        )
        pieces = F.transform(segments(s["t"]), lambda p: F.regexp_replace(p, regex, mark))
        text = F.array_join(
            F.zip_with(pieces, _sentinels(s["t"]), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), ""
        )
        return F.when(
            s["t"].rlike(pattern), _line(text, F.concat(s["occ"], _occurrences(F.lit(rank), matches)))
        ).otherwise(s)

    return F.transform(lines, wide_step if wide else narrow_step)


def _apply_terms(lines: Column, candidates: Column) -> Column:
    """Terms found in the document, in rule order, with their own sentinels."""

    def one_line(line: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            return F.when(
                F.contains(s["t"], c["literal"]) & F.rlike(s["t"], c["pattern"]),
                _line(
                    F.regexp_replace(s["t"], c["pattern"], sentinel(c["rank"])),
                    F.concat(
                        s["occ"],
                        _occurrences(c["rank"], F.regexp_extract_all(s["t"], c["pattern"], F.lit(0))),
                    ),
                ),
            ).otherwise(s)

        return F.aggregate(candidates, line, step)

    return F.transform(lines, one_line)


# --- findings: switches, tokens ---------------------------------------------


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def active_findings(findings: Column, enabled: list[str]) -> Column:
    """Findings whose rule switch is on, one per value (the first), in the order given; an unknown (null) type is never switched off."""
    blocked = [t for t, _, _, _, switch in lx.FINDING_TOKENS if switch is not None and switch not in enabled]
    off = lambda f: F.coalesce(f["entity_type"].isin(*blocked), F.lit(False)) if blocked else F.lit(False)
    usable = F.filter(findings, lambda f: (F.char_length(f["text"]) > 0) & ~off(f))
    by_text = F.sort_array(F.transform(usable, lambda f, i: F.struct(f["text"].alias("text"), i.alias("i"), f["entity_type"].alias("entity_type"))))
    firsts = let(by_text, lambda fs: F.filter(fs, lambda f, i: (i == 0) | (f["text"] != F.get(fs, i - 1)["text"])))
    ordered = F.sort_array(F.transform(firsts, lambda f: F.struct(f["i"], f["text"], f["entity_type"])))
    return F.coalesce(F.transform(ordered, lambda f: F.struct(f["text"], f["entity_type"])), F.array()).cast(FINDINGS_TYPE)


def token_part(entity_type: Column, position: int) -> Column:
    table = {row[0]: row[position] for row in lx.FINDING_TOKENS}
    return F.coalesce(F.element_at(_literal_map(table), entity_type), F.lit(lx.FINDING_FALLBACK[position - 1]))


# --- the expression ----------------------------------------------------------


def active_rules(rules: RuleSet, scope: str) -> list:
    return [r for r in rules.rules if r.enabled and not (scope == "document" and r.id == "chinese_name")]


def word_sides(active: list) -> tuple[list[int], list[int]]:
    """Ranks of the rules whose placeholder ends, and begins, with a word character."""
    ends = [i + 1 for i, r in enumerate(active) if r.use_counter or re.match(r"\w", r.template[-1:])]
    return ends, [i + 1 for i, r in enumerate(active) if re.match(r"\w", r.template[:1])]


def is_whole(active: list, scope: str) -> bool:
    """Whether the rules may run over the whole text at once."""
    return scope == "fragment" or not any(_LINE_BOUND.search(r.pattern.replace("(?:", "(")) for r in active)


def may_match(text: Column, active: list) -> Column:
    """A cheap test: whether any rule matches."""
    hit = F.lit(False)
    for rule in active:
        found = text.rlike(java_pattern(rule.pattern))
        hit = hit | (F.contains(text, F.lit(rule.needle)) & found if rule.needle else found)
    return hit


def rule_lines(text: Column, rules: RuleSet, scope: str = "document", tested: bool = False) -> Column:
    """The text in lines (or as one line) after all rules, with what they found; unless ``tested``, rules run only where one may match."""
    active = active_rules(rules, scope)
    raw = F.array(text) if is_whole(active, scope) else F.split(text, "(?<=\\n)", -1)
    untouched = F.transform(raw, lambda t: _line(t, F.array().cast("array<struct<rank:int,original:string>>")))
    lines = F.when(text.rlike(SENTINEL_CLASS), apply_pattern(untouched, 0, SENTINEL_CLASS, wide=False)).otherwise(untouched)
    for rank, rule in enumerate(active, start=1):
        lines = apply_pattern(lines, rank, java_pattern(rule.pattern), is_wide(rule.pattern))
    return lines if tested else F.when(may_match(text, active) | text.rlike(SENTINEL_CLASS), lines).otherwise(untouched)


def joined_lines(lines: Column) -> Column:
    """The lines as one text ``t`` with all that was recorded in them, ``occ``."""
    return F.struct(
        F.array_join(F.transform(lines, lambda s: s["t"]), "").alias("t"),
        F.flatten(F.transform(lines, lambda s: s["occ"])).alias("occ"),
    )


def marks_in_order(state: Column, scope: str, whole_text: bool) -> Column:
    """Every sentinel of a text with its recorded value, in the order of first appearance: (line, rank, at, original)."""
    # sentinels in text order, with their line
    pieces = F.split(state["t"], "(?<=\\n)", -1) if scope == "document" else F.array(state["t"])
    marks = F.flatten(
        F.transform(pieces, lambda t, ln: F.transform(_sentinels(t), lambda c: F.struct(ln.alias("line"), c.alias("c"))))
    )
    # sorted the way the values were recorded, they line up with them
    recorded = (
        sort_by_key(F.transform(marks, lambda m, i: F.struct(m["c"].alias("c"), i.alias("at"), m["line"].alias("line"))), "c")
        if whole_text
        else F.sort_array(F.transform(marks, lambda m, i: F.struct(m["line"].alias("line"), m["c"].alias("c"), i.alias("at"))))
    )
    return F.sort_array(
        F.zip_with(
            recorded,
            state["occ"],
            lambda m, o: F.struct(
                m["line"].alias("line"), o["rank"].alias("rank"), m["at"].alias("at"), o["original"].alias("original")
            ),
        )
    )


def values_in_order(ordered: Column) -> Column:
    """The masked values among the marks, sorted by (original, pos)."""
    return sort_by_key(
        F.transform(
            F.filter(ordered, lambda o: o["rank"] > 0),
            lambda o, i: F.struct(
                o["original"].alias("original"), i.alias("pos"), o["rank"].alias("rank"),
                o["line"].alias("line"), o["at"].alias("at"),
            ),
        ),
        "original",
    )


def foreign_marks(ordered: Column) -> Column:
    """Code points of the sentinels that stood in the text before: (at, out)."""
    return F.transform(
        F.filter(ordered, lambda o: o["rank"] == 0),
        lambda o: F.struct(o["at"].alias("at"), o["original"].alias("out")),
    )


def mask_column(
    text: Column,
    rules: RuleSet,
    *,
    findings: Column | None = None,
    seed: Column | None = None,
    seed_counter: Column | None = None,
    scope: str = "document",
    terms: Column | None = None,
    lines: Column | None = None,
) -> Column:
    """Struct ``(masked, mapping, masked_entity_count)`` for one text column.

    ``lines`` are those of :func:`rule_lines` after a library of ``terms`` (an array column) and ``findings`` (those of
    :func:`active_findings`) have been applied to them; findings need them, see :func:`mask_documents`.

    ``scope="document"`` works line by line and leaves the plain name rule to
    the detectors; ``scope="fragment"`` treats the value as one line and uses
    every rule. ``text`` should be a plain column. ``seed`` is an array of
    earlier mapping entries, ``seed_counter`` the last number they used.
    """
    if scope not in ("document", "fragment"):
        raise ValueError(f"unknown scope {scope!r}")
    active = active_rules(rules, scope)
    first_term = len(active) + 1
    first_finding = first_term + len(rules.terms)
    if first_finding >= SENTINEL_CAPACITY:
        raise ValueError("too many rules")
    if terms is not None:
        if rules.terms:
            raise ValueError("terms come with the rules or as a table, not both")
        first_finding = first_term + F.coalesce(F.size(terms), F.lit(0))

    prefixes = [r.template for r in active] + [f"[{t.category}]" for t in rules.terms]
    ids = [r.id for r in active] + [t.rule_id for t in rules.terms]
    counted = [r.use_counter for r in active] + [False] * (len(rules.terms) + (terms is not None))
    word_end, word_start = word_sides(active)

    if findings is not None and lines is None:
        raise ValueError("findings come with the lines that they have been applied to")
    finds = findings
    cands = candidate_terms(text, rules.terms, first_term, word_end, word_start) if rules.terms and finds is None else None
    no_cands = F.array().cast("array<struct<rank:int,literal:string,pattern:string>>")
    no_finds = F.array().cast(FINDINGS_TYPE)
    no_seed = F.array().cast(SEED_TYPE)
    seeds = F.coalesce(seed.cast(SEED_TYPE), no_seed) if seed is not None else no_seed
    start = F.coalesce(seed_counter.cast("int"), F.lit(0)) if seed_counter is not None else F.lit(0)

    # constants of the plan, built once
    all_prefixes, all_ids, all_counted = constant_array(prefixes), constant_array(ids), constant_array(counted, "boolean")
    static = {
        "prefix": lambda rank: F.get(all_prefixes, rank - 1),
        "suffix": lambda rank: F.lit(""),
        "rule_id": lambda rank: F.get(all_ids, rank - 1),
        "counted": lambda rank: F.get(all_counted, rank - 1),
    }

    def describe(fs: Column, rank: Column, what: str) -> Column:
        known = static[what](rank)
        if terms is not None:
            term = F.get(terms, rank - first_term)
            of_term = {
                "prefix": lambda: F.concat(F.lit("["), term["category"], F.lit("]")),
                "suffix": lambda: F.lit(""),
                "rule_id": lambda: F.concat(F.lit("sensitive_term_"), term["id"]),
                "counted": lambda: F.lit(False),
            }[what]()
            known = F.when(rank < first_term, known).otherwise(of_term)
        if finds is None:
            return known
        entity_type = F.get(fs, rank - first_finding)["entity_type"]
        dynamic = {
            "prefix": lambda: token_part(entity_type, 1),
            "suffix": lambda: token_part(entity_type, 2),
            "rule_id": lambda: token_part(entity_type, 3),
            "counted": lambda: F.lit(True),
        }[what]()
        return F.when(rank < first_finding, known).otherwise(dynamic)

    whole_text = is_whole(active, scope)

    def rewrite(cs: Column, fs: Column) -> Column:
        now = rule_lines(text, rules, scope, tested=True) if lines is None else lines
        if cands is not None:
            now = _apply_terms(now, cs)
        return joined_lines(now)

    def assemble(state: Column, fs: Column) -> Column:
        def group(ordered: Column) -> Column:
            foreign = foreign_marks(ordered)
            return let(
                values_in_order(ordered), lambda a: let(distinct_values(a), lambda d: finish(state["t"], fs, a, d, foreign))
            )

        return let(marks_in_order(state, scope, whole_text), group)

    def finish(marked: Column, fs: Column, by_value: Column, distinct: Column, foreign: Column) -> Column:
        fresh = distinct
        carried = None
        if seed is not None:
            known = F.sort_array(
                F.transform(seeds, lambda e: F.struct(e["original"].alias("original"), e["masked"].alias("masked")))
            )
            tagged = let(
                known,
                lambda k: F.transform(
                    distinct,
                    lambda d: F.struct(d.alias("d"), lookup(k, d["original"], "original", "masked").alias("masked")),
                ),
            )
            fresh = F.transform(F.filter(tagged, lambda x: x["masked"].isNull()), lambda x: x["d"])
            carried = F.transform(
                F.filter(tagged, lambda x: x["masked"].isNotNull()),
                lambda x: F.struct(
                    x["masked"].alias("masked"), x["d"]["start"].alias("start"), x["d"]["n"].alias("n")
                ),
            )
        by_first = F.sort_array(
            F.transform(
                fresh,
                lambda d: F.struct(
                    d["pos"].alias("first_seen"), d["line"].alias("line"), d["original"].alias("original"),
                    d["rank"].alias("rank"), d["start"].alias("start"), d["n"].alias("n"),
                ),
            )
        )

        def entry(d: Column, masked: Column) -> Column:
            return F.struct(
                d["first_seen"].alias("first_seen"), d["original"].alias("original"), masked.alias("masked"),
                describe(fs, d["rank"], "rule_id").alias("rule_id"), d["line"].alias("line"),
                d["start"].alias("start"), d["n"].alias("n"),
            )

        def numbered(ds: Column) -> Column:
            with_counter = ds if all(counted) else F.filter(ds, lambda d: describe(fs, d["rank"], "counted"))
            numbers = F.transform(
                with_counter,
                lambda d, i: entry(
                    d,
                    F.concat(
                        describe(fs, d["rank"], "prefix"), (start + i + 1).cast("string"), describe(fs, d["rank"], "suffix")
                    ),
                ),
            )
            if all(counted):
                return numbers
            constants = F.transform(
                F.filter(ds, lambda d: ~describe(fs, d["rank"], "counted")),
                lambda d: entry(d, describe(fs, d["rank"], "prefix")),
            )
            return F.sort_array(F.concat(numbers, constants))

        def output(entries: Column) -> Column:
            mapping = F.transform(
                entries,
                lambda e: F.struct(
                    e["original"].alias("original"), e["masked"].alias("masked"), e["rule_id"].alias("rule_id"),
                    e["first_seen"].cast("int").alias("first_seen"), e["line"].cast("int").alias("line"),
                    e["n"].cast("int").alias("n_occurrences"),
                ),
            )
            written = F.transform(
                entries,
                lambda e: F.struct(e["masked"].alias("masked"), e["start"].alias("start"), e["n"].alias("n")),
            )
            if carried is not None:
                mapping = F.concat(
                    F.transform(
                        seeds,
                        lambda e: F.struct(
                            e["original"].alias("original"), e["masked"].alias("masked"), e["rule_id"].alias("rule_id"),
                            F.lit(-1).alias("first_seen"), F.lit(-1).alias("line"),
                            F.coalesce(lookup(distinct, e["original"], "original", "n"), F.lit(0)).cast("int").alias("n_occurrences"),
                        ),
                    ),
                    mapping,
                )
                written = F.concat(carried, written)
            outs = F.sort_array(
                F.concat(
                    foreign,
                    F.flatten(
                        F.transform(
                            written,
                            # by index: slice() would copy the whole array for each value
                            lambda w: F.transform(
                                F.sequence(w["start"], w["start"] + w["n"] - 1),
                                lambda j: F.struct(F.get(by_value, j)["at"].alias("at"), w["masked"].alias("out")),
                            ),
                        )
                    ),
                )
            )
            masked = F.array_join(
                F.zip_with(segments(marked), outs, lambda p, r: F.concat(p, F.coalesce(r["out"], F.lit("")))), ""
            )
            return F.struct(
                masked.alias("masked"),
                mapping.cast(MAPPING_TYPE).alias("mapping"),
                F.size(by_value).cast("bigint").alias("masked_entity_count"),
            )

        return let(let(by_first, numbered), output)

    untouched = F.struct(
        text.alias("masked"),
        (
            F.transform(
                seeds,
                lambda e: F.struct(
                    e["original"].alias("original"), e["masked"].alias("masked"), e["rule_id"].alias("rule_id"),
                    F.lit(-1).alias("first_seen"), F.lit(-1).alias("line"), F.lit(0).alias("n_occurrences"),
                ),
            )
            if seed is not None
            else F.array()
        ).cast(MAPPING_TYPE).alias("mapping"),
        F.lit(0).cast("bigint").alias("masked_entity_count"),
    )

    def run(cs: Column, fs: Column) -> Column:
        hit = may_match(text, active)
        if cands is not None:
            hit = hit | (F.size(cs) > 0)
        if terms is not None:
            hit = hit | F.coalesce(F.size(terms) > 0, F.lit(False))
        if finds is not None:
            hit = F.exists(lines, lambda s: F.size(s["occ"]) > 0)
        masked = let(rewrite(cs, fs), lambda state: assemble(state, fs))
        return F.when(hit, masked).otherwise(untouched)

    if cands is None and finds is None:
        return run(no_cands, no_finds)
    bound = F.struct(
        (cands if cands is not None else no_cands).alias("c"), (finds if finds is not None else no_finds).alias("f")
    )
    return let(bound, lambda b: run(b["c"], b["f"]))


def distinct_values(by_value: Column) -> Column:
    """Groups of equal originals in an array sorted by (original, pos)."""
    starts = F.filter(
        F.sequence(F.lit(0), F.size(by_value) - 1),
        lambda i: (i == 0) | (F.get(by_value, i)["original"] != F.get(by_value, i - 1)["original"]),
    )
    groups = let(
        starts,
        lambda st: F.transform(
            st,
            lambda p, j: F.struct(
                F.get(by_value, p)["original"].alias("original"),
                F.get(by_value, p)["pos"].alias("pos"),
                F.get(by_value, p)["rank"].alias("rank"),
                F.get(by_value, p)["line"].alias("line"),
                p.alias("start"),
                (F.coalesce(F.get(st, j + 1), F.size(by_value)) - p).alias("n"),
            ),
        ),
    )
    empty = F.array().cast("array<struct<original:string,pos:int,rank:int,line:int,start:int,n:int>>")
    return F.when(F.size(by_value) == 0, empty).otherwise(groups)


# --- DataFrame operators -----------------------------------------------------


def mask_documents(
    df: DataFrame,
    id_col: str,
    text_col: str,
    rules: RuleSet,
    *,
    findings: str | DataFrame | None = None,
    seed: str | None = None,
    seed_counter: str | None = None,
    scope: str = "document",
    terms: DataFrame | None = None,
) -> MaskOutput:
    """Mask a text column; every other column is carried along.

    ``findings`` is an array column of (text, entity_type), which keeps the
    job free of shuffles, or a findings table with ``id_col``, ``text`` and
    ``entity_type`` (optionally ``start``), which is grouped per document and
    joined. A hot document cannot overload a task: the group is bounded by the
    findings of one row.

    ``terms`` is a term library as a table (id, term, category, enabled) of any
    size. It is joined, not collected (see :mod:`cloakframe.operators.term_join`).
    """
    rules = rules.checked(df.sparkSession)
    findings_col = findings
    if isinstance(findings, DataFrame):
        df = attach_findings(df, findings, id_col)
        findings_col = "_findings"
    library = {}
    if terms is not None:
        active = active_rules(rules, scope)
        marked = F.when(F.col(text_col).isNotNull(), F.array_join(F.transform("_lines", lambda s: s["t"]), ""))
        after = len(active) + 1, *word_sides(active)
        # seeds and findings change what terms leave, so such texts are all swept in order
        done = None if findings_col or seed else written(F.col("_lines"), is_whole(active, scope), *after)
        df = attach_terms(df, marked, terms, done=done, by=F.col(text_col), late={"_lines": rule_lines(F.col(text_col), rules, scope)})
        df = df.withColumn("_swept", swept(F.col("_lines"), F.col("_terms"), *after))
        library = {"terms": F.col("_terms"), "lines": F.col("_swept")}
    if findings_col:
        df = df.withColumn("_found", active_findings(F.col(findings_col), rules.enabled_ids()))
        df, library = _with_findings(df, F.col(text_col), rules, scope, library)
    expr = mask_column(
        F.col(text_col),
        rules,
        **library,
        findings=F.col("_found") if findings_col else None,
        seed=F.col(seed) if seed else None,
        seed_counter=F.col(seed_counter) if seed_counter else None,
        scope=scope,
    )
    df = df.withColumn("_m", expr)
    masked, n = F.col("_m.masked"), F.col("_m.masked_entity_count")
    if library and "_written" in df.columns:
        # texts that are written already have no other marks; the mapping is read from the sweep of all, which is left out of the plan where nobody asks for it
        left = mask_column(
            F.col(text_col), rules, terms=F.col("_written.terms"), lines=F.coalesce("_written.lines", "_lines"), seed_counter=F.col(seed_counter) if seed_counter else None, scope=scope
        )
        df = df.withColumn("_rest", F.when(F.col("_written.masked").isNull(), left))
        masked, n = F.coalesce("_written.masked", "_rest.masked"), F.coalesce("_written.n", "_rest.masked_entity_count")
    dropped = [text_col, *([findings_col] if findings_col else []), *([seed] if seed else []), *([seed_counter] if seed_counter else [])]
    dropped += ["_lines", "_terms", "_swept", "_found", "_base", "_done", "_written", "_rest"] if library else []
    wide = (
        df.withColumns({"_masked": masked, "_mapping": F.col("_m.mapping"), "_n": n})
        .drop(*dropped, "_m")
        .withColumnsRenamed({"_masked": "masked", "_mapping": "mapping", "_n": "masked_entity_count"})
    )
    return MaskOutput(wide, id_col, rules)


def _with_findings(df: DataFrame, text: Column, rules: RuleSet, scope: str, library: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """The lines after rules, terms and the findings in ``_found``; all findings of a row share one sentinel, above those of rules and terms."""
    active = active_rules(rules, scope)
    first = len(active) + 1
    if library:
        lines, number, mark = library["lines"], F.lit(first) + F.coalesce(F.size(library["terms"]), F.lit(0)), first + 1
    else:
        lines, mark = rule_lines(text, rules, scope), first + len(rules.terms)
        number = F.lit(mark)
        if rules.terms:
            plain = lines
            lines = let(candidate_terms(text, rules.terms, first, *word_sides(active)), lambda cs: _apply_terms(plain, cs))
    df = small_batches(df).withColumn("_base", lines)
    df = df.withColumn("_done", swept_findings(F.col("_base"), F.transform("_found", lambda f: f["text"]), number, sentinel_char(mark)))
    return df, library | {"lines": F.col("_done")}


def attach_findings(df: DataFrame, findings: DataFrame, id_col: str) -> DataFrame:
    """Distinct finding values per document, in order, as an array column."""
    order = F.col("start") if "start" in findings.columns else F.lit(0)
    per_value = findings.groupBy(id_col, "text", "entity_type").agg(F.min(order).alias("start"))
    grouped = per_value.groupBy(id_col).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("start", "text", "entity_type"))),
            lambda f: F.struct(f["text"].alias("text"), f["entity_type"].alias("entity_type")),
        ).alias("_findings")
    )
    return df.join(grouped, id_col, "left")


def mask_fragments(df: DataFrame, id_col: str, value_col: str, rules: RuleSet, **kwargs) -> MaskOutput:
    """Single values (cells, form fields): one line, every rule."""
    return mask_documents(df, id_col, value_col, rules, scope="fragment", **kwargs)


def masked_counts(files: DataFrame, summary: DataFrame, id_col: str, failed: Column) -> DataFrame:
    """Masked count per input row: NULL for failed rows, 0 where nothing matched."""
    counts = summary.select(id_col, F.col("masked_entity_count").alias("_n"))
    return (
        files.join(counts, id_col, "left")
        .withColumn("masked_entity_count", F.when(~failed, F.coalesce("_n", F.lit(0))))
        .drop("_n")
    )


FEW_ORIGINALS = 32


def leak_check(wide: DataFrame, id_col: str, masked_col: str = "masked", mapping_col: str = "mapping") -> DataFrame:
    """Rows whose masked text still holds one of its own originals.

    Up to ``FEW_ORIGINALS`` entries are looked for one by one, more in one sweep over the text, so the work does not grow
    with originals x text; the rows are the same. Null originals are in no text.
    """
    text, mapping = F.col(masked_col), F.col(mapping_col)
    many = F.size(mapping) > FEW_ORIGINALS
    told = wide.select(id_col, text.alias("_t"), mapping.alias("_m"), swept_contained(text, F.transform(mapping, lambda m: m["original"]), many).alias("_at"))
    one_by_one = F.filter("_m", lambda m: F.contains(F.col("_t"), m["original"]))
    leaks = F.when(F.size("_m") > FEW_ORIGINALS, F.transform("_at", lambda i: F.get("_m", i))).otherwise(one_by_one)
    return told.select(id_col, F.inline(F.transform(leaks, lambda m: F.struct(m["original"].alias("original"), m["rule_id"].alias("rule_id")))))
