"""Rule sets: built-in catalogue, activation, custom rules, terms as rules.

A rule set is small by contract (seven built-in rules, a few custom rules and
at most :data:`~cloakframe.plans.lexicon.TERM_MAX_ROWS` terms), so it lives on
the driver as plain tuples and is compiled into Column expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.plans import lexicon as lx

RULE_SCHEMA = (
    "rule_ord INT, id STRING, name STRING, pattern STRING, replacement_template STRING, "
    "enabled BOOLEAN, builtin BOOLEAN, use_counter BOOLEAN"
)
RULE_JSON_SCHEMA = RULE_SCHEMA.replace("rule_ord INT, ", "")


class InvalidRules(ValueError):
    """Rule ids that are missing or unknown (error code INVALID_RULES)."""

    code = "INVALID_RULES"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    pattern: str
    template: str
    enabled: bool = True
    builtin: bool = False
    use_counter: bool = True
    needle: str | None = None
    """A literal every match holds; texts without it are not scanned."""


@dataclass(frozen=True)
class Term:
    id: str
    term: str
    category: str
    enabled: bool = True

    @property
    def has_han(self) -> bool:
        """Strictly between U+4E00 and U+9FA5: such terms match without word boundaries."""
        return any("一" < c < "龥" for c in self.term)

    @property
    def rule_id(self) -> str:
        return f"sensitive_term_{self.id}"


@dataclass(frozen=True)
class RuleSet:
    """Ordered rules, then terms. Order decides which rule sees a value first."""

    rules: tuple[Rule, ...] = ()
    terms: tuple[Term, ...] = ()
    warnings: tuple[str, ...] = field(default=())

    def enabled_ids(self) -> list[str]:
        return [r.id for r in self.rules if r.enabled]

    def add(self, id: str, pattern: str, template: str, *, name: str | None = None, use_counter: bool = True) -> RuleSet:
        """Custom rule: sits after the built-in rules and before the terms."""
        return replace(self, rules=(*self.rules, Rule(id, name or id, pattern, template, use_counter=use_counter)))

    def guarded(self, *ids: str) -> RuleSet:
        """The same rules, but a match of the named ones has no ASCII digit beside it (default: phone, id_card, bank_card)."""
        ids = ids or ("phone", "id_card", "bank_card")
        return replace(self, rules=tuple(replace(r, pattern=f"(?<![0-9])(?:{r.pattern})(?![0-9])") if r.id in ids else r for r in self.rules))

    def missing_required(self) -> list[str]:
        """Rules that personal data calls for and this set doesn't have switched on."""
        return [i for i in lx.PII_REQUIRED_RULES if i not in self.enabled_ids()]

    def with_terms(self, terms: list[Term]) -> RuleSet:
        return replace(self, terms=tuple(t for t in terms if t.enabled))

    def checked(self, spark: SparkSession) -> RuleSet:
        """Drop rules whose pattern does not compile and report them."""
        regex = spark.sparkContext._jvm.java.util.regex.Pattern
        good, warnings = [], []
        for rule in self.rules:
            try:
                regex.compile(java_pattern(rule.pattern))
                good.append(rule)
            except Exception:  # noqa: BLE001 - any JVM syntax error means "invalid"
                if rule.enabled:
                    warnings.append(f"INVALID_RULE_PATTERN:{rule.id}")
        return replace(self, rules=tuple(good), warnings=(*self.warnings, *warnings))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, r.id, r.name, r.pattern, r.template, r.enabled, r.builtin, r.use_counter)
            for i, r in enumerate(self.rules)
        ]
        return spark.createDataFrame(rows, RULE_SCHEMA)


def java_pattern(pattern: str) -> str:
    """Only a line feed ends a line, for '.', '^' and '$' alike."""
    return "(?d)" + pattern


def builtin_rules() -> RuleSet:
    needles = {"email": "@"}
    return RuleSet(tuple(Rule(i, n, p, t, builtin=True, needle=needles.get(i)) for i, n, p, t in lx.BUILTIN_RULES))


def default_rules() -> RuleSet:
    """Built-in rules that are on unless the user says otherwise."""
    base = builtin_rules()
    return replace(base, rules=tuple(r for r in base.rules if r.id not in lx.DEFAULT_OFF_RULES))


def activate(rule_ids: list[str], terms: list[Term] | None = None, custom: list[Rule] | None = None) -> RuleSet:
    """Chosen built-in rules in catalogue order, then custom rules, then terms."""
    chosen = tuple(r for r in builtin_rules().rules if r.id in set(rule_ids))
    return RuleSet((*chosen, *(custom or []))).with_terms(terms or [])


def rule_catalogue(spark: SparkSession) -> DataFrame:
    df = builtin_rules().to_df(spark)
    return df.withColumn("enabled_by_default", ~F.col("id").isin(*lx.DEFAULT_OFF_RULES))


def parse_rule_ids(spec: str) -> list[str]:
    """JSON array or comma list of rule ids; empty or unknown ids are refused."""
    try:
        ids = json.loads(spec)
    except ValueError:
        ids = [part.strip() for part in spec.split(",")]
    if not isinstance(ids, list):
        raise InvalidRules(spec)
    ids = [i for i in ids if i]
    known = {r[0] for r in lx.BUILTIN_RULES} | {lx.TERMS_RULE_ID}
    if not ids or not all(isinstance(i, str) and i in known for i in ids):
        raise InvalidRules(spec)
    return ids


def validate_rule_requests(requests: DataFrame, spec_col: str = "rules") -> DataFrame:
    """Column form of :func:`parse_rule_ids` for a table of requests."""
    known = [r[0] for r in lx.BUILTIN_RULES] + [lx.TERMS_RULE_ID]
    spec = F.col(spec_col)
    parsed = F.coalesce(
        F.when(spec.rlike(r"^\s*\["), F.from_json(spec, "array<string>")),
        F.when(~spec.rlike(r"^\s*[\[{]"), F.transform(F.split(spec, ","), lambda s: F.trim(s))),
    )
    ids = F.filter(parsed, lambda s: s.isNotNull() & (s != ""))
    bad = F.array_except(ids, F.lit(known))
    ok = ids.isNotNull() & (F.size(ids) > 0) & (F.size(bad) == 0)
    return requests.withColumn("rule_ids", F.when(ok, ids)).withColumn(
        "error_code", F.when(~F.coalesce(ok, F.lit(False)), F.lit("INVALID_RULES"))
    )


def read_rules(spark: SparkSession, path: str) -> RuleSet:
    """Rule configuration from JSON lines; a rule file is small by nature."""
    rows = spark.read.schema(RULE_SCHEMA).json(path).orderBy("rule_ord").toLocalIterator()
    rules = [
        Rule(r["id"], r["name"], r["pattern"], r["replacement_template"], r["enabled"], r["builtin"],
             True if r["use_counter"] is None else r["use_counter"])
        for r in rows
    ]
    return RuleSet(tuple(rules)).checked(spark)


def write_rules(rules: RuleSet, spark: SparkSession, path: str) -> None:
    rules.to_df(spark).write.mode("overwrite").json(path)


def terms_from_df(terms: DataFrame) -> list[Term]:
    """Collect an enabled term snapshot, ordered by term, with its size checked."""
    limit = lx.TERM_MAX_ROWS
    rows = (
        terms.filter("enabled")
        .select(F.col("id").cast("string").alias("id"), "term", "category")
        .orderBy("term", "id")
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(f"a term snapshot holds at most {limit} enabled terms")
    return [Term(r["id"], r["term"], r["category"]) for r in rows]
