"""Which terms of a (possibly large) term library occur in a text.

Testing every term against every text would cost terms x texts. Instead each
term has a key: its first word run, or its first two characters when it holds
Han text. A text is cut into words (or character pairs) once and intersected
with the keys by hashing; only the few terms whose key is present are tried.
The candidates are then applied in rule order, which gives the same result as
trying all terms one after another.

The key tables are constants inside the plan. Their size is bounded by the
term library's own limit, which is checked when the snapshot is collected.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.hof import let, lookup, sentinel_char
from cloakframe.plans.rules import Term

_WORD = re.compile(r"\w+")
_CANDIDATE = "struct<rank:int,literal:string,pattern:string>"
_GROUPS = f"array<struct<key:string,terms:array<{_CANDIDATE}>>>"


def quote(literal: str) -> str:
    """Escape a literal for Java regular expressions."""
    return "".join(c if c.isalnum() or c.isspace() or not c.isascii() else "\\" + c for c in literal)


def quote_column(literal: Column) -> Column:
    """Column form of :func:`quote`."""
    return F.regexp_replace(literal, r"([^\p{L}\p{N}\s])", r"\\$1")


def _class_of(ranks: list[int]) -> str:
    return "[" + "".join(sentinel_char(r) for r in ranks) + "]" if ranks else ""


def term_pattern(term: Term, word_end: list[int] = (), word_start: list[int] = ()) -> str:
    """Pattern of one term.

    ``word_end`` and ``word_start`` are ranks whose placeholder ends or begins
    with a word character: beside them a word boundary behaves as it would
    beside the written placeholder.
    """
    body = quote(term.term)
    if term.has_han:
        return body
    boundary = r"(?U:\b)"
    ends, starts = _class_of(list(word_end)), _class_of(list(word_start))
    left, right = boundary + body, boundary
    if ends:
        left = f"{boundary}(?<!{ends}){body}" if _WORD.match(term.term[0]) else f"(?:{boundary}|{ends}){body}"
    if starts:
        right = f"{boundary}(?!{starts})" if _WORD.match(term.term[-1]) else f"(?:{boundary}|(?={starts}))"
    # the literal comes first, which lets the matcher skip ahead; what has to
    # stand before it is checked by looking back over it
    return f"{body}{right}(?<={left})"


def _groups(entries: dict[str, list]) -> Column:
    table = [{"key": k, "terms": v} for k, v in sorted(entries.items(), key=lambda kv: kv[0].encode())]
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), _GROUPS)


def _from_keys(parts: Column, entries: dict[str, list]) -> Column:
    keys = F.array_intersect(parts, F.split(F.lit("\n".join(sorted(entries))), "\n"))
    found = let(
        _groups(entries),
        lambda groups: F.flatten(F.transform(keys, lambda k: lookup(groups, k, "key", "terms"))),
    )
    return F.coalesce(found, F.array().cast(f"array<{_CANDIDATE}>"))


def candidate_terms(
    text: Column, terms: tuple[Term, ...], first_rank: int, word_end: list[int] = (), word_start: list[int] = ()
) -> Column:
    """Terms that may occur in ``text``: array of (rank, literal, pattern), by rank."""
    words: dict[str, list] = defaultdict(list)
    pairs: dict[str, list] = defaultdict(list)
    singles: dict[str, list] = defaultdict(list)
    always: list = []
    for i, term in enumerate(terms):
        entry = {"rank": first_rank + i, "literal": term.term, "pattern": term_pattern(term, word_end, word_start)}
        if term.has_han:
            (pairs if len(term.term) > 1 else singles)[term.term[:2]].append(entry)
        elif (run := _WORD.search(term.term)) is not None:
            words[run.group()].append(entry)
        else:
            always.append(entry)
    none = F.array().cast(f"array<{_CANDIDATE}>")
    parts = []
    if words:
        parts.append(_from_keys(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), words))
    has_han = F.rlike(text, F.lit("[一-龥]"))
    if pairs:
        grams = F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))
        parts.append(F.when(has_han, _from_keys(grams, pairs)).otherwise(none))
    if singles:
        chars = F.regexp_extract_all(text, F.lit("[一-龥]"), F.lit(0))
        parts.append(F.when(has_han, _from_keys(chars, singles)).otherwise(none))
    if always:
        parts.append(F.from_json(F.lit(json.dumps(always, ensure_ascii=False)), f"array<{_CANDIDATE}>"))
    if not parts:
        return none
    merged = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.sort_array(F.filter(merged, lambda c: F.contains(text, c["literal"])))
