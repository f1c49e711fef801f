"""Masking with a term library of any size, held as a table.

Only a library of a few terms becomes a constant of the plan; beyond that it is never collected. Each term is filed under one token: its word, of several words a longer one that no other
term has or else the two neighbours that fewest terms have, or a pair of characters when it holds Han text (a single character when it has no more, or when it has no word at all). Texts are dealt
into as many partitions as a shuffle has. The distinct tokens of each partition are joined with that index by equality, and the terms that are met come into the partition before its texts: rows
are tokens of a partition and not of every text, and no text carries its terms. Tokens are hashes; a bitmap of the library's hashes, a few MB whatever its size, keeps most others out of the join.

What is taken are hits in the order of terms and then of places, each that no earlier one overlaps and whose word boundaries hold beside the placeholders written so far: what trying all terms one
after another would give. Texts that only whole words can match are written a batch at a time (:mod:`cloakframe.operators.term_batch`). For others one sweep per text looks for the terms
where their tokens stand. The taken values are one sentinel each; which term it was stands beside it, so the number of terms in a text is not bounded.

A term with Han text matches anywhere, others at word boundaries. A placeholder of a term begins and ends with a bracket, which is no word character; those of
rules count as what they begin and end with. Where a term takes Han characters out of a run of letters, what is left of the run counts as a word; a term that mixes Han characters with others and
cuts through other letters frees no further words. Null and empty texts have no terms; equal terms under several ids go to the smallest id.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.hof import constant_array, let, lookup, sentinel_char
from cloakframe.functions.sizes import small_batches
from cloakframe.operators.term_batch import BUCKET_BITS, ROWS, SIEVE_BITS, key_hashes, packs, partition_tokens, sieve_of, with_library
from cloakframe.operators.term_batch import patterns as _patterns

TERMS_TYPE = "array<struct<term:string,id:string,category:string,key:string,han:boolean>>"
FEW = 2_000
LINES_TYPE = "array<struct<t:string,occ:array<struct<rank:int,original:string>>>>"
DONE_TYPE = f"struct<masked:string,n:bigint,terms:{TERMS_TYPE},lines:{LINES_TYPE}>"
# fixed values: the Han range of terms, Java's Unicode word character
HAN = r"[\x{4E01}-\x{9FA4}]"
WORD = r"(?U)\w+"
LETTERS = r"(?U)[\w&&[^\x{4E01}-\x{9FA4}]]+"  # runs without Han characters
_TERM = pa.struct([("term", pa.string()), ("id", pa.string()), ("category", pa.string()), ("key", pa.string()), ("han", pa.bool_())])
_LINES = pa.list_(pa.struct([("t", pa.string()), ("occ", pa.list_(pa.struct([("rank", pa.int32()), ("original", pa.string())])))]))
_DONE = pa.struct([("masked", pa.string()), ("n", pa.int64()), ("terms", pa.list_(_TERM)), ("lines", _LINES)])
OWN_WORD = 3  # letters of a word under which a term of several may be filed; shorter ones are in most texts


def filed_terms(terms: DataFrame) -> DataFrame:
    """(term, t, han, of, kind, key): the enabled terms under each token that may be their key; ``of`` is the kind of term, ``t`` its id and category."""
    one = terms.filter("enabled AND term <> ''").groupBy("term").agg(F.min(F.struct(F.col("id").cast("string").alias("id"), "category")).alias("t"))
    one = one.select("term", "t", F.rlike("term", F.lit(HAN)).alias("han"))
    runs = F.regexp_extract_all("term", F.lit(WORD), F.lit(0))
    pairs = F.array_distinct(F.regexp_extract_all("term", F.lit("(?s)(?=(..))"), F.lit(1)))
    kind = F.when(F.col("han"), F.when(F.char_length("term") > 1, "pair").otherwise("single")).when(F.size(runs) > 1, "words").when(F.size(runs) > 0, "word").otherwise("other")
    keyed = one.withColumn("of", kind)
    under = lambda kind, tokens: F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("key")))
    long = F.filter(F.array_distinct(runs), lambda w: F.char_length(w) >= OWN_WORD)
    tokens = F.when(F.col("of") == "pair", under("pair", pairs)).when(F.col("of") == "words", F.concat(under("words", let(runs, neighbours)), under("word", long)))
    tokens = tokens.otherwise(F.array(F.struct(F.col("of").alias("kind"), F.when(F.col("of") == "word", F.get(runs, 0)).otherwise(F.substring("term", 1, 1)).alias("key"))))
    return keyed.select("*", F.inline(tokens))


def term_index(terms: DataFrame) -> DataFrame:
    """(key, kind, term, id, category, han) of the enabled terms; kind is word, words, pair, single or other."""
    filed = filed_terms(terms)
    often = filed.groupBy("kind", "key").agg(F.count("t").alias("n"))  # of t, that both readers of the terms read the same columns and share one exchange
    # few terms under one key, of several words one of them only if it has no other; of equally rare tokens the longest
    shared = (F.col("of") == "words") & (F.col("kind") == "word") & (F.col("n") > 1)
    best = F.min_by(F.struct("kind", "key"), F.struct(shared, "n", F.col("kind") != "word", -F.char_length("key"), "key"))
    return filed.join(often, ["kind", "key"]).groupBy("term", "t", "han").agg(best.alias("b")).select("b.kind", "term", "t.id", "t.category", "han", "b.key")


def neighbours(words: Column) -> Column:
    """Distinct pairs of words that follow each other, as one text with a line feed between; ``words`` is a bound variable."""
    return F.array_distinct(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit("\n"), F.get(words, i + 1))))


def token_arrays(text: Column, kinds: set[str]) -> dict[str, Column]:
    """Distinct tokens of a text by kind, for the kinds of key that the library has."""
    none = F.array().cast("array<string>")
    has_han = F.rlike(text, F.lit(HAN))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    if kinds & {"pair", "single"}:  # a term may take the Han part of a run
        words = F.when(has_han, F.concat(words, F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)))).otherwise(words)
    found = {
        "word": words,
        # a term of several words has no Han characters; what it matches is such runs, whole, one after the other
        "words": let(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), neighbours),
        "pair": F.when(has_han, F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1))).otherwise(none),
        "single": F.when(has_han, F.regexp_extract_all(text, F.lit(HAN), F.lit(0))).otherwise(none),
        "other": F.regexp_extract_all(text, F.lit(r"(?U)\W"), F.lit(0)),
    }
    return {k: found[k] for k in sorted(kinds)}


def _constant_terms(text: Column, rows: list) -> Column:
    """The same terms as :func:`attach_terms` joins, looked up in a library that is a constant of the plan."""
    words, _, han, _ = _patterns()
    least: dict[str, tuple] = {}
    for r in rows:
        least[r["term"]] = min((r["id"], r["category"]), least.get(r["term"], (r["id"], r["category"])))
    tokens = {}
    for term in least:
        found = sorted(set(words.findall(term)))
        if han.search(term):
            tokens[term] = ("pair" if len(term) > 1 else "single", sorted({term[i : i + 2] for i in range(len(term) - 1)}) or [term])
        else:
            tokens[term] = ("word", found) if found else ("other", [term[0]])
    often = Counter((kind, k) for kind, keys in tokens.values() for k in keys)
    groups: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for term, (kind, keys) in tokens.items():
        key = min(keys, key=lambda k: (often[kind, k], -len(k), k))
        id_, category = least[term]
        groups[kind][key].append({"term": term, "id": id_, "category": category, "key": key, "han": kind in ("pair", "single")})
    parts = []
    for kind, tokens_of in token_arrays(text, set(groups)).items():
        table = [{"key": k, "terms": v} for k, v in sorted(groups[kind].items(), key=lambda kv: kv[0].encode())]
        known = F.array_intersect(tokens_of, constant_array([g["key"] for g in table]))
        one = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), f"array<struct<key:string,terms:{TERMS_TYPE}>>")
        parts.append(_looked_up(one, known))
    found = F.sort_array(F.concat(*parts))
    return let(found, lambda f: F.when(F.size(f) > 0, f))


def _looked_up(groups: Column, keys: Column) -> Column:
    return let(groups, lambda g: F.flatten(F.transform(keys, lambda k: lookup(g, k, "key", "terms"))))


def attach_terms(
    df: DataFrame, text: Column, terms: DataFrame, name: str = "_terms", few: int = FEW, *, done: Column | None = None, by: Column | None = None, late: dict[str, Column] | None = None
) -> DataFrame:
    """``df`` with the terms whose token occurs in ``text``, in library order (term, id); null where there are none.

    A library of at most ``few`` terms is a constant of the plan, a larger one is joined. Terms of several words are attached by one of their words in the first
    case, by two neighbours or a word of their own in the second: which candidates come differs, what the sweep takes does not.

    ``late`` are columns to add, which ``text`` may be made of: rows are dealt out by ``by`` (``text`` unless given) without them. With ``done``, see :func:`written`, a joined
    library also gives the column ``_written``.
    """
    df = small_batches(df)  # the sweep after it holds a batch of texts with their terms
    late = late or {}
    rows = terms.filter("enabled AND term <> ''").select(F.col("id").cast("string").alias("id"), "term", "category").limit(few + 1).collect()
    if len(rows) <= few:
        return df.withColumns(late).withColumn(name, _constant_terms(text, rows) if rows else F.lit(None).cast(TERMS_TYPE))
    met = _beside_library(df, text, terms, text if by is None else by, late)
    if done is not None:
        met = met.withColumn("_written", done)
    return met.withColumn(name, _attached("_terms_lib", "_terms_text")).filter("_terms_lib IS NULL").drop("_terms_lib", "_terms_text", "_terms_part")


def _beside_library(df: DataFrame, text: Column, terms: DataFrame, by: Column, late: dict[str, Column]) -> DataFrame:
    """``df`` with ``late``, ``_terms_text`` and ``_terms_part``, dealt by text; each partition begins with packs of the terms (``_terms_lib``) whose token is in one of its texts."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bit = F.shiftrightunsigned(_key_hash("kind", "key"), 64 - SIEVE_BITS)
    bits = filed_terms(terms).select("kind", bit.alias("bit")).select("kind", F.shiftright("bit", BUCKET_BITS).alias("b"), F.col("bit").bitwiseAND((1 << BUCKET_BITS) - 1).alias("p"))
    sieve = bits.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"), F.collect_set("kind").alias("kinds")).collect()
    kinds = {k for r in sieve for k in r["kinds"]}
    # equal texts need the same terms; texts without any go where the other columns say
    names = [c.lower() for c in df.columns]
    plain = [f for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant")) and names.count(f.name.lower()) == 1]
    spare = [F.col("`" + f.name.replace("`", "``") + "`") for f in plain]
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    dealt = df.select("*", by.alias("_terms_by")).select("*", F.when(F.col("_terms_by") != "", part("_terms_by")).otherwise(part(*spare) if spare else 0).alias("_terms_part")).drop("_terms_by")
    texts = dealt.withColumns(late).select("_terms_part", text.alias("_terms_text")).filter("_terms_text <> ''").repartitionById(n, "_terms_part")
    tokens = texts.mapInArrow(partition_tokens(kinds, sieve_of({r["b"]: bytes(r["bits"]) for r in sieve})), "_terms_part int, _hash long")
    index = term_index(terms).withColumn("category", F.col("category").cast("string")).withColumn("_hash", _key_hash("kind", "key"))
    met = tokens.join(index, "_hash").select("_terms_part", *ROWS.names).mapInArrow(packs, "_terms_part int, _terms_lib binary")
    both = dealt.select("*", F.lit(None).cast("binary").alias("_terms_lib")).union(met.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema], "_terms_part", "_terms_lib"))
    return both.repartitionById(n, "_terms_part").sortWithinPartitions(F.col("_terms_lib").isNull()).withColumns(late).withColumn("_terms_text", text)


def _key_hash(kind: str, key: str) -> Column:
    @F.arrow_udf("long")
    def run(kinds: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array(key_hashes(kinds, keys).view("int64"))

    return run(kind, key)


def _attached(lib: str, text: str) -> Column:
    @F.arrow_udf(TERMS_TYPE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(_TERM)
        for library, texts, n, *_ in with_library(batches):
            found = library.attached(texts).cast(kind) if library else pa.nulls(len(texts), kind)
            yield pa.concat_arrays([pa.nulls(n, kind), found])

    return run.asNondeterministic()(lib, text)  # kept where it stands: rows of the library have to come through it


def written(lines: Column, whole: bool, first: int, word_end: list[int], word_start: list[int]) -> Column:
    """For :func:`attach_terms`: the masked text and the number of places for texts that need no sweep in order; for others the terms, and ``lines`` after them where there are terms."""
    ends, starts = (frozenset(map(sentinel_char, r)) for r in (word_end, word_start))

    @F.arrow_udf(DONE_TYPE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for library, texts, n, marked in with_library(batches):
            found = pa.nulls(len(texts), _DONE)
            if library:
                each = texts.dictionary_encode()  # equal texts are in one partition
                masked, places, terms = (x.take(each.indices) for x in library.masked(each.dictionary))
                left = [None] * len(texts)
                for i in pc.indices_nonzero(terms.is_valid()).to_pylist():  # one text at a time
                    text = texts[i].as_py()
                    own = marked[i].as_py() or [{"t": t, "occ": []} for t in ([text] if whole else re.split("(?<=\n)", text))]
                    sweep = Sweep(terms[i].as_py(), first, ends, starts)
                    left[i] = [sweep.line(x) for x in own]
                found = pa.StructArray.from_arrays([masked, places, terms.cast(pa.list_(_TERM)), pa.array(left, _LINES)], fields=list(_DONE))
            yield pa.concat_arrays([pa.nulls(n, _DONE), found])

    # lines without marks are those of the text
    return run.asNondeterministic()("_terms_lib", "_terms_text", F.when(F.exists(lines, lambda s: F.size(s["occ"]) > 0), lines))


class Sweep:
    """One text's terms, ready to be looked for; ``word_end`` and ``word_start`` are the sentinels that count as a word character where they end and begin."""

    def __init__(self, terms: list[dict], first: int, word_end: frozenset[str], word_start: frozenset[str]):
        self.terms, self.first, self.mark = terms, first, sentinel_char(first)
        self.word_end, self.word_start = word_end, word_start
        self.by_word, self.by_pair = defaultdict(list), defaultdict(list)
        words, _, _, self.word = _patterns()
        for i, t in enumerate(terms):
            if t["han"] or not words.search(t["term"]):
                self.by_pair[t["key"]].append((i, t["term"].index(t["key"])))
            else:
                key = max(t["key"].split("\n"), key=len)
                self.by_word[key].append((i, next(m.start() for m in words.finditer(t["term"]) if m.group() == key)))

    def hits(self, text: str) -> list[tuple[int, int]]:
        """Every place (term, start) where a term's characters stand."""
        found = set()
        words, other, han, _ = _patterns()
        for pattern in (words, other) if han.search(text) else (words,):
            for m in pattern.finditer(text) if self.by_word else ():
                found.update((i, m.start() - at) for i, at in self.by_word.get(m.group(), ()))
        for size in {len(k) for k in self.by_pair}:
            for p in range(len(text) - size + 1):
                found.update((i, p - at) for i, at in self.by_pair.get(text[p : p + size], ()))
        return sorted((i, s) for i, s in found if s >= 0 and text.startswith(self.terms[i]["term"], s))

    def line(self, line: dict) -> dict:
        text, taken, spans = line["t"], {}, []

        def is_word(place: int, term: int, marks: frozenset[str]) -> bool:
            if not 0 <= place < len(text) or taken.get(place, term) < term:
                return False
            return text[place] in marks or bool(self.word.match(text[place]))

        for i, start in self.hits(text):
            term = self.terms[i]["term"]
            end = start + len(term)
            if any(p in taken for p in range(start, end)):
                continue
            if not self.terms[i]["han"]:
                left, right = is_word(start - 1, i, self.word_end), is_word(end, i, self.word_start)
                if left == bool(self.word.match(term[0])) or right == bool(self.word.match(term[-1])):
                    continue
            taken.update(dict.fromkeys(range(start, end), i))
            spans.append((start, end, i))
        out, at = [], 0
        for start, end, _ in sorted(spans):
            out += [text[at:start], self.mark]
            at = end
        occ = [{"rank": self.first + i, "original": text[s:e]} for s, e, i in sorted(spans)]
        return {"t": "".join(out) + text[at:], "occ": line["occ"] + occ}


def swept(lines: Column, terms: Column, first: int, word_end: list[int], word_start: list[int]) -> Column:
    """``lines`` (see LINES_TYPE) after all terms; rows without a term don't go through Python."""
    ends, starts = (frozenset(map(sentinel_char, r)) for r in (word_end, word_start))
    @F.arrow_udf(LINES_TYPE)
    def run(rows: pa.Array) -> pa.Array:
        out = []
        for i in range(len(rows)):  # one text at a time
            row = rows[i].as_py()
            s = row and Sweep(row["terms"], first, ends, starts)
            out.append(s and [s.line(x) for x in row["lines"]])
        return pa.array(out, _LINES)

    run = run.asNondeterministic()  # kept as a step of its own: merged into what reads it, Spark can't place it
    return F.coalesce(run(F.when(F.size(terms) > 0, F.struct(lines.alias("lines"), terms.alias("terms")))), lines)
