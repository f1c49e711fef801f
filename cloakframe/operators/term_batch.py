"""Terms of a library looked for in a batch of texts at once: numpy over the UTF-8 bytes of Arrow strings.

Words are runs of word characters, found by comparing neighbouring bytes' classes; a word, or a pair of neighbours, is one 64-bit hash. Hashes only choose
candidates: every hit is compared with its term byte by byte. A text whose hits are whole words throughout is written here. What has to be swept in order (terms with Han
characters, terms that begin or end with no word character, texts with sentinels) is left to :class:`cloakframe.operators.term_join.Sweep`, with its candidates.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_HAN_PYTHON = "[丁-龤]"
_WORD_PYTHON = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]"
WORD, HAN = 1, 2  # bits of a class
SENTINEL_LEAD = 0xF3  # texts with a byte from here on may hold sentinels
SIEVE_BITS, BUCKET_BITS = 27, 15  # 16 MB at most, in bitmaps of 4 KB
HASHED, PIECE, HITS, WRITTEN = 4_096, 1 << 16, 1 << 15, 1 << 18  # bytes of a word that its hash reads; bytes, hits and bytes written that are dealt with together
BATCH = 1 << 20  # bytes of texts looked at together: workers keep the memory they once had, and an executor has several
_SEED = {"word": 0x9AE16A3B2F90404F, "words": 0xC949C7DEFA7F4A31, "pair": 0xB492B66FBE98F273, "single": 0xD6E8FEB86659FD93, "other": 0xA5A3564E7A1D2F4B}
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def patterns():
    import regex

    return regex.compile(f"{_WORD_PYTHON}+"), regex.compile(f"(?:(?!{_HAN_PYTHON}){_WORD_PYTHON})+"), regex.compile(_HAN_PYTHON), regex.compile(_WORD_PYTHON)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """The class of each code point and of each ASCII byte; a number for each byte; powers of the base and of its inverse."""
    words, _, han, _ = patterns()
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0x20  # surrogates are no characters
    points = points.tobytes().decode("utf-32-le")
    of_point = np.zeros(0x110000, np.uint8)
    for bit, pattern in ((WORD, words), (HAN, han)):
        for m in pattern.finditer(points):
            of_point[m.start() : m.end()] |= bit
    of_byte = np.zeros(256, np.uint8)
    of_byte[:128] = of_point[:128]
    numbers = np.random.RandomState(7).randint(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    powers = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(PIECE + HASHED, base, np.uint64)
        p[0] = 1
        powers.append(np.cumprod(p))
    return of_point, of_byte, numbers, *powers


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with the end of the last."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    of_point, of_byte, *_ = _tables()
    out = np.zeros(len(data) + 3, np.uint8)
    out[: len(data)] = of_byte[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        rest = np.concatenate([data, np.zeros(3, np.uint8)])
        first, b1, b2, b3 = (rest[at + i].astype(np.int32) for i in range(4))
        b1, b2, b3 = b1 & 63, b2 & 63, b3 & 63
        two, three = first < 0xE0, first < 0xF0
        point = np.where(two, (first & 31) << 6 | b1, np.where(three, (first & 15) << 12 | b1 << 6 | b2, (first & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = of_point[np.minimum(point, 0x10FFFF)]
        out[at] = out[at + 1] = kind
        out[at[~two] + 2] = kind[~two]
        out[at[~three] + 3] = kind[~three]
    return out[: len(data)]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the spans of ``data``, which come in order of their starts."""
    _, _, numbers, powers, inverse = _tables()
    out, short = np.empty(len(starts), np.uint64), np.minimum(ends, starts + HASHED)
    for a in range(0, len(data), PIECE):
        lo, hi = np.searchsorted(starts, (a, a + PIECE))
        if lo < hi:
            piece = data[a : a + PIECE + HASHED]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(numbers[piece] * powers[: len(piece)], out=sums[1:])
            s = starts[lo:hi] - a
            out[lo:hi] = (sums[short[lo:hi] - a] - sums[s]) * inverse[s]
    out[starts >= len(data)] = 0  # empty spans at the end
    return mixed(out ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(3) + b * np.uint64(5), _SEED["words"])


def key_hashes(kinds: pa.Array, keys: pa.Array) -> np.ndarray:
    """The hash of a term's key, as :class:`Texts` has it for the tokens of texts."""
    data, at = bytes_of(keys)
    kinds = kinds.to_numpy(zero_copy_only=False)
    out = hashes(data, at[:-1], at[1:])
    for kind, seed in _SEED.items():
        of = np.flatnonzero(kinds == kind)
        if kind == "words":  # two words with a line feed between
            feeds = np.flatnonzero(data == 10)
            feed = feeds[np.searchsorted(feeds, at[of])]
            out[of] = paired(hashes(data, at[of], feed), hashes(data, feed + 1, at[of + 1]))
        else:
            out[of] = mixed(out[of], seed)
    return out


def of_strings(strings: list[str]) -> np.ndarray:
    data, at = bytes_of(pa.array(strings, pa.string()))
    return hashes(data, at[:-1], at[1:])


def ragged(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def pieces(texts: pa.Array):
    """The texts in slices of about ``BATCH`` bytes; a longer text is one by itself."""
    _, at = bytes_of(texts)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(at, np.arange(BATCH, at[-1], BATCH)), [len(texts)]])).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield texts.slice(a, b - a)


class Texts:
    """The words of a batch of texts; ``where`` is the text that a word is in."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.data, self.at = bytes_of(texts)
        self.kind = classes(self.data)
        self.has_han = bool((self.kind & HAN).any())
        self.is_start, self.is_end, self.starts, self.ends = self.runs((self.kind & WORD) > 0)
        self.where = self.text_at(self.starts)
        self.hash = hashes(self.data, self.starts, self.ends)

    def text_at(self, places: np.ndarray) -> np.ndarray:
        """The texts of places, which come in order."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(np.searchsorted(places, self.at)))

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and last bytes of the runs of members, as marks and as places (the end is the place behind)."""
        inner = self.at[(self.at > 0) & (self.at < len(member))]
        before, behind = np.zeros_like(member), np.zeros_like(member)
        before[1:], behind[:-1] = member[:-1], member[1:]
        before[inner], behind[inner - 1] = False, False
        first, last = member & ~before, member & ~behind
        return first, last, np.flatnonzero(first), np.flatnonzero(last) + 1

    def neighbours(self, where: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of two words that follow each other, and the pair's hash."""
        first = np.flatnonzero(where[1:] == where[:-1])
        return first, paired(hash_[first], hash_[first + 1])

    def tokens(self, kinds: set[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the tokens of these kinds, see :func:`cloakframe.operators.term_join.token_arrays`."""
        where, hash_, found = self.where, self.hash, [(self.where[:0], self.hash[:0])]
        if self.has_han:  # a term may take the Han part of a run
            _, _, starts, ends = self.runs((self.kind & (WORD | HAN)) == WORD)
            where, hash_ = self.text_at(starts), hashes(self.data, starts, ends)
            if "word" in kinds:
                found.append((where, mixed(hash_, _SEED["word"])))
        if "word" in kinds:
            found.append((self.where, mixed(self.hash, _SEED["word"])))
        if "words" in kinds:
            first, pairs = self.neighbours(where, hash_)
            found.append((where[first], pairs))
        if kinds & {"pair", "single", "other"}:
            found += self._characters(kinds)
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _characters(self, kinds: set[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        _, _, han, word = patterns()
        held = {kind: ([], []) for kind in ("pair", "single", "other") if kind in kinds}
        for i, text in enumerate(self.texts.to_pylist()):
            has_han = text and self.has_han and han.search(text)
            for kind, (where, tokens) in held.items():
                if text and (kind == "other" or has_han):
                    own = {c for c in set(text) if not word.match(c)} if kind == "other" else set(han.findall(text)) if kind == "single" else {text[j : j + 2] for j in range(len(text) - 1)}
                    where += [i] * len(own)
                    tokens += own
        return [(np.array(where, np.int64), mixed(of_strings(tokens), _SEED[kind])) for kind, (where, tokens) in held.items() if tokens]


class Library:
    """Terms with their keys, one row a term, put in order of the terms."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows.column("term"))).combine_chunks().to_struct_array()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        kinds, keys = rows.field("kind"), rows.field("key")
        self.kinds = set(kinds.unique().to_pylist())
        self.rows = pa.StructArray.from_arrays([rows.field(f) for f in ("term", "id", "category", "key", "han")], ["term", "id", "category", "key", "han"])
        self.hash = key_hashes(kinds, keys)
        own = Texts(rows.field("term"))
        self.data, self.begin, self.size = own.data, own.at[:-1], np.diff(own.at)
        word = (own.kind & WORD) > 0
        of_words = np.isin(kinds.to_numpy(zero_copy_only=False), ["word", "words"])
        # what is swept in order: no whole words, or more than one line
        self.odd = ~of_words | ~word[self.begin] | ~word[self.begin + self.size - 1]
        self.odd[own.text_at(np.flatnonzero(own.data == 10))] = True
        self.place = np.zeros(len(rows), np.int64)  # of the key in its term
        first, pairs = own.neighbours(own.where, own.hash)
        for where, starts, hash_ in ((own.where, own.starts, mixed(own.hash, _SEED["word"])), (own.where[first], own.starts[first], pairs)):
            same = np.flatnonzero(hash_ == self.hash[where])
            term, at = np.unique(where[same], return_index=True)
            self.place[term] = starts[same[at]] - self.begin[term]
        self.order = np.argsort(self.hash, kind="stable")
        ordered = self.hash[self.order]
        self.first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        self.known, self.many = ordered[self.first], np.diff(np.append(self.first, len(ordered)))
        self.shift = np.uint64(64 - max(10, len(rows).bit_length() + 3))
        self.present = np.zeros(1 << (64 - int(self.shift)), bool)
        self.present[self.known >> self.shift] = True
        labels = [b"" if c is None else f"[{c}]".encode() for c in rows.field("category").to_pylist()]
        self.label_data = np.frombuffer(b"".join(labels), np.uint8)
        self.label_size = np.array([len(x) for x in labels], np.int64)
        self.label_at = np.cumsum(self.label_size) - self.label_size

    def find(self, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the tokens are keys, once for each of their terms, and the terms."""
        maybe = np.flatnonzero(self.present[hash_ >> self.shift])
        at = np.minimum(np.searchsorted(self.known, hash_[maybe]), len(self.known) - 1)
        same = self.known[at] == hash_[maybe]
        token, at = maybe[same], at[same]
        n = self.many[at]
        return np.repeat(token, n), self.order[np.repeat(self.first[at], n) + ragged(n)]

    def candidates(self, texts: Texts, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, term) whose key is in the text, in order; ``only`` is a mark for each text."""
        where, hash_ = texts.tokens(self.kinds)
        if only is not None:
            where, hash_ = where[only[where]], hash_[only[where]]
        token, term = self.find(hash_)
        both = np.unique(where[token] * len(self.rows) + term)
        return both // len(self.rows), both % len(self.rows)

    def lists(self, n_texts: int, where: np.ndarray, term: np.ndarray) -> pa.Array:
        """The terms of each text as an array; null where there are none."""
        at = np.searchsorted(where, np.arange(n_texts + 1))
        none = np.append(at[1:] == at[:-1], False)
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=none), self.rows.take(pa.array(term)))

    def attached(self, texts: pa.Array) -> pa.Array:
        return self.lists(len(texts), *self.candidates(Texts(texts)))

    def equal(self, data: np.ndarray, starts: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether the term stands at the place."""
        out = np.empty(len(term), bool)
        for a in range(0, len(term), HITS):
            t, s = term[a : a + HITS], starts[a : a + HITS]
            n = self.size[t]
            begin = np.cumsum(n) - n
            each = np.arange(n.sum())
            same = data[each + np.repeat(s - begin, n)] == self.data[each + np.repeat(self.begin[t] - begin, n)]
            out[a : a + HITS] = np.logical_and.reduceat(same, begin) if len(t) else True
        return out

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(place, term) of the terms of whole words, in order of places."""
        found = []
        if "word" in self.kinds:
            token, term = self.find(mixed(texts.hash, _SEED["word"]))
            found.append((token, term))
        if "words" in self.kinds:
            first, pairs = texts.neighbours(texts.where, texts.hash)
            token, term = self.find(pairs)
            found.append((first[token], term))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        token, term = map(np.concatenate, zip(*found, strict=True))
        start = texts.starts[token] - self.place[term]
        end, where = start + self.size[term], texts.where[token]
        good = np.flatnonzero(~self.odd[term] & (start >= texts.at[where]) & (end <= texts.at[where + 1]))
        good = good[texts.is_start[start[good]] & texts.is_end[end[good] - 1]]
        good = good[self.equal(texts.data, start[good], term[good])]
        good = good[np.argsort(start[good], kind="stable")]
        return start[good], term[good]

    def masked(self, texts: pa.Array) -> list[pa.Array]:
        """Masked texts, numbers of masked places, and the candidates of the texts that have to be swept in order, which have neither."""
        return [pa.concat_arrays(x) for x in zip(*map(self._masked, pieces(texts) if len(texts) else [texts]), strict=True)]

    def _masked(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        batch, none = Texts(texts), texts.is_null().to_numpy(zero_copy_only=False)
        slow = none.copy()
        slow[batch.text_at(np.flatnonzero(batch.data >= SENTINEL_LEAD))] = True
        if self.odd.any():
            where, term = self.candidates(batch, ~slow)
            odd = self.odd[term]
            for i, t in zip(where[odd].tolist(), term[odd].tolist(), strict=True):
                slow[i] = slow[i] or self.rows[t]["term"].as_py() in texts[i].as_py()
        start, term = self.hits(batch)
        kept = ~slow[batch.text_at(start)]
        start, term = start[kept], term[kept]
        kept = taken(start, start + self.size[term], term)
        start, term = start[kept], term[kept]
        text, at = self.written(batch, start, term)
        n = np.diff(np.searchsorted(start, batch.at))
        wide = pa.Array.from_buffers(pa.large_string(), len(texts), [pa.array(~slow).buffers()[1], pa.py_buffer(at), pa.py_buffer(text)])
        own = self.lists(len(texts), *self.candidates(batch, slow)) if (slow & ~none).any() else pa.nulls(len(texts), pa.list_(self.rows.type))
        return wide.cast(pa.string()), pa.array(n, mask=slow), own

    def written(self, batch: Texts, start: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts with labels in place of the terms, and where each text begins."""
        end, label = start + self.size[term], self.label_size[term]
        source, size = np.empty(2 * len(start) + 1, np.int64), np.empty(2 * len(start) + 1, np.int64)
        source[0], source[2::2], source[1::2] = 0, end, len(batch.data) + self.label_at[term]
        size[0:-1:2], size[-1], size[1::2] = start - source[0:-1:2], len(batch.data) - source[-1], label
        whole, out = np.concatenate([batch.data, self.label_data]), []
        large = np.flatnonzero(size > WRITTEN)  # copied as they are, the others by the place of each byte
        cuts = np.unique(np.concatenate([[0, len(size)], large, large + 1, np.searchsorted(np.cumsum(size), np.arange(WRITTEN, size.sum(), WRITTEN))]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n = size[a:b]
            at = source[a] if b - a == 1 else np.repeat(source[a:b] - (np.cumsum(n) - n), n)
            out.append(whole[at : at + n[0]] if b - a == 1 else whole[at + np.arange(len(at))])
        grown = np.concatenate([[0], np.cumsum(label - self.size[term])])
        return np.concatenate(out), batch.at + grown[np.searchsorted(start, batch.at)]


def taken(start: np.ndarray, end: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Marks the hits that stay if all are taken in order of terms and then of places and each that overlaps an earlier one is left; hits come in order of places.

    Where hits overlap their neighbours only, a hit stays if the walk from it to earlier and earlier neighbours has an even number of steps on either side.
    """
    n = len(start)
    if n < 2:
        return np.ones(n, bool)
    reach = np.maximum.accumulate(end)
    meets = start[1:] < reach[:-1]
    place = np.arange(n)
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[1:] = meets & (term[:-1] <= term[1:])
    right[:-1] = meets & (term[1:] < term[:-1])
    to_left = place - np.maximum.accumulate(np.where(left, 0, place))
    to_right = np.minimum.accumulate(np.where(right, n, place)[::-1])[::-1] - place
    out = (to_left % 2 == 0) & (to_right % 2 == 0)
    group = np.concatenate([[0], np.cumsum(~meets)])
    tangled = np.unique(group[2:][start[2:] < reach[:-2]])  # a hit overlaps another than its neighbours
    for lo, hi in zip(np.searchsorted(group, tangled).tolist(), np.searchsorted(group, tangled, "right").tolist(), strict=True):
        origin, used = int(start[lo]), bytearray(int(reach[hi - 1] - start[lo]))
        for i in sorted(range(lo, hi), key=lambda i: (term[i], start[i])):
            s, e = int(start[i]) - origin, int(end[i]) - origin
            out[i] = not any(used[s:e])
            if out[i]:
                used[s:e] = b"\1" * (e - s)
    return out


def sieve_of(bitmaps: dict[int, bytes]) -> bytes:
    """The bitmaps of all buckets as one, compressed."""
    bits = np.zeros((1 << (SIEVE_BITS - BUCKET_BITS), 1 << (BUCKET_BITS - 3)), np.uint8)
    for bucket, bitmap in bitmaps.items():
        bits[bucket] = np.frombuffer(bitmap, np.uint8)
    return pa.Codec("zstd").compress(bits, asbytes=True)


def partition_tokens(kinds: set[str], sieve: bytes):
    """For mapInArrow over (partition, text): the distinct (partition, hash) of the tokens that the sieve lets through."""

    def run(batches):
        bits = np.frombuffer(pa.Codec("zstd").decompress(sieve, 1 << (SIEVE_BITS - 3)), np.uint8)
        held, fresh = {}, {}
        for batch in batches:
            part, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            if (part == part[:1]).all():  # as Spark deals them
                texts = texts.unique()
            done = 0
            for some in pieces(texts):
                where, hash_ = Texts(some).tokens(kinds)
                bit = hash_ >> np.uint64(64 - SIEVE_BITS)
                through = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                where, hash_ = part[done + where[through]], hash_[through]
                done += len(some)
                for c in np.unique(where).tolist():
                    fresh.setdefault(c, []).append(np.unique(hash_[where == c]))
                    if sum(map(len, fresh[c])) > max(1 << 20, len(held.get(c, ()))):
                        held[c] = np.unique(np.concatenate([held.get(c, hash_[:0]), *fresh.pop(c)]))
        del bits
        pa.default_memory_pool().release_unused()
        for c in sorted({*held, *fresh}):
            found = np.unique(np.concatenate([held.get(c, np.zeros(0, np.uint64)), *fresh.get(c, ())])).view(np.int64)
            for a in range(0, len(found), 1 << 16):
                some = found[a : a + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(some), c, np.int32)), pa.array(some)], ["_terms_part", "_hash"])

    return run


ROWS = pa.schema([("term", pa.string()), ("id", pa.string()), ("category", pa.string()), ("key", pa.string()), ("han", pa.bool_()), ("kind", pa.string())])
PACKED = 1 << 17  # rows that are put into packs together


def packs(batches):
    """For mapInArrow over (partition, row of a library): (partition, many rows as compressed bytes); in rows of their own, terms would be several times as large."""
    codec, held, n = pa.Codec("zstd", compression_level=1), [], 0

    def packed(held):
        table = pa.Table.from_batches(held).combine_chunks()
        part = table.column("_terms_part").to_numpy()
        order = np.argsort(part, kind="stable")
        table, part = table.select(ROWS.names).cast(ROWS).take(pa.array(order)), part[order]
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ROWS) as out:
                out.write_table(table.slice(a, b - a))
            whole = sink.getvalue()
            pack = whole.size.to_bytes(8, "little") + codec.compress(whole, asbytes=True)
            yield pa.record_batch([pa.array([part[a]], pa.int32()), pa.array([pack], pa.binary())], ["_terms_part", "_terms_lib"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED:
            yield from packed(held)
            held, n = [], 0
    if n:
        yield from packed(held)
    pa.default_memory_pool().release_unused()


def unpacked(packs: list[bytes]) -> pa.Table:
    codec = pa.Codec("zstd")
    return pa.concat_tables(pa.ipc.open_stream(codec.decompress(p[8:], int.from_bytes(p[:8], "little"))).read_all() for p in packs)


def with_library(batches):
    """(library, texts, number of rows before them, other columns) of the batches of one partition, whose rows are first the packs of its library, then texts; the library is null if it has none."""
    held, library, begun = [], None, False
    for pack, text, *others in batches:
        n = len(pack) - pack.null_count
        if n and (begun or pack.slice(0, n).null_count):
            raise RuntimeError("rows of a library after texts")
        held += pack.slice(0, n).to_pylist()
        if n < len(pack) and not begun:
            library, begun = Library(unpacked(held)) if held else None, True
            held = []
            pa.default_memory_pool().release_unused()
        yield library, text.slice(n), n, *(x.slice(n) for x in others)
