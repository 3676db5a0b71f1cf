"""Token ids in compressed binary shards: Re-Pair grammars with random-access decoding.

Documents are range-partitioned and sorted by id, tokenised, given an end id, and cut
into shards of about ``shard_ids`` ids. Each shard is compressed by Re-Pair: frequent
pairs of neighbouring ids are replaced by new nonterminals, again and again, never
across the end of a document. A shard file holds

    magic ``TLRP``, version, counts, the base of the nonterminals,
    doc ids (int64), document starts in ids (int64) and in symbols (int64),
    the rules (left, right) (uint32) with their expansion lengths (uint32),
    the symbols (uint32), and a CRC of everything before it.

``decode_range`` reads any id range: expansion lengths find the symbols that cover it
and only those are expanded. Shard files are the binary column of a parquet table in
the shared folder, so Spark's commit protocol covers them and no executor needs a
path that only it can see; ``export`` writes them out as plain files.

Defined cases: a null text is an empty one (just the end id); null document ids sort
first and are kept as null; repeated rows are kept; an empty table gives no shards;
extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, stored, tidied

MAGIC = b"TLRP"
HEAD = struct.Struct("<4sIQQQQ")  # magic, version, documents, symbols, rules, first nonterminal
NO_ID = -(2**63)


# --- Re-Pair -----------------------------------------------------------------------------


def repair(ids: np.ndarray, ends: np.ndarray, min_count: int = 16, per_round: int = 4096, least: float = 1e-3):
    """Compress ``ids``; ``ends`` marks the last id of each document.

    Pairs of neighbours are counted exactly. The first round looks at all places, later ones only at
    those next to a symbol of the round before: no other pair is new, and old pairs only get rarer,
    so the places of frequent pairs are kept. A round takes the ``per_round`` most frequent pairs
    that occur ``min_count`` times or more and replaces their occurrences (of overlapping ones the
    more frequent pair wins; of one pair's, every second). Rounds go on until no pair is left or one
    replaces less than a share ``least`` of the symbols. Returns symbols, their end marks, rules
    (n x 2) and the first nonterminal's number.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    seq = ids.astype(np.int64)
    seq[ends] |= END
    seq[-1:] |= END
    rules: list[np.ndarray] = []
    n_rules, pairs, look = 0, np.zeros(0, np.int64), np.flatnonzero(seq < END)
    spot = what = np.zeros(0, np.int64)  # places of frequent pairs, at their left symbols, and the pairs' numbers
    while len(seq) > 1:
        found, place, number = _frequent(seq[look] << 32 | seq[look + 1] & END - 1, min_count)
        place, number, pairs = look[place], number + len(pairs), np.concatenate([pairs, found])
        if len(spot):
            row = np.sort(np.concatenate([spot << 32 | what, place << 32 | number]))
            spot, what = row >> 32, row & 0xFFFFFFFF
        else:
            spot, what = place, number
        counts = np.bincount(what, minlength=len(pairs))
        chosen = np.flatnonzero(counts >= min_count)
        if not len(chosen):
            break
        rank = np.full(len(pairs), GONE, np.int64)
        rank[chosen] = NO_RANK
        chosen = chosen[np.lexsort((pairs[chosen], -counts[chosen]))[:per_round]]
        rank[chosen] = np.arange(len(chosen))
        ranks = rank[what]
        won = _winners(spot, ranks)
        take, of = spot[won], ranks[won]
        used = np.bincount(of, minlength=len(chosen)) > 0
        made = pairs[chosen[used]]
        rules.append(np.stack([made >> 32, made & 0xFFFFFFFF], axis=1))
        seq[take] = (base + n_rules + (np.cumsum(used) - 1))[of] | seq[take + 1] & END
        n_rules += len(made)
        kept = np.ones(len(seq), bool)
        kept[take + 1] = False
        seq = seq[np.flatnonzero(kept)]
        if len(take) < least * len(seq):
            break
        fresh = take - np.arange(len(take))
        near = np.zeros(len(seq), bool)
        near[fresh] = near[fresh[fresh > 0] - 1] = True
        look = np.flatnonzero(near & (seq < END))
        kept[take] = kept[take[take > 0] - 1] = False  # pairs that held a replaced symbol
        stay = np.flatnonzero((ranks < GONE) & kept[spot])
        spot, what = spot[stay], what[stay]
        spot = spot - np.searchsorted(take, spot)
    last = seq >= END
    return seq & END - 1, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), base


END = 1 << 32  # marks the last symbol of a document
NO_RANK, GONE = 1 << 30, 1 << 31


def _frequent(key: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that occur ``min_count`` times or more, all their places, and which of them is at each."""
    row = np.sort(key)
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
    found = row[begin[np.diff(begin, append=len(row)) >= min_count]]
    if not len(found):
        return found, np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, part, at, turn = np.arange(len(found)), key, None, 0
    while len(left):  # a small hash table; keys that lose their slot take another turn
        bits, factor = max(10, (4 * len(left)).bit_length()), np.uint64(0x9E3779B97F4A7C15 + 0x1000003D2 * turn)
        slot = lambda x: (x.view(np.uint64) * factor >> np.uint64(64 - bits)).view(np.int64)
        table, mine = np.full(1 << bits, len(found)), slot(found[left])
        table[mine] = left
        got = table[slot(part)]
        same = np.append(found, -1)[got] == part
        if turn:
            number[at], known[at] = got, same
        else:
            number, known = got, same
        left = left[table[mine] != left]
        if len(left):
            some = np.flatnonzero(~same & (got < len(found)))
            part, at, turn = part[some], some if at is None else at[some], turn + 1
    places = np.flatnonzero(known)
    return found, places, number[places]


def _winners(spot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at ascending places to replace, so that no two of them overlap."""
    won = rank < NO_RANK
    overlap = spot[1:] == spot[:-1] + 1
    first = rank[:-1] <= rank[1:]
    second = np.append(overlap & ~first, False)  # gives way to the next
    won &= ~second
    won[1:] &= ~(overlap & first)
    again = np.flatnonzero(overlap & (rank[1:] == rank[:-1]) & (rank[1:] < NO_RANK)) + 1  # of one pair, as in a run of one symbol
    if len(again):
        opens = np.diff(again, prepend=-1) != 1
        even = again[(again - again[opens][np.cumsum(opens) - 1]) % 2 == 1]
        won[even] = ~second[even]
    return np.flatnonzero(won)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(len(rules), np.int64)
    length = lambda x: np.where(x < base, 1, out[np.maximum(x - base, 0)])
    done = 0
    while done < len(rules):  # a rule refers to earlier rounds' rules only, so whole stretches go at once
        stop = done + 1
        deepest = rules[done:].max(axis=1) - base
        ready = np.flatnonzero(deepest >= done)
        stop = done + (int(ready[0]) if len(ready) else len(deepest))
        stop = max(stop, done + 1)
        out[done:stop] = length(rules[done:stop, 0]) + length(rules[done:stop, 1])
        done = stop
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """Replace nonterminals by the ids they stand for: every rule is expanded once, then copied."""
    big = symbols >= base
    if not len(rules) or not big.any():
        return symbols.astype(np.uint32)
    lengths = expansion_lengths(rules, base) if lengths is None else lengths.astype(np.int64)
    flat = np.arange(base, base + len(rules))
    while (open_ := flat >= base).any():  # a pass per level of the grammar, over the rules only
        out = np.empty(len(flat) + int(open_.sum()), np.int64)
        at = np.arange(len(flat)) + np.cumsum(open_) - open_
        rule = rules[flat[open_] - base]
        out[at[~open_]] = flat[~open_]
        out[at[open_]] = rule[:, 0]
        out[at[open_] + 1] = rule[:, 1]
        flat = out
    # one gather: an id stands for itself, behind the rules' expansions
    number = symbols[big].astype(np.int64) - base
    size = np.ones(len(symbols), np.int64)
    size[big] = lengths[number]
    begin = np.cumsum(size) - size
    total = int(begin[-1] + size[-1])
    source = np.concatenate([flat, symbols[~big].astype(np.int64)]).astype(np.uint32)
    place = np.empty(len(symbols), np.int64)
    place[big] = (np.cumsum(lengths) - lengths)[number]
    place[~big] = len(flat) + np.arange(len(symbols) - len(number))
    small = np.int32 if max(total, len(source)) < 1 << 31 else np.int64
    return source[np.arange(total, dtype=small) + np.repeat((place - begin).astype(small), size)]


# --- one shard file ----------------------------------------------------------------------


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a shard: ``lengths`` counts each document's ids, its end id included."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    ends = np.zeros(len(ids), bool)
    ends[starts[1:] - 1] = True
    symbols, last, rules, base = repair(ids, ends)
    at = np.concatenate([[0], np.flatnonzero(last) + 1]).astype("<i8")
    body = b"".join(
        (
            HEAD.pack(MAGIC, 1, len(doc_ids), len(symbols), len(rules), base),
            np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(),
            starts.tobytes(),
            at.tobytes(),
            rules.astype("<u4").tobytes(),
            expansion_lengths(rules, base).astype("<u4").tobytes(),
            symbols.astype("<u4").tobytes(),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """Reader of one shard file's bytes."""

    def __init__(self, blob: bytes):
        if zlib.crc32(memoryview(blob)[:-4]) != struct.unpack("<I", blob[-4:])[0]:
            raise ValueError("shard file is damaged")
        magic, version, docs, symbols, rules, self.base = HEAD.unpack_from(blob)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard file")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids = take("<i8", docs)
        self.starts = take("<i8", docs + 1)
        self.symbol_starts = take("<i8", docs + 1)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", rules)
        self.symbols = take("<u4", symbols)

    def decode_all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.base, self.lengths)

    def decode_document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.symbol_starts[k] : self.symbol_starts[k + 1]], self.rules, self.base, self.lengths)

    def decode_range(self, first: int, stop: int) -> np.ndarray:
        """Ids ``first`` to ``stop`` of the shard; expands only the symbols that cover them."""
        first, stop = max(0, first), min(stop, int(self.starts[-1]))
        if stop <= first:
            return np.zeros(0, np.int64)
        d = int(np.searchsorted(self.starts, first, "right")) - 1
        e = int(np.searchsorted(self.starts, stop, "left"))
        part = self.symbols[self.symbol_starts[d] : self.symbol_starts[e]].astype(np.int64)
        big = part >= self.base
        size = np.ones(len(part), np.int64)
        size[big] = self.lengths[part[big] - self.base]
        stops = int(self.starts[d]) + np.cumsum(size)
        i, j = int(np.searchsorted(stops, first, "right")), int(np.searchsorted(stops, stop, "left")) + 1
        out = expand(part[i:j], self.rules, self.base, self.lengths)
        begin = int(stops[i] - size[i])
        return out[first - begin : stop - begin]


# --- tokenising --------------------------------------------------------------------------


OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
_CUT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two word hashes


def character_classes() -> np.ndarray:
    """Class of each code point by the published pattern and this installation's Unicode tables. The tokenizer asks
    the library, whose tables may be of another version; this is the tests' reference for the pattern."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *[0x20] * 0x800, *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = OTHER
    return out


def word_starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser's words begin, for texts in a row; ``first`` are the texts' first places.

    Its pattern, alternative by alternative: contractions; runs of letters, of numbers or of
    other marks, each with one space before it; white space up to the last one before a word;
    a last one that isn't a space stands alone.
    """
    n = len(points)
    begins = np.zeros(n + 1, bool)
    begins[first] = begins[n] = True
    run = begins.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    space = kind == SPACE
    word = np.flatnonzero(run[:n] & ~space & ~begins[:n])  # runs with something before them in the text
    before = word[space[word - 1]] - 1  # the last white space of each run that a word follows
    start[before] = True
    start[before[points[before] == 0x20] + 1] = False
    mark = np.flatnonzero((points == 0x27) & start)
    mark = mark[run[mark + 1] & ~begins[mark + 1]]
    if len(mark):
        ended = np.append(points, 0)
        ended = np.append(ended, 0)
        a, b = ended[mark + 1], ended[mark + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~begins[np.minimum(mark + 2, n)] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for size, at in ((1, mark[one]), (2, mark[two])):
            start[at + 1] = False
            rest = at + 1 + size
            rest = rest[rest < n]
            start[rest[~run[rest]]] = True  # what is left of the run of letters
    return np.flatnonzero(start)


def imitated(spec: dict) -> bool:
    """Does a tokenizer file ask for just what the word cutting here does: no normaliser, the byte-level
    pattern without a space put in front, and merges inside words without marks or chance?"""
    words, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        spec.get("normalizer") is None
        and words.get("type") == "ByteLevel"
        and words.get("add_prefix_space") is False
        and words.get("use_regex", True) is True
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or ())
        and spec.get("truncation") is None
    )


def byte_letters() -> np.ndarray:
    """The byte-level alphabet: the code point that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, np.uint32)
    out[plain] = plain
    out[np.setdiff1d(np.arange(256), plain)] = 256 + np.arange(256 - len(plain))
    return out


class WordCachedTokenizer:
    """Ids of whole texts through the tokenizers library, each distinct word encoded once.

    The library splits a text into words by the vocabulary's published pattern and
    merges inside words only, so a text's ids are its words' ids in a row. Words are cut
    and hashed for a whole batch at once; a table finds the ids of known ones, unknown
    ones go to the library's model and are remembered. The library is asked once for the
    class of each character that occurs. Two 64-bit hashes tell words apart and give each
    two places in the table; words too long for the hashes' powers go to the model each
    time; texts with an added token's string go to the library whole, and so do all texts
    of a file that isn't ``imitated``.
    """

    LIMIT = 1_200_000  # words kept; bounds a worker's memory to some 100 MB
    LONGEST = 128
    STRETCH = 1 << 17
    BITS = 22

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = not imitated(json.loads(self.tokenizer.to_str()))
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.letters = byte_letters()
        self.letters[0xFF] = 0x0A  # no byte of UTF-8: it stands between words
        series = lambda c: np.multiply.accumulate(np.full(self.STRETCH + self.LONGEST, c, np.uint64))
        with np.errstate(over="ignore"):
            self.powers = [(series(c), series(pow(c, -1, 1 << 64))) for c in _CUT]  # and of their inverses
        self.forget()

    def forget(self) -> None:
        self.slot = np.full(1 << self.BITS, -1, np.int32)
        self.one, self.two = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.ids = np.zeros(1 << 17, np.int32)
        self.stop = np.zeros(1 << 16, np.int64)  # where each word's ids stop, after a leading 0
        self.words = 0

    def _room(self, name: str, size: int) -> None:
        a = getattr(self, name)
        if size > len(a):
            setattr(self, name, np.concatenate([a, np.zeros(max(len(a), size - len(a)), a.dtype)]))

    def _classify(self, points: np.ndarray) -> None:
        """Ask the library how it cuts "a", the character twice and "!"."""
        for c in np.unique(points).tolist():
            stops = [stop for _, (_, stop) in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}{chr(c)}!")]
            self.classes[c] = LETTER if stops[0] == 3 else {2: SPACE, 3: NUMBER, 4: OTHER}[stops[1]]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, in a row, and how many. Words are cut already, so they need the model alone."""
        raw = np.frombuffer("\udcff".join(words).encode("utf-8", "surrogateescape"), np.uint8)
        model = self.tokenizer.model
        got = [[t.id for t in model.tokenize(w)] for w in self.letters[raw].tobytes().decode("utf-32-le").split("\n")]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(sizes.sum())), sizes

    def _learn(self, words: list[str], one: np.ndarray, two: np.ndarray) -> None:
        ids, sizes = self._encoded(words)
        n, total = self.words, int(self.stop[self.words])
        for name in ("one", "two"):
            self._room(name, n + len(words))
        self._room("stop", n + len(words) + 1)
        self._room("ids", total + len(ids))
        self.one[n : n + len(words)], self.two[n : n + len(words)] = one, two
        self.ids[total : total + len(ids)] = ids
        self.stop[n + 1 : n + len(words) + 1] = total + np.cumsum(sizes)
        number, place = np.arange(n, n + len(words), dtype=np.int32), self._place(one)
        free = self.slot[place] < 0
        self.slot[np.where(free, place, self._place(two))] = number
        self.words = n + len(words)

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.BITS)).view(np.int64)

    def _numbers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Number of each known word, -1 for others."""
        at = self.slot[self._place(one)]
        out = np.where((at >= 0) & (self.one[at] == one) & (self.two[at] == two), at, -1)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            one, two = one[miss], two[miss]
            at = self.slot[self._place(two)]
            out[miss] = np.where((at >= 0) & (self.one[at] == one) & (self.two[at] == two), at, -1)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each text has."""
        if self.plain:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)
        joined = "".join(texts)
        some = any(a in joined for a in self.added)  # a match across two texts only costs a second look
        whole = {k: self.tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if any(a in t for a in self.added)} if some else {}
        plain = [t for k, t in enumerate(texts) if k not in whole]
        ids, n = self._encode_plain(plain)
        if not whole:
            return ids, n
        parts, counts, at = [], [], 0
        ends = np.concatenate([[0], np.cumsum(n)])
        for k in range(len(texts)):
            if k in whole:
                part = np.array(whole[k], np.int32)
            else:
                part = ids[ends[at] : ends[at + 1]]
                at += 1
            parts.append(part)
            counts.append(len(part))
        return np.concatenate(parts), np.array(counts, np.int64)

    def _sums(self, wide: np.ndarray, begin: np.ndarray, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """Polynomial of each word's characters: a difference of running sums, moved back to its first
        place; a stretch of characters at a time. Words that are too long get no use of theirs."""
        out, k = np.empty(len(begin), np.uint64), 0
        while k < len(begin):
            e = int(np.searchsorted(begin, begin[k] + self.STRETCH))
            stop = min(begin[e] if e < len(begin) else len(wide), begin[k] + self.STRETCH + self.LONGEST)
            part, at = wide[begin[k] : stop], begin[k:e] - begin[k]
            upto = np.cumsum(part * powers[: len(part)])
            ends = np.append(upto[at[1:] - 1], upto[-1])
            ends[1:] -= ends[:-1].copy()
            out[k:e] = ends * inverse[at]
            k = e
        return out

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        size = np.array([len(t) for t in texts], np.int64)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if self.words > self.LIMIT:
            self.forget()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = (np.cumsum(size) - size)[size > 0]
        kind = self.classes[points]
        unknown = kind == UNKNOWN
        if unknown.any():
            self._classify(points[unknown])
            kind = self.classes[points]
        begin = word_starts(points, kind, first)
        length = np.diff(np.append(begin, len(points)))
        long = length > self.LONGEST
        with np.errstate(over="ignore"):
            wide = points.astype(np.uint64) + np.uint64(1)
            one, two = (_spread(self._sums(wide, begin, *p), length) for p in self.powers)
        number = self._numbers(one, two)
        number[long] = -1
        missing = np.flatnonzero((number < 0) & ~long)
        if len(missing):
            new, at = np.unique(one[missing], return_index=True)
            at = missing[at]
            self._learn([joined[i : i + n] for i, n in zip(begin[at].tolist(), length[at].tolist())], new, two[at])
            number[missing] = self._numbers(one[missing], two[missing])
        odd = np.flatnonzero(number < 0)  # long words, and words whose place in the table another one took
        start, count = self.stop[number], self.stop[number + 1] - self.stop[number]
        if len(odd):
            extra, sizes = self._encoded([joined[i : i + n] for i, n in zip(begin[odd].tolist(), length[odd].tolist())])
            base = int(self.stop[self.words])
            self._room("ids", base + len(extra))
            self.ids[base : base + len(extra)] = extra  # beyond the known words' ids; the next one learnt overwrites it
            start[odd], count[odd] = base + np.cumsum(sizes) - sizes, sizes
        ids = self.ids[_runs(start, count)]
        n = np.zeros(len(texts), np.int64)
        n[size > 0] = np.add.reduceat(count, np.searchsorted(begin, first))  # every text begins with a word
        return ids, n


_SHARED: dict[str, WordCachedTokenizer] = {}


def shared_tokenizer(path: str) -> WordCachedTokenizer:
    """A worker's tokenizer, with the words that its earlier tasks have met."""
    if path not in _SHARED:
        _SHARED[path] = WordCachedTokenizer(path)
    return _SHARED[path]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then the same for the next."""
    stop = np.cumsum(size)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - size), size)


def _spread(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    x = x ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


# --- the corpus --------------------------------------------------------------------------


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and write all documents; the table of shard files:
    part, seq (order within part), before (ids before it in its part), n_ids, blob. Rows follow ascending ids over (part, seq)."""
    spark = docs.sparkSession
    small_batches(spark)

    def build(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = shared_tokenizer(tokenizer_path)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = before = 0

        def flush():
            nonlocal seq, held, size, before
            doc_ids = [d for h in held for d in h[0]]
            lengths, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            blob = pack(doc_ids, lengths, ids)
            out = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "before": [before], "n_ids": [len(ids)], "blob": pa.array([blob], pa.binary())})
            seq, held, size, before = seq + 1, [], 0, before + len(ids)
            return out

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                cut = batch.slice(k, 256)
                ids, n = encoder.encode([t or "" for t in cut.column(1).to_pylist()])
                ended = np.full(len(ids) + len(n), end_id, np.int32)
                stop = np.cumsum(n + 1)
                keep = np.ones(len(ended), bool)
                keep[stop - 1] = False
                ended[keep] = ids
                held.append((cut.column(0).to_pylist(), n + 1, ended))
                size += len(ended)
                if size >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "_place")
        .sortWithinPartitions("doc_id", "_place")
        .drop("_place")
    )
    return stored(ordered.mapInArrow(tidied(build), "part long, seq long, before long, n_ids long, blob binary"), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = shards.sparkSession
    small_batches(spark)
    # one row per part, of which there are as many as tasks, on the driver
    total, offsets = 0, []
    for r in sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        offsets.append((r["part"], total))
        total += r["n"]
    place = spark.createDataFrame(offsets or [(0, 0)], "part long, part_offset long")

    def decode(batches):
        for batch in batches:
            for first, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(blob.as_py())
                raw = shard.decode_all().astype("<u4").tobytes()
                at = (shard.starts * 4).tolist()
                view = memoryview(raw)
                crc = [zlib.crc32(view[i:j]) for i, j in zip(at, at[1:])]
                ids = pa.array([None if d == NO_ID else d for d in shard.doc_ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(shard.starts[:-1] + first), pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    joined = shards.select("part", "before", "blob").join(F.broadcast(place), "part").withColumn("first", F.col("before") + F.col("part_offset"))
    return joined.select("first", "blob").mapInArrow(tidied(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard as ``folder/part-seq.tlrp`` on a file system that executors mount."""

    def write(batches):
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                name = f"{folder}/{row['part']:06d}-{row['seq']:06d}.tlrp"
                with open(f"{name}.tmp", "wb") as f:
                    f.write(row["blob"])
                os.replace(f"{name}.tmp", name)  # a task that runs twice leaves one whole file
                names.append(name)
            yield pa.RecordBatch.from_pydict({"file": names})

    return shards.select("part", "seq", "blob").mapInArrow(write, "file string")
