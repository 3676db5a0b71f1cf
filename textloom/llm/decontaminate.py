"""Benchmark decontamination with an FM-index per shard of the training texts.

Training documents are read a shard at a time; nothing is shuffled. Words become
symbols: the benchmark's words have numbers; a run of any other words, or a document's
end, is symbol 1, which no phrase holds. The shard's suffixes are sorted, its
Burrows-Wheeler transform is kept in a wavelet matrix, and every phrase (a window of
consecutive benchmark words) is searched backwards, last word first: each step narrows
a suffix range by two ranks per level of the matrix. Occurrences are located by
stepping back (LF) from each row of the range to a sampled suffix position. Their word
spans are merged per document.

Texts: A-Z lower-cased, words are runs of bytes 0-9, a-z and 0x80 up (in a pattern,
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``). Words of one 64-bit hash are one
symbol; the words of every located occurrence are then compared as text, so that a shared
hash costs time and no result.

Defined cases: null or wordless texts have no words and no hits; items of fewer words
than a window are one window; wordless items match nothing; rows that repeat an item id
count as one item, null ids as one item written as an empty string; an empty benchmark
hits nothing; repeated documents each get their row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, stored, tidied

#: A benchmark larger than this many bytes of text is searched in parts of about half of that, a pass each.
PHRASE_BYTES = 4 << 20
#: Bytes of text in one index.
SHARD_BYTES = 2 << 20
SAMPLE = 8

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_FOLD = bytes(range(256)).lower()


# --- words -------------------------------------------------------------------------------


_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_POWERS = _powers(256)


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each word in ``raw`` (already lower-cased), and a hash of each."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], _IS_WORD[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return start, stop, np.zeros(0, np.uint64)
    size = stop - start
    with np.errstate(over="ignore"):
        letters = data[inside[1:-1]].astype(np.uint64) + np.uint64(1)
        first = np.cumsum(size) - size
        place = np.arange(len(letters)) - np.repeat(first, size)
        longest = int(size.max())
        powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
        x = np.add.reduceat(letters * powers[place], first)
        x ^= size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return start, stop, x ^ (x >> np.uint64(32))


class Phrases:
    """The windows of all benchmark items as rows of symbols (0 ends the shard, 1 is any other word).

    A symbol is a hash: words that share one share a symbol, and occurrences are told apart by spelling."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raws = [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for _, t in items]
        found = [words_of(r) for r in raws]
        spelled = [[r[i:j] for i, j in zip(f[0].tolist(), f[1].tolist())] for r, f in zip(raws, found)]
        hashed = {w: h for ws, f in zip(spelled, found) for w, h in zip(ws, f[2].tolist())}
        self.hashes = np.unique(np.fromiter(hashed.values(), np.uint64, len(hashed)))
        symbol = {h: k + 2 for k, h in enumerate(self.hashes.tolist())}
        self.alphabet = len(self.hashes) + 2
        of: dict[tuple[bytes, ...], set[str]] = {}
        for (item, _), ws in zip(items, spelled):
            for k in range(max(1, len(ws) - window + 1) if ws else 0):
                of.setdefault(tuple(ws[k : k + window]), set()).add(item)
        self.rows = sorted(of, key=lambda p: (len(p), p))
        self.items = [sorted(of[p]) for p in self.rows]
        self.sizes = np.array([len(p) for p in self.rows], np.int64)
        self.longest = int(self.sizes.max()) if len(self.sizes) else 0
        self.table = np.zeros((len(self.rows), self.longest), np.int32)
        for k, p in enumerate(self.rows):
            self.table[k, self.longest - len(p) :] = [symbol[hashed[w]] for w in p]  # right-aligned: the search goes backwards

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 2, 1).astype(np.int32)


# --- the index ---------------------------------------------------------------------------


class WaveletMatrix:
    """Rank of any symbol in any prefix: one bit vector with running counts per bit of the alphabet."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        seq = seq.astype(np.int32)
        for k in reversed(range(self.levels)):
            bit = (seq >> k & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][word] + np.bitwise_count(self.bits[level][word] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before place ``at``."""
        low = np.zeros_like(at)
        for level in range(self.levels):
            bit = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            o_at, o_low = self._ones(level, at), self._ones(level, low)
            at, low = np.where(bit, self.zeros[level] + o_at, at - o_at), np.where(bit, self.zeros[level] + o_low, low - o_low)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            bit = (self.bits[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, at)
            at = np.where(bit > 0, self.zeros[level] + ones, at - ones)
            out = out << 1 | bit
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling; only those still tied are sorted again.

    The last symbol must be smaller than all others, so that no suffix ties to the end.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    sorted_ = seq[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # place of the first equal suffix
    step = 1
    at = np.arange(n)
    while True:
        tied = ~new[at] | np.concatenate([~new[at][1:], [False]])
        at = at[tied]
        if not len(at):
            return order
        who = order[at]
        key = (rank[who] << 32) + rank[np.minimum(who + step, n - 1)]
        again = np.argsort(key, kind="stable")
        who, key = who[again], key[again]
        order[at] = who
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[at] = fresh
        rank[who] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        step *= 2


class FMIndex:
    """Backward search and location of phrases in a sequence of symbols that ends in its only 0."""

    def __init__(self, seq: np.ndarray, alphabet: int, sample: int = SAMPLE):
        self.n = len(seq)
        order = suffix_order(seq)
        self.bwt = WaveletMatrix(seq[order - 1], alphabet)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=alphabet))])
        self.sampled = order % sample == 0
        self.rank_of_sampled = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled].astype(np.int64)

    def ranges(self, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each (right-aligned) phrase."""
        low, high = np.zeros(len(table), np.int64), np.full(len(table), self.n, np.int64)
        for k in range(table.shape[1]):
            live = np.flatnonzero((sizes > k) & (low < high))
            if not len(live):
                break
            s = table[live, table.shape[1] - 1 - k].astype(np.int64)
            both = self.bwt.rank(np.concatenate([s, s]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.less[s] + both[: len(live)], self.less[s] + both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back to a sampled row, plus the steps made."""
        out, rows, who, steps = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(who):
            at = self.sampled[rows]
            out[who[at]] = self.positions[self.rank_of_sampled[rows[at]]] + steps
            who, rows, steps = who[~at], rows[~at], steps + 1
            symbol = self.bwt.access(rows)
            rows = self.less[symbol] + self.bwt.rank(symbol, rows)
        return out


def search_shard(texts: list[str | None], phrases: Phrases):
    """Per text: number of words, merged word spans of all occurrences, items that occur;
    and the start and stop byte of each word of the whole shard with each text's first word."""
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts]
    joined = b" ".join(raws)
    start, stop, hashes = words_of(joined)
    bound = np.cumsum([len(r) + 1 for r in raws])
    n_words = np.diff(np.concatenate([[0], np.searchsorted(start, bound)]))
    first = np.cumsum(n_words) - n_words
    spans, items = [[] for _ in texts], [set() for _ in texts]
    if len(start) and len(phrases.rows):
        place = np.arange(len(start)) + np.repeat(np.arange(len(texts)), n_words)  # a 1 after each document
        seq = np.ones(len(start) + len(texts) + 1, np.int32)
        seq[place] = phrases.symbols(hashes)
        seq[-1] = 0
        keep = np.concatenate([[True], (seq[1:] != 1) | (seq[:-1] != 1)])
        origin = np.flatnonzero(keep)
        index = FMIndex(seq[keep], phrases.alphabet)
        low, high = index.ranges(phrases.table, phrases.sizes)
        found = np.flatnonzero(high > low)
        count = high[found] - low[found]
        rows = np.repeat(low[found] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        number = np.zeros(len(seq), np.int64)
        number[place] = np.arange(len(start))
        word = number[origin[index.locate(rows)]]
        doc = np.searchsorted(first + n_words, word, "right")
        for k, w, d in zip(np.repeat(found, count).tolist(), word.tolist(), doc.tolist()):
            e = w + int(phrases.sizes[k])
            if [joined[i:j] for i, j in zip(start[w:e].tolist(), stop[w:e].tolist())] == list(phrases.rows[k]):
                spans[d].append((w - int(first[d]), e - int(first[d])))
                items[d].update(phrases.items[k])
    return n_words, [merge(x) for x in spans], items, (start, stop, first)


def merge(spans) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of ``spans`` (word numbers) and what stands between them."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    start, stop, _ = words_of(raw.translate(_FOLD))
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : start[a]])
        at = int(stop[b - 1])
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


# --- the corpus --------------------------------------------------------------------------


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """(item, text): long items cut into overlapping pieces that have the same windows."""
    most = PHRASE_BYTES // 8

    def run(batches):
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw, at = text.encode("utf-8", "surrogatepass"), 0
                start, stop, _ = words_of(raw.translate(_FOLD)) if len(raw) > most else ([], [], None)
                pieces = [] if len(start) > window else [text]
                while at + window <= len(start) and not (pieces and at + window - 1 == len(start)):
                    end = max(at + window, int(np.searchsorted(stop, start[at] + most, "right")))
                    pieces.append(raw[start[at] : stop[end - 1]].decode("utf-8", "surrogatepass"))
                    at = end - window + 1
                for piece in pieces:
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item], pa.string()), "text": pa.array([piece], pa.string())})

    return items.mapInArrow(run, "item string, text string")


def _parts(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list[DataFrame]:
    """The benchmark in parts of bounded size; a large one is cut into pieces, dealt by their hashes."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= PHRASE_BYTES:
        return [items]
    n = -(-2 * size // PHRASE_BYTES)
    pieces = stored(_pieces(items, window), "decontaminate-pieces")
    return [pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def _pass(docs: DataFrame, items: list[tuple[str, str]], window: int, cut: bool = False) -> DataFrame:
    """Search one part of the benchmark; ``docs`` has the spans and items of earlier parts.
    With ``cut`` the texts come back without all spans."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(items)  # PHRASE_BYTES of text at most
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches):
        phrases = Phrases(shared.value, window)
        held, size = [], 0

        def flush():
            n_words, spans, found, _ = search_shard([r["text"] for r in held], phrases)
            spans = [merge([*s, *((x["a"], x["b"]) for x in r["spans"])]) for r, s in zip(held, spans)]
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([r["doc_id"] for r in held], pa.int64()),
                    "text": pa.array([remove(r["text"], s) if cut else r["text"] for r, s in zip(held, spans)], pa.string()),
                    "n_words": pa.array(n_words, pa.int64()),
                    "spans": pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], spans_type),
                    "items": pa.array([sorted(f.union(r["items"])) for r, f in zip(held, found)], pa.list_(pa.string())),
                    "rest": pa.array([r["rest"] for r in held], rest_type),
                }
            )

        for batch in batches:
            rest_type = batch.schema.field("rest").type
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["text"] or "")
                if size >= SHARD_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(tidied(run), docs.schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = (), cut: bool = False) -> DataFrame:
    """Per document: doc_id, text, n_words, spans (merged, in words), items (sorted ids), and
    the columns named in ``carry`` as a struct ``rest``."""
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
        F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("rest"),
    )
    parts = _parts(benchmark, item_col, item_text_col, window)
    for k, part in enumerate(parts):
        items = [(r["item"], r["text"]) for r in part.collect()]
        found = _pass(found, items, window, cut and k + 1 == len(parts))
        if k + 1 < len(parts):
            found = stored(found, "decontaminate")
    return found


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` (same columns) without the benchmark's passages: hit spans are cut out of the
    texts, and a document of which no word is left goes. Other documents stay as they are."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = scan(docs, benchmark, window, carry=others, cut=True)
    kept = found.where((F.size("spans") == 0) | (n_hit() < F.col("n_words")))
    return kept.select(*[F.col("rest")[c].alias(c) if c in others else F.col(c) for c in docs.columns])


def report(found: DataFrame) -> DataFrame:
    """Columns n_items, items_sha256 and contaminated in place of the item list."""
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
