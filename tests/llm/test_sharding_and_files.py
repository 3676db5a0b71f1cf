"""Sharding and token files against direct definitions."""

import zlib

import numpy as np
import pytest

from textloom.llm import sharding, token_files

TOKENS = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, extra int"


def docs(spark, data):
    return spark.createDataFrame(data, DOCS)


def hand(n):
    return [(i, f"text {i % 7} " * (i % 5), i) for i in range(n)] + [(3, "text 3 " * 3, 0), (None, "no id", 1), (50, None, 2), (51, "", 3), (52, "long " * 30_000, 4), (53, "über 🙂 <|endoftext|> x", 5)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, key=7)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.locate(p, n, key=7) == np.arange(n)).all()


def test_keys_differ():
    a, b = sharding.permute(np.arange(1000), 1000, 1), sharding.permute(np.arange(1000), 1000, 2)
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15


def test_assign(spark):
    data = hand(40)
    got = sharding.assign(docs(spark, data), shards=8).collect()
    assert len(got) == len(data)
    assert sorted(r.place for r in got) == list(range(len(data)))
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    counts = np.bincount([r.shard for r in got], minlength=8)
    assert counts.max() - counts.min() <= 1
    for r in got:
        text = next(t for i, t, _ in data if i == r.doc_id)
        raw = (text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    order = sorted(got, key=lambda r: r.row_number_global)
    ids = [r.doc_id for r in order]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_assign_is_reproducible(spark):
    data = hand(30)
    one = sharding.assign(docs(spark, data), shards=5)
    two = sharding.assign(docs(spark, data[::-1]).repartition(7), shards=5)
    key = lambda d: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in d.collect())
    assert key(one) == key(two)


def test_assign_empty(spark):
    assert sharding.assign(docs(spark, [])).collect() == []


# --- Re-Pair ------------------------------------------------------------------------------


def test_places_equal_brute_force(spark):
    """The network and the cycle walk in plain integers, a row at a time."""
    full = (1 << 64) - 1

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ x >> shift) * factor) & full
        return x ^ x >> 31

    def place(row, n, key):
        a = 1
        while a * a < n:
            a += 1
        b = -(-n // a)
        keys = [mix((r * 0x9E3779B97F4A7C15 + key) & full) for r in range(1, sharding.ROUNDS + 1)]
        while True:
            left, right = divmod(row, b)
            for r, k in enumerate(keys):
                if r % 2 == 0:
                    left = (left + mix((right + k) & full) % a) % a
                else:
                    right = (right + mix((left + k) & full) % b) % b
            row = left * b + right
            if row < n:
                return row

    rng = np.random.default_rng(3)
    data = [(int(i), f"text {i}", 0) for i in rng.choice(10**6, 207, replace=False)]
    got = {r.doc_id: (r.row_number_global, r.shard, r.slot) for r in sharding.assign(docs(spark, data), shards=8, key=11).collect()}
    want = {i: place(k, len(data), 11) for k, (i, *_) in enumerate(sorted(data))}
    assert got == {i: (k, want[i] % 8, want[i] // 8) for k, (i, *_) in enumerate(sorted(data))}
    assert sorted(want.values()) == list(range(len(data)))


def test_written_shards_hold_every_row_once(spark, tmp_path):
    data = [(1, "same"), (1, "same"), (1, "same"), (None, "no id"), (None, None), (3, "c"), (2, "")]
    table = spark.createDataFrame([(*r, "s", k) for k, r in enumerate(data)], "doc_id long, text string, shard string, n int")
    sharding.write_shards(table, f"{tmp_path}/shards", shards=3)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert set(back.columns) == {"doc_id", "text", "shard", "n", "slot", "shard_"}
    got = back.collect()
    assert sorted(r.n for r in got) == list(range(len(data))) and all((r.doc_id, r.text, r.shard) == (*data[r.n], "s") for r in got)
    key = lambda r, shard: (str(r["doc_id"]), r[shard], r["slot"])
    assert sorted(key(r, "shard_") for r in got) == sorted(key(r, "shard") for r in sharding.assign(table, shards=3).collect())
    sharding.write_shards(table.limit(0), f"{tmp_path}/none", shards=3)


@pytest.mark.parametrize("seed", range(6))
def test_repair_round_trip(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, 80)
    ids = rng.integers(0, [2, 5, 50, 3, 1000, 1][seed], lengths.sum())
    blob = token_files.pack(list(range(80)), lengths, ids)
    shard = token_files.Shard(blob)
    assert (shard.decode_all() == ids).all()
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for k in (0, 7, 79):
        assert (shard.decode_document(k) == ids[starts[k] : starts[k + 1]]).all()
    for a, b in ((0, 1), (5, 5), (17, 400), (starts[-1] - 3, starts[-1] + 9)):
        assert (shard.decode_range(int(a), int(b)) == ids[a:b]).all()
    lengths_of = [len(token_files.expand(np.array([shard.base + k]), shard.rules, shard.base)) for k in range(len(shard.rules))]
    assert lengths_of == shard.lengths.tolist()


def test_repair_goes_on_until_no_pair_is_left():
    passage = np.arange(100, 612)
    ids = np.tile(passage, 64)
    symbols, last, rules, base = token_files.repair(ids, np.arange(len(ids)) % len(passage) == len(passage) - 1, least=0.0)
    assert len(symbols) == 64 and token_files.expansion_lengths(rules, base).max() == len(passage)
    assert (token_files.expand(symbols, rules, base) == ids).all()


@pytest.mark.parametrize("n", [2, 15, 16, 40, 4096, 30_001])
def test_repair_halves_runs(n):
    """A run of one symbol shrinks by half a round, whatever its neighbours, until 16 pairs are no more."""
    ids = np.array([*[5] * n, 6, *[5] * n, 6])
    ends = np.arange(len(ids)) == len(ids) - 1
    symbols, last, rules, base = token_files.repair(ids, ends, least=0.0)
    assert (token_files.expand(symbols, rules, base) == ids).all() and last.tolist() == [False] * (len(symbols) - 1) + [True]
    assert len(symbols) < 80 and len(rules) < 40


@pytest.mark.parametrize("kinds, least", [(3, 1), (700, 5), (40_000, 3), (40_000, 16), (10, 10**6)])
def test_pairs_are_counted_exactly(kinds, least):
    rng = np.random.default_rng(kinds)
    key = rng.integers(0, 50_000, kinds)[rng.integers(0, kinds, 200_000)] << 32 | 17
    value, count = np.unique(key, return_counts=True)
    found, places, which = token_files._frequent(key, least)
    assert found.tolist() == value[count >= least].tolist()
    assert places.tolist() == np.flatnonzero(np.isin(key, found)).tolist() and (found[which] == key[places]).all()


def test_first_round_takes_the_most_frequent_pairs():
    """As many kinds of pairs as a table of hashed counts would mix up."""
    rng = np.random.default_rng(4)
    ids = rng.zipf(1.3, 400_000) % 30_000
    ends = rng.random(len(ids)) < 0.01
    ends[-1] = True
    inside = ~ends[:-1]
    pair, count = np.unique((ids[:-1] << 32 | ids[1:])[inside], return_counts=True)
    best = pair[np.lexsort((pair, -count))[:300]]
    rules = token_files.repair(ids, ends, per_round=300, least=2.0)[2]
    assert len(rules) > 200 and set((rules[:, 0] << 32 | rules[:, 1]).tolist()) <= set(best.tolist())


def test_rules_stay_inside_documents():
    ids, lengths = np.tile([1, 2], 500), np.full(500, 2)
    shard = token_files.Shard(token_files.pack(list(range(500)), lengths, ids))
    assert len(shard.rules) == 1 and len(shard.symbols) == 500


def test_damage_is_noticed():
    blob = bytearray(token_files.pack([1], np.array([3]), np.array([1, 2, 3])))
    blob[60] ^= 1
    with pytest.raises(ValueError):
        token_files.Shard(bytes(blob))


def test_token_files_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = TOKENS.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    data = [d for d in hand(40) if d[0] is not None]
    shards = token_files.write_shards(docs(spark, data), path, shard_ids=2000)
    got = sorted(tuple(r) for r in token_files.read_documents(shards).collect())
    want, start = [], 0
    texts = {}
    for i, t, _ in data:
        texts.setdefault(i, []).append(t)
    for i in sorted(texts):
        for t in texts[i]:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert got == sorted(want)
    token_files.export(shards, str(tmp_path)).collect()
    assert len(list(tmp_path.glob("*.tlrp"))) == shards.count()


def test_token_files_empty(spark):
    shards = token_files.write_shards(docs(spark, []), TOKENS.path("byte_bpe_50k.json"))
    assert token_files.read_documents(shards).collect() == []


def test_words_equal_the_pattern():
    """Random texts of awkward pieces: the same words as the published pattern's."""
    import random

    import regex

    rng, cut, classes = random.Random(1), regex.compile(TOKENS.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}")), token_files.character_classes()
    pieces = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "a", "bc", "É", "漢", "1", "23", "½", "²", "'", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'x", "!", "--", "🙂", "_", "\x1c", "\x00", "s", "ll"]
    for _ in range(3000):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 4))]
        joined = "".join(texts)
        if not joined:
            continue
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in texts])
        starts = token_files.word_starts(points, classes[points], (np.cumsum(size) - size)[size > 0])
        got = [joined[i:j] for i, j in zip(starts, [*starts[1:], len(joined)])]
        assert got == [w for t in texts for w in cut.findall(t)], texts


def test_random_texts_equal_the_library():
    import random

    from tokenizers import Tokenizer

    path = TOKENS.path("byte_bpe_50k.json")
    encoder, library, rng = token_files.WordCachedTokenizer(path), Tokenizer.from_file(path), random.Random(2)
    pieces = [" ", "  ", "\n", "\u00a0", "hello", "World", "É", "漢字", "123", "½", "'", "'s", "'re", "'ll", "'x", "!", "🙂", "\x1c", "\x85", "\u200b", "x" * 300, "<|endoftext|>", "ǅ", "ß"]
    for _ in range(150):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 15))) for _ in range(4)]
        ids, n = encoder.encode(texts)
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts], texts


def test_word_cache_survives_forgetting():
    from tokenizers import Tokenizer

    path = TOKENS.path("byte_bpe_50k.json")
    encoder, library = token_files.WordCachedTokenizer(path), Tokenizer.from_file(path)
    encoder.LIMIT = 5
    texts = ["a b c d e f g h", " lead  two", "x'll don't ½² 漢字\n\n\té", "<|endoftext|>", "", "ab " * 50]
    for part in (texts[:3], texts[3:], texts):
        ids, n = encoder.encode(part)
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_words_that_share_a_place_are_encoded_once():
    encoder = token_files.WordCachedTokenizer(TOKENS.path("byte_bpe_50k.json"))
    encoder.BITS = 13
    encoder.forget()
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(k, k + 500)) for k in range(0, 2000, 500)]
    asked, whole = [], encoder._encoded
    encoder._encoded = lambda words: (asked.append(len(words)), whole(words))[1]
    want = encoder.encode(texts)
    for _ in range(4):
        encoder.encode(texts)
    asked.clear()
    again = encoder.encode(texts)
    assert all((a == b).all() for a, b in zip(want, again)) and sum(asked) < 20


def test_classes_are_the_librarys():
    """Characters that two versions of Unicode class differently: letters here, unassigned there."""
    from tokenizers import Tokenizer

    path = TOKENS.path("byte_bpe_50k.json")
    encoder, library = token_files.WordCachedTokenizer(path), Tokenizer.from_file(path)
    texts = ["\U0004dba0\U000333b3're\n", "\xbd\U000b1056''s1", "\U000be140'll", "a\u0558b \u0558", "a\u088f\u088f1 \u0c5c!", "\u208f\u209d2"]
    ids, n = encoder.encode(texts)
    assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    every = np.array([c for c in range(0x600) if c != 0x558])
    encoder._classify(every)
    reference = token_files.character_classes()
    assert (encoder.classes[every] == reference[every]).mean() > 0.99


def test_other_tokenizer_files_go_through_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(TOKENS.path("byte_bpe_50k.json")))
    assert token_files.imitated(spec)
    texts = ["It's  the first\n\ntext 12", "", " x", "été don't"]
    for k, change in enumerate(({"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}})):
        other = spec | change
        assert not token_files.imitated(other)
        path = str(tmp_path / f"{k}.json")
        json.dump(other, open(path, "w"))
        ids, n = token_files.WordCachedTokenizer(path).encode(texts)
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
