import gc
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import re
from tokenizers import Tokenizer

from trellis.llm import decontaminate, packing, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items, window):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        x = words(t)
        wins = {tuple(x[i : i + window]) for i in range(max(1, len(x) - window + 1))} if x else set()
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    ids |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [10_000, 9])
def test_scan_equals_brute_force(spark, block):
    rng = random.Random(1)
    vocab = ["a", "B", "c1", "é", "ÉX", "🙂", "dd"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "\n", "-", "  ", "_"]) for _ in range(n))
    items = [(i, say(rng.randint(0, 12))) for i in range(12)] + [(None, "a B c1 dd"), (50, None), (51, " -- "), (52, "only")]
    texts = [None, "", "!!", "ONLY a", *(say(rng.randint(0, 60)) for _ in range(60)), "x " * 3000 + items[3][1].upper() + " x" * 3000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, items string").repartition(3)
    got = {r.doc_id: r for r in decontaminate.scan(docs, spark.createDataFrame(items, "item_id int, text string"), window=4, block_words=block).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(t, items, 4)
        assert sum(len(words(t[s.start : s.end])) for s in r.spans) == r.n_hit
    assert decontaminate.scan(docs.limit(0), spark.createDataFrame([], "item_id int, text string")).collect() == []


def test_long_items_are_cut_and_dealt(spark):
    rng = random.Random(6)
    long = [f"w{rng.randrange(5000)}" for _ in range(900)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, "w1 w2")], "item_id int, text string")
    texts = [" ".join(long[k : k + 10]) for k in range(0, 891, 7)] + [" ".join(long[:9]), "w1 w2 w3", "x " + " ".join(long) + " y"]
    got = decontaminate.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), items, block_words=64).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(r.text, [(1, " ".join(long)), (2, "w1 w2")], 10)


def test_fast_encoder_equals_tokenizers():
    slow, fast = Tokenizer.from_file(BPE), packing.encoder(BPE)
    rng = random.Random(2)
    odd = [chr(c) for c in (*range(0x20), *range(0x7F, 0x2100, 7), 0x3000, 0x4E2D, 0x1F642, 0x2028, 0x85, 0xA0, 0xFEFF, 0x10FFFF)]
    texts = ["", " ", "\n\n  a", "don't we'll 's 'S x'rest", "a" * 3000, "1234 56  78\t9", "<|endoftext|> x", *("".join(rng.choice([*odd, "a", " ", "'", "re", "9", "\n"]) for _ in range(60)) for _ in range(300))]
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_takes_a_million_blanks():
    for t in (" " * 1_000_000 + "x", "a" + "\n" * 1_000_000):
        assert packing.encoder(BPE)(t).tolist() == Tokenizer.from_file(BPE).encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x", "é🙂"]) for _ in range(rng.choice([0, 1, 5, 50, 400, 3000])))) for i in range(120)] + [(None, None), (7, "again")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BPE, with_ids=True).collect()
    slow = Tokenizer.from_file(BPE)
    docs, windows = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length and r.length > 0
        docs[r.doc_id, r.doc_tokens].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for i, t in rows:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(docs[i, len(ids)], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
    waste = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        waste += 0 if at & (at - 1) == 0 else 1024 - at
    assert waste == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BPE).collect() == []


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(4)
    p = packing.Packer(16)
    for k in range(400):
        n = rng.randint(1, 15)
        options = {0: sum(c * c for c in p.count) + 2 * p.count[n] + 1}
        for h in range(1, 16 - n + 1):
            if p.count[h]:
                c = p.count.copy()
                c[h] -= 1
                if h + n < 16:
                    c[h + n] += 1
                options[h] = sum(c * c)
        assert options[p.level(n)] == min(options.values())
        p.add(k, np.zeros(n, np.uint32))
    assert p.count[0] == 0 and p.count[16] == 0


def brute_count(word, model):
    best = {0: (0.0, 0)}
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        cands = [(best[end - 1][0] + n * -20.0, best[end - 1][1] + n)] + [(best[s][0] + model[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in model]
        best[end] = max(cands, key=lambda c: (c[0], -c[1]))
    return best[len(word)][1]


def test_trie_counts_equal_brute_force(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = token_counts.scores(path)
    texts = [None, "", " \n ", "the then there theme", "the 🙂 naïve Überraschung 日本語 xqzzk", "a " * 500 + "zzz" * 400, "the then there theme"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in token_counts.token_counts(df, path, most_words=2, most_nodes=5).collect():
        w = (texts[r.doc_id] or "").split()
        assert r.n_pretokens == len(w) and r.n_tokens == sum(brute_count("▁" + x, model) for x in w)
    assert token_counts.token_counts(df.limit(0), path).collect() == []


def test_trie_equals_brute_force_on_odd_vocabularies_and_its_nodes_are_no_objects():
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("ab▁é🙂") for _ in range(n))
    for _ in range(30):  # pieces within pieces, equal scores
        model = {say(rng.randint(1, 6)): -float(rng.randint(1, 4)) for _ in range(rng.randint(0, 25))}
        trie, words = token_counts.Trie(model), [say(rng.randint(0, 12)) for _ in range(60)]
        assert [trie.count(w) for w in words] == [brute_count(w, model) for w in words]
    trie, words = token_counts.Trie({"a": -1.0}), [say(30) for _ in range(1000)]
    gc.collect()
    held = len(gc.get_objects())
    for w in words:
        trie.count(w)
    gc.collect()
    assert len(gc.get_objects()) - held < 1000  # some 25,000 nodes
