"""Packing, spelling variants and the conversation trie against plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import conversation_trie, packing, spelling

DOCS = ("doc_id bigint, text string, ids string, length string, word string, n bigint, "
        "rank bigint, bucket string, row bigint")


def docs_of(spark, rows):
    extra = ("clash", "9", "w", 7, 1, "b", 3)
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS).repartition(3)


# ---------------------------------------------------------------- packing

@pytest.fixture(scope="module")
def tokenizer():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer
    return path, Tokenizer.from_file(path)


ODD = ["It's", "don't", "a<|endoftext|>b", "<|x", "É", "é", "×", "÷", "ß", "ÿ", "Àb", "x" * 400,
       "12ab3", "́", "é", "日本語", "\x1c", " ", "!!", "?!a", "'s", "Iİ", "\u0085",
       "²", "ª", "_a_", "\x7f", "ΑΣ", "😀", "word,", "THE", "end."]


def odd_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) + rng.choice(["", " ", "\n", "\t"]) for _ in range(k % 40))
             for k in range(400)]
    return [*texts, None, "", "  \n", "alpha beta " * 4000, "alpha beta " * 4000]


def test_encoder_agrees_with_the_library(tokenizer):
    path, whole = tokenizer
    with open(path, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    texts = odd_texts()
    for _ in range(2):  # the second time from what it has learnt
        ids, per_row = encoder.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(per_row)
        for text, lo, hi in zip(texts, ends - per_row, ends, strict=True):
            assert ids[lo:hi].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_forgets_without_harm(tokenizer, monkeypatch):
    path, whole = tokenizer
    monkeypatch.setattr(packing, "MEMO_UNITS", 50)
    with open(path, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    for text in odd_texts()[:60]:
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 0]


def test_pieces_and_sequences(spark, tokenizer):
    path, whole = tokenizer
    texts = odd_texts()
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "null id"), (None, None)]
    pieces = packing.tokenise(docs_of(spark, rows), path, size=256)
    packed = packing.pack(pieces, size=256, groups=16).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at:at + 256]
            want[i, p, at, len(part), np.array(part, "<u4").tobytes()] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids))
                               for r in packed) == want
    check_sequences([(r.sequence_id, r.offset, r.length) for r in packed], 256)
    whole_rows = packing.sequences(packing.pack(pieces, size=256)).collect()
    assert sum(r.length for r in whole_rows) == sum(r.length for r in packed)
    assert all(len(r.ids) == 4 * r.length <= 4 * 256 for r in whole_rows)


def check_sequences(rows, size):
    by = collections.defaultdict(list)
    for s, offset, length in rows:
        by[s].append((offset, length))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def best_fit_decreasing(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        k = min(fits, key=lambda j: rooms[j]) if fits else len(rooms)
        if not fits:
            rooms.append(size)
        rooms[k] -= n
    return len(rooms)


def test_plan_is_valid_and_no_longer_than_best_fit(spark):
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 2049, 900), rng.integers(260, 700, 900),
                    np.minimum(rng.geometric(1 / 500, 900), 2048), [1025] * 7 + [1023] * 3,
                    [5], [1] * 5000, [2048] * 3):
        counts = collections.Counter(map(int, lengths))
        found = packing.plan(counts, 2048, groups=48)
        assert found.sequences <= best_fit_decreasing([int(n) for n in lengths], 2048)
        assert found.sequences >= -(-sum(map(int, lengths)) // 2048)
        df = spark.createDataFrame([(int(n), "x") for n in lengths], "length int, sequence_id string")
        got = packing.pack(df, groups=48)
        assert got.columns == ["length", "sequence_id", "offset"]
        assert check_sequences([(r.sequence_id, r.offset, r.length) for r in got.collect()],
                               2048) == found.sequences


def test_pack_handles_nulls_empty_tables_and_ranks_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 16)
    schema = "length long, piece int, rank int, bucket int, row int, turn int, before int"
    lengths = [7] * 500 + [900] * 77 + [None, 0, 3000]
    got = packing.pack(spark.createDataFrame([(n, 1, 2, 3, 4, 5, 6) for n in lengths], schema))
    rows = got.collect()
    assert got.columns[:7] == [c.split()[0] for c in schema.split(", ")] and len(rows) == 580
    placed = [(r.sequence_id, r.offset, r.length) for r in rows if r.sequence_id is not None]
    assert len(placed) == 577 and check_sequences(placed, 2048) == 39
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    empty = spark.createDataFrame([], DOCS)
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert packing.tokenise(empty, path).count() == 0


# ---------------------------------------------------------------- spelling

def runs(text):
    word = ""
    for ch in (text or "") + " ":
        if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
            word += ch.lower() if "A" <= ch <= "Z" else ch
        elif word:
            yield word
            word = ""


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def spelling_rows():
    rng = random.Random(8)
    stems = ["contains", "aabbaabb", "ÀÉîoûy", "ßtraßen", "xxxxxxxx", "sevenly"]
    texts = []
    for k in range(300):
        words = []
        for _ in range(40):
            w = list(rng.choice(stems[:1 + k % len(stems)]))
            if rng.random() < 0.12:
                at = rng.randrange(len(w))
                w[at:at + rng.randrange(2)] = rng.choice(["", "x", "a", "É", "tt"])
            words.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        texts.append(rng.choice([" ", "1", "×, ", "·"]).join(words))
    return [*enumerate(texts), (7, texts[7]), (None, texts[0]), (900, None), (901, ""),
            (902, "y" * 5000 + " " + "contains " * 3000), (903, "日本語contains語")]


def test_spelling_variants(spark):
    rows = spelling_rows()
    n = collections.Counter()
    for i, t in rows:
        for r in runs(t):
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 5 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            if len(r) >= 6:
                n[r] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    want = {}
    form = {}
    for w in n:
        met = [o for o in n if near(w, o)]
        best = min(met, key=lambda o: (-n[o], o), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
        want[w] = len(met)
    assert len(n) > 100 and len(form) > 20
    words = spelling.vocabulary(docs_of(spark, rows), least_n=3, every=5)
    got = spelling.group(words).collect()
    assert len(got) == len(n)
    for r in got:
        root = r.word
        while root in form:
            root = form[root]
        f = form.get(r.word)
        assert (r.n, r.n_near, r.form, r.form_n, r.root) == (
            n[r.word], want[r.word], f, n.get(f), root)


def test_spelling_nulls_and_empty_tables(spark):
    assert spelling.vocabulary(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.group(spark.createDataFrame([], "word string, n long, form int")).count() == 0
    odd = spark.createDataFrame([("abcdef", 9, 1), (None, 4, 1), ("abcdeg", None, 1)],
                                "word string, n long, prefix int")
    assert [tuple(r) for r in spelling.group(odd).select("word", "n_near", "root").collect()] == [
        ("abcdef", 0, "abcdef")]


def test_roots_follow_forms_to_the_last(spark):
    chain = [("aaaaaa", 1), ("aaaaab", 5), ("aaaabb", 25), ("aaabbb", 125), ("aabbbb", 625)]
    got = spelling.group(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r.word: (r.form, r.root) for r in got} == {
        w: (chain[k + 1][0] if k < 4 else None, "aabbbb") for k, (w, _) in enumerate(chain)}


def test_crc_of_runs():
    rng = random.Random(2)
    texts = [rng.randbytes(rng.choice([0, 1, 7, 63, 64, 65, 900])) for _ in range(300)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - np.array([len(t) for t in texts])
    seed = np.array([zlib.crc32(str(k).encode()) for k in range(300)], np.uint32)
    assert spelling._crc_of(raw, start, end, seed).tolist() == [
        zlib.crc32(str(k).encode() + t) for k, t in enumerate(texts)]


# ---------------------------------------------------------------- the trie

CONV = "conv_id bigint, turn bigint, role string, text string, node string, depth int, seq int"


def conversation_rows():
    rng = random.Random(11)
    rows = []
    for c in range(0, 140):
        if c % 10 == 5:
            continue
        for t in range(rng.randrange(0, 14)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["hé", "yo", "", None])))
    for c in range(1000, 1300):          # a group of copies, from equal heads
        rows += [(c, t, "user", "same") for t in range(3)]
    rows += [(2000, None, "user", "first"), (2000, 1, "b", "tie"), (2000, 1, "a", "tie"),
             (2000, 1, "a", "tie"), (None, 1, "user", "nobody"), (-3, 1, "u", "negative")]
    rows += [(2001, t, "u", f"turn {t}") for t in range(300)]
    return rows


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, saved, leaves = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, inside in members.items():
        value = (len(inside) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += value
            leaves[node[:d]] += not children[node]
    return collections.Counter(
        (min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside),
         children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(c for c in inside if built[c] == node)))
                        .encode()).hexdigest())
        for node, inside in members.items())


FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
          "saved_tokens", "ends_sha256")


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE_IDS", 7)
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], CONV).repartition(5)
    got = collections.Counter(tuple(r[f] for f in FIELDS)
                              for r in conversation_trie.trie(df).collect())
    assert got == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie.trie(spark.createDataFrame([], CONV)).count() == 0
    # own turns all replaced by an absent base: a member of the root without a turn
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    one = spark.createDataFrame([(c, 1, "u", "t", "x", 0, 0)], CONV)
    assert [tuple(r[f] for f in FIELDS) for r in conversation_trie.trie(one).collect()] == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
