"""Prefix trie, token alignment and group-matrix join against brute force, with their edge cases."""

import hashlib
import random
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from ledgerline.llm import group_matrix_join, prefix_trie, sentence_pieces, token_alignment
from ledgerline.llm.near_dedup import WordHashes, shingle_set

TURNS = "conv_id long, turn long, role string, text string, depth string, path long"
DOCS = "doc_id long, text string, pair long, cid string, row string"


# --- prefix trie -----------------------------------------------------------------------------------


def nodes_by_force(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        role, text = role or "", text or ""
        if c is not None:
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves[p] or 1
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode().split())
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def nodes_of(spark, rows):
    out = prefix_trie.prefix_nodes(spark.createDataFrame(rows, TURNS).repartition(3)).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in out)


def conversations(seed=3, count=400):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1200), count):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            shared = rng.random() < (0.9 if t < 2 else 0.4)
            text = f"common {t % 3} words" if shared else f"own {rng.randrange(40)}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text, "x", 1))
    return rows


def test_trie_equals_brute_force(spark):
    rows = conversations()
    assert nodes_of(spark, rows) == nodes_by_force(rows)


def test_trie_edges(spark):
    odd = [
        (7, None, None, None, None, None), (7, 1, "", "", None, None), (27, 1, "user", " \t ", None, None), (27, 1, "user", "a  b\vc", None, None),
        (27, 1, "user", "a  b\vc", None, None), (40, 5, "u", "x" * 50_000, None, None), (None, 1, "user", "nobody's", None, None),
        (41, 0, "user", "é 日本", None, None)]
    # copies of one conversation, and a long one
    odd += [(c, t, "user", f"same {t}", None, None) for c in range(1000, 1300) if zlib.crc32(str(c).encode()) % 4 == 0 for t in range(2)]
    odd += [(2001, t, "user", f"turn {t % 7}", None, None) for t in range(1500)]
    assert nodes_of(spark, odd) == nodes_by_force(odd)


def test_trie_of_nothing(spark):
    assert nodes_of(spark, []) == []
    assert nodes_of(spark, [(None, 1, "user", "a", None, None)]) == []


def test_tree_layouts_grow_and_paths_are_cut():
    rng = random.Random(1)
    keys = sorted({bytes([b]) * 16 for b in range(256)} | {bytes([9]) * 16 + rng.randbytes(16) for _ in range(30)} | {b""})
    root = prefix_trie.tree_of(keys)
    assert (root.layout, root.size) == (256, 256)
    branch = root.find(9)
    assert branch.path == bytes([9]) * 16 and keys[branch.end] == bytes([9]) * 16
    assert branch.layout in (16, 48) and [k.path[0] for k in branch.children()] == sorted(k.path[0] for k in branch.children())
    depth, parent, _, end = prefix_trie.aligned_nodes(root)
    # bytes at which paths part inside an id are no nodes
    assert Counter(depth.tolist()) == {0: 1, 1: 256, 2: 30} and sorted(end.tolist()) == list(range(len(keys)))
    assert all(depth[p] == d - 1 for p, d in zip(parent[1:], depth[1:], strict=True))


# --- token alignment ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def aligned_by_force(files, rows):
    a, b = Tokenizer.from_str(files[0]), sentencepiece.SentencePieceProcessor(model_proto=files[1])
    a.encode_special_tokens = True
    known = token_alignment.sides(*files)
    linked, docs = Counter(), []
    for d, text, *_ in rows:
        raw = b" " + (text or "").encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs, ys = [known.a_bytes[i] for i in x], [known.b_bytes[i] for i in y]
        if not text or b"".join(xs) != raw or b"".join(ys) != raw:
            docs.append((d, 0, 0, 0, [], ""))
            continue
        spans = [[(sum(map(len, s[:i])), sum(map(len, s[: i + 1]))) for i in range(len(s))] for s in (xs, ys)]
        links = [(i, j) for i, (p, q) in zip(x, spans[0], strict=True) for j, (r, s) in zip(y, spans[1], strict=True) if p < s and r < q]
        ends = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        parts, low = [], 0
        for high in ends:
            parts.append("|".join(",".join(str(i) for i, (p, _) in zip(ids, s, strict=True) if low <= p < high) for ids, s in zip((x, y), spans, strict=True)))
            low = high
        linked.update(links)
        docs.append((d, len(x), len(y), len(parts), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    highest = defaultdict(int)
    for (_, j), n in linked.items():
        highest[j] = max(highest[j], n)
    key = lambda r: (r[0] is None, r)
    return sorted([(d, n, m, g, len(k), sum(linked[p] == highest[p[1]] for p in k), sum(linked[p] for p in k), h) for d, n, m, g, k, h in docs], key=key)


TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, " "), (5, "  two  spaces   and a tail  "),
    (6, "\n\tline\n next  line \n"), (7, "mark ▁ inside"), (8, "日本語 emoji 🙂 naïve café"), (9, "<|endoftext|> <s> <0x41> </s> plain"),
    (10, "The quick brown fox jumps over the lazy dog."), (10, "The quick brown fox jumps over the lazy dog."), (11, "x" * 900),
    (12, "don't we'll I'm 1234567 ,,,;; \x00 \x1c   end"), (13, "עברית और हिन्दी ภาษาไทย"), (None, "no id"), (14, "a \n b"), (15, " lead")]


def test_alignment_equals_brute_force(spark, files):
    rng = random.Random(2)
    words = ["alpha", "Überzug", "naïveté", "re-entry", "x1y2", "tokenisation", "的", "\n", "  ", "'s"]
    rows = [(d, t, None, "c", "r") for d, t in TEXTS + [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(40)]]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    expected = aligned_by_force(files, rows)
    for head in (token_alignment.HEAD_PAIRS, 25, 0):
        got = sorted((tuple(r) for r in token_alignment.align_documents(docs, *files, head).collect()), key=lambda r: (r[0] is None, r))
        assert got == expected
    assert token_alignment.align_documents(docs.limit(0), *files).collect() == []


def test_long_text_in_windows(files, monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdé\n", k=rng.randrange(1, 9))) for _ in range(6_000))
    found = []
    for window, slice_tokens in ((1 << 20, 200_000), (500, 700)):
        monkeypatch.setattr(token_alignment, "WINDOW", window)
        monkeypatch.setattr(token_alignment, "SLICE_TOKENS", slice_tokens)
        known = token_alignment.sides(*files)
        known.new.clear(), known.old.clear()
        sizes = known.sizes(0), known.sizes(1)
        frame = token_alignment._Frame(token_alignment.Digits(60_000), sizes, len(known.b_bytes))
        document, other = token_alignment._encoded([text, text + " ▁"], known, frame)
        assert (other.n_a, other.pairs) == (0, [])
        keys, counts = token_alignment._held(document)
        found.append((document.n_a, document.n_b, document.n_groups, document.n_links, document.digest.hexdigest(), keys.tolist(), counts.tolist()))
    assert found[0] == found[1]


def test_stretches_are_encoded_as_the_libraries_do(files):
    """With and without the fast way of the first side."""
    texts = [t for _, t in TEXTS if t] + ["one two", "ends in  ", "؀ later script"]
    known = token_alignment.Sides.build(*files)
    slow = token_alignment.Sides.build(*files)
    assert known.ranks is not None and known.by_stretch
    slow.ranks = None
    for t in texts:
        for w in known.windows(t):
            for side in (known, slow):
                side.learn(side.stretches(w))
            assert [known.new[s] for s in known.stretches(w)] == [slow.new[s] for s in slow.stretches(w)]


# --- group-matrix join ------------------------------------------------------------------------------------


def joined_by_force(rows, percent, size=3):
    """Rows of one id are one node; a row without an id is alone."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]):
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    key = lambda r: (r[0] is None, r[1:] if r[0] is None else r)
    return sorted([(r[0], len(s), None if r[0] is None else low[find(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))], key=key)


def join_of(spark, rows, percent):
    out = group_matrix_join.similarity_join(spark.createDataFrame(rows, DOCS).repartition(3), 3, percent).collect()
    return sorted((tuple(r) for r in out), key=lambda r: (r[0] is None, r[1:] if r[0] is None else r))


def near_copies(seed, groups, members, words=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([2, 3, 9, 12, 20, words, 3 * words]))
        for _ in range(rng.randrange(1, members)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary).upper()]
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("percent", [90, 60])
def test_join_equals_brute_force(spark, percent):
    texts = [*near_copies(5, 25, 12), None, "", " \n", "a", "A", "a b", "x" * 5_000, "é ñ 日本 end"]
    ids = random.Random(1).sample(range(5_000), len(texts))
    rows = [(d, t, 1, "c", "r") for d, t in zip(ids, texts, strict=True)]
    assert join_of(spark, rows, percent) == joined_by_force(rows, percent)


def test_join_of_one_large_group(spark, monkeypatch):
    """Near copies that fill many groups, some linked with none of the others; a passage that everything shares."""
    monkeypatch.setattr(group_matrix_join, "GROUP", 8)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(260):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            copy[rng.randrange(120)] = f"v{rng.randrange(10_000)}"
        rows.append((d, " ".join(copy), 1, "c", "r"))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(1000 + d, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) + " " + passage, 1, "c", "r") for d in range(60)]
    got = join_of(spark, rows, 90)
    assert got == joined_by_force(rows, 90)
    assert len({r[2] for r in got}) > 62


def test_join_edges(spark):
    assert join_of(spark, [], 90) == []
    rows = [(None, "a b c d", 1, "", ""), (5, "a b c d", 1, "", ""), (4, "A B C D", 1, "", ""), (5, "a b c d", 1, "", ""), (6, None, 1, "", ""), (7, "", 1, "", "")]
    assert join_of(spark, rows, 90) == joined_by_force(rows, 90)


def test_near_sets_share_a_signature():
    """Every pair at the threshold has one, also when few ranges are filled."""
    rng = np.random.default_rng(1)
    for percent in (90, 60, 50):
        for size in [1, 2, 3, 5, 9, 10, 11, 19, 20, 21, 40, 150, 1000]:
            for _ in range(40):
                base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(rng.choice([1, 0, 0])))
                extra = rng.integers(0, 1 << 63, group_matrix_join.difference(2 * size, percent) + 1, dtype=np.uint64)
                gone = rng.integers(0, len(base))
                other = np.unique(np.concatenate([base[: len(base) - gone], extra[: rng.integers(0, len(extra) + 1)]]))
                common = len(np.intersect1d(base, other))
                if 100 * common >= percent * (len(base) + len(other) - common) and common < max(len(base), len(other)):
                    mine, theirs = (group_matrix_join.signatures_of(s, percent) for s in (base, other))
                    assert np.intersect1d(mine, theirs).size


def test_groups_not_opened_hold_no_link():
    words = WordHashes()
    texts = [t.encode() for t in near_copies(8, 6, 10)]
    sets = [shingle_set(t, 3, words) for t in texts]
    sets = [s for s in {s.tobytes(): s for s in sets if len(s)}.values()]
    half = len(sets) // 2
    one = group_matrix_join.Group.of(range(half), [s.tobytes() for s in sets[:half]])
    two = group_matrix_join.Group.of(range(half, len(sets)), [s.tobytes() for s in sets[half:]])
    links = group_matrix_join.linked_members(one, two, 80)
    near = {(i, j) for i in range(half) for j in range(half, len(sets))
            if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)}
    assert set(links) <= near and {i for i, _ in links} | {j for _, j in links} == {x for p in near for x in p}


# --- SentencePiece models with markers inside pieces ---------------------------------------------------


def _message(*parts):
    """A protobuf message from (number, bytes, float or int)."""
    out = b""
    for number, value in parts:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2, len(value)]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 & 127 | (128 if number > 15 else 0), *([number >> 4] if number > 15 else []), value])
    return out


def test_pieces_with_inner_markers_are_encoded_whole(monkeypatch):
    names = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("a▁b", -0.5, 1), ("▁a", -3.0, 1), ("▁b", -3.0, 1), ("a", -4.0, 1), ("▁", -1.0, 1), ("b", -4.0, 1)]
    pieces = [(1, _message((1, n.encode()), (2, score), (3, kind))) for n, score, kind in names]
    model = _message(*pieces, (2, _message((3, 1))), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    known = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder = sentence_pieces.PieceEncoder(model)
    texts = ["a b", "a b a b", "b a", "ab", "a"]
    for (ids, parity, *_), text in zip(encoder.encode(texts), texts, strict=True):
        same = np.frombuffer(ids, "<u4").tolist() == known.encode(text)
        assert parity == same
    assert known.encode("a b") == [7, 3] and not encoder.by_mark


def test_stretches_come_back_from_the_generation_before(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "KEPT_STRETCHES", 8)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    encoder, known = sentence_pieces.PieceEncoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(3)
    words = [f"word{i}" for i in range(30)]
    for _ in range(40):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 12)))
        (ids, parity, back, _), = encoder.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == known.encode(text) and parity and back
        assert len(encoder.stretches) + len(encoder.before) <= 40


def test_only_runs_that_differ_are_encoded_stretch_by_stretch(monkeypatch):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        encoder = sentence_pieces.PieceEncoder(f.read())
    alone = []
    by_stretch = encoder.learn_alone
    monkeypatch.setattr(encoder, "learn_alone", lambda new: (alone.append(len(new)), by_stretch(new)))
    texts = [" ".join(f"word{i} été{i} 漢{i}" for i in range(low, low + 40)) for low in range(0, 400, 40)] + ["two  spaces ▁ and a marker", "\U0001f9ff\x00end", "", "  "]
    found = encoder.encode(texts)
    assert max(alone) <= 2 * sentence_pieces.TOGETHER
    for text, (ids, same, _, n_bytes) in zip(texts, found, strict=True):
        theirs = encoder.reference.encode(text)
        assert same == (np.frombuffer(ids, "<u4").tolist() == theirs)
        assert n_bytes == sum(encoder.reference.is_byte(i) for i in np.frombuffer(ids, "<u4").tolist())
    before = sentence_pieces.PieceEncoder(encoder.reference.serialized_model_proto())
    monkeypatch.setattr(before, "learn_together", lambda new: new)
    assert before.encode(texts) == found


def test_word_hashes_stay_small_and_right():
    words = WordHashes()
    tracemalloc.start()
    try:
        for i in range(300_000):
            words[b"word %d" % i]
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 25e6
    assert words[b"word 1"] == xxhash.xxh3_64_intdigest(b"word 1") == words[b"word 1"]
