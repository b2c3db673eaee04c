"""Corpus operators against brute force on small tables, and their edge cases."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import (
    learned_ann,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sentence_pieces,
    sharding,
    stages,
    suffix_dedup,
    url_filter,
    warc,
)
from ledgerline.llm.byte_bpe import ByteBpe
from ledgerline.llm.queries import BYTE_BPE, URL_RULES

ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "a"), (904, "a"), (905, "x" * 6_000), (906, "é ñ ▁ 日本   end ")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    full = [(d, t, None if d % 5 == 0 else "en", "s", len(t or "")) for d, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def near_copies(seed=5, groups=12):
    """Texts with edited, cut and exact copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([8, 12, 20, 80, 300]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            texts.append(" ".join(copy[: rng.randrange(1, len(copy) + 1)] if rng.random() < 0.3 else copy))
    ids = rng.sample(range(800), len(texts))
    return [*zip(ids, texts), *ODD]


# --- near duplicates -------------------------------------------------------------------------


def groups_by_force(rows, size, percent):
    sets, holders = {}, defaultdict(set)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        runs = [tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        sets[d] = set(runs)
        for r in runs:
            holders[r].add(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in {x for r in sets[a] for x in holders[r] if x > a}:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d, _ in rows)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = near_copies()
    got = near_dedup.near_duplicates(documents(spark, rows), size, percent)
    assert sorted(map(tuple, got.collect())) == groups_by_force(rows, size, percent)


def test_near_duplicates_of_one_band_value_in_many_units(spark, monkeypatch):
    """Thirty edits of one text, most of them just too far from each other: units of two by two meet all of them."""
    monkeypatch.setattr(near_dedup, "UNIT", 2)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(240)]
    texts = []
    for i in range(30):
        copy = list(base)
        for at in rng.sample(range(0, 240, 4), rng.choice([2, 5, 6, 7])):
            copy[at] = f"x{i}_{at}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    wanted = groups_by_force(rows, 3, 85)
    assert 1 < len({r[2] for r in wanted}) < 30
    assert sorted(map(tuple, near_dedup.near_duplicates(documents(spark, rows)).collect())) == wanted


def test_shared_band_values_only(spark):
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.integers(0, 2**63, 2_000, dtype=np.uint64)) for _ in range(3)]
    regs = [near_dedup.registers_of(s) for s in (*sets, np.zeros(0, np.uint64))]
    regs.append(np.concatenate([regs[0][:50], regs[1][50:]]))
    rows = [(i, bytearray(r.tobytes()), 2_000) for i, r in enumerate(regs)]
    classes = spark.createDataFrame(rows, "cid long, registers binary, n_shingles long")
    held = defaultdict(set)
    for i, r in enumerate(regs):
        for band in range(near_dedup.REGISTERS // near_dedup.BAND):
            part = tuple(r[band * near_dedup.BAND : (band + 1) * near_dedup.BAND])
            if set(part) != {near_dedup.EMPTY}:
                held[band, part].add(i)
    wanted = {(b, c) for (b, _), cs in held.items() if len(cs) > 1 for c in cs}
    got = {(r.band, r.cid) for r in near_dedup.shared_bands(classes).collect()}
    assert got >= wanted and len(got - wanted) < 5


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2)
    for share in (0.2, 0.85):
        n = int(10_000 * share)
        a, b = both[:10_000], both[10_000 - n : 20_000 - n]
        regs = [near_dedup.registers_of(np.sort(x)) for x in (a, b)]
        found, used = near_dedup.estimate(regs[0][None], regs[1][None], np.array([10_000]))
        assert used[0] == near_dedup.REGISTERS
        assert abs(found[0] - n / (20_000 - n)) < 0.18


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = dict(map(tuple, near_dedup.components(edges).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {100: 90}


def test_pipeline_keeps_different_texts_of_one_id(spark):
    rng = random.Random(12)
    a, b, c, d, e = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(5))
    near_a, near_c = a + " end", c + " end"
    rows = [(1, a), (2, near_a), (2, b), (2, b), (3, near_a), (4, c), (4, near_c), (5, None), (5, None), (6, ""), (None, a), (None, a), (7, d), (7, e)]
    docs = spark.createDataFrame([(d, t, "en", f"s{i}", len(t or "")) for i, (d, t) in enumerate(rows)], DOCS).repartition(3)
    got = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    assert all(r.n_chars == len(r.text or "") for r in got)
    found = Counter((r.doc_id, r.text) for r in got)
    # either text of id 4 may stand for its group, but only one
    assert (found.pop((4, c), 0), found.pop((4, near_c), 0)) in {(0, 1), (1, 0)}
    assert found == {(1, a): 1, (2, b): 1, (5, None): 1, (6, ""): 1, (None, a): 2, (7, d): 1, (7, e): 1}
    assert next(r.source for r in got if r.text == b) == "s2"


# --- suffix-array dedup ------------------------------------------------------------------------


def cut_by_force(rows, span=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            first[b[i : i + span]] = min(d, first.get(b[i : i + span], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark):
    rng = random.Random(3)
    bases = ["".join(rng.choice("ab \n") for _ in range(300)) for _ in range(4)]
    rows = []
    for d in rng.sample(range(800), 50):
        t, i, j = rng.choice(bases), rng.randrange(300), rng.randrange(300)
        rows.append((d, t[:i] + rng.choice(["", "é", "xx"]) + t[j:] + rng.choice(bases)[rng.randrange(300) :]))
    rows += ODD
    got = suffix_dedup.remove_repeats(documents(spark, rows))
    assert sorted(map(tuple, got.collect())) == cut_by_force(rows)


def test_pipeline_hands_texts_over_in_small_batches(spark, monkeypatch):
    sizes = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def seen(batches):
        for batch in batches:
            sizes[0].add(batch.num_rows)
            sizes[1].add(batch.num_rows > corpus_pipeline.BATCH)
            yield batch

    docs = spark.range(2_500, numPartitions=1).selectExpr("id doc_id", "'a' text", "'en' lang", "'s' source", "1L n_chars")
    through = lambda d, *_, **__: d.mapInArrow(seen, docs.schema)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs)
    monkeypatch.setattr(quality_rules, "judge_documents", through)
    monkeypatch.setattr(quality_classifier, "score_documents", through)
    monkeypatch.setattr(quality_classifier, "fit_quality", lambda *_: None)
    rules, classifier, *_ = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [rules, classifier, ("last", lambda _, d, __: d)])
    before = spark.conf.get(stages.BATCH_ROWS)
    assert corpus_pipeline.run(spark, "").count() == 2_500
    assert [s.value for s in sizes] == [5_000, 0] and spark.conf.get(stages.BATCH_ROWS) == before


def test_pipeline_cuts_every_row_by_itself(spark):
    rng = random.Random(13)
    a, b, c, d = ("".join(rng.choices("abcdefgh é", k=90)) for _ in range(4))
    rows = [(1, a), (2, b + a), (2, c + a), (3, d), (None, b + d), (None, b + d), (None, c), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)
    got = corpus_pipeline.suffix_dedup_stage(spark, docs, "").collect()
    assert all(r.n_chars == len(r.text or "") for r in got)
    want = [(1, a), (2, b), (2, c), (3, d), (None, ""), (None, ""), (None, ""), (4, None)]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def test_blind_trie_orders_and_merges():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)]
    trie = suffix_dedup.BlindTrie(12)
    for i, s in enumerate(strings):
        trie.insert(s, i)
    leaves = list(trie.ordered())
    assert [strings[m[0]] for m in leaves] == sorted(set(strings))
    assert all(len({strings[i] for i in m}) == 1 for m in leaves) and sum(map(len, leaves)) == 300


# --- packing -------------------------------------------------------------------------------------


def test_byte_bpe_equals_the_tokenizer():
    reference, mine = Tokenizer.from_file(BYTE_BPE), ByteBpe(BYTE_BPE)
    texts = [t or "" for _, t in near_copies()] + [
        "a  b", " lead", "trail ", "a\n b", "a \nb", "a\n  b", "\t\t", "it's we'LL 12x", "x<|endoftext|> y", "²½ ok", "🙂 🙂"]
    for t in texts:
        ids = reference.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == ids, repr(t)


def test_byte_bpe_takes_whole_texts(monkeypatch):
    """Usual texts need no dictionary; long ones, later letters and special tokens take it. The ids are the tokenizer's either way."""
    reference, mine = Tokenizer.from_file(BYTE_BPE), ByteBpe(BYTE_BPE)
    rng, cut = random.Random(4), []
    by_pieces = mine.by_pieces
    monkeypatch.setattr(mine, "by_pieces", lambda t: cut.append(t) or by_pieces(t))
    common = [*" \n\t\x1c\x85\xa0'1\xb2a\xe9<|", "ll", "'re", " the"]
    usual = ["".join(rng.choice(common if i % 2 else [chr(c) for c in range(0x590)]) for _ in range(rng.randrange(60))) for i in range(600)]
    odd = ["a \u4e2d\u6587", "x<|endoftext|> y", "a" + " \n" * 60_000 + "b"]
    for t in usual + odd:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t[:80])
    assert cut == odd


def test_packing(spark):
    rows = [*near_copies(), (950, "word " * 5_000)]
    got = packing.pack_documents(spark, documents(spark, rows), BYTE_BPE, 64).toPandas()
    reference = Tokenizer.from_file(BYTE_BPE)
    total = 0
    for d, t in rows:
        ids = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        mine = got[got.doc_id == d].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length.iloc[1:] == 64).all()
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.05 * -(-total // 64) + 1


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    histogram = Counter(rng.randrange(1, 101) for _ in range(500))
    plan = packing.plan_best_fit(histogram, 100)
    rooms = []
    for n in sorted(histogram.elements(), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(100 - n)
    assert plan.sequences == len(rooms)


# --- sharding --------------------------------------------------------------------------------------


def test_capacity_is_smallest(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(1, 50) for _ in range(60)] + [400]
    rng.shuffle(sizes)
    keys = sorted(rng.getrandbits(64) for _ in sizes)
    rows = [(k - 2**64 if k >= 2**63 else k, s) for k, s in zip(keys, sizes)]
    groups = spark.createDataFrame(rows, "key long, size long")
    cuts, capacity = sharding.minimax_cuts(groups, 5)

    def fits(c):
        n, used = 1, 0
        for s in sizes:
            if s > c:
                return False
            n, used = (n, used + s) if used + s <= c else (n + 1, s)
        return n <= 5

    assert fits(capacity) and not fits(capacity - 1)
    shards = Counter()
    for k, s in zip(keys, sizes):
        shards[sum(k >= c for c in cuts)] += s
    assert max(shards.values()) == capacity and sum(shards.values()) == sum(sizes)


def test_shards_hold_groups_and_slots(spark):
    rows = near_copies()
    got = sharding.shard_documents(documents(spark, rows), 7).toPandas().merge(
        documents(spark, rows).toPandas()[["doc_id", "text"]], on="doc_id")
    assert len(got) == len(rows)
    assert got.groupby(got.text.fillna("")).shard.nunique().max() == 1
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))


# --- WARC ------------------------------------------------------------------------------------------


def test_archives_come_back(spark):
    big = "<p>" + "é" * 800
    rows = [(1, "http://a.org/x", big), (7, "http://a.org/x", big), (3, None, big), (4, "HTTP://B.org", None), (5, "http://a.org/y z", "s"),
            (6, "http://a.org/y", "s"), (7, "http://a.org/x", big), (None, "http://c.org/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index, captures = warc.archive_pages(spark, pages)
    got = warc.fetch(spark, index, captures, payloads=True).collect()
    want = sorted((p is None, p or 0, (h or "").encode()) for p, _, h in rows)
    full = {hashlib.sha1(big.encode()).hexdigest(): big.encode()}
    assert sorted((r.page_id is None, r.page_id or 0, full[r.digest] if r.type == "revisit" else bytes(r.payload)) for r in got) == want
    kinds = {r.page_id: (r.type, r.refers_to) for r in got}
    assert kinds[1] == kinds[3] == ("revisit", 7)
    assert kinds[7] == kinds[5] == kinds[6] == kinds[None] == ("response", None)
    reader = warc.IndexReader(index)
    assert len(reader.captures_of("http://a.org/x")) == 3 and reader.captures_of("http://none.org/") == []


def test_index_finds_keys_across_blocks(spark, tmp_path):
    keys = [f"org,h{i % 7})/p {i:020d}" for i in range(500)]
    rows = spark.createDataFrame([(k, "f", i, 1) for i, k in enumerate(keys)], warc.CAPTURES)
    reader = warc.IndexReader(warc.build_index(rows, str(tmp_path / "index"), block_lines=10))
    assert all([k for k, *_ in reader.scan(k, k)] == [k] for k in keys)
    assert len(list(reader.scan("org,h3)/p ", "org,h3)/p ~"))) == len(keys[3::7])


# --- URLs --------------------------------------------------------------------------------------------


def test_url_rules_and_list(spark):
    rows = [(1, "http://www.Example.ORG/en/12?x#y"), (2, "https://a.b.com/fr/1"), (3, "https://b.com/de/"), (4, None), (5, "no scheme"),
            (6, "http://m.bad.net/p/?utm_source=q"), (7, "https://bad.net/p"), (8, "http://org/a"), (9, "http://notexample.org/es/1"), (7, "https://bad.net/p")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("bad.net/p",), ("b.com/de",)], "canonical string")
    got = url_filter.judge_urls(spark, pages, listed, URL_RULES).collect()
    found = {r.page_id: (r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert found == {1: ("example.org/en/1", "block"), 2: ("com/fr/", "allow"), 3: ("com/de/", "block"), 4: (None, "allow"), 5: (None, "allow"),
                     6: (None, "block"), 7: (None, "block"), 8: ("org/", "allow"), 9: ("org/", "allow")}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5_000).select(F.xxhash64("id").alias("h"))
    bloom = url_filter.BlockedBloom.build(keys, "h")
    known = keys.toPandas()["h"].to_numpy()
    others = spark.range(5_000, 25_000).select(F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    assert bloom.may_hold(known).all() and bloom.may_hold(others).mean() < 0.02


# --- quality -----------------------------------------------------------------------------------------


def base_by_force(text):
    words = (text or "").encode().split()
    triples = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside))


def test_base_counts(spark):
    rows = [*near_copies(), (950, "a b c\na b c\n\nx # <y>\na b c"), (951, "q " * 40)]
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.judge_documents(documents(spark, rows)).collect()}
    assert got == {d: base_by_force(t) for d, t in rows}


def test_divergent_documents_go(spark):
    rng = random.Random(6)
    def text(form):
        return " ".join(form(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choices("abcdefg", k=6))) for _ in range(200))
    rows = [(i, text(str)) for i in range(60)] + [(100, text(str.upper)), (101, text(lambda w: w + "%%"))]
    got = {r.doc_id: r for r in quality_rules.judge_documents(documents(spark, rows)).collect()}
    assert all(got[i].kept for i in range(60))
    assert not got[100].kept and not got[101].kept and not got[100].base_failed
    assert quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)


def test_texts_without_the_words_of_their_language_go(spark):
    rng = random.Random(11)
    stop = {
        "en": "the of and to a in is that it for was on with be by as this are at from".split(),
        "de": "der die und in den von zu das mit sich auf des für ist nicht dem im ein eine als".split(),
        "fr": "de la le et les des en un du une que pour est qui par dans sur au pas avec".split(),
    }

    def prose(lang, n, share=0.27):
        weights = [1 / (i + 2) for i in range(20)]
        return " ".join(rng.choices(stop[lang], weights)[0] if rng.random() < share else "".join(rng.choices("aeinrstl", k=7)) for _ in range(n))

    # language, text, kept
    rows = [(lang, prose(lang, rng.choice([80, 120, 200, 800])), True) for lang in stop for _ in range(120)]
    rows += [(lang, prose(other, n), False) for lang in stop for other in stop if lang != other for n in (150, 400)]
    rows += [(lang, prose("en", n, share=0), False) for lang in [*stop, None] for n in (80, 150, 400)]
    rows += [(None, prose(lang, 200), True) for lang in stop] + [("xx", prose("fr", 200), True)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (lang, t, _) in enumerate(rows)], DOCS).repartition(3)
    got = {r.doc_id: r for r in quality_rules.judge_documents(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [(lang, len(t.split())) for i, (lang, t, kept) in enumerate(rows) if got[i].kept != kept] == []


def test_rare_common_words_may_be_missing():
    counts = {b"x": 5}
    sparse = quality_rules.Reference.of(np.zeros(8), counts, 1_000)
    found = Counter([b"w%d" % i for i in range(100)])
    assert not quality_rules.lacks_words(sparse.bare, found, 100, sparse, [sparse])


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(8)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}###" for i in range(40)]
    rows = [(i, " ".join(rng.choices(good if i % 3 else bad, k=60))) for i in range(400)] + ODD
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int")
    docs = documents(spark, rows)
    model = quality_classifier.fit_quality(docs, labels)
    got = quality_classifier.score_documents(docs, model).join(labels, "doc_id").withColumn("held", quality_classifier.held_out()).toPandas()
    held = got[got.held]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.97 and got.score.between(0, 1).all()
    none = quality_classifier.fit_quality(docs, labels.limit(0))
    assert {round(r.score, 3) for r in quality_classifier.score_documents(docs, none).collect()} == {0.5}


# --- neighbours ----------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1_000 + i, rows[20][1]) for i in range(30)]
    odd = [(2_000, None), (2_020, [0.0] * 16), (2_040, [float("nan")] * 16), (2_060, [1.0]), (2_080, [None] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3)
    got = learned_ann.search(table, table.where("vec_id % 20 = 0"), 20).toPandas()
    ids, all_vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    hits = 0
    queries = [i for i in range(len(rows)) if ids[i] % 20 == 0]
    assert sorted(got.query_id.unique()) == sorted(ids[queries])
    for i in queries:
        score = (all_vectors * all_vectors[i]).sum(axis=1)
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert list(zip(-mine.score, mine.vec_id)) == sorted(zip(-mine.score, mine.vec_id))
        hits += len(set(ids[best]) & set(mine.vec_id))
    assert hits / (20 * len(queries)) >= 0.9


def neighbours_by_force(rows, queries, k):
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for q in queries:
        score = (vectors * vectors[ids == q][0]).sum(axis=1)
        order = np.lexsort((ids, -score))
        out[q] = ids[order][ids[order] != q][:k].tolist()
    return out


@pytest.mark.parametrize("n", [1, 15, 21])
def test_small_tables_come_back_whole(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 8)).astype(np.float32))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in learned_ann.search(table, table, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert {q: got[q] for q in range(n)} == neighbours_by_force(rows, range(n), 20)


def test_queries_go_on_until_they_have_enough_rows(spark):
    """One id is held by most rows, which are no candidates of its query and fill the part it is sent to."""
    rng = np.random.default_rng(5)
    rows = [(7, rng.normal(size=8).astype(np.float32).tolist())] * 400
    rows += [(1_000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)).astype(np.float32))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = table.where("vec_id >= 1000").unionByName(spark.createDataFrame(rows[:1], table.schema))
    got = Counter(r.query_id for r in learned_ann.search(table, queries, 20).collect())
    assert got == {q: 20 for q in [7, *range(1_000, 1_040)]}


def test_copies_do_not_set_the_probes():
    """With most of the sample copies, the others' neighbours are found as well."""
    rng = np.random.default_rng(9)
    vectors = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 1_500, axis=0), rng.normal(size=(500, 16))])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    router = learned_ann.fit_router(vectors, 16, 20)
    own = np.arange(1_500, 2_000)
    truth = router.part(vectors)[learned_ann.top_neighbours(vectors, vectors[own], own, 20)]
    visited = router.best(vectors[own], router.probes)
    assert (truth[:, :, None] == visited[:, None, :]).any(axis=2).mean() >= 0.95


# --- SentencePiece ---------------------------------------------------------------------------------------


def test_sentencepiece_parity_and_decoding(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [*near_copies(groups=4), (950, "a   b  c"), (951, " lead trail "), (952, "tab\tnew\nline 🙂 中文")]
    with open(path, "rb") as f:
        model = f.read()
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sentence_pieces.encode_documents(documents(spark, rows), model, ids=True)
    texts = dict(rows)
    for r in encoded.collect():
        assert r.parity and list(r.ids) == reference.encode(texts[r.doc_id] or ""), texts[r.doc_id]
        assert r.round_trip == ("▁" not in (texts[r.doc_id] or ""))
    for r in sentence_pieces.decode_documents(encoded, model).collect():
        if "▁" not in (texts[r.doc_id] or ""):
            assert r.text == (texts[r.doc_id] or "")


def _field(number, value):
    if isinstance(value, bytes):
        return bytes([number << 3 | 2, len(value)]) + value
    return bytes([number << 3 | 5]) + struct.pack("<f", value) if isinstance(value, float) else bytes([number << 3, value])


def test_unigram_model_keeps_its_scores():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁a", -3.2, 1), ("c", -6.0, 1)]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    data += _field(2, _field(3, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0))
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    tokenizer = sentence_pieces.rebuild(sentence_pieces.PieceModel.parse(data))
    for text in ("ab", "a b", "abc ab", "cab  ba", "aabb"):
        assert tokenizer.encode(text).ids == reference.encode(text), text


# --- empty tables ------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = documents(spark, ODD[:1]).where("false")
    assert near_dedup.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert packing.pack_documents(spark, none, BYTE_BPE).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert quality_rules.judge_documents(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.score_documents(none, quality_classifier.fit_quality(none, labels)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index, captures = warc.archive_pages(spark, pages)
    assert warc.fetch(spark, index, captures).count() == 0
    assert url_filter.judge_urls(spark, pages, spark.createDataFrame([], "canonical string"), URL_RULES).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert learned_ann.search(vectors, vectors).count() == 0


def test_fine_registers_part_pairs_at_the_threshold_from_those_below():
    """Pairs at 85 % pass the second estimate, pairs at 70 % do not."""
    rng = np.random.default_rng(3)
    for n in (150, 2_000):
        for ratio, wanted in ((0.85, True), (0.70, False)):
            for _ in range(50):
                common = int(np.ceil(2 * n * ratio / (1 + ratio)))
                x = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
                a, b = (np.unique(p) for p in (x[:n], x[n - common :]))
                fine = [near_dedup.registers_of(p, near_dedup.FINE_BITS)[None] for p in (a, b)]
                assert near_dedup.near_enough(*fine, np.array([n]), n, 85)[0] == wanted


def test_kept_only_gives_the_kept_rows_with_their_texts(spark):
    """Language and text among the carried columns, more rows than a slice, NULLs, empty input."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    at = max(r["doc_id"] for r in given) + 1
    data = [(r["doc_id"] + at * k, r["text"], r["lang"]) for k in range(1 + 1100 // len(given)) for r in given]
    data += [(at * 2000, None, "en"), (at * 2000 + 1, "", None), (at * 2000 + 2, "buy now " * 60, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").coalesce(1)
    judged = quality_rules.judge_documents(docs)
    kept = quality_rules.judge_documents(docs, columns=("doc_id", "text", "lang"), kept_only=True)
    wanted = {r["doc_id"] for r in judged.where("kept").collect()}
    got = kept.select("doc_id", "text", "lang").collect()
    assert 0 < len(wanted) < len(data) and len(got) == len(wanted) and len(data) > 1000
    assert {tuple(r) for r in got} == {d for d in data if d[0] in wanted}
    assert quality_rules.judge_documents(docs.limit(0), columns=("doc_id", "text", "lang"), kept_only=True).count() == 0
    labels = spark.createDataFrame([(d[0], int(d[0] in wanted)) for d in data], "doc_id long, quality int")
    model = quality_classifier.fit_quality(docs, labels)
    scored = quality_classifier.score_documents(docs, model)
    kept = quality_classifier.score_documents(docs, model, columns=("doc_id", "text", "lang"), kept_only=True)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in scored.where("predicted = 1").collect())
