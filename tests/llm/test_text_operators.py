"""The operators on texts against brute force, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from watchloom.llm import chat_tree, decontaminate, line_dedup, minhash, packing, skew, suffix_dedup, token_store
from watchloom.llm.kernel import window_min
from watchloom.llm.line_dedup import CuckooFilter, LineIndex
from watchloom.llm.store import Store
from watchloom.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
R = random.Random(5)
VOCABULARY = ["the", "of", "Straße", "été", "lorem", "ipsum", "dolor", "AB", "c3", "e", "señor", "x-y", "fin."] + [f"w{i}" for i in range(60)]


def sentence(n: int, r=R) -> str:
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


LINE = "a line that is long enough to count as one of these, 1234"
BASE, PASSAGE = sentence(140), sentence(60)
ROWS = [
    (1, BASE),
    (2, BASE),  # exact copy
    (3, BASE.replace("lorem", "LOREM")),  # equal but for case
    (4, BASE + " one more"),  # near copy
    (5, None),
    (6, ""),
    (7, "word"),
    (8, "word"),
    (9, f"{sentence(30)}\n{LINE}\n{sentence(20)}"),
    *[(10 + i, f"  {LINE.upper()}\t\n{sentence(10)}\n{LINE}") for i in range(6)],
    (20, sentence(300) + " " + PASSAGE + " " + sentence(300)),
    (21, PASSAGE + " " + sentence(40)),
    (22, "é" * 450 + "z" * 450),
    (23, "   \n\t  "),
    (24, sentence(20_000)),  # very long
    (25, "...!!!###"),
]


def frame(spark, rows=ROWS, clash=()):
    ddl = "doc_id long, text string" + "".join(f", {c} string" for c in clash)
    return spark.createDataFrame([(*r, *["own"] * len(clash)) for r in rows], ddl)


def collect(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def test_window_min_is_the_minimum_of_each_window():
    x = np.random.RandomState(1).randint(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 7, 64, 200):
        assert window_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(len(x) - w + 1)]


# --- near duplicates


@pytest.mark.parametrize("ngram", [2, 5])
def test_minhash_matches_all_pairs(spark, ngram):
    got = {d: (n, c) for d, n, c in collect(minhash.NearDuplicates(frame(spark), ngram).run(), "doc_id", "n_shingles", "component_id")}
    assert got == minhash.brute_force(ROWS, ngram)


@pytest.mark.parametrize("chunk", [2, 2048])
def test_minhash_links_a_chain_whose_ends_are_far_apart(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)  # buckets over a chunk go another way
    words = [f"u{i}" for i in range(400)]
    rows = [(100 + i, " ".join(words[20 * i : 20 * i + 200])) for i in range(8)]  # neighbours share 90 % of their words
    R.shuffle(rows)
    got = {d: c for d, c in collect(minhash.NearDuplicates(frame(spark, rows)).run(), "doc_id", "component_id")}
    assert got == {d: c for d, (_, c) in minhash.brute_force(rows).items()} and set(got.values()) == {100}


def test_minhash_edges(spark):
    rows = [(None, BASE), (1, BASE), (1, BASE), (3, None)]
    got = sorted(collect(minhash.NearDuplicates(frame(spark, rows)).run(), "doc_id", "component_id"), key=str)
    assert got == sorted([(1, 1), (1, 1), (3, 3), (None, None)], key=str)
    assert minhash.NearDuplicates(frame(spark, [])).run().count() == 0


def test_minhash_ties_the_texts_of_one_id(spark):
    other = sentence(90)
    rows = [(1, BASE), (3, other), (5, BASE), (5, other), (8, other), (9, sentence(50))]
    got = set(collect(minhash.NearDuplicates(frame(spark, rows)).run(), "doc_id", "component_id"))
    assert got == {(1, 1), (3, 1), (5, 1), (8, 1), (9, 9)}


@pytest.mark.parametrize("part", [3, 2048])
def test_minhash_compares_a_large_bucket_of_dissimilar_members_in_bounded_groups(spark, monkeypatch, part):
    monkeypatch.setattr(minhash, "CHUNK", 8)
    monkeypatch.setattr(skew, "PART", part)
    # one shingle is the least of all in most slots of every text: buckets of texts that are hardly alike, with pairs among them
    r, rows = random.Random(4), []
    for i in range(60):
        words = ["same"] * 8 + [f"v{i}-{j}" for j in range(3)]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join([*words, f"x{r.random()}"])))
    got = dict(collect(minhash.NearDuplicates(frame(spark, rows)).run(), "doc_id", "component_id"))
    assert got == {d: c for d, (_, c) in minhash.brute_force(rows).items()}


def test_minhash_dedup_keeps_one_of_each_group_and_other_columns(spark):
    out = minhash.dedup(frame(spark, clash=["n_shingles", "component_id"]))
    assert out.columns == ["doc_id", "text", "n_shingles", "component_id"]
    kept = {r.doc_id for r in out.collect()}
    assert 1 in kept and not kept & {2, 3, 4} and {5, 6, 23} <= kept


def test_superminhash_estimates_similarity():
    r = np.random.RandomState(2)
    x = r.randint(0, 2**63, 1000).astype(np.uint64)
    a, b = np.sort(x[:800]), np.sort(x[200:])
    low = minhash.superminhash(np.concatenate([a, b]), np.array([0, 800, 1600]))
    assert abs((low[0] == low[1]).mean() - 0.6) < 0.12
    tiny = minhash.superminhash(x[:3], np.array([0, 3]))
    assert (tiny < 2**63).all()  # every slot is filled, even from three elements


def test_parity_maps_never_rule_out_a_near_pair():
    r = np.random.RandomState(3)
    for n in (3, 40, 700, 9000):
        x = np.unique(r.randint(0, 2**63, n + n // 4).astype(np.uint64))
        a, b = x[:n], x[len(x) - n :]
        both = len(np.intersect1d(a, b))
        maps = minhash._maps([m.tobytes() for m in minhash.parity_maps(np.concatenate([a, b]), np.array([0, n, 2 * n]))])
        threshold = both / (2 * n - both)
        assert minhash._near(maps[:1], maps[1], np.array([n]), np.int64(n), threshold)[0]


# --- lines


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    docs = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            docs.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(docs[key(x)]) >= min_docs and d < max(docs[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_match_brute_force(spark):
    index = LineIndex.empty(spark).insert(frame(spark))
    out = index.apply(frame(spark, clash=["n_lines", "hi"]))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()} == brute_lines(ROWS)
    assert "hi" in out.columns and len(out.columns) == len(set(out.columns))


def test_lines_inserts_and_deletions_undo_each_other(spark):
    first, second = ROWS[:12], ROWS[12:]
    a = LineIndex.empty(spark).insert(frame(spark, first))
    both = a.insert(frame(spark, second))
    assert {r.doc_id: r.n_dropped for r in both.apply(frame(spark)).collect()} == {d: n for d, (_, n, _) in brute_lines(ROWS).items()}
    back = both.delete(frame(spark, second))
    assert sorted(collect(back.postings, "doc_id", "hi", "lo")) == sorted(collect(a.postings, "doc_id", "hi", "lo"))
    assert sorted(collect(back.counts, "hi", "refs", "last_doc")) == sorted(collect(a.counts, "hi", "refs", "last_doc"))
    assert {r.doc_id: r.n_dropped for r in back.apply(frame(spark, first)).collect()} == {d: n for d, (_, n, _) in brute_lines(first).items()}


def test_lines_of_one_document_touch_only_their_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LAYERS", 3)
    monkeypatch.setattr(line_dedup, "PROBE", 4)  # a shard's lines are dealt over parts
    lines = [f"{i} line that is long enough to be counted as one of them" for i in range(30)]
    held = [(i, "\n".join(lines[i : i + 6])) for i in range(25)]
    index = LineIndex.empty(spark).insert(frame(spark, held))
    before = dict(held)
    for step, row in enumerate([(50, "\n".join(lines[:3])), (50, lines[7]), (3, lines[29]), (60, lines[2])]):
        index = index.insert(frame(spark, [row]))
        if len(index.changes) > 1:
            assert index.changes[-1].count() == index.levels[-1].count() == len(row[1].split("\n"))
        before[row[0]] = before.get(row[0], "") + "\n" + row[1]
        if step == 1:
            index = index.delete(frame(spark, [(4, None), (5, None)]))
            before = {d: t for d, t in before.items() if d not in (4, 5)}
    want = {}
    for d, t in before.items():
        for x in set(t.strip("\n").split("\n")):
            want.setdefault(x, set()).add(d)
    assert sorted(collect(index.counts, "refs", "last_doc")) == sorted((len(x), max(x)) for x in want.values())
    rows = list(before.items())
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in index.apply(frame(spark, rows)).collect()} == brute_lines(rows)


def test_lines_edges(spark):
    assert LineIndex.empty(spark).insert(frame(spark, [])).apply(frame(spark, [])).count() == 0
    rows = [(1, LINE)] * 6 + [(None, LINE)] * 6  # one document and no document
    assert [n for (n,) in collect(LineIndex.empty(spark).insert(frame(spark, rows)).apply(frame(spark, rows)), "n_dropped")] == [0] * 12


@settings(max_examples=20, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=3000), st.integers(0, 100))
def test_cuckoo_filter_forgets_nothing_but_what_is_deleted(keys, share):
    x = np.array(sorted(keys), np.uint64)
    f = CuckooFilter(len(x))
    f.insert(x)
    assert f.contains(x).all()
    gone = x[: len(x) * share // 100]
    f.delete(gone)
    assert f.contains(x[len(gone) :]).all()
    f.delete(x[len(gone) :])
    assert not f.table.any()


# --- substrings


def test_suffix_dedup_matches_brute_force(spark):
    want = {d: w for (d, _), w in zip(ROWS, suffix_dedup.brute_force([t for _, t in ROWS]), strict=True)}
    out = suffix_dedup.remove_repeats(frame(spark, clash=["spans", "d"]))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()} == want
    assert want[22][1] > 0  # runs of one byte repeat inside their own text


def test_suffix_dedup_repeated_rows_and_nulls(spark):
    rows = [(1, BASE), (1, BASE), (None, BASE), (None, None), (2, sentence(80))]
    got = sorted(collect(suffix_dedup.remove_repeats(frame(spark, rows)), "n_bytes", "n_removed"))
    n = len(BASE.encode())
    assert got == sorted([(n, n)] * 3 + [(0, 0), (len(rows[4][1].encode()), 0)])
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("group", [3, 2048])
def test_suffix_dedup_deals_a_large_group_over_arrays(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(skew, "PART", group)
    rows = [(i, f"{sentence(8, random.Random(i))} {BASE[:230 + i % 4]} {sentence(8, random.Random(i + 99))}") for i in range(14)]
    rows += [(i, f"{sentence(8, random.Random(i))}{BASE[40:280]}") for i in range(20, 24)]
    want = {d: w for (d, _), w in zip(rows, suffix_dedup.brute_force([t for _, t in rows]), strict=True)}
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_spans_come_from_groups_that_hold_all_occurrences(spark):
    rows = [*ROWS, *((100 + i, f"{sentence(6)} {PASSAGE} {sentence(6)}") for i in range(10))]
    data = {d: (t or "").encode() for d, t in rows}
    found = suffix_dedup.Repeats(frame(spark, rows))
    groups, covered = {}, {d: set() for d in data}
    for r in found.occurrences().collect():
        groups.setdefault((r.g1, r.g2, r.length), set()).add((r.d, r.lo))
        covered[r.d].update(range(r.lo, r.lo + r.length))
    for (_, _, n), places in groups.items():
        strings = {data[d][lo : lo + n] for d, lo in places}
        assert len(strings) == 1 and len(places) > 1 and n >= 200
        (x,) = strings
        at = set()
        for d, t in data.items():
            p = t.find(x)
            while p >= 0:
                at.add((d, p))
                p = t.find(x, p + 1)
        assert places == at  # all occurrences, not only neighbours
    want = {d: w for (d, _), w in zip(rows, suffix_dedup.brute_force([t for _, t in rows]), strict=True)}
    assert {d: len(c) for d, c in covered.items()} == {d: w[1] for d, w in want.items()}


@pytest.mark.parametrize("group", [256, 2048])
def test_suffix_dedup_of_one_passage_in_ten_thousand_rows(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    passage = " ".join(f"p{i}" for i in range(80))[:260]
    rows = [(i, f"{i:05d} {passage} {i * 7919 % 10007:05d}") for i in range(10_000)]
    out = suffix_dedup.remove_repeats(frame(spark, rows)).groupBy("n_removed", "n_spans").count().collect()
    want = suffix_dedup.brute_force([t for _, t in rows])
    assert sorted((r.n_removed, r.n_spans, r["count"]) for r in out) == sorted((a, b, sum(w[1:3] == (a, b) for w in want)) for a, b in {w[1:3] for w in want})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab\0", max_size=40), st.integers(1, 2)), min_size=1, max_size=6))
def test_intervals_are_the_maximal_repeats(rows):
    texts, times = [t.encode() for t, _ in rows], np.array([k for _, k in rows])
    sa = suffix_dedup.SuffixArray(texts, 3, times)
    got = set()
    for length, lo, hi in sa.maximal_repeats():
        places = frozenset((int(sa.own[p]), int(sa.at[p])) for p in sa.sa[lo : hi + 1])
        assert (length, places) not in got
        got.add((length, places))
    want, seen = set(), {}
    for i, t in enumerate(texts):
        for a in range(len(t)):
            for b in range(a + 3, len(t) + 1):
                seen.setdefault(t[a:b], set()).add((i, a))
    for s, places in seen.items():  # copies of a text are extended alike, but not over its ends
        left = {texts[i][a - 1] if a else ("start", i, k) for i, a in places for k in range(times[i])}
        right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else ("end", i, k) for i, a in places for k in range(times[i])}
        if sum(times[i] for i, _ in places) > 1 and len(left) > 1 and len(right) > 1:
            want.add((len(s), frozenset(places)))
    assert got == want


# --- packing and token files


def test_encoder_gives_the_library_s_ids():
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "Ab", "'s", "don't", "1", "é", "<|endoftext|>", "...", "Ü", "é", "中", "🙂", "ΑΣ", "İ", "x,"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [t or "" for _, t in ROWS]
    for path in (BYTE, WORD):
        e = Encoder(path)
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in e.encode(texts)] == want


def test_pack_is_whole_gapless_and_tight(spark):
    out = packing.pack(frame(spark, [*ROWS, (None, "null id"), (1, BASE)]), BYTE, size=256, with_ids=True).collect()
    by = {}
    for r in out:
        assert r.length == len(r.ids) <= 256 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    e = Encoder(BYTE)
    for d, t in ROWS[3:]:
        pieces = sorted((r.piece, r.start, r.ids) for r in out if r.doc_id == d)
        ids = [*e.encode([t or ""])[0].tolist(), 2]
        assert sum((p[2] for p in pieces), []) == ids and [p[1] for p in pieces] == [sum(len(q[2]) for q in pieces[:i]) for i in range(len(pieces))]
        assert all(len(p[2]) == 256 for p in pieces[1:])
    assert len(by) <= -(-sum(r.length for r in out) // 256) + 1
    assert packing.pack(frame(spark, []), BYTE).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=30))
def test_plan_uses_every_piece_once(histogram):
    used = {}
    for times, take in packing.plan(histogram, 64):
        assert times > 0 and sum(n * k for n, k in take.items()) <= 64
        for n, k in take.items():
            used[n] = used.get(n, 0) + k * times
    assert used == histogram
    placer = packing.Placer(packing.plan(histogram, 64))
    lengths = np.array([n for n, k in histogram.items() for _ in range(k)])
    ranks = np.array([i for k in histogram.values() for i in range(k)])
    s, o = placer.place(lengths, ranks)
    spots = {(int(a), int(b) + j) for a, b, n in zip(s, o, lengths, strict=True) for j in range(n)}
    assert len(spots) == lengths.sum()


def test_token_files_round_trip(spark):
    rows = [*ROWS, (None, "null id")]
    folder = Store(spark, "test-tokens").path("files")
    shards = token_store.write(frame(spark, rows), WORD, folder, sequence=64, shards=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read(shards).collect()}
    e, at = Encoder(WORD), 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        ids = np.append(e.encode([t or ""])[0], 1).astype("<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    import os

    named = {r.uri.rsplit("/", 1)[1] for r in shards.collect()}
    there = os.listdir(folder.removeprefix("file://"))
    assert {x.rsplit(".", 1)[0] for x in there} == named and len(there) == 2 * len(named)
    reader = token_store.ShardReader(shards.first().uri)
    ids, mask = reader.sequences(0)
    assert ids.shape == mask.shape and ids.shape[1] == 64 and not ids.flags.owndata
    assert token_store.read(token_store.write(frame(spark, []), WORD, folder + "-empty", shards=2)).count() == 0


def test_packing_and_token_files_of_repeated_rows_with_clashing_columns(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, None), (None, ""), (2, "w " * 30_000)]
    docs = frame(spark, rows, clash=["piece", "ids", "start", "sequence_id"])
    packed = packing.pack(docs, BYTE, with_ids=True).collect()
    assert sum(r.doc_id == 1 for r in packed) == 3 and sum(r.length for r in packed if r.doc_id == 2) == 1 + len(Encoder(BYTE).encode(["w " * 30_000])[0])
    back = token_store.read(token_store.write(docs, WORD, Store(spark, "test-clash").path("files"), shards=2)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in back) == sorted((str(d), 1 + len(Encoder(WORD).encode([t or ""])[0])) for d, t in rows)
    assert len({r.start for r in back}) == len(rows)


# --- decontamination


ITEMS = [(1, PASSAGE), (2, sentence(13)), (3, "two words"), (4, None), (5, "..."), (6, PASSAGE), (10, sentence(5))]


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_winnowing_finds_every_shared_window(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "BITS", bits)
    docs = [*ROWS, (30, f"x {ITEMS[1][1].upper()}! y {ITEMS[6][1]}, and Two, words")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.find(frame(spark, docs, clash=["spans"]), items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in out.collect()}
    want = {d: decontaminate.brute_force(t, ITEMS) for d, t in docs}
    assert got == want and want[20][1] >= 60 and want[30][2] == ["10", "2", "3"]
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in out.collect())


@pytest.mark.parametrize("part", [5, 2048])
def test_a_benchmark_as_large_as_the_documents(spark, monkeypatch, part):
    monkeypatch.setattr(skew, "PART", part)  # hot fingerprints are salted
    monkeypatch.setattr(decontaminate, "BITS", 1 << 15)
    r = random.Random(8)
    word = lambda: r.choice("abcd")  # noqa: E731  few words: fingerprints and windows that many rows share
    some = lambda: " ".join(word() for _ in range(r.randint(0, 60)))
    docs = [(i, some()) for i in range(60)] + [(100 + i, f"{PASSAGE} {some()}") for i in range(40)] + [(100, PASSAGE), (None, PASSAGE), (7, None)]
    items = [(i, some()) for i in range(60)] + [(200 + i, f"{sentence(3)} {PASSAGE}") for i in range(40)] + [(None, "d c b a d c b")]
    out = decontaminate.find(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    named = [("" if i is None else i, t) for i, t in items]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in out.collect())
    assert got == sorted((str(d), *decontaminate.brute_force(t, named)) for d, t in docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=13, max_size=60), st.integers(0, 47))
def test_winnowing_loses_no_window_of_repetitive_words(doc, at):
    data = np.frombuffer(" ".join(doc).encode(), np.uint8)
    _, _, h, _ = decontaminate.words(data, np.array([0, len(data)]))
    at = min(at, len(doc) - 13)
    from watchloom.llm.kernel import ngram_hashes

    prints = lambda x: {int(g) for g in ngram_hashes(x, 5)[decontaminate.fingerprints(x, 5, 9)]}
    assert prints(h[at : at + 13]) & prints(h)  # a shared window shares a fingerprint


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    out = decontaminate.decontaminate(frame(spark, clash=["n_words"]), items)
    assert out.columns == ["doc_id", "text", "n_words"]
    assert {r.doc_id for r in out.collect()} == {d for d, t in ROWS if not (lambda n, k: k and 20 * k >= n)(*decontaminate.brute_force(t, ITEMS[:1])[:2])}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark), none).count() == len(ROWS)
    assert decontaminate.decontaminate(frame(spark, []), items).count() == 0


# --- chats

CHATS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", "more"), (1, 3, "assistant", "yes <|im_end|>"),
    (2, 0, "user", "hello"), (2, 1, "assistant", "hi"), (2, 2, "user", "less"), (2, 3, "assistant", ""),
    (3, 0, "user", "hello"), (3, 1, "assistant", "hi"),
    (4, 1, "assistant", "b"), (4, 0, "user", r"<\\|im_start|> <\|x <||> \n"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a"),
    (5, None, None, None), (None, 0, "we\nird\\n<|im_end|>", "t"), (None, 1, "assistant", "z"),
    *[(100 + i, 0, "user", "hello") for i in range(30)],
]


def test_chat_tree_round_trip_and_sharing(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    for size, tokenizer in ((1 << 19, BYTE), (100, BYTE), (100, None)):
        tree = chat_tree.build(rows, tokenizer, size)
        got = {r.conv_id: r for r in chat_tree.read_back(tree, tokenizer).collect()}
        by = {}
        for c, t, role, text in CHATS:
            by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
        assert set(got) == set(by)
        for c, turns in by.items():
            turns = [(r, x) for _, r, x in sorted(turns)]
            loss = "".join(x for r, x in turns if r == "assistant")
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            g = got[c]
            assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
            assert g.formatted_chars == sum(len("".join(chat_tree.turn_parts(r, x))) for r, x in turns)
    nodes = [r for r in chat_tree.build(rows).where("kind = 'node'").collect()]
    assert sum("hello" in "".join(map(chr, r.ids)) for r in nodes) == 1  # shared by 33 conversations
    for r in nodes:
        assert r.position == sum(a.end - a.start for a in r.ancestors) and r.length == len(r.ids)
    assert chat_tree.read_back(chat_tree.build(rows.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("<|\\>\nim_endstar ", max_size=30), st.text("<|\\>\nim_endstar ", max_size=40)), max_size=4))
def test_template_is_undone_exactly(turns):
    assert chat_tree.parse("".join("".join(chat_tree.turn_parts(r, t)) for r, t in turns)) == turns


def test_shared_turns_are_emitted_once_whatever_the_partitions(spark):
    first = sentence(40)
    rows = [(i, 0, "user", first) for i in range(400)] + [(i, 1, "assistant", f"{i % 7} {sentence(3)}") for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tree = chat_tree.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE)
        assert tree.where("kind = 'node' AND parent = -1").count() == tree.select("pack").distinct().count() == 1
        small = chat_tree.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE, 10_000)
        packs = small.select("pack").distinct().count()
        assert packs > 3 and small.where("kind = 'node' AND parent = -1").count() == packs
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
