"""The operators of the subpackage against brute force on small fixtures of edge cases."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from voxloom.llm import byte_bpe, chat, components, html_text, imatch, jaccard_join, neighbours, packing, suffix_dedup, token_counts, toxicity
from voxloom.llm.suffix_array import permuted_common_prefixes, suffix_array

RNG = np.random.default_rng(5)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "été", "naïve", "x", "Yes,", "no.", "12", "a-b"]


def sentence(n):
    return " ".join(RNG.choice(WORDS, n))


def texts():
    base = sentence(60)
    words = base.split()
    near = [" ".join(w if i % 31 else "changed" for i, w in enumerate(words)), base + " tail", base.upper()]
    return [None, "", " \n ", "one", "one two three four", base, base, *near, sentence(40), "z" * 300, "🙂 é́ " * 30, sentence(3000), base[:200] + "\n\n" + sentence(5), "a\x00b  c\t"]


# columns with names that the operators use inside
DOCS = "doc_id bigint, text string, id int, block int, score double, part int, node bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, i, 0, 0.5, 1, 2) for i, t in enumerate(texts())]
    rows += [(None, "null id " + sentence(60), 0, 0, 0.5, 1, 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return df.select("doc_id", "text").collect()


# --- 1 ---


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def linked(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(spark, docs, empty):
    got = jaccard_join.op1(docs).collect()
    want = linked([tuple(r) for r in by_id(docs)])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.op1(empty).count() == 0


def test_jaccard_join_of_a_chain_of_copies(spark):
    words = [f"w{i}" for i in range(80)]
    rows, now = [], list(words)
    for i in range(40):  # each differs little from the one before, and the ends differ much
        rows.append((i, " ".join(now)))
        now[(i * 7) % 80] = f"n{i}"
    rows += [(100 + i, " ".join(f"q{i}_{j}" for j in range(30))) for i in range(5)] + [(200, rows[0][1]), (7, rows[30][1])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.op1(d).collect()
    assert len(got) == len(rows)
    # the two rows of document 7 stand for one document
    sets, ids = [shingles(t) for _, t in rows], [i for i, _ in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if ids[a] == ids[b] or 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [x if r == y else r for r in root]
    least = {r: min(i for i, q in zip(ids, root) if q == r) for r in root}
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, least[r]) for i, r in zip(ids, root))
    kept = jaccard_join.keep_one(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


@pytest.mark.parametrize("rounds, common", [(0, 2), (2, 4), (2, 16)])
def test_jaccard_join_across_bounds(spark, monkeypatch, rounds, common):
    """Blocks and groups of a few nodes; without leader rounds the blocks find every link."""
    for name, v in (("CHUNK", 900), ("BLOCK", 3000), ("GROUP_BYTES", 4000), ("BLOCK_NODES", 3), ("BLOCK_BYTES", 2000), ("COMMON", common)):
        monkeypatch.setattr(jaccard_join, name, v)
    rows = []
    for g in range(12):
        base = [f"w{g % 4}_{x}" for x in range(int(RNG.integers(20, 60)))]
        for k in range(6):
            words = list(base)
            for at in RNG.integers(0, len(base), int(RNG.integers(0, 4))):
                words[at] = f"n{g}_{k}_{at}"
            rows.append((100 * g + k, " ".join(words)))
    rows += [(5000 + i, " ".join(f"u{i}_{x}" for x in range(12)) + " and a line that very many of them have in common here") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    shared = jaccard_join.shared_shingles(d, 5, 0.75, "doc_id", "text")
    node = {r.id: r.node for r in jaccard_join.document_sets(d, 5, "doc_id", "text").collect()}
    root = {r.node: r.root for r in jaccard_join.links(shared, 0.75, rounds).collect()}
    want = linked(rows)
    for i in want:
        for j in want:
            assert (root.get(node[i], node[i]) == root.get(node[j], node[j])) == (want[i][1] == want[j][1])


def test_suffix_filter_is_an_upper_bound():
    for _ in range(300):
        x, y = (np.unique(RNG.integers(0, 60, RNG.integers(1, 40))) for _ in range(2))
        both = len(np.intersect1d(x, y))
        assert all(jaccard_join.most_in_common(x, y, k) >= both for k in range(5)) and jaccard_join.most_in_common(x, y, 20) <= min(len(x), len(y))
        if both:
            at, to = jaccard_join._first_common(x, y)
            assert x[at] == y[to] and jaccard_join.similar(x, y, len(x), len(y), at, to, 0.4) == (both >= int(np.ceil((len(x) + len(y)) * 0.4 / 1.4 - 1e-9)))


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 9), (6, 6)], "a bigint, b bigint")
    assert {r.node: r.root for r in components.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_made_for_polynomial_hashes(spark):
    """Such words agree modulo 2^64 under any base."""
    rows = [(i, thue_morse(n, i % 2)) for i, n in enumerate((1024, 1024, 2048, 2048, 4096, 4096))] + [(9, thue_morse(2048, 1))]
    got = {r.doc_id: r.component_id for r in jaccard_join.op1(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {**{i: i for i in range(6)}, 9: 3}


def test_piece_hashes_of_all_lengths():
    from voxloom.llm.hashing import piece_hashes

    data = np.frombuffer(bytes(range(1, 60)) + b"\0" * 30, np.uint8)
    spans = [(a, b) for a in range(len(data)) for b in range(a + 1, min(a + 27, len(data)) + 1)]
    start, end = np.array(spans).T
    one, two = piece_hashes(data, start, end), piece_hashes(data, start, end, 1)
    text = [data[a:b].tobytes() for a, b in spans]
    assert len(set(one.tolist())) == len(set(text)) == len(set(two.tolist())) and not set(one.tolist()) & set(two.tolist())
    assert len({(t, h) for t, h in zip(text, one.tolist())}) == len(set(text))


# --- 2 ---


def test_fold_events_and_round_trip(spark):
    log = [
        ("c", 1, 0, "delta", "user", "Hi \\ <|im_start|>"), ("c", 2, 1, "delta", "assistant", "Hel"), ("c", 3, 1, "delta", "assistant", "lo"),
        ("c", 4, 1, "regenerate", "assistant", "Bye"), ("c", 5, 1, "delta", "assistant", "!"), ("c", 6, 0, "edit", "user", "Edited <|im_end|>\n"), ("d", 1, 0, "delta", "a\nb", None), (None, 1, 0, None, None, ""),
    ]
    events = spark.createDataFrame(log, "conv_id string, seq int, message int, kind string, role string, text string")
    m = chat.fold_events(events)
    assert sorted((r.conv or "", r.message, r.role, r.text) for r in m.collect()) == [("", 0, "", ""), ("c", 0, "user", "Edited <|im_end|>\n"), ("c", 1, "assistant", "Bye!"), ("d", 0, "a\nb", "")]
    from pyspark.sql import functions as F

    back = chat.render(m).select("conv", chat.parse(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r.conv: ([tuple(t) for t in r.t], r.loss) for r in back}
    assert got["c"] == ([("user", "Edited <|im_end|>\n"), ("assistant", "Bye!")], "Bye!")
    assert got["d"] == ([("a\nb", "")], "") and got[None] == ([("", "")], "")


def test_op2_digests(spark):
    rows = [(1, 0, "user", "a\\|<|"), (1, 1, "assistant", "é🙂"), (1, 2, "assistant", None), (2, 5, None, "x")]
    got = {r.conv_id: r for r in chat.op2(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\\|<|\nassistant\né🙂\nassistant\n\n") and got[1].loss_chars == 2 and got[1].loss_sha256 == sha("é🙂")
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == sha("<|im_end|><|im_start|>assistant ok") and got[2].turns_sha256 == sha("\nx\n")


def test_op2_folds_its_rows_as_events(spark, monkeypatch):
    logs, fold = [], chat.fold_events
    monkeypatch.setattr(chat, "fold_events", lambda events, *a, **b: logs.append(events) or fold(events, *a, **b))
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "<|b"), (None, 0, None, None), (None, 1, "user", "c")]
    got = {r.conv_id: r for r in chat.op2(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert {(r.conv_id, r.seq, r.kind) for r in logs[0].collect()} == {(1, 0, "delta"), (None, 0, "delta"), (None, 1, "delta"), (-1, 0, "delta"), (-1, 1, "delta")}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"assistant\n<|b\nuser\na\nuser\na\n").hexdigest()
    assert got[None].n_turns == 2 and got[None].turns_sha256 == hashlib.sha256(b"\n\nuser\nc\n").hexdigest()


def test_op2_of_odd_tables(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, seq int, message string, kind string, conv int"
    long = "x\\<|" * 40_000
    rows = [(1, 0, "user", "b", 0, "m", "edit", 3), (1, 0, "user", "a", 0, "m", "edit", 3), (1, 0, "user", "a", 9, None, "regenerate", 3), (1, 1, "assistant", long, 0, "m", None, None), (2, None, "assistant", "<|nl|>\n", 0, "m", "edit", 3)]
    d = spark.createDataFrame(rows, kind)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat.op2(d).collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha(f"user\na\nuser\na\nuser\nb\nassistant\n{long}\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(long), sha(long)) and got[2].turns_sha256 == sha("assistant\n<|nl|>\n\n")
    assert [r.conv_id for r in chat.op2(d.limit(0)).collect()] == [-1]


# --- 3 ---


def test_neighbours(spark):
    x = RNG.normal(size=(400, 24))
    x[7], x[9] = x[0], x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [None] + [1.0] * 23, 1), (1100, [1.0], 1), (None, x[5].tolist(), 1), (3, x[3].tolist(), 1)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, block int")
    got = neighbours.op3(d).collect()
    hits = 0
    for q in (0, 100, 200, 300):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(400), dist)) if i != q][:10]
        own = [r for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert [r.rank for r in own] == list(range(1, 11)) and all(r.score == pytest.approx(dist[r.vec_id], abs=1e-12) for r in own)
        hits += len({r.vec_id for r in own} & set(want))
    assert hits >= 36 and {r.query_id for r in got} == {0, 100, 200, 300}
    few = neighbours.op3(d.where("vec_id IN (0, 7, 9)")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(1, 7), (2, 9)]
    assert neighbours.op3(d.where("vec_id > 999 AND vec_id < 1100")).count() == 0


def test_pigeonhole_finds_every_code_within_the_radius():
    codes = RNG.integers(0, 1 << 16, (500, 5)).astype(np.uint16)
    codes[:50] = codes[0] ^ (1 << RNG.integers(0, 16, (50, 5))).astype(np.uint16)
    tables = neighbours.Tables(codes)
    for i in range(0, 500, 25):
        distance = neighbours.hamming(codes, codes[i])
        for radius in (0, 1, 4, 5, 9, 10, 23, 40, 80):
            for prune in (True, False):
                assert tables.within(codes[i], radius, prune).tolist() == np.flatnonzero(distance <= radius).tolist()
    assert tables.prune(codes[:8], 4) and not tables.prune(codes[:8], 40)


def test_neighbours_do_not_depend_on_the_blocks(spark, monkeypatch):
    x = RNG.normal(size=(700, 32))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = []
    for rows in (30, 1 << 16):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", rows)
        got.append(sorted(map(tuple, neighbours.op3(d).collect())))
    assert got[0] == got[1] and len(got[0]) == 70
    near = {(q, int(i)) for q in range(0, 700, 100) for i in np.argsort(((x - x[q]) ** 2).sum(1))[1:11]}
    assert len({(r[0], r[2]) for r in got[0]} & near) >= 63  # recall of 0.9


# --- 4 ---


def test_fingerprints(spark, docs, empty):
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in by_id(docs)), key=lambda r: (r[0], r[1] or 0))
    got = {r.doc_id: r for r in imatch.op4(docs).collect()}
    for (_, i, t), (_, _, n) in zip(rows, rows[1:] + rows[:1]):
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(imatch.edited(t, n).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same: dict = {}
    for _, i, t in rows:
        same.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert imatch.op4(empty).count() == 0
    one = imatch.op4(spark.createDataFrame([(5, "a b c d")], "doc_id bigint, text string")).first()
    assert one.n_chars == 7 and one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()


def plain_fingerprints(texts, looked):
    """The method word by word, in Python integers: sets of terms, their document frequencies, the band, 64 subsets."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def term(w):
        pieces = [int.from_bytes(w[i : i + 8], "little") for i in range(0, len(w), 8)]
        return mix(sum(mix(v ^ mix((2 * k + 0xD6E8FEB86659FD93) & mask)) for k, v in enumerate(pieces)) + mix(len(w)) & mask)

    terms = lambda t: set(re.findall(rb"[^\x20\x09-\x0d]+", t.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))))
    df = Counter(w for t in texts for w in terms(t))
    n = len(texts)
    band = {w for w, c in df.items() if max(2.0, 0.001 * n) <= c <= max(2.0, 0.1 * n)}
    out = []
    for t in looked:
        kept = sorted(map(term, terms(t) & band or terms(t)))
        code = []
        for s in range(64):
            rate = (2, 4, 6, 7, 8, 9, 10, 11)[s // 8]
            total = sum(mix(h) for h in kept if mix((h + 0x51ED270B * (s + 1)) & mask) % (1 << rate) == 0) & mask
            code.append(mix(total) >> 48 | 1 if total else 0)
        out.append(code)
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    groups = [[(x == y) for x, y in zip(a[i : i + 8], b[i : i + 8]) if x or y] for i in range(0, 64, 8)]
    full = [sum(g) / len(g) for g in groups if len(g) >= 4]
    return max(full) if full else sum(map(sum, groups)) / sum(map(len, groups))


def test_fingerprints_against_plain_ones(spark):
    rows = sorted((i, sentence(int(RNG.integers(0, 40))) + f" rare{i % 40} Rare{i % 15} own{i}") for i in range(60)) + [(100, ""), (101, "été 🙂 rare3"), (102, None)]
    texts = [t or "" for _, t in rows]
    news = [imatch.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    want, changed = plain_fingerprints(texts, texts), plain_fingerprints(texts, news)
    text = lambda code: "".join(f"{x:04x}" for x in code)
    got = {r.doc_id: r for r in imatch.op4(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    for k, (i, _) in enumerate(rows):
        assert got[i].fingerprint == text(want[k]) and got[i].edited_fingerprint == text(changed[k])
        assert got[i].near_edited == pytest.approx(plain_likeness(want[k], changed[k])) and got[i].near_next == pytest.approx(plain_likeness(want[k], want[(k + 1) % len(rows)]))


# --- 5 ---


def removed(rows):
    first, out = {}, {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows if i is not None):
        cover = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                cover[p : p + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        out[i] = (len(t), int(cover.sum()), int((cover & ~np.concatenate(([False], cover[:-1]))).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, empty):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op5(docs).collect()}
    null = got.pop(None)
    assert got == removed([tuple(r) for r in by_id(docs)]) and null[1] == 0
    assert suffix_dedup.op5(empty).count() == 0
    kept = suffix_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {r.doc_id: r.text is None for r in kept.collect()} == {r.doc_id: r.text is None for r in by_id(docs)}


def test_suffix_dedup_of_repeated_ids(spark):
    t = sentence(40)
    d = spark.createDataFrame([(2, t), (2, t), (2, t + " more"), (3, "x " + t)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_removed > 0) for r in suffix_dedup.op5(d).collect())
    assert got == [(2, False), (2, False), (2, False), (3, True)]


@pytest.mark.parametrize("hot", [0, 3, 10**9])
def test_suffix_dedup_across_bounds(spark, monkeypatch, hot):
    """Blocks, chunks and homes of a few documents, and minimisers that are all, partly or never dealt by what is around them."""
    for name, v in (("CHUNK", 1500), ("BLOCK", 4000), ("HOME_BYTES", 5000), ("HOT", hot)):
        monkeypatch.setattr(suffix_dedup, name, v)
    line, long = "permission is granted to any person who gets a copy of this", sentence(200)
    rows = [(int(i), f"{sentence(int(RNG.integers(0, 30)))} {line} {sentence(int(RNG.integers(0, 30)))}") for i in RNG.permutation(120)]
    rows += [(200 + i, long[7 * i : 7 * i + 400]) for i in range(20)] + [(300, "a" * 700), (301, "a" * 900 + "b"), (302, "ab" * 300), (303, "ab" * 200 + "c"), (304, None), (305, long), (306, long), (306, long)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op5(d).collect()}
    assert got == {(i, *v) for i, v in removed(rows[:-1]).items()}


def test_suffix_dedup_where_minimisers_hash_alike(spark, monkeypatch):
    """Contents are told apart by hashes of their own: eight bits of the minimiser are enough for right results."""
    for name, v in (("CHUNK", 1500), ("BLOCK", 4000), ("HOME_BYTES", 5000), ("_LOW", np.uint64(255))):
        monkeypatch.setattr(suffix_dedup, name, v)
    line = "permission is granted to any person who gets a copy of this"
    rows = [(i, f"{sentence(int(RNG.integers(5, 40)))} {line if i % 3 else ''} {sentence(int(RNG.integers(5, 40)))}") for i in range(120)] + [(200 + i, sentence(40)) for i in range(4)] * 2
    rows = [(i, t) for i, t in dict(rows).items()] + [(400 + i, t) for i, t in rows[::7]]
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op5(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == {(i, *v) for i, v in removed(rows).items()}


def test_contents_that_agreed_in_forty_bits(spark):
    line = "xtiovbqqozttxlajyava"
    pair = [f"dsrzqofbugvfzygzwspu{line}kpswwakoxqpwwwsxofs", f"kawbtuoychzeqaoxbial{line}zdbrhfnqhpqffwzyfwah"]
    rows = list(enumerate(pair, 1))
    got = suffix_dedup.op5(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2, "doc_id")).collect()
    assert [r.n_removed for r in got] == [0, 0]
    bits = lambda text: suffix_dedup.stretches(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[4] & np.uint64((1 << 40) - 1)
    assert set(bits(pair[0]).tolist()).isdisjoint(bits(pair[1]).tolist())


def test_parts_of_equal_strings_have_equal_keys():
    data = np.frombuffer((sentence(80) + "a" * 120 + sentence(80)).encode(), np.uint8)
    both = np.concatenate((data, data[100:-60]))
    bounds = np.array([0, len(data), len(both)])
    row, start, size, *_ = suffix_dedup.stretches(both, bounds)
    nth, begin, n, key = suffix_dedup.parted(both, start, size)
    of = {int(p): int(k) for s, m, k in zip(begin, n, key) for p in range(s, s + m - 49)}
    assert sorted(of) == [p for a, b in zip(bounds, bounds[1:]) for p in range(a, b - 49)]
    assert all(of[100 + p] == of[len(data) + p] for p in range(len(both) - len(data) - 49)) and len(set(of.values())) > 20


def test_stretches_take_little_memory_beside_the_text(monkeypatch):
    import tracemalloc

    rows = np.random.default_rng(1).integers(97, 123, (2000, 1000)).astype(np.uint8)
    data, bounds = rows.ravel(), np.arange(2001) * 1000

    def traced():
        tracemalloc.start()
        row, start, size, *rest = suffix_dedup.stretches(data, bounds)
        parts = suffix_dedup.parted(data, start, size)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, [row, start, size, *rest, *parts]

    suffix_dedup.span_hashes(data[:50], np.arange(1), np.arange(1, 2))  # the tables of powers, once
    most, got = traced()
    monkeypatch.setattr(suffix_dedup, "STEP", 1 << 30)
    at_once, want = traced()
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, want))
    assert most < 60 * len(data) < at_once


def test_long_runs_take_little_time():
    import time

    t = time.process_time()
    two = np.concatenate((np.full(10**6, 97, np.uint8), np.full(10**6, 98, np.uint8)))
    sa = suffix_array(two)
    assert time.process_time() - t < 5 and sorted(sa.tolist()) == list(range(len(two)))
    b = two.tobytes()
    assert all(b[x : x + 50] <= b[y : y + 50] for x, y in zip(sa[::9973], sa[9973::9973]))
    for n in (120, 260):
        d = np.repeat(RNG.integers(0, 3, 12), RNG.integers(1, n // 4, 12)).astype(np.uint8)
        sa, b = suffix_array(d, 10).tolist(), d.tobytes()
        assert sorted(sa) == list(range(len(d))) and [b[i : i + 10] for i in sa] == sorted(b[i : i + 10] for i in range(len(d)))


def test_suffix_array():
    for n in (1, 2, 30, 200):
        for k in (1, 2, 5):
            d = RNG.integers(0, k, n).astype(np.uint8)
            b = d.tobytes()
            sa = suffix_array(d, 10**9)
            assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
            flags = permuted_common_prefixes(d, sa, 10)
            assert all(flags[y] == (b[x : x + 10] == b[y : y + 10] and min(n - x, n - y) >= 10) for x, y in zip(sa, sa[1:]))


# --- 6, 7 ---


def test_token_counts(spark, docs, empty):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    one = sentencepiece.SentencePieceProcessor(model_file=model)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op6(docs, model, 100).collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()), n := len(one.encode(r.text or "")), n > 100) for r in by_id(docs))
    assert token_counts.op6(empty, model).count() == 0


def test_byte_bpe(spark, docs, empty):
    import tiktoken

    ranks = P.path("byte_bpe_50k.tiktoken")
    one = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={}).encode_ordinary
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op7(docs, ranks, P.PATTERN).collect()}
    assert got == {r.doc_id: (len(i := one(r.text or "")), sha(np.array(i, "<u4").tobytes()), sha((r.text or "").encode())) for r in by_id(docs)}
    back = byte_bpe.decode(byte_bpe.encode(docs, ranks, P.PATTERN), ranks).collect()
    assert {r.id: bytes(r.decoded) for r in back} == {r.doc_id: (r.text or "").encode() for r in by_id(docs)}
    assert byte_bpe.op7(empty, ranks, P.PATTERN).count() == 0


# --- 8 ---


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = min((b for b in bins if b >= n), default=None)
        if room is None:
            bins.append(capacity - n)
        else:
            bins.remove(room)
            bins.append(room - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    for _ in range(100):
        capacity = int(RNG.choice([7, 20, 64]))
        lengths = RNG.integers(1, capacity + 1, RNG.integers(0, 150)).tolist()
        used: dict = {}
        for n, _, count, first, each, offset in packing.plan(Counter(lengths), capacity):
            for x in range(count):
                used.setdefault(first + x // each, []).append((offset + x % each * n, n))
        for b in used.values():
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in b) for b in used.values()) == best_fit(lengths, capacity)


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    one = Tokenizer.from_file(path)
    got = packing.op8(docs, path).collect()
    places: dict = {}
    want = []
    for r in by_id(docs):
        ids = [*one.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(r.doc_id, k, 2048 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(ids[i : i + 2048] for i in range(0, len(ids), 2048))]
    assert Counter(want) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(places) == len(best_fit([w[3] for w in want], 2048))
    for b in places.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.op8(empty, path).count() == 0


@pytest.mark.parametrize("room", [None, (40, 200)])
def test_word_ids_are_those_of_the_library(monkeypatch, room):
    import pyarrow as pa
    from tokenizers import Tokenizer

    if room:  # buffers that are full all the time
        monkeypatch.setattr(packing, "CACHE_WORDS", room[0])
        monkeypatch.setattr(packing, "CACHE_IDS", room[1])
    path = P.path("word_bpe_49k.json")
    own, library = packing.WordIds(path), Tokenizer.from_file(path)
    letters = [*"aB'sTdLmrev0123 .,-_\t\n<=", "\u00a0", "é", "É", "×", "ß", "Σ", "K", "\u0301", "\u030c", "\u0338", "<|endoftext|>", "\x1c", "\x85", "🙂", "'ll", "Ⅷ", "٣"]
    some = ["".join(RNG.choice(letters, n)) for n in RNG.integers(0, 40, 3000)] + ["ab" * 600, "ab" * 600 + "c", "é" * 700, "", "x" * 5000]
    got = [x.tolist() for a in range(0, len(some), 100) for x in own(pa.array(some[a : a + 100], pa.string()))]
    assert got == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


# --- 9 ---


def test_toxicity_is_learned_and_folded(spark):
    bad, rows, marks = ["zorgish", "blemmer"], [], []
    for i in range(600):
        words, toxic = RNG.choice(WORDS[:6], 30).tolist(), i % 4 == 0
        if toxic:
            words[5] = bad[i % 3 % 2]
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(1000, "you zоrgish"), (1001, "you z0rg1sh!"), (1002, None), (1003, "alpha beta"), (None, "zorgish"), (1000, "you zorgish")]
    d, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*marks, (5000, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    got = toxicity.op9(d, labels).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    truth = dict(marks)
    assert np.mean([of[i].predicted == truth[i] for i in truth if of[i].held_out]) > 0.97
    assert of[1000].predicted == of[1001].predicted == of[None].predicted == 1 and of[1002].predicted == of[1003].predicted == 0
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    clean = toxicity.keep_clean(d, toxicity.fit(d, labels))
    assert clean.columns == d.columns and clean.where("doc_id IN (1000, 1001)").count() == 0 and clean.where("doc_id = 1003").count() == 1
    model = toxicity.fit(d, labels, phrases=("zorgish fruit",))
    s = {r.id: r.score for r in toxicity.toxicity(spark.createDataFrame([(0, "a zorgish fruit"), (1, "a zorgish")], "doc_id bigint, text string"), model).collect()}
    assert s[0] < 0.5 < s[1]
    assert {r.score for r in toxicity.op9(d, labels.where("toxic = 0")).collect()} == {toxicity.Model().score(0, 0, 0)}


def test_exceptions_cancel_before_the_largest_weight():
    model = toxicity.Model({" strong": 9.0, " weak": 1.0}, {" strongly ": -9.0, " weak tea ": -1.0})
    of = lambda text: model.features(toxicity.fold(text), model.automaton())
    assert of("strongly weak")[2] == 1 and of("strongly weak") == of("calmly weak")
    assert of("strong weak")[2] == 9 and of("strongly strong")[2] == 9
    assert of("weak tea strongly") == (0, 0, 0)


def test_features_against_plain_search():
    """Every occurrence of every entry by plain search, without those inside an exception."""
    for _ in range(200):
        draw = lambda n: "".join(RNG.choice(list("ab "), n))
        weights = {draw(int(RNG.integers(1, 4))): float(RNG.integers(1, 9)) for _ in range(5)}
        exceptions = {p: -1.0 for p in (draw(int(RNG.integers(2, 6))) for _ in range(3)) if p not in weights}
        model, text = toxicity.Model(weights, exceptions), toxicity.fold(draw(30))
        spots = lambda entries, text=text: [(i, i + len(p), p) for p in entries for i in range(len(text) - len(p) + 1) if text.startswith(p, i)]
        spans = spots(exceptions)
        found = [weights[p] for a, b, p in spots(weights) if not any(x <= a and b <= y for x, y, _ in spans)]
        x, y, z = model.features(text, model.automaton())
        words = max(1, len(text.split()))
        assert z == max(found, default=0.0) and x == pytest.approx(np.log1p(sum(found))) and y == pytest.approx(np.log1p(100 * sum(found) / words) if found else 0)


def test_toxicity_of_odd_tables(spark):
    d = spark.createDataFrame([(1, "zorgish " * 50_000, 9, 0.5), (1, None, 9, 0.5), (2, "", None, None)], "doc_id bigint, text string, label int, score double")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y")], "doc_id bigint, toxic int, text string")
    got = toxicity.op9(d, labels).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.op9(d.limit(0), labels).count() == 0 and toxicity.op9(d, labels.limit(0)).count() == 3
    assert toxicity.keep_clean(d, toxicity.Model()).columns == d.columns


def test_exceptions_of_clean_rows(spark):
    rows, marks = [], []
    for i in range(600):
        words, toxic = RNG.choice(WORDS[:6], 30).tolist(), i % 4 == 0
        if toxic:
            words[5] = ["zorgish", "blemmer"][i % 8 // 4]
        elif i % 20 == 1:
            words[5] = "zorgishness"
        elif i % 20 == 2:
            words[5:7] = ["blemmer", "pie"]
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    d, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.fit(d, labels)
    a = model.automaton()
    worst = lambda text: model.features(toxicity.fold(text), a)[2]
    assert worst("a zorgish") > 0 and worst("a blemmer") > 0
    assert worst("a zorgishness") == 0 and worst("some blemmer pie") == 0


# --- 10 ---


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav><a>m</a></nav><article><h1>T</h1><p><b>one<br>two<p>three &eacute;</article><footer>f</footer>", "T\n\none two\n\nthree é"),
        ("<body><div class='sidebar x'>s</div><div><p>first long paragraph here<p>second long paragraph here</div><div id=comments><p>a<p>b<p>c</div>", "first long paragraph here\n\nsecond long paragraph here"),
        ("<article><p>a</p><script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><form>f</form><p>c</p></article>", "a\n\nc"),
        ("<body><header>site</header><article><header>title</header><p>text</article>", "title\n\ntext"),
        ("<p>never <b>closed <i>tags", "never closed tags"),
        ("</div></p><p>stray</p><!-- c --", "stray"),
        # a reference ends with its text
        ("AT&<b>amp;</b> &am<!-- -->p; &lt;b&gt;", "AT&amp; &amp; <b>"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def plain_core(body):
    """The node with the largest density sum, by the formula read node by node."""
    import math

    def count(node):
        chars, tags, lc, lt = 0, 0, 0, 0
        for x in node.items:
            if isinstance(x, str):
                chars += len("".join(x.split()))
            else:
                c, t, a, b = count(x)
                chars, tags, lc, lt = chars + c, tags + t + 1, lc + a, lt + b + (x.tag == "a")
        return (chars, tags, chars, tags) if node.tag == "a" else (chars, tags, lc, lt)

    whole = count(body)

    def density(node):
        c, t, lc, lt = count(node)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + whole[2] / max(whole[0], 1) * c + math.e)
        return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + 1e-9) / math.log(max(base, 1.0) + 1.0)

    every, rest = [], [body]
    while rest:
        every.append(rest.pop(0))
        rest += every[-1].children()
    return max(every, key=lambda x: sum(map(density, x.children())))


P1, P2, P3 = (f"A paragraph number {k} of the article, with words enough to be dense and no link at all in it." for k in "123")
LINKS = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(12))


@pytest.mark.parametrize(
    "html, want",
    [
        # nothing but density tells the text from the links
        (f"<body><div><ul>{LINKS}</ul></div><div><p>{P1}<p>{P2}<p>{P3}</div><div><ul>{LINKS}</ul></div>", [P1, P2, P3]),
        # an article of links beside the text, and one around it
        (f"<body><article><ul>{LINKS}</ul></article><div><p>{P1}<p>{P2}<p>{P3}</div>", [P1, P2, P3]),
        (f"<body><div><ul>{LINKS}</ul></div><article><h1>Title</h1><div><p>{P1}<p>{P2}</div><p>Short end.</p></article>", ["Title", P1, P2, "Short end."]),
        (f"<body><div><h1>Title</h1><div><p>{P1}<p>{P2}</div></div><ul>{LINKS}</ul>", ["Title", P1, P2]),
        # names of classes: whole ones, of containers, that don't hold the text
        (f"<body><div class='page has-sidebar'><p>{P1}<p>{P2}</div>", [P1, P2]),
        # named containers that hold all the text, or all but a title
        (f"<body><div><div class='widget'><p>{P1}</div><div class='widget'><p>{P2}</div></div>", [P1, P2]),
        (f"<body><h1>Title</h1><div><div class='widget'><p>{P1}</div><div class='widget'><p>{P2} {P3}</div></div><div class='menu'><ul>{LINKS}</ul></div>", ["Title", P1, f"{P2} {P3}"]),
        (f"<body><div class='sidebar'><p>{P1}<p>{P2}</div>", [P1, P2]),
        (f"<article><p>{P1}</p><p class='social'>Kept.</p><div class='ad'>Buy this.</div><p>{P2}</p></article>", [P1, "Kept.", P2]),
        (f"<body><div><p>{P1}<p>{P2}</div><div id='comments'>" + "".join(f"<div class=comment><p>{P3} {P3}</p></div>" for _ in range(9)) + "</div>", [P1, P2]),
        (f"<body><div class='cookie-banner'>We use cookies.</div><div role='navigation'>{P3}</div><main><p>{P1}<p>{P2}</main>", [P1, P2]),
        ("<article><p>one <b>two<p>three</b> four</article>", ["one two", "three four"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
    ],
)
def test_density_and_names(html, want):
    assert html_text.main_text(html) == "\n\n".join(want)


def test_core_against_the_formula():
    for _ in range(60):
        parts = RNG.choice(["<div>", "</div>", "<p>", "<ul><li>", "</li></ul>", "<a href=x>", "</a>", "some words here ", "x", "<b>y</b>"], 40)
        root = html_text.parse("<body>" + "".join(parts))
        body = root.items[0]
        nodes = html_text._walk(body)
        html_text._measure(nodes, body)
        assert html_text._core(nodes) is plain_core(body)


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<p>a<li>" * 120_000, "<!a" * 300_000, "<a '" * 250_000, "<div>" * 200_000, "</b>" * 250_000, "<" * 10**6, "&amp;" * 200_000, "<b><p>" * 80_000 + "x"):
        t = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - t < 15


def test_extract_of_an_empty_table(spark):
    d = spark.createDataFrame([], "page_id bigint, url string, html string, text string, n_chars int")
    assert html_text.op10(d).count() == 0
    assert html_text.op10(spark.createDataFrame([(1, "u", "<p>" + "word " * 400_000, "t", 5)], d.schema)).first().n_chars == 5 * 400_000 - 1


def test_extract(spark):
    rows = [(1, "u", "<p>x</p>", "e"), (None, None, None, "e"), (2, "v", "<ul>" + "<li>item</li>" * 2000 + "</ul>", "e"), (1, "u", "<p>x</p>", "e")]
    got = html_text.op10(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == 4 and {r.page_id: r.n_chars for r in got} == {1: 1, None: 0, 2: 2000 * 4 + 1999 * 2}


# --- pipeline ---


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == before.columns
        if name == "ngram_jaccard_join":
            groups = linked([tuple(r) for r in by_id(before)])
            assert {r.doc_id for r in by_id(docs)} == {c for _, c in groups.values()}
        if name == "suffix_array_dedup":
            want = removed([tuple(r) for r in by_id(before)])
            exact = {i for i, w in want.items() if w[1] == 0}
            old = dict(tuple(r) for r in by_id(before))
            assert all(r.text == old[r.doc_id] for r in by_id(docs) if r.doc_id in exact) and docs.count() == before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in by_id(docs)}


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id bigint, text string, lang string, node int, label int, n_chars bigint"
    t = sentence(60)
    rows = [(1, t, "en", 1, 1, 0), (1, t + " tail", "en", 1, 1, 0), (2, t, None, 1, 1, 0), (3, None, "en", 1, 1, 0), (None, t, "en", 1, 1, 0), (None, None, None, None, None, None), (4, "", "fr", 1, 1, 0), (5, sentence(50), "fr", 1, 1, 0)]
    for name, some in (("full", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(some, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(f(spark, docs, str(folder)).collect(), docs.schema)
            assert [c for c, _ in docs.dtypes] == kind.replace(",", "").split()[::2]
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted({r.doc_id for r in got if r.doc_id is not None}) == ([1, 3, 4, 5] if some else []) and sum(r.doc_id is None for r in got) == (2 if some else 0)
        if some:
            assert {r.doc_id: r.text for r in docs.collect()}[1] == t  # the smallest text of the rows with this id
