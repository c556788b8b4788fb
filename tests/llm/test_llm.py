"""The ten operators against brute force, round trips or held-out accuracy, and their edge cases."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, media, mixing, near_dedup, packing, quality, substring, tokens, url_filter, warc, winnow, words
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.tokens import encoder
from gridloom.session import Scratch, lean, lean_group

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    """Rows (doc_id, text[, source]) as documents with clashing extra columns."""
    rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in texts]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("size", "score", "node", "n_words", "n_removed", "chunk", "payload", "key", "media", "n_bytes", "copies", "id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def prose(rng, n, vocabulary=400):
    return " ".join("w%d" % k for k in rng.zipf(1.3, n) % vocabulary)


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (None, "a null id"), (5, "ümläut ñ 漢字 \U0001f600 <|endoftext|>"), (6, "x" * 5000), (7, "word " * 3000)]


# --- 1 packing

def test_encoder_is_the_tokenizer():
    e = encoder(tokenizer_path())
    for t in ["", " a  b\n\nc", "İstanbul ΣΑΣ é ²3x's don't <|endoftext|>y  z\x1cq 漢字 'S", "A'S!!! b*** \u0301x é.", "word" * 300, "\u00a0nbsp\u2003em a\u0085b"]:
        assert e.encode(t) == np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids, np.uint16).tobytes()


def test_many_texts_at_once_are_the_tokenizer(monkeypatch):
    """Runs of all lengths, every Latin-1 character in every kind of neighbourhood, texts beyond Latin-1, and caches that start anew."""
    rng = np.random.default_rng(41)
    letters = [c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº"]
    texts = [None, "", " ", "\n\n", " a  b\n\nc ", "x" * 5000, "BY-NC 4.0 a.b@c-d.example.com (555)-3687", "don't <|endoftext|>y a<|endoftext|>b <|ENDOFTEXT|>", "漢字 İstanbul ΣΑΣ", "end\n", "\nstart"]
    texts += ["".join(rng.choice(letters, n)) + "." for n in (*range(1, 40), 100)] * 2
    texts += [a + c + b for c in map(chr, range(256)) for a, b in (("", ""), ("ab", "cd"), ("1", "2"), (", ", ";x"), (" ", " "))]
    texts += ["".join(map(chr, rng.integers(0, 256, 400))) for _ in range(40)] + ["".join(rng.choice(list("aeinrst .,-1'"), 2000)) for _ in range(20)]
    texts += ["".join(rng.choice(list("aéÉ \u0301\u2003’—漢İ\U0001f600.1\n"), 300)) for _ in range(40)]
    e = tokens.WordEncoder(tokenizer_path())
    want = [np.asarray(e.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint16).tobytes() for t in texts]
    assert e.table is not None and e.encode_all(texts) == want and e.encode_all(texts[::-1]) == want[::-1]
    small = tokens.WordEncoder(tokenizer_path(), cache_words=50)
    monkeypatch.setattr(tokens, "TOGETHER", 3000)
    assert small.encode_all(texts) == want and small.encode_all(texts) == want
    monkeypatch.setattr(tokens._RunTable, "BITS", 12)  # full, with many runs to a slot
    assert tokens.WordEncoder(tokenizer_path()).encode_all(texts) == want


def test_new_words_need_no_call_each():
    """Thousands of words never seen before, with no call of the tokenizer or its model for any of them."""
    rng = np.random.default_rng(42)
    texts = [" ".join("".join(rng.choice(list("abcdeghilmnoprstuéñü"), int(rng.integers(1, 25)))) + ("." if k % 9 == 0 else "") for k in range(200)) for _ in range(40)]
    e = tokens.WordEncoder(tokenizer_path())
    want = [np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids, np.uint16).tobytes() for t in texts]
    e.words.tokenizer = e.words.runs.tokenize = None
    assert e.encode_all(texts) == want


def check_packing(pieces, rows, window=4096):
    e = encoder(tokenizer_path())
    ids = [np.frombuffer(e.encode(t) + b"\x02\x00", np.uint16) for _, t in rows]
    want = Counter((d, len(x), zlib.crc32(x.astype("<u4").tobytes())) for (d, _), x in zip(rows, ids))
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    covered = Counter()
    for (d, n), ps in by_doc.items():
        starts = Counter()
        for p in ps:
            for k in range(p.start, p.start + p.length):
                starts[k] += 1
        copies = sum(c for (a, m, _), c in want.items() if (a, m) == (d, n))
        assert set(starts) == set(range(n)) and set(starts.values()) == {copies}
        covered[d, n] = copies
    assert sum(covered.values()) == len(rows)
    padding = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at == ps[0].sequence_tokens
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    one = {(d, n): x for (d, _), x in zip(rows, ids) for n in [len(x)]}
    for p in pieces:
        if want[p.doc_id, p.doc_tokens, zlib.crc32(one[p.doc_id, p.doc_tokens].astype("<u4").tobytes())] == 1:
            assert p.ids_crc32 == zlib.crc32(one[p.doc_id, p.doc_tokens][p.start : p.start + p.length].astype("<u4").tobytes())


def test_workers_keep_the_encoder_for_tokenizing_only(spark):
    encoder(tokenizer_path())
    assert list(lean(iter, "tokens")(iter([1]))) == [1] and tokens._loaded
    assert list(lean(iter)(iter([1]))) == [1] and not tokens._loaded
    encoder(tokenizer_path())
    assert lean_group(len)([1]) == 1 and not tokens._loaded

    def held(kind):
        def run(batches):
            for _ in batches:
                yield pa.record_batch({"n": pa.array([len(tokens._loaded)], pa.int32())})

        return {r.n for r in spark.range(0, 8, 1, 2).mapInArrow(lean(run, kind), "n int").collect()}

    packing.tokenize(docs(spark, ODD), tokenizer_path()).collect()  # its workers go on to the next steps
    assert 1 in held("tokens")
    assert held("") == {0}


def test_steps_get_small_batches(spark):
    def run(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(0, 6000, 1, 1).withColumn("x", F.repeat(F.lit("abcdefghij"), 200))
    scratch = Scratch(spark, "batches")
    got = scratch.save(rows.mapInArrow(run, "n long, size long"), "sizes").collect()
    scratch.drop()
    assert sum(r.n for r in got) == 6000 and max(r["size"] for r in got) < 6e6
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_shard_memory():
    rng = np.random.default_rng(1)
    ids = [(rng.zipf(1.2, n) % 49000).astype("<u2") for n in rng.integers(5, 1500, 600)]
    idf = np.log1p(rng.random(49152))
    tracemalloc.start()
    shard = packing.Shard(ids, idf, 700.0)
    peak = tracemalloc.get_traced_memory()[1] - 8 * 2 * len(idf)
    tracemalloc.stop()
    assert peak < 25 * sum(map(len, ids))
    k, term = 7, int(ids[7][0])
    bag = {int(t) for t in ids[k][:-1]}
    by_hand = [sum(idf[t] * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(x) / 700.0)) for t, f in Counter(x[:-1].tolist()).items() if t in bag) for x in ids]
    assert term in bag and np.allclose(shard.scores(k), by_hand)


def test_packing_tiles_every_document(spark):
    rng = np.random.default_rng(1)
    rows = ODD + [(100 + k, prose(rng, int(rng.integers(1, 900)))) for k in range(60)]
    check_packing(packing.pack(docs(spark, rows), tokenizer_path()).collect(), rows)
    check_packing(packing.pack(docs(spark, rows).repartition(5), tokenizer_path(), shard_tokens=3000).collect(), rows)
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0


def test_bm25_and_neighbours():
    rng = np.random.default_rng(2)
    ids = [np.append(rng.integers(3, 60, int(rng.integers(1, 80))), 2) for _ in range(30)]
    idf, mean = rng.random(64), 40.0
    shard = packing.Shard(ids, idf, mean)
    for k in range(30):
        got, want = shard.scores(k), np.zeros(30)
        for t in set(ids[k][:-1].tolist()):
            for d, x in enumerate(ids):
                tf = (x[:-1] == t).sum()
                want[d] += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(x) / mean)) if tf else 0
        assert np.allclose(got, want)
    first = next(packing.fill(shard, [len(x) for x in ids], 100))
    ranked = sorted((d for d in range(1, 30)), key=lambda d: (-shard.scores(0)[d], d))
    assert [x[0] for x in first[1:]] == ranked[: len(first) - 1]


def test_a_shrinking_shard_fills_the_same_windows():
    """Every window is filled by a search of all unused documents, also after most of the shard is used."""
    rng = np.random.default_rng(3)
    ids = [np.append(rng.integers(3, 90, int(rng.integers(1, 60))), 2) for _ in range(300)]
    idf, mean, lengths = rng.random(96), 30.0, [len(x) for x in ids]
    whole, shard = packing.Shard(ids, idf, mean), packing.Shard(ids, idf, mean)
    unused = set(range(300))
    for sequence in packing.fill(shard, lengths, 128):
        if sum(x[2] for x in sequence) < 128:
            break
        seed = sequence[0][3]
        unused.discard(seed)
        score = whole.scores(seed)
        ranked = sorted(unused, key=lambda d: (-score[d], d))[: len(sequence) - 1]
        assert [(x[0], x[4]) for x in sequence[1:]] == [(d, score[d]) for d in ranked]
        unused -= set(ranked)
    assert len(unused) < 10 and shard.n < 100 and whole.n == 300


def test_neighbours_far_apart_in_the_layout_share_a_window(spark):
    """1.2M tokens: the first document of the layout and the last, the second and the last but one ... share rare words."""
    e = encoder(tokenizer_path())
    ids = {w: np.frombuffer(e.encode(w), np.uint16) for w in e.tokenizer.get_vocab() if w.isascii() and w.isalpha() and w.islower()}
    words = sorted((w for w in ids if len(ids[w]) == 1), key=lambda w: ids[w][0])
    common, rare = words[:300], words[300:]
    rows = [(k, " ".join([common[k]] * 3700 + rare[5 * min(k, 299 - k) :][:5] * 60)) for k in range(300)]
    met = defaultdict(set)
    for p in packing.pack(docs(spark, rows), tokenizer_path()).collect():
        met[p.sequence_id].add(p.doc_id)
    pairs = {(d, 299 - d) for held in met.values() for d in held if d < 150 and 299 - d in held}
    assert len(pairs) >= 140  # a few are used up as fillers of unrelated windows


def test_layout_counts_every_id():
    """One more token leaves a long document's place in the layout, and ids off any stride are counted."""
    rng = np.random.default_rng(12)
    x = np.append(rng.integers(3, 200, 3000), 2).astype(np.uint16)
    x[1:900:3], x[2:1300:5] = 250, 251
    y = np.insert(x, 50, 77)
    top, _, _ = packing._signatures(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]))
    assert top == [np.bincount(x[:-1]).argmax()] * 2
    z = np.full(2560, 9, dtype=np.uint16)
    z[::20] = 3
    assert packing._signatures(z, np.array([0, len(z)]))[0] == [9]


# --- 2 quality

def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    m = out.join(labels, "doc_id").where("held_out").toPandas()
    assert len(m) > 80 and (m.predicted == m.quality).mean() >= 0.95
    assert (m.score.between(0, 1)).all() and ((m.score >= 0.5) == (m.predicted == 1)).all()


def test_quality_reads_whole_texts(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    blank = quality.Network(np.zeros((4, 256, 16), np.float32), np.zeros(16, np.float32), np.zeros(16, np.float32), 0.0)
    assert {r.score for r in quality.score(docs(spark, [(1, None), (2, "")]), blank).collect()} == {0.5}
    good, bad = "plain words that flow along. ", "SHOUT!!! BUY*** "
    rows = [(k, (good if k % 2 else bad) * 12) for k in range(40)] + ODD + [(90, good * 3000), (91, good * 3000 + bad * 3000), (92, good * 3000)]
    network = quality.train(docs(spark, rows), labels)
    assert network.logit(b"") == network.logit(b"\0" * 256)
    out = defaultdict(list)
    scored = quality.score(docs(spark, rows), network)
    for r in scored.collect():
        out[r.doc_id].append(r.score)
    assert scored.count() == len(rows) and out[1][0] is not None and 0 <= out[1][0] <= 1
    assert out[90] == out[92] and out[91][0] < out[90][0] and out[90][0] > 0.5
    assert quality.judge(docs(spark, []), labels).count() == 0
    one_sided = quality.train(docs(spark, rows), labels.where("quality = 1"))
    assert quality.score(docs(spark, rows), one_sided).select("score").distinct().count() == 1


def test_network_by_force():
    """The convolution, pooling and mean by plain loops."""
    rng = np.random.default_rng(21)
    net = quality.Network(rng.normal(0, 1, (4, 256, 16)).astype(np.float32), rng.normal(0, 1, 16).astype(np.float32), rng.normal(0, 1, 16).astype(np.float32), 0.25)
    for n in (0, 1, 5, 255, 256, 257, 384, 385, 1000):
        raw = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        chunks = max(1, -(-n // 128) - 1)
        padded = raw + bytes(128 * (chunks + 1) + 3 - n)
        logits = []
        for c in range(chunks):
            z = 0.0
            for f in range(16):
                best = max(sum(float(net.tables[j, padded[i + j], f]) for j in range(4)) for i in range(128 * c, 128 * c + 256))
                z += max(0.0, best + float(net.shift[f])) * float(net.weights[f])
            logits.append(z)
        assert abs(net.logit(raw) - (sum(logits) / chunks + 0.25)) < 1e-3


def test_fit_takes_whole_texts_within_its_bytes(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    # what tells the labels apart lies far behind the first chunks
    rows = [(k, "same words here. " * 400 + ("zzzz qqqq " if k % 2 else "aaaa eeee ") * 300) for k in range(60)]
    network = quality.train(docs(spark, rows), labels)
    z = [network.logit(t.encode()) for _, t in rows]
    assert sum((v >= 0) == (k % 2 == 1) for k, v in enumerate(z)) >= 57
    seen = []
    quality_fit, quality.fit = quality.fit, lambda texts, label: seen.append((texts, label)) or quality_fit([], np.empty(0))
    try:
        quality.train(docs(spark, rows + [(3, "again")]), labels, fit_bytes=100_000)
    finally:
        quality.fit = quality_fit
    texts, label = seen[0]
    assert 0 < sum(len(x) for x in texts) <= 100_000 and {x.decode() for x in texts} <= {t for _, t in rows} | {"again"} and len(label) == len(texts)


# --- 3 near dedup

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("cells", [32, 0])  # equal cells of the band, or all of them
def test_alignment_against_plain_lcs(monkeypatch, cells):
    monkeypatch.setattr(near_dedup, "CELLS", cells)
    rng = np.random.default_rng(3)
    left, right = [], []
    for _ in range(200):
        a = rng.integers(0, 30, int(rng.integers(1, 120))).astype(np.uint32)
        b = a.copy()
        for _ in range(int(rng.integers(0, 9))):
            k = int(rng.integers(0, len(b)))
            b = [np.delete(b, k) if len(b) > 1 else b, np.insert(b, k, rng.integers(0, 30)).astype(np.uint32), np.roll(b, 1)][int(rng.integers(3))]
        left.append(a)
        right.append(b.astype(np.uint32))
    for a, b, s in zip(left, right, near_dedup.resemblances(left, right)):
        m = lcs(a.tolist(), b.tolist())
        true = m / (len(a) + len(b) - m)
        assert abs(s - true) < 1e-12 if true >= 0.8 else s == -1


def classes_by_force(rows):
    seqs = {}
    for k, (d, t) in enumerate(rows):
        w = WORD.findall(t or "")
        seqs[k] = (w, [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in seqs:
        for b in range(a):
            (wa, sa), (wb, sb) = seqs[a], seqs[b]
            same = wa == wb
            if not same and sa and sb and len(set(sa) & set(sb)) * 2 >= len(sa):
                m = lcs(sa, sb)
                same = m / (len(sa) + len(sb) - m) >= 0.8
            if same and find(a) != find(b):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return sorted(sorted(g) for g in groups.values())


def test_near_duplicates_by_force(spark):
    rng = np.random.default_rng(4)
    rows, n = [r for r in ODD if r[0] is not None], 100
    for _ in range(12):
        base = prose(rng, int(rng.integers(6, 260)), 5000).split()
        for _ in range(int(rng.integers(2, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                k = int(rng.integers(0, len(w)))
                w[k] = "e%d" % rng.integers(10**6)
            rows.append((n, "  ".join(w)))
            n += 1
    for k in range(6):  # tiny texts that differ at their ends
        rows.append((n + k, " ".join("t%d" % j for j in range(k % 3, 12 + k // 3))))
    got = defaultdict(list)
    out = near_dedup.near_duplicates(docs(spark, rows)).collect()
    for r in out:
        got[r.class_id].append(r.doc_id)
        assert r.class_id <= r.exact_of <= r.doc_id
    assert len(out) == len(rows) and sorted(sorted(g) for g in got.values()) == classes_by_force(rows)


def test_near_duplicates_of_many_and_of_none(spark):
    rng = np.random.default_rng(5)
    base = prose(rng, 150, 5000).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 700):  # a family of edits of one original, most of them not alike to each other
        w = list(base)
        for p in rng.choice(len(w), int(rng.integers(1, 8)), replace=False):
            w[p] = "e%d" % rng.integers(10**6)
        rows.append((k, " ".join(w)))
    out = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(146)}
    first = shingles(rows[0][1])
    for k, t in rows[1:]:
        s = shingles(t)
        if len(s & first) / len(s | first) >= 0.8:
            assert out[k] == out[0]
    kept = near_dedup.keep_one(docs(spark, rows + [(0, rows[0][1]), (None, "x"), (None, "x")]))
    assert kept.where("doc_id = 0").count() == 1 and kept.where("doc_id IS NULL").count() == 2
    assert kept.where("doc_id IS NOT NULL").count() == len(set(out.values()))
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_families_under_one_key(spark, monkeypatch):
    """Buckets that hold two unlike families, a chain between families and loners, compared in blocks of four: classes as by brute force, links few."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = np.random.default_rng(13)
    sequences, family = [], []
    for f, n in ((0, 25), (1, 25), (2, 9)):
        base = rng.integers(1 << 20, 1 << 21, 120)
        for _ in range(n):
            v = base.copy()
            at = rng.choice(120, int(rng.integers(0, 20)), replace=False)
            v[at] = rng.integers(1 << 22, 1 << 30, len(at))
            sequences.append(v)
            family.append(f)
    bridge = sequences[0].copy()
    for step in range(1, 9):  # each is alike to the one before, the ends are not
        bridge = bridge.copy()
        bridge[12 * step : 12 * step + 12] = rng.integers(1 << 22, 1 << 30, 12)
        sequences.append(bridge)
    sequences += [rng.integers(1, 1 << 30, 120) for _ in range(10)]
    n = len(sequences)
    packed = [np.asarray(v, dtype=np.uint32) for v in sequences]
    shingles = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in enumerate(packed)], "node long, shingles binary")
    members = spark.createDataFrame([(key, k, float(k % 7)) for key in (5, 6) for k in range(n) if key == 5 or k % 2], "key long, node long, support double")
    links = [(r.a, r.b) for r in near_dedup._links(members, shingles, Scratch(spark, "test")).collect()]
    assert len(links) < 12 * n
    pairs = [(a, b) for a in range(n) for b in range(a)]
    alike = [p for p, s in zip(pairs, near_dedup.resemblances([packed[a] for a, _ in pairs], [packed[b] for _, b in pairs])) if s >= 0.8]

    def classes(edges):
        root = list(range(n))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return sorted(sorted(k for k in range(n) if root[k] == r) for r in set(root))

    assert set(links) <= {p for a, b in alike for p in ((a, b), (b, a))}
    assert classes(links) == classes(alike) and len(classes(alike)) > 12


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 102), (101, 103)], "a long, b long")
    roots = {r.node: r.root for r in near_dedup.components(edges, Scratch(spark, "test")).collect()}
    assert {roots[k] for k in range(41)} == {0} and {roots[k] for k in range(100, 104)} == {100}


# --- 4 WARC

def test_warc_round_trip(spark):
    pages = [(1, "http://a.example.com/x?y=1", "<html>\r\n\r\nWARC/1.1\r\n"), (2, "https://b.example.org", None), (3, None, ""), (4, "no scheme", "same"), (5, "http://A.example.com:80/q z", "same"), (6, "http://a.example.com/x?y=1", "ü\U0001f600"), (6, "http://a.example.com/x?y=1", "ü\U0001f600"), (7, "http://h/", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    import base64

    for direct in (True, False):  # workers open the files, or Spark reads them
        rows = sorted(warc.round_trip(df, direct=direct).collect(), key=lambda r: r.page_id)
        assert [r.page_id for r in rows] == [1, 2, 3, 4, 5, 6, 6, 7]
        for r, (p, _, html) in zip(rows, pages):
            raw = (html or "").encode()
            last = max(q for q, _, h in pages if (h or "") == (html or ""))
            assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if p == last else ("revisit", last))
            assert r.body_bytes == (len(raw) if p == last else 0)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0


def test_warc_of_long_and_repeated_pages(spark, monkeypatch):
    """Pages of very unlike sizes, groups of copies, null ids, and a filter so full that every row is exchanged."""
    long = "long \r\n\r\nWARC/1.1 " * 40_000
    rows = [(k, "http://h.example.com/", "copy" if k % 3 else f"own {k}") for k in range(300)] + [(400 + k, None, long) for k in range(3)] + [(500, "u", long + "x"), (None, None, "copy"), (None, "v", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def key(r):
        return (r[0] is None, r[0] or 0, r[1], r[2], r[3] or 0)

    want = []
    for p, _, h in rows:
        last = max((q for q, _, g in rows if g == h and q is not None), default=None)
        revisit = p is not None and h is not None and p < last
        want.append((p, len((h or "").encode()), "revisit" if revisit else "response", last if revisit else None))
    for bits in (1 << 25, 1 << 15):
        monkeypatch.setattr(warc, "FILTER_BITS", bits)
        got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    folder = warc.write(pages, Scratch(spark, "test"), file_bytes=1000)
    archive = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect())
    kinds = Counter(h["WARC-Type"] for _, _, h, _, _ in warc.parse(archive))
    assert kinds == Counter(w[2] for w in want)


def test_warc_lookup(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.example.com/p{k}", f"body {k}") for k in range(3000)], "page_id long, url string, html string")
    scratch = Scratch(spark, "test")
    folder = warc.write(pages, scratch)
    lines = warc.captures(spark, folder)
    index = warc.build_index(lines, scratch, parts=3)
    assert index.count() >= 3 and lines.count() == 3000
    for k in (0, 1, 1234, 2999):
        raw = warc.fetch(spark, index, f"com,example,h{k % 7})/p{k}", k)
        assert raw.startswith(b"WARC/1.1") and raw.endswith(f"body {k}\r\n\r\n".encode())
    assert warc.fetch(spark, index, "com,example,h1)/absent", 5) is None
    assert warc.fetch(spark, index, "a", 0) is None
    asked = spark.createDataFrame([("com,example,h0)/p7", 7), ("zzz", 1)], "url_key string, page_id long")
    got = {r.url_key: r.file for r in warc.locate(asked, index).collect()}
    assert got["com,example,h0)/p7"] and got["zzz"] is None
    with pytest.raises(ValueError):
        list(warc.parse(b"garbage" * 10))


# --- 5 media

def test_media_round_trip(spark):
    rows = {}
    for r in media.fingerprint(media.store(docs(spark, ODD)), keep=("doc_id", "n_bytes", "text")).collect():
        raw = (r.text or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert r.media_bytes == len(full) + 44 and r.times == sorted(r.times) and len(r.times) == len(r.codes)
        assert r.feature == f"{len(r.times)}:" + hashlib.sha256(np.asarray(r.times + r.codes, "<i4").tobytes()).hexdigest()
        key = r.text or ""
        assert rows.setdefault(key, (r.media_sha256, r.codes)) == (r.media_sha256, r.codes)
    assert media.fingerprint(media.store(docs(spark, []))).count() == 0
    long = docs(spark, [(1, "long " * 200_000), (1, "long " * 200_000), (2, None)])
    found = media.fingerprint(media.store(long)).collect()
    assert [r.payload_bytes for r in found] == [-(-1_000_000 // 192) * 192] * 2 + [192] and found[0] == found[1]


def test_features_by_force():
    """Frames, transform, peaks and pairs by plain loops; the last samples are in a frame too."""
    rng = np.random.default_rng(22)
    for n in (192, 256, 576, 960, 1920):
        samples = rng.integers(0, 256, n, dtype=np.uint8)
        x = samples.astype(float) - 128
        frames = 1 + max(0, -(-(n - 256) // 128))
        x = np.append(x, np.zeros(256 + 128 * (frames - 1) - n))
        level, found = [], []
        for f in range(frames):
            w = [x[128 * f + k] * (0.5 - 0.5 * np.cos(2 * np.pi * k / 255)) for k in range(256)]
            power = [abs(sum(w[k] * np.exp(-2j * np.pi * b * k / 256) for k in range(256))) for b in range(128)]
            level.append([max(power[a:b]) for a, b in zip((2, 8, 20, 48), (8, 20, 48, 128))])
            found.append([a + int(np.argmax(power[a:b])) for a, b in zip((2, 8, 20, 48), (8, 20, 48, 128))])
        peaks = [(f, found[f][k]) for f in range(frames) for k in range(4) if (f == 0 or level[f][k] >= level[f - 1][k]) and (f == frames - 1 or level[f][k] > level[f + 1][k])]
        pairs = [(t, b << 20 | peaks[i + d][1] << 12 | peaks[i + d][0] - t) for i, (t, b) in enumerate(peaks) for d in (1, 2, 3) if i + d < len(peaks)]
        t, c = media.pair_codes(samples.tobytes())
        assert sorted(zip(t.tolist(), c.tolist())) == sorted(pairs)
        other = samples.copy()
        other[-60:] = 255 * (np.arange(60) // 5 % 2)
        assert n != 576 or media.pair_codes(other.tobytes())[1].tolist() != c.tolist()


def test_fingerprint_finds_a_shifted_excerpt():
    rng = np.random.default_rng(6)
    sound = rng.integers(60, 190, 40000, dtype=np.uint8).tobytes()
    t, c = media.pair_codes(sound)
    t2, c2 = media.pair_codes(sound[12800:32000])  # a hundred hops later
    where = defaultdict(list)
    for a, x in zip(t.tolist(), c.tolist()):
        where[x].append(a)
    shifts = Counter(a - b for b, x in zip(t2.tolist(), c2.tolist()) for a in where[x])
    assert shifts.most_common(1)[0][0] == 100 and shifts[100] > 0.8 * len(t2)


# --- 6 mixing

def targets_by_force(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, capped = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (budget - sum(2 * size[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > 2 * size[s]]
        if not over:
            return {s: 2.0 * size[s] if s in capped else weight[s] * level for s in names}
        capped |= set(over)


def mixed_rows(n=600):
    rng = np.random.default_rng(7)
    sources = ["a", "é", "Z", "src10", "src2", None]
    return [(k, prose(rng, int(rng.integers(0, 200))) if k % 50 else None, sources[min(5, int(rng.integers(0, 14)))]) for k in range(n)] + [(5, "same row", "a")] * 3


def test_mixing_hits_its_targets(spark):
    rows = mixed_rows()
    out = mixing.sample(docs(spark, rows)).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want, taken = targets_by_force(size), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == size[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    for s in want:
        assert abs(taken[s] - want[s]) <= 3


def test_mixing_repeats_and_levels(spark):
    df = docs(spark, mixed_rows())
    key = lambda out: sorted((r.doc_id, r.size, r.copies) for r in out.collect())
    assert key(mixing.sample(df)) == key(mixing.sample(df.repartition(7)))
    out = mixing.sample(df, shard=16).collect()  # three levels of walks
    taken, want = defaultdict(int), {}
    for r in out:
        taken[r.source] += r.size * r.copies
        want[r.source] = r.target
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 200 for s in want)
    assert mixing.sample(docs(spark, [])).count() == 0
    assert {r.copies for r in mixing.sample(docs(spark, [(1, None), (2, "")])).collect()} <= {0, 1, 2}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in mixing.sample(df).collect())


def test_mixing_with_very_long_documents(spark):
    """Documents a hundred times longer than the rest do not keep a source from its target."""
    rng = np.random.default_rng(24)
    rows = [(k, prose(rng, int(rng.integers(20, 300))), "abc"[k % 3]) for k in range(3000)] + [(9000 + k, "w " * 20_000, "abc"[k % 3]) for k in range(4)]
    for size in (mixing.SHARD, 600):
        taken, want = defaultdict(int), {}
        for r in mixing.sample(docs(spark, rows), shard=size).collect():
            taken[r.source] += r.size * r.copies
            want[r.source] = r.target
            assert 0 <= r.copies <= 2
        assert all(abs(taken[s] - want[s]) <= 10 for s in want)


def test_draw_keeps_tokens_and_expectations():
    import random

    rng = np.random.default_rng(25)
    x = np.append(rng.integers(50, 200, 300), 9000).astype(float).tolist()
    p = rng.uniform(0.3, 0.7, 301).tolist()
    total, mean = np.dot(p, x), np.zeros(301)
    for seed in range(400):
        q = mixing.draw(p, x, 300, random.Random(seed))
        assert q[300] in (0.0, 1.0) and abs(np.dot(q, x) - total) < 1 and all(0 <= v <= 1 for v in q)
        mean += np.asarray(q) / 400
    assert np.abs(mean - np.asarray(p)).max() < 0.1


def test_walk_keeps_totals():
    import random

    rng = np.random.default_rng(8)
    x = rng.integers(1, 1000, 200).astype(float)
    p = rng.random(200)
    q = mixing.walk(p.tolist(), x.tolist(), random.Random(1))
    assert abs(np.dot(p, x) - np.dot(q, x)) < 1e-6 and abs(p.sum() - sum(q)) < 1e-6
    assert sum(1e-9 < v < 1 - 1e-9 for v in q) <= 2


# --- 7 URL filter

def judged_by_force(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    cut = re.search(r"[/?#]", rest)
    host = (rest[: cut.start()] if cut else rest).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.split(r"[?#]", rest[cut.start() :])[0] if cut else ""
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_url_rules_and_trees(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://notexample.com/en/7", "ftp://x.net/de/1", "a://example.net/de/8/", "http://q.org?es/", "http://q.org/es/a#b", "http://éÀ.org/fr/", "x://com/en/", "http://u@h:8/p://q"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(3, "http://", "clash")], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(k, f"http://{'bad-spam-site' if k % 2 else 'fine'}{k}.example.fr/{'9' * (k % 7)}/a") for k in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = url_filter.train(labelled, labels)
    assert len(model.trees) == url_filter.TREES and model.auc > 0.95 and model.threshold < 1
    judged = url_filter.judge(labelled, model).collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in judged) >= 195
    for r in url_filter.judge(pages, model).collect():
        host, path, best = judged_by_force(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best[0] if best else None)
        assert r.verdict == (best[1] if best else "block" if r.score >= model.threshold else "allow")
    # the CASE expressions are the trees
    names = [f"f_{n}" for n in url_filter.FEATURES]
    base, trees, suffixes = model[:3]

    def grow(t, x):
        return t if isinstance(t, float) else grow(t[2] if x[t[0]] <= t[1] else t[3], x)

    for f, r in zip(url_filter.features(labelled.orderBy("page_id"), suffixes).collect(), sorted(judged, key=lambda r: r.page_id)):
        z = base + sum(grow(t, [f[n] for n in names]) for t in trees)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9
    assert url_filter.judge(pages.limit(0), model).count() == 0
    none = url_filter.train(labelled, labels.limit(0))
    assert none.trees == [] and none.threshold > 1 and {r.verdict for r in url_filter.judge(labelled, none).collect()} == {"allow"}


def test_rules_say_what_the_contract_says(spark):
    """Verdicts written out here, not taken from RULES: each rule, a subdomain, the longer rule over the shorter, and URLs that just miss."""
    want = {
        "http://com/en/1": ("com/en/", "block"), "http://www.a.com/en/": ("com/en/", "block"), "http://example.com/en/6": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"), "http://a.EXAMPLE.com/en/77?q": ("example.com/en/7", "allow"), "http://notexample.com/en/7": ("com/en/", "block"),
        "http://net/de/8": ("net/de/", "allow"), "http://www.a.net/de/1": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://a.Example.NET/de/80#x": ("example.net/de/8", "block"), "http://notexample.net/de/8": ("net/de/", "allow"),
        "http://org/es/": ("org/es/", "block"), "http://w.org/es/a/b": ("org/es/", "block"), "http://w.org/de/8": (None, None), "http://net.de/de/8": (None, None), "net/de/8": (None, None),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    for base, otherwise in ((-9.0, "allow"), (9.0, "block")):  # the trees' verdict counts only where no rule fits
        model = url_filter.Model(base, [], {"": 0.0}, 0.5, float("nan"))
        got = {r.url: (r.rule, r.verdict) for r in url_filter.judge(pages, model).collect()}
        assert got == {u: (rule, verdict or otherwise) for u, (rule, verdict) in want.items()}


def test_unseen_urls(spark):
    """Skill on URLs that had no part in the fit, none on labels that URLs do not tell, and then nothing is blocked."""
    rng = np.random.default_rng(23)
    words = ["".join(rng.choice(list("aeinorst"), 6)) for _ in range(400)]
    urls, bad = [], []
    for k in range(1500):
        b = k % 4 == 0
        urls.append((k, f"http://{words[int(rng.integers(400))]}{'-' + str(rng.integers(100, 999)) if b or rng.random() < 0.1 else ''}.example.fr/{k}?a=1{'&b=2&c=3' if b and rng.random() < 0.7 else ''}"))
        bad.append(b)
    pages = spark.createDataFrame(urls, "page_id long, url string")
    model = url_filter.train(pages.where("page_id < 1000"), spark.createDataFrame([(k, int(not b), 0) for k, b in enumerate(bad)], "doc_id long, quality int, toxic int"))
    score = {r.page_id: (r.score, r.verdict) for r in url_filter.judge(pages.where("page_id >= 1000"), model).collect()}
    y = np.asarray([float(bad[k]) for k in sorted(score)])
    assert url_filter.area(np.asarray([score[k][0] for k in sorted(score)]), y) > 0.9 and model.auc > 0.9
    blocked = np.asarray([score[k][1] == "block" for k in sorted(score)])
    assert blocked[y == 1].mean() > 0.6 and blocked[y == 0].mean() < 0.2
    chance = url_filter.train(pages, spark.createDataFrame([(k, int(rng.random() < 0.85), 0) for k in range(1500)], "doc_id long, quality int, toxic int"))
    assert 0.35 < chance.auc < 0.65 and sum(r.verdict == "block" for r in url_filter.judge(pages, chance).collect()) < 75


def test_area_and_cutoff():
    s, y = np.asarray([0.9, 0.8, 0.8, 0.4, 0.3, 0.3]), np.asarray([1.0, 1, 0, 0, 1, 0])
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert abs(url_filter.area(s, y) - np.mean(pairs)) < 1e-12 and np.isnan(url_filter.area(s, np.ones(6)))
    assert url_filter.cutoff(np.repeat(s, 10), np.repeat(y, 10)) == 0.8 and url_filter.cutoff(s, y) == 2.0 and url_filter.cutoff(np.empty(0), np.empty(0)) == 2.0


def test_url_features_one_by_one(spark):
    urls = ["https://WWW.a-b-c.example.com/en/77/x.html?page=2&ref=x#top", "http://aabb/", "", None, "no scheme", "ftp://9.8.7.6:80", "http://é.org/ü?=1&&k=", "http://h/" + "9a/" * 3000 + "?q=" + "x" * 5000, "a://b?c#d?e=1"]
    rows = {r.id: r for r in url_filter.features(spark.createDataFrame(list(enumerate(urls)), "id int, url string"), {"com": 0.7, "": 0.2}).collect()}

    def entropy(t):
        return -sum(n / len(t) * np.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0

    for k, url in enumerate(urls):
        r, u = rows[k], url or ""
        host, path, _ = judged_by_force(url)
        suffix = host.rsplit(".", 1)[-1]
        want = {
            "url_length": len(u), "host_length": len(host), "path_length": len(path), "host_depth": host.count("."), "path_depth": path.count("/"), "digit_ratio": sum(c in "0123456789" for c in u) / max(1, len(u)),
            "host_hyphens": host.count("-"), "host_entropy": entropy(host), "path_entropy": entropy(path), "parameters": len(re.findall(r"[?&][^?&#=]+", u)), "has_fragment": "#" in u, "secure": u.startswith("https"),
            "suffix_length": len(suffix), "suffix_blocked": {"com": 0.7}.get(suffix, 0.2),
        }
        assert set(want) == set(url_filter.FEATURES)
        for name, value in want.items():
            assert abs(r[f"f_{name}"] - value) < 1e-9, (url, name)


def test_document_number(spark):
    urls = ["http://a.example.com/en/77/x.html", "http://a/en/5462.html?x=1", "http://a/en/12#top", "http://a/x9/y", None, "http://9/", "http://a/12345678901234567890/7"]
    got = [r.n for r in spark.createDataFrame(list(enumerate(urls)), "id int, url string").select("id", url_filter.document_number(F.col("url")).alias("n")).orderBy("id").collect()]
    assert got == [77, 5462, 12, None, None, None, 7]


# --- 8 winnowing

def winnow_by_force(text):
    """Positions and hashes from their definition, in plain integers."""
    points = [ord(c) for c in text]
    if not points:
        return []

    def hashed(part):
        h = 0
        for p in part:
            h = (h * 0x9E3779B1 + ((p * 0x85EBCA6B & 0xFFFFFFFF) ^ (p >> 7))) & 0xFFFFFFFF
        h = (h ^ (h >> 16)) * 0x7FEB352D & 0xFFFFFFFF
        h = (h ^ (h >> 15)) * 0x846CA68B & 0xFFFFFFFF
        return h ^ (h >> 16)

    hashes = [hashed(points[i : i + 8]) for i in range(max(1, len(points) - 7))]
    w, h = min(16, len(hashes)), {}
    for i in range(len(hashes) - w + 1):
        window = hashes[i : i + w]
        j = max(k for k in range(w) if window[k] == min(window))
        h[i + j] = hashes[i + j]
    return sorted(h.items())


def likeness_by_force(a, b):
    x, y = {h for _, h in winnow_by_force(a)}, {h for _, h in winnow_by_force(b)}
    return len(x & y) / len(x | y) if x or y else 1.0


def test_winnow_by_force():
    rng = np.random.default_rng(9)
    for n in (0, 1, 5, 7, 8, 9, 22, 23, 24, 40, 300):
        text = "".join(rng.choice(list("ab\U0001f600c"), n))
        p, h = winnow.winnow(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        assert list(zip(p.tolist(), h.tolist())) == winnow_by_force(text)
    shared = "".join(rng.choice(list("abcdefgh"), winnow.K + winnow.W - 1))
    a, b = ({int(x) for x in winnow.winnow(np.frombuffer(t.encode("utf-32-le"), np.uint32))[1]} for t in ("qq" * 30 + shared, shared + "zyx" * 30))
    assert a & b


def test_winnow_neighbours(spark):
    rng = np.random.default_rng(10)
    rows = [(int(k), prose(rng, int(rng.integers(0, 80)))) for k in rng.permutation(300)] + [(None, "none"), (17, None), (9999, "\U0001f600" * 10)]
    hashed = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), hashed[r[1]], r[1]))
    for size in (1 << 30, 2000):
        got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in winnow.neighbours(docs(spark, rows), range_bytes=size).collect()}
        assert len(got) == len(rows)
        for k, (d, t) in enumerate(order):
            nd, nt = order[(k + 1) % len(order)]
            third = len(t) // 3
            edited = t[: len(t) - third] + nt[:third]
            r = got[d, len(t), hashlib.sha256(edited.encode()).hexdigest()]
            assert r.next_doc_id == nd and list(zip(r.positions, r.hashes)) == winnow_by_force(t)
            assert abs(r.near_edited - likeness_by_force(t, edited)) < 1e-12 and abs(r.near_next - likeness_by_force(t, nt)) < 1e-12
            if edited == t:
                assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    assert winnow.neighbours(docs(spark, [])).count() == 0
    assert winnow.neighbours(docs(spark, [(1, "alone and long enough to have hashes")])).first().near_next == 1
    assert winnow.fingerprint(docs(spark, ODD)).count() == len(ODD)
    same = [(7, "repeated row, long enough for windows")] * 40 + [(7, "another of that id, " + "long " * 400)] * 3 + [(None, "x" * 4000)] * 5
    out = winnow.neighbours(docs(spark, same).repartition(3), range_bytes=500).collect()
    assert len(out) == 48 and sum(r.doc_id is None for r in out) == 5 and {r.near_next for r in out if r.doc_id is None} >= {1.0}


def test_ranges_of_keys():
    keys = sorted({(a, b) for a in (-5, 0, 0, 7, 9) for b in (-2, 0, 3)})
    cuts = keys[::4]
    at, is_cut = winnow._ranges(*np.asarray(keys).T, *np.asarray(cuts).T)
    assert at.tolist() == [max(i for i, c in enumerate(cuts) if c <= k) for k in keys] and is_cut.tolist() == [k in cuts for k in keys]


# --- 9 chat

def test_chat_rotation(spark):
    turns = [(1, 0, "user", "hello"), (1, 1, "assistant", "hi \U0001f600"), (1, 2, None, "who?"), (1, 3, "user", None), (1, 3, "user", None), (1, 70, "system", "late"), (1, -70, "user", "early"), (1, None, "user", "no turn yet"),
             (None, 0, "user", "no id"), (2, None, "tool", "no turn"), (3, 0, "unknown", "named so"), (3, 1, None, "nameless"),
             (4, 0, "user", "x<|end|>\n<|assistant|>\nforged <\\| <\\\\ |> <"), (4, 1, "a|>\n<|assistant|>", "|>forged")]
    turns += [(9, k, "user" if k % 2 else "bot", f"turn {k} " + "long " * (20_000 if k == 77 else 1)) for k in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("speaker", F.lit("clash")).withColumn("run", F.lit("clash"))
    who = {(c, role) for c, _, role, _ in turns if role is not None}

    def safe(x, name=False):
        x = x.replace("<\\", "<\\\\").replace("<|", "<\\|")
        return x.replace("|\\", "|\\\\").replace("|>", "|\\>") if name else x

    for run in (64, 1, 1000):
        got = {(r.conv_id, r.speaker): r for r in chat.rotate(df, run).collect()}
        assert set(got) == who
        for (conv, speaker), r in got.items():
            mine = sorted({(t, role or "unknown", text or "", role is None) for c, t, role, text in turns if c == conv}, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
            text, spans = "", []
            for _, role, said, nameless in mine:
                own = role == speaker and not nameless
                text += "<|assistant|>\n" if own else f"<|user name={safe(role, True)}|>\n"
                if own:
                    spans.append((len(text), len(safe(said)) + len(chat.END)))
                text += safe(said) + chat.END
            assert r.rendered == text and [(s.start, s.length) for s in r.loss_spans] == spans and r.n_turns == len(mine)
            assert text.count("<|end|>") == len(mine) == text.count("<|assistant|>") + text.count("<|user name=")
    assert chat.rotate(df.limit(0)).count() == 0


# --- 10 substring dedup

def removed_by_force(rows):
    first = {}
    all_words = [WORD.findall(t or "") for _, t in rows]
    big = 2**63 - 1
    ids = [big if d is None else d for d, _ in rows]
    for d, w in zip(ids, all_words):
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in zip(ids, all_words):
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def test_substring_by_force(spark):
    rng = np.random.default_rng(11)
    passages = [prose(rng, int(n), 9000) for n in (12, 13, 14, 60, 200)]
    rows = list(ODD)
    for k in range(150):
        parts = [prose(rng, int(rng.integers(0, 60)), 9000)] + [passages[int(j)] for j in rng.integers(0, 5, int(rng.integers(0, 3)))] + [prose(rng, int(rng.integers(0, 30)), 9000)]
        rows.append((1000 - k, " \n".join(parts)))
    rows += [(500, rows[-1][1]), (2000, rows[-1][1]), (2000, rows[-1][1])]
    want = Counter((d, *r) for (d, _), r in zip(rows, removed_by_force(rows)))
    for df, size in ((docs(spark, rows), 1 << 23), (docs(spark, rows).repartition(6), 5000)):
        out = substring.dedup(df, bucket_bytes=size)
        assert out.columns[: len(DOCS.split(", "))] == [c.split()[0] for c in DOCS.split(", ")]
        assert Counter(tuple(r) for r in substring.digest(out).collect()) == want
        kept = {r.doc_id: r.text for r in out.collect()}
        assert kept[1] is None and kept[3] == " \t\n "
    assert substring.dedup(docs(spark, [])).count() == 0


class Caught:
    """In place of a DataFrame: keeps the function that it would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        self.run = lambda batch: f(iter([batch]))
        return self

    def mapInPandas(self, f, _):
        self.run = lambda batch: f(iter([batch.to_pandas()]))
        return self


def test_substring_memory_of_a_task():
    """Arrays of one chunk at a time: 27, 23 and 5 times its text (of short words); 46, 44 and 23 with the chunk before held too and 64-bit sums per byte."""
    rng = np.random.default_rng(12)
    texts = [[prose(rng, 1000, 9000) for _ in range(200)] for _ in range(4)]
    texts[1][:20] = texts[0][:20]

    def payload(part):
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.array(range(200), pa.int64()), "text": part})
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return sink.getvalue().to_pybytes()

    size = max(sum(map(len, part)) for part in texts)
    batch = pa.record_batch({"chunk": pa.array(range(4), pa.int64()), "payload": [payload(part) for part in texts]})
    peaks = []

    def peak(f):
        tracemalloc.start()
        f()
        peaks.append(tracemalloc.get_traced_memory()[1] / size)
        tracemalloc.stop()

    send, extend, bag = substring._send_anchors(Caught(), 1), substring._extend(Caught(), 1), words.Bag([t.encode() for t in texts[0]])
    everything = [[{"n": 10, "places": substring._squeeze(np.ones(10, dtype=np.uint32))}]] * 4
    peak(lambda: [None for _ in send.run(batch)])
    peak(lambda: [None for _ in extend.run(batch.append_column("places", pa.array(everything)))])
    peak(lambda: substring._cut(bag, np.arange(len(bag.starts)) % 3 == 0))
    assert peaks[0] < 34 and peaks[1] < 30 and peaks[2] < 10


def test_word_hashes_in_segments(monkeypatch):
    texts = [b"alpha beta  gamma", b"", b"beta " * 50, b"\tgamma\n", b"z" * 700]
    whole = words.Bag(texts).hashes
    monkeypatch.setattr(words, "_SEGMENT", 16)
    assert (words.Bag(texts).hashes == whole).all()
    assert whole[1] == whole[3] and whole[2] == whole[-2] and len(set(whole.tolist())) == 4


# --- the registered queries

def test_queries_against_their_sql(spark, sf_dir):
    """Every registered query with SQL on the smallest tables."""
    import duckdb

    from gridloom.llm import queries

    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        theirs = con.execute(sql).df()
        ours = queries.queries()[name](spark, sf_dir).toPandas()[list(theirs.columns)]
        rows = [sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist())) for df in (ours, theirs)]
        assert rows[0] == rows[1], name
