"""Round trips, tampering and rates of the codecs and containers."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import bytestats, codec, entropy, sniff
from gridloom.sources import archive
from gridloom.streaming import chunks


@pytest.mark.parametrize("mode", ["fast", "strong", "geometric", "predictor", "no such mode"])
def test_bytes_round_trip(mode):
    for data in (b"", b"a", b"A" * 300 + b"B" * 300, bytes(range(256)) * 2, "größer, größer. ".encode() * 20):
        assert codec.decompress(codec.compress(data, mode)) == data


def test_random_bytes_are_stored():
    data = np.random.default_rng(5).integers(0, 256, 2000, dtype=np.uint8).tobytes()
    assert len(codec.compress(data)) == len(data) + codec.HEADER + 1


def test_many_lengths():
    rng = np.random.default_rng(6)
    for n in rng.integers(1, 900, 25):
        data = rng.choice([0, 255, 254, 7], int(n)).astype(np.uint8).tobytes()  # runs of 0xFF exercise the carry
        assert codec.decompress(codec.compress(data, "fast")) == data


def test_tampering_is_seen():
    packed = bytearray(codec.compress(b"a short sentence, again and again. " * 20, "fast"))
    packed[-5] ^= 1
    with pytest.raises(ValueError):
        codec.decompress(bytes(packed))
    with pytest.raises(ValueError):
        codec.decompress(b"nonsense" * 20)


def test_symbols_near_entropy():
    rng = np.random.default_rng(0)
    s = rng.choice(2, 20000, p=[0.999, 0.001]).tolist()
    assert len(entropy.encode_symbols(s, 2)) < 400
    assert entropy.decode_symbols(entropy.encode_symbols(s, 2), len(s), 2) == s
    z = (rng.zipf(1.5, 2000) % 4096).tolist()
    assert entropy.decode_symbols(entropy.encode_symbols(z, 4096), len(z), 4096) == z


def test_predictor_registry():
    with pytest.raises(ValueError):
        entropy.register_predictor("", entropy.NGramMix)
    with pytest.raises(KeyError):
        entropy.get_predictor("absent")
    entropy.register_predictor("flat", lambda: entropy.FromFunction(lambda seen: np.zeros(256), logits=True))
    data = b"abcabcabc" * 30
    assert codec.decompress(codec.compress(data, "predictor:flat")) == data
    for name in ("gru", "ngram-mix"):
        packed = codec.compress(data, f"predictor:{name}")
        assert codec.decompress(packed) == data and len(packed) < len(data) + codec.HEADER


def test_predictors_travel_to_executors(spark):
    class Repeats:
        def reset(self):
            self.last = 0

        def predict(self):
            return np.where(np.arange(256) == self.last, 200.0, 1.0)

        def update(self, byte):
            self.last = byte

    entropy.register_predictor("repeats", Repeats)
    df = spark.createDataFrame([(1, "a" * 500), (2, None)], "id int, text string")
    rows = {r.id: r for r in codec.decompress_column(codec.compress_column(df, "text", mode="predictor:repeats")).collect()}
    assert bytes(rows[1].data) == b"a" * 500 and len(rows[1].archive) < 150 and rows[2].data is None


def test_apportioned_weights():
    rng = np.random.default_rng(3)
    for w in (rng.random(256), np.zeros(256), np.eye(256)[7], np.full(256, 1e300), np.r_[np.nan, -1.0, np.inf, rng.random(253)], rng.random(256) ** 40):
        parts = entropy.apportion(w)
        assert parts.sum() == entropy.MAX_TOTAL and parts.min() >= 1
        good = np.where(np.isfinite(w) & (w > 0), w, 0)
        if 0 < good.sum() < np.inf:
            assert np.abs(parts - 1 - good / good.sum() * (entropy.MAX_TOTAL - 256)).max() < 1


def test_consolidated_archive(spark):
    rng = np.random.default_rng(8)
    kinds = rng.normal(0, 1.5, (12, 24))
    rows = (kinds[rng.integers(0, 12, 120)] + rng.normal(0, 0.05, (120, 24))).astype(np.float32)
    ids = [f"row {k}" for k in range(120)]
    back, names = codec.deconsolidate(codec.consolidate(rows, ids))
    assert (back.view("<u4") == rows.view("<u4")).all() and names == ids
    rough, names = codec.deconsolidate(codec.consolidate(rows, ids, exact=False))
    assert names == ids and 0 < np.abs(rough - rows).max() < 3
    assert abs((rough.astype(float) ** 2).sum() / (rows.astype(float) ** 2).sum() - 1) < 1e-5  # mass is kept
    assert codec.deconsolidate(codec.consolidate(rows))[1] is None
    assert codec.deconsolidate(codec.consolidate(np.zeros((0, 24)), []))[1] == []
    with pytest.raises(codec.MissingAddresses):
        codec.consolidate(rows, exact=False)
    with pytest.raises(ValueError):
        codec.consolidate(rows[:, :8])
    damaged = bytearray(codec.consolidate(rows, ids))
    damaged[20] ^= 1
    with pytest.raises(ValueError):
        codec.deconsolidate(bytes(damaged))
    told = codec.inspect(spark.createDataFrame([(codec.consolidate(rows, ids),), (codec.compress(b"abc"),)], "archive binary")).collect()
    assert [r.members for r in told] == [120, 0] and told[0].regime == codec.SITES and all(r.valid and r.version == codec.VERSION for r in told)


def test_tensor_rate_and_distortion():
    w = np.random.default_rng(1).normal(0, 0.02, (64, 96)).astype(np.float32)
    last = -1e9
    for scale in (2.0, 4.0, 8.0):
        packed = codec.compress_tensor(w, scale)
        back = codec.decompress_tensor(packed)
        snr = 10 * np.log10((w**2).sum() / ((w - back) ** 2).sum())
        assert back.shape == w.shape and snr > last + 3
        last = snr
        if scale == 4.0:
            assert 8 * len(packed) / w.size < 5.5 and snr > 22
    assert codec.decompress_tensor(codec.compress_tensor(w, 4.0, shells=True)).shape == w.shape


def test_legacy_modes():
    data = b"one two three " * 40
    for mode in codec.LEGACY:
        out = codec.legacy_decompress(codec.legacy_compress(data, mode))
        assert len(out) == len(data) and (out == data or mode == "mythic")
        told = codec.legacy_info(codec.legacy_compress(data, mode))
        assert told["mode"] == mode and told["summary"]["vectors"] == 9 and codec.legacy_decompress(codec.legacy_compress(b"", mode)) == b""
    with pytest.raises(ValueError):
        codec.legacy_compress(data, "standard")


def test_columns_and_inspect(spark):
    df = spark.createDataFrame([(1, "hello hello hello"), (2, None), (3, "")], "id int, text string")
    rows = {r.id: r for r in codec.decompress_column(codec.inspect(codec.compress_column(df, "text"))).collect()}
    assert bytes(rows[1].data) == b"hello hello hello" and rows[1].source_length == 17 and rows[1].truth == "exact_recovery"
    assert rows[2].archive is None and rows[2].data is None and bytes(rows[3].data) == b""


def test_archive_source(spark, tmp_path):
    files = spark.createDataFrame([("x", "b.txt", b"bb" * 50), ("x", "a.txt", b"a"), ("y", "c", b"")], "archive string, name string, content binary")
    packed = archive.bundle(files)
    got = {(r.archive, r.name): bytes(r.content) for r in archive.members(packed).collect()}
    assert got == {("x", "a.txt"): b"a", ("x", "b.txt"): b"bb" * 50, ("y", "c"): b""}
    for r in packed.collect():
        (tmp_path / r.archive).write_bytes(r.data)
    archive.register(spark)
    read = spark.read.format("gridloom_archive").load(str(tmp_path)).collect()
    assert sorted((r.name, bytes(r.content)) for r in read) == [("a.txt", b"a"), ("b.txt", b"bb" * 50), ("c", b"")]
    names = spark.read.format("gridloom_archive").option("index", "true").load(str(tmp_path)).collect()
    assert sorted((r.name, r.original_size, r.content) for r in names) == [("a.txt", 1, None), ("b.txt", 100, None), ("c", 0, None)]


def test_transform_keeps_nulls(spark):
    from gridloom.operators import hadamard

    df = spark.createDataFrame([(1, [1.0] * 8), (2, None)], "id int, v array<double>")
    back = {r.id: r.v for r in hadamard.transform(hadamard.transform(df), inverse=True).collect()}
    assert back[2] is None and max(abs(x - 1) for x in back[1]) < 1e-12


def test_chunk_stream_source(spark, tmp_path):
    blob = os.urandom(5000) + b"z" * 5000
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one").write_bytes(archive.write_stream(blob, 1000))
    archive.register(spark)
    stream = spark.readStream.format("gridloom_chunks").load(str(tmp_path / "s"))
    q = stream.writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = sorted(spark.table("chunks").collect(), key=lambda r: r.chunk)
    assert b"".join(bytes(r.data) for r in rows) == blob
    damaged = bytearray(archive.write_stream(blob, 1000))
    damaged[16] ^= 1
    with pytest.raises(ValueError):
        list(archive.read_stream(bytes(damaged)))


def test_compress_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc " * 400), (2, "")], "id int, text string")
    chunks.split(docs, "id", "text", 500).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    chunks.compress_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    back = chunks.decompress_table(spark, str(tmp_path / "out"))
    text = {r.id: b"".join(bytes(x.data) for x in sorted(r.parts, key=lambda p: p.chunk)) for r in back.groupBy("id").agg(F.collect_list(F.struct("chunk", "data")).alias("parts")).collect()}
    assert text == {1: ("abc " * 400).encode(), 2: b""}
    assert chunks.statistics(spark.read.parquet(str(tmp_path / "out"))).first().total == 1600


def test_running_sites(spark, tmp_path):
    rows = spark.createDataFrame([(k, [float(k % 3) * 4] + [0.0] * 23) for k in range(9)], "id long, v array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = chunks.running_sites(stream).writeStream.format("memory").queryName("sites").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("sites").collect()) == [3, 3, 3]


def test_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = chunks.windowed(stream).writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").count() > 0


def test_sniffing(spark):
    rows = [("a.bin", b"\x89PNG\r\n\x1a\n" + b"x", 9), ("b.JPG", b"plain", 5), ("noext", b"zz", 2), ("t.txt", b"MZ", 2), ("u", b"MZx", 3)]
    out = {r.path: r for r in sniff.analyze(spark.createDataFrame(rows, "path string, content binary, length long")).collect()}
    assert (out["a.bin"].mime, out["a.bin"].mode, out["a.bin"].is_precompressed) == ("image/png", "fast", True)
    assert out["b.JPG"].category == "compressed_image" and out["noext"].category == "unknown"
    assert out["t.txt"].category == "text"  # a rule needs more bytes than its own
    assert out["u"].category == "binary"


def test_byte_entropy(spark):
    df = spark.createDataFrame([("abab" * 100,), (None,), ("",)], "t string")
    r = bytestats.conditional_entropy(df, "t", 0).first()
    assert (r.n_bytes, r.contexts) == (400, 1) and abs(r.bits_per_byte - 1) < 1e-12
    assert bytestats.conditional_entropy(df, "t", 1).first().bits_per_byte == 0


def test_command_line(spark, tmp_path, capsys):
    from gridloom import cli

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.txt").write_text(f"file {k} " * 100)
    stored, plain = str(tmp_path / "stored"), str(tmp_path / "plain")
    assert cli.compress(spark, str(tmp_path / "in"), stored, "fast") == 0
    assert "3 files" in capsys.readouterr().out
    assert cli.test(spark, stored) == 0 and cli.listing(spark, stored) == 0 and cli.info(spark, stored) == 0
    assert cli.decompress(spark, stored, plain) == 0
    assert sorted(bytes(r.data) for r in spark.read.parquet(plain).collect()) == [(f"file {k} " * 100).encode() for k in range(3)]


def test_rate_distortion_codes_every_weight(spark):
    """The query against the whole vectors of each label, coded by numpy; blocks of a tensor add up."""
    from gridloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    pdf = spark.read.parquet(f"{sf}/embeddings.parquet").where("label = 3").orderBy("vec_id").toPandas()
    w = np.concatenate([np.asarray(v, dtype=np.float64) for v in pdf.embedding])
    archive = codec.compress_tensor(w, 4.0)
    got = catalog.tensor_rate_distortion(spark, sf).where("tensor_id = 3 AND scale = 4.0").first()
    assert abs(got.bits_per_weight - 8 * len(archive) / len(w)) < 1e-4
    assert abs(got.snr_db - 10 * np.log10((w**2).sum() / ((w - codec.decompress_tensor(archive)) ** 2).sum())) < 1e-3
    parts = spark.createDataFrame([(1, w[:640].tolist()), (1, w[640:].tolist())], "tensor_id long, w array<double>")
    assert abs(codec.bits_to_snr(parts, (4.0,)).first().bits_per_weight - 8 * sum(len(codec.compress_tensor(x, 4.0)) for x in (w[:640], w[640:])) / len(w)) < 1e-9


def _mixed_blobs():
    rng = np.random.default_rng(11)
    few = [rng.choice([0, 255, 254, 7], int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 700, 60)]  # runs of 0xFF exercise the carry
    noise = [rng.integers(0, 256, int(n), dtype=np.uint8).tobytes() for n in rng.integers(0, 700, 60)]
    words = [" ".join(rng.choice(["größer", "and", "again", "sentence", "7"], int(n))).encode() for n in rng.integers(1, 90, 150)]
    return [b"", b"a", b"A" * 3000 + b"B" * 3000, *few, *noise, *words, b"", b"\xff" * 900]


def test_many_blobs_in_step(monkeypatch):
    """The same bytes as one blob at a time, whatever the lanes, groups and blobs left alone."""
    blobs = _mixed_blobs()
    one = [entropy.encode_bytes(b, entropy.CONTEXTS["fast"]) for b in blobs]
    assert entropy.encode_all(blobs) == one and entropy.decode_all(one, [len(b) for b in blobs]) == blobs
    assert entropy.encode_all([]) == [] == entropy.decode_all([], []) and entropy.encode_all([b"", b"one"]) == [entropy.encode_bytes(b, entropy.CONTEXTS["fast"]) for b in (b"", b"one")]
    monkeypatch.setattr(entropy, "LANES", 14)
    monkeypatch.setattr(entropy, "GROUP", 30_000)
    assert entropy.encode_all(blobs) == one and entropy.decode_all(one, [len(b) for b in blobs]) == blobs
    assert codec.compress_all(blobs, "fast") == [codec.compress(b, "fast") for b in blobs]
    packed = [codec.compress(b, ("fast", "strong", "raw")[k % 3]) for k, b in enumerate(blobs[:80])]
    assert codec.decompress_all(packed) == blobs[:80]


def test_damage_is_seen_in_step():
    texts = [f"sentence {k}, again and again. ".encode() * 20 for k in range(40)]
    packed = codec.compress_all(texts, "fast")
    assert codec.decompress_all(packed) == texts
    for damaged in (packed[7][:-30], packed[7][: codec.HEADER + 1], packed[7][:60] + bytes([packed[7][60] ^ 1]) + packed[7][61:]):
        with pytest.raises(ValueError):
            codec.decompress_all([*packed[:7], damaged, *packed[8:]])


def test_coding_in_step_is_fast():
    """Texts of 300 lanes take less than a third of the time of one after the other (a tenth, alone on a machine)."""
    rng = np.random.default_rng(3)
    blobs = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "magna"], 250)).encode() for _ in range(600)]
    took = []
    for run in (lambda: entropy.decode_all(entropy.encode_all(blobs), [len(b) for b in blobs]), lambda: [entropy.decode_bytes(entropy.encode_bytes(b, entropy.CONTEXTS["fast"]), len(b), entropy.CONTEXTS["fast"]) for b in blobs[:60]]):
        began = time.process_time()
        run()
        took.append(time.process_time() - began)
    assert took[0] * 3 < took[1] * 10


def test_stream_roundtrip_keeps_odd_texts(spark, tmp_path):
    """Null, empty, long and many texts against their hashes."""
    import hashlib

    from gridloom.plans import catalog

    texts = {1: None, 2: "", 3: "größer, " * 20_000, 4: "x" * 65536} | {k: f"text {k} " * (k % 40) for k in range(5, 120)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.sha256 for r in catalog.stream_roundtrip(spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
