"""Spectra, codecs, layers, sources, clustering, decoding and streams against plain restatements."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.functions import kernels as K
from chorale.functions import signal, text
from chorale.operators import clustering, scorer
from chorale.sources import audio, models
from chorale.streaming import chunks


def test_power_spectrum_is_the_transform():
    x = np.random.default_rng(0).normal(size=400).astype(np.float32)
    k, n = np.arange(257)[:, None], np.arange(512)[None]
    direct = np.abs((np.pad(x, (0, 112)) * np.exp(-2j * np.pi * k * n / 512)).sum(axis=1)) ** 2
    assert np.allclose(K.power_spectrum(x), direct, rtol=1e-4)


def test_log_mel_shape_and_silence():
    assert K.log_mel(np.zeros(16000)).shape == (80, 101)
    assert np.allclose(K.log_mel(np.zeros(1600)), (-10 + 4) / 4)
    assert K.frame_count(16000 * 60) == 3000


def test_filters_agree_with_rows(spark):
    rows = signal.mel_filterbank(spark).toPandas().sort_values(["mel", "bin"])
    assert np.allclose(rows.weight.to_numpy().reshape(80, 201), K.mel_filters(), atol=1e-6)


@pytest.mark.parametrize("kind,steps", [("q8_0", 127), ("q5_0", 15), ("q4_0", 8)])
def test_codec_round_trip(kind, steps):
    x = np.random.default_rng(1).normal(size=320).astype(np.float32)
    raw = K.quantize(x, kind)
    assert len(raw) == K.row_bytes(320, kind)
    step = np.abs(x.reshape(-1, 32)).max(axis=1).repeat(32) / steps
    assert (np.abs(K.dequantize(raw, kind) - x) <= step * (1.01 if kind == "q4_0" else 0.51) + 1e-3).all()
    assert K.quantized_dot(raw, kind, x) == pytest.approx(float(K.dequantize(raw, kind) @ x))
    assert (K.dequantize(K.quantize(np.zeros(32), kind), kind) == 0).all()
    assert list(K.half_away(np.array([0.5, -0.5, 1.5, 2.5]))) == [1, -1, 2, 3]


def test_attention_and_cache():
    rng = np.random.default_rng(2)
    q, k, v = (rng.normal(size=(5, 8)).astype(np.float32) for _ in range(3))
    whole, w = K.attention(q, k, v, 2, K.causal_mask(5))
    assert np.allclose(w.sum(axis=1), 1, atol=1e-5) and np.allclose(np.triu(w, 1), 0)
    cache = K.KeyValueCache(5, 8)
    for i in range(5):
        ks, vs = cache.append(k[i : i + 1], v[i : i + 1])
        assert np.allclose(K.attention(q[i : i + 1], ks, vs, 2)[0], whole[i : i + 1], atol=1e-5)
    with pytest.raises(ValueError):
        cache.append(k[:1], v[:1])
    x = rng.normal(size=(3, 10))
    weight = rng.normal(size=(4, 3, 3))
    got = K.conv1d(x, weight, np.zeros(4), stride=2)
    assert got.shape == (4, 5) and got[1, 2] == pytest.approx((np.pad(x, ((0, 0), (1, 1)))[:, 4:7] * weight[1]).sum())


def wav(data: bytes, code=1, channels=1, rate=16000, bits=16, extra=b"") -> bytes:
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + extra + b"fmt " + struct.pack("<IHHIIHH", 16, code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + b"data" + struct.pack("<I", len(data)) + data


def test_wav_depths_and_errors(spark, tmp_path):
    assert list(audio.decode_wav(wav(bytes([0, 128, 255]), bits=8))) == [-1.0, 0.0, 127 / 128]
    assert list(audio.decode_wav(wav(struct.pack("<2h", -32768, 16384)))) == [-1.0, 0.5]
    assert list(audio.decode_wav(wav(b"\x00\x00\x80\x00\x00\x40", bits=24))) == [-1.0, 0.5]
    assert list(audio.decode_wav(wav(struct.pack("<2i", -(2**31), 2**30), bits=32))) == [-1.0, 0.5]
    assert list(audio.decode_wav(wav(struct.pack("<2f", 0.25, -0.5), code=3, bits=32))) == [0.25, -0.5]
    assert list(audio.decode_wav(wav(struct.pack("<5h", 0, 16384, 16384, 16384, 7), channels=2, extra=b"LIST\x03\x00\x00\x00abc\x00"))) == [0.25, 0.5]
    for bad in (b"", b"RIFF1234WAVE", wav(b"ab", code=7), b"RIFF1234WAVEdata\x02\x00\x00\x00ab"):
        with pytest.raises(audio.AudioError):
            audio.decode_wav(bad)
    up = audio.resample(np.array([0.0, 1.0], np.float32), 8000)
    assert list(up) == [0.0, 0.5, 1.0, 1.0]
    (tmp_path / "a.wav").write_bytes(wav(struct.pack("<2h", -32768, 16384)))
    (tmp_path / "b.flac").write_bytes(b"fLaC1234")
    got = {r.format: (list(r.samples), r.error) for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert got["wav"] == ([-1.0, 0.5], None) and got["flac"][1]


def gguf(tensors, meta, alignment=32) -> bytes:
    string = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(meta))
    for k, v in meta.items():
        head += string(k) + (struct.pack("<I", 8) + string(v) if isinstance(v, str) else struct.pack("<IIQ", 9, 8, len(v)) + b"".join(map(string, v)) if isinstance(v, list) else struct.pack("<II", 4, v))
    body, at = b"", 0
    for name, (shape, kind, raw) in tensors.items():
        head += string(name) + struct.pack(f"<I{len(shape)}QIQ", len(shape), *shape, kind, at)
        raw += b"\0" * (-len(raw) % alignment)
        body, at = body + raw, at + len(raw)
    return head + b"\0" * (-len(head) % alignment) + body


SIZES = dict(n_vocab=50370, n_audio_ctx=50, n_audio_state=8, n_audio_head=2, n_audio_layer=1, n_text_ctx=16, n_text_state=8, n_text_head=2, n_text_layer=2, n_mels=80)


def tiny_model() -> bytes:
    rng = np.random.default_rng(5)
    shapes = {"encoder.conv1.weight": (3, 80, 8), "encoder.conv1.bias": (8,), "encoder.conv2.weight": (3, 8, 8), "encoder.conv2.bias": (8,), "encoder.positional_embedding": (8, 50), "decoder.positional_embedding": (8, 17), "decoder.token_embedding.weight": (8, SIZES["n_vocab"])}
    for block, parts in (("encoder.blocks.0", ["attn"]), ("decoder.blocks.0", ["attn", "cross_attn"]), ("decoder.blocks.1", ["attn", "cross_attn"])):
        for part in parts:
            for p in ("query", "key", "value", "out"):
                shapes[f"{block}.{part}.{p}.weight"] = (8, 8)
                shapes[f"{block}.{part}.{p}.bias"] = (8,)
        for ln in [f"{p}_ln" for p in parts] + ["mlp_ln"]:
            shapes[f"{block}.{ln}.weight"] = shapes[f"{block}.{ln}.bias"] = (8,)
        shapes |= {f"{block}.mlp.0.weight": (8, 32), f"{block}.mlp.0.bias": (32,), f"{block}.mlp.2.weight": (32, 8), f"{block}.mlp.2.bias": (8,)}
    for ln in ("encoder.ln_post", "decoder.ln"):
        shapes[f"{ln}.weight"] = shapes[f"{ln}.bias"] = (8,)
    tensors = {k: (s, 0, rng.normal(0, 0.5, s[::-1]).astype("<f4").tobytes()) for k, s in shapes.items()}
    meta = {models.KEYS[k][1]: v for k, v in SIZES.items()} | {"tokenizer.ggml.tokens": [" a", "b", " c"]}
    return gguf(tensors, meta)


def test_model_files(spark, tmp_path):
    data = tiny_model()
    model = models.parse(data)
    assert model.hparams["n_text_layer"] == 2 and model.vocab[:4] == [" a", "b", " c", "<|3|>"] and model.filters.shape == (80, 201)
    for broken in (data[:-400], data[:100], b"GGUF" + struct.pack("<IQQ", 2, 0, 0), b"GGUF" + struct.pack("<IQQ", 3, 1 << 40, 0), b"nope"):
        with pytest.raises(models.ModelError):
            models.parse(broken)
    rng = np.random.default_rng(0)
    for _ in range(200):  # damaged files give an error, never anything else
        head = bytearray(data[:3000])
        for i in rng.integers(0, 3000, 4):
            head[i] = rng.integers(256)
        try:
            models.parse(bytes(head))
        except (models.ModelError, struct.error):
            pass
    (tmp_path / "m.gguf").write_bytes(data)
    (tmp_path / "bad.gguf").write_bytes(data[:50])
    items = models.read_model(spark, str(tmp_path)).cache()
    assert items.where("part = 'error'").count() == 1
    from chorale.plans import facade

    assert facade.model_info(items).where("n_vocab is not null").first().n_vocab == SIZES["n_vocab"]
    assert models.count_blocks(items.where("part = 'tensor'"), "decoder.blocks.").first().n_blocks == 2
    assert facade.model_stats(items).first().n_tensors == len(model.tensors)


def test_legacy_model():
    raw = K.quantize(np.arange(64), "q8_0")
    data = b"lmgg" + struct.pack("<11i", *range(1, 12)) + struct.pack("<2i", 1, 2) + struct.pack("<2f", 0.5, 1.5) + struct.pack("<i", 2) + struct.pack("<i", 1) + b"a" + struct.pack("<i", 2) + b"bc"
    data += struct.pack("<3i", 1, 1, 3) + struct.pack("<i", 64) + b"x" + raw + struct.pack("<3i", 1, 1, 1) + struct.pack("<i", 2) + b"y" + np.array([1, 2], "<f2").tobytes()
    m = models.parse(data)
    assert m.vocab == ["a", "bc"] and list(models.values(*m.tensors["y"])) == [1, 2] and m.hparams["n_mels"] == 10
    assert np.allclose(models.values(*m.tensors["x"]), np.arange(64), atol=0.3)
    with pytest.raises(models.ModelError):
        models.parse(data[:-1])


def test_vocabularies(spark):
    assert models.parse_vocabulary('{"model": {"vocab": {"a": 0, "c": 2}}, "added_tokens": [{"id": 3, "content": "<x>"}]}') == ["a", "", "c", "<x>"]
    assert models.parse_vocabulary("a\nb\n") == ["a", "b"]
    v = spark.createDataFrame([(1, "x")], "token long, token_text string")
    assert [r.token_text for r in models.fill_gaps(v, 3).orderBy("token").collect()] == ["<|0|>", "x", "<|2|>"]
    names = spark.createDataFrame([("model.decoder.layers.3.encoder_attn.k_proj.weight",)], "name string")
    assert models.map_names(names).first().name == "decoder.blocks.3.cross_attn.key.weight"


class Planned:
    """A scorer that wants to say fixed tokens."""

    def __init__(self, said, vocab=("<|x|>", " hello", " world"), size=50500):
        self.said, self.vocab, self.size, self.context = list(said), list(vocab), size, 448

    def _logits(self, k):
        x = np.full(self.size, -5.0)
        x[self.said[k] if k < len(self.said) else scorer.END] = 30.0
        return x

    def start(self, samples, prompt):
        return self._logits(0), 0

    def step(self, state, token):
        return self._logits(state + 1), state + 1

    def attention(self, state):
        return np.eye(8)[state % 8] * 9


MARKS = [50364, 50364, 1, 50414, 50414, 2, 50464, 50464]


def test_decoding_loops():
    x = np.zeros(100, np.float32)
    o = scorer.Options(language="en", timestamps=True)
    assert scorer.transcribe(Planned(MARKS), x, o)[0].tokens == MARKS
    assert scorer.transcribe(Planned([1, 2]), x, scorer.Options(language="en", beam_width=3))[0].tokens == [1, 2]
    a = scorer.transcribe(Planned([1, 2]), x, scorer.Options(language="en", temperature=0.5, top_k=5, top_p=0.9))[0]
    assert a.tokens == [1, 2]
    assert scorer.transcribe(Planned([1, 1, 1, 1, 1]), x, scorer.Options(language="en", no_repeat_ngram_size=2))[0].tokens[:2] == [1, 1]
    assert scorer.language_code(scorer.language_token("fr")) == "fr" and scorer.language_token("??") == scorer.LANGUAGE
    for bad in ({"beam_width": 0}, {"temperature": -1}, {"top_p": 0}, {"no_speech_threshold": 2}, {"fallback_temperatures": (-1,)}):
        with pytest.raises(ValueError):
            scorer.Options(**bad)


def test_prompt_encoding_is_greedy():
    encode = scorer.PromptEncoder(["a", "ab", "ab", "c", ""])
    assert encode("abcxa") == [1, 3, 0]
    assert scorer.build_prompt(9, False, False, [5]) == [scorer.PREVIOUS, 5, scorer.START, 9, scorer.TRANSCRIBE, scorer.NO_TIMESTAMPS]


def test_transformer_steps_agree_with_a_prefill():
    tool = scorer.TransformerScorer(models.parse(tiny_model()))
    x = np.sin(np.arange(3200) / 20).astype(np.float32)
    whole, _ = tool.start(x, [1, 2, 3])
    _, state = tool.start(x, [1])
    for t in (2, 3):
        logits, state = tool.step(state, t)
    assert np.allclose(whole, logits, atol=1e-3)
    half = scorer.TransformerScorer(models.parse(tiny_model()), half_cache=True)
    assert np.allclose(half.start(x, [1, 2, 3])[0], whole, atol=0.2)
    assert tool.attention(state).sum() == pytest.approx(1, abs=1e-4)


def test_front_end_to_end(spark):
    from chorale.plans import facade

    t = np.arange(16000 * 4) / 16000
    x = (np.where((t % 2) < 1.5, 0.5, 0.0) * np.sin(2 * np.pi * 440 * t)).astype(float)
    sig = spark.createDataFrame([("c", 0, 0, x[:40000].tolist()), ("c", 1, 40000, x[40000:].tolist())], "clip_id string, chunk_idx int, start_sample long, samples array<float>")
    speech = facade.speech(sig).orderBy("start").collect()
    assert len(speech) == 2 and speech[0].start == 0 and 23000 < speech[0].end < 25000
    said = list(MARKS)
    segs = facade.transcribe(sig, lambda: Planned(said), scorer.Options(language="en", timestamps=True)).orderBy("seg_idx").collect()
    assert [(s.start, s.end, s.text) for s in segs] == [(0.0, 1.0, "hello"), (1.0, 2.0, "world")]
    tokens = facade.score(sig.limit(1), lambda: Planned([1, 2]), scorer.Options(language="en", word_timestamps=True))
    assert [w.word for w in facade.align_words(tokens).orderBy("word_idx").collect()] == ["hello", "world"]
    who = facade.diarize(sig).orderBy("start").collect()
    assert who and who[0].speaker == 0
    with pytest.raises(ValueError):
        facade.DiarizeOptions(hop_s=9)
    told = []
    progress = facade.Progress(spark, lambda done, total: told.append((done, total)))
    again = facade.transcribe(sig, lambda: Planned(said), scorer.Options(language="en", timestamps=True), progress=progress)
    assert len(progress.run(again.collect)) == len(segs)
    assert told == [(k + 1, len(told)) for k in range(len(told))] and len(told) == facade.plan_chunks(sig).count()


def test_progress_of_failures(spark):
    from chorale.plans.progress import Progress

    told = []
    progress = Progress(spark, lambda done, total: told.append(done), seconds=0.01)
    progress.expect(spark.range(3))
    with pytest.raises(KeyError):
        progress.run(lambda: {}["missing"])
    assert told == []
    spark.range(50).foreach(lambda r, d=progress.done: d.add(1))  # tasks that ran again counted more than there is
    assert progress.run(lambda: 7) == 7 and told == [1, 2, 3]

    def broken(done, total):
        raise OSError("no screen")

    progress = Progress(spark, broken)
    progress.expect(spark.range(1))
    with pytest.raises(OSError):
        progress.run(lambda: 7)


def test_embedders_keep_the_contract(spark):
    from chorale.operators import embedding
    from chorale.plans import facade

    model = tiny_model()
    tool = scorer.TransformerScorer(models.parse(model))
    x = np.sin(np.arange(16000) / 20).astype(np.float32)
    mean = embedding.EncoderEmbedder(tool)
    frames = tool.encode(x)
    assert mean.dim == 8 == frames.shape[1]
    assert np.allclose(mean.embed(x), frames.mean(axis=0) / np.linalg.norm(frames.mean(axis=0)))
    for bad in (lambda s, r: np.ones(3), lambda s, r: np.full(3, np.nan), lambda s, r: np.ones((1, 1))):
        with pytest.raises(ValueError):
            embedding.Checked(bad).embed(x)
    with pytest.raises(ValueError):
        mean.embed(x[:0])
    with pytest.raises(ValueError):
        embedding.unit(np.zeros(3))
    chunk = spark.createDataFrame([("c", 0, 0, x.tolist()), ("d", 0, 0, [])], "clip_id string, chunk_idx int, start_sample long, samples array<float>")
    got = {r.clip_id: r for r in facade.encoder_output(chunk, lambda: scorer.TransformerScorer(models.parse(model))).collect()}
    assert np.allclose(np.array(got["c"].output).reshape(got["c"].n_frames, got["c"].width), frames, atol=1e-5)
    assert got["d"].error and got["d"].output is None
    who = facade.diarize(chunk.limit(1), make_embedder=lambda: embedding.EncoderEmbedder(scorer.TransformerScorer(models.parse(model))))
    assert {r.speaker for r in who.collect()} == {0}


def blobs(k, n, seed):
    rng = np.random.default_rng(seed)
    centres = np.linalg.qr(rng.normal(size=(16, k)))[0].T
    truth = np.repeat(np.arange(k), n)
    x = centres[truth] + rng.normal(0, 0.05, (k * n, 16))
    order = rng.permutation(k * n)
    return (x / np.linalg.norm(x, axis=1, keepdims=True))[order], truth[order]


@pytest.mark.parametrize("how", [{"method": "ahc"}, {"method": "ahc", "k": 3}, {"method": "spectral"}, {"method": "kmeans", "k": 3}])
def test_planted_clusters(how):
    x, truth = blobs(3, 12, 4)
    got = clustering.cluster(x, **how)
    assert (got == clustering.compact(truth)).all()
    assert list(clustering.cluster(x[:1])) == [0] and got[0] == 0


def test_linkage_against_plain_restatement():
    x, _ = blobs(4, 6, 9)
    groups = [[i] for i in range(len(x))]
    d = 1 - x @ x.T
    while len(groups) > 4:
        i, j = min(((a, b) for a in range(len(groups)) for b in range(a + 1, len(groups))), key=lambda p: (np.mean(d[np.ix_(groups[p[0]], groups[p[1]])]), p))
        groups[i] += groups.pop(j)
    label = np.empty(len(x), int)
    for k, g in enumerate(groups):
        label[g] = k
    assert (clustering.compact(label) == clustering.cluster(x, "ahc", k=4)).all()


def test_entropy_cases(spark):
    d = spark.createDataFrame([("aaaaaaaaaa",), ("abcdefghijklmnopqrstuvwxyz",), ("",), (None,), ("éa" * 6,)], "t string")
    got = d.select(text.char_entropy(F.col("t")).alias("h"), text.is_hallucination(F.col("t")).alias("f")).collect()
    assert [round(r.h, 4) for r in got] == [0.0, 4.7004, 0.0, 0.0, 1.0]
    assert [r.f for r in got] == [True, False, False, False, True]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows, seq = [], {1: 0, 2: 0}
    for _ in range(12):
        for s in (1, 2):
            rows.append((s, seq[s], rng.random(int(rng.integers(0, 40))).astype(float).tolist(), False))
            seq[s] += 1
    rows += [(s, seq[s], [], True) for s in (1, 2)]
    schema = "stream_id long, seq long, samples array<float>, eos boolean"
    batch = chunks.batch_chunks(spark.createDataFrame(rows, schema), 50, 45).toPandas().sort_values(["stream_id", "chunk_idx"]).reset_index(drop=True)
    assert batch["last"].sum() == 2 and (batch[~batch["last"]].n_samples == 50).all()
    src = str(tmp_path / "in")
    for k in range(0, len(rows), 9):
        spark.createDataFrame(rows[k : k + 9], schema).coalesce(1).write.mode("append").parquet(src)
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = chunks.stream_chunks(sdf, 50, 45).writeStream.format("memory").queryName("chunks_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    live = spark.table("chunks_out").toPandas().sort_values(["stream_id", "chunk_idx"]).reset_index(drop=True)
    assert live.round(4).equals(batch.round(4))


def test_gaps_in_a_stream_wait():
    ahead = {s: (s, [], False) for s in (4, 1, 3)}
    assert [p[0] for p in chunks.in_order(ahead, 0, 9)] == [1] and sorted(ahead) == [3, 4]
    assert [p[0] for p in chunks.in_order(ahead, 1, 1)] == [3, 4] and not ahead


def test_streamed_transcripts_equal_batch(spark, tmp_path):
    from chorale.plans import facade
    from chorale.streaming import transcripts

    o = scorer.Options(language="fr", timestamps=True)
    n, said = 16000, list(MARKS)
    rows = [(s, k, [0.1] * n, False) for k in range(5) for s in (1, 2)] + [(s, 5, [], True) for s in (1, 2)]
    schema = "stream_id long, seq long, samples array<float>, eos boolean"
    batch = transcripts.transcribe(spark.createDataFrame(rows, schema), lambda: Planned(said), o, 2 * n, n)
    got = {r.stream_id: r for r in transcripts.finish(batch).collect()}
    assert got[1].text == " ".join(["hello world"] * 5) and got[1].language == "fr" and got[1].errors == 0 and got[1].processed == 4 * n
    assert [(s.start, s.end, s.text) for s in got[2].segments][:4] == [(0.0, 1.0, "hello"), (1.0, 2.0, "world"), (1.0, 2.0, "hello"), (2.0, 3.0, "world")]
    # a whole chunk's segments are those of the front's own plan
    chunk = spark.createDataFrame([("c", 0, 0, [0.1] * n)], "clip_id string, chunk_idx int, start_sample long, samples array<float>")
    front = facade.transcribe_segments(facade.score(chunk, lambda: Planned(said), o)).orderBy("seg_idx").collect()
    assert [(s.start, s.end, s.text, s.confidence, s.is_hallucination) for s in front] == [tuple(s) for s in got[1].segments[:2]]
    bad = transcripts.finish(transcripts.transcribe(spark.createDataFrame(rows[:6], schema), lambda: 1 / 0 if False else {}["x"], o, 2 * n, n)).first()
    assert bad.errors == 2 and bad.text == "" and bad.segments == []
    # live, with pushes in the wrong order over the micro-batches, and one twice
    src = str(tmp_path / "in")
    for some in (rows[2:4] + rows[6:8], rows[0:2] + rows[2:4], rows[10:], rows[8:10] + rows[4:6]):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(src)
    live = transcripts.transcribe(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), lambda: Planned(said), o, 2 * n, n)
    q = live.writeStream.format("memory").queryName("transcripts_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    done = {r.stream_id: r for r in transcripts.finish(spark.table("transcripts_out")).collect()}
    assert done == got


def message(*items) -> bytes:
    def number(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return b"".join(number(k << 3 | (0 if isinstance(v, int) else 2)) + (number(v) if isinstance(v, int) else number(len(v)) + v) for k, v in items)


def exported(tensors: dict) -> bytes:
    kinds = {"float32": 1, "float16": 10, "float64": 11, "int64": 7}
    return message((1, 8), (7, message(*[(5, message(*[(1, d) for d in x.shape], (2, kinds[x.dtype.name]), (8, n.encode()), (9, x.tobytes()))) for n, x in tensors.items()])))


def test_exported_weights(spark, tmp_path):
    from chorale.sources import exported as source

    rng = np.random.default_rng(8)
    make = lambda *s: rng.normal(0, 0.2, s).astype("<f4")
    ln = lambda p: {f"{p}.weight": make(64), f"{p}.bias": make(64)}
    attention = lambda p: {k: v for q in "qkv" for k, v in {f"{p}.{q}_proj.weight": make(64, 64), f"{p}.{q}_proj.bias": make(64)}.items()} | {f"{p}.out_proj.weight": make(64, 64), f"{p}.out_proj.bias": make(64)}
    mlp = lambda p: {f"{p}.fc1.weight": make(256, 64), f"{p}.fc1.bias": make(256), f"{p}.fc2.weight": make(64, 256), f"{p}.fc2.bias": make(64)}
    e, d = "model.encoder", "model.decoder"
    enc = {f"{e}.conv1.weight": make(64, 80, 3), f"{e}.conv1.bias": make(64), f"{e}.conv2.weight": make(64, 64, 3), f"{e}.conv2.bias": make(64), f"{e}.embed_positions.weight": make(50, 64)}
    enc |= ln(f"{e}.layer_norm") | attention(f"{e}.layers.0.self_attn") | ln(f"{e}.layers.0.self_attn_layer_norm") | mlp(f"{e}.layers.0") | ln(f"{e}.layers.0.final_layer_norm")
    dec = {f"{d}.embed_positions.weight": make(17, 64), f"{d}.embed_tokens.weight": make(300, 64), "shape_of": np.arange(3), "proj_out.weight": make(2, 2)} | ln(f"{d}.layer_norm")
    for i in (0, 1):
        b = f"{d}.layers.{i}"
        dec |= attention(f"{b}.self_attn") | ln(f"{b}.self_attn_layer_norm") | attention(f"{b}.encoder_attn") | ln(f"{b}.encoder_attn_layer_norm") | mlp(b) | ln(f"{b}.final_layer_norm")
    dec[f"{d}.layers.0.fc1.bias"] = dec[f"{d}.layers.0.fc1.bias"].astype("<f2")
    files = [exported(enc), exported(dec)]
    model = source.load(files)
    assert (model.hparams["n_vocab"], model.hparams["n_text_layer"], model.hparams["n_audio_ctx"], model.hparams["n_text_ctx"], model.hparams["n_mels"]) == (300, 2, 50, 17, 80)
    tool = scorer.TransformerScorer(model)
    assert np.array_equal(tool.tensor("decoder.blocks.1.cross_attn.query.weight"), dec[f"{d}.layers.1.encoder_attn.q_proj.weight"])
    assert np.array_equal(tool.tensor("encoder.conv1.weight"), enc[f"{e}.conv1.weight"]) and model.tensors["encoder.conv1.weight"][0] == (3, 80, 64)
    assert not {"proj_out.weight", "shape_of"} & set(model.tensors) and model.vocab[65] == "A" and model.vocab[299] == "<|extra_299|>" and len(model.vocab) == 300
    x = np.sin(np.arange(3200) / 20).astype(np.float32)
    assert tool.start(x, [1, 2])[0].shape == (300,)
    for name, data in zip(("encoder.onnx", "decoder.onnx", "bad.onnx"), [*files, files[0][:-7]]):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "vocab.json").write_text('{"vocab": {"a": 0, "c": 2}}')
    items = source.read_exported(spark, [str(tmp_path / "encoder.onnx"), str(tmp_path / "decoder.onnx")], str(tmp_path / "vocab.json")).cache()
    assert {r.name: int(r.text) for r in items.where("part = 'hparam'").collect()} == model.hparams
    assert [r.text for r in items.where("part = 'vocab' and idx < 4").orderBy("idx").collect()] == ["a", "<|extra_1|>", "c", "<|extra_3|>"]
    stored = {r.name: (tuple(r["shape"]), bytes(r.raw)) for r in items.where("part = 'tensor'").collect()}
    assert stored == {k: (s, raw) for k, (s, _, raw) in model.tensors.items()}
    assert items.where("part = 'error'").count() == 0
    assert source.read_exported(spark, [str(tmp_path / "bad.onnx")]).where("part = 'error'").count() == 2
    for broken in (b"\x3a\xff\xff\xff\xff\x0f", message((7, message((5, message((1, 4), (2, 1), (8, b"a"), (9, b"1234")))))), message((7, message((5, message((2, 1), (8, 5))))))):
        with pytest.raises(models.ModelError):
            list(source.tensors_of(broken))


def test_blocks_are_preferred(spark):
    rows = [("f", "tensor", "w", 0, "f32"), ("f", "tensor", "w", 1, "q8_0"), ("g", "tensor", "w", 0, "f32"), ("g", "vocab", "w", 0, "utf8")]
    found = models.get_tensor(spark.createDataFrame(rows, "path string, part string, name string, idx int, dtype string"), "w")
    assert sorted((r.path, r.dtype) for r in found.collect()) == [("f", "q8_0"), ("g", "f32")]


def test_beams_keep_attention():
    got = scorer.transcribe(Planned([1, 2]), np.zeros(100, np.float32), scorer.Options(language="en", beam_width=3, word_timestamps=True))[0]
    assert got.tokens == [1, 2] and [a.argmax() for a in got.attention] == [0, 1]
