import numpy as np
import pyarrow as pa
import pytest

from shirabe.llm import telephony as A


def test_tables_hold_the_published_values():
    mu, al = A.TABLES["mulaw"].tolist(), A.TABLES["alaw"].tolist()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF], mu[0xF0], mu[0x8F]) == (-32124, 0, 32124, 0, 120, 16764)
    assert (al[0x2A], al[0xAA], al[0x55], al[0xD5], al[0x80], al[0x00]) == (-32256, 32256, -8, 8, 5504, -5504)
    assert sorted(mu) == sorted(-x for x in mu) and len(set(al)) == 256


def scalar_adpcm(raw, block):
    out, broken = [], False
    for at in range(0, len(raw), block):
        b = raw[at : at + block]
        if len(b) < 4:
            broken = True
            continue
        p = int.from_bytes(b[:2], "little", signed=True)
        i = min(b[2], 88)
        out.append(p)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(A.STEPS[i])
                d = step >> 3
                if code & 1:
                    d += step >> 2
                if code & 2:
                    d += step >> 1
                if code & 4:
                    d += step
                p = max(-32768, min(32767, p - d if code & 8 else p + d))
                i = max(0, min(88, i + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                out.append(p)
    return out, broken


@pytest.mark.parametrize("block", [5, 36, 256])
def test_adpcm_same_as_sample_by_sample(block):
    r = np.random.default_rng(block)
    raws = [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 3, 4, 5, block, block + 2, block + 4, 3 * block + 7, 1000)]
    off = np.append(0, np.cumsum([len(x) for x in raws]))
    x, at, broken = A.decode_adpcm(np.frombuffer(b"".join(raws), np.uint8), off, block)
    for i, raw in enumerate(raws):
        assert (x[at[i] : at[i + 1]].tolist(), bool(broken[i])) == scalar_adpcm(raw, block)


@pytest.mark.parametrize("rates", [(8000, 16000), (8000, 24000), (8000, 11025), (16000, 8000), (44100, 8000), (8000, 8000)])
def test_resampling_same_as_direct_sums(rates):
    r = np.random.default_rng(1)
    signals = [r.integers(-30000, 30000, n).astype(np.int16) for n in (0, 1, 5, 40)]
    off = np.append(0, np.cumsum([len(s) for s in signals]))
    y, at = A.resample(np.concatenate(signals), off, *rates)
    g = np.gcd(*rates)
    up, down = rates[1] // g, rates[0] // g
    for i, s in enumerate(signals):
        got = y[at[i] : at[i + 1]]
        assert len(got) == -(-len(s) * up // down)
        for m in range(len(got)):
            base, p = divmod(m * down, up)
            if up == down:
                want = s[m]
            else:
                h = A.kernel(up, down)
                side = h.shape[1] // 2
                want = sum(h[p, k + side] * float(s[base + k]) for k in range(-side, side + 1) if 0 <= base + k < len(s))
            assert abs(got[m] - np.clip(want, -32768, 32767)) <= 1


def test_a_tone_stays_a_tone():
    t = np.arange(4000)
    x = (12000 * np.sin(2 * np.pi * 500 * t / 8000)).astype(np.int16)
    y, _ = A.resample(x, np.array([0, len(x)]), 8000, 16000)
    want = 12000 * np.sin(2 * np.pi * 500 * np.arange(8000) / 16000)
    assert np.abs(y - want)[50:-50].max() < 60


@pytest.mark.parametrize("rate, to", [(44100, 8000), (48000, 8000), (16000, 8000), (48000, 16000)])
def test_what_is_above_the_new_band_goes(rate, to):
    t = np.arange(rate)
    level = lambda f: np.sqrt((A.resample((10000 * np.sin(2 * np.pi * f * t / rate)).astype(np.int16), np.array([0, rate]), rate, to)[0][400:-400].astype(float) ** 2).mean()) / (10000 / np.sqrt(2))
    for f in (to * 0.56, to * 0.625, to * 0.875, to):
        assert level(f) < 0.01
    for f in (to * 0.05, to * 0.2, to * 0.35):
        assert abs(level(f) - 1) < 0.02


def test_more_than_a_cell_holds(spark, monkeypatch):
    monkeypatch.setattr(A, "CELL", 100)
    pcm, n, rate, error = A.decode_batch(pa.array([b"x" * 20, b"x" * 26]), ["mulaw", "mulaw"], 8000, 16000, 256)
    assert [p is None for p in pcm.to_pylist()] == [False, True] and n.to_pylist() == [40, None] and error.to_pylist()[0] is None and error.to_pylist()[1]


def test_spark(spark):
    rows = [(1, b"\x00\xff" * 9, "mulaw", "e"), (2, b"", "alaw", "e"), (3, None, "alaw", "e"), (4, b"abc", "mp3", "e"), (5, b"abc", None, None), (6, b"x" * 70000, "ima_adpcm", "e"), (7, b"y" * 258, "ima_adpcm", "e"), (None, b"a", "mulaw", "e"), (1, b"\x00\xff" * 9, "mulaw", "e")]
    df = spark.createDataFrame(rows, "doc_id long, payload binary, codec string, error string")
    got = A.decode_audio(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and by[1].n_samples == 36 and by[2].pcm == b"" and by[3].pcm is None and by[3].error is None
    assert by[4].pcm is None and "mp3" in by[4].error and by[5].pcm is None and by[5].error is None
    assert by[6].n_samples == 2 * len(scalar_adpcm(b"x" * 70000, 256)[0]) and by[7].error and by[7].n_samples == 2 * 505
    assert by[1].error_in == "e" and A.decode_audio(df.limit(0)).count() == 0
