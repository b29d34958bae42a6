"""Audio clean-up on 16 kHz mono samples, one recording at a time, as an ordered chain of effects.

Recordings arrive as WAV bytes (Spark's ``binaryFile``) and leave as WAV bytes; between effects nothing is written. numpy
only: biquads and the band-pass are run as FFT-free recursions over second-order sections, forward and backward."""

from __future__ import annotations

import io
import json
import wave
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 16_000
EFFECTS = ("autogain", "bandpass", "presence", "dereverb")


class AudioError(ValueError):
    pass


@dataclass(frozen=True)
class AudioOptions:
    target_dbfs: float = -20.0
    max_gain_db: float = 16.0
    crossfade_ms: float = 100.0
    low_hz: float = 150.0
    high_hz: float = 5500.0
    center_hz: float = 3000.0
    boost_db: float = 6.0
    q: float = 1.0
    rt60_floor_ms: float = 300.0
    subtract_factor: float = 1.0
    dereverb_fade_ms: float = 50.0
    chain: tuple[str, ...] = field(default=())

    def __post_init__(self):
        unknown = [e for e in self.chain if e not in EFFECTS]
        if unknown or len(set(self.chain)) != len(self.chain):
            raise AudioError(f"unknown or repeated effect in {self.chain}")
        if not 0 < self.low_hz < self.high_hz < RATE / 2:
            raise AudioError("the band must lie between 0 and half the sample rate")
        if not 0 < self.center_hz < RATE / 2 or self.q <= 0 or abs(self.boost_db) > 24:
            raise AudioError("presence: a centre below half the rate, q > 0 and 24 dB at most")
        if self.rt60_floor_ms <= 0 or self.subtract_factor < 0 or self.dereverb_fade_ms < 0:
            raise AudioError("dereverb: a positive floor, a factor and a fade of at least 0")


def read_wav(content: bytes) -> np.ndarray:
    with wave.open(io.BytesIO(content)) as w:
        if (w.getframerate(), w.getnchannels(), w.getsampwidth()) != (RATE, 1, 2):
            raise AudioError(f"expected {RATE} Hz mono PCM_16, got {w.getparams()}")
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768


def write_wav(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(np.round(np.clip(samples, -1, 1 - 1 / 32768) * 32768).astype("<i2").tobytes())
    return out.getvalue()


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0


def level(x: np.ndarray) -> float:
    return 20 * np.log10(rms(x) + 1e-12)


def around(x: np.ndarray, at_s: float, half_s: float = 0.2) -> tuple[float, float]:
    """Levels (RMS) of what lies within ``half_s`` before and after a moment; 0 where nothing does."""
    centre, width = int(at_s * RATE), int(half_s * RATE)
    return rms(x[max(0, centre - width) : max(0, centre)]), rms(x[max(0, centre) : centre + width])


def levels_around(recordings: DataFrame, cuts: DataFrame, key: str = "recording_id", half_s: float = 0.2) -> DataFrame:
    """(key, boundary, rms_before, rms_after) of cuts (key, boundary, cutoff_ms) in recordings (key, content): a recording is decoded once."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, content, at in zip(pdf[key], pdf["content"], pdf["cuts"], strict=True):
                x = read_wav(bytes(content))
                rows += [(k, c["boundary"], *around(x, c["cutoff_ms"] / 1000, half_s)) for c in at]
            yield pd.DataFrame(rows, columns=[key, "boundary", "rms_before", "rms_after"])

    listed = cuts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("boundary", "cutoff_ms"))).alias("cuts"))
    return recordings.select(key, "content").join(listed, key).mapInPandas(run, f"{key} string, boundary long, rms_before double, rms_after double")


def slices(x: np.ndarray, turns: list[tuple[float, float]]) -> np.ndarray:
    """The samples of turns (start, end in seconds), joined in order of time."""
    return np.concatenate([np.empty(0, x.dtype), *[x[int(a * RATE) : int(b * RATE)] for a, b in sorted(turns)]])


def tile(regions: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
    """Regions without overlaps (the earlier one keeps its samples), with unity regions in the gaps."""
    out, at = [], 0
    for a, b, g in regions:
        a = max(a, at)
        if b <= a:
            continue
        if a > at:
            out.append((at, a, 1.0))
        out.append((a, b, g))
        at = b
    return [*out, (at, n, 1.0)] if at < n else out


def envelope(regions: list[tuple[int, int, float]], n: int, fade: int) -> np.ndarray:
    """Gain for each sample; linear ramps at the joints that reach the middle of either neighbour at most."""
    env = np.ones(n, np.float32)
    for a, b, g in regions:
        env[a:b] = g
    for (a1, b1, g1), (a2, b2, g2) in zip(regions, regions[1:], strict=False):
        reach = min(fade // 2, (b1 - a1) // 2, (b2 - a2) // 2)
        if b1 == a2 and g1 != g2 and reach >= 1:
            env[b1 - reach : b1 + reach] = g1 + (g2 - g1) * np.arange(2 * reach) / (2 * reach)
    return env


def spans_of(turns: list[tuple[float, float]], n: int) -> list[tuple[int, int]]:
    out = [(max(0, round(a * RATE)), min(n, round(b * RATE))) for a, b in sorted(turns)]
    return [(a, b) for a, b in out if b > a]


def autogain(x: np.ndarray, turns: list[tuple[float, float]], o: AudioOptions) -> tuple[np.ndarray, dict]:
    spans = spans_of(turns, len(x))
    if not spans:
        return x, {"turn_count": 0}
    target, most = 10 ** (o.target_dbfs / 20), 10 ** (o.max_gain_db / 20)
    gains = [1.0 if rms(x[a:b]) < 1e-6 else min(target / rms(x[a:b]), most) for a, b in spans]
    fade = max(1, round(RATE * o.crossfade_ms / 1000))
    regions = tile([(a, b, g) for (a, b), g in zip(spans, gains, strict=True)], len(x))
    y = np.clip(x * envelope(regions, len(x), fade), -1.0, 1.0 - 1e-7)
    before, after = np.array([level(x[a:b]) for a, b in spans]), np.array([level(y[a:b]) for a, b in spans])
    drop = (before.std() - after.std()) / before.std() * 100 if before.std() > 0 else 0.0
    return y, {
        "turn_count": len(spans),
        "pre_rms_std_db": round(float(before.std()), 3),
        "post_rms_std_db": round(float(after.std()), 3),
        "spread_drop_pct": round(float(drop), 1),
        "ceiling_hits": int((after - before > o.max_gain_db - 0.5).sum()),
    }


def second_order(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cascade of biquads (b0, b1, b2, a1, a2), by the impulse response where it has died out: one FFT convolution each."""
    y = x.astype(np.float64)
    for b0, b1, b2, a1, a2 in sections:
        radius = max(np.abs(np.roots([1, a1, a2])).max(), 1e-3)
        length = int(min(max(64, np.log(1e-9) / np.log(min(radius, 0.99999))), 1 << 17))
        h, p1, p2 = np.empty(length), 0.0, 0.0
        for k in range(length):
            p0 = (b0, b1, b2)[k] if k < 3 else 0.0
            h[k] = p0 - a1 * p1 - a2 * p2
            p1, p2 = h[k], p1
        size = 1 << int(np.ceil(np.log2(len(y) + length)))
        y = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(h, size), size)[: len(y)]
    return y


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with the ends reflected so that they don't ring."""
    pad = min(len(x) - 1, RATE // 4)
    if pad < 1:
        return x
    wide = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    y = second_order(sections, second_order(sections, wide)[::-1])[::-1]
    return y[pad : pad + len(x)].astype(np.float32)


def butterworth(order: int, low: float, high: float) -> np.ndarray:
    """Band-pass of ``order`` per edge: a high-pass and a low-pass, bilinear transform of the analogue prototype."""
    out = []
    for k in range(order // 2):
        q = 1 / (2 * np.cos(np.pi * (2 * k + 1) / (2 * order)))
        for hz, high_pass in ((low, True), (high, False)):
            w = 2 * np.pi * hz / RATE
            c, alpha = np.cos(w), np.sin(w) / (2 * q)
            b = np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2] if high_pass else [(1 - c) / 2, 1 - c, (1 - c) / 2])
            out.append([*(b / (1 + alpha)), -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)])
    return np.array(out)


def peaking(center: float, boost_db: float, q: float) -> np.ndarray:
    """The audio EQ cookbook's peaking filter."""
    amp, w = 10 ** (boost_db / 40), 2 * np.pi * center / RATE
    alpha, c = np.sin(w) / (2 * q), np.cos(w)
    a0 = 1 + alpha / amp
    return np.array([[(1 + alpha * amp) / a0, -2 * c / a0, (1 - alpha * amp) / a0, -2 * c / a0, (1 - alpha / amp) / a0]])


def bandpass(x, turns, o: AudioOptions):
    return zero_phase(butterworth(4, o.low_hz, o.high_hz), x), {"low_hz": o.low_hz, "high_hz": o.high_hz}


def presence(x, turns, o: AudioOptions):
    return zero_phase(peaking(o.center_hz, o.boost_db / 2, o.q), x), {"center_hz": o.center_hz, "boost_db": o.boost_db}


def rt60(x: np.ndarray) -> float | None:
    """Decay time of a stretch of speech from its backward-integrated energy between -5 and -25 dB; None where it can't be told."""
    if len(x) < RATE // 2:
        return None
    energy = np.cumsum(second_order(butterworth(4, 500, 2000), x)[::-1] ** 2)[::-1]
    if energy[0] <= 0:
        return None
    db = 10 * np.log10(energy / energy[0] + 1e-12)
    use = (db < -5) & (db > -25)
    if use.sum() < 100:
        return None
    slope = np.polyfit(np.flatnonzero(use) / RATE, db[use], 1)[0]
    return -60 / slope if slope < 0 and 0.05 <= -60 / slope <= 2 else None


def subtract_reverb(x: np.ndarray, seconds: float, factor: float, size: int = 512) -> np.ndarray:
    """Spectral subtraction of the late reverberation that earlier frames predict; a tenth of the power always stays."""
    hop = size // 2
    window = np.sin(np.pi * (np.arange(size) + 0.5) / size)
    wide = np.pad(x.astype(np.float64), (hop, size + (-len(x)) % hop))
    frames = np.lib.stride_tricks.sliding_window_view(wide, size)[::hop] * window
    spec = np.fft.rfft(frames)
    power, decay, late = np.abs(spec) ** 2, 10 ** (-6 * hop / RATE / seconds), np.zeros(size // 2 + 1)
    for k in range(len(spec)):
        clean = np.maximum(power[k] - factor * late, 0.1 * power[k])
        late = decay * (late + power[k])
        spec[k] *= np.sqrt(clean / np.maximum(power[k], 1e-20))
    back, out = np.fft.irfft(spec, size) * window, np.zeros(len(wide))
    for k, f in enumerate(back):
        out[k * hop : k * hop + size] += f
    return out[hop : hop + len(x)].astype(np.float32)


def dereverb(x: np.ndarray, turns: list[tuple[float, float]], o: AudioOptions) -> tuple[np.ndarray, dict]:
    y, found = x.copy(), []
    fade = max(1, round(RATE * o.dereverb_fade_ms / 1000))
    for a, b in spans_of(turns, len(x)):
        if b - a < RATE // 2:
            continue
        seconds = max(rt60(x[a:b]) or 0.4, o.rt60_floor_ms / 1000)
        found.append(seconds)
        wet = subtract_reverb(x[a:b], seconds, o.subtract_factor)
        ramp = np.minimum(1, np.minimum(np.arange(b - a), np.arange(b - a)[::-1]) / min(fade, max(1, (b - a) // 2)))
        y[a:b] = (1 - ramp) * y[a:b] + ramp * wet
    return np.clip(y, -1.0, 1.0 - 1e-7), {"turn_count": len(found), "rt60_avg_ms": round(1000 * float(np.mean(found)), 1) if found else 0.0}


def run_chain(content: bytes, turns: list[tuple[float, float]], o: AudioOptions) -> tuple[bytes, list[dict]]:
    if not o.chain:
        return content, []
    x, stats = read_wav(content), []
    for name in o.chain:
        x, s = {"autogain": autogain, "bandpass": bandpass, "presence": presence, "dereverb": dereverb}[name](x, turns, o)
        stats.append({"effect": name} | s)
    return write_wav(x), stats


def clean_audio(audio: DataFrame, turns: DataFrame, options: AudioOptions, key: str = "recording_id") -> DataFrame:
    """(key, content, stats): each recording's WAV through the chain, with its turns (start_ms, end_ms) beside it."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        spans = [(a / 1000, b / 1000) for a, b in zip(right["start_ms"], right["end_ms"], strict=True)]
        rows = [(k, *run_chain(bytes(c), spans, options)) for k, c in zip(left[key], left["content"], strict=True)]
        return pd.DataFrame([(k, c, json.dumps(s)) for k, c, s in rows], columns=[key, "content", "stats"])

    kind = dict(audio.dtypes)[key]
    return audio.select(key, "content").groupBy(key).cogroup(turns.select(key, "start_ms", "end_ms").groupBy(key)).applyInPandas(
        run, f"{key} {kind}, content binary, stats string"
    )
