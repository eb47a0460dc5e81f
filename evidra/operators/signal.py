"""Numeric kernels over sample arrays, one clip a row: Arrow batches in, one row of features or frames out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME, HOP = 2048, 512
# Bounds of applause (variation of flux, rhythm of syllables in Hz, onset density, flatness, length) and of
# sudden sounds (crest factor, attack, and the time until the next one).
VARIATION, SYLLABLES, DENSE, NOISY, APPLAUSE_MS = (0.25, 1.5), (2.0, 8.0), 0.30, 0.40, 1_200
CREST, ATTACK_MS, REFRACTORY_MS = 8.0, 20.0, 120


def frames(x: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Rows of ``frame`` samples each ``hop`` apart; a short signal is one padded row."""
    if len(x) < frame:
        x = np.pad(x, (0, frame - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]


def spectra(x: np.ndarray, rate: int, frame: int = FRAME, hop: int = HOP) -> pd.DataFrame:
    """Root mean square, spectral flatness, centroid and flux of each frame."""
    f = frames(x.astype(np.float64), frame, hop)
    magnitude = np.abs(np.fft.rfft(f * np.hanning(frame), axis=1)) + 1e-12
    bins = np.fft.rfftfreq(frame, 1 / rate)
    flux = np.concatenate([[0.0], np.sqrt((np.maximum(np.diff(magnitude, axis=0), 0) ** 2).sum(axis=1))])
    return pd.DataFrame({
        "rms": np.sqrt((f * f).mean(axis=1)), "flatness": np.exp(np.log(magnitude).mean(axis=1)) / magnitude.mean(axis=1),
        "centroid": (magnitude * bins).sum(axis=1) / magnitude.sum(axis=1), "flux": flux,
    })


def hum_prominence(x: np.ndarray, rate: int, mains: float) -> float:
    """Decibels by which the mains frequency stands above the bins around it."""
    magnitude = np.abs(np.fft.rfft(x * np.hanning(len(x)))) + 1e-12
    at = round(mains * len(x) / rate)
    near = np.r_[max(0, at - 30) : max(0, at - 3), at + 4 : at + 31]
    near = near[near < len(magnitude)]
    return float(20 * np.log10(magnitude[max(0, at - 1) : at + 2].max() / np.median(magnitude[near]))) if len(near) else 0.0


def tempo(flux: np.ndarray, rate: float) -> float | None:
    """Beats a minute, 60 to 200, by autocorrelation of the flux; none for a steady signal."""
    if len(flux) < 8 or flux.std() < 1e-9:
        return None
    d = flux - flux.mean()
    power = np.correlate(d, d, mode="full")[len(d) - 1 :]
    low, high = max(1, int(rate * 60 / 200)), min(len(power) - 1, int(rate * 60 / 60))
    return None if high <= low else float(60 * rate / (low + int(power[low : high + 1].argmax())))


def stft_features(clips: DataFrame) -> DataFrame:
    """clip, frame, rms, flatness, centroid and flux of the frames of ``clips(clip, rate, samples)``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                out = spectra(np.asarray(r.samples, np.float64), r.rate)
                yield out.assign(clip=r.clip, frame=np.arange(len(out)))[["clip", "frame", "rms", "flatness", "centroid", "flux"]]

    return clips.select("clip", "rate", "samples").mapInPandas(run, "clip long, frame long, rms double, flatness double, centroid double, flux double")


def clip_features(clips: DataFrame) -> DataFrame:
    """clip, share of clipped samples, hum at 50 and 60 Hz, and tempo."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                x = np.asarray(r.samples, np.float64)
                beat = tempo(spectra(x, r.rate)["flux"].to_numpy(), r.rate / HOP)
                rows.append((r.clip, float((np.abs(x) >= 0.999).mean()) if len(x) else 0.0, hum_prominence(x, r.rate, 50.0), hum_prominence(x, r.rate, 60.0), beat))
            yield pd.DataFrame(rows, columns=["clip", "clipped", "hum50", "hum60", "bpm"])

    return clips.select("clip", "rate", "samples").mapInPandas(run, "clip long, clipped double, hum50 double, hum60 double, bpm double")


def image_statistics(images: DataFrame) -> DataFrame:
    """frame, mean luma, variance of the Laplacian, contrast, blockiness and noise of grey pictures (frame, width, pixels).

    Noise is what a high-pass filter leaves in the flattest tenth of a picture, where there is no texture.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                g = np.asarray(r.pixels, np.float64).reshape(-1, r.width)
                lap = -4 * g[1:-1, 1:-1] + g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:]
                step = np.abs(np.diff(g, axis=1)).mean(axis=0)
                edge = step[7::8].mean() if len(step) > 7 else 0.0
                noise = np.percentile(np.abs(lap) / 4, 10) if lap.size else 0.0
                rows.append((r.frame, g.mean(), lap.var() if lap.size else 0.0, g.std(), edge / (step.mean() + 1e-9), noise))
            yield pd.DataFrame(rows, columns=["frame", "luma", "sharpness", "contrast", "blockiness", "noise"])

    return images.select("frame", "width", "pixels").mapInPandas(run, "frame long, luma double, sharpness double, contrast double, blockiness double, noise double")


def colourfulness(images: DataFrame) -> DataFrame:
    """frame and colourfulness of pictures (frame, red, green, blue): spread and mean of the two opponent colours, as published
    by Hasler and Suesstrunk; in column functions alone."""
    rg = F.zip_with("red", "green", lambda a, b: a - b)
    yb = F.zip_with(F.zip_with("red", "green", lambda a, b: (a + b) / 2), "blue", lambda m, b: m - b)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    each = images.select("frame", rg.cast("array<double>").alias("rg"), yb.cast("array<double>").alias("yb"))
    mean = {c: F.try_divide(total(c), F.size(c)) for c in ("rg", "yb")}
    variance = {c: F.try_divide(total(F.transform(c, lambda x: x * x)), F.size(c)) - mean[c] ** 2 for c in ("rg", "yb")}
    spread, shift = F.sqrt(F.greatest(variance["rg"] + variance["yb"], F.lit(0.0))), F.sqrt(mean["rg"] ** 2 + mean["yb"] ** 2)
    return each.select("frame", F.coalesce(spread + 0.3 * shift, F.lit(0.0)).alias("colourfulness"))


def phase_correlation(left: np.ndarray, right: np.ndarray, frame: int = 2048, hop: int = 1024) -> float | None:
    """Mean over frames of the normalised product of two channels; silent frames don't count."""
    a, b = frames(left, frame, hop), frames(right, frame, hop)
    power = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    loud = power > 1e-9
    return float(((a * b).sum(axis=1)[loud] / power[loud]).mean()) if loud.any() else None


def channel_metrics(clips: DataFrame) -> DataFrame:
    """clip, share of clipped samples, spread of the channels' levels in dB, and phase correlation, of stereo ``clips(clip, left, right)``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                x = [np.asarray(c, np.float64) for c in (r.left, r.right)]
                level = [20 * np.log10(max(np.sqrt((c * c).mean()), 1e-6)) for c in x]
                rows.append((r.clip, float(np.mean([(np.abs(c) >= 0.999).mean() for c in x])), abs(level[0] - level[1]), phase_correlation(*x)))
            yield pd.DataFrame(rows, columns=["clip", "clipped", "spread_db", "phase"])

    return clips.select("clip", "left", "right").mapInPandas(run, "clip long, clipped double, spread_db double, phase double")


def segments(kinds: DataFrame, least_ms: int = 700, window_ms: int = 1_000) -> DataFrame:
    """Windows (clip, n, kind) as segments: a lone dissenter between two that agree is smoothed, left to right; short ones go."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        k = rows.sort_values("n")["kind"].tolist()
        for i in range(1, len(k) - 1):
            if k[i - 1] == k[i + 1] != k[i]:
                k[i] = k[i - 1]
        out: list[list] = []
        for i, kind in enumerate(k):
            if out and out[-1][0] == kind:
                out[-1][2] = (i + 1) * window_ms
            else:
                out.append([kind, i * window_ms, (i + 1) * window_ms])
        out = [s for s in out if s[2] - s[1] >= least_ms] or out[:1]
        frame = pd.DataFrame(out, columns=["kind", "start_ms", "end_ms"])
        frame["clip"] = rows["clip"].iloc[0]
        return frame[["clip", "kind", "start_ms", "end_ms"]]

    return kinds.select("clip", "n", "kind").groupBy("clip").applyInPandas(scan, "clip long, kind string, start_ms long, end_ms long")


def ducking(levels: DataFrame, least: int = 10) -> DataFrame:
    """clip and how many dB the music lies lower under speech, from ``levels(clip, rms, kind)``; null below ``least`` frames of either."""
    of = lambda kind, p: F.percentile(F.when(F.col("kind") == kind, F.col("rms")), p)
    n = lambda kind: F.count_if(F.col("kind") == kind)
    out = levels.groupBy("clip").agg(of("speech", 0.2).alias("under"), of("music", 0.5).alias("alone"), n("speech").alias("s"), n("music").alias("m"))
    db = 20 * F.log10(F.greatest("alone", F.lit(1e-9)) / F.greatest("under", F.lit(1e-9)))
    return out.select("clip", F.when((F.col("s") >= least) & (F.col("m") >= least), db).alias("db")).withColumn("deliberate", F.col("db") > 3)


def motion(differences: DataFrame) -> DataFrame:
    """clip, sample and whether it is a hard CUT or GRADUAL, from frame differences (clip, n, diff): spikes over four medians and eight."""
    w = Window.partitionBy("clip").orderBy("n")
    typical = differences.groupBy("clip").agg(F.percentile("diff", 0.5).alias("median"))
    spike = (F.col("diff") > 4 * F.col("median")) & (F.col("diff") > 8)
    d = differences.join(typical, "clip").withColumn("spike", spike)
    beside = F.coalesce(F.lag("spike").over(w), F.lit(False)) | F.coalesce(F.lead("spike").over(w), F.lit(False))
    return d.withColumn("kind", F.when(beside, "GRADUAL").otherwise("CUT")).filter("spike").select("clip", "n", "kind")


def modulation_hz(rms: np.ndarray, rate: float) -> float:
    """The strongest rate between 0.5 and 20 Hz at which loudness rises and falls; 0 for a steady or very short signal."""
    d = rms - rms.mean() if len(rms) >= 8 else np.zeros(0)
    if not d.any():
        return 0.0
    power, at = np.abs(np.fft.rfft(d * np.hanning(len(d)))), np.fft.rfftfreq(len(d), 1 / rate)
    power[(at <= 0.5) | (at >= 20)] = -1
    return float(at[power.argmax()]) if power.max() >= 0 else 0.0


def applause_spans(found: pd.DataFrame, rate: float) -> list[tuple[int, int]]:
    """Spans of dense, noisy onsets that are neither steady nor in the rhythm of speech, of the spectra ``found``."""
    flux, flat = found["flux"].to_numpy(), found["flatness"].to_numpy()
    if len(flux) < 20 or flux.mean() <= 1e-12 or not VARIATION[0] <= flux.std() / flux.mean() <= VARIATION[1]:
        return []
    if SYLLABLES[0] <= modulation_hz(found["rms"].to_numpy(), rate) <= SYLLABLES[1]:
        return []
    width = max(4, int(rate))
    density = np.convolve(flux > np.percentile(flux, 60), np.ones(width) / width, mode="same")
    edges = np.flatnonzero(np.diff(np.concatenate([[False], (density > DENSE) & (flat > NOISY), [False]])))
    spans = [(int(a * 1000 / rate), int(b * 1000 / rate)) for a, b in edges.reshape(-1, 2)]
    return [(a, b) for a, b in spans if b - a >= APPLAUSE_MS]


def impulse_shape(x: np.ndarray, rate: int) -> tuple[float, float, float]:
    """Crest factor, rise from a tenth to nine tenths of the peak, and time from the peak to below a tenth, both in ms."""
    level = np.abs(x)
    peak, apex = level.max(), int(level.argmax())
    rise = int((level >= 0.9 * peak).argmax()) - int((level >= 0.1 * peak).argmax())
    below = level[apex:] < 0.1 * peak
    fall = int(below.argmax()) if below.any() else len(x) - apex
    return float(peak / max(np.sqrt((x * x).mean()), 1e-9)), max(0.0, rise / rate * 1000), fall / rate * 1000


def transients(x: np.ndarray, rate: int) -> list[tuple[int, int, float, float, float]]:
    """start and end in ms, crest, attack and decay of sudden sounds; each at least ``REFRACTORY_MS`` after the last one taken."""
    found, out, last = spectra(x, rate), [], -REFRACTORY_MS
    flux = found["flux"].to_numpy()
    limit = np.median(flux) + 3 * flux.std() if len(flux) >= 4 else np.inf
    for k in np.flatnonzero(flux > limit) if limit > 0 else ():
        at = int(k * HOP / rate * 1000)
        begin = int(at / 1000 * rate)
        window = x[max(0, begin - int(0.02 * rate)) : begin + int(0.25 * rate)]
        if at - last < REFRACTORY_MS or len(window) < 64 or np.abs(window).max() <= 1e-9:
            continue
        crest, attack, decay = impulse_shape(window, rate)
        if crest >= CREST and attack <= ATTACK_MS:
            out.append((at, at + int(decay), crest, attack, decay))
            last = at
    return out


def sound_events(clips: DataFrame) -> DataFrame:
    """clip, kind (APPLAUSE, IMPULSE), start_ms, end_ms, crest, attack_ms and decay_ms of ``clips(clip, rate, samples)``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                x = np.asarray(r.samples, np.float64)
                rows += [(r.clip, "APPLAUSE", a, b, None, None, None) for a, b in applause_spans(spectra(x, r.rate), r.rate / HOP)]
                rows += [(r.clip, "IMPULSE", *event) for event in transients(x, r.rate)]
            yield pd.DataFrame(rows, columns=["clip", "kind", "start_ms", "end_ms", "crest", "attack_ms", "decay_ms"])

    return clips.select("clip", "rate", "samples").mapInPandas(run, "clip long, kind string, start_ms long, end_ms long, crest double, attack_ms double, decay_ms double")
