"""Classical denoisers over segments (signal, noise_types, noise_paths): one Arrow pass, segments of a kind together.

Every method returns the cleaned signal and whether it worked; where it didn't, the signal comes back as it was, or
filtered, by the `fallback` parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from biowave.functions import kernels as K

#: The spread of the modes of white noise, as parts of the first one's, by decomposition.
WHITE_EMD = (1.0, 0.4751015, 0.29994139, 0.21576524, 0.13714082, 0.09261460, 0.05600730, 0.05497522)
WHITE_CEEMDAN = (1.0, 0.45871, 0.309190, 0.19652, 0.14093, 0.084863, 0.06222, 0.05597)

LEAST_SAMPLES = 64  # of a signal that is decomposed
SHORTEST = 27  # samples up to which no signal is filtered
HELD = 1 << 19  # samples of signals whose modes a task holds
DECOMPOSE = ("emd", "vmd", "ceemdan")

DEFAULTS = {
    "hp": {"order": 4, "drift_hz": 10.0, "line_hz": 60.0, "line_q": 5.0, "ecg_hz": 40.0, "motion_hz": 40.0, "motion_nstdb_hz": 20.0, "low_hz": 20.0, "high_hz": 500.0, "colour_is_white": True},
    "highpass": {"cutoff_hz": 20.0, "order": 4},
    "ts": {"low_hz": 2.5, "high_hz": 50.0, "order": 4, "least_peaks": 2, "least_gap_s": 0.14, "fallback": "noisy"},
    "emd": {"f_min": 20.0, "f_max": 500.0, "modes": 8, "fallback": "noisy"},
    "vmd": {"f_min": 20.0, "f_max": 500.0, "modes": 10, "alpha": 2000.0, "tau": 0.0, "tol": 1e-7, "fallback": "noisy"},
    "ceemdan": {"f_min": 20.0, "f_max": 500.0, "modes": 8, "trials": 20, "fallback": "noisy"},
}


class Noise:
    """What the names of a segment's noise tell."""

    def __init__(self, types: str | None, paths: str | None):
        up, low = (types or "").upper(), (types or "").lower()
        self.line, self.ecg, self.white, self.drift = "PLI" in up, "ECG" in up, "WGN" in up, "BW" in up
        self.colour = any(c in low for c in ("color", "colour", "pink", "brown"))
        self.motion = "MOA" in up or "+M" in up or up == "M" or "MOTION" in up
        self.nstdb = "nstdb" in f"{types} {paths}".lower() and "machado" not in f"{types} {paths}".lower()
        self.broad = self.white or self.colour or not up.strip()


def iir_chain(x: np.ndarray, rate: float, noise: Noise, p: dict) -> np.ndarray:
    """Filters for what is known to be in the signals: line notch, band, drift, then ECG and motion; short signals stay as they are."""
    if x.shape[1] <= SHORTEST:
        return x
    if noise.line:
        x = K.without_tone(x, rate, p["line_hz"], p["line_q"])
    if noise.white or (noise.colour and p["colour_is_white"]):
        x = K.band_pass(x, rate, p["low_hz"], p["high_hz"], p["order"])
    if noise.drift:
        x = K.high_pass(x, rate, p["drift_hz"], p["order"])
    cut = max(p["ecg_hz"] if noise.ecg else 0.0, (p["motion_nstdb_hz"] if noise.nstdb else p["motion_hz"]) if noise.motion else 0.0)
    return K.high_pass(x, rate, cut, p["order"]) if cut else x


def template_subtraction(x: np.ndarray, rate: float, p: dict) -> tuple[np.ndarray, bool]:
    """Take the mean beat, scaled to each beat by least squares, out of one signal."""
    size, least = int(rate), p.get("least_gap", p["least_gap_s"] * rate)  # least_gap is in samples
    if len(x) < size:  # shorter than the slow average
        return x, False
    band = K.band_pass(x[None], rate, p["low_hz"], p["high_hz"], p["order"])[0]
    slow, fast = (np.convolve(np.abs(band), np.ones(n) / n, "same") for n in (size, max(1, size // 10)))
    up = np.flatnonzero(np.diff(np.r_[0, (slow < fast).astype(int), 0]))
    starts, stops = up[::2], up[1::2]
    peaks = [a + int(np.argmax(band[a:b])) for a, b in zip(starts, stops, strict=True) if b < len(x) and b - a >= least]
    if len(peaks) < p["least_peaks"]:
        return x, False
    beat = int(np.diff(peaks).min())
    left, right = int(0.25 * beat), int(0.45 * beat)
    whole = [k for k in peaks if k >= left and k + right + 1 <= len(x)]
    if not whole:
        return x, False
    waves = np.stack([band[k - left : k + right + 1] for k in whole])
    mean = waves.mean(axis=0)
    size2 = float(mean @ mean)
    out = x.copy()
    for k, wave in zip(whole, waves, strict=True):
        out[k - left : k + right + 1] -= (float(wave @ mean) / size2 if size2 > 0 else 1.0) * mean
    return out, True


class Modes:
    """Decompositions by a method; those of a signal that comes again, for other names or another candidate, are there already."""

    def __init__(self, method: str):
        self.method, self.known = method, {}

    def of(self, x: np.ndarray, p: dict) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each row of x its modes and, where the method gives them, their centres as fractions of the rate."""
        given = tuple(p.get(c) for c in ("modes", "trials", "alpha", "tau", "tol"))
        keys = [(given, row.tobytes()) for row in x]
        if new := {key: k for k, key in enumerate(keys) if key not in self.known}:
            some = x[list(new.values())]
            if self.method == "vmd":
                found = list(zip(*K.vmds(some, p["modes"], p["alpha"], p["tau"], p["tol"]), strict=True))
            else:
                found = [(m, None) for m in (K.ceemdans(some, p["trials"], most=p["modes"]) if self.method == "ceemdan" else K.emds(some, p["modes"]))]
            self.known.update(zip(new, found, strict=True))
        return [self.known[key] for key in keys]


def _cleaned_modes(modes: np.ndarray, centre: np.ndarray, rate: float, noise: Noise, p: dict, baseline: bool = True) -> np.ndarray:
    """Modes (a row each, of any signals) after tone, motion and drift rules."""
    out = modes.copy()
    if noise.line:
        at = (centre > 50) & (centre < 70)
        out[at] = K.without_tones(out[at], rate, centre[at], 20.0)
    if baseline and (noise.motion or noise.drift):
        low = centre < (p["f_min"] if noise.motion else 10)
        out[low] *= 0
        out[~low] = K.high_pass(out[~low], rate, p["f_min"]) if noise.motion else out[~low] - K.low_pass(out[~low], rate, 10.0)
    return out


def _like_beats(modes: np.ndarray, low: np.ndarray) -> list[int]:
    """The six modes of a signal most like its low part."""
    live = [k for k in range(len(modes)) if modes[k].any() and modes[k].std() > 0]
    return sorted(live, key=lambda k: abs(np.corrcoef(low, modes[k])[0, 1]))[-6:] if low.std() > 0 else []


def _by_spread(expected: tuple[float, ...], modes: np.ndarray, keep_last: bool):
    def white(out: np.ndarray) -> np.ndarray:
        spread = modes.std(axis=1)
        level = [expected[min(k, len(expected) - 1)] * spread[0] for k in range(len(modes))]
        out[0] = 0
        for k in range(1, len(out) - keep_last):
            out[k] = 0 if level[k] > spread[k] or spread[0] == 0 else K.soft(out[k], K.threshold_of(modes[k]) / 4)
        return out

    return white


def _put_in(method: str, x: np.ndarray, rate: float, noise: Noise, p: dict) -> np.ndarray:
    """What is decomposed of signals: without what is below the band where the noise is coloured."""
    return K.high_pass(x, rate, p["f_min"]) if noise.colour else x


def decomposed(method: str, x: np.ndarray, rate: float, noise: Noise, p: dict, modes: Modes) -> tuple[np.ndarray, np.ndarray]:
    """Signals from their cleaned modes, and whether that worked; not for those that are short or not finite, or that don't come apart."""
    out, ok = x.copy(), np.zeros(len(x), bool)
    at = np.flatnonzero(np.isfinite(x).all(axis=1)) if x.shape[1] >= LEAST_SAMPLES else np.zeros(0, int)
    if not len(at):
        return out, ok
    try:
        made = _from_modes(method, _put_in(method, x[at], rate, noise, p), rate, noise, p, modes)
    except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError):
        if len(at) > 1:  # by themselves, so that one that fails takes no other with it
            for k in at:
                out[[k]], ok[[k]] = decomposed(method, x[[k]], rate, noise, p, modes)
        return out, ok
    good = np.isfinite(made).all(axis=1)
    out[at[good]], ok[at[good]] = made[good], True
    return out, ok


def _from_modes(method: str, x: np.ndarray, rate: float, noise: Noise, p: dict, modes: Modes) -> np.ndarray:
    """Signals from their modes: those of all signals are filtered together, what depends on a signal's own modes goes signal by signal."""
    found = modes.of(x, p)
    ends = np.cumsum([len(m) for m, _ in found])
    each = [slice(b - len(m), b) for (m, _), b in zip(found, ends, strict=True)]
    flat = np.concatenate([m for m, _ in found])
    if method == "vmd":
        centre = np.concatenate([c for _, c in found]) * rate
        # beats aren't for these modes, and what would take motion or drift takes them for it
        out = _cleaned_modes(flat, centre, rate, noise, p, baseline=not noise.ecg)
        if noise.broad:
            for k, f in enumerate(centre):
                out[k] = K.interval_soft(out[k], K.threshold_of(out[k]) / 4) if p["f_min"] <= f <= p["f_max"] else 0
        return np.stack([out[s].sum(axis=0) for s in each])
    power = np.abs(np.fft.rfft(flat))[:, : x.shape[1] // 2]
    out = _cleaned_modes(flat, power.argmax(axis=1) * rate / x.shape[1], rate, noise, p)
    ceemdan = method == "ceemdan"
    if noise.broad:
        for (m, _), s in zip(found, each, strict=True):
            out[s] = _by_spread(WHITE_CEEMDAN if ceemdan else WHITE_EMD, m, ceemdan)(out[s])
    if noise.ecg:
        low = K.low_pass(x, rate, 40.0)
        beats = np.array([s.start + k for s, v in zip(each, low, strict=True) for k in _like_beats(out[s], v)], int)
        out[beats] = K.high_pass(out[beats], rate, 30.0)
    return np.stack([out[s].sum(axis=0) for s in each])


def _parameters(method: str, params: dict | None) -> dict:
    p = DEFAULTS[method] | ((params or {}).get(method) or {})
    p["modes"] = int(p.get("modes", 0))
    return p


def run(method: str, x: np.ndarray, rate: float, types: str | None, paths: str | None, params: dict | None = None, modes: Modes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cleaned signals (rows of x) and whether each worked; modes may hold decompositions that are there already."""
    p = _parameters(method, params)
    noise = Noise(types, paths)
    if method == "hp":
        return iir_chain(x, rate, noise, p), np.ones(len(x), bool)
    if method == "highpass":
        return (K.high_pass(x, rate, p["cutoff_hz"], p["order"]) if x.shape[1] > SHORTEST else x.copy()), np.ones(len(x), bool)
    if method == "ts":
        out, ok = x.copy(), np.zeros(len(x), bool)
        for k, row in enumerate(x):
            out[k], ok[k] = template_subtraction(row, rate, p)
    else:
        out, ok = decomposed(method, x, rate, noise, p, modes or Modes(method))
    if p["fallback"] == "hp" and not ok.all():
        out[~ok] = iir_chain(x[~ok], rate, noise, DEFAULTS["hp"] | ((params or {}).get("hp") or {}))
    return out, ok


def _runs(part: pd.DataFrame, signal: str) -> Iterator[pd.DataFrame]:
    """Rows one after the other with about HELD samples, so that what is held of their modes is bounded."""
    run = (np.cumsum([0 if v is None else len(v) for v in part[signal]]) // HELD).astype(int)
    for k in np.unique(run):
        yield part[run == k].reset_index(drop=True)


def denoise(rows: DataFrame, method: str, rate: float, signal: str = "noisy", types: str = "noise_types", paths: str = "noise_paths", params: dict | None = None, vary: tuple[str, str] | None = None) -> DataFrame:
    """rows with `denoised` and `ok`. Filter and select rows before: nothing is pushed below this.

    vary names a parameter of the method and the column that holds its value in each row.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("denoised", T.ArrayType(T.DoubleType())), T.StructField("ok", T.BooleanType())])

    def own_params(v: float) -> dict | None:
        return (params or {}) | {method: ((params or {}).get(method) or {}) | {vary[0]: v}} if vary else params

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (some for whole in parts for some in _runs(whole, signal)):
            value = part[vary[1]] if vary else pd.Series(0.0, index=part.index)
            # signals are worked on together whose names tell the same, whatever files their noise is from
            noises = [Noise(t, p) for t, p in zip(part[types], part[paths], strict=True)]
            lengths = part[signal].map(lambda v: -1 if v is None else len(v))
            kinds = pd.Series(list(zip([tuple(vars(n).values()) for n in noises], lengths, value, strict=True)), index=part.index)
            denoised, ok = pd.Series([None] * len(part), index=part.index, dtype=object), pd.Series(False, index=part.index)
            modes = _decomposed_together(part[signal], noises, lengths, value) if method in DECOMPOSE else None
            for (_, n, v), at in kinds.groupby(kinds, dropna=False).groups.items():
                if n > 0:
                    t, p = part.loc[at[0], types], part.loc[at[0], paths]
                    x = np.stack(part.loc[at, signal].to_numpy()).astype(float)
                    y, good = run(method, x, rate, t, p, own_params(v), modes)
                    for k, row, g in zip(at, y, good, strict=True):
                        denoised[k], ok[k] = row, bool(g)
            yield part.assign(denoised=denoised, ok=ok)

    def _decomposed_together(signals: pd.Series, noises: list[Noise], lengths: pd.Series, value: pd.Series) -> Modes:
        """What is decomposed of the signals depends on little of their names, so it is done for more of them than one kind."""
        modes, colour = Modes(method), [n.colour for n in noises]
        alike = pd.DataFrame({"n": lengths.to_numpy(), "colour": colour, "v": value.to_numpy()}).groupby(["n", "colour", "v"], dropna=False)
        for (n, _, v), at in alike.indices.items():
            if n >= LEAST_SAMPLES:
                x = np.stack(signals.iloc[at].to_numpy()).astype(float)
                x, p = x[np.isfinite(x).all(axis=1)], _parameters(method, own_params(v))
                if len(x):
                    modes.of(_put_in(method, x, rate, noises[at[0]], p), p)
        return modes

    return rows.mapInPandas(batch, schema)


def chunked_model(rows: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], signal: str = "noisy", size: int = 2000) -> DataFrame:
    """rows with `denoised` by a model on chunks of `size` samples: scaled by their 99th percentile, clipped, scaled back.

    load() is called once a task and returns a function of a matrix of chunks; the last chunk is padded with zeros.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("denoised", T.ArrayType(T.DoubleType()))])

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            out = []
            for v in part[signal]:
                x = np.zeros(0) if v is None else np.asarray(v, float)
                chunks = np.pad(x, (0, -len(x) % size)).reshape(-1, size)
                by = np.quantile(np.abs(chunks), 0.99, axis=1, keepdims=True) if len(chunks) else np.ones((0, 1))
                by = np.where(by < 1e-9, 1.0, by)
                out.append(None if v is None else (model(np.clip(chunks / by, -1, 1)) * by).reshape(-1)[: len(x)])
            yield part.assign(denoised=out)

    return rows.mapInPandas(batch, schema)
