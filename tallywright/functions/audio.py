"""Audio in numpy: PCM WAV payloads, resampling by two, spectrograms and log-mel bands, for use behind `readers.decoded`."""

from __future__ import annotations

import io
import wave

import numpy as np


def wav(content: bytes) -> np.ndarray:
    """Mono samples in [-1, 1) of a 16-bit PCM WAV payload; channels are averaged. Raises ValueError for anything else."""
    try:
        with wave.open(io.BytesIO(content)) as f:
            if f.getsampwidth() != 2:
                raise ValueError("not 16-bit PCM")
            frames = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
    except (wave.Error, EOFError) as error:
        raise ValueError(str(error)) from error
    return (frames.astype(np.float32) / 32768).mean(axis=1, dtype=np.float32)


def as_wav(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit PCM WAV payload of samples in [-1, 1)."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.round(np.asarray(samples) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def halved(x: np.ndarray, taps: int = 64) -> np.ndarray:
    """Half the rate: a windowed sinc low-pass at a quarter of the rate, then every second sample."""
    n = np.arange(taps + 1) - taps / 2
    h = np.sinc(n / 2) * np.hanning(taps + 3)[1:-1]
    return np.convolve(x, h / h.sum(), "same")[::2].astype(np.float32)


def spectrogram(x: np.ndarray, size: int = 1024, hop: int = 320) -> np.ndarray:
    """Power by frame and frequency, Hann windows centred on multiples of hop, the signal reflected at its ends."""
    x = np.pad(np.asarray(x, np.float64), size // 2, "reflect" if len(x) > size // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.abs(np.fft.rfft(frames * window, axis=1)) ** 2


def mel_bank(rate: int, size: int, bands: int, low: float = 50.0, high: float | None = None) -> np.ndarray:
    """Triangular filters, evenly spaced in mel (2595 log10(1 + f / 700)): bands x frequencies."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high or rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, rate: int, bands: int = 128, size: int = 1024, hop: int = 320, floor: float = 80.0) -> np.ndarray:
    """Decibels by band and frame, relative to the loudest and no lower than floor below it."""
    power = mel_bank(rate, size, bands) @ spectrogram(x, size, hop).T
    level = 10 * np.log10(np.maximum(power, 1e-10))
    return np.maximum(level, level.max() - floor).astype(np.float32)


def kaldi_bank(rate: int, size: int, bands: int, low: float = 20.0, high: float | None = None) -> np.ndarray:
    """Filters that are triangles in mel (1127 ln(1 + f / 700)), evenly spaced there: bands x size / 2 frequencies, without the last."""
    mel = lambda f: 1127 * np.log(1 + f / 700)
    edges = np.linspace(mel(low), mel(high or rate / 2), bands + 2)[:, None]
    f = mel(np.arange(size // 2) * rate / size)
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])))


def kaldi_energies(frames: np.ndarray, rate: int, bands: int) -> np.ndarray:
    """Log energies, frames x bands, of frames of samples: mean taken off, pre-emphasis of 0.97, Povey window, power spectrum, bank.

    The transform's size is the power of two that holds a frame; energies are no lower than single precision's epsilon.
    """
    x = np.asarray(frames, np.float64)
    n = x.shape[1]
    size = 1 << max(0, n - 1).bit_length()
    x = x - x.mean(axis=1, keepdims=True)
    x = x - 0.97 * np.concatenate([x[:, :1], x[:, :-1]], axis=1)
    x = x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))) ** 0.85
    power = np.abs(np.fft.rfft(x, size, axis=1)[:, : size // 2]) ** 2
    return np.log(np.maximum(power @ kaldi_bank(rate, size, bands).T, np.finfo(np.float32).eps))
