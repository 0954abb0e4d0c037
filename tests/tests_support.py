"""Files that several tests write."""

import numpy as np


def packed_212(x: np.ndarray) -> bytes:
    v = x.reshape(-1).astype(np.int64)
    v = np.r_[v, np.zeros(len(v) % 2, np.int64)] & 0xFFF
    a, b = v[::2], v[1::2]
    return np.stack([a & 0xFF, (a >> 8) | ((b >> 8) << 4), b & 0xFF], axis=1).astype(np.uint8).tobytes()


def put_record(folder, name, x, gains=(200.0, 100.0, 50.0), zeros=(0, 10, -3), told=True):
    """A format-212 record of samples x channels, and its samples in physical units."""
    n, channels = x.shape
    lines = [f"{name} {channels} 128" + (f" {n}" if told else "")] + [f"{name}.dat 212 {gains[c]} 12 {zeros[c]} 0 0 0 ECG{c}" for c in range(channels)]
    (folder / f"{name}.hea").write_text("\n".join(["# a comment", *lines]) + "\n")
    (folder / f"{name}.dat").write_bytes(packed_212(x))
    return (x - np.array(zeros[:channels])) / np.array(gains[:channels])
